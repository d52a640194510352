from __future__ import annotations

import base64
import hashlib
import textwrap

import duckdb
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import quotes, syncmers, warc

PAGES = [(1, "http://a/ü?q=1", "<p>one</p>"), (2, "http://b/\r\nX: y", "<p>two é</p>"), (3, None, "<p>one</p>"), (4, "http://c", None), (5, "http://d", ""), (6, "http://e", "x" * 300_000), (6, "http://e", "x" * 300_000), (0, "http://f", "<p>two é</p>"), (None, "http://g", "alone\r\n\r\nWARC/1.1"), (8, "http://h", "<p>one</p>")]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("archive_bytes", [16_000_000, 700])
def test_archives(pages, monkeypatch, archive_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    index = warc.write_archives(pages)
    assert index.count() == len(PAGES)
    first = {}
    for page_id, _, html in PAGES:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    expected = []
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        revisit = page_id is not None and first[html or ""] != page_id
        expected.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[html or ""] if revisit else None, None if revisit else data))
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in warc.read_records(index).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_selected_records_are_read_in_few_ranges(pages):
    index = warc.write_archives(pages.coalesce(1))
    found = warc.read_records(index, F.col("page_id").isin(1, 8, 6)).collect()
    assert sorted(r.page_id for r in found) == [1, 6, 6, 8]
    assert all(warc.write_archives(pages, min_payload=100).filter("payload_digest is not null").collect()[i].record_type for i in range(len(PAGES)))


def test_hot_payloads_and_urls_read_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARE", 3)
    monkeypatch.setattr(warc, "broadcast_if_small", lambda df: df)
    rows = [(i, f"http://h/{i} ü" if i % 2 else None, "same" if i < 40 else f"p{i % 50}") for i in range(100)]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = {r.page_id: r for r in warc.read_records(index).collect()}
    first = {}
    for i, _, html in rows:
        first.setdefault(html, i)
    assert all(found[i].refers_to == (None if first[html] == i else first[html]) for i, _, html in rows)
    assert {r.page_id: r.url for r in index.collect()} == {i: r.url for i, r in found.items()} and found[2].url is None and "%C3%BC" in found[3].url


def test_no_pages(pages):
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


THREADS = [
    (1, 0, "u", "Hello there\nhow are you?\n\nSecond para"), (1, 1, "a", "> Hello   THERE\n> how are you?\nFine"), (1, 2, "u", "> > how are you?\r\n> Fine\r\nok thanks"), (1, 3, "a", ">unknown thing\nbye"),
    (1, 4, "b", ">> Hello there\n> something nobody\nhm"), (1, 4, "b", ">> Hello there\n> something nobody\nhm"), (1, 5, "b", "> hm"), (2, 0, "u", "> Hello there"), (None, 1, "u", "> Hello there"), (2, None, "x", None), (2, 1, "u", ""),
]


def test_quotations_are_linked(spark):
    frame = spark.createDataFrame([(*t, 1) for t in THREADS], "conv_id long, turn long, role string, text string, depth int")
    found = {(r.conv_id, r.turn): r for r in quotes.linked_conversations(frame).collect()}
    assert quotes.linked_conversations(frame).count() == len(THREADS)
    replies = {(1, 1): (0, 0, 1), (1, 2): (1, 0, 2), (1, 4): (0, 0, 1), (1, 5): (4, 0, 2)}
    for key, r in found.items():
        expected = replies.get(key, (None, key[1], 0))
        assert (r.parent_turn, r.root_turn, r.depth) == expected, key
    assert found[1, 2].own_text == "ok thanks" and (found[1, 4].n_quoted, found[1, 4].n_linked) == (2, 1)
    assert quotes.linked_conversations(frame.limit(0)).count() == 0


def test_quotations_against_sql(spark):
    frame = spark.createDataFrame(THREADS, "conv_id long, turn long, role string, text string")
    connection = duckdb.connect()
    connection.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    connection.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", THREADS)
    answer = connection.execute(quotes.OP3_SQL)
    columns = [c[0] for c in answer.description]
    own = [tuple(r[c] for c in columns) for r in quotes.as_rows(frame).collect()]
    assert sorted(own, key=str) == sorted(answer.fetchall(), key=str)


def test_long_chain_of_replies(spark):
    rows = [(7, 0, "u", "start")] + [(7, i, "u", f"> {'start' if i == 1 else f'say {i - 1}'}\nsay {i}") for i in range(1, 40)]
    found = quotes.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {(r.turn, r.depth, r.root_turn) for r in found.collect()} == {(i, i, 0) for i in range(40)}


def test_branches_stand_under_their_parents(spark, monkeypatch):
    monkeypatch.setattr(quotes, "tasks_for", lambda *a, **k: 5)
    rows = [(1, 0, "u", "zero"), (1, 1, "a", "> zero\none"), (1, 2, "b", "> zero\ntwo"), (1, 3, "u", "> one\nthree"), (1, 4, "a", "four"), (1, 5, "b", "> three\nfive"), (1, 6, "a", "> two\nsix"), (2, 0, "u", "other")]
    found = quotes.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    order = [(r.turn, r.own_text) for r in sorted(found, key=lambda r: (r.conv_id, r.position))]
    assert order == [(0, "zero"), (1, "one"), (3, "three"), (5, "five"), (2, "two"), (6, "six"), (4, "four"), (0, "other")]
    assert {r.turn: r.reply_path for r in found if r.conv_id == 1}[5] == [0, 1, 3, 5] and sorted(r.position for r in found if r.conv_id == 1) == list(range(1, 8))


def test_many_lines(spark):
    text = "\n".join(("> " if i % 3 else "") + f"line {i}" for i in range(20_000))
    found = quotes.linked_conversations(spark.createDataFrame([(1, 0, "u", "line 1\nline 2"), (1, 1, "a", text)], "conv_id long, turn long, role string, text string"))
    assert {r.turn: (r.n_quoted, r.n_linked) for r in found.collect()} == {0: (0, 0), 1: (6667, 1)}


def test_rewrapped_paragraphs_and_single_sentences(spark):
    paragraphs = [f"The {n} paragraph says that the river rose over its banks in the night. Nobody had seen the {n} flood coming, and the bridge was lost!" for n in ("first", "second", "third")]
    wrapped = ["\n".join(f"> {line}" for line in textwrap.wrap(p, 40)) for p in paragraphs]
    rows = [
        (1, 0, "u", "\n\n".join(paragraphs)),
        (1, 1, "a", wrapped[0] + "\n>\n" + wrapped[1] + "\n\nTwo of three."),
        (1, 2, "u", "> Nobody had seen the second flood\n> coming, and the bridge was lost!\nOne sentence."),
        (1, 3, "a", "> Nobody had seen the fourth flood\n> coming.\nNobody's."),
        (1, 4, "u", "> Two of three.\n>\n" + wrapped[2] + "\nA newer one with an older one."),
    ]
    found = quotes.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((r.turn, r.n_quoted, r.n_linked, r.parent_turn, r.root_turn) for r in found.collect()) == [(0, 0, 0, None, 0), (1, 1, 1, 0, 0), (2, 1, 1, 0, 0), (3, 1, 0, None, 3), (4, 1, 1, 1, 0)]
    # The SQL says the same of them.
    conversations = pa.table({"conv_id": [r[0] for r in rows], "turn": [r[1] for r in rows], "role": [r[2] for r in rows], "text": [r[3] for r in rows]})
    told = duckdb.connect().register("conversations", conversations).execute(quotes.OP3_SQL)
    columns = [c[0] for c in told.description]
    own = quotes.as_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select(*columns).collect()
    assert sorted(map(tuple, own)) == sorted(told.fetchall())


def sketch(text):
    data = text.encode()
    signed = lambda b: (x := xxhash.xxh64_intdigest(b, 42)) - (2**64 if x >= 2**63 else 0)
    small = [signed(data[i : i + syncmers.S]) for i in range(len(data) - syncmers.S + 1)]
    width, found = syncmers.K - syncmers.S + 1, set()
    for i in range(len(data) - syncmers.K + 1):
        if min(small[i : i + width]) in (small[i], small[i + width - 1]):
            found.add(xxhash.xxh64_intdigest(data[i : i + syncmers.K], 42) >> 32)
    return sorted(found or {xxhash.xxh64_intdigest(data, 42) >> 32})[: syncmers.SKETCH]


def likeness(a, b):
    union = sorted({*a, *b})[: syncmers.SKETCH]
    return len({*union} & {*a} & {*b}) / len(union)


@pytest.mark.parametrize("range_bytes", [4_000_000, 2000])
def test_edited_texts(spark, documents, monkeypatch, range_bytes):
    monkeypatch.setattr(syncmers, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(syncmers, "SEGMENT", 512)
    unique = documents.dropDuplicates(["doc_id"])
    rows = sorted(((r.doc_id, r.text or "") for r in unique.collect()), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    found = {r.doc_id: r for r in syncmers.with_edits(unique).collect()}
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        r, printed = found[doc_id], lambda s: "".join(f"{x:08x}" for x in s)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (printed(sketch(text)), printed(sketch(edited)))
        assert (r.near_edited, r.near_next) == pytest.approx((likeness(sketch(text), sketch(edited)), likeness(sketch(text), sketch(following))))


def test_ranges_by_two_levels(spark):
    for n in (0, 1, 2, 3, 10, 101):
        cuts = [3 * i for i in range(n)]
        keys = spark.range(-2, 3 * n + 2)
        assert all(r.found == sum(c <= r.id for c in cuts) for r in keys.select("id", syncmers.range_of(F.col("id"), cuts).alias("found")).collect())


def test_fingerprint_edges(documents, empty):
    assert syncmers.with_edits(documents).count() == documents.count()
    assert syncmers.with_edits(empty).count() == 0
    alone = syncmers.with_edits(documents.filter("doc_id = 8")).first()
    assert alone.near_next == 1.0


def test_positional_matches(spark):
    text = "the anchors of a text stand where they stood before, only further on in the other one"
    docs = spark.createDataFrame([(1, text), (2, "0123456789" + text), (3, "something else altogether, with nothing shared at all")], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "left_id long, right_id long")
    found = syncmers.positional_matches(pairs, syncmers.anchors(docs)).collect()
    assert [(r.left_id, r.right_id, r.shift) for r in found] == [(1, 2, 10)]


def test_likeness_is_near_the_exact_one(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    errors = []
    for text in texts:
        edited = text[: len(text) * 2 // 3] + texts[0][: len(text) // 3]
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(syncmers, "SKETCH", 10**9)
            exact = likeness(sketch(text), sketch(edited))
        errors.append(abs(exact - likeness(sketch(text), sketch(edited))))
    assert sum(errors) / len(errors) < 0.06 and max(errors) < 0.25


def test_working_tables_go(spark, tmp_path):
    import os

    from lexmill.llm import common

    common.materialize(spark.range(3), "three")
    folder = common._own_folder(spark).removeprefix("file:")
    assert os.listdir(folder)
    common.clear_working_tables(spark)
    assert not os.path.exists(folder)
