"""Passages that documents repeat, by relative Lempel-Ziv parsing.

Every word that a window of ``window`` words covers is removed if the same window also starts in
a document with a smaller id.

Routing.  Each window has a seed: the least (by hash) of its runs of ``seed`` words, the leftmost of
equals.  Equal windows have equal seeds at the same place, so consecutive windows with the same
seed form a phrase, and only phrases of one seed can share a window.  Phrases that are equal count
as one, with the first document that holds it: each later document repeats it as a whole, as one
factor.  What is left are seeds with several phrases, where copies begin, end or differ.

Parsing.  Those phrases are dealt by seed over reference blocks.  A block indexes its phrases, in
order of their documents, with a suffix array, the lengths of common prefixes and, for each place,
the longest match that starts in an earlier document.  Each phrase is factored greedily: the
longest match, or one word if there is none, and on from its end.  Factors of at least ``window``
words are duplicate spans.  A repeated window that a factor's end cuts is found by looking up the
matches of the places less than a window before the end.  So no repeated window is missed.

A seed with more than ``hot`` phrases would fill a block, so its phrases are cut down to single
windows, each routed by its own hash, and the first document of each is found by an aggregation.
Rows of hot keys (seeds, phrases, repeated rows) are dealt over salts.

Words are compared by their 64-bit XXH64, phrases and windows by 64-bit hashes of those.

Defined cases: a null text has no words; a null id counts as larger than any other; rows of the
same id never remove each other's words; repeated rows have the same result each; texts of fewer
words than a window stay as they are; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import chunks_by_total, hot_keys, join_hot, materialize, table
from lexmill.llm.words import numbered_words, slices_of, whole_texts

WINDOW, SEED = 50, 20
HOT_PHRASES, BLOCK_WORDS = 2000, 400_000
SLICE_BYTES = 4_000_000
LAST_ID = (1 << 63) - 1
_ROW = ["doc", "text_hash"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` words from each place on, put together from runs of powers of two."""
    out, covered, power, width = None, 0, words, 1
    while True:
        if length & width:
            if out is None:
                out = power
            else:
                n = max(0, len(words) - covered - width + 1)
                out = _joined(out[:n], power[covered : covered + n])
            covered += width
        if covered == length:
            return out
        n = max(0, len(power) - width)
        power = _joined(power[:n], power[width : width + n])
        width *= 2


def least_places(values: np.ndarray, span: int) -> np.ndarray:
    """The place of the least of the ``span`` values from each place on, the leftmost of equals."""
    best, width = np.arange(len(values)), 1

    def lesser(apart: int) -> np.ndarray:
        n = max(0, len(best) - apart)
        left, right = best[:n], best[apart : apart + n]
        return np.where(values[right] < values[left], right, left)

    while 2 * width <= span:
        best = lesser(width)
        width *= 2
    return lesser(span - width) if width < span else best


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of all words in turn, the number of words of each text)."""
    numbers, words, counts = numbered_words(texts, lower=False)
    digests = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))
    return digests[numbers], counts


def phrases(words: np.ndarray, counts: np.ndarray, window: int, seed: int) -> dict[str, np.ndarray]:
    """The phrases of documents of so many words in a row: document, seed, phrase (hashes), start (in
    the document) and windows (their number)."""
    none = {"document": np.zeros(0, np.int64), "seed": np.zeros(0, np.uint64), "phrase": np.zeros(0, np.uint64), "start": np.zeros(0, np.int64), "windows": np.zeros(0, np.int64)}
    if len(words) < window:
        return none
    first_word = np.cumsum(counts) - counts
    n_windows = np.maximum(counts - window + 1, 0)
    document = np.repeat(np.arange(len(counts)), n_windows)
    if not len(document):
        return none
    place = np.arange(len(document)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + first_word[document]
    seeds, whole = run_hashes(words, seed), run_hashes(words, window)
    least = least_places(seeds, window - seed + 1)[place]
    opens = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (document[1:] != document[:-1]))))
    closes = np.append(opens[1:], len(document)) - 1
    n = closes - opens + 1
    names = _joined(_joined(whole[place[opens]], whole[place[closes]]), n.astype(np.uint64))
    return {"document": document[opens], "seed": seeds[least[opens]], "phrase": names, "start": place[opens] - first_word[document[opens]], "windows": n}


def _phrase_rows(window: int, seed: int):
    def run(batches):
        for batch in batches:
            for first, last in slices_of(batch.column("text"), SLICE_BYTES):
                own = batch.slice(first, last - first)
                found = phrases(*word_hashes(own.column("text")), window, seed)
                rows = pa.array(found["document"])
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc").take(rows), own.column("text_hash").take(rows), pa.array(found["seed"].view(np.int64)), pa.array(found["phrase"].view(np.int64)), pa.array(found["start"].astype(np.int32)), pa.array(found["windows"].astype(np.int32))],
                    names=["doc", "text_hash", "seed", "phrase", "start", "windows"],
                )

    return run


def _first_of_row(batch: pa.RecordBatch, before: tuple) -> tuple[np.ndarray, tuple]:
    """Which rows are not the same document as the row before them."""
    doc, text = batch.column("doc").to_numpy(), batch.column("text_hash").to_numpy()
    same = (doc == np.append(before[0], doc[:-1])) & (text == np.append(before[1], text[:-1])) if before else np.append(False, (doc[1:] == doc[:-1]) & (text[1:] == text[:-1]))
    return ~same, (doc[-1:], text[-1:])


def _wanted_words(window: int):
    """The words of the wanted phrases of each document; of phrases that are cut down, the hashes of their windows."""

    def run(batches):
        before: tuple = ()
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh, before = _first_of_row(batch, before)
            batch = batch.filter(pa.array(fresh))
            for first, last in slices_of(batch.column("text"), SLICE_BYTES):
                own = batch.slice(first, last - first)
                words, counts = word_hashes(own.column("text"))
                first_word = np.cumsum(counts) - counts
                out = []
                for row, (doc, wanted) in enumerate(zip(own.column("doc").to_pylist(), own.column("wanted").to_pylist())):
                    for w in wanted:
                        at = first_word[row] + w["start"]
                        told = words[at : at + w["windows"] + window - 1]
                        out.append((w["block"], w["phrase"], doc, (run_hashes(told, window) if w["block"] is None else told).tobytes()))
                block, phrase, doc, data = zip(*out) if out else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(phrase, pa.int64()), pa.array(doc, pa.int64()), pa.array(data, pa.binary())], names=["block", "phrase", "doc", "data"])

    return run


class ReferenceBlock:
    """Suffix array over sequences, each of one document, with the longest earlier match of each place.

    ``match[p]`` is the length of the longest run of words from place ``p`` on that also starts in a sequence
    of a smaller document; sequences end with a symbol of their own, so no match leaves its sequence."""

    def __init__(self, sequences: list[np.ndarray], docs: np.ndarray) -> None:
        lengths = np.array([len(s) + 1 for s in sequences], dtype=np.int64)
        self.first, self.end = np.cumsum(lengths) - lengths, np.cumsum(lengths) - 1
        n = int(lengths.sum())
        inside = np.ones(n, bool)
        inside[self.end] = False
        symbol = np.zeros(n, np.int64)
        symbol[inside] = np.unique(np.concatenate(sequences), return_inverse=True)[1]
        symbol[self.end] = symbol.max(initial=0) + 1 + np.arange(len(sequences))
        self.ranks = [symbol]
        while 1 << (len(self.ranks) - 1) < lengths.max():
            held, width = self.ranks[-1], 1 << (len(self.ranks) - 1)
            beyond = np.zeros(n, np.int64)
            beyond[: n - width] = held[width:] + 1
            self.ranks.append(np.unique(held * (n + 2) + beyond, return_inverse=True)[1])
        self.suffixes = np.argsort(self.ranks[-1], kind="stable")
        self.common = self._common(self.suffixes[:-1], self.suffixes[1:])
        owner = np.unique(docs, return_inverse=True)[1][np.repeat(np.arange(len(sequences)), lengths)][self.suffixes]
        before = self._nearest_smaller(owner, self.common)
        after = self._nearest_smaller(owner[::-1], self.common[::-1])[::-1]
        self.match = np.zeros(n, np.int64)
        self.match[self.suffixes] = np.maximum(before, after)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``a`` and at ``b`` share."""
        length = np.zeros(len(a), np.int64)
        for step in reversed(range(len(self.ranks))):
            held = self.ranks[step]
            length += (held[np.minimum(a + length, len(held) - 1)] == held[np.minimum(b + length, len(held) - 1)]).astype(np.int64) << step
        return length

    @staticmethod
    def _nearest_smaller(owner: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Symbols that each suffix shares with the nearest one before it of a smaller owner (0: there is none).

        Runs of 2, 4, ... entries hold their least owner and least common length; each suffix steps over the
        runs, the longest first, that have no smaller owner."""
        n = len(owner)
        owners, commons = [owner], [common]
        while 2 << (len(owners) - 1) <= n - 1:
            half = 1 << (len(owners) - 1)
            o, c = owners[-1], commons[-1]
            owners.append(np.minimum(o[:-half], o[half:]))
            commons.append(np.minimum(c[:-half], c[half:]))
        at, shared = np.arange(n), np.full(n, np.iinfo(np.int64).max)
        for step in reversed(range(len(owners))):
            start = at - (1 << step)
            over = start >= 0
            over[over] = owners[step][start[over]] >= owner[over]
            shared[over] = np.minimum(shared[over], commons[step][start[over]])
            at[over] = start[over]
        found = at > 0
        shared[found] = np.minimum(shared[found], common[at[found] - 1])
        shared[~found] = 0
        return shared

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, lengths) of the greedy factors of all sequences."""
        places, lengths, at = [], [], np.arange(len(self.first))
        place = self.first.copy()
        while len(at := at[place[at] < self.end[at]]):
            length = np.maximum(1, self.match[place[at]])
            places.append(place[at])
            lengths.append(length)
            place[at] += length
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places, lengths = np.concatenate(places), np.concatenate(lengths)
        order = np.argsort(places, kind="stable")
        return places[order], lengths[order]

    def spans(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, lengths) of the duplicate spans: factors of ``window`` words, and matches of as many
        that begin less than a window before a factor's end."""
        places, lengths = self.factors()
        at_factor, to_end = np.zeros(len(self.match), bool), np.zeros(len(self.match), np.int64)
        at_factor[places] = True
        inside = np.repeat(places, lengths) + np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        to_end[inside] = np.repeat(places + lengths, lengths) - inside
        looked_up = at_factor | ((to_end > 0) & (to_end < window))
        found = np.flatnonzero(looked_up & (self.match >= window))
        return found, self.match[found]


def _parse_block(window: int):
    def run(block: pa.Table) -> pa.Table:
        names, once = np.unique(block.column("phrase").to_numpy(), return_index=True)  # a document may stand in several rows
        docs = block.column("doc").to_numpy()[once]
        data = block.column("data")
        sequences = [np.frombuffer(data[i].as_py(), np.uint64) for i in once.tolist()]
        order = np.argsort(docs, kind="stable")
        names, docs, sequences = names[order], docs[order], [sequences[i] for i in order.tolist()]
        reference = ReferenceBlock(sequences, docs)
        place, length = reference.spans(window)
        which = np.searchsorted(reference.first, place, side="right") - 1
        start = (place - reference.first[which]).astype(np.int32)
        return pa.table({"phrase": pa.array(names[which]), "start": pa.array(start), "words": pa.array(length.astype(np.int32))})

    return run


def _windows_of(batches):
    for batch in batches:
        data = [np.frombuffer(d, np.int64) for d in batch.column("data").to_pylist()]
        n = np.array([len(d) for d in data], dtype=np.int64)
        rows = pa.array(np.repeat(np.arange(len(data)), n))
        start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        flat = np.concatenate(data) if data else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("phrase").take(rows), batch.column("doc").take(rows), pa.array(start.astype(np.int32)), pa.array(flat)], names=["phrase", "doc", "start", "hash"])


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("text_hash"), "doc_id", text.alias("text"))


def _spans_of_phrases(docs: DataFrame, contested: DataFrame, hot_rows: DataFrame, window: int, hot_phrases: int, block_words: int) -> DataFrame:
    """(phrase, spans): what the first document of a contested phrase repeats of smaller documents."""
    n_words = contested.filter(F.col("n_phrases") <= hot_phrases).agg(F.sum(F.col("first.windows") + (window - 1))).first()[0] or 0
    n_blocks = chunks_by_total(n_words, block_words)
    block = F.when(F.col("n_phrases") <= hot_phrases, F.pmod(F.xxhash64("seed"), F.lit(n_blocks)).cast("int")).alias("block")
    wanted = contested.select("first.doc", "first.text_hash", F.struct(block, "phrase", "first.start", "first.windows").alias("wanted")).groupBy(*_ROW).agg(F.collect_list("wanted").alias("wanted"))
    held = join_hot(docs.select(*_ROW, "text"), wanted, _ROW, hot_rows, F.monotonically_increasing_id())
    told = materialize(held.select(*_ROW, "text", "wanted").mapInArrow(_wanted_words(window), "block int, phrase long, doc long, data binary"), "contested-phrases")
    parsed = told.filter("block is not null").repartition(n_blocks, "block").groupBy("block").applyInArrow(_parse_block(window), "phrase long, start int, words int")
    # Repeated rows give a phrase several times: once is enough.
    windows = told.filter("block is null").dropDuplicates(["phrase"]).select("phrase", "doc", "data").mapInArrow(_windows_of, "phrase long, doc long, start int, hash long")
    windows = materialize(windows, "windows-of-hot-seeds")
    firsts = materialize(windows.groupBy("hash").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), F.count("*").alias("n")).filter("first_doc < last_doc"), "first-windows")
    cut = join_hot(windows, firsts.select("hash", "first_doc"), ["hash"], hot_keys(firsts, ["hash"], "n", windows.count()), F.xxhash64("phrase")).filter("doc > first_doc")
    both = parsed.unionByName(cut.select("phrase", "start", F.lit(window).alias("words")))
    return both.groupBy("phrase").agg(F.collect_list(F.struct("start", "words")).alias("spans"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED, hot_phrases: int = HOT_PHRASES, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(doc, text_hash, spans of (start, words)) of the documents that repeat windows of smaller ones (spans may
    overlap), and the hot ones among the keys (doc, text_hash) of ``docs``."""
    rows = _rows(docs)
    all_phrases = materialize(rows.select(*_ROW, "text").mapInArrow(_phrase_rows(window, seed), "doc long, text_hash long, seed long, phrase long, start int, windows int"), "phrases")
    first = F.min(F.struct("doc", "text_hash", "start", "windows")).alias("first")
    distinct = materialize(all_phrases.groupBy("seed", "phrase").agg(first, F.max("doc").alias("last_doc"), F.count("*").alias("n")), "distinct-phrases")
    seeds = distinct.groupBy("seed").agg(F.count("*").alias("n_phrases"), F.min("first.doc").alias("first_doc"), F.max("last_doc").alias("last_doc"))
    seeds = materialize(seeds.filter("first_doc < last_doc").select("seed", "n_phrases"), "repeated-seeds")
    n_rows, n_distinct = all_phrases.count(), distinct.count()
    repeated = materialize(join_hot(distinct, seeds, ["seed"], hot_keys(seeds, ["seed"], "n_phrases", n_distinct), F.col("phrase")), "repeated-phrases")
    # Each row's first window starts at word 0.
    copies = all_phrases.filter("start = 0").groupBy(*_ROW).agg(F.count("*").alias("n"))
    hot_rows = materialize(hot_keys(copies, _ROW, "n", n_rows), "hot-rows")
    inner = _spans_of_phrases(rows, repeated.filter("n_phrases > 1"), hot_rows, window, hot_phrases, block_words)
    told = repeated.select("phrase", F.col("first.doc").alias("first_doc"), "last_doc", "n").join(inner, "phrase", "left").filter("first_doc < last_doc or spans is not null")
    told = materialize(told, "judged-phrases")
    met = join_hot(all_phrases, told.select("phrase", "first_doc", "spans"), ["phrase"], hot_keys(told, ["phrase"], "n", n_rows), F.xxhash64("doc", "start"))
    whole = F.array(F.struct(F.col("start"), (F.col("windows") + (window - 1)).alias("words")))
    part = F.transform("spans", lambda s: F.struct((F.col("start") + s["start"]).alias("start"), s["words"].alias("words")))
    found = met.select(*_ROW, F.when(F.col("doc") > F.col("first_doc"), whole).otherwise(part).alias("spans")).filter("spans is not null")
    return materialize(found.groupBy(*_ROW).agg(F.flatten(F.collect_set("spans")).alias("spans")), "repeated-spans"), hot_rows


def _keep(batches):
    for batch in batches:
        for first, last in slices_of(batch.column("text"), SLICE_BYTES):
            own = batch.slice(first, last - first)
            lists = pc.ascii_split_whitespace(whole_texts(own.column("text")))
            filled = pc.not_equal(lists.flatten(), "").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(own)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            words, row = lists.flatten().filter(pa.array(filled)), row[filled]
            n_words = np.bincount(row, minlength=len(own)).astype(np.int64)
            first_word = np.cumsum(n_words) - n_words
            depth = np.zeros(len(words) + 1, np.int64)
            spans = own.column("spans")
            n_spans = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
            flat = spans.flatten()
            start = first_word[np.repeat(np.arange(len(own)), n_spans)] + flat.field("start").to_numpy(zero_copy_only=False)
            np.add.at(depth, start, 1)
            np.add.at(depth, start + flat.field("words").to_numpy(zero_copy_only=False), -1)
            kept = np.cumsum(depth[:-1]) == 0
            n_kept = np.bincount(row[kept], minlength=len(own)).astype(np.int64)
            offsets = np.concatenate(([0], np.cumsum(n_kept)))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), words.filter(pa.array(kept)).cast(pa.string())), " ")
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(n_words), pa.array(n_words - n_kept), texts], names=["doc_id", "n_words", "n_removed", "kept_text"])


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, hot_phrases: int = HOT_PHRASES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, and kept_text, the words that stay with one space between them."""
    spans, hot_rows = repeated_spans(docs, window, seed, hot_phrases, block_words)
    rows = _rows(docs)
    # A text too short for a window has no spans: such rows are dealt anyhow.
    short = F.octet_length("text") < 2 * window - 1
    held = join_hot(rows, spans, _ROW, hot_rows, F.monotonically_increasing_id(), how="left", apart=short)
    return held.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans").mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept_text string")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP12_SQL = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS n, doc_id, coalesce(doc_id, {LAST_ID}) AS id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS words FROM documents),
word AS (SELECT n, id, words, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM docs),
windows AS (SELECT n, id, place, md5(array_to_string(words[place:place + {WINDOW - 1}], ' ')) AS w FROM word WHERE place + {WINDOW - 1} <= len(words)),
firsts AS (SELECT w, min(id) AS first_id FROM windows GROUP BY w),
hit AS (SELECT n, place FROM windows JOIN firsts USING (w) WHERE id > first_id),
judged AS (
  SELECT n, place, word, max(h.place) OVER (PARTITION BY n ORDER BY place ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM word LEFT JOIN hit h USING (n, place)),
kept AS (SELECT n, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (NOT gone) AS kept FROM judged GROUP BY n)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (n)"""
