"""Token-id shards compressed by Re-Pair grammars.

Documents are tokenized in ascending doc_id order and written as shard files.  In a shard,
adjacent id pairs that repeat are replaced by nonterminals, the most frequent first, until no
pair occurs twice (``min_count``) without overlapping itself.  The file holds the rules, the
length of every rule's expansion, and where each document's symbols begin, so any document can
be decoded alone.

File: the magic bytes, a header of five unsigned 64-bit numbers (documents, rules, symbols,
first nonterminal, bytes of one symbol: 3 or 4), then arrays: doc ids (int64), null flags of ids
(uint8), ids per document (uint64), first symbol per document (uint64), rules (2 symbols each),
expansion lengths (uint32), symbols; all little-endian, symbols of 3 bytes as all lower two
bytes and then all third bytes.

A manifest table lists the shard files in order with their numbers of ids; the first id of a
shard is the sum over the shards before it.  The files of an attempt that did not commit are
in no manifest.

Defined cases: null and empty texts are one end id; a null id sorts first; rows of the same id
are ordered by a hash of their text, so a repeated id cannot fill one shard; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.arrays import sorted_pairs
from lexmill.llm.common import materialize, new_path, table, tasks_for, text_or_empty, with_scheme
from lexmill.llm.files import read_range, write_file
from lexmill.llm.tokens import chunk_tokenizer, crc32_of, tokenizer_path
from lexmill.llm.words import give_back, slices_of

TOKENIZER, END_ID = "word_bpe_49k.json", 1
MIN_COUNT = 2
SHARD_IDS, RANGE_BYTES = 1_000_000, 24_000_000
MAGIC = b"LMRP0002"


def compress(ids: np.ndarray, n_ids: np.ndarray, first_rule: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols per document, rules) of documents of so many ids in a row.

    A round ranks all pairs that occur ``min_count`` times by their counts and replaces every
    occurrence that outranks the two it overlaps, so the most frequent pairs go first, and as many
    others as don't touch them.  Rounds end when no pair is left that can be replaced ``min_count`` times.  A pair
    of old symbols never becomes more frequent, so after the first round only pairs that repeat
    and pairs with a new symbol are looked at."""
    n = len(ids)
    symbols = np.append(ids, 0).astype(np.uint32)
    # Neighbours of each place; ``n`` stands for none, as no pair goes over a document's end.
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    ends = np.cumsum(n_ids)[n_ids > 0]
    after[ends - 1] = n
    before[np.concatenate(([0], ends[:-1]))[: len(ends)]] = n
    open_pair, alive = after != n, np.ones(n + 1, bool)
    open_pair[n] = False
    rank_at = np.zeros(n + 1, np.int32)
    rules, n_rules, top = [], 0, int(max(first_rule, ids.max(initial=0)))
    while len(active := np.flatnonzero(open_pair)):
        keys, at = sorted_pairs(symbols[active], symbols[after[active]], active, top, top)
        open_pair[active] = False
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        counts = np.diff(starts, append=len(keys))
        pairs = np.flatnonzero(counts >= min_count)
        if not len(pairs):
            break
        own = counts[pairs]
        pairs = pairs[np.argsort(own.astype(np.uint16) if own.max() < 1 << 16 else own, kind="stable")]  # a pair's rank is its place here, from 1
        rank = np.zeros(len(starts), np.int32)
        rank[pairs] = np.arange(1, len(pairs) + 1)
        rank_of = np.repeat(rank, counts)
        rank_at[at] = rank_of
        left = at[starts[pairs]]
        pairs, counts = np.stack([symbols[left], symbols[after[left]]], axis=1), counts[pairs]
        active = np.flatnonzero(rank_at) if 8 * len(at) > n else np.sort(at[rank_of > 0])
        del keys, at, starts, rank, rank_of
        own = rank_at[active]
        open_pair[active] = True
        first = (own >= rank_at[before[active]]) & (own >= rank_at[after[active]])
        rank_at[active] = 0
        # Occurrences of equal rank overlap only in runs of one id: every other one is taken.
        first = np.flatnonzero(first)
        at, pair = active[first], own[first] - 1
        taken = np.ones(len(at), bool)
        overlaps = np.flatnonzero(after[at[:-1]] == at[1:]) + 1
        opens = np.diff(overlaps, prepend=-1) != 1
        taken[overlaps] = (overlaps - overlaps[opens][np.cumsum(opens) - 1]) % 2 == 1
        used = np.bincount(pair[taken], minlength=len(pairs))
        # Nothing outranks these, and still they are too few without overlaps: they are done with.
        spent = (used < min_count) & (np.bincount(pair, minlength=len(pairs)) == counts)
        open_pair[active[spent[own - 1]]] = False
        ruled = used >= min_count
        symbol_of = first_rule + n_rules + np.cumsum(ruled) - 1
        chosen = taken & ruled[pair]
        at, pair = at[chosen], pair[chosen]
        gone = after[at]
        beyond = after[gone]
        symbols[at] = symbol_of[pair]
        after[at], before[beyond], alive[gone], open_pair[gone] = beyond, at, False, False
        changed = np.concatenate([before[at], at])
        open_pair[changed] = after[changed] != n
        open_pair[n] = False
        rules.append(pairs[ruled])
        n_rules += int(ruled.sum())
        top = max(top, first_rule + n_rules)
    alive[n] = False
    document = np.repeat(np.arange(len(n_ids)), n_ids)
    per_document = np.bincount(document[alive[:n]], minlength=len(n_ids)).astype(np.int64)
    return symbols[:n][alive[:n]], per_document, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """How many ids each rule stands for; a rule uses earlier ones only."""
    lengths = np.zeros(len(rules), np.int64)
    todo = np.arange(len(rules))
    parts = rules.astype(np.int64) - first_rule
    while len(todo):
        known = np.where(parts[todo] < 0, 1, lengths[np.maximum(parts[todo], 0)])
        ready = (known > 0).all(axis=1)
        lengths[todo[ready]] = known[ready].sum(axis=1)
        todo = todo[~ready]
    return lengths


def _wide(values: np.ndarray, width: int) -> bytes:
    """Numbers as their lower two bytes, all in a row, and then their third (or all four bytes each)."""
    values = np.ascontiguousarray(values, dtype=np.uint32).ravel()
    return values.astype("<u4").tobytes() if width == 4 else (values & 0xFFFF).astype("<u2").tobytes() + (values >> 16).astype("u1").tobytes()


class Shard:
    """A shard file's contents; decodes any run of documents."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        n_docs, n_rules, n_symbols, self.first_rule, width = np.frombuffer(data, "<u8", 5, 8).tolist()
        at = 48

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        def take_wide(n: int) -> np.ndarray:
            if width == 4:
                return take("<u4", n).astype(np.int64)
            low = take("<u2", n)
            return low.astype(np.int64) | take("u1", n).astype(np.int64) << 16

        self.doc_ids, self.null_ids = take("<i8", n_docs), take("u1", n_docs).astype(bool)
        self.n_ids, self.first_symbol = take("<u8", n_docs).astype(np.int64), take("<u8", n_docs).astype(np.int64)
        self.rules, self.lengths = take_wide(2 * n_rules).reshape(-1, 2), take("<u4", n_rules).astype(np.int64)
        self.symbols = take_wide(n_symbols)
        self._expanded: np.ndarray | None = None

    def decode(self, first: int, last: int) -> np.ndarray:
        """The ids of the documents from ``first`` to before ``last``."""
        if first >= last:
            return np.zeros(0, np.uint32)
        end = self.first_symbol[last] if last < len(self.first_symbol) else len(self.symbols)
        symbols = self.symbols[self.first_symbol[first] : end]
        if len(symbols) < len(self.rules) or int(self.lengths.sum()) > len(symbols) + int(self.n_ids.sum()):
            return self._expand(symbols)
        # Many symbols: every rule is expanded once (the first entries are the plain ids' own), and the expansions are copied.
        if self._expanded is None:
            self._expanded = np.concatenate([np.arange(self.first_rule, dtype=np.uint32), self._expand(np.arange(len(self.rules)) + self.first_rule)])
        length = self._length(symbols)
        starts = np.append(np.arange(self.first_rule), self.first_rule + np.cumsum(self.lengths) - self.lengths)[symbols]
        return self._expanded[np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """Each nonterminal's two parts are put where its expansion length says, until only ids are left."""
        length = self._length(symbols)
        out, place = np.zeros(int(length.sum()), np.uint32), np.cumsum(length) - length
        while len(symbols):
            plain = symbols < self.first_rule
            out[place[plain]] = symbols[plain]
            place, parts = place[~plain], self.rules[symbols[~plain] - self.first_rule]
            place = np.concatenate([place, place + self._length(parts[:, 0])])
            symbols = np.concatenate([parts[:, 0], parts[:, 1]])
        return out

    def _length(self, symbols: np.ndarray) -> np.ndarray:
        is_rule = symbols >= self.first_rule
        out = np.ones(len(symbols), np.int64)
        out[is_rule] = self.lengths[symbols[is_rule] - self.first_rule]
        return out


def shard_bytes(doc_ids: np.ndarray, null_ids: np.ndarray, ids: np.ndarray, n_ids: np.ndarray, first_rule: int) -> bytes:
    """A shard file of documents; nonterminals are numbered from ``first_rule``, above all ids."""
    if len(ids) and int(ids.max()) >= first_rule:
        raise ValueError(f"id {int(ids.max())} is no id of a vocabulary of {first_rule}")
    symbols, per_document, rules = compress(ids, n_ids, first_rule)
    first_symbol = np.cumsum(per_document) - per_document
    width = 3 if max(first_rule + len(rules), int(ids.max(initial=0)) + 1) <= 1 << 24 else 4
    header = np.array([len(doc_ids), len(rules), len(symbols), first_rule, width], dtype="<u8")
    parts = [header, doc_ids.astype("<i8"), null_ids.astype("u1"), n_ids.astype("<u8"), first_symbol.astype("<u8")]
    return MAGIC + b"".join(p.tobytes() for p in parts) + _wide(rules, width) + expansion_lengths(rules, first_rule).astype("<u4").tobytes() + _wide(symbols, width)


def _write_shards(folder: str, path: str, end_id: int, cut: str):
    def run(record_batches):
        tokenizer, part = chunk_tokenizer(path, cut), TaskContext.get().partitionId()
        first_rule = max(tokenizer.size, end_id + 1)
        held, n_held, number = [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, n_held, number
            doc_ids, null_ids, ids, n_ids = (np.concatenate(x) for x in zip(*held))
            uri = write_file(folder, f"{part:06d}-{number:06d}", data := shard_bytes(doc_ids, null_ids, ids, n_ids, first_rule))
            row = pa.RecordBatch.from_pylist([{"part": part, "number": number, "uri": uri, "n_docs": len(doc_ids), "n_ids": int(n_ids.sum()), "n_bytes": len(data)}])
            held, n_held, number = [], 0, number + 1
            give_back()
            return row

        for batch in record_batches:
            texts, doc_id = batch.column("text"), batch.column("doc_id")
            null_ids, doc_ids = doc_id.is_null().to_numpy(zero_copy_only=False), doc_id.fill_null(0).to_numpy(zero_copy_only=False)
            for first, last in slices_of(texts):
                ids, n_ids = tokenizer.encode(texts.slice(first, last - first), end_id)
                held.append((doc_ids[first:last], null_ids[first:last], ids, n_ids))
                n_held += len(ids)
                if n_held >= SHARD_IDS:
                    yield flush()
        if held:
            yield flush()

    return run


def _read_shards(record_batches):
    for batch in record_batches:
        for row in batch.to_pylist():
            shard = Shard(read_range(row["uri"]))
            start = row["first_id"] + np.cumsum(shard.n_ids) - shard.n_ids
            crc, first = [], 0
            while first < len(shard.n_ids):  # some million ids at a time
                last = first + max(1, int(np.searchsorted(np.cumsum(shard.n_ids[first:]), 1 << 20, "right")))
                ids, cuts = shard.decode(first, last), np.cumsum(shard.n_ids[first:last]).tolist()
                crc.extend(crc32_of(ids[a:b]) for a, b in zip([0, *cuts[:-1]], cuts))
                first = last
            doc_id = pa.array(shard.doc_ids, mask=shard.null_ids)
            give_back()
            yield pa.RecordBatch.from_pydict({"doc_id": doc_id, "start": pa.array(start), "n_tokens": pa.array(shard.n_ids), "ids_crc32": pa.array(crc, pa.int64())})


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = END_ID, cut: str = "words") -> DataFrame:
    """Write the documents (integer doc_id, text) as shard files in ascending doc_id order, with the ids of any
    tokenizer that ``tokens`` can cut texts for.

    Returns the manifest: part, number, uri, n_docs, n_ids, n_bytes, first_id."""
    spark = docs.sparkSession
    folder = with_scheme(spark, new_path(spark, "token-shards"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranged = source.withColumn("tie", F.xxhash64("text")).repartitionByRange(tasks_for(total, RANGE_BYTES), "doc_id", "tie")
    ordered = ranged.sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    manifest = ordered.mapInArrow(_write_shards(folder, path or tokenizer_path(TOKENIZER), end_id, cut), "part long, number long, uri string, n_docs long, n_ids long, n_bytes long")
    manifest = materialize(manifest, "manifest")
    # Starts are summed over the tasks that wrote (a row for each), and inside each task over its files.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before_part"))
    before = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    within = manifest.withColumn("within", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    starts = within.join(F.broadcast(tasks), "part").withColumn("first_id", F.col("before_part") + F.col("within"))
    return materialize(starts.select(*manifest.columns, "first_id"), "manifest-starts")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    files = manifest.select("uri", "first_id")
    n = files.count()  # a task each, beyond some thousands up to 64 files to a task
    return files.repartition(max(1, min(n, 4096), n // 64), "uri").mapInArrow(_read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents")))
