"""Alignment of two tokenizers over one corpus: which ids of A stand for which ids of B.

A (byte-level BPE) encodes a space and the text, B (pieces, which adds the space) the text; both
without special tokens, whose strings are plain text.  Tokens cover byte ranges; a token of A and
one of B whose ranges overlap are linked, and places where both end cut the tokens into groups.

Chunks.  A text is cut before each single space between two characters that are not white space:
there A starts a pre-token, and no piece of B holds a space behind another character.  Groups end
there too, so links and groups are found once for each distinct chunk, in a cache of bounded size.

Postings.  Some megabytes of documents form a block.  Each distinct linked pair of a document is a
posting (pair, document, multiplicity); a block's postings are sorted and parted by their A id into
``SLICES`` messages, written once.  The documents of each pair are counted by an aggregation, the
highest count of an A id by another (one row for each id of A's vocabulary).  Then postings and
counts are cogrouped by slice: streams sorted by the key, which spill.  Blocks of a slice are dealt
over as many groups as keep one at ``GROUP_POSTINGS``, so a frequent id is never one task; the slice's
counts go to each of its groups.  A group adds up the contributions of its postings by document, and
sends them back, one message for each block and slice, where they are summed by document.

Messages grow in proportion to the blocks, and a task holds one block, or one group and one slice
of the counts.

Defined cases: null and empty texts, and texts that either tokenizer doesn't give back byte for
byte, have no tokens: zeros and an empty digest; repeated rows count as documents each; a null
doc_id stays null; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.arrays import pack_arrays, unpack_arrays
from lexmill.llm.common import materialize, table, text_or_empty
from lexmill.llm.tokens import SPACE_BETWEEN, UNEVEN, tokenizer_path
from lexmill.llm.words import slices_of

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICES, GROUP_POSTINGS, SLICE_BYTES = 64, 3_000_000, 4_000_000
CACHE_CHUNKS, CACHE_CHARS = 300_000, 30_000_000
INFO, SPREAD = -1, 2_654_435_761
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand
    for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level_bytes(entry: str) -> bytes:
    alphabet = _byte_alphabet()
    return bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()


def piece_bytes(piece: str) -> bytes:
    byte = _BYTE_PIECE.fullmatch(piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for own in lists for x in own), np.int64, int(lengths.sum())), lengths


class ChunkAligner:
    """Encodes chunks with both tokenizers and aligns them, each distinct chunk once."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self._a, self._b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self._a.encode_special_tokens = True
        self._bytes_a = [byte_level_bytes(self._a.id_to_token(i) or "") for i in range(self._a.get_vocab_size())]
        self._bytes_b = [piece_bytes(self._b.id_to_piece(i)) for i in range(self._b.get_piece_size())]
        self._width_a, self._width_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self._bytes_a, self._bytes_b))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((4, 0), np.int64)  # of A, of B, groups, links
        self.valid, self.pairs = np.zeros(0, bool), np.zeros(0, np.uint64)
        self.first, self.n_pairs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._chars = 0

    def full(self) -> bool:
        return len(self.number) > CACHE_CHUNKS or self._chars > CACHE_CHARS

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of A and of B of each chunk, with the space before it."""
        return [e.ids for e in self._a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)], self._b.encode(chunks, num_threads=1)

    def learn(self, chunks: list[str]) -> None:
        """Align distinct chunks that are not known yet."""
        all_a, all_b = self.encode(chunks)
        ids_a, n_a = _flat(all_a)
        ids_b, n_b = _flat(all_b)
        whole = lambda ids, told: b"".join([told[i] for i in ids])
        texts = [b" " + c.encode() for c in chunks]
        valid = np.array([whole(a, self._bytes_a) == t == whole(b, self._bytes_b) for a, b, t in zip(all_a, all_b, texts)], dtype=bool)
        # Chunks stand one behind the other on one line of bytes, those that aren't valid with nothing on it.
        own_a, own_b = np.repeat(valid, n_a), np.repeat(valid, n_b)
        ids_a, ids_b = ids_a[own_a], ids_b[own_b]
        n_a, n_b = np.where(valid, n_a, 0), np.where(valid, n_b, 0)
        end_a, end_b = np.cumsum(self._width_a[ids_a]), np.cumsum(self._width_b[ids_b])
        ends = np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        both_a, both_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        chunk_a, chunk_b = np.repeat(np.arange(len(chunks)), n_a), np.repeat(np.arange(len(chunks)), n_b)
        n_links = np.bincount(chunk_a[at_a], minlength=len(chunks)) if len(at_a) else np.zeros(len(chunks), np.int64)
        n_groups = np.bincount(chunk_a[both_a], minlength=len(chunks))
        self.first = np.concatenate([self.first, len(self.pairs) + np.cumsum(n_links) - n_links])
        self.n_pairs = np.concatenate([self.n_pairs, n_links])
        self.pairs = np.concatenate([self.pairs, ids_a[at_a].astype(np.uint64) << np.uint64(32) | ids_b[at_b].astype(np.uint64)])
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, n_links]).astype(np.int64)], axis=1)
        self.valid = np.concatenate([self.valid, valid])
        self.groups += self._group_texts(ids_a.tolist(), both_a.tolist(), n_a.tolist(), ids_b.tolist(), both_b.tolist(), n_b.tolist())
        self.number.update(zip(chunks, range(len(self.number), len(self.number) + len(chunks))))
        self._chars += sum(map(len, chunks))

    @staticmethod
    def _group_texts(ids_a, both_a, n_a, ids_b, both_b, n_b) -> list[str]:
        """``a1,a2|b1;a3|b2`` of each chunk."""
        out, i, j = [], 0, 0
        for own_a, own_b in zip(n_a, n_b):
            if own_a == own_b == 1:
                out.append(f"{ids_a[i]}|{ids_b[j]}")
                i, j = i + 1, j + 1
                continue
            sides = []
            for ids, closes, at, n in ((ids_a, both_a, i, own_a), (ids_b, both_b, j, own_b)):
                sides.append("".join([f"{x};" if close else f"{x}," for x, close in zip(ids[at : at + n], closes[at : at + n])])[:-1].split(";"))
            out.append(";".join([f"{a}|{b}" for a, b in zip(*sides)]))
            i, j = i + own_a, j + own_b
        return out

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the number of each chunk in turn, chunks per text); null and empty texts have none."""
        column = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(column)
        empty = pc.equal(column, "").to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(column, UNEVEN).to_numpy(zero_copy_only=False) & ~empty
        lists = pc.split_pattern(column.filter(pa.array(~odd & ~empty)), " ")
        encoded = lists.flatten().dictionary_encode()
        apart = {i: SPACE_BETWEEN.split(column[i].as_py()) for i in np.flatnonzero(odd).tolist()}
        chunks = encoded.dictionary.to_pylist()
        n_even = len(chunks)
        chunks += [c for own in apart.values() for c in own]
        unknown = [c for c in dict.fromkeys(chunks) if c not in self.number]
        for first in range(0, len(unknown), 20_000):
            self.learn(unknown[first : first + 20_000])
        numbers = np.fromiter((self.number[c] for c in chunks), np.int64, len(chunks))
        counts = np.zeros(n, np.int64)
        counts[~odd & ~empty] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        counts[odd] = [len(own) for own in apart.values()]
        of_odd = np.repeat(odd, counts)
        out = np.empty(len(of_odd), np.int64)
        out[~of_odd], out[of_odd] = numbers[encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)], numbers[n_even:]
        return out, counts


@lru_cache(maxsize=2)
def chunk_aligner(path_a: str, path_b: str) -> ChunkAligner:
    return ChunkAligner(path_a, path_b)


@dataclass
class AlignedTexts:
    """``counts`` (of A, of B, groups, links; by text), the group texts, and the distinct pairs of each text with
    their multiplicities, sorted by pair and text."""

    counts: np.ndarray
    groups: list[str]
    pair: np.ndarray
    text: np.ndarray
    times: np.ndarray


def align_texts(texts: pa.Array, aligner: ChunkAligner) -> AlignedTexts:
    if aligner.full():
        aligner.clear()
    chunks, n_chunks = aligner.cut(texts)
    text = np.repeat(np.arange(len(texts)), n_chunks)
    spoiled = np.zeros(len(texts), bool)
    spoiled[text[~aligner.valid[chunks]]] = True
    stays = ~spoiled[text]
    chunks, text = chunks[stays], text[stays]
    n_chunks = np.where(spoiled, 0, n_chunks)
    counts = np.zeros((4, len(texts)), np.int64)
    for kind in range(4):
        np.add.at(counts[kind], text, aligner.counts[kind][chunks])
    cuts, listed, told = np.concatenate(([0], np.cumsum(n_chunks))).tolist(), chunks.tolist(), aligner.groups
    groups = [";".join([told[c] for c in listed[a:b]]) for a, b in zip(cuts, cuts[1:])]
    key, times = np.unique(chunks * len(texts) + text, return_counts=True)  # each chunk of a text once
    chunk, text = np.divmod(key, len(texts)) if len(texts) else (key, key)
    n = aligner.n_pairs[chunk]
    pair = aligner.pairs[np.repeat(aligner.first[chunk], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    text, times = np.repeat(text, n), np.repeat(times, n)
    order = np.lexsort((text, pair))
    pair, text, times = pair[order], text[order], times[order]
    opens = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])))) if len(pair) else np.zeros(0, np.int64)
    return AlignedTexts(counts, groups, pair[opens], text[opens], np.add.reduceat(times, opens) if len(opens) else times)


def slice_of(a: np.ndarray, slices: int) -> np.ndarray:
    return ((a.astype(np.int64) * SPREAD) >> 16) % slices


def _packed_rows(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _blocks(path_a: str, path_b: str, slices: int):
    """Rows (block, slice, n_postings, data): what a block's documents are (slice ``INFO``), and its postings."""

    def run(batches):
        aligner, block = chunk_aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, last in slices_of(batch.column("text"), SLICE_BYTES):
                own = batch.slice(first, last - first)
                found = align_texts(own.column("text"), aligner)
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.groups]
                told = pa.RecordBatch.from_arrays([own.column("doc_id"), *map(pa.array, found.counts), pa.array(digests)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
                rows = [(block, INFO, 0, _packed_rows(told))]
                part = slice_of(found.pair >> np.uint64(32), slices)
                order = np.argsort(part, kind="stable")
                for mine in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
                    pair, n = np.unique(found.pair[mine], return_counts=True)
                    data = pack_arrays(a=pair >> np.uint64(32), b=pair & np.uint64(0xFFFFFFFF), n=n.astype(np.uint64), text=found.text[mine].astype(np.uint64), times=found.times[mine].astype(np.uint64))
                    rows.append((block, int(part[mine[0]]), len(mine), data))
                blocks, parts, sizes, data = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(parts, pa.int32()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], names=["block", "slice", "n_postings", "data"])
                block += 1

    return run


def _documents_of_pairs(at_once: int = 1_000_000):
    """Rows (a, b, n): the documents of each pair, summed over the messages of a task as far as memory is bounded."""

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        pair, place = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, place, np.concatenate([m for _, m in held]))
        return pa.RecordBatch.from_arrays([pa.array((pair >> np.uint64(32)).astype(np.int32)), pa.array((pair & np.uint64(0xFFFFFFFF)).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

    def run(batches):
        held, n_held = [], 0
        for batch in batches:
            for data in batch.column("data"):
                own = unpack_arrays(data.as_py())
                held.append((own["a"] << np.uint64(32) | own["b"], own["n"].astype(np.int64)))
                n_held += len(own["n"])
                if n_held > at_once:
                    yield summed(held)
                    held, n_held = [], 0
        if held:
            yield summed(held)

    return run


def _contributions(postings: pa.Table, counts: pa.Table) -> pa.Table:
    """What a group's postings add to their documents: for each message one of (text, n_best, count_sum)."""
    pair = counts.column("a").to_numpy().astype(np.uint64) << np.uint64(32) | counts.column("b").to_numpy().astype(np.uint64)
    order = np.argsort(pair)
    pair, n, best = pair[order], counts.column("n").to_numpy()[order], counts.column("best").to_numpy()[order]
    blocks, out = [], []
    for block, data in zip(postings.column("block").to_pylist(), postings.column("data")):
        own = unpack_arrays(data.as_py())
        at = np.repeat(np.searchsorted(pair, own["a"] << np.uint64(32) | own["b"]), own["n"].astype(np.int64))
        text, place = np.unique(own["text"], return_inverse=True)
        times = own["times"].astype(np.int64)
        n_best, count_sum = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        np.add.at(n_best, place, times * (n[at] == best[at]))
        np.add.at(count_sum, place, times * n[at])
        blocks.append(block)
        out.append(pack_arrays(text=text, n_best=n_best.astype(np.uint64), count_sum=count_sum.astype(np.uint64)))
    return pa.table({"block": pa.array(blocks, pa.int64()), "slice": pa.array([0] * len(blocks), pa.int32()), "data": pa.array(out, pa.binary())})


def _summed_block(rows: pa.Table) -> pa.Table:
    """The documents of one block with their contributions summed."""
    info, sums = None, []
    for part, data in zip(rows.column("slice").to_pylist(), rows.column("data")):
        if part == INFO:
            info = pa.ipc.open_stream(data.as_buffer()).read_all()
        else:
            sums.append(unpack_arrays(data.as_py()))
    n_best, count_sum = np.zeros(len(info), np.int64), np.zeros(len(info), np.int64)
    for own in sums:
        text = own["text"].astype(np.int64)
        n_best[text] += own["n_best"].astype(np.int64)
        count_sum[text] += own["count_sum"].astype(np.int64)
    told = {name: info.column(name) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(told | {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum), "groups_sha256": info.column("groups_sha256")})


class Alignment:
    """Two tokenizers aligned over ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame, path_a: str | None = None, path_b: str | None = None, slices: int = SLICES, group_postings: int = GROUP_POSTINGS) -> None:
        self._paths = path_a or tokenizer_path(TOKENIZER_A), path_b or tokenizer_path(TOKENIZER_B)
        self._source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        self._slices, self._group_postings = slices, group_postings
        self._messages = materialize(self._source.mapInArrow(_blocks(*self._paths, slices), "block long, slice int, n_postings long, data binary"), "postings")
        pairs = self._messages.filter(F.col("slice") != INFO).select("data").mapInArrow(_documents_of_pairs(), "a int, b int, n long")
        counted = materialize(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")), "pair-counts")
        #: One row for each id of A that occurs: no more than its vocabulary.
        best = F.broadcast(counted.groupBy("a").agg(F.max("n").alias("best")))
        #: (a, b, n, best): the documents that hold each linked pair, and the most that any pair of ``a`` has.
        self.counts = counted.join(best, "a").select("a", "b", "n", "best")

    def groups(self) -> DataFrame:
        """Per document: doc_id, groups (``a1,a2|b1;a3|b2``)."""
        paths = self._paths

        def run(batches):
            aligner = chunk_aligner(*paths)
            for batch in batches:
                for first, last in slices_of(batch.column("text"), SLICE_BYTES):
                    own = batch.slice(first, last - first)
                    yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(align_texts(own.column("text"), aligner).groups, pa.string())], names=["doc_id", "groups"])

        return self._source.mapInArrow(run, "doc_id long, groups string")

    def documents(self) -> DataFrame:
        """Per document: its tokens, groups and links, how many links are the best of their A id, the
        sum of the links' counts, and the digest of its groups."""
        sizes = {r["slice"]: r["n"] for r in self._messages.filter(F.col("slice") != INFO).groupBy("slice").agg(F.sum("n_postings").alias("n")).collect()}
        n_groups = F.element_at(F.array(*(F.lit(max(1, -(-sizes.get(s, 0) // self._group_postings))) for s in range(self._slices))), F.col("slice") + 1)
        slice_of_pair = F.pmod(F.shiftright(F.col("a").cast("long") * F.lit(SPREAD), 16), F.lit(self._slices)).cast("int")
        postings = self._messages.filter(F.col("slice") != INFO).select("slice", F.pmod(F.xxhash64("block"), n_groups).alias("group"), "block", "data")
        counts = self.counts.withColumn("slice", slice_of_pair).select("slice", F.explode(F.sequence(F.lit(0).cast("long"), n_groups.cast("long") - 1)).alias("group"), "a", "b", "n", "best")
        added = postings.groupBy("slice", "group").cogroup(counts.groupBy("slice", "group")).applyInArrow(_contributions, "block long, slice int, data binary")
        info = self._messages.filter(F.col("slice") == INFO).select("block", "slice", "data")
        return added.unionByName(info).groupBy("block").applyInArrow(_summed_block, RESULT)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Alignment(table(spark, sf_dir, "documents")).documents()
