"""Best-two-fit packing of tokenized documents into sequences of fixed length.

A document is its ids and one end id.  A longer document than a sequence is cut into full
pieces, of which the first may be shorter.  Each task fills bins greedily (the largest piece
that fits, again and again); then, if a gap is left, it replaces the bin's smallest piece by
the two unpacked pieces that fit the expanded gap most tightly.  The tasks pack while they
read, so no text is shuffled.  What lies in bins with more than ``SLACK`` free places after
that is packed once more, over larger shards of pieces (a few numbers each, no texts), so that
the number of sequences doesn't grow with the number of tasks.

Defined cases: null and empty texts are one end id; null ids and repeated rows are pieces like
any other; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lexmill.llm.common import chunks_by_total, materialize, table, text_or_empty
from lexmill.llm.tokens import batches, chunk_tokenizer, crc32_of, tokenizer_path

CAPACITY, END_ID, TOKENIZER = 2048, 0, "byte_bpe_50k.json"
SLACK = 20
SHARD_PIECES, REPACK_PIECES = 65_536, 262_144


def _pair_for(room: int, sizes: np.ndarray, counts: np.ndarray, at_most: np.ndarray) -> tuple[int, int]:
    """The two available sizes with the largest sum of at most ``room`` (0, 0 if there are none)."""
    first = sizes[: np.searchsorted(sizes, room)]  # leaves at least 1 for the second
    if not len(first):
        return 0, 0
    second = at_most[room - first]
    alone = (second == first) & (counts[first] < 2)
    second = np.where(alone, at_most[first - 1], second)
    total = np.where(second > 0, first + second, 0)
    best = int(np.argmax(total))
    return (int(first[best]), int(second[best])) if total[best] else (0, 0)


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of every piece; lengths are 1 to ``capacity``."""
    lengths = np.asarray(lengths, dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)
    next_of = np.cumsum(counts) - counts  # the next piece of each size, in ``order``
    bin_of, offset_of = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    indices, left, number = np.arange(capacity + 1), len(lengths), 0

    def available() -> tuple[np.ndarray, np.ndarray]:
        return np.flatnonzero(counts), np.maximum.accumulate(np.where(counts > 0, indices, 0))

    sizes, at_most = available()
    while left:
        chosen, gap = [], capacity
        while (size := int(at_most[gap])) and left:
            chosen.append(size)
            gap -= size
            counts[size] -= 1
            left -= 1
            if not counts[size]:
                sizes, at_most = available()
        if gap and left:
            smallest = chosen[-1]  # sizes were taken in falling order
            a, b = _pair_for(gap + smallest, sizes, counts, at_most)
            if a + b > smallest:
                chosen[-1:] = [a, b]
                counts[smallest] += 1
                counts[a] -= 1
                counts[b] -= 1
                left -= 1
                sizes, at_most = available()
        offset = 0
        for size in chosen:
            piece = order[next_of[size]]
            next_of[size] += 1
            bin_of[piece], offset_of[piece] = number, offset
            offset += size
        number += 1
    return bin_of, offset_of


def cut_pieces(n_ids: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents of so many ids."""
    rest = n_ids % capacity
    pieces = n_ids // capacity + (rest > 0)
    document = np.repeat(np.arange(len(n_ids)), pieces)
    piece = np.arange(len(document)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    head = np.where(rest > 0, rest, capacity)[document]
    start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
    return document, piece, start, np.where(piece == 0, head, capacity)


def _packed(columns: dict[str, pa.Array], base: int, capacity: int, slack: int) -> pa.RecordBatch:
    """The columns with sequence_id and offset; both null in a bin with more free places than ``slack``."""
    length = columns["length"].to_numpy(zero_copy_only=False)
    bins, offset = best_two_fit(length, capacity)
    open_bin = (capacity - np.bincount(bins, weights=length) > slack)[bins] if len(length) else np.zeros(0, bool)
    return pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(base + bins, mask=open_bin), "offset": pa.array(offset, mask=open_bin)})


def _tokenize_and_pack(path: str, capacity: int, end_id: int):
    def run(record_batches):
        tokenizer, base = chunk_tokenizer(path, "spaced"), TaskContext.get().partitionId() << 36
        held, n_held, used = [], 0, 0

        def flush():
            nonlocal held, n_held, used
            joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            out = _packed({n: joined.column(n) for n in joined.schema.names}, base + used, capacity, SLACK)
            used += n_held
            held, n_held = [], 0
            return out

        for batch in record_batches:
            texts = batch.column("text").to_pylist()
            for first, last in batches(texts):
                ids, n_ids = tokenizer.encode(texts[first:last], end_id)
                document, piece, start, length = cut_pieces(n_ids, capacity)
                at = (np.cumsum(n_ids) - n_ids)[document] + start
                crc = np.array([crc32_of(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist())], dtype=np.int64)
                doc_id = batch.column("doc_id").slice(first, last - first).take(pa.array(document))
                held.append(pa.RecordBatch.from_pydict({"doc_id": doc_id, "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc)}))
                n_held += len(document)
                if n_held >= SHARD_PIECES:
                    yield flush()
        if n_held:
            yield flush()

    return run


def _repack(capacity: int):
    def run(record_batches):
        base = (1 << 62) + (TaskContext.get().partitionId() << 36)
        batches_held = list(record_batches)  # at most about REPACK_PIECES short rows
        if batches_held:
            joined = pa.Table.from_batches(batches_held).combine_chunks().to_batches()
            for batch in joined:
                if batch.num_rows:
                    yield _packed({n: batch.column(n) for n in batch.schema.names}, base, capacity, capacity)

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    id_field = StructField("doc_id", docs.schema["doc_id"].dataType)
    pieces = StructType([id_field, StructField("piece", IntegerType()), *(StructField(n, LongType()) for n in ("start", "length", "ids_crc32"))])
    placed = StructType([*pieces.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    source = docs.select("doc_id", text_or_empty().alias("text"))
    first = materialize(source.mapInArrow(_tokenize_and_pack(path or tokenizer_path(TOKENIZER), capacity, end_id), placed), "packed")
    loose = first.filter(F.col("sequence_id").isNull()).select(pieces.names)
    shards = chunks_by_total(loose.count(), REPACK_PIECES)
    return first.filter(F.col("sequence_id").isNotNull()).union(loose.repartition(shards).mapInArrow(_repack(capacity), placed))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
