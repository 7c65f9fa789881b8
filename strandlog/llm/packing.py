"""Best-fit packing of tokenized documents into sequences of bounded length by hierarchical residual packing.

Pieces of full length are sequences of their own. The others are dealt evenly over partitions, whatever their order in the
table, and packed best-fit decreasing there. Nearly full bins are emitted; underfull ones go up a tree as items of their
summed length: each round deals those that are left over as many fewer partitions and packs them best-fit again. The tree ends
when one partition has held all, or when a round merges hardly any: bins that all are over half full need no further
moves. No task holds more than two chunks of items at a time.

What the tree leaves underfull is opened once more: pieces of one length are interchangeable, so their numbers per length, at
most ``LENGTH`` sums, are packed best-fit decreasing in one plan, and the pieces, numbered within their length, look their
places up in it. That fills the rooms in which a piece would have fitted and a bin would not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm.common import save
from strandlog.llm.tokens import encoder, vocabulary_path

LENGTH = 1024
END_ID = 2
CHUNK = 20_000
SLACK = 8
VOCABULARY = "byte_bpe_50k.tiktoken"

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_BINS = f"closed boolean, total long, members array<struct<{_PIECES.replace(' long', ': long').replace(' int', ': int')}>>"


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, if n is over ``length``."""
    if n <= length:
        return [(0, n)]
    first = n % length
    return ([(0, first)] if first else []) + [(at, length) for at in range(first, n, length)]


def pieces_of(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, special: bool = True) -> DataFrame:
    """The pieces of every row of docs: doc_id, piece, start, length, ids_crc32. A null text is empty: its end id alone."""
    path = path or vocabulary_path(VOCABULARY)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, special).encode
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py())
                ids.append(end_id)
                packed = memoryview(ids.tobytes())
                for k, (start, n) in enumerate(cut(len(ids), length)):
                    for column, value in zip(out, (doc_id, k, start, n, zlib.crc32(packed[4 * start : 4 * (start + n)]))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(pieces, _PIECES)


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Best-fit decreasing: the bins as lists of positions in ``sizes``. Rooms are integers, so the tightest bin that
    an item fits in is the lowest set bit of a mask of the rooms at hand."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(i)
        else:
            room, at = length, len(bins)
            bins.append([i])
        if room > size:
            with_room[room - size].append(at)
            rooms |= 1 << (room - size)
    return bins


def best_fit_counts(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of counts[size] items of each size, by runs of bins with equal room. Rows (size, first number,
    first bin, k, offset) in order: the items of that size from that number on, up to the next row's, go k to a bin."""
    plan: list[tuple[int, int, int, int, int]] = []
    with_room: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]
    rooms = n_bins = 0
    for size in sorted(counts, reverse=True):
        number, left = 0, counts[size]
        while left:
            fits = rooms >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                at, n = with_room[room].pop()
                if not with_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, at, n = length, n_bins, -(-left // (length // size))
                n_bins += n
            k = room // size
            for bins, each in ((min(n, left // k), k), (1, left % k)):
                if bins and each and n and left:
                    plan.append((size, number, at, each, length - room))
                    if room > each * size:
                        with_room[room - each * size].append((at, bins))
                        rooms |= 1 << (room - each * size)
                    number, left, at, n = number + bins * each, left - bins * each, at + bins, n - bins
            if n:
                with_room[room].append((at, n))
                rooms |= 1 << room
    return plan


def _fitted(items: DataFrame, length: int) -> DataFrame:
    """_BINS made best-fit of the items (total, members) of each partition, at most two chunks of them at a time."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            chunk = pa.Table.from_batches(held).combine_chunks()
            totals, members = chunk.column("total").to_numpy(), chunk.column("members").chunk(0)
            bins = best_fit(totals.tolist(), length)
            sizes = np.diff(members.offsets.to_numpy())
            order = np.fromiter((i for b in bins for i in b), np.int64, len(totals))
            n_members = [int(sizes[b].sum()) for b in bins]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_members)]).astype(np.int32)), members.take(pa.array(order)).flatten())
            total = np.array([int(totals[b].sum()) for b in bins])
            return pa.RecordBatch.from_arrays([pa.array(total >= length - SLACK), pa.array(total), lists], names=["closed", "total", "members"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 2 * CHUNK:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return items.select("total", "members").mapInArrow(fit, _BINS)


def _numbered(residue: DataFrame, length: int) -> DataFrame:
    """The pieces with part and number: their place among those of the same length in their task."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in batches:
            sizes = batch.column("length").to_numpy()
            order = np.argsort(sizes, kind="stable")
            at = np.empty(len(sizes), np.int64)
            at[order] = np.arange(len(sizes)) - np.searchsorted(sizes[order], sizes[order])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(sizes), part)), pa.array(at + seen[sizes])], names=[*batch.schema.names, "part", "number"])
            seen += np.bincount(sizes, minlength=length + 1)

    return residue.mapInArrow(number, f"{_PIECES}, part long, number long")


def pack_pieces(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32), each from 1 to ``length`` long."""
    pieces = save(pieces, "pack-pieces")
    columns = pieces.columns
    done = pieces.filter(F.col("length") >= length).select(F.array(F.struct(*columns)).alias("members"))
    items = pieces.filter(F.col("length") < length).select(F.col("length").alias("total"), F.array(F.struct(*columns)).alias("members"))
    n, level = items.count(), 0
    while True:
        parts = max(1, -(-n // CHUNK))
        if parts > 1:  # by row, so that copies of a document don't meet in one partition
            items = items.withColumn("nth", F.monotonically_increasing_id()).repartition(parts, F.xxhash64("nth", F.lit(level)))
        else:
            items = items.coalesce(1)  # one chunk
        bins = save(_fitted(items, length), f"pack-level-{level}")
        done = done.unionByName(bins.filter("closed").select("members"))
        items, left = bins.filter("not closed"), bins.filter("not closed").count()
        if parts == 1 or level and left > 0.99 * n:
            break
        n, level = left, level + 1
    residue = save(_numbered(items.select(F.explode("members").alias("m")).select("m.*"), length), "pack-residue")
    counts = residue.groupBy("length", "part").agg(F.count("*").alias("n"))
    plan = best_fit_counts({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, length)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = residue.join(counts, ["length", "part"]).select(*columns, (F.col("before") + F.col("number")).alias("number"))
    table = np.array(plan, dtype=np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]

    def placed_by_plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            size, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            row = table[np.searchsorted(keys, (size << 48) + number, side="right") - 1]
            i = number - row[:, 1]
            at = [pa.array(2 * (row[:, 2] + i // row[:, 3]) + 1), pa.array(row[:, 4] + i % row[:, 3] * size)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *at], names=[*columns, "sequence_id", "offset"])

    spread = numbered.mapInArrow(placed_by_plan, f"{_PIECES}, sequence_id long, offset long")

    # even numbers for the bins that are done, odd ones for those of the plan
    placed = done.select((2 * F.monotonically_increasing_id()).alias("sequence_id"), "members")
    at = "transform(members, (m, i) -> aggregate(slice(members, 1, i), 0L, (a, x) -> a + x.length))"
    placed = placed.select("sequence_id", F.explode(F.arrays_zip("members", F.expr(at).alias("offset"))).alias("m"))
    return placed.select("m.members.*", "sequence_id", "m.offset").unionByName(spread)


def pack(docs: DataFrame, **options) -> DataFrame:
    """One row per piece of every row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Rows with the same doc_id are packed each by itself. Sequence ids are arbitrary numbers; two runs may number and
    fill their sequences differently, but pieces and their ids are the same. An empty table gives no sequences.
    """
    return pack_pieces(pieces_of(docs, **options), options.get("length", LENGTH))
