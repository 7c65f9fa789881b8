"""Ranked lexical search without random access (NRA) over impact-sorted postings, for all items of a block at once.

A posting's impact is its term's weight times its saturated frequency. Postings are written in bands of falling impact and
read band after band. What has been read of a document gives its score for an item a lower bound; the greatest impacts
that are still unread of the item's other terms give the upper one. After each band

* the threshold of an item is the k-th highest lower bound of any document;
* documents whose upper bounds are below the thresholds of all items leave;
* an item is closed when the sum of its terms' unread impacts is below its threshold: no document without a read posting
  can still enter, so when all are closed only postings of documents that stayed are read on.

Reading goes on until the bands are exhausted for what stayed, so members, ties and scores are exact. The state is the
postings read so far of the documents that stayed, one row a document; intervals are computed from it in blocks, so no
row is ever made for a pair of item and document but each task's best k of an item.

Items are handled in blocks of bounded size (``ITEMS`` items or ``CHARS`` characters on average; one longer item makes a
longer block), so what goes to all executors of a block's terms is bounded however many items there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm.common import rounds, save
from strandlog.llm.letters import terms

K = 20
ITEMS = 2048
CHARS = 1 << 23
#: Shares of all postings that are read by the end of each band, about; they set how much a round reads, no result.
BANDS = (0.5, 0.75, 0.9, 1.0)
#: At most so many intervals, and so many gains of postings for items, are held at a time, about.
CELLS = 1 << 18
GAINS = 1 << 19

_STATE = "key long, doc_id long, terms array<int>, s array<long>"


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """key, doc_id, n, terms, tf of every document with a term: n counts all its terms, terms and tf those of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, ids, ns, offsets, found, tfs = [], [], [], [0], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                n, own = 0, Counter()
                for some in terms(text.as_py() or b""):
                    n += len(some)
                    own.update(filter(vocabulary.__contains__, some))
                if not n:
                    continue
                key += 1
                keys.append(key)
                ids.append(doc_id)
                ns.append(n)
                found.extend(map(vocabulary.__getitem__, own))
                tfs.extend(own.values())
                offsets.append(len(found))
            offsets = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], names=["key", "doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(count, "key long, doc_id long, n long, terms array<int>, tf array<long>")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, length of each row's list)"""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _as_lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values, kind))


def banded(docs: DataFrame, n_docs: int, n_terms: int, weights: np.ndarray, cuts: np.ndarray) -> DataFrame:
    """band, key, doc_id, terms, s: of each document the postings of each band; band b has impacts from cuts[b] on, below cuts[b - 1]."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (term, lengths), (tf, _), n = _lists(batch.column("terms")), _lists(batch.column("tf")), batch.column("n").to_numpy()
            m = 75 + (25 * n * n_docs) // n_terms
            s = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, lengths))
            impact = s * weights[term]
            band = np.searchsorted(-cuts, -impact, side="left")
            row = np.repeat(np.arange(len(n)), lengths)
            for b in range(len(cuts)):
                here = (band == b) & (impact > 0)
                per_row = np.bincount(row[here], minlength=len(n))
                some = pa.array(np.flatnonzero(per_row))
                columns = [pa.array(np.full(len(some), b, np.int32)), batch.column("key").take(some), batch.column("doc_id").take(some)]
                columns += [_as_lists(x[here], per_row[per_row > 0], kind) for x, kind in ((term, pa.int32()), (s, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["band", "key", "doc_id", "terms", "s"])

    return docs.mapInArrow(bands, f"band int, {_STATE}")


class Items:
    """A block's items: for each term the items that hold it and the term's occurrences there."""

    def __init__(self, texts: list[str | None]):
        counts = [Counter(t for some in terms((text or "").encode()) for t in some) for text in texts]
        self.vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        pairs = sorted((self.vocabulary[t], q, n) for q, own in enumerate(counts) for t, n in own.items())
        self.n_items, self.n_terms = len(texts), len(self.vocabulary)
        term, self.item, self.times = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ([], [], [])))
        self.term = term
        self.start = np.searchsorted(term, np.arange(self.n_terms + 1))


class Intervals:
    """Score intervals of documents for all items, from the postings read of them. ``unread``: the greatest unread s of each term."""

    def __init__(self, items: Items, weights: np.ndarray, unread: np.ndarray):
        self.items, self.gain = items, items.times * weights[items.term]
        self.loss = self.gain * unread[items.term]
        self.open = np.zeros(items.n_items, np.int64)
        np.add.at(self.open, items.item, self.loss)

    def blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """(rows, lower, upper), the bounds as matrices of rows by items."""
        n, step = self.items.n_items, max(1, CELLS // self.items.n_items)
        for at in range(0, batch.num_rows, step):
            rows = batch.slice(at, step)
            (term, lengths), (s, _) = _lists(rows.column("terms")), _lists(rows.column("s"))
            held = self.items.start[term + 1] - self.items.start[term]
            row = np.repeat(np.arange(rows.num_rows), lengths)
            lower, seen = np.zeros(rows.num_rows * n, np.int64), np.zeros(rows.num_rows * n, np.int64)
            before = np.concatenate([[0], np.cumsum(held)])
            cuts = np.unique(np.minimum(len(term), np.searchsorted(before, np.arange(0, before[-1] + GAINS, GAINS))))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                posting = np.repeat(np.arange(lo, hi), held[lo:hi])
                place = self.items.start[term[posting]] + np.arange(before[lo], before[hi]) - before[posting]
                cell = row[posting] * n + self.items.item[place]
                np.add.at(lower, cell, s[posting] * self.gain[place])
                np.add.at(seen, cell, self.loss[place])
            lower = lower.reshape(-1, n)
            yield rows, lower, lower + self.open - seen.reshape(-1, n)


def _thresholds(state: DataFrame, intervals: Intervals, k: int) -> np.ndarray:
    """Each item's k-th highest lower bound, 0 if fewer documents have one."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((0, intervals.items.n_items), np.int64)
        for batch in batches:
            for _, lower, _ in intervals.blocks(batch):
                top = np.concatenate([top, lower])
                if len(top) > k:
                    top = np.partition(top, len(top) - k, axis=0)[-k:]
        rank, item = np.nonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(top[rank, item])], names=["item", "lower"])

    order = Window.partitionBy("item").orderBy(F.desc("lower"))
    kth = state.mapInArrow(best, "item int, lower long").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).filter(F.col("r") == k)
    out = np.zeros(intervals.items.n_items, np.int64)
    for r in kth.collect():  # at most one row an item of the block
        out[r.item] = r.lower
    return out


def _staying(state: DataFrame, intervals: Intervals, thresholds: np.ndarray) -> DataFrame:
    """The documents whose upper bound reaches the threshold of an item."""

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, upper in intervals.blocks(batch):
                yield rows.filter(pa.array(((upper >= thresholds) & (upper > 0)).any(axis=1)))

    return state.mapInArrow(stay, _STATE)


def _best(state: DataFrame, intervals: Intervals, k: int) -> DataFrame:
    """item, doc_id, score: each task's k best of an item. Everything of the documents must have been read."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = intervals.items.n_items
        top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        least = np.zeros(n, np.int64)
        for batch in batches:
            for rows, score, _ in intervals.blocks(batch):
                ids = rows.column("doc_id").to_numpy()
                good = (score > 0) & (score >= least)
                for q in np.flatnonzero(good.any(axis=0)):
                    s, d = np.concatenate([top[q][0], score[good[:, q], q]]), np.concatenate([top[q][1], ids[good[:, q]]])
                    order = np.lexsort((d, -s))[:k]
                    top[q] = s[order], d[order]
                    least[q] = s[order[-1]] if len(order) == k else 0
        item = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s, _ in top])
        yield pa.RecordBatch.from_arrays([pa.array(item), *(pa.array(np.concatenate([x[i] for x in top])) for i in (1, 0))], names=["item", "doc_id", "score"])

    return state.mapInArrow(best, "item int, doc_id long, score long")


def _ranked_block(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """item_id, rank, doc_id, score of the items in rows (item_id, text)."""
    spark, items = docs.sparkSession, Items([r.text for r in rows])
    docs = save(counted(docs, items.vocabulary), "lexical-docs")
    total = docs.agg(F.count("*"), F.sum("n")).first()
    n_docs, n_terms = total[0], total[1] or 1
    df = np.zeros(items.n_terms, np.int64)
    for r in docs.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # the block's terms
        df[r.term] = r["count"]
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    # the impact of a term's commonest postings, those of one occurrence, places the cuts
    by_weight = np.argsort(-weights)
    share = np.cumsum(df[by_weight]) / max(1, df.sum())
    cuts = np.array([*(weights[by_weight[min(items.n_terms - 1, int(np.searchsorted(share, x)))]] * 480_000 + 1 for x in BANDS[:-1]), 0] if items.n_terms else [0])
    bands = save(banded(docs.filter("doc_id is not null"), n_docs, n_terms, weights, cuts), "lexical-bands", by=["band"])

    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros((len(cuts), items.n_terms), np.int64)
        for batch in batches:
            (term, lengths), (s, _) = _lists(batch.column("terms")), _lists(batch.column("s"))
            np.maximum.at(most, (np.repeat(batch.column("band").to_numpy(), lengths), term), s)
        band, term = np.nonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(band.astype(np.int32)), pa.array(term.astype(np.int32)), pa.array(most[band, term])], names=["band", "term", "s"])

    most = np.zeros((len(cuts) + 1, items.n_terms), np.int64)
    for r in bands.select("band", "terms", "s").mapInArrow(greatest, "band int, term int, s long").groupBy("band", "term").agg(F.max("s").alias("s")).toLocalIterator():
        most[r.band, r.term] = r.s
    unread = np.maximum.accumulate(most[::-1], axis=0)[::-1][1:]  # after each band

    state = spark.createDataFrame([], _STATE)
    closed = False
    for b in range(len(cuts)):
        read = bands.filter(F.col("band") >= b if closed else F.col("band") == b).drop("band")
        if closed:  # no new document enters; what stayed is read to its end
            read = read.join(state.select("key"), "key", "left_semi")
        last = closed or b == len(cuts) - 1
        if b:
            read = state.unionByName(read).groupBy("key", "doc_id").agg(F.collect_list(F.struct("terms", "s")).alias("p"))
            read = read.select("key", "doc_id", F.flatten("p.terms").alias("terms"), F.flatten("p.s").alias("s"))
        intervals = Intervals(items, weights, unread[-1] if last else unread[b])
        if last:
            state = read
            break
        read = save(read, "lexical-read")
        thresholds = _thresholds(read, intervals, k)
        state = save(_staying(read, intervals, thresholds), "lexical-state")
        closed = bool((intervals.open < thresholds).all())
    ids = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(rows)], "item int, item_id long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    best = _best(state, intervals, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item with a score above 0, ties by doc_id.

    Null and empty texts have no terms: such documents count nowhere, such items have no rows. Documents without a doc_id
    count in the statistics and aren't ranked; those that share one are ranked each by itself. Items that are the same
    in item_id and text are one; items that only share an item_id are ranked each by itself. Other columns play no part.
    """
    spark = docs.sparkSession
    with rounds(spark):
        items = save(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct(), "lexical-items")
        n, chars = items.agg(F.count("*"), F.sum(F.length("text"))).first()
        n_blocks = max(1, -(-n // ITEMS), -(-(chars or 0) // CHARS))
        out = None
        for block in range(n_blocks):
            rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).orderBy("item_id", "text").collect()  # bounded
            if rows:
                found = save(_ranked_block(docs, rows, k), "lexical", lasting=True)
                out = found if out is None else out.unionByName(found)
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
