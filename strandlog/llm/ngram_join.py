"""N-gram Jaccard join by grouped prefixes, with the components of its links.

1. Counting. Shingle hashes are dealt out in packed blocks (not a row each) to find, for every document, how many of
   its shingles occur in more than one. A document linked at t shares at least t of its own shingles, so the others have
   no link; this is exact and leaves few documents. A shingle that several documents of one block have is sent once.
2. Equal sets become one class, told by a 128-bit digest, and a node of the graph of links.
3. Grouped prefixes. The shingles that are left are counted again and ordered by how many sets have them, then by hash.
   Two linked sets share one of the first n - ceil(t n) + 1 of each. Those that only one set has come first in this order
   and are left out, but their number counts. Sets with the same size, the same number of such and the same prefix form
   a group; only groups are matched.
4. Leaders. Members are verified against their group's least, leaders against the least of each prefix shingle's bucket:
   a number of pairs in proportion to the rows. What links joins components.
5. The rest, exactly, in buckets that still hold several components. Where a shingle is the first that two sets share,
   its places in both bound what they can share at all, and so the sizes of partners. Per bucket and size the largest
   such bound is kept, and a group without a partner there leaves: documents made from one template that aren't linked
   leave here without being paired. Pairs of the groups that stay are filtered: sizes, places, different components, and
   no earlier shingle in both prefixes. Groups with a pair left are expanded to members, which are verified on the whole
   sets where their least shared shingle lies. Only links that join two components are returned. A large bucket is dealt
   out as pairs of blocks.

Nothing is written for each pair of a bucket. The blocks of the counts are cut so that a worker holds some ``CELL`` bytes
whatever the size of the table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.common import as_row, save
from strandlog.llm.links import components
from strandlog.llm.shingles import shingle_sets

BLOCK = 1_000
CELL = 48_000_000
MOST_TASKS = 20_000
NO_ID = -(2**63)
_BATCH = 4_000
_PACKED = 1_000_000
_MANY = 2**16 - 1  # the place of a shingle that several documents of a block have


def _least_overlap(n, m, num: int, den: int):
    """The smallest intersection of sets of n and m with den * intersection >= num * union."""
    return -(-num * (n + m) // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _rows(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _cells(docs: DataFrame, n_bytes: int) -> tuple[int, int]:
    """Into how many cells shingles are dealt, and over how many tasks."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = max(tasks, -(-n_bytes // CELL))
    return cells, min(cells, max(tasks, MOST_TASKS))


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each cell, of rows sorted by cell."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["cell"] != row["cell"]:
                yield held[0]["cell"], held
                held = []
            held.append(row)
    if held:
        yield held[0]["cell"], held


def _shared_counts(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest, n_shared (its shingles that are in several rows) of every row of docs
    (doc_id, text_hash, text)."""
    n_bytes = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    cells, tasks = _cells(docs, n_bytes)
    schema = pa.schema([("cell", pa.int32()), ("batch", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("digests", pa.binary()), ("shared", pa.binary()), ("shingles", pa.binary()), ("places", pa.binary())])
    ddl = "cell int, batch long, ids binary, sizes binary, digests binary, shared binary, shingles binary, places binary"
    none = {f.name: None for f in schema}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k_th = TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(at, _BATCH)
                sets = list(shingle_sets(batch.column(2), k))
                sizes = np.array([len(s) for s in sets], dtype=np.uint32)
                ids = np.array([batch.column(0).to_pylist(), batch.column(1).to_pylist()], dtype=np.int64)
                shingles = np.concatenate([*sets, np.zeros(0, np.uint64)])
                places = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
                order = np.argsort(shingles, kind="stable")
                shingles, places = shingles[order], places[order]
                new = np.concatenate(([True], shingles[1:] != shingles[:-1]))[: len(shingles)]
                times = np.diff(np.append(np.flatnonzero(new), len(shingles)))
                several = np.repeat(times > 1, times)
                shared = np.bincount(places[several], minlength=len(sets)).astype(np.uint32)
                places[several] = _MANY
                shingles, places = shingles[new], places[new]
                cell = (shingles >> np.uint64(32)) % np.uint64(cells)
                order = np.argsort(cell, kind="stable")
                short, places, cell = shingles[order].astype(np.uint32), places[order], cell[order]
                first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))[: len(cell)]).tolist()
                rows = [none | {"cell": zlib.crc32(k_th.to_bytes(8, "little")) % cells, "batch": k_th, "ids": ids.tobytes(), "sizes": sizes.tobytes(), "digests": b"".join(map(_digest, sets)), "shared": shared.tobytes()}]
                for low, high in zip(first, [*first[1:], len(cell)]):
                    rows.append(none | {"cell": int(cell[low]), "batch": k_th, "shingles": short[low:high].tobytes(), "places": places[low:high].tobytes()})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                k_th += 1

    out_schema = pa.schema([("batch", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("digests", pa.binary()), ("shared", pa.binary()), ("places", pa.binary())])
    out_ddl = "batch long, ids binary, sizes binary, digests binary, shared binary, places binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_cell(batches):
            rows = [{f.name: r.get(f.name) for f in out_schema} for r in held if r["ids"] is not None]
            some = [(r["batch"], np.frombuffer(r["shingles"], np.uint32), np.frombuffer(r["places"], np.uint16)) for r in held if r["ids"] is None]
            shingles = np.concatenate([*(s for _, s, _ in some), np.zeros(0, np.uint32)])
            order = np.argsort(shingles, kind="stable")
            ordered = shingles[order]
            same = np.concatenate(([False], ordered[1:] == ordered[:-1], [False]))
            shared = np.zeros(len(shingles), dtype=bool)
            shared[order] = (same[1:] | same[:-1])[: len(shingles)]
            at = 0
            for batch, s, places in some:
                hit = places[shared[at : at + len(s)]]
                at += len(s)
                hit = hit[hit != _MANY]  # those were counted where they were dealt
                if len(hit):
                    rows.append({"batch": batch, "ids": None, "sizes": None, "digests": None, "shared": None, "places": hit.tobytes()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=out_schema)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(_BATCH, dtype=np.int64))
        facts = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["ids"] is not None:
                    facts[r["batch"]] = r
                else:
                    sums[r["batch"]] += np.bincount(np.frombuffer(r["places"], np.uint16), minlength=_BATCH)
        for k_th, r in facts.items():
            ids, sizes = np.frombuffer(r["ids"], np.int64).reshape(2, -1), np.frombuffer(r["sizes"], np.uint32)
            digests = [r["digests"][16 * i : 16 * i + 16] for i in range(len(sizes))]
            shared = sums[k_th][: len(sizes)] + np.frombuffer(r["shared"], np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[0]), pa.array(ids[1]), pa.array(sizes.astype(np.int64)), pa.array(digests, pa.binary()), pa.array(shared)], names=["doc_id", "text_hash", "n_shingles", "digest", "n_shared"]
            )

    dealt = docs.select("doc_id", "text_hash", "text").mapInArrow(deal, ddl)
    counted = dealt.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(count, out_ddl)
    totals = counted.repartition(tasks, "batch").mapInArrow(total, "doc_id long, text_hash long, n_shingles long, digest binary, n_shared long")
    return save(totals, "ngram-counts")


def _ordered_sets(docs: DataFrame, wanted: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """node, n, alone (its shingles that no other wanted set has), prefix (the shared ones among the first, rarest first)
    and shingles (ascending) of the wanted classes (node, doc_id, text_hash) that can be linked at all."""
    n_shingles = wanted.agg(F.sum("n").alias("n")).first().n or 0
    cells, tasks = _cells(docs, 8 * n_shingles)
    packed_schema = pa.schema([("batch", pa.int64()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("shingles", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k_th = TaskContext.get().partitionId() << 32
        held: tuple[list, list] = ([], [])

        def packed() -> pa.RecordBatch:
            sizes = np.array([len(s) for s in held[1]], dtype=np.uint32)
            row = [{"batch": k_th, "nodes": np.array(held[0], np.int64).tobytes(), "sizes": sizes.tobytes(), "shingles": np.concatenate(held[1]).tobytes()}]
            held[0].clear()
            held[1].clear()
            return pa.RecordBatch.from_pylist(row, schema=packed_schema)

        for batch in batches:
            for node, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k)):
                held[0].append(node)
                held[1].append(s)
                if sum(map(len, held[1])) >= _PACKED if len(held[1]) % 50 == 0 or len(s) >= _PACKED else False:
                    yield packed()
                    k_th += 1
        if held[0]:
            yield packed()

    def distinct(shingles: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct shingles of a batch in the order in which they are dealt, with their cells and times; and where
        each of the batch's shingles is among them."""
        u, where, times = np.unique(np.frombuffer(shingles, np.uint64), return_inverse=True, return_counts=True)
        cell = (u >> np.uint64(32)) % np.uint64(cells)
        order = np.argsort(cell, kind="stable")
        rank = np.empty(len(u), np.int64)
        rank[order] = np.arange(len(u))
        return u[order], cell[order].astype(np.int64), times[order].astype(np.uint32), rank[where]

    dealt_schema = pa.schema([("cell", pa.int32()), ("batch", pa.int64()), ("at", pa.int64()), ("short", pa.binary()), ("times", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                u, cell, times, _ = distinct(r["shingles"])
                first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))[: len(cell)]).tolist()
                yield pa.RecordBatch.from_pylist([
                    {"cell": int(cell[low]), "batch": r["batch"], "at": low, "short": u[low:high].astype(np.uint32).tobytes(), "times": times[low:high].tobytes()}
                    for low, high in zip(first, [*first[1:], len(cell)])
                ], schema=dealt_schema)

    told_schema = pa.schema([("batch", pa.int64()), ("at", pa.int64()), ("times", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_cell(batches):
            short = np.concatenate([np.frombuffer(r["short"], np.uint32) for r in held])
            times = np.concatenate([np.frombuffer(r["times"], np.uint32) for r in held]).astype(np.int64)
            _, where = np.unique(short, return_inverse=True)
            sums = np.minimum(np.bincount(where, weights=times), 2**32 - 1).astype(np.uint32)[where]
            ends = np.cumsum([len(r["short"]) // 4 for r in held])
            yield pa.RecordBatch.from_pylist([{"batch": r["batch"], "at": r["at"], "times": sums[e - len(r["short"]) // 4 : e].tobytes()} for r, e in zip(held, ends)], schema=told_schema)

    out_schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("alone", pa.int64()), ("prefix", pa.binary()), ("shingles", pa.binary())])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts, told = {}, defaultdict(list)
        for batch in batches:
            for r in batch.to_pylist():
                if r["nodes"] is not None:
                    facts[r["batch"]] = r
                else:
                    told[r["batch"]].append((r["at"], r["times"]))
        for k_th, r in facts.items():
            *_, where = distinct(r["shingles"])
            times = np.frombuffer(b"".join(t for _, t in sorted(told.pop(k_th))), np.uint32)[where]
            shingles, nodes, sizes = (np.frombuffer(r[c], t) for c, t in (("shingles", np.uint64), ("nodes", np.int64), ("sizes", np.uint32)))
            columns: dict[str, list] = {f.name: [] for f in out_schema}
            for node, n, end in zip(nodes.tolist(), sizes.tolist(), np.cumsum(sizes, dtype=np.int64).tolist()):
                s, t = shingles[end - n : end], times[end - n : end]
                alone, length = int((t < 2).sum()), prefix_length(n, num, den)
                if alone < length:
                    first = s[np.lexsort((s, t))][alone:length]
                    for c, value in zip(columns.values(), (node, n, alone, first.tobytes(), s.tobytes())):
                        c.append(value)
            yield _rows(columns, out_schema)

    on = [F.col("d.doc_id") == F.col("w.doc_id"), F.col("d.text_hash") == F.col("w.text_hash")]
    texts = docs.alias("d").join(wanted.alias("w"), on).select("w.node", "d.text").dropDuplicates(["node"])
    packed = save(texts.mapInArrow(pack, "batch long, nodes binary, sizes binary, shingles binary"), "ngram-packed")
    dealt = packed.mapInArrow(deal, "cell int, batch long, at long, short binary, times binary")
    told = dealt.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(count, "batch long, at long, times binary")
    both = packed.unionByName(told, allowMissingColumns=True).select("batch", "nodes", "sizes", "shingles", "at", "times")
    return save(both.repartition(tasks, "batch").mapInArrow(order, "node long, n long, alone long, prefix binary, shingles binary"), "ngram-sets")


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two ascending sets are alike enough; stops early where the smaller hashes already differ too much."""
    least = _least_overlap(len(a), len(b), num, den)
    if least > min(len(a), len(b)):
        return False
    spare = len(a) + len(b) - 2 * least  # so many may be in one set only
    p, q = a[: len(a) // 8 + 1], b[: len(b) // 8 + 1]
    upto = min(p[-1], q[-1])
    p, q = p[: np.searchsorted(p, upto, "right")], q[: np.searchsorted(q, upto, "right")]
    if len(p) + len(q) - 2 * len(np.intersect1d(p, q, assume_unique=True)) > spare:
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= least


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [_linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), num, den) for p, q in zip(x, y)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    # the side with one row for each of many pairs goes first, so that skew meets the sets' side only once
    return pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b").mapInArrow(keep, "a long, b long")


def _most(n: str, place: str, num: int, den: int) -> str:
    """The largest size of a set whose first shared shingle may be the one at ``place`` (from 0) of a set of n: they can
    share n - place at most, and must share num / (num + den) of both sizes together."""
    return f"(({n} - {place}) * {num + den} div {num} - {n})"


def _blocked(rows: DataFrame, key: str) -> DataFrame:
    """rows (shingle, key, ...) dealt to pairs of blocks (i, j), i <= j, of some BLOCK rows each; ``own`` is a row's."""
    size = rows.groupBy("shingle").agg(F.count("*").alias("members"))
    out = rows.join(size, "shingle").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    out = out.withColumn("own", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "members", "blocks")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """The rows (less shingle, i, j) of each pair of blocks, of rows sorted by these three."""
    key, held = None, []
    for batch in batches:
        for r in zip(*[c.to_pylist() for c in batch.columns]):
            if held and r[:3] != key:
                yield key, held
                held = []
            key = r[:3]
            held.append(r[3:])
    if held:
        yield key, held


def _near_groups(buckets: DataFrame, prefixes: DataFrame, tasks: int, num: int, den: int) -> DataFrame:
    """shingle, leader: the groups that have a pair to verify in a bucket, from rows (shingle, leader, n, place, most,
    low, high), where low and high are the least and greatest component of the group."""
    sizes = buckets.groupBy("shingle", "n").agg(F.max("most").alias("most"), F.count("*").alias("k"), F.min("low").alias("low"), F.max("high").alias("high"))
    sizes = sizes.groupBy("shingle").agg(F.collect_list(F.struct("n", "most", "k", "low", "high")).alias("sizes"))
    some = F.expr(
        f"exists(sizes, z -> z.n * {den} >= n * {num} and n * {den} >= z.n * {num} and z.n <= most and n <= z.most "
        "and (z.n <> n or z.k > 1 or low <> high) and (z.low <> low or z.high <> low or low <> high))"
    )
    left = save(buckets.join(sizes, "shingle").filter(some).drop("sizes"), "ngram-left")
    left = left.join(prefixes, "leader").withColumn("before", F.expr("substring(prefix, 1, cast(8 * (place - alone) as int))")).drop("prefix", "alone", "place")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are (own, leader, n, most, low, high, before)."""
        for (shingle, i, j), rows in _by_block(batches):
            rows.sort(key=lambda r: r[2])
            own, _, n, most, low, high = (np.array(x) for x in list(zip(*rows))[:6])
            before = [np.frombuffer(r[6], np.uint64) for r in rows]
            lengths = np.array([len(b) for b in before])
            ends = np.cumsum(lengths)
            every = np.concatenate([*before, np.zeros(0, np.uint64)])
            hit = (low != high) & (i == j)  # pairs within a group are verified where its first shingle lies
            hit &= lengths == 0
            for x in range(1, len(rows)):
                first = int(np.searchsorted(n, -(-num * n[x] // den)))
                last = min(x, int(np.searchsorted(n, most[x], "right")))
                if first >= last:
                    continue
                y = slice(first, last)
                good = (most[y] >= n[x]) & ~((low[y] == low[x]) & (high[y] == low[x]) & (low[x] == high[x]))
                if i != j:
                    good &= own[y] != own[x]
                if good.any() and lengths[x]:
                    start = ends[first] - lengths[first]
                    met = np.isin(every[start : ends[last - 1]], before[x])
                    good &= np.bincount(np.repeat(np.arange(last - first), lengths[y])[met], minlength=last - first) == 0
                if good.any():
                    hit[x] = True
                    hit[y] |= good
            leaders = [r[1] for r, h in zip(rows, hit) if h]
            yield pa.RecordBatch.from_arrays([pa.array([shingle] * len(leaders), pa.int64()), pa.array(leaders, pa.int64())], names=["shingle", "leader"])

    blocked = _blocked(left, "leader").select("shingle", "i", "j", "own", "leader", "n", "most", "low", "high", "before")
    blocked = blocked.repartition(tasks, "shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    return save(blocked.mapInArrow(pairs, "shingle long, leader long").distinct(), "ngram-near")


def _cross_links(near: DataFrame, members: DataFrame, sets: DataFrame, tasks: int, num: int, den: int) -> DataFrame:
    """Links between components, from the groups (shingle, leader) that have a pair to verify."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are (own, node, leader, component, n, before, shingles)."""
        for (_, i, j), rows in _by_block(batches):
            rows.sort(key=lambda r: r[4])
            n = np.array([r[4] for r in rows])
            reach = np.searchsorted(n, n * den // num, side="right")
            whole = [np.frombuffer(r[6], np.uint64) for r in rows]
            before = {r[2]: frozenset(np.frombuffer(r[5], np.uint64).tolist()) for r in rows}
            apart: dict[tuple, bool] = {}
            top: dict[int, int] = {}

            def find(x: int) -> int:
                while top.setdefault(x, x) != x:
                    top[x] = x = top[top[x]]
                return x

            found = []
            for x, r in enumerate(rows):
                for y in range(x + 1, int(reach[x])):
                    s = rows[y]
                    if i != j and r[0] == s[0] or find(r[3]) == find(s[3]):
                        continue
                    pair = r[2], s[2]
                    if pair not in apart:  # no earlier shingle is in both prefixes; a group's own pairs belong to its first
                        apart[pair] = not before[r[2]] if r[2] == s[2] else before[r[2]].isdisjoint(before[s[2]])
                    if apart[pair] and _linked(whole[x], whole[y], num, den):
                        top[find(r[3])] = find(s[3])
                        found.append({"a": r[1], "b": s[1]})
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    rows = near.join(members, "leader").withColumn("before", F.expr("substring(prefix, 1, 8 * (array_position(order, shingle) - 1))")).drop("prefix", "order")
    blocked = _blocked(rows, "node").join(sets.select("node", "shingles"), "node")
    blocked = blocked.select("shingle", "i", "j", "own", "node", "leader", "component", "n", "before", "shingles")
    blocked = blocked.repartition(tasks, "shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    return save(blocked.mapInArrow(verify, "a long, b long"), "ngram-cross")


def _classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of docs (doc_id, text_hash, n_shingles, digest) and the classes of equal sets (digest, node, least_id of
    its rows, component: the least node that links reach)."""
    num, den = percent, 100
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text").withColumn("text_hash", F.xxhash64("text"))
    counts = _shared_counts(docs, k)
    classes = counts.filter("n_shingles > 0").groupBy("digest").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("at"), F.first("n_shingles").alias("n"), F.max("n_shared").alias("n_shared"),
        F.min(F.nullif("doc_id", F.lit(NO_ID))).alias("least_id"),
    )
    # numbers depend on how rows were partitioned, so they are saved at once
    classes = save(classes.select("digest", "at.*", "n", "n_shared", "least_id", F.monotonically_increasing_id().alias("node")), "ngram-classes")
    sets = _ordered_sets(docs, classes.filter(F.col("n_shared") * den >= F.col("n") * num), k, num, den)

    groups = sets.groupBy("n", "alone", "prefix").agg(F.min("node").alias("leader"))
    members = save(sets.select("node", "n", "alone", "prefix").join(groups, ["n", "alone", "prefix"]), "ngram-members")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                prefixes = [np.frombuffer(p, np.int64) for p in some.column(3).to_pylist()]
                times = np.array([len(p) for p in prefixes], dtype=np.int64)
                leaders, n, alone = (np.repeat(np.array(some.column(c).to_pylist(), np.int64), times) for c in (0, 1, 2))
                places = np.concatenate([*map(np.arange, times), np.zeros(0, np.int64)]).astype(np.int64) + alone
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*prefixes, np.zeros(0, np.int64)])), pa.array(leaders), pa.array(n), pa.array(places)], names=["shingle", "leader", "n", "place"])

    prefixes = members.filter("node = leader").select("leader", "n", "alone", "prefix")
    of_groups = prefixes.mapInArrow(unpack, "shingle long, leader long, n long, place long").withColumn("most", F.expr(_most("n", "place", num, den)))
    of_groups = save(of_groups, "ngram-prefixes")
    firsts = of_groups.groupBy("shingle").agg(F.min(F.struct("leader", "n")).alias("first"), F.count("*").alias("k")).filter("k > 1")
    near = of_groups.join(firsts, "shingle").filter(F.col("leader") > F.col("first.leader"))
    near = near.filter((F.col("n") * den >= F.col("first.n") * num) & (F.col("first.n") * den >= F.col("n") * num))
    pairs = near.select(F.col("leader").alias("a"), F.col("first.leader").alias("b")).distinct()
    pairs = pairs.union(members.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")))
    links = save(_verified(save(pairs, "ngram-pairs"), sets, num, den), "ngram-links")
    joined = components(links).withColumnRenamed("node", "of")

    placed = members.join(joined, F.col("node") == F.col("of"), "left").drop("of").withColumn("component", F.coalesce("component", "node"))
    of_leader = placed.groupBy("leader").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    rows = of_groups.join(of_leader, "leader")
    mixed = rows.groupBy("shingle").agg(F.min("low").alias("least"), F.max("high").alias("greatest")).filter("least <> greatest").select("shingle")
    buckets = save(rows.join(mixed, "shingle", "left_semi").select("shingle", "leader", "n", "place", "most", "low", "high"), "ngram-buckets")
    tasks = _cells(docs, 64 * buckets.count())[1]
    near = _near_groups(buckets, prefixes.select("leader", "alone", "prefix"), tasks, num, den)
    order = of_groups.groupBy("leader").agg(F.expr("transform(array_sort(collect_list(struct(place, shingle))), x -> x.shingle)").alias("order"))
    wanted = placed.join(near.select("leader").distinct(), "leader", "left_semi").join(order, "leader").select("leader", "node", "component", "n", "prefix", "order")
    links = links.union(_cross_links(near, wanted, sets, tasks, num, den))
    joined = components(links).withColumnRenamed("node", "of")
    classes = classes.join(joined, F.col("node") == F.col("of"), "left").select("digest", "node", "least_id", F.coalesce("component", "node").alias("component"))
    return counts.select("doc_id", "text_hash", "n_shingles", "digest"), classes


def jaccard_components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    Rows link where 100 * intersection >= percent * union of their sets of k-word shingles (A-Z lowered); component_id
    is the least doc_id reachable by links, null only if every doc_id there is. A text with fewer than k words is one
    shingle; a null text or one without words has none and is linked with nothing, so its component_id is its doc_id.
    Every row is matched for itself, rows without a doc_id or with one that another text has too. Equal rows get equal
    results. Other columns are ignored; an empty table gives an empty one.
    """
    rows, classes = _classes(docs, k, percent)
    least = classes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_class = classes.join(least, "component").select("digest", "component_id", F.lit(True).alias("found"))
    out = rows.join(of_class, "digest", "left")
    own = F.nullif("doc_id", F.lit(NO_ID))
    return out.select(own.alias("doc_id"), "n_shingles", F.when(F.col("found"), F.col("component_id")).otherwise(own).alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component, that of its least doc_id (null last, then least text hash), with the columns
    it came with. Rows with equal doc_id and text count once, the least by all columns; texts without words are linked
    with nothing."""
    rows, classes = _classes(docs, k, percent)
    rows = rows.groupBy("doc_id", "text_hash", "digest").agg(F.count("*").alias("copies"))
    found = rows.join(classes.select("digest", "component"), "digest", "left")
    key = F.struct((F.col("doc_id") == NO_ID).alias("last"), "doc_id", "text_hash", "copies")
    kept = found.filter("component is not null").groupBy("component").agg(F.min(key).alias("key")).select("key.*")
    kept = kept.unionByName(found.filter("component is null").select((F.col("doc_id") == NO_ID).alias("last"), "doc_id", "text_hash", "copies"))
    kept = save(kept.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"), "copies"), "ngram-kept")
    given = docs.select(as_row(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("hash"))
    stays = given.join(kept, (F.col("id") == F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")))
    once = stays.filter("copies = 1").select("row.*")
    return once.unionByName(stays.filter("copies > 1").groupBy("id", "hash").agg(F.min("row").alias("row")).select("row.*"))
