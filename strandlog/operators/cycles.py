"""Shortest ways back for all ordered pairs of accounts at once, by a search from both ends that meets in the middle.

For a pair u -> v the way back is a walk v ... p -> u with p other than v; its level is the distance from v to p. The
forward side holds, for each v that is still asked for, the accounts at each distance with the least predecessor as
parent. The backward side holds, for each u, the accounts from which some p that pays u is at a distance, with that p: the
two nearest p where u and v pay each other (as p may not be v), else the nearest one. A level is settled by joining
half-way accounts, from the side that has fewer of them for the pair, so a hub next to an account of few edges costs what
the small side has. Both sides go six hops at most and end with the last pair that asks for them.

No row holds a path: parents give the first half of the way, and the second is walked through the accounts that the
backward side knows to lead to p.

Rows of a round are bounded: where a side passes ``max_rows``, its pairs are searched in halves, one after another. So more
pairs or larger hubs cost time, no memory, and there is always an answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions.written import cut

MAX_HOPS = 12
MAX_ROWS = 2_000_000_000


class TooManyRows(RuntimeError):
    """A round of a search over several roots is too large to be done for all of them together."""


def in_halves(asked: DataFrame, key: str, search: Callable[[DataFrame, int], DataFrame], max_rows: int) -> DataFrame:
    """What ``search`` finds for all that is asked, searched in halves by ``key`` wherever it raises TooManyRows. A single
    key is searched whatever its size."""
    found, parts = None, [(asked, 0, False)]
    while parts:
        part, depth, single = parts.pop()
        try:
            more = search(part, 1 << 62 if single else max_rows)
            found = more if found is None else found.unionByName(more)
        except TooManyRows:
            single = part.select(key).distinct().limit(2).count() < 2
            side = F.pmod(F.shiftright(F.xxhash64(key, F.lit(depth // 60)), depth % 60), F.lit(2))
            parts += [(part, depth, True)] if single else [(cut(part.filter(side == half), "half"), depth + 1, False) for half in (0, 1)]
    return found


def core_of(pairs: DataFrame) -> DataFrame:
    """Pairs left when nodes without a way in or out are taken off again and again; all cycles are in them. It ends
    when a round takes few: what is left over costs the search a little and changes nothing."""
    size, left = None, pairs
    while size is None or now < 0.9 * size:
        size = left.count() if size is None else now
        left = left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        left = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        left = cut(left.select("src", "dst"), "core")
        now = left.count()
    return left


def _checked(rows: DataFrame, name: str, max_rows: int) -> DataFrame:
    rows = cut(rows, name)
    if (n := rows.count()) > max_rows:
        raise TooManyRows(f"{n} rows of {name}")
    return rows


def _forward(last: DataFrame, known: DataFrame, step: DataFrame, level: int) -> DataFrame:
    """v, node, parent, lvl of the accounts first reached at a level."""
    on = last.join(step, "node").groupBy("v", F.col("next").alias("reached")).agg(F.min("node").alias("parent"))
    return on.withColumnRenamed("reached", "node").join(known.select("v", "node"), ["v", "node"], "left_anti").select("v", "node", "parent", F.lit(level).alias("lvl"))


def _backward(last: DataFrame, known: DataFrame, step: DataFrame, distance: int) -> DataFrame:
    """u, node, p, places, dist: the accounts from which p is at a distance, each with ``places`` nearest p at most."""
    back = step.select(F.col("next").alias("node"), F.col("node").alias("before"))
    on = last.join(back, "node").select("u", F.col("before").alias("node"), "p", "places").distinct()
    held = known.groupBy("u", "node").agg(F.count("*").alias("held"), F.min("p").alias("one"))
    on = on.join(held, ["u", "node"], "left").filter("held is null or held < places and one <> p")
    order = Window.partitionBy("u", "node").orderBy("p")
    on = on.withColumn("r", F.row_number().over(order)).filter("r <= places - coalesce(held, 0)")
    return on.select("u", "node", "p", "places", F.lit(distance).alias("dist"))


def _met(left: DataFrame, forward: DataFrame, backward: DataFrame) -> DataFrame:
    """left with the least p for which a half-way account is in both sides' rows, null if there is none. Pairs of which a
    side has come to its end are gone: they have no way back."""
    sizes = left.join(forward.groupBy("v").agg(F.count("*").alias("n_forward")), "v").join(backward.groupBy("u").agg(F.count("*").alias("n_backward")), "u")
    f, b = forward.select("v", "node"), backward.select("u", "node", "p")
    one = sizes.filter("n_forward <= n_backward").select("u", "v").join(f, "v").join(b, ["u", "node"])
    two = sizes.filter("n_forward > n_backward").select("u", "v").join(b, "u").join(f, ["v", "node"])
    met = one.select("u", "v", "p").unionByName(two.select("u", "v", "p")).filter("p <> v").groupBy("u", "v").agg(F.min("p").alias("p"))
    return sizes.select("u", "v").join(met, ["u", "v"], "left")


def _ways(hits: DataFrame, forward: DataFrame, backward: DataFrame, step: DataFrame) -> DataFrame:
    """src, dst, level, path of the hits (u, v, level, p)."""
    hits = hits.withColumn("a", F.expr("(level + 1) div 2")).withColumn("b", F.expr("level div 2"))
    middle = hits.join(backward.withColumnRenamed("dist", "b"), ["u", "p", "b"]).join(forward.select("v", "node", F.col("lvl").alias("a")), ["v", "node", "a"])
    middle = cut(middle.select("u", "v", "p", "node", F.col("b").alias("rest")), "middle")
    to_p, arcs = backward.select("u", "p", F.col("node").alias("next"), F.col("dist").alias("rest")), None
    for _ in range((MAX_HOPS - 1) // 2):  # all accounts on the shortest ways from the middle to p, with their least predecessor
        on = middle.filter("rest > 0").withColumn("rest", F.col("rest") - 1).join(to_p, ["u", "p", "rest"]).join(step, ["node", "next"])
        on = on.groupBy("u", "v", "p", "rest", F.col("next").alias("reached")).agg(F.min("node").alias("parent")).withColumnRenamed("reached", "node")
        middle = cut(on, "second-half")
        arcs = middle if arcs is None else arcs.union(middle)
        if middle.filter("rest > 0").isEmpty():
            break
    way = hits.select("u", "v", "level", "a", "b", F.col("p").alias("at"), F.array("p").alias("path"))
    steps = [(arcs.filter(F.col("rest") == i).select("u", "v", F.col("node").alias("at"), "parent"), ["u", "v", "at"], F.col("b") > i) for i in range((MAX_HOPS - 1) // 2)]
    steps += [(forward.filter(F.col("lvl") == i).select("v", F.col("node").alias("at"), "parent"), ["v", "at"], F.col("a") >= i) for i in range(MAX_HOPS // 2, 0, -1)]
    for n, (known, on, goes) in enumerate(steps):
        way = way.join(known, on, "left").withColumn("parent", F.when(goes, F.col("parent")))
        way = way.select("u", "v", "level", "a", "b", F.coalesce("parent", "at").alias("at"), F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat(F.array("parent"), "path")).alias("path"))
        if n == len(steps) // 2:
            way = cut(way, "ways")
    return cut(way.select(F.col("u").alias("src"), F.col("v").alias("dst"), "level", "path"), "ways")


def return_paths(pairs: DataFrame, asked: DataFrame | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """src, dst, level, path for the ordered pairs (distinct, without self-loops) that a way leads back from dst to src
    within the hop budget. path lists the accounts from dst to the last before src, the least account breaking each tie from
    its end on; level is its length less one, 1 to 11. ``asked``: those of the pairs that are asked for, if not all; then
    nothing is done for the graph as a whole."""
    core = core_of(pairs.select("src", "dst")) if asked is None else pairs.select("src", "dst")
    step = core.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    back = core.select(F.col("dst").alias("u"), F.col("src").alias("v"), F.lit(2).alias("places"))
    wanted = core if asked is None else asked
    asked = cut(wanted.select(F.col("src").alias("u"), F.col("dst").alias("v")).join(back, ["u", "v"], "left").select("u", "v", F.coalesce("places", F.lit(1)).alias("places")), "asked")

    def search(part: DataFrame, most: int) -> DataFrame:
        left = part.select("u", "v")
        forward = last_f = part.select("v").distinct().select("v", F.col("v").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("lvl"))
        ends = part.groupBy("u").agg(F.max("places").alias("places"))
        backward = last_b = _checked(step.select(F.col("next").alias("u"), F.col("node").alias("p")).join(ends, "u").select("u", F.col("p").alias("node"), "p", "places", F.lit(0).alias("dist")), "backward", most)
        hits = None
        for level in range(1, MAX_HOPS):
            if level % 2:
                last_f = _checked(_forward(last_f.join(left.select("v").distinct(), "v", "left_semi"), forward, step, level // 2 + 1), "forward", most)
                forward = forward.union(last_f)
            else:
                last_b = _checked(_backward(last_b.join(left.select("u").distinct(), "u", "left_semi"), backward, step, level // 2), "backward", most)
                backward = backward.union(last_b)
            judged = cut(_met(left, last_f, last_b), "met")
            found = judged.filter("p is not null").withColumn("level", F.lit(level))
            hits = found if hits is None else hits.union(found)
            left = judged.filter("p is null").select("u", "v")
            if left.isEmpty():
                break
        return _ways(hits, forward, backward, step)

    return in_halves(asked, "v", search, max_rows)


def open_ends(pairs: DataFrame, roots: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """root, boundary, goes_on: the nearest account without a way out that a root reaches within the budget less one hop
    (the least of equally near), null if none; and where there is none, whether some account is first reached at the hop
    after the budget's last. A root's search ends at its first open end."""
    step = pairs.select(F.col("src").alias("node"), F.col("dst").alias("next"))

    def search(part: DataFrame, most: int) -> DataFrame:
        frontier = seen = cut(part.select("root", F.col("root").alias("node")), "reached")
        found = None
        for level in range(MAX_HOPS + 1):
            if level == MAX_HOPS:
                more = frontier.select("root", F.lit(None).cast("string").alias("boundary"), F.lit(True).alias("goes_on")).distinct()
            else:
                ends = frontier.join(step.select("node"), "node", "left_anti").groupBy("root").agg(F.min("node").alias("boundary"))
                more = cut(ends.select("root", "boundary", F.lit(False).alias("goes_on")), "ends")
                on = frontier.join(more, "root", "left_anti").join(step, "node").select("root", F.col("next").alias("node")).distinct()
                frontier = _checked(on.join(seen, ["root", "node"], "left_anti"), "reached", most)
                seen = seen.union(frontier)
            found = more if found is None else found.union(more)
            if frontier.isEmpty():
                break
        return found

    return in_halves(cut(roots, "roots"), "root", search, max_rows)
