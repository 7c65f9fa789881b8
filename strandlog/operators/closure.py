"""Inheritance of beliefs: closures, audits, spawning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.functions.written import cut
from strandlog.operators.holdings import beliefs_held


_ROW = ["belief_id", "depth", "agent_id", "from_agent_id", "inherited_at", "invalidated_at", "truncated"]


def _plain(beliefs: DataFrame, inheritance: DataFrame) -> DataFrame:
    """belief_id of the beliefs that every agent has from one agent at most, and their originators from none."""
    twice = inheritance.groupBy("belief_id", F.col("to_agent_id").alias("agent_id")).agg(F.count("*").alias("n"))
    twice = twice.join(beliefs.select("belief_id", F.col("originating_agent_id").alias("agent_id"), F.lit(True).alias("origin")), ["belief_id", "agent_id"], "left")
    return beliefs.select("belief_id").distinct().join(twice.filter("n > 1 or origin").select("belief_id"), "belief_id", "left_anti")


def _origins(beliefs: DataFrame) -> DataFrame:
    null_ts = F.lit(None).cast("timestamp")
    return beliefs.select(
        "belief_id", F.lit(0).alias("depth"), F.col("originating_agent_id").alias("agent_id"), F.lit(None).cast("long").alias("from_agent_id"),
        null_ts.alias("inherited_at"), null_ts.alias("invalidated_at"), F.lit(False).alias("truncated"), F.array("originating_agent_id").alias("path"),
    )


def _by_doubling(beliefs: DataFrame, inheritance: DataFrame, chains: bool) -> DataFrame:
    """The closure where each heir has a belief from one agent: every edge points to the one above it, and each round lets it
    point twice as far, so a lineage of n heirs takes log n rounds. What never comes to the originator (loops, and heirs of agents that
    never held the belief) isn't in the closure and leaves when the longest possible lineage has been covered."""
    edges = inheritance.join(beliefs.select("belief_id", "originating_agent_id"), "belief_id")
    row = F.struct("from_agent_id", "inherited_at", "invalidated_at")
    up = edges.select(
        "belief_id", F.col("to_agent_id").alias("agent_id"), F.col("from_agent_id").alias("above"), F.lit(1).alias("depth"), (F.col("from_agent_id") == F.col("originating_agent_id")).alias("arrived"),
        row.alias("edge"), (F.array("from_agent_id", "to_agent_id") if chains else F.lit(None).cast("array<long>")).alias("path"),
    )
    up = cut(up, "lineage")
    most = up.groupBy("belief_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < most and not up.filter("not arrived").isEmpty():
        over = up.select("belief_id", F.col("agent_id").alias("above"), F.col("above").alias("further"), F.col("depth").alias("more"), F.col("arrived").alias("now"), F.col("path").alias("before"))
        going = up.filter("not arrived").join(over, ["belief_id", "above"])
        path = F.concat("before", F.slice("path", 2, F.size("path"))) if chains else F.col("path")
        going = going.select("belief_id", "agent_id", F.col("further").alias("above"), (F.col("depth") + F.col("more")).alias("depth"), F.col("now").alias("arrived"), "edge", path.alias("path"))
        up = cut(up.filter("arrived").union(going), "lineage")
        reach *= 2
    return up.filter("arrived").select("belief_id", "depth", "agent_id", "edge.*", F.lit(False).alias("truncated"), "path").select(*_ROW, "path")


def _by_levels(level: DataFrame, inheritance: DataFrame) -> DataFrame:
    """The closure below ``level``, depth by depth, with the path of each row, by which an agent that is met again is told."""
    edges = inheritance.select("belief_id", F.col("from_agent_id").alias("agent_id"), F.col("to_agent_id").alias("next"), F.col("inherited_at").alias("at"), F.col("invalidated_at").alias("gone"))
    level, out, depth = cut(level, "closure"), None, 0
    while not level.isEmpty():
        depth += 1
        step = level.filter("not truncated").select("belief_id", "agent_id", "path").join(edges, ["belief_id", "agent_id"])
        again = F.array_contains("path", F.col("next"))
        level = cut(
            step.select(
                "belief_id", F.lit(depth).alias("depth"), F.col("next").alias("agent_id"), F.col("agent_id").alias("from_agent_id"), F.col("at").alias("inherited_at"),
                F.col("gone").alias("invalidated_at"), again.alias("truncated"), F.concat("path", F.array("next")).alias("path"),
            ),
            "closure",
        )
        out = level if out is None else out.union(level)
    return out


def inheritance_closure(beliefs: DataFrame, inheritance: DataFrame, chains: bool = False) -> DataFrame:
    """belief_id, depth, agent_id, from_agent_id, inherited_at, invalidated_at, truncated for all beliefs at once; with ``chains`` also
    path, the agents from the originator on.

    From each originator along the belief's edges; two ways in give two rows. Beliefs that every heir has from one agent,
    however deep they go, take a number of rounds that is the logarithm of their heirs. In the others an agent met again
    on its own path is told (truncated) and not followed, so every path ends; they take a round for each depth."""
    plain = cut(_plain(beliefs, inheritance), "plain")
    origins = _origins(beliefs)
    out = origins.union(_by_doubling(beliefs.join(plain, "belief_id", "left_semi"), inheritance.join(plain, "belief_id", "left_semi"), chains))
    below = _by_levels(origins.join(plain, "belief_id", "left_anti"), inheritance)
    if below is not None:
        out = out.union(below)
    return out if chains else out.drop("path")


def ancestor_chains(beliefs: DataFrame, inheritance: DataFrame) -> DataFrame:
    """belief_id, agent_id, chain from the holder back to the originator."""
    return inheritance_closure(beliefs, inheritance, chains=True).select("belief_id", "agent_id", F.reverse("path").alias("chain"))


def provenance_audit(beliefs: DataFrame, inheritance: DataFrame, agents: DataFrame) -> DataFrame:
    """edge_id, belief_id, codes, verdict of every edge.

    A1: the source is the heir's parent. A2: inherited when the heir was spawned. A3: the source held the belief by
    then (its originator always did). A4: the source's own edge hadn't been revoked before. An edge with an unknown
    agent is inconclusive; one that breaks an invariant is anomalous, which outranks that."""
    to = agents.select(F.col("agent_id").alias("to_agent_id"), "parent_id", "spawned_at", F.lit(True).alias("known_to"))
    source = agents.select(F.col("agent_id").alias("from_agent_id"), F.lit(True).alias("known_from"))
    held = inheritance.groupBy("belief_id", F.col("to_agent_id").alias("from_agent_id")).agg(F.min("inherited_at").alias("held_from"), F.min("invalidated_at").alias("revoked_at"))
    d = inheritance.join(beliefs.select("belief_id", "originating_agent_id"), "belief_id").join(to, "to_agent_id", "left").join(source, "from_agent_id", "left").join(held, ["belief_id", "from_agent_id"], "left")
    origin = F.col("from_agent_id") == F.col("originating_agent_id")
    codes = F.array_compact(
        F.array(
            F.when(F.col("known_to") & ~F.col("parent_id").eqNullSafe(F.col("from_agent_id")), "A1"),
            F.when(F.col("known_to") & (F.col("inherited_at") != F.col("spawned_at")), "A2"),
            F.when(~origin & F.coalesce(F.col("held_from") > F.col("inherited_at"), F.lit(True)), "A3"),
            F.when(F.col("inherited_at") > F.col("revoked_at"), "A4"),
        )
    )
    verdict = F.when(F.size("codes") > 0, "anomalous").when(F.col("known_to").isNull() | F.col("known_from").isNull(), "inconclusive").otherwise("ok")
    return d.withColumn("codes", codes).select("edge_id", "belief_id", "codes", verdict.alias("verdict"))


def belief_verdicts(audit: DataFrame, beliefs: DataFrame) -> DataFrame:
    d = audit.groupBy("belief_id").agg(F.expr("count_if(verdict = 'anomalous')").alias("anomalous"), F.expr("count_if(verdict = 'inconclusive')").alias("inconclusive"))
    d = beliefs.select("belief_id").join(d, "belief_id", "left").na.fill(0)
    return d.withColumn("verdict", F.when(F.col("anomalous") > 0, "ANOMALOUS").when(F.col("inconclusive") > 0, "INCONCLUSIVE").otherwise("CLEAN"))


def spawn(requests: DataFrame, agents: DataFrame, beliefs: DataFrame, inheritance: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a batch of requests (child_id, parent_id, at) appends: the children with the reasons of those refused, an
    edge for each active belief their parents hold, and the parents that retire."""
    parents = agents.select(F.col("agent_id").alias("parent_id"), "generation", "bloodline", "status")
    d = requests.join(parents, "parent_id", "left")
    refusal = F.when(F.col("status").isNull(), "UNKNOWN_PARENT").when(F.col("status") != "alive", "DEAD_PARENT")
    children = d.select("child_id", "parent_id", (F.col("generation") + 1).alias("generation"), "bloodline", "at", refusal.alias("refusal"))
    accepted = children.filter("refusal is null")
    held = beliefs_held(beliefs, inheritance, active_only=True).select(F.col("agent_id").alias("parent_id"), "belief_id")
    edges = accepted.join(held, "parent_id").select("belief_id", F.col("parent_id").alias("from_agent_id"), F.col("child_id").alias("to_agent_id"), F.col("at").alias("inherited_at"))
    return children, edges, accepted.select(F.col("parent_id").alias("agent_id"), F.col("at").alias("retired_at"))
