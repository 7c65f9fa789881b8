"""Who holds a belief, and whether they may act on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def holders(beliefs: DataFrame, inheritance: DataFrame) -> DataFrame:
    """agent_id, belief_id: originators and heirs, each once. Two equi-joins' worth of rows, not an OR-join."""
    origin = beliefs.select(F.col("originating_agent_id").alias("agent_id"), "belief_id")
    heirs = inheritance.select(F.col("to_agent_id").alias("agent_id"), "belief_id")
    return origin.union(heirs).distinct()


def beliefs_held(beliefs: DataFrame, inheritance: DataFrame, active_only: bool = False) -> DataFrame:
    """Each agent's beliefs, whether or not its inheritance edge is still open."""
    wanted = beliefs.filter("status = 'active'") if active_only else beliefs
    return holders(beliefs, inheritance).join(wanted, "belief_id")


def closure_agents(agents: DataFrame, beliefs: DataFrame, inheritance: DataFrame) -> DataFrame:
    held = holders(beliefs, inheritance.join(beliefs.select("belief_id"), "belief_id", "left_semi"))
    return agents.join(held, "agent_id")


def governance_gate(decisions: DataFrame, beliefs: DataFrame, agents: DataFrame, inheritance: DataFrame) -> DataFrame:
    """Adds refusal: why a decision may not be made now, or null. An originator needs no edge of its own."""
    live = inheritance.filter("invalidated_at is null").select("belief_id", F.col("to_agent_id").alias("agent_id"), F.lit(1).alias("live")).distinct()
    state = beliefs.select("belief_id", "originating_agent_id", F.col("status").alias("belief_status"))
    d = decisions.join(state, "belief_id", "left").join(agents.select("agent_id", F.col("status").alias("agent_status")), "agent_id", "left")
    d = d.join(live, ["belief_id", "agent_id"], "left")
    refusal = (
        F.when(F.col("belief_id").isNull(), "NO_BELIEF")
        .when(F.col("belief_status") != "active", "BELIEF_INACTIVE")
        .when(F.col("agent_status") != "alive", "DECIDER_DEAD")
        .when(F.col("live").isNull() & (F.col("agent_id") != F.col("originating_agent_id")), "NO_LIVE_EDGE")
    )
    return d.withColumn("refusal", refusal)
