"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.common import save


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node in ``links`` (a, b), long columns.

    Each round every node takes the least label among its neighbours' and its own, then its label's label, so labels
    travel twice as far each time; a round is saved before the next. Minima are pre-aggregated before the shuffle, so a
    node with very many neighbours costs one row a task.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = save(both, "links-edges")
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "links-labels")
    while True:
        heard = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("heard"))
        told = labels.join(heard, "node").select("node", F.col("component").alias("was"), F.least("component", "heard").alias("now"))
        told = save(told, "links-told")
        over = told.select(F.col("node").alias("via"), F.col("now").alias("further"))
        jumped = told.join(over, F.col("now") == F.col("via"), "left").select("node", "was", F.coalesce("further", "now").alias("component"))
        jumped = save(jumped, "links-labels")
        labels = jumped.select("node", "component")
        if jumped.filter("was <> component").isEmpty():
            return labels
