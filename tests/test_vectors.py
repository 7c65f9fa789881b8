"""Nearest vectors: which vectors ask, and how many neighbours the index finds."""

import random

from pyspark.sql import functions as F

from strandlog import plans
from strandlog.operators import vectors as N


def test_every_fiftieth_vector_asks_and_the_index_finds_nine_in_ten(spark, data):
    asked = {r.vec_id for r in spark.read.parquet(f"{data}/embeddings.parquet").filter("vec_id % 50 = 0").collect()}
    rows = plans.queries()["ann_vs_exact_recall"](spark, data).collect()
    assert {r.query_id for r in rows} == asked
    assert {r.query_id for r in plans.queries()["retrieve_indexed"](spark, data).collect()} == asked
    assert sum(r.recall for r in rows) / len(rows) >= 0.9 and all(r.share_met < 0.8 for r in rows)


def test_index_prunes_where_vectors_cluster(spark):
    """300 groups of 20 near vectors: a tenth of the cells finds all, and every vector is in the index."""
    rnd = random.Random(3)
    centres = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(300)]
    rows = [(20 * g + i, 0, [x + rnd.gauss(0, 0.05) for x in c]) for g, c in enumerate(centres) for i in range(20)] + [(9_000, 0, [0.0] * 16)]
    v = spark.createDataFrame(rows, "vec_id long, source int, embedding array<float>")
    asks = v.filter("vec_id % 50 = 0")
    found, exact = N.topk_indexed(asks, v, 5, probed=0.1), N.topk_cosine(asks, v, 5)
    assert N.cells_of(v)[0].count() == 6_000
    got = [r.recall for r in N.recall(found, exact).filter("query_id < 9000").collect()]
    assert sum(got) > 0.95 * len(got) and max(r.met for r in found.collect()) < 0.3 * 6_000
    assert N.topk_indexed(asks, v.limit(0), 5).count() == 0


def test_blocks_give_what_one_search_gives(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet").selectExpr("vec_id", "label as source", "embedding")
    asks = v.filter("vec_id % 10 = 0")
    order = lambda d: sorted(d.select("query_id", "vec_id", "rank", F.round("distance", 9)).collect())
    assert order(N.topk_in_blocks(asks, v, 3, most_queries=asks.count() - 1)) == order(N.topk_cosine(asks, v, 3))


def test_a_stored_index_takes_more_vectors_and_reads_the_visited_cells_alone(spark, tmp_path):
    rnd = random.Random(4)
    centres = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(60)]
    near = lambda c: [x + rnd.gauss(0, 0.05) for x in c]
    schema = "vec_id long, source int, embedding array<float>"
    first = spark.createDataFrame([(20 * g + i, 0, near(c)) for g, c in enumerate(centres) for i in range(20)], schema)
    more = spark.createDataFrame([(5_000 + g, 0, near(c)) for g, c in enumerate(centres)], schema)
    index = N.StoredIndex.build(first, str(tmp_path / "index"))
    fitted = index.centres.count()
    index.add(more)
    whole, asks = first.union(more), first.filter("vec_id % 50 = 0 and vec_id < 100")
    found = index.search(asks, 21, probed=0.1)
    got = [r.recall for r in N.recall(found, N.topk_cosine(asks, whole, 21)).collect()]
    assert sum(got) >= 0.9 * len(got) and index.centres.count() == fitted and index.entries.count() == 1_260
    assert found.filter("vec_id >= 5000").count() >= 1
    cells = index.visits(asks, 0.1).select("cell").distinct().count()
    scans = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "dynamicpruning" in line]
    assert scans and cells < 0.3 * fitted  # the plan prunes folders by the visited cells


def test_kept_results_follow_a_change_in_a_folder_below(spark, tmp_path):
    from strandlog.functions.written import kept

    table = str(tmp_path / "table")
    spark.range(4).selectExpr("id", "id % 2 as part").write.partitionBy("part").parquet(table)
    read = lambda: kept(spark, "sizes", [table], lambda: spark.read.parquet(table).groupBy().count()).first()[0]
    assert read() == 4
    spark.range(3).selectExpr("id").write.mode("append").parquet(f"{table}/part=1")
    assert read() == 7


def test_products_of_matrices_rank_as_sql_does(spark):
    """Copies tie by id, zero vectors and null ones come last, sources keep apart; each against the expression in SQL."""
    rnd = random.Random(12)
    some = [[rnd.gauss(0, 1) for _ in range(5)] for _ in range(12)]
    rows = [(i, i % 3, some[rnd.randrange(12)]) for i in range(90)] + [(90, 0, [0.0] * 5), (91, 1, [0.0] * 5), (92, 2, None)]
    v = spark.createDataFrame(rows, "vec_id long, source int, embedding array<float>").repartition(3)
    asks = v.filter("vec_id % 9 = 0")
    both = N.with_norm(asks).toDF("query_id", "qs", "qe", "qn").crossJoin(N.with_norm(v)).withColumn("distance", 1 - N.dot("qe", "embedding") / F.nullif(F.col("qn") * F.col("norm"), F.lit(0.0)))
    for same, k in ((False, 4), (True, 4), (False, 93)):
        d = both.filter("qs = source") if same else both
        d = d.withColumn("rank", F.expr("row_number() over (partition by query_id order by distance nulls last, vec_id)")).filter(F.col("rank") <= k)
        got = N.topk_cosine(asks, v, k, same).select("query_id", "vec_id", "distance", "rank")
        assert sorted(map(str, got.collect())) == sorted(map(str, d.select("query_id", "vec_id", "distance", "rank").collect()))
