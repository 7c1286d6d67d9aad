"""A round of the community search moves nodes as the rules say, and shuffles no links."""

import re

from pyspark.sql import functions as F

from strandwise.operators import graph


def test_a_round_shuffles_no_links(spark):
    ring = [(k, (k + d) % 40, 1.0) for k in range(40) for d in (1, 39)] + [(k, k, 0.0) for k in range(40)]
    links = spark.createDataFrame(ring, "id long, nbr long, w double").withColumns({"k": F.lit(2.0), "total": F.lit(80.0), "turns": F.col("id").bitwiseAND(F.lit(1))})
    links = links.repartition(4, "id").persist()
    assert links.count() == 120
    state = spark.range(40).select("id", F.lit(2.0).alias("k"), F.col("id").alias("community"))
    out = graph._round(links, state, 0, True, 1.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    shuffled = re.findall(r"Exchange hashpartitioning\((\w+).*ENSURE_REQUIREMENTS", plan)
    assert shuffled == [], plan
    # even ones have their turn, and of two neighbours that gain alike the smaller wins
    assert {r.id: r.community for r in out.collect()} == {k: (1 if k == 0 else k - 1) if k % 2 == 0 else k for k in range(40)}
    links.unpersist()
