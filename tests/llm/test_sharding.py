import zlib

from strandwise.llm.sharding import shard_records

SCHEMA = "doc_id long, text string, shard string, bucket int"


def test_laws(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = shard_records(docs).collect()
    assert len(out) == docs.count()
    for s in range(8):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    moved = [r for r in out if r.grown_shard != r.shard]
    assert all(r.grown_shard == 8 for r in moved) and 0 < len(moved) < len(out) / 4
    again = {r.doc_id: r.shard for r in shard_records(docs.where("doc_id % 3 = 0")).collect()}
    assert all(again[r.doc_id] == r.shard for r in out if r.doc_id in again)


def test_weights(spark):
    docs = spark.range(8000).selectExpr("id as doc_id", "'x' as text")
    got = {r["shard"]: r["count"] for r in shard_records(docs, weights=(3.0, 1.0, 0.0), grown_weights=(3.0, 1.0, 0.0, 1.0)).groupBy("shard").count().collect()}
    assert set(got) == {0, 1} and 5700 < got[0] < 6300


def test_edges(spark):
    data = [(None, None, "a", 1), (1, "", "b", 2), (1, "", "b", 2), (2, "é" * 9, None, None)]
    out = shard_records(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(out) == 4 and len({(r.shard, r.slot) for r in out}) == 4
    assert {(r.doc_id, r.size, r.text_crc32) for r in out} == {(None, 1, 0), (1, 1, 0), (2, 19, zlib.crc32(("é" * 9).encode()))}
    assert shard_records(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_key_with_a_third_of_all_rows_is_numbered_in_many_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from strandwise.llm import sharding

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seen = []
    real = sharding.ranked
    monkeypatch.setattr(sharding, "ranked", lambda df, *order, **names: seen.append(df.orderBy(*order).groupBy(F.spark_partition_id().alias("p")).count()) or real(df, *order, **names))
    docs = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("x")).otherwise(F.col("id").cast("string")).alias("text"))
    out = shard_records(docs).collect()
    parts = sorted(r["count"] for r in seen[0].collect())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 4 and parts[-1] <= 2 * parts[len(parts) // 2]
    for s in range(8):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in out if r.doc_id == 7}) == 1
