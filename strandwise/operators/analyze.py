"""Graph analysis: degrees, hubs, surprising links, cohesion, summaries and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Labels of a .json source that are keys and no entities. Fixed values.
JSON_NOISE = ("start", "end", "name", "id", "type", "properties", "value", "key", "data", "items", "title", "description", "version", "dependencies", "devdependencies", "peerdependencies", "optionaldependencies", "bundleddependencies", "bundledependencies")
#: Relations that a file's structure makes. Fixed values.
STRUCTURAL = ("imports", "imports_from", "re_exports", "contains", "method")
#: Extensions of code. Fixed values.
CODE = (
    "py ts js jsx tsx go rs java cpp cc cxx c h hpp rb swift kt kts cs scala php lua toc zig ps1 ex exs m mm jl vue svelte astro dart v sv svh mjs ejs sql r "
    "groovy gradle luau f f90 f95 f03 f08 mts cts ets sln csproj fsproj vbproj props targets"
).split()
PAPER, IMAGE = ("pdf",), ("png", "jpg", "jpeg", "webp", "gif", "svg")


def degrees(adj: DataFrame) -> DataFrame:
    """(id, degree): distinct neighbours, of a frame of distinct pairs."""
    return adj.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def top_dir(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def file_category(path: Column) -> Column:
    ext = F.lower(F.when(F.contains(path, F.lit(".")), F.substring_index(path, ".", -1)).otherwise(""))
    return F.when(ext.isin(*CODE), "code").when(ext.isin(*PAPER), "paper").when(ext.isin(*IMAGE), "image").otherwise("doc")


def code_language(path: Column) -> Column:
    ext = F.lower(F.substring_index(basename(path), ".", -1))
    return F.when(file_category(path) != "code", None).when(ext.isin("cjs", "js", "jsx", "mjs"), "javascript").when(ext.isin("cts", "mts", "ts", "tsx"), "typescript").when(ext.isin("py", "pyw"), "python").otherwise(ext)


def is_file_node(degree: Column) -> Column:
    label, source = F.coalesce("label", F.lit("")), F.coalesce("source_file", F.lit(""))
    call = label.endswith("()")
    return (label != "") & (((source != "") & (label == basename(source))) | (label.startswith(".") & call) | (call & (degree <= 1)))


def is_concept_node() -> Column:
    source = F.coalesce("source_file", F.lit(""))
    return (source == "") | ~F.contains(basename(source), F.lit("."))


def is_json_key_node() -> Column:
    return F.lower(F.coalesce("source_file", F.lit(""))).endswith(".json") & F.lower(F.trim(F.coalesce("label", F.lit("")))).isin(*JSON_NOISE)


def god_nodes(nodes: DataFrame, adj: DataFrame, n: int = 10) -> DataFrame:
    """The n nodes with most neighbours that are no files, concepts or JSON keys; ids in order break ties."""
    joined = nodes.join(degrees(adj), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    real = joined.where(~is_file_node(F.col("degree")) & ~is_concept_node() & ~is_json_key_node())
    return real.orderBy(F.desc("degree"), "id").limit(n).select("id", "label", "degree")


def surprises(nodes: DataFrame, edges: DataFrame, adj: DataFrame, membership: DataFrame | None = None, n: int = 5) -> DataFrame:
    """The n highest scored links between files: (src, tgt, relation, confidence, score).

    Confidence gives 3, 2 or 1, different file types 2, different top folders
    2, different communities 1, a hub met by a peripheral node 1; a semantic
    similarity counts half as much again. Inferred calls between languages get
    no structural points. Keys break ties.
    """
    deg = degrees(adj)
    side = nodes.join(deg, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    if membership is not None:
        side = side.join(membership, "id", "left")
    else:
        side = side.withColumn("community", F.lit(None).cast("long"))
    side = side.where(~is_file_node(F.col("degree")) & ~is_concept_node()).select("id", "source_file", "degree", "community")
    named = lambda p: side.select(*[F.col(c).alias(f"{p}_{c}") for c in side.columns])
    e = edges.where(~F.col("relation").isin(*STRUCTURAL)).select("src", "tgt", "relation", "confidence")
    j = e.join(named("u"), F.col("src") == F.col("u_id")).join(named("v"), F.col("tgt") == F.col("v_id")).where("u_source_file != v_source_file")
    u, v = F.col("u_source_file"), F.col("v_source_file")
    hidden = (F.col("confidence") == "INFERRED") & F.lower("relation").isin("calls", "uses") & F.coalesce(code_language(u) != code_language(v), F.lit(False))
    points = F.when(hidden, 0).otherwise(F.when(F.col("confidence") == "AMBIGUOUS", 3).when(F.col("confidence") == "INFERRED", 2).otherwise(1))
    points += F.when(file_category(u) != file_category(v), 2).otherwise(0)
    points += F.when((top_dir(u) != top_dir(v)) & ~hidden, 2).otherwise(0)
    points += F.when(F.coalesce(F.col("u_community") != F.col("v_community"), F.lit(False)) & ~hidden, 1).otherwise(0)
    points = F.when(F.col("relation") == "semantically_similar_to", F.floor(points * 1.5)).otherwise(points)
    hub = (F.least("u_degree", "v_degree") <= 2) & (F.greatest("u_degree", "v_degree") >= 5)
    scored = j.withColumn("score", (points + F.when(hub, 1).otherwise(0)).cast("long"))
    return scored.orderBy(F.desc("score"), "src", "tgt", "relation").limit(n).select("src", "tgt", "relation", "confidence", "score")


def cross_community(edges: DataFrame, membership: DataFrame, n: int = 5) -> DataFrame:
    """The best link of each pair of communities: ambiguous before inferred before extracted, then by key."""
    m = lambda p: membership.select(F.col("id").alias(p), F.col("community").alias(f"c_{p}"))
    pairs = edges.join(m("src"), "src").join(m("tgt"), "tgt").where("c_src != c_tgt")
    rank = F.when(F.col("confidence") == "AMBIGUOUS", 0).when(F.col("confidence") == "INFERRED", 1).otherwise(2)
    key = F.struct(rank.alias("rank"), "src", "tgt", "relation", "confidence")
    best = pairs.groupBy(F.least("c_src", "c_tgt").alias("low"), F.greatest("c_src", "c_tgt").alias("high")).agg(F.min(key).alias("k"))
    return best.select("low", "high", "k.src", "k.tgt", "k.relation", "k.confidence", "k.rank").orderBy("rank", "src", "tgt", "relation").limit(n).drop("rank")


def cohesion(adj: DataFrame, membership: DataFrame) -> DataFrame:
    """(community, size, cohesion): linked pairs inside over possible pairs; one member gives 1."""
    m = lambda p: membership.select(F.col("id").alias(p), F.col("community").alias(f"c_{p}"))
    inside = adj.where("id < nbr").join(m("id"), "id").join(m("nbr"), "nbr").where("c_id = c_nbr").groupBy(F.col("c_id").alias("community")).agg(F.count(F.lit(1)).alias("pairs"))
    size = membership.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    ratio = F.coalesce("pairs", F.lit(0)) / (F.col("size") * (F.col("size") - 1) / 2)
    return size.join(inside, "community", "left").select("community", "size", F.round(F.when(F.col("size") <= 1, 1.0).otherwise(ratio), 6).alias("cohesion"))


def confidence_audit(edges: DataFrame) -> DataFrame:
    """(confidence, n, percent): shares rounded half up."""
    total = edges.agg(F.count(F.lit(1)).alias("total"))
    return edges.groupBy("confidence").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("confidence", "n", F.floor(100 * F.col("n") / F.col("total") + 0.5).cast("long").alias("percent"))


def summary(nodes: DataFrame, edges: DataFrame, adj: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean degree and the top hub."""
    deg = degrees(adj)
    return (
        nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
        .crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges")))
        .crossJoin(deg.agg(F.sum("degree").alias("ends"), F.min(F.struct((-F.col("degree")).alias("d"), "id"))["id"].alias("top_hub")))
        .select(
            "n_nodes",
            "n_edges",
            F.round(F.col("ends") / (F.col("n_nodes") * (F.col("n_nodes") - 1.0)), 8).alias("density"),
            F.round(F.col("ends") / F.col("n_nodes"), 4).alias("mean_degree"),
            "top_hub",
        )
    )


def facets(records: DataFrame, fields: list[str], max_values: int = 40, min_coverage: float = 0.05) -> DataFrame:
    """(field, value, n) of string fields that enough rows have and that have few values."""
    long = records.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])))
    counted = long.where("value is not null and value != ''").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    total = records.agg(F.count(F.lit(1)).alias("total"))
    ok = counted.groupBy("field").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("covered")).crossJoin(F.broadcast(total))
    ok = ok.where((F.col("k") > 1) & (F.col("k") <= max_values) & (F.col("covered") >= min_coverage * F.col("total"))).select("field")
    return counted.join(F.broadcast(ok), "field")  # one row for each field named


def first_by_type(records: DataFrame, kind: str, order: list, n: int) -> DataFrame:
    """The first n records of each type, with the number of those not shown."""
    by = W.partitionBy(kind)
    ranked = records.withColumn("rank", F.row_number().over(by.orderBy(*order))).join(records.groupBy(kind).agg(F.count(F.lit(1)).alias("total")), kind)
    return ranked.where(F.col("rank") <= n).withColumn("hidden", F.greatest(F.col("total") - n, F.lit(0)))


def degree_window(nodes: DataFrame, edges: DataFrame, adj: DataFrame, n: int = 2000) -> tuple[DataFrame, DataFrame]:
    """The n nodes with most neighbours and the edges among them."""
    top = nodes.join(degrees(adj), "id", "left").orderBy(F.coalesce("degree", F.lit(0)).desc(), "id").limit(n)
    ids = top.select("id")
    return top, edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["tgt"] == ids["id"], "left_semi")
