"""Surface forms of labels: what is left without titles and parentheses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.operators import graph

#: Words that may lead a name without being part of it.
HONORIFICS = (
    "dr sir colonel col inspector mr mrs ms miss lord lady captain capt professor prof doctor madame madam monsieur the"
).split()
_LED = rf"(?:(?i:{'|'.join(HONORIFICS)})\.?\s+)"


def without_parentheses(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(label, r"\s*\([^)]*\)\s*", " "), r"\s+", " "))


def _unled(label: Column) -> Column:
    """The label without none, one, two ... of the honorifics that lead it; something always stays."""
    led = F.regexp_extract(label, rf"^{_LED}*(?=\S)", 0)
    count = F.regexp_count(led, F.lit(_LED))
    strip = lambda k: F.regexp_replace(label, F.concat(F.lit(f"^{_LED}{{"), k.cast("string"), F.lit("}")), F.lit(""))
    return F.transform(F.sequence(F.lit(0), count), strip)


def surface_forms(label: Column) -> Column:
    """All that a label becomes by leaving out leading honorifics, one after the other, and parentheses, in any order; itself first, no blank ones. Null and blank have none."""
    base = F.trim(F.coalesce(label, F.lit("")))
    either = F.flatten(F.transform(_unled(base), lambda x: F.array(x, without_parentheses(x))))
    return F.array_distinct(F.filter(F.flatten(F.transform(either, _unled)), lambda x: x != ""))


def label_terms(label: Column) -> Column:
    """The surface forms in lower case, white space as one blank, sorted."""
    return F.array_sort(F.array_distinct(F.transform(surface_forms(label), lambda x: F.lower(F.regexp_replace(F.trim(x), r"\s+", " ")))))


def alias_classes(labels: DataFrame) -> DataFrame:
    """(id, entity) of labels (id, label), several rows for an id allowed: the smallest id that shared terms lead to, over any number of steps.

    Ids and terms are nodes of one graph, so a term that a third of all labels
    have is a star, never pairs. An id without a term is an entity of its own.
    """
    names = labels.select("id", F.explode(label_terms(F.col("label"))).alias("term")).distinct()
    # every class has an id, and those sort before terms
    found = graph.components(names.select(F.concat(F.lit("i:"), "id").alias("id"), F.concat(F.lit("t:"), "term").alias("nbr")))
    classes = found.where("id like 'i:%'").select(F.substr("id", F.lit(3)).alias("id"), F.substr("component", F.lit(3)).alias("entity"))
    return labels.select("id").distinct().join(classes, "id", "left").select("id", F.coalesce("entity", "id").alias("entity"))
