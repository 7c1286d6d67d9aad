"""The lines that the diff query parses are in one order."""

from pyspark.sql import functions as F
from strandwise.functions import text as tx
from strandwise.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_diff_lines_have_no_ties(spark, monkeypatch):
    given = []
    monkeypatch.setattr(tx, "parse_diff", lambda lines: given.append(lines) or lines)
    catalogue.QUERIES["j18_diff_hunks"](spark, SF)
    assert given[0].groupBy("doc", "no").count().where("count > 1").isEmpty()  # part 0 had its file's line number
    assert given[0].groupBy("doc").agg(F.min_by("line", "no").alias("first")).where("not startswith(first, '+++ ')").isEmpty()
