"""What a task holds doesn't grow with its table."""

import pytest
from strandwise.operators import build

@pytest.fixture
def shuffled(spark):
    """Records that all stages so far wrote to shuffles."""
    context = spark.sparkContext

    def records():
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    return records


def test_diff_shuffles_a_key_once_for_both_sides(spark, shuffled):
    old, new = (spark.range(a, a + 20_000, 1, 1).selectExpr("id as k", "if(id % 5 = 0, null, id) as v") for a in (0, 10_000))
    before = shuffled()
    found = build.diff(old, new, ["k", "v"]).groupBy("change").count().collect()
    assert {tuple(r) for r in found} == {("added", 10_000), ("removed", 10_000)}  # before, equal rows with a null were both
    assert shuffled() - before < 60_000
