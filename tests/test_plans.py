"""What Catalyst makes of the queries: pushed filters, pruned columns, no cross products of rows."""

import pytest

from echofold.operators.shared import clean, cut, shared_dir
from echofold.plans import queries as q
from tests.compare import SF, needs_tables


def plan(df):
    return df._jdf.queryExecution().toString()


@needs_tables
def test_scan_is_pruned_and_filtered(spark):
    p = plan(q.scan_min_size(spark, SF))
    assert "PushedFilters: [" in p and "GreaterThanOrEqual(size,102400)" in p
    assert "ReadSchema: struct<path:string,size:bigint,scan_ord:bigint>" in p


@needs_tables
@pytest.mark.parametrize("name", ["shared_terms", "candidate_pairs", "edges", "keep_best", "apply_plan", "cache_upsert", "identity_score"])
def test_no_cross_product(spark, name):
    p = plan(q.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@needs_tables
def test_fingerprints_stay_out_of_the_candidate_join(spark):
    """The posting join carries keys and terms; the wide column is joined to the candidates only."""
    p = plan(q.document_frequency(spark, SF))
    assert "hashpartitioning(term" in p


def test_cut_is_read_back_and_cleaned(spark, tmp_path):
    df = cut(spark.range(10).selectExpr("id", "array(id) AS a"))
    assert df.count() == 10 and shared_dir(spark).removeprefix("file:") in df.inputFiles()[0]
    clean(spark)
    assert not spark.sparkContext._jvm.java.io.File(shared_dir(spark).removeprefix("file:")).exists()
