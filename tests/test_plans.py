"""Shapes of physical plans that matter at scale."""

import pytest

from __spark_entry__ import queries
from inodeatlas.session import cut_lineage

SF = "/root/testdata/sf0.001"
LAZY = [
    "quantiles_dd", "quantiles_exact", "summary_stats", "rank_values", "rank_errors", "key_counts", "rollup_shrink_counts",
    "quantiles_kll_bounds", "quantiles_td_bounds", "reduce_fid_events", "inventory_nine_columns", "primary_documents",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_products_and_pruned_scans(spark, name):
    text = plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    # no scan reads the columns that no file needs
    assert "l_tax" not in text and "c_acctbal" not in text and "o_orderpriority" not in text
    # row-at-a-time Python nowhere; Arrow only in the two sketches without a built-in
    assert "BatchEvalPython" not in text
    if name != "quantiles_td_bounds":
        assert "MapInArrow" not in text


def test_documents_need_no_shuffle_of_their_own(spark):
    from inodeatlas.operators.primary import primary_documents
    from inodeatlas.sources import inventory

    lines = spark.read.text("/root/repo/README.md")
    good, _ = inventory.parse_inventory(lines)
    assert "Exchange" not in plan(primary_documents(good))


def test_summaries_combine_before_the_shuffle(spark):
    from inodeatlas.operators.aggregate import key_partials
    from inodeatlas.schemas import INVENTORY

    text = plan(key_partials(spark.createDataFrame([], INVENTORY)))
    # users, groups and deepest directories first, then the levels above: two shuffles
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("HashAggregate") == 4


def test_checkpoints_go_to_the_configured_folder(spark):
    cut = cut_lineage(spark.range(3))
    assert "Scan ExistingRDD" in plan(cut)
    assert spark.sparkContext.getCheckpointDir()


def test_line_items_meet_the_joined_tables_once(spark):
    from inodeatlas.plans.tables import files

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        text = plan(files(spark, SF).select("uid", "size", "path"))
    finally:
        spark.conf.set(key, before)
    joins = [line for line in text.splitlines() if "SortMergeJoin" in line]
    assert len(joins) == 4 and "l_orderkey" in joins[0]
