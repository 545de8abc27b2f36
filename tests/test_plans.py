"""Shapes of the physical plans that matter at scale."""

import pytest

from catalogloom.driver.registry import ALL

SF = "/root/testdata/sf0.001"

#: Queries whose work is done in Arrow or pandas batches: provider calls, pixels, rolling names of terms.
PYTHON = {"complete_batch", "binarize_images", "process_assets", "generate_images", "clean_image_rows", "scan_term_table"}

#: Collections with a bound that does not depend on the texts, and what bounds them.
BOUNDED = {
    "tree_digest": "runs of neighbours, 16 hashes each",
    "scan_term_table": "the different numbers of pieces among the terms",
}


def plan(spark, name):
    return ALL[name].run(spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(ALL))
def test_native_and_no_cartesian(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert ("Pandas" in text or "PythonUDF" in text or "MapInArrow" in text) == (name in PYTHON)


@pytest.mark.parametrize("name", ["expand_deliverables", "explode_pages", "check_listings", "fit_crop_box", "asset_paths"])
def test_narrow_operators_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize("name", ["node_hash", "files_digest", "bundle_manifest", "node_timestamps", "cost_summary"])
def test_groups_reduce_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert "partial_" in text and "collect_list" not in text


def test_columns_are_pruned(spark):
    text = plan(spark, "cost_summary")
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in text


@pytest.mark.parametrize("name", sorted(set(ALL) - set(BOUNDED)))
def test_no_unbounded_collection(spark, name):
    text = plan(spark, name)
    assert "collect_list" not in text and "collect_set" not in text
