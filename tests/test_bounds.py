"""Groups behind the bound are told, and the queries over whole tables cut nothing."""

from tracelake.operators import recovery
from tracelake.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_cut_groups_are_told(spark):
    shape = "image_id long, fragment_id long, parent long, channel int, partition long, region_id long, offset long, length long"
    rows = [(1, k, k // 3, None, 0, None, k * 10, 5) for k in range(9)] + [(2, 20, 7, None, 0, None, 0, 5)]
    got = recovery.group_fragments(spark.createDataFrame(rows, shape), 3, 2).collect()
    assert {(r.image_id, r.n_groups, r.groups_truncated, r.truncated) for r in got} == {(1, 3, True, False), (2, 1, False, False)} and len(got) == 7


def test_nothing_is_cut(spark):
    from tracelake.plans.q_recovery import fragments

    got = QUERIES["a09_group_fragments_whole"](spark, SF_DIR).collect()
    assert len(got) == fragments(spark, SF_DIR).count() and max(r.member for r in got) > 2 and not any(r.truncated or r.groups_truncated for r in got)
    assert QUERIES["a12_reassemble_whole"](spark, SF_DIR).where("truncated").count() == 0
    assert QUERIES["d08_run_recovery_whole"](spark, SF_DIR).where("truncated").count() == 0
    assert QUERIES["d10_basis_inventory_whole"](spark, SF_DIR).where("rank > n_all").count() == 0


def test_findings_of_a_whole_run_shuffle_once(spark):
    """Line items go to the bins of their targets as they are; they are neither dealt out nor grouped ahead of that, and told apart there."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, -1)
    try:
        found = QUERIES["d08_run_recovery_whole"](spark, SF_DIR)
        # findings, targets by bin, targets by image, candidates by image
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 4
    finally:
        spark.conf.set(name, before)
