"""Tables in the shared folder."""

import os

import pytest

from tessera.operators.scratch import broadcast_if_small, saved, settled, shared_dir


def folders(spark):
    return set(os.listdir(shared_dir(spark))) if os.path.isdir(shared_dir(spark)) else set()


def test_tables_on_the_way_go_when_the_result_is_written(spark):
    before = folders(spark)
    kept = saved(spark.range(3))

    def make():
        first = saved(kept.selectExpr("id + 1 AS id"))
        second = settled(spark, lambda: saved(first.selectExpr("id * 2 AS id")))
        return second.join(first, "id")

    out = settled(spark, make)
    assert sorted(r["id"] for r in out.collect()) == [2] and kept.count() == 3
    assert len(folders(spark) - before) == 2


def test_a_failing_step_leaves_the_list_as_it_was(spark):
    with pytest.raises(ZeroDivisionError):
        settled(spark, lambda: 1 / 0)
    before = folders(spark)
    saved(spark.range(1))
    assert len(folders(spark) - before) == 1


def test_a_cluster_has_to_name_the_folder(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_only_counted_rows_are_broadcast(spark):
    big, small = spark.range(50), spark.range(5)
    plan = lambda most: big.join(broadcast_if_small(small, most), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(5) and "SortMergeJoin" in plan(4)
