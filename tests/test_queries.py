import pytest

from rowgrove.operators.oracles import ORACLES
from rowgrove.operators.queries import QUERIES

from .oracle import TABLES, connect, same

#: Tables that the queries read; in key order, so that files follow each other in order.
SORTED = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module", params=[2, 7])
def many_files(request, sf_dir, tmp_path_factory):
    """A copy of the tables in which each is a folder of several files of unlike sizes."""
    import os

    import pyarrow.parquet as pq

    to = tmp_path_factory.mktemp(f"files{request.param}")
    for t in TABLES:
        if t not in SORTED:
            os.symlink(f"{sf_dir}/{t}.parquet", to / f"{t}.parquet")
            continue
        whole = pq.read_table(f"{sf_dir}/{t}.parquet").sort_by(SORTED[t])
        (to / f"{t}.parquet").mkdir()
        cuts = [round(whole.num_rows * (i / request.param) ** 1.5) for i in range(request.param + 1)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            pq.write_table(whole.slice(a, b - a), to / f"{t}.parquet" / f"part-{i:05d}.parquet", row_group_size=1111)
    return str(to)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, sf_dir, con):
    same(QUERIES[name](spark, sf_dir), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql_over_many_files(name, spark, many_files, con):
    same(QUERIES[name](spark, many_files), con, ORACLES[name])


def test_plans_read_only_what_they_need(spark, sf_dir):
    plan = QUERIES["read_chunk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" in plan and "o_custkey" not in plan and "Exchange" not in plan


def test_many_files_are_numbered_without_sorting_rows(spark, many_files):
    plan = QUERIES["read_chunk"](spark, many_files)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" in plan and "o_custkey" not in plan and "BroadcastHashJoin" in plan


def test_entry_points_import():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


