"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from orograph.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = ["p1_bounds", "p6_tile_list", "p20_project", "n1_n2_slope", "n4_relief", "g5_components", "f7_hotspots", "j1_distance_join", "g11_viewshed", "st4_fold_parts", "a22_render_score", "a19_cosine", "a20_composition", "j11_call_matching", "j11_call_state", "st5_tool_calls", "st5_tool_calls_state", "snk10_session_store", "st_session_windows", "p6_sql_text", "n15_point_elevation", "api14_problems"]


def plain(value):
    if isinstance(value, float):
        return repr(0.0 if value == 0 else value)
    return f"[{','.join(map(plain, value))}]" if isinstance(value, (list, tuple)) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "customer supplier orders events documents embeddings pages conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    answer = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.collect()) == theirs


def test_most_queries_have_sql():
    assert len(QUERIES) >= 80 and len(ORACLE_SQL) >= 0.85 * len(QUERIES)
