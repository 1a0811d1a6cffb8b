"""Every registered query against DuckDB on the smallest tables."""

import duckdb
import pytest

from corvane.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i] for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    values = [tuple(r) for r in got.collect()]
    if name in catalog.SQL:
        done = duck.execute(catalog.SQL[name])
        names = [d[0] for d in done.description]
        assert sorted(got.columns) == sorted(names)
        assert rows(got.columns, values) == rows(names, done.fetchall())
    else:
        assert values


def test_sql_queries_run_no_python(spark):
    """Queries that SQL can express stay in the JVM, but for parsers, footers, folds and states that can't."""
    python = {"ast_imports", "json_flatten_containers", "json_unflatten", "mime_body", "tool_scatter_gather_mock", "pack_pad", "pack_truncate", "collate_positions", "stream_temporal", "stream_dedup", "topo_levels", "footer_counts", "wide_runs", "stream_streaks", "bm25_topk", "context_reassembly", "embedding_lookup", "reply_elements", "stream_closed_sessions", "shard_scan", "cosine_topk", "tool_server_calls"}
    for name in set(catalog.SQL) - python:
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "ArrowEval" not in plan and "MapIn" not in plan, name
