"""Every query with SQL is compared with it on the smallest tables; every other one runs."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from corpuskit.plans import oracle, registry


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool | str | int):
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.6f}" if float(v) != int(float(v)) else str(int(float(v)))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return str(v)


def test_names():
    assert set(oracle.ORACLE) <= set(registry.QUERIES)


def test_imports_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries()"], cwd=root).returncode == 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name not in oracle.ORACLE:
        return
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    r = c.execute(oracle.ORACLE[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted(tuple(plain(x[df.columns.index(k)]) for k in order) for x in rows)
    theirs = sorted(tuple(plain(x[names.index(k)]) for k in order) for x in r.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", ["tfidf_topk_search", "near_dup_classes", "latest_posts", "section_forward_fill", "systematic_sample", "group_split_components", "pareto_front", "p3_found", "spearman", "emb_topk_cosine"])
def test_empty_tables(spark, data, tmp_path, name):
    for f in os.listdir(data):
        spark.read.parquet(f"{data}/{f}").limit(0).write.parquet(f"{tmp_path}/{f}")
    assert len(registry.QUERIES[name](spark, str(tmp_path)).collect()) <= 1
