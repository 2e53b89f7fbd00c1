"""Plans and operators: pushdown, pruning, no needless shuffle or Python, and properties against plain Python."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernlake.functions.types import duration_micros, interval_seconds, kind_of, literal
from quernlake.operators import dml, relational, temporal
from quernlake.plans.lexer import SyntaxProblem, statements
from quernlake.queries import QUERIES
from quernlake.sources import files

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(QUERIES["filter_pushdown"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in p and "EqualTo(o_orderstatus,F)" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in p
    assert "Exchange" not in p


def test_no_python_in_plans(spark):
    for name in ("candles", "first_last_ordered", "fn_collate", "merge_state", "as_of_txn", "range_join"):
        assert "Python" not in plan(QUERIES[name](spark, SF)), name


def test_as_of_shuffles_once(spark):
    assert plan(QUERIES["as_of_txn"](spark, SF)).count("Exchange hashpartitioning") == 1


def test_range_join_is_an_equi_join(spark):
    p = plan(QUERIES["range_join"](spark, SF))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_range_join_matches_all_pairs(spark):
    r = random.Random(1)
    points = [(i, r.uniform(-50, 50)) for i in range(80)]
    spans = [(i, a := r.uniform(-60, 50), a + r.choice([0, 1, 7, 40])) for i in range(30)]
    p, s = spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(spans, "s int, a double, b double")
    got = sorted((q["p"], q["s"]) for q in relational.range_join(p, s, "x", "a", "b", 5.0).collect())
    assert got == sorted((i, j) for i, x in points for j, a, b in spans if a <= x < b)
    left = relational.range_join(p, s, "x", "a", "b", 5.0, "left").where("s is null").count()
    assert left == sum(not any(a <= x < b for _, a, b in spans) for _, x in points)


def test_merge_against_python(spark):
    r = random.Random(2)
    t = {k: r.randrange(100) for k in r.sample(range(60), 30)}
    s = {k: r.randrange(100) for k in r.sample(range(60), 30)}
    td, sd = spark.createDataFrame(list(t.items()), "k int, v int"), spark.createDataFrame(list(s.items()), "k int, v int")
    got = {x["k"]: x["v"] for x in dml.merge(td, sd, ["k"], {"v": F.col("t.v") + F.col("s.v")}, delete=F.col("s.v") < 20, insert=F.col("s.v") > 50).collect()}
    want = {k: v + s[k] if k in s else v for k, v in t.items() if not (k in s and s[k] < 20)} | {k: v for k, v in s.items() if k not in t and v > 50}
    assert got == want


def test_newest_against_python(spark):
    r = random.Random(3)
    h = [(r.randrange(8), n, r.random() < 0.3, r.randrange(9)) for n in range(60)]
    df = spark.createDataFrame(h, "_row_id int, _txn_id int, _deleted boolean, v int")
    for upto in (5, 30, 60):
        last = {}
        for k, n, gone, v in h:
            if n <= upto:
                last[k] = (gone, v)
        got = sorted((x["_row_id"], x["v"]) for x in temporal.as_of_transaction(df, upto).collect())
        assert got == sorted((k, v) for k, (gone, v) in last.items() if not gone)


@settings(max_examples=60, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 90), st.sampled_from(["second", "minute", "hour", "day", "week", "month", "year"]))
def test_intervals(n, unit):
    size = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 30 * 86400, "year": 365 * 86400}[unit]
    assert interval_seconds(f"{n} {unit}s") == interval_seconds(f"{n} {unit}") == n * size


@settings(max_examples=60)
@given(st.integers(0, 40), st.integers(1, 50), st.integers(0, 900))
def test_durations(h, m, ms):
    text = (f"{h}h" if h else "") + f"{m}m" + (f"{ms}ms" if ms else "")
    assert duration_micros(text) == (h * 3600 + m * 60) * 1_000_000 + ms * 1000


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=20))
def test_text_literals(spark, text):
    assert spark.sql(f"SELECT {literal(text)} AS x").first()[0] == text


def test_lexer():
    assert len(statements("SELECT 1; -- c;\nSELECT ';' # d\n; /* x; */")) == 2
    with pytest.raises(SyntaxProblem):
        statements("SELECT \x01")
    with pytest.raises(ValueError):
        kind_of("BLOB")
    with pytest.raises(ValueError):
        duration_micros("5 parsecs")


def test_files_round_trip(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id % 3 AS g", "cast(id AS string) AS s")
    for fmt in ("parquet", "orc", "csv", "json"):
        files.write(df, f"{tmp_path}/{fmt}", fmt, cluster_by=["g"])
        back = files.read(spark, f"{tmp_path}/{fmt}", fmt, None if fmt in files.SELF_DESCRIBING else df.schema)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        files.read(spark, f"{tmp_path}/csv", "csv")
