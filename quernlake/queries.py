"""Registered queries over the benchmark tables, each with its twin in DuckDB's SQL.

Most are texts of the dialect, run by the engine; where the twin's text is the same, it is not written twice. Sums of
money are sums of decimals, so that they don't depend on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernlake.functions import aggregates, scalar
from quernlake.operators import dml, relational, temporal
from quernlake.plans.engine import Engine
from quernlake.sources import files
from quernlake.sources.versioned import ConstraintError

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return files.read(spark, f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str, text: str) -> Engine:
    """An engine that knows the tables that a text names."""
    e = Engine(spark)
    for name in TABLES:
        if name in text:
            e.register(name, table(spark, sf_dir, name))
    return e


#: Texts that mean the same in the dialect and in DuckDB.
SAME: dict[str, str] = {
    # scans, projections, filters
    "scan_all": "SELECT * FROM region",
    "project_columns": "SELECT o_orderkey, o_custkey FROM orders",
    "project_expression": "SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS q, l_quantity - l_tax AS r FROM lineitem",
    "filter_pushdown": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
    "pk_lookup": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 17",
    "pk_range": "SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200",
    "pk_contradiction": "SELECT o_orderkey FROM orders WHERE o_orderkey > 5 AND o_orderkey < 3",
    "constant_where": "SELECT r_name FROM region WHERE 1 = 1",
    "range_merge": "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 50000",
    "multi_column_filter": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_shipdate >= TIMESTAMP '1995-01-01 00:00:00'",
    "or_and_precedence": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O' AND o_totalprice > 200000",
    "between_in_like": "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 15 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND p_type LIKE '%A%'",
    "not_in_list": "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 2, 3) AND NOT (p_name LIKE 'a_%')",
    "null_logic": "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s, NULLIF(o_orderstatus, 'F') = 'O' AS is_o, NULLIF(o_orderstatus, 'F') IS NULL AS is_null FROM orders WHERE NOT (NULLIF(o_orderstatus, 'F') = 'P') OR NULLIF(o_orderstatus, 'F') IS NULL",
    "is_not_null": "SELECT COUNT(*) AS n FROM orders WHERE NULLIF(o_orderpriority, '5-LOW') IS NOT NULL",
    "case_searched": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' END AS size_class FROM part",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders",
    "count_star": "SELECT COUNT(*) AS n FROM lineitem",
    "one_row": "SELECT 1 + 2 AS three, 'a' || 'b' AS ab",
    # joins
    "join_inner": "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000",
    "join_right": "SELECT s.s_suppkey, n.n_nationkey FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey",
    "join_full": "SELECT a.c_custkey AS a, b.s_suppkey AS b FROM customer a FULL OUTER JOIN supplier b ON a.c_custkey = b.s_suppkey + 100",
    "join_cross": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "join_comma": "SELECT r.r_name, n.n_name FROM region r, nation n WHERE r.r_regionkey = n.n_regionkey",
    "join_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_self": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey",
    "join_using": "SELECT x.k, x.a, y.b FROM (SELECT o_orderkey AS k, o_custkey AS a FROM orders) x JOIN (SELECT l_orderkey AS k, l_quantity AS b FROM lineitem) y USING (k)",
    "join_multiway": "SELECT r.r_name, COUNT(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
    "join_null_keys": "SELECT a.o_orderkey AS a, b.n_nationkey AS b FROM (SELECT o_orderkey, NULLIF(o_custkey, 1) AS k FROM orders WHERE o_orderkey < 500) a LEFT JOIN (SELECT n_nationkey, NULLIF(n_nationkey, 2) AS k FROM nation) b ON a.k = b.k",
    # subqueries and CTEs
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * AVG(c_acctbal) + 100000 FROM customer)",
    "scalar_subquery_select": "SELECT r_name, (SELECT COUNT(*) FROM nation) AS nations FROM region",
    "in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "not_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "not_in_null": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT NULLIF(o_custkey, 1) FROM orders)",
    "exists_subquery": "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100000)",
    "not_exists_correlated": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "correlated_subquery": "SELECT p.p_partkey FROM part p WHERE p.p_retailprice > (SELECT AVG(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)",
    "nested_subquery": "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%'))",
    "derived_table": "SELECT t.s, COUNT(*) AS n FROM (SELECT o_orderstatus AS s FROM orders WHERE o_totalprice > 50000) t GROUP BY t.s",
    "cte_single": "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000) SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey",
    "cte_multi": "WITH a AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT MAX(n) AS m FROM a) SELECT a.k, a.n FROM a JOIN b ON a.n = b.m",
    "cte_columns": "WITH t (k, s) AS (SELECT c_custkey, c_mktsegment FROM customer) SELECT s, COUNT(k) AS n FROM t GROUP BY s",
    "cte_in_subquery": "WITH rich AS (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) SELECT COUNT(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM rich)",
    "cte_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t",
    # aggregates
    "agg_all": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS total, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, ROUND(AVG(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_global": "SELECT COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total, MIN(o_orderdate) AS first_day, MAX(o_orderdate) AS last_day FROM orders",
    "agg_empty": "SELECT COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders WHERE o_orderkey < 0",
    "agg_distinct": "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS lines, AVG(DISTINCT l_linenumber) AS mean FROM lineitem GROUP BY l_returnflag",
    "agg_nulls": "SELECT o_orderpriority, COUNT(NULLIF(o_orderstatus, 'F')) AS n, MAX(NULLIF(o_orderstatus, 'P')) AS top FROM orders GROUP BY o_orderpriority",
    "group_null_key": "SELECT NULLIF(o_orderstatus, 'F') AS s, COUNT(*) AS n FROM orders GROUP BY NULLIF(o_orderstatus, 'F')",
    "group_alias": "SELECT p_size % 5 AS bucket, COUNT(*) AS n FROM part GROUP BY bucket",
    "group_expr": "SELECT p_size % 7 AS bucket, MAX(p_retailprice) AS top FROM part GROUP BY p_size % 7",
    "having_alias": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12",
    "having_aggregate": "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10 AND MAX(o_totalprice) > 100000",
    "agg_expression": "SELECT l_shipmode, n FROM (SELECT l_returnflag AS l_shipmode, CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS n FROM lineitem GROUP BY l_returnflag) t",
    "agg_join": "SELECT n.n_name, COUNT(*) AS n, CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "rollup": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    # windows
    "window_frame": "SELECT o_orderkey, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS top3 FROM orders",
    # order, limit, distinct, sets
    "order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 5",
    "distinct_rows": "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer",
    "distinct_join": "SELECT DISTINCT n.n_regionkey, c.c_mktsegment FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier",
    # functions with one meaning in both
    "fn_upper_lower": "SELECT n_nationkey, UPPER(n_name) AS u, LOWER(n_name) AS l FROM nation",
    "fn_concat_null": "SELECT p_partkey, CONCAT(p_brand, NULLIF(p_type, p_type), '-', p_size) AS c FROM part",
    "fn_concat_operator": "SELECT p_partkey, p_brand || ':' || p_type AS c FROM part",
    "flagship_brands": "SELECT p.p_brand, COUNT(*) AS n, CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_quantity < 10 GROUP BY p.p_brand",
}

#: (dialect, DuckDB) where the texts differ.
PAIRS: dict[str, tuple[str, str]] = {
    "row_number": (
        "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders",
        "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS rn FROM orders",
    ),
    "rank_lag": (
        "SELECT o_orderkey, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS d, LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders",
        "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS r, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS d, LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders",
    ),
    "alias_in_where": (
        "SELECT o_orderkey, o_totalprice / 1000 AS thousands FROM orders WHERE thousands > 200",
        "SELECT o_orderkey, o_totalprice / 1000 AS thousands FROM orders WHERE o_totalprice / 1000 > 200",
    ),
    "order_nulls": (
        "SELECT k, s FROM (SELECT o_orderkey AS k, NULLIF(o_orderstatus, 'F') AS s FROM orders) t ORDER BY s DESC, k LIMIT 40",
        "SELECT k, s FROM (SELECT o_orderkey AS k, NULLIF(o_orderstatus, 'F') AS s FROM orders) t ORDER BY s DESC NULLS FIRST, k LIMIT 40",
    ),
    "order_nulls_asc": (
        "SELECT k, s FROM (SELECT o_orderkey AS k, NULLIF(o_orderstatus, 'O') AS s FROM orders) t ORDER BY s, k DESC LIMIT 40",
        "SELECT k, s FROM (SELECT o_orderkey AS k, NULLIF(o_orderstatus, 'O') AS s FROM orders) t ORDER BY s NULLS LAST, k DESC LIMIT 40",
    ),
    "fn_math": (
        "SELECT c_custkey, ABS(c_acctbal) AS a, CEILING(c_acctbal) AS c, CEIL(c_acctbal) AS c2, FLOOR(c_acctbal) AS f, ROUND(c_acctbal) AS r, ROUND(c_acctbal, 1) AS r1 FROM customer",
        "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, ceil(c_acctbal) AS c2, floor(c_acctbal) AS f, round(c_acctbal) AS r, CAST(CAST(CAST(c_acctbal AS VARCHAR) AS DECIMAL(18, 1)) AS DOUBLE) AS r1 FROM customer",
    ),
    "fn_integers": (
        "SELECT p_partkey, ABS(p_size - 25) AS a, FLOOR(p_size) AS f, p_size / 4 AS d, p_size % 4 AS m FROM part",
        "SELECT p_partkey, CAST(abs(p_size - 25) AS DOUBLE) AS a, CAST(p_size AS DOUBLE) AS f, p_size / 4 AS d, p_size % 4 AS m FROM part",
    ),
    "division_by_zero": (
        "SELECT p_partkey, p_retailprice / (p_size - 10) AS q, p_size % (p_size - 10) AS m FROM part",
        "SELECT p_partkey, p_retailprice / NULLIF(p_size - 10, 0) AS q, p_size % NULLIF(p_size - 10, 0) AS m FROM part",
    ),
    "fn_length": ("SELECT doc_id, LENGTH(text) AS n FROM documents", "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents"),
    "fn_substring": (
        "SELECT doc_id, SUBSTRING(text, 0, 20) AS a, SUBSTRING(text, 5, 10) AS b, SUBSTRING(text, 2, -3) AS c, SUBSTRING(lang, 2) AS d FROM documents",
        "SELECT doc_id, substring(text, 1, 20) AS a, substring(text, 5, 10) AS b, '' AS c, substring(lang, 2) AS d FROM documents",
    ),
    "fn_coalesce_empty": (
        "SELECT o_orderkey, COALESCE(NULL, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END, 'other') AS c FROM orders",
        "SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END, ''), 'other') AS c FROM orders",
    ),
    "fn_collate": (
        "SELECT doc_id, COLLATE(lang, 'NOCASE') AS a, COLLATE(SUBSTRING(text, 1, 60), 'NOACCENT') AS b FROM documents WHERE lang = 'fr'",
        "SELECT doc_id, lower(lang) AS a, translate(substring(text, 1, 60), 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ', 'AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy') AS b FROM documents WHERE lang = 'fr'",
    ),
    "fn_cast": (
        "SELECT p_partkey, CAST(p_retailprice AS INTEGER) AS i, CAST(p_size AS TEXT) AS t, CAST(p_size AS FLOAT) AS f, CAST(p_brand AS INTEGER) AS bad, CAST('yes' AS BOOLEAN) AS y, CAST('12.7' AS INTEGER) AS cut FROM part",
        "SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS VARCHAR) AS t, CAST(p_size AS DOUBLE) AS f, CAST(NULL AS BIGINT) AS bad, TRUE AS y, CAST(12 AS BIGINT) AS cut FROM part",
    ),
    "fn_cast_timestamp": (
        "SELECT r_regionkey, CAST('2024/03/05' AS TIMESTAMP) AS a, CAST('03/25/2024' AS TIMESTAMP) AS b, CAST('Mar 05, 2024' AS DATE) AS c, CAST('nope' AS TIMESTAMP) AS d FROM region",
        "SELECT r_regionkey, TIMESTAMP '2024-03-05 00:00:00' AS a, TIMESTAMP '2024-03-25 00:00:00' AS b, TIMESTAMP '2024-03-05 00:00:00' AS c, CAST(NULL AS TIMESTAMP) AS d FROM region",
    ),
    "fn_date_trunc": (
        "SELECT event_id, DATE_TRUNC('month', ts) AS m, DATE_TRUNC('hour', ts) AS h FROM events",
        "SELECT event_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS m, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h FROM events",
    ),
    "fn_time_trunc": (
        "SELECT event_id, TIME_TRUNC('15m', ts) AS a, TIME_TRUNC('1h30m', ts) AS b FROM events",
        "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS a, time_bucket(INTERVAL '90 minutes', ts, TIMESTAMP '1970-01-01') AS b FROM events",
    ),
    "group_time": (
        "SELECT TIME_TRUNC('1h', ts) AS bucket, COUNT(*) AS n, MAX(value) AS top FROM events GROUP BY TIME_TRUNC('1h', ts)",
        "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS n, max(value) AS top FROM events GROUP BY 1",
    ),
    "interval_arith": (
        "SELECT o_orderkey, o_orderdate + INTERVAL '1 month' AS a, o_orderdate - INTERVAL '2 years' AS b, o_orderdate + INTERVAL '36 hours' AS c FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' - INTERVAL '90 days'",
        "SELECT o_orderkey, o_orderdate + INTERVAL 30 DAY AS a, o_orderdate - INTERVAL 730 DAY AS b, o_orderdate + INTERVAL 36 HOUR AS c FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01 00:00:00' - INTERVAL 90 DAY",
    ),
    "first_last_ordered": (
        "SELECT user_id, FIRST(event_type ORDER BY ts, event_id) AS f, LAST(event_type ORDER BY ts, event_id) AS l, FIRST(NULLIF(event_type, 'click') ORDER BY ts, event_id) AS g FROM events GROUP BY user_id",
        "SELECT user_id, arg_min(event_type, {'a': ts, 'b': event_id}) AS f, arg_max(event_type, {'a': ts, 'b': event_id}) AS l, arg_min(event_type, {'a': ts, 'b': event_id}) FILTER (WHERE event_type <> 'click') AS g FROM events GROUP BY user_id",
    ),
    "candles_sql": (
        "SELECT TIME_TRUNC('15m', ts) AS bucket, FIRST(value ORDER BY ts, event_id) AS open, MAX(value) AS high, MIN(value) AS low, LAST(value ORDER BY ts, event_id) AS close FROM events GROUP BY TIME_TRUNC('15m', ts)",
        "SELECT time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS bucket, arg_min(value, {'a': ts, 'b': event_id}) AS open, max(value) AS high, min(value) AS low, arg_max(value, {'a': ts, 'b': event_id}) AS close FROM events GROUP BY 1",
    ),
    "text_plus": (
        "SELECT p_partkey, p_brand + p_type AS a, p.p_name + '/' + UPPER(p_brand) AS b, p_size + p_partkey AS c FROM part p",
        "SELECT p_partkey, p_brand || p_type AS a, p_name || '/' || upper(p_brand) AS b, p_size + p_partkey AS c FROM part",
    ),
    "substring_from": (
        "SELECT o_orderkey, SUBSTRING(o_orderpriority FROM o_orderkey % 4 + 1 FOR 3) AS s, EXTRACT(MONTH FROM o_orderdate) AS m FROM orders",
        "SELECT o_orderkey, substring(o_orderpriority, CAST(o_orderkey % 4 + 1 AS BIGINT), 3) AS s, CAST(extract(month FROM o_orderdate) AS INTEGER) AS m FROM orders",
    ),
    "json_members": (
        "SELECT event_id, props -> 'k' AS j, CAST(props ->> 'k' AS INTEGER) AS k FROM events",
        "SELECT event_id, CAST(props -> 'k' AS VARCHAR) AS j, TRY_CAST(props ->> 'k' AS BIGINT) AS k FROM events",
    ),
    "cast_boolean": (
        "SELECT n_nationkey, CAST(n_nationkey % 2 AS BOOLEAN) AS odd, CAST('yes' AS BOOLEAN) AS y, CAST(CAST(NULL AS TEXT) AS BOOLEAN) AS u FROM nation",
        "SELECT n_nationkey, n_nationkey % 2 <> 0 AS odd, TRUE AS y, CAST(NULL AS BOOLEAN) AS u FROM nation",
    ),
    "json_valid": (
        "SELECT event_id, CAST(props AS JSON) IS NOT NULL AS ok, CAST(CONCAT('{', props) AS JSON) IS NULL AS broken FROM events",
        "SELECT event_id, json_valid(props) AS ok, NOT json_valid('{' || props) AS broken FROM events",
    ),
    "json_path": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS INTEGER) AS k FROM events",
        "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    ),
}

FLAGSHIP = """
    SELECT n.n_name, COUNT(*) AS n, CAST(SUM(CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue
    FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN nation n ON c.c_nationkey = n.n_nationkey
    WHERE o.o_orderdate >= TIMESTAMP '1994-01-01 00:00:00' AND o.o_orderdate < TIMESTAMP '1999-01-01 00:00:00'
    GROUP BY n.n_name HAVING COUNT(*) > 5 ORDER BY revenue DESC, n.n_name LIMIT 10
"""
SAME["join_group_having_topk"] = FLAGSHIP
SAME |= {
    "join_natural": "SELECT n_name, n_regionkey FROM nation NATURAL JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 12) x",
    "join_semi": "SELECT c_custkey FROM customer c SEMI JOIN orders o ON c.c_custkey = o.o_custkey",
    "join_anti": "SELECT c_custkey FROM customer c ANTI JOIN orders o ON c.c_custkey = o.o_custkey",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "group_ordinal": "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1",
    "nulls_first": "SELECT k FROM (SELECT NULLIF(o_orderstatus, 'F') AS k, o_orderkey FROM orders) t ORDER BY k NULLS FIRST, o_orderkey LIMIT 900",
    "cast_in_where": "SELECT o_orderkey FROM orders WHERE CAST(o_totalprice AS INTEGER) % 2 = 0 AND CAST(o_orderkey AS TEXT) LIKE '1%' AND o_totalprice < 0",
    "not_like_between": "SELECT p_partkey FROM part WHERE p_type NOT LIKE '%A%' AND p_size NOT BETWEEN 5 AND 15",
    "boolean_predicate": "SELECT x.o_orderkey FROM (SELECT o_orderkey, o_totalprice > 1000 AS big FROM orders) x WHERE big = TRUE OR big = FALSE",
    "distinct_from": "SELECT o_orderkey FROM orders WHERE NULLIF(o_orderstatus, 'F') IS DISTINCT FROM 'O' AND o_orderpriority IS NOT DISTINCT FROM '1-URGENT'",
    "intersect_all": "SELECT n_regionkey FROM nation WHERE n_nationkey < 15 INTERSECT ALL SELECT n_regionkey FROM nation WHERE n_nationkey > 8",
    "except_all": "SELECT n_regionkey FROM nation EXCEPT ALL SELECT n_regionkey FROM nation WHERE n_nationkey > 8",
    "unary_minus": "SELECT -l_quantity AS q, -(l_linenumber - 3) AS n FROM lineitem WHERE -l_quantity < -40",
    "windows_more": "SELECT c_custkey, LEAD(c_custkey, 1) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nxt, FIRST_VALUE(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS f, CAST(NTILE(3) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS t FROM customer",
}


def dialect(text: str) -> Query:
    return lambda spark, sf_dir: engine(spark, sf_dir, text).sql(text)


# --- operators as DataFrames


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.candles(table(spark, sf_dir, "events"), "1h", "ts", "value", by=["event_type"], tie="event_id")


def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within the hour that starts at an event of every hundredth id: a banded join, not all pairs."""
    e = table(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast(T.TimestampType())) / 1_000_000.0)
    spans = e.where("event_id % 100 = 0").select(F.col("event_id").alias("span_id"), F.col("s").alias("a"), (F.col("s") + 3600).alias("b"))
    return relational.range_join(e.select("event_id", "s"), spans, "s", "a", "b", 3600.0).select("event_id", "span_id")


def null_safe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.nullif("o_orderstatus", F.lit("F")).alias("k"), "o_orderkey")
    s = spark.createDataFrame([(None, "none"), ("O", "open")], "k string, label string")
    return relational.null_safe_join(o, s, ["k"])


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.top_k(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), 20, "p_retailprice DESC", "p_partkey", offset=3)


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.numbered(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")])


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of their user's row: event ids are transactions, some versions delete."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("_row_id"), F.col("event_id").alias("_txn_id"), F.col("ts").alias("_create_time"), (F.col("event_id") % 11 == 0).alias("_deleted"), "event_type", "value")


def as_of_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.as_of_transaction(history(spark, sf_dir), 700).select("_row_id", "_txn_id", "event_type", "value")


def as_of_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    return temporal.as_of_timestamp(h, F.lit("2024-01-10 00:00:00").cast(T.TimestampNTZType())).select("_row_id", "_txn_id", "event_type", "value")


def update_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return dml.updated(o, {"o_totalprice": F.col("o_totalprice") + 1, "o_orderstatus": F.lit("X")}, F.nullif("o_orderstatus", F.lit("P")) == "O")


def delete_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.deleted(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.nullif("o_orderstatus", F.lit("P")) == "O")


def upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    new = o.where("o_orderkey % 3 = 0").select((F.col("o_orderkey") * 2).alias("o_orderkey"), F.lit(5.0).alias("o_totalprice"))
    return dml.upsert(o, new, ["o_orderkey"], {"o_totalprice": F.col("t.o_totalprice") + F.col("s.o_totalprice")})


def merge_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    s = o.where("o_orderkey % 2 = 0").select((F.col("o_orderkey") + 50).alias("o_orderkey"), F.lit("M").alias("o_orderstatus"), "o_totalprice")
    return dml.merge(o, s, ["o_orderkey"], {"o_orderstatus": F.col("s.o_orderstatus")}, delete=F.col("t.o_orderstatus") == "P", insert=F.col("s.o_totalprice") > 100000)


def versioned_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create, insert, update and delete on a versioned table, then a join of two of its versions."""
    e = engine(spark, sf_dir, "nation")
    e.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL, region INTEGER)")
    e.execute("INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM nation")
    before = e.store.latest().version
    e.execute("UPDATE t SET name = LOWER(name), region = region + 10 WHERE region < 3")
    e.execute("DELETE FROM t WHERE id % 5 = 0")
    return e.sql(f"SELECT a.id, a.name AS old_name, b.name AS new_name, b.region FROM t AS OF TRANSACTION {before} a LEFT JOIN t b ON a.id = b.id")


def engine_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "customer")
    e.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, seg TEXT, n INTEGER)")
    e.execute("INSERT INTO t SELECT c_custkey, c_mktsegment, 1 FROM customer WHERE c_custkey % 2 = 0")
    e.execute("INSERT INTO t (id, seg, n) SELECT c_custkey, 'new', 5 FROM customer WHERE c_custkey % 3 = 0 ON DUPLICATE KEY UPDATE n = n + VALUES(n)")
    return e.sql("SELECT id, seg, n FROM t")


def engine_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "supplier")
    e.execute("CREATE TABLE t (id INTEGER, bal FLOAT)")
    e.execute("INSERT INTO t SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 2 = 0")
    e.execute("MERGE INTO t USING supplier AS s ON t.id = s.s_suppkey WHEN MATCHED AND s.s_nationkey < 5 THEN DELETE WHEN MATCHED THEN UPDATE SET bal = s.s_acctbal + 1 WHEN NOT MATCHED AND s.s_nationkey > 10 THEN INSERT (id, bal) VALUES (s.s_suppkey, 0)")
    return e.sql("SELECT id, bal FROM t")


def _orders(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with a versioned copy of the orders."""
    e = engine(spark, sf_dir, "orders customer")
    e.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, cust INTEGER, status TEXT, price FLOAT)")
    e.execute("INSERT INTO t SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
    return e


def as_of_after_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version from before a snapshot next to the one after it and a later change of a column's type."""
    e = _orders(spark, sf_dir)
    before = e.store.latest().version
    e.execute("UPDATE t SET status = 'N' WHERE id % 3 = 0")
    e.execute("PRAGMA snapshot")
    e.execute("DELETE FROM t WHERE id % 5 = 0")
    e.execute("ALTER TABLE t MODIFY COLUMN cust TEXT")
    return e.sql(f"SELECT a.id, a.cust, a.status AS old_status, b.status, b.cust AS cust_text FROM t AS OF TRANSACTION {before} a LEFT JOIN t b ON a.id = b.id")


def upsert_key_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert that would give two rows one key is an error and changes nothing; one to a free key works."""
    e = _orders(spark, sf_dir)
    first, second = (r[0] for r in e.sql("SELECT id FROM t ORDER BY id LIMIT 2").collect())
    try:
        e.execute(f"INSERT INTO t (id) VALUES ({first}) ON DUPLICATE KEY UPDATE id = {second}")
    except ConstraintError:
        e.execute(f"INSERT INTO t (id) VALUES ({first}) ON DUPLICATE KEY UPDATE id = -1")
    return e.sql("SELECT id, status FROM t")


def update_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _orders(spark, sf_dir)
    e.execute("WITH rich AS (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) UPDATE t SET status = 'R', price = price + 1 WHERE cust IN (SELECT c_custkey FROM rich)")
    return e.sql("SELECT id, status, price FROM t")


def delete_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _orders(spark, sf_dir)
    e.execute("DELETE FROM t WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = cust AND c_acctbal < 0) OR price > (SELECT AVG(o_totalprice) FROM orders)")
    return e.sql("SELECT id FROM t")


def transaction_savepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _orders(spark, sf_dir)
    e.execute("BEGIN; DELETE FROM t WHERE id % 2 = 0; SAVEPOINT a; DELETE FROM t; ROLLBACK TO a; ALTER TABLE t RENAME TO u; COMMIT")
    e.execute("BEGIN; DELETE FROM u; ROLLBACK")
    return e.sql("SELECT id, price FROM u")


def ddl_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that are added, renamed, changed and dropped, a view and a table from a query."""
    e = _orders(spark, sf_dir)
    e.execute("CREATE INDEX by_cust ON t (cust); ALTER TABLE t ADD COLUMN score FLOAT; UPDATE t SET score = price / 2 WHERE id < 1000")
    e.execute("ALTER TABLE t RENAME COLUMN score TO points; ALTER TABLE t DROP COLUMN cust; CREATE VIEW v AS SELECT id, points FROM t WHERE points IS NOT NULL")
    e.execute("CREATE TABLE w AS SELECT id, points, status FROM t WHERE status = 'F'; DROP TABLE IF EXISTS nothing")
    return e.sql("SELECT v.id, v.points, w.status FROM v LEFT JOIN w ON v.id = w.id")


def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "")
    e.execute("CREATE TABLE b (id INTEGER PRIMARY KEY, x TEXT NOT NULL, y FLOAT); CREATE TABLE a (i INTEGER); CREATE INDEX by_x ON b (x); CREATE COLUMNAR INDEX ON b (y)")
    e.execute("SET vectorized = ON; PRAGMA keep_snapshots = 3; TRUNCATE TABLE a")
    parts = [e.sql(f"SHOW {what}") for what in ("TABLES", "CREATE TABLE b", "INDEXES FROM b")] + [e.sql("PRAGMA keep_snapshots")]
    rows = [(i, "|".join(str(v) for v in r)) for i, df in enumerate(parts) for r in df.collect()]
    return spark.createDataFrame(rows, "part int, line string")


def files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as CSV, JSON and Parquet and back."""
    e = engine(spark, sf_dir, "")
    root = f"{e.store.files.root}/files"
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    back = None
    for kind in ("csv", "json", "parquet"):
        files.write(o, f"{root}/{kind}", kind)
        part = files.read(spark, f"{root}/{kind}", kind, schema=o.schema).withColumn("kind", F.lit(kind))
        back = part if back is None else back.unionByName(part)
    return back


def user_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar and an aggregate function of the caller's own."""

    def doubled(x: pd.Series) -> pd.Series:
        return x * 2

    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    e = engine(spark, sf_dir, "supplier")
    e.register_function("doubled", F.pandas_udf(doubled, "long"))
    e.register_function("spread", F.pandas_udf(spread, "double"))
    return e.sql("SELECT doubled(s_nationkey) AS d, spread(s_acctbal) AS s FROM supplier GROUP BY s_nationkey")


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "orders").prepare("SELECT o_orderkey FROM orders WHERE o_orderstatus = ? AND o_totalprice BETWEEN $2 AND $3").sql("F", 1000, 50000.5)


def column_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(scalar.time_trunc("6h", "ts").alias("bucket")).agg(aggregates.first("value", "ts", tie="event_id").alias("open"), aggregates.last("value", "ts", tie="event_id").alias("close"), F.sum(scalar.length("event_type")).alias("bytes"))


DATAFRAME: dict[str, tuple[Query, str]] = {
    "candles": (
        candles,
        "SELECT event_type, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS bucket, arg_min(value, {'a': ts, 'b': event_id}) AS open, max(value) AS high, min(value) AS low, arg_max(value, {'a': ts, 'b': event_id}) AS close, count(*) AS n FROM events GROUP BY 1, 2",
    ),
    "range_join": (range_join, "SELECT p.event_id, s.event_id AS span_id FROM events p JOIN events s ON s.event_id % 100 = 0 AND p.ts >= s.ts AND p.ts < s.ts + INTERVAL 1 HOUR"),
    "null_safe_join": (null_safe_join, "SELECT o.k, o.o_orderkey, s.label FROM (SELECT nullif(o_orderstatus, 'F') AS k, o_orderkey FROM orders) o JOIN (VALUES (NULL, 'none'), ('O', 'open')) s(k, label) ON o.k IS NOT DISTINCT FROM s.k"),
    "top_k_operator": (top_k, "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS FIRST, p_partkey LIMIT 20 OFFSET 3"),
    "row_number_operator": (numbered, "SELECT c_custkey, c_nationkey, c_acctbal, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS row_number FROM customer"),
    "as_of_txn": (
        as_of_transaction,
        "SELECT user_id AS _row_id, event_id AS _txn_id, event_type, value FROM events WHERE event_id <= 700 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_id % 11 <> 0",
    ),
    "as_of_ts": (
        as_of_timestamp,
        "SELECT user_id AS _row_id, event_id AS _txn_id, event_type, value FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_id % 11 <> 0",
    ),
    "update_state": (update_state, "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders"),
    "delete_state": (delete_state, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'"),
    "upsert_state": (
        upsert_state,
        "WITH s AS (SELECT o_orderkey * 2 AS k FROM orders WHERE o_orderkey % 3 = 0) SELECT coalesce(o_orderkey, k) AS o_orderkey, CASE WHEN o_orderkey IS NULL THEN 5.0::DOUBLE WHEN k IS NULL THEN o_totalprice ELSE o_totalprice + 5 END AS o_totalprice FROM orders FULL JOIN s ON o_orderkey = k",
    ),
    "merge_state": (
        merge_state,
        "WITH s AS (SELECT o_orderkey + 50 AS k, o_totalprice AS p FROM orders WHERE o_orderkey % 2 = 0) SELECT coalesce(o_orderkey, k) AS o_orderkey, CASE WHEN k IS NOT NULL THEN 'M' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey IS NULL THEN p ELSE o_totalprice END AS o_totalprice FROM orders FULL JOIN s ON o_orderkey = k WHERE (o_orderkey IS NULL AND p > 100000) OR (o_orderkey IS NOT NULL AND (k IS NULL OR o_orderstatus <> 'P'))",
    ),
    "versioned_as_of": (
        versioned_as_of,
        "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS old_name, CASE WHEN n_nationkey % 5 <> 0 THEN CASE WHEN n_regionkey < 3 THEN lower(n_name) ELSE n_name END END AS new_name, CAST(CASE WHEN n_nationkey % 5 <> 0 THEN CASE WHEN n_regionkey < 3 THEN n_regionkey + 10 ELSE n_regionkey END END AS BIGINT) AS region FROM nation",
    ),
    "engine_upsert": (
        engine_upsert,
        "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'new' END AS seg, CAST(CASE WHEN c_custkey % 6 = 0 THEN 6 WHEN c_custkey % 2 = 0 THEN 1 ELSE 5 END AS BIGINT) AS n FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
    ),
    "engine_merge": (
        engine_merge,
        "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + 1 ELSE 0 END AS bal FROM supplier WHERE (s_suppkey % 2 = 0 AND s_nationkey >= 5) OR (s_suppkey % 2 <> 0 AND s_nationkey > 10)",
    ),
    "as_of_after_snapshot": (
        as_of_after_snapshot,
        "SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS old_status, CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'N' ELSE o_orderstatus END END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS cust_text FROM orders",
    ),
    "upsert_key_change": (upsert_key_change, "SELECT CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN -1 ELSE o_orderkey END AS id, o_orderstatus AS status FROM orders"),
    "update_subquery": (
        update_subquery,
        "SELECT o_orderkey AS id, CASE WHEN c_acctbal > 5000 THEN 'R' ELSE o_orderstatus END AS status, CASE WHEN c_acctbal > 5000 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    ),
    "delete_subquery": (
        delete_subquery,
        "SELECT o_orderkey AS id FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE coalesce(c_acctbal, 0) >= 0 AND o_totalprice <= (SELECT avg(o_totalprice) FROM orders)",
    ),
    "transaction_savepoint": (transaction_savepoint, "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey % 2 <> 0"),
    "ddl_changes": (ddl_changes, "SELECT o_orderkey AS id, o_totalprice / 2 AS points, CASE WHEN o_orderstatus = 'F' THEN 'F' END AS status FROM orders WHERE o_orderkey < 1000"),
    "show_tables": (
        show_tables,
        "SELECT * FROM (VALUES (CAST(0 AS INTEGER), 'a'), (0, 'b'), (1, 'b|CREATE TABLE b (id INTEGER PRIMARY KEY, x TEXT NOT NULL, y FLOAT)'), (2, 'b|by_x|x|btree|False'), (2, 'b|columnar_b_y|y|columnar|False'), (3, '3')) v(part, line)",
    ),
    "files_round_trip": (files_round_trip, "SELECT o_orderkey, o_orderstatus, o_totalprice, kind FROM orders, (VALUES ('csv'), ('json'), ('parquet')) k(kind)"),
    "user_functions": (user_functions, "SELECT CAST(2 * s_nationkey AS BIGINT) AS d, max(s_acctbal) - min(s_acctbal) AS s FROM supplier GROUP BY s_nationkey"),
    "parameters": (parameters, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 50000.5"),
    "column_api": (
        column_api,
        "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS bucket, arg_min(value, {'a': ts, 'b': event_id}) AS open, arg_max(value, {'a': ts, 'b': event_id}) AS close, CAST(sum(octet_length(encode(event_type))) AS BIGINT) AS bytes FROM events GROUP BY 1",
    ),
}

QUERIES: dict[str, Query] = {n: dialect(t) for n, t in SAME.items()} | {n: dialect(t) for n, (t, _) in PAIRS.items()} | {n: q for n, (q, _) in DATAFRAME.items()}
ORACLE: dict[str, str] = SAME | {n: t for n, (_, t) in PAIRS.items()} | {n: t for n, (_, t) in DATAFRAME.items()}
