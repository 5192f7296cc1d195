"""Named queries in the dialect, one or more for each construct, and DuckDB SQL for their rows.

Where both engines read the same text alike, the oracle is the query itself with casts of its sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.engine import Engine

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

FLAGSHIP = """
SELECT o_orderpriority, COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders
WHERE o_totalprice BETWEEN 1000 AND 100000 GROUP BY o_orderpriority HAVING COUNT(*) > 1 ORDER BY total DESC LIMIT 5"""

_NULLED = "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END"
_KEY = "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderpriority END"


def _same(sql: str) -> tuple[str, str]:
    return sql, sql


#: name: (our SQL, DuckDB's). Doubles are summed as rounded integers, so that order of addition does not show.
SQL: dict[str, tuple[str, str]] = {
    "scan_project": _same("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"),
    "scan_star": _same("SELECT * FROM nation"),
    "filter_compare": _same("SELECT o_orderkey FROM orders WHERE o_totalprice >= 150000.5 AND o_orderstatus <> 'F' AND o_custkey < 700"),
    "filter_3vl_and_or_not": _same(f"SELECT o_orderkey FROM orders WHERE NOT (({_NULLED}) > 300 AND o_orderstatus = 'O') OR ({_NULLED}) < 10"),
    "filter_in_list": _same("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', NULL)"),
    "filter_not_in": _same("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (1, 2, 3, 5, 8, 13)"),
    "filter_not_in_null": _same("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (1, NULL)"),
    "filter_between": _same("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount NOT BETWEEN 0.02 AND 0.08"),
    "filter_like": _same("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_%e%'"),
    "filter_not_like": _same("SELECT p_partkey FROM part WHERE p_type NOT LIKE 'S%'"),
    "filter_is_null": _same(f"SELECT o_orderkey FROM orders WHERE ({_NULLED}) IS NULL"),
    "filter_is_not_null": _same(f"SELECT o_orderkey FROM orders WHERE ({_NULLED}) IS NOT NULL AND o_custkey > 5"),
    "filter_timestamp": _same("SELECT o_orderkey FROM orders WHERE o_orderdate >= CAST('1995-01-01' AS TIMESTAMP) AND o_orderdate < TIMESTAMP '1995-07-01'"),
    "arith_basic": _same("SELECT l_orderkey, l_linenumber, l_linenumber * 2 + l_orderkey - 1 AS a, l_quantity * 2 AS b FROM lineitem"),
    "arith_division": _same("SELECT o_orderkey, o_orderkey / 4 AS a, o_custkey / 8 AS b FROM orders"),
    "arith_modulo_floor": ("SELECT o_orderkey, (o_custkey - 500) % 7 AS a, (o_custkey - 500) % -7 AS b FROM orders", "SELECT o_orderkey, (((o_custkey - 500) % 7) + 7) % 7 AS a, (((o_custkey - 500) % -7) + -7) % -7 AS b FROM orders"),
    "unary_negate": _same("SELECT o_orderkey, -o_custkey AS a, -(o_custkey - 3) AS b FROM orders"),
    "case_searched": _same("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE WHEN o_custkey > 500 THEN o_custkey END AS c FROM orders"),
    "cast_numeric": ("SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS a, CAST(o_custkey AS DOUBLE) AS b, CAST('12' AS INT) AS c, CAST(o_custkey % 2 AS BOOLEAN) AS d FROM orders", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS a, CAST(o_custkey AS DOUBLE) AS b, CAST('12' AS INT) AS c, CAST(o_custkey % 2 AS BOOLEAN) AS d FROM orders"),
    "cast_date_timestamp": _same("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST('2020-02-29' AS DATE) AS e, CAST('2020-02-29 12:30:00' AS TIMESTAMP) AS f FROM orders"),
    "cast_string": _same("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS a FROM orders"),
    "fn_lower_upper": _same("SELECT c_custkey, LOWER(c_mktsegment) AS a, UPPER(c_name) AS b FROM customer"),
    "fn_length": ("SELECT p_partkey, LENGTH(p_name) AS a, LENGTH('é中') AS b FROM part", "SELECT p_partkey, LENGTH(p_name) AS a, LENGTH('é中') AS b FROM part"),
    "fn_abs": _same("SELECT c_custkey, ABS(c_acctbal) AS a, ABS(c_nationkey - 10) AS b FROM customer"),
    "fn_coalesce": _same(f"SELECT o_orderkey, COALESCE({_NULLED}, -1) AS a, COALESCE(NULL, {_KEY}, 'none') AS b FROM orders"),
    "fn_concat": (f"SELECT o_orderkey, CONCAT(o_orderstatus, '-', {_KEY}) AS a FROM orders", f"SELECT o_orderkey, o_orderstatus || '-' || {_KEY} AS a FROM orders"),
    "fn_substring": ("SELECT c_custkey, SUBSTRING(c_name, 3, 4) AS a, SUBSTRING(c_name, 5) AS b, SUBSTRING(c_name, -2, 3) AS c, SUBSTRING(c_name, 0, 2) AS d FROM customer", "SELECT c_custkey, substring(c_name, 3, 4) AS a, substring(c_name, 5) AS b, substring(c_name, 1, 3) AS c, substring(c_name, 1, 2) AS d FROM customer"),
    "fn_round": ("SELECT p_partkey, ROUND(p_retailprice / 3, 2) AS a, ROUND(p_size / 2) AS b, ROUND(p_size, -1) AS c FROM part", "SELECT p_partkey, round(p_retailprice / 3, 2) AS a, round_even(p_size / 2, 0) AS b, CAST(round_even(p_size / 10, 0) * 10 AS INT) AS c FROM part"),
    "limit_with_order": _same("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 17"),
    "limit_zero": _same("SELECT o_orderkey FROM orders LIMIT 0"),
    "topk": _same("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25"),
    "order_multi_nulls": _same(f"SELECT o_orderkey, {_KEY} AS k FROM orders ORDER BY k DESC, o_orderkey LIMIT 1000"),
    "order_nulls_first": _same(f"SELECT o_orderkey, {_KEY} AS k FROM orders ORDER BY k NULLS FIRST, o_orderkey DESC LIMIT 40"),
    "order_by_ordinal": _same("SELECT c_name, c_acctbal FROM customer ORDER BY 2 DESC, 1 LIMIT 10"),
    "order_by_alias": _same("SELECT c_custkey, 0 - c_acctbal AS debt FROM customer ORDER BY debt, c_custkey LIMIT 10"),
    "order_by_hidden": _same("SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10"),
    "order_multi_nulls_whole": _same(f"SELECT o_orderkey, {_KEY} AS k FROM orders ORDER BY k DESC, o_orderkey"),
    "order_nulls_first_whole": _same(f"SELECT o_orderkey, {_KEY} AS k FROM orders ORDER BY k NULLS FIRST, o_orderkey DESC"),
    "order_by_ordinal_whole": _same("SELECT c_name, c_acctbal FROM customer ORDER BY 2 DESC, 1"),
    "order_by_alias_whole": _same("SELECT c_custkey, 0 - c_acctbal AS debt FROM customer ORDER BY debt, c_custkey"),
    "order_by_hidden_whole": _same("SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey"),
    "join_inner": _same("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"),
    "join_left": _same("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey"),
    "join_right": _same("SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT OUTER JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 250000.0"),
    "join_full": _same("SELECT n.n_nationkey, s.s_suppkey FROM nation n FULL OUTER JOIN supplier s ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 0.0"),
    "join_multi_key": _same("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber"),
    "join_multiway": _same("SELECT r.r_name, COUNT(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name"),
    "join_self": _same("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey"),
    "join_expression_key": _same("SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_nationkey + 1 = s.s_nationkey"),
    "join_constant_on": _same("SELECT o.o_orderkey, c.c_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING'"),
    "join_null_keys": _same(f"SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN customer c ON CASE WHEN o.o_custkey % 3 = 0 THEN NULL ELSE o.o_custkey END = c.c_custkey"),
    "join_non_equi": _same("SELECT a.r_regionkey AS x, n.n_nationkey AS y FROM region a JOIN nation n ON a.r_regionkey < n.n_regionkey"),
    "agg_global": _same("SELECT COUNT(*) AS n, COUNT(o_custkey) AS c, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders"),
    "agg_global_empty": ("SELECT COUNT(*) AS n, SUM(o_custkey) AS s, MIN(o_orderstatus) AS lo FROM orders WHERE o_orderkey < 0", "SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, MIN(o_orderstatus) AS lo FROM orders WHERE o_orderkey < 0"),
    "agg_group": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(CAST(l_quantity AS BIGINT)) AS q, MAX(l_shipdate) AS d FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, MAX(l_shipdate) AS d FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "agg_group_expression": _same("SELECT UPPER(c_mktsegment) AS s, COUNT(*) AS n FROM customer GROUP BY UPPER(c_mktsegment)"),
    "agg_group_null_key": _same(f"SELECT {_KEY} AS k, COUNT(*) AS n, COUNT({_NULLED}) AS c FROM orders GROUP BY {_KEY}"),
    "agg_avg": ("SELECT o_orderpriority, AVG(o_custkey) AS a FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, AVG(o_custkey) AS a FROM orders GROUP BY o_orderpriority"),
    "agg_count_distinct": _same("SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n, COUNT(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_orderstatus"),
    "agg_sum_avg_distinct": ("SELECT SUM(DISTINCT l_linenumber) AS s, AVG(DISTINCT l_linenumber) AS a FROM lineitem", "SELECT CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS s, AVG(DISTINCT l_linenumber) AS a FROM lineitem"),
    "agg_min_max_string": _same("SELECT c_nationkey, MIN(c_name) AS lo, MAX(DISTINCT c_mktsegment) AS hi FROM customer GROUP BY c_nationkey"),
    "agg_expression": ("SELECT o_orderstatus, SUM(o_custkey) / COUNT(*) AS a, MAX(o_custkey) - MIN(o_custkey) AS r FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(SUM(o_custkey) AS DOUBLE) / COUNT(*) AS a, MAX(o_custkey) - MIN(o_custkey) AS r FROM orders GROUP BY o_orderstatus"),
    "having_aggregate": _same("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12"),
    "having_alias": _same("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12 AND o_custkey > 10"),
    "having_only_aggregate": _same("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING MAX(o_totalprice) > 280000.0"),
    "grouping_sets": _same("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())"),
    "grouping_sets_empty_input": _same("SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY GROUPING SETS ((o_orderstatus), ())"),
    "grouping_sets_repeated": _same("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderstatus))"),
    "win_row_number": _same("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders"),
    "win_rank": _same("SELECT l_orderkey, l_linenumber, RANK() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS r FROM lineitem"),
    "win_dense_rank": _same(f"SELECT o_orderkey, DENSE_RANK() OVER (PARTITION BY o_orderstatus ORDER BY {_NULLED}) AS r FROM orders"),
    "win_agg_partition": _same("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders"),
    "win_agg_running_default_frame": ("SELECT o_orderkey, SUM(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) AS s FROM orders", "SELECT o_orderkey, CAST(SUM(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) AS BIGINT) AS s FROM orders"),
    "win_rows_preceding": ("SELECT o_orderkey, SUM(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS n FROM orders", "SELECT o_orderkey, CAST(SUM(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS n FROM orders"),
    "win_rows_following": _same("SELECT o_orderkey, MIN(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m, AVG(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS a FROM orders"),
    "win_empty_frame": ("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 FOLLOWING AND 1 FOLLOWING) AS n, MAX(o_custkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND 1 PRECEDING) AS m FROM orders", "SELECT o_orderkey, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS m FROM orders"),
    "win_distinct": ("SELECT o_orderkey, COUNT(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS n, SUM(DISTINCT o_custkey % 10) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS s FROM orders", "SELECT o_orderkey, COUNT(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS n, CAST(SUM(DISTINCT o_custkey % 10) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders"),
    "win_over_aggregate": _same("SELECT o_orderpriority, COUNT(*) AS n, RANK() OVER (ORDER BY COUNT(*) DESC) AS r FROM orders GROUP BY o_orderpriority"),
    "win_in_expression": ("SELECT o_orderkey, o_custkey - MIN(o_custkey) OVER (PARTITION BY o_orderstatus) AS d FROM orders", "SELECT o_orderkey, o_custkey - MIN(o_custkey) OVER (PARTITION BY o_orderstatus) AS d FROM orders"),
    "win_several_partitions": _same("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS a, COUNT(*) OVER (PARTITION BY o_orderpriority) AS b FROM orders"),
    "win_rank_no_order": _same("SELECT o_orderkey, RANK() OVER (PARTITION BY o_orderstatus) AS r FROM orders"),
    "star_multi_source": ("SELECT * FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", 'SELECT n.n_nationkey AS "n.n_nationkey", n.n_name AS "n.n_name", n.n_regionkey AS "n.n_regionkey", r.r_regionkey AS "r.r_regionkey", r.r_name AS "r.r_name" FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey'),
    "count_star_pruned": _same("SELECT COUNT(*) AS n FROM lineitem"),
    "events_by_type": _same("SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS u, MIN(ts) AS first_ts FROM events GROUP BY event_type"),
    "flagship": (FLAGSHIP, "SELECT o_orderpriority, n, total FROM (" + FLAGSHIP.strip() + ")"),
}


def engine(spark: SparkSession, sf_dir: str, sql: str) -> Engine:
    """With the tables that the query names."""
    e = Engine(spark)
    words = set(sql.replace(",", " ").replace("(", " ").split())
    for name in TABLES:
        if name in words:
            e.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return e


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    sql = SQL[name][0]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir, sql).sql(sql)

    query.__name__ = name
    return query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run("flagship")(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run(name) for name in SQL}


def oracles() -> dict[str, str]:
    return {name: duck for name, (_, duck) in SQL.items()}


__all__ = ["FLAGSHIP", "SQL", "engine", "flagship", "oracles", "queries"]
