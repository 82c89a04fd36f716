"""Aggregates, grouping, cubes and duplicate elimination."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.registry import builtins
from millrace.operators import aggregates
from millrace.plans.base import Plans

P = Plans()
_FUNCTIONS = builtins()

P.sql("sum_all_types", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS i, CAST(sum(l_orderkey) AS BIGINT) AS l, round(CAST(sum(CAST(l_quantity AS FLOAT)) AS DOUBLE), 2) AS f, round(sum(l_quantity), 2) AS d FROM lineitem GROUP BY l_returnflag")
P.sql("min_max_all_types", "SELECT min(l_linenumber) AS min_i, max(l_linenumber) AS max_i, min(l_orderkey) AS min_l, max(l_orderkey) AS max_l, CAST(min(CAST(l_tax AS FLOAT)) AS DOUBLE) AS min_f, CAST(max(CAST(l_tax AS FLOAT)) AS DOUBLE) AS max_f, min(l_extendedprice) AS min_d, max(l_extendedprice) AS max_d FROM lineitem")
P.sql("min_string", "SELECT n_regionkey, min(n_name) AS lo, max(n_name) AS hi FROM nation GROUP BY n_regionkey")
P.sql("max_of_negatives", "SELECT l_linenumber, max(0 - l_orderkey) AS m FROM lineitem GROUP BY l_linenumber")
P.sql("avg_all_types", "SELECT l_linestatus, round(avg(l_linenumber), 6) AS i, round(avg(l_orderkey), 4) AS l, round(avg(CAST(l_linenumber AS FLOAT)), 6) AS f, round(avg(l_quantity), 6) AS d FROM lineitem GROUP BY l_linestatus")
P.sql("count_rows", "SELECT count(*) AS n FROM lineitem")
P.sql("count_values", "SELECT count(nullif(c_mktsegment, 'BUILDING')) AS n, count(*) AS all_rows FROM customer")
P.sql("agg_expr", "SELECT count(*) + max(l_orderkey) AS v FROM lineitem")
P.sql("agg_case", "SELECT l_returnflag, round(100 * sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice), 6) AS pct FROM lineitem GROUP BY l_returnflag")
P.sql("global_agg", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem")
P.sql("global_agg_empty", "SELECT count(*) AS n, sum(l_quantity) AS s, max(l_orderkey) AS m FROM lineitem WHERE l_orderkey < 0")
P.sql("group_by_one", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
P.sql("group_by_two", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")
P.sql("group_by_expr", "SELECT o_custkey % 10 AS bucket, count(*) AS n FROM orders GROUP BY o_custkey % 10")
P.frame("group_by_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")(lambda t: aggregates.group(t("orders"), ["o_custkey"], F.count("*").alias("n"), having=F.col("n") > 12))
P.sql("having_expr", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 1000000 AND count(*) < 20")
P.sql("group_by_limit", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY o_custkey LIMIT 5")
P.sql("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
P.sql("count_distinct", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
P.frame("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)")(lambda t: aggregates.cube(t("lineitem"), ["l_returnflag", "l_linestatus"], F.count("*").alias("n")))
P.frame("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)")(lambda t: aggregates.rollup(t("orders"), ["o_orderstatus", "o_orderpriority"], F.count("*").alias("n")))
P.frame("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")(lambda t: aggregates.grouping_sets(t("orders"), [["o_orderstatus"], ["o_orderpriority"], []], F.count("*").alias("n")))
P.sql("grouping_mixed", "SELECT l_linenumber, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_linenumber, CUBE(l_returnflag), ROLLUP(l_linestatus)")
P.sql("grouping_empty_set", "SELECT count(*) AS n FROM nation GROUP BY ()", "SELECT count(*) AS n FROM nation GROUP BY GROUPING SETS (())")
P.frame("salted_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(*) AS n FROM lineitem GROUP BY l_returnflag")(
    lambda t: aggregates.count_distinct(t("lineitem"), ["l_returnflag"], "l_partkey", distinct="parts", rows="n")
)
P.frame("udaf_composite", "SELECT o_orderstatus, round(avg(o_totalprice), 4) AS a, count(o_custkey) AS n FROM orders GROUP BY o_orderstatus")(
    lambda t: t("orders").groupBy("o_orderstatus").agg(F.round(_FUNCTIONS.call(t("orders"), "avg", "o_totalprice"), 4).alias("a"), _FUNCTIONS.call(t("orders"), "count", "o_custkey").alias("n"))
)


@P.frame("udf_scalar", "SELECT o_orderkey, upper(o_orderstatus) || '-' || CAST(o_custkey AS VARCHAR) AS tag FROM orders")
def _udf_scalar(t):
    r = builtins()
    r.scalar("tag", ["string", "long"], "string", lambda s, k: F.concat(F.upper(s), F.lit("-"), k.cast("string")))
    return t("orders").select("o_orderkey", r.call(t("orders"), "tag", "o_orderstatus", "o_custkey").alias("tag"))


@P.frame("udf_pandas", "SELECT s_suppkey, round(s_acctbal * 2 + 1, 2) AS v FROM supplier")
def _udf_pandas(t):
    def double_and_one(x):
        return x * 2 + 1

    double_and_one.__annotations__ = {"x": __import__("pandas").Series, "return": __import__("pandas").Series}
    r = builtins()
    r.pandas_scalar("d1", ["double"], "double", double_and_one)
    return t("supplier").select("s_suppkey", F.round(r.call(t("supplier"), "d1", "s_acctbal"), 2).alias("v"))
