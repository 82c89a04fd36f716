"""Scans, projections, predicates, arithmetic and order."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import ipv4, scalar
from millrace.operators import scan, sorting
from millrace.plans.base import Plans

P = Plans()

# scans and projections
P.frame("scan_all", "SELECT * FROM customer")(lambda t: scan.scan(t("customer")))
P.frame("project_cols", "SELECT l_orderkey, l_quantity FROM lineitem")(lambda t: scan.scan(t("lineitem"), ["l_orderkey", "l_quantity"]))
P.sql("project_expr", "SELECT l_orderkey, l_linenumber + 1 AS next_line, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
P.queries["const_select"] = lambda spark, sf: scan.constants(spark, five=F.lit(2) + F.lit(3), m=F.lit(8) * F.lit(9), word="x")
P.oracles["const_select"] = "SELECT 2 + 3 AS five, 8 * 9 AS m, 'x' AS word"
P.sql("select_star_join", "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey")

# predicates
P.sql("filter_cmp", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_partkey < 100")
P.sql("filter_and_or_not", "SELECT o_orderkey, o_orderstatus FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND NOT o_totalprice < 200000")
P.sql("filter_not_equal", "SELECT o_orderkey FROM orders WHERE o_orderstatus ~= 'O' AND o_orderpriority ^= '1-URGENT' AND o_orderkey != 7 AND o_custkey <> 1", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority <> '1-URGENT' AND o_orderkey <> 7 AND o_custkey <> 1")
P.sql("filter_like", "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1%'")
P.sql("filter_like_ci", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'pro?o%'", "SELECT p_partkey, p_type FROM part WHERE regexp_full_match(p_type, 'pro.o.*', 'is')", strict_like=True)
P.frame("filter_like_plain_regex", "SELECT p_partkey FROM part WHERE p_type ILIKE 'e%y'")(lambda t: t("part").where(scalar.like(F.col("p_type"), "e%y")).select("p_partkey"))
P.sql("filter_not_like", "SELECT p_partkey, p_type FROM part WHERE p_type NOT LIKE '%A%'")
P.sql("filter_is_null", "SELECT c_custkey FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) x WHERE seg IS NULL")
P.sql("filter_is_not_null", "SELECT c_custkey, seg FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) x WHERE seg IS NOT NULL")
P.sql("filter_in", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (1, 3, 5, 7)")
P.sql("filter_not_in", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
P.sql("filter_is_true", "SELECT o_orderkey, (nullif(o_orderstatus, 'P') = 'F') IS NOT FALSE AS f FROM orders WHERE (nullif(o_orderstatus, 'P') = 'F') IS TRUE OR (nullif(o_orderstatus, 'P') = 'O') IS UNKNOWN", "SELECT o_orderkey, (nullif(o_orderstatus, 'P') = 'F') IS NOT FALSE AS f FROM orders WHERE (nullif(o_orderstatus, 'P') = 'F') IS TRUE OR (nullif(o_orderstatus, 'P') = 'O') IS NULL")
P.sql("filter_between", "SELECT l_orderkey, l_discount + 0.0 AS d FROM lineitem WHERE l_quantity BETWEEN 10 AND 12", "SELECT l_orderkey, CAST(l_discount + 0.0 AS DOUBLE) AS d FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
P.sql("case_when", "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'one' WHEN r_regionkey = 2 THEN 'two' ELSE 'zero' END AS cond FROM region")
P.sql("case_when_no_else", "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'one' WHEN r_regionkey = 2 THEN 'two' END AS cond FROM region")
P.sql("date_compare", "SELECT o_orderkey, CAST(o_orderdate AS date) AS d FROM orders WHERE o_orderdate <= timestamp '1996-03-22 00:00:00'")
P.sql("column_alias", "SELECT o.o_orderkey AS k, o.o_custkey AS c FROM orders o WHERE o.o_custkey < 20")

# arithmetic
P.sql("arith_ops", "SELECT o_orderkey, o_orderkey + o_custkey AS a, o_orderkey - o_custkey AS s, o_orderkey * 2 AS m, round(o_totalprice / 3, 4) AS d FROM orders")
P.sql("int_division", "SELECT o_orderkey, o_orderkey / 7 AS q, (o_orderkey + o_custkey) / 10 AS r FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, (o_orderkey + o_custkey) // 10 AS r FROM orders")
P.sql("modulo", "SELECT o_orderkey, o_orderkey % 7 AS a, (0 - o_orderkey) % 7 AS b FROM orders")
P.frame("typed_arithmetic", "SELECT l_orderkey, CAST(l_orderkey // l_linenumber AS BIGINT) AS q, CAST(l_linenumber * l_quantity AS DOUBLE) AS p FROM lineitem")(
    lambda t: t("lineitem").select("l_orderkey", scalar.arithmetic(t("lineitem"), "l_orderkey", "/", "l_linenumber").alias("q"), scalar.arithmetic(t("lineitem"), "l_linenumber", "*", "l_quantity").alias("p"))
)
P.frame("ipv4_pack", "SELECT user_id, user_id AS packed, concat_ws('.', user_id // 16777216, user_id // 65536 % 256, user_id // 256 % 256, user_id % 256) AS quad, (user_id // 256) = 0 AS local FROM events")(
    lambda t: t("events").select("user_id", ipv4.pack(ipv4.unpack(F.col("user_id"))).alias("packed"), ipv4.unpack(F.col("user_id")).alias("quad"), ipv4.matches_subnet(F.col("user_id"), "0.0.0.0", 24).alias("local"))
)
P.frame("random_bounds", "SELECT count(*) AS n FROM nation")(lambda t: t("nation").select(scalar.random_int(10).alias("r")).where("r between 0 and 9").agg(F.count("*").alias("n")))
P.sql("random_call", "SELECT count(*) AS n FROM (SELECT random(5) AS r FROM orders) x WHERE r >= 0 AND r < 5", "SELECT count(*) AS n FROM orders")

# order and limits
P.sql("order_by_asc", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey")
P.sql("order_by_desc_nulls", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer ORDER BY seg DESC NULL FIRST, c_custkey", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer ORDER BY seg DESC NULLS FIRST, c_custkey")
P.sql("order_by_alias", "SELECT s_suppkey AS k, s_acctbal AS bal FROM supplier ORDER BY bal DESC, k")
P.sql("nulls_last_by_default", "SELECT c_custkey, nullif(c_nationkey, 3) AS nk FROM customer ORDER BY nk, c_custkey", "SELECT c_custkey, nullif(c_nationkey, 3) AS nk FROM customer ORDER BY nk NULLS LAST, c_custkey")
P.frame("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")(lambda t: sorting.top(t("orders").select("o_orderkey", "o_totalprice"), 10, sorting.key("o_totalprice", descending=True), sorting.key("o_orderkey")))
P.frame("limit_only", "SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 37) x")(lambda t: sorting.limit(t("orders"), 37).agg(F.count("*").alias("n")))
