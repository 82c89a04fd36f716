"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import joins, setops
from millrace.plans.base import Plans

P = Plans()

P.sql("join_inner_on", "SELECT n_name, r_name FROM nation INNER JOIN region ON n_regionkey = r_regionkey")
P.sql("join_comma", "SELECT c_name, n_name FROM customer, nation WHERE c_nationkey = n_nationkey AND c_acctbal > 5000")
_NAMED = "(SELECT s_nationkey AS nk, s_suppkey FROM supplier) a", "(SELECT n_nationkey AS nk, n_name FROM nation) b"
P.frame("join_natural", f"SELECT nk, s_suppkey, n_name FROM {_NAMED[0]} NATURAL JOIN {_NAMED[1]}")(lambda t: joins.natural(t("supplier").select(F.col("s_nationkey").alias("nk"), "s_suppkey"), t("nation").select(F.col("n_nationkey").alias("nk"), "n_name")))
P.sql("join_natural_left", f"SELECT nk, s_suppkey, n_name FROM {_NAMED[1]} NATURAL LEFT JOIN {_NAMED[0]}")
P.frame("join_using", f"SELECT nk, s_suppkey, n_name FROM {_NAMED[0]} JOIN {_NAMED[1]} USING (nk)")(lambda t: joins.using(t("supplier").select(F.col("s_nationkey").alias("nk"), "s_suppkey"), t("nation").select(F.col("n_nationkey").alias("nk"), "n_name"), ["nk"]))
P.frame("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region")(lambda t: joins.cross(t("nation").select("n_name"), t("region").select("r_name")))
P.sql("join_cross_where", "SELECT n_name, r_name FROM nation CROSS JOIN region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'")
P.sql("join_left", "SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT OUTER JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 40")
P.sql("join_right", "SELECT o_orderkey, o_custkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 300000) o RIGHT OUTER JOIN customer ON o_custkey = c_custkey")
P.sql("join_full", "SELECT o_orderkey, o_custkey, c_custkey, c_name FROM orders FULL OUTER JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'F'")
P.frame("join_union", "SELECT n_name, r_name FROM nation FULL OUTER JOIN region ON false")(lambda t: joins.union_join(t("nation").select("n_name"), t("region").select("r_name")))
P.sql("join_union_text", "SELECT n_name, r_name FROM nation UNION JOIN region", "SELECT n_name, r_name FROM nation FULL OUTER JOIN region ON false")
P.sql("union_join_subquery", "SELECT n_name, x.name FROM nation UNION JOIN (SELECT r_name AS name FROM region WHERE r_regionkey > 1) AS x", "SELECT n_name, x.name FROM nation FULL OUTER JOIN (SELECT r_name AS name FROM region WHERE r_regionkey > 1) x ON false")
P.sql("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
P.sql("join_theta_only", "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON r_regionkey > n_nationkey")
P.sql("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a, supplier b WHERE a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
P.sql("join_multiway", "SELECT r_name, count(*) AS n FROM region, nation, customer, orders WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey AND c_custkey = o_custkey GROUP BY r_name")
_CUSTOMER_ORDERS = "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"


def _customer_orders(strategy):
    return lambda t: joins.join(t("orders").select("o_orderkey", "o_custkey"), t("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), strategy=strategy).select("o_orderkey", "c_name")


# Catalyst broadcasts a side that its size estimate shows to be below the threshold.
P.frame("join_broadcast", _CUSTOMER_ORDERS)(_customer_orders(None))
P.frame("join_sort_merge", _CUSTOMER_ORDERS)(_customer_orders("merge"))
P.frame("join_shuffle_hash", _CUSTOMER_ORDERS)(_customer_orders("hash"))
P.frame("join_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")(lambda t: joins.join(t("orders"), t("lineitem").where("l_quantity > 49"), F.col("l_orderkey") == F.col("o_orderkey"), "semi").select("o_orderkey"))
P.frame("join_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")(lambda t: joins.join(t("orders"), t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "anti").select("o_orderkey"))
P.sql("join_expr_case", "SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN 'in' ELSE 'out' END AS side FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000")
P.sql("subquery_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
P.sql("subquery_scalar", "SELECT s_suppkey FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)")
P.sql("subquery_from", "SELECT status, n FROM (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus) x WHERE n > 10")

# sets
_A = "SELECT n_regionkey AS k FROM nation"
_B = "SELECT r_regionkey AS k FROM region WHERE r_regionkey > 1"
_a = lambda t: t("nation").select(F.col("n_regionkey").alias("k"))
_b = lambda t: t("region").where("r_regionkey > 1").select(F.col("r_regionkey").alias("k"))
P.frame("union_all", f"{_A} UNION ALL {_B}")(lambda t: setops.union_all(_a(t), _b(t)))
P.frame("union_distinct", f"{_A} UNION {_B}")(lambda t: setops.union(_a(t), _b(t)))
P.frame("intersect", f"{_A} INTERSECT {_B}")(lambda t: setops.intersect(_a(t), _b(t)))
P.frame("intersect_all", f"{_A} INTERSECT ALL {_B}")(lambda t: setops.intersect(_a(t), _b(t), all_rows=True))
P.frame("except", f"{_A} EXCEPT {_B}")(lambda t: setops.subtract(_a(t), _b(t)))
P.frame("except_all", f"{_A} EXCEPT ALL {_B}")(lambda t: setops.subtract(_a(t), _b(t), all_rows=True))
P.sql("set_precedence", f"SELECT 100 AS k UNION {_A} INTERSECT {_B}")
