"""The 22 TPC-H questions, restated over the columns that the supplied tables have.

Tables without partsupp take the distinct (part, supplier) pairs of lineitem; dates are moved to
the range of the data. Sums are rounded to cents on both sides.
"""

from __future__ import annotations

from millrace.plans.base import Plans

P = Plans()
_NET = "l_extendedprice * (1 - l_discount)"
_PAIRS = "(SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem) ps"

P.sql("q01", f"""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum({_NET}), 2) AS sum_disc_price, round(sum({_NET} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty,
  round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= timestamp '2001-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")
P.sql("q02", f"""
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand
FROM part, supplier, {_PAIRS}, nation, region
WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size < 10 AND p_type = 'PROMO' AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""")
P.sql("q03", f"""
SELECT l_orderkey, round(sum({_NET}), 2) AS revenue, o_orderdate
FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
  AND o_orderdate < timestamp '1998-03-15 00:00:00' AND l_shipdate > timestamp '1998-03-15 00:00:00'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
P.sql("q04", """
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= timestamp '1997-07-01 00:00:00' AND o_orderdate < timestamp '1997-10-01 00:00:00'
  AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)
GROUP BY o_orderpriority ORDER BY o_orderpriority""")
P.sql("q05", f"""
SELECT n_name, round(sum({_NET}), 2) AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
  AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
  AND o_orderdate >= timestamp '1997-01-01 00:00:00' AND o_orderdate < timestamp '1998-01-01 00:00:00'
GROUP BY n_name ORDER BY revenue DESC, n_name""")
P.sql("q06", """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= timestamp '1997-01-01 00:00:00' AND l_shipdate < timestamp '1998-01-01 00:00:00'
  AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""")
P.sql("q07", f"""
SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue
FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, {_NET} AS volume
  FROM supplier, lineitem, orders, customer, nation n1, nation n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
    AND (n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2' OR n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')) shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""")
P.sql("q08", f"""
SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share
FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, {_NET} AS volume, n2.n_name AS nation
  FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
    AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type = 'ECONOMY') all_nations
GROUP BY o_year ORDER BY o_year""")
P.sql("q09", f"""
SELECT nation, o_year, round(sum(amount), 2) AS sum_profit
FROM (SELECT n_name AS nation, CAST(year(o_orderdate) AS BIGINT) AS o_year, {_NET} - 0.5 * p_retailprice AS amount
  FROM part, supplier, lineitem, orders, nation
  WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_brand LIKE 'Brand#1%') profit
GROUP BY nation, o_year ORDER BY nation, o_year DESC""")
P.sql("q10", f"""
SELECT c_custkey, c_name, round(sum({_NET}), 2) AS revenue, c_acctbal, n_name
FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= timestamp '1997-10-01 00:00:00'
  AND o_orderdate < timestamp '1998-01-01 00:00:00' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
_PAIRS_7 = f"{_PAIRS}, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7'"
P.sql("q11", f"""
SELECT ps_partkey, count(*) AS suppliers FROM {_PAIRS_7}
GROUP BY ps_partkey HAVING count(*) > (SELECT count(*) * 1.3 / count(DISTINCT ps_partkey) FROM {_PAIRS_7}) ORDER BY suppliers DESC, ps_partkey""")
P.sql("q12", """
SELECT l_linestatus, sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS high_line_count,
  sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS low_line_count
FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate >= timestamp '1997-01-01 00:00:00' AND l_shipdate < timestamp '1998-01-01 00:00:00'
GROUP BY l_linestatus ORDER BY l_linestatus""".replace("sum(CASE", "CAST(sum(CASE").replace("0 END)", "0 END) AS BIGINT)"))
P.sql("q13", """
SELECT c_count, count(*) AS custdist
FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '5-LOW' GROUP BY c_custkey) c_orders
GROUP BY c_count ORDER BY custdist DESC, c_count DESC""")
P.sql("q14", f"""
SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_NET} ELSE 0 END) / sum({_NET}), 4) AS promo_revenue
FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= timestamp '1997-09-01 00:00:00' AND l_shipdate < timestamp '1997-10-01 00:00:00'""")
P.sql("q15", f"""
WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum({_NET}), 2) AS total_revenue FROM lineitem
  WHERE l_shipdate >= timestamp '1997-01-01 00:00:00' AND l_shipdate < timestamp '1997-04-01 00:00:00' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue
WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""")
P.sql("q16", f"""
SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM {_PAIRS}, part
WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""")
P.sql("q17", """
SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part
WHERE p_partkey = l_partkey AND p_brand = 'Brand#3' AND p_type = 'MEDIUM'
  AND l_quantity < (SELECT 0.2 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)""")
P.sql("q18", """
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS qty
FROM customer, orders, lineitem
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""")
P.sql("q19", f"""
SELECT round(sum({_NET}), 2) AS revenue FROM lineitem, part
WHERE p_partkey = l_partkey AND (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5
  OR p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10
  OR p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)""")
P.sql("q20", f"""
SELECT s_name, s_suppkey FROM supplier, nation
WHERE s_suppkey IN (SELECT ps_suppkey FROM {_PAIRS} WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')
    AND 10 < (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= timestamp '1997-01-01 00:00:00'))
  AND s_nationkey = n_nationkey AND n_regionkey < 3 ORDER BY s_name""")
P.sql("q21", """
SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation
WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate
  AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
  AND s_nationkey = n_nationkey AND n_regionkey = 1
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""")
P.sql("q22", """
SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
WHERE c_nationkey IN (13, 11, 23, 9, 10, 18, 17) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.0)
  AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)
GROUP BY c_nationkey ORDER BY c_nationkey""")
# The simple scan and group set.
P.sql("scan_filter_project", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey > 1000 AND l_quantity < 5")
P.sql("group_scan", "SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_suppkey")
