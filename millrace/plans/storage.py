"""Tables written and read back: formats, layouts, CTAS and lookups.

Results go to scratch folders in the shared folder that the session names."""

from __future__ import annotations

import re
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import layout
from millrace.operators.scan import parquet
from millrace.plans.base import Plans
from millrace.session import Warehouse
from millrace.sources import files
from millrace.types import schema_of

P = Plans()


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder; only where the session names none, and runs in one process, in a
    temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    path = f"{base}/millrace/{label}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def _warehouse(spark: SparkSession, label: str) -> Warehouse:
    return Warehouse(spark, scratch(spark, label))


def ctas_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, name = _warehouse(spark, "ctas"), f"t_{uuid.uuid4().hex}"
    w.catalog.register(f"o_{name}", parquet(spark, sf_dir, "orders"))
    return w.sql(f"{name} := select o_custkey, count(*) as n from o_{name} group by o_custkey; select * from {name}")


def ctas_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, name = _warehouse(spark, "insert"), f"t_{uuid.uuid4().hex}"
    w.catalog.register(f"r_{name}", parquet(spark, sf_dir, "region"))
    return w.sql(f"create table {name} as select r_regionkey, r_name from r_{name}; insert into {name} select r_regionkey + 10, r_name from r_{name}; insert into {name} values (99, 'x'); select * from {name}")


def _roundtrip(fmt: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, source = scratch(spark, fmt), parquet(spark, sf_dir, "customer")
        schema = schema_of([("c_custkey", "long"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")])
        source = source.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
        files.write(source, path, fmt, {"csvfile.delimiter": "|"})
        return files.read(spark, path, fmt, schema, {"csvfile.delimiter": "|"})

    return run


def typed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bytes and addresses through text and back."""
    schema = schema_of([("id", "long"), ("raw", "bytes"), ("ip", "ipv4"), ("ok", "bool")])
    source = parquet(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").cast("binary").alias("raw"), (F.col("s_suppkey") + 167772160).alias("ip"), (F.col("s_nationkey") > 12).alias("ok"))
    source = source.select(*[F.col(f.name).alias(f.name, metadata=f.metadata) for f in schema])
    path = scratch(spark, "typed")
    files.write(source, path, "csv")
    return files.read(spark, path, "csv", schema).select("id", F.col("raw").cast("string").alias("raw"), "ip", "ok")


def hash_partitioned_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "hash")
    layout.hash_partitioned(parquet(spark, sf_dir, "orders"), path, ["o_custkey"], 8)
    return spark.read.parquet(path).select("o_custkey", F.input_file_name().alias("file")).groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


def range_partitioned_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "range")
    layout.range_partitioned(parquet(spark, sf_dir, "orders"), path, ["o_orderkey"], 6)
    return spark.read.parquet(path).select("o_orderkey", "o_totalprice")


def _named(text: str, *tables: str, then=None):
    """A script through ``Warehouse.sql``, in a warehouse of its own: $T is a name of its own, and a
    table's name stands for it. ``then`` gets (warehouse, name) in place of the last statement's rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        w, name = _warehouse(spark, "script"), f"t_{uuid.uuid4().hex}"
        for t in tables:
            w.catalog.register(f"{t}_{name}", parquet(spark, sf_dir, t))
        script = re.sub(r"\b(" + "|".join(tables) + r")\b", rf"\1_{name}", text) if tables else text
        out = w.sql(script.replace("$T", name).replace("$DIR", scratch(spark, "data")))
        return then(w, name) if then else out

    return run


def _reattached(w: Warehouse, name: str) -> DataFrame:
    """Rows through the index, in a new session that attaches the table."""
    path = w.catalog.get(name).path
    w.sql(f"detach {name}")
    other = Warehouse(w.spark, w.catalog.warehouse)
    other.sql(f"attach {name} '{path}'")
    return other.sql(f"select k, v from {name} where k = 7")


def sql_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User functions of two overloads, a pandas one and an aggregate, and packed addresses, in one query."""

    def twice(x):
        return x * 2

    twice.__annotations__ = {"x": pd.Series, "return": pd.Series}
    w, name = _warehouse(spark, "udf"), f"u_{uuid.uuid4().hex}"
    w.catalog.register(name, parquet(spark, sf_dir, "supplier"))
    w.functions.scalar("tag", ["long"], "string", lambda k: F.concat(F.lit("n"), k.cast("string")))
    w.functions.scalar("tag", ["string"], "string", lambda s: F.concat(F.lit("s"), F.upper(s)))
    w.functions.pandas_scalar("twice", ["double"], "double", twice)
    w.functions.aggregate("spread", ["double"], "double", lambda c: {"lo": F.min(c), "hi": F.max(c)}, lambda lo, hi: hi - lo)
    return w.sql(f"""select tag(s_nationkey) as a, tag(min(s_name)) as b, round(sum(twice(s_acctbal)), 2) as c, round(spread(s_acctbal), 2) as d,
        ipv4_unpack(167772160 + s_nationkey) as ip, ipv4_pack('10.0.0.9') as packed from {name} group by s_nationkey""")


_LINES = "create table $T as select l_orderkey as k, l_partkey as v, l_linenumber as n from lineitem; create index i_$T on $T using bst (k desc null first) with ('ranges' = '3')"
SCRIPTS = {
    "index_lookup": (_named(f"{_LINES}; select k, v, n from $T where k = 33 and n > 1", "lineitem"), "SELECT l_orderkey AS k, l_partkey AS v, l_linenumber AS n FROM lineitem WHERE l_orderkey = 33 AND l_linenumber > 1"),
    "index_insert": (_named(f"{_LINES}; insert into $T values (33, -1, 0), (-5, 1, 1); select x.k, v, n from $T x where x.k = 33", "lineitem"), "SELECT l_orderkey AS k, l_partkey AS v, l_linenumber AS n FROM lineitem WHERE l_orderkey = 33 UNION ALL SELECT 33, -1, 0"),
    "index_drop_table": (_named(f"{_LINES}; drop table $T; create table $T as select 33 as k, 1 as v; select k, v from $T where k = 33", "lineitem"), "SELECT 33 AS k, 1 AS v"),
    "index_persisted": (_named(_LINES, "lineitem", then=_reattached), "SELECT l_orderkey AS k, l_partkey AS v FROM lineitem WHERE l_orderkey = 7"),
    "index_unique": (_named("create table $T as select o_orderkey as k, o_custkey as v from orders; create unique index i_$T on $T using hash (k asc); select k, v from $T where k = 64", "orders"), "SELECT o_orderkey AS k, o_custkey AS v FROM orders WHERE o_orderkey = 64"),
    "sql_int_division_alias": (_named("select q, q / 2 as h, 100.0 * k / (n + 1) as p from (select o_orderkey / 7 as q, o_orderkey as k, o_custkey as n from orders) x", "orders"), "SELECT o_orderkey // 7 AS q, o_orderkey // 7 // 2 AS h, CAST(100.0 AS DOUBLE) * o_orderkey / (o_custkey + 1) AS p FROM orders"),
    "sql_int_division_homonym": (_named("$T := select 7.5 as o_orderkey; select o_orderkey, o_orderkey / 2 as h, sum(o_custkey) / count(*) as m from orders group by o_orderkey", "orders"), "SELECT o_orderkey, o_orderkey // 2 AS h, CAST(sum(o_custkey) // count(*) AS BIGINT) AS m FROM orders GROUP BY o_orderkey"),
    "csv_newline": (_named("create table $T using csv location '$DIR' with ('csvfile.delimiter' = ',') as select c_custkey, concat(c_name, '\\n,\\\\', c_mktsegment, '\\r\\\\n') as note from customer; select * from $T", "customer"), "SELECT c_custkey, c_name || chr(10) || ',' || chr(92) || c_mktsegment || chr(13) || chr(92) || 'n' AS note FROM customer"),
    "create_table_insert": (_named("create table $T (id long, name string, ratio double) using parquet location '$DIR'; insert into $T select r_regionkey, r_name, r_regionkey / 4.0 from region; insert into $T values (9, 'x', 0.5); select * from $T", "region"), "SELECT r_regionkey AS id, r_name AS name, r_regionkey / 4.0 AS ratio FROM region UNION ALL SELECT 9, 'x', 0.5"),
    "drop_and_create": (_named("$T := select 1 as a; drop table $T; $T := select n_name as a from nation; select a from $T", "nation"), "SELECT n_name AS a FROM nation"),
    "attach_detach": (_named("$T := select n_nationkey as k, n_name as v from nation", "nation", then=_reattached), "SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey = 7"),
    "mem_store": (_named("create table $T using mem as select n_nationkey as k, n_name as v from nation; insert into $T values (99, 'x'); select k, v from $T where k > 20", "nation"), "SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey > 20 UNION ALL SELECT 99, 'x'"),
    "show_tables": (_named("$T := select 1 as a; show tables", "region", then=lambda w, name: w.sql("show tables").select(F.regexp_replace("table_name", "_?t_[0-9a-f]+", "").alias("name"))), "SELECT unnest(['', 'region']) AS name"),
    "describe": (_named("$T := select r_regionkey, r_name, cast(r_regionkey as double) as x from region; desc $T", "region"), "SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string'), ('x', 'double')) AS t(column_name, column_type)"),
}
P.queries |= {k: f for k, (f, _) in SCRIPTS.items()} | {"sql_udf": sql_udf, "rcfile_roundtrip": _roundtrip("rcfile")}
P.oracles |= {k: text for k, (_, text) in SCRIPTS.items()} | {
    "sql_udf": """SELECT 'n' || s_nationkey AS a, 's' || upper(min(s_name)) AS b, round(sum(s_acctbal * 2), 2) AS c, round(max(s_acctbal) - min(s_acctbal), 2) AS d,
        '10.0.0.' || s_nationkey AS ip, 167772169 AS packed FROM supplier GROUP BY s_nationkey""",
}
_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer"
P.queries |= {
    "ctas_assign": ctas_assign,
    "ctas_insert": ctas_insert,
    "csv_roundtrip": _roundtrip("csv"),
    "parquet_roundtrip": _roundtrip("parquet"),
    "orc_roundtrip": _roundtrip("orc"),
    "raw_roundtrip": _roundtrip("raw"),
    "typed_csv": typed_csv,
    "hash_partitioned_store": hash_partitioned_store,
    "range_partitioned_store": range_partitioned_store,
}
P.oracles |= {
    "ctas_assign": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey",
    "ctas_insert": "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey + 10, r_name FROM region UNION ALL SELECT 99, 'x'",
    **dict.fromkeys(("csv_roundtrip", "parquet_roundtrip", "orc_roundtrip", "raw_roundtrip", "rcfile_roundtrip"), _CUSTOMER),
    "typed_csv": "SELECT s_suppkey AS id, s_name AS raw, s_suppkey + 167772160 AS ip, s_nationkey > 12 AS ok FROM supplier",
    "hash_partitioned_store": "SELECT o_custkey, count(*) AS n, 1 AS files FROM orders GROUP BY o_custkey",
    "range_partitioned_store": "SELECT o_orderkey, o_totalprice FROM orders",
}
