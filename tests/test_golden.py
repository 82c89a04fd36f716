"""Expected values of the mini TPC-H rows and of the generated fixtures."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import ipv4, scalar
from millrace.functions.registry import FunctionError, builtins
from millrace.operators import aggregates, joins, layout, setops, sorting
from millrace.session import Warehouse
from millrace.types import SchemaError, promoted, schema_of

LINEITEM = [(1, 1, 7706, 1, 17.0, 21168.23, 0.04, 0.02, "N", "O", "1996-03-13"), (1, 1, 7311, 2, 36.0, 45983.16, 0.09, 0.06, "N", "O", "1996-04-12"), (2, 2, 1191, 1, 38.0, 44694.46, 0.0, 0.05, "N", "O", "1997-01-28"), (3, 2, 1798, 1, 45.0, 54058.05, 0.06, 0.0, "R", "F", "1994-02-02"), (3, 3, 6540, 2, 49.0, 46796.47, 0.1, 0.0, "R", "F", "1993-11-09")]
COLUMNS = "l_orderkey bigint, l_partkey int, l_suppkey int, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"


@pytest.fixture(scope="module")
def w(spark, tmp_path_factory):
    w = Warehouse(spark, str(tmp_path_factory.mktemp("wh")))
    w.catalog.register("lineitem", spark.createDataFrame(LINEITEM, COLUMNS))
    score = [(f"test{i % 10}", i + 1, i + 1900) for i in range(100)]
    w.catalog.register("score", spark.createDataFrame(score, "deptname string, score int, year int"))
    w.catalog.register("dept", spark.createDataFrame([(i, f"test{i}", i + 1900) for i in range(10)], "id int, deptname string, since int"))
    return w


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("select distinct l_orderkey, l_linenumber from lineitem", 5),
        ("select distinct l_orderkey from lineitem", 3),
        ("select * from lineitem where l_shipdate <= '1996-03-22'", 3),
        ("select l_orderkey, l_partkey, count(*) as n from lineitem group by cube(l_orderkey, l_partkey)", 11),
        ("select l_orderkey, sum(l_partkey) as s from lineitem group by l_orderkey limit 2", 2),
        ("select deptname, max(score) as m from score group by deptname", 10),
        ("select deptname, since, year from dept natural join score", 100),
    ],
)
def test_counts(w, text, want):
    assert w.sql(text).count() == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("select count(*) + max(l_orderkey) as v from lineitem", 8),
        ("select max(l_orderkey) as v from lineitem", 3),
        ("select min(l_orderkey) as v from lineitem", 1),
        ("select avg(l_partkey) as v from lineitem", 1.8),
        ("select round(sum(l_extendedprice * l_discount), 0) as v from lineitem", 12908.0),
        ("select count(*) as v from lineitem where l_returnflag = 'N' and l_linestatus = 'O'", 3),
        ("select sum(score) as v from score where deptname = 'test3'", sum(range(4, 101, 10))),
    ],
)
def test_values(w, text, want):
    assert w.sql(text).first()["v"] == pytest.approx(want)


def test_order_and_averages(w):
    assert [r[0] for r in w.sql("select l_orderkey from lineitem order by l_orderkey limit 3").collect()] == [1, 1, 2]
    got = w.sql("select l_orderkey, round(avg(l_discount), 4) as a from lineitem group by l_orderkey order by l_orderkey").collect()
    assert [r["a"] for r in got] == [0.065, 0.0, 0.08]


def test_nulls_aggregates_and_outer_joins(spark):
    df = spark.createDataFrame([(1, None), (2, -5), (3, -7)], "k int, v int")
    got = aggregates.group(df, [], F.max("v").alias("m"), F.count("v").alias("n"), F.sum("v").alias("s")).first()
    assert tuple(got) == (-5, 2, -12)
    assert [r["v"] for r in sorting.order(df, sorting.key("v", descending=True)).collect()] == [-5, -7, None]
    assert [r["v"] for r in sorting.order(df, sorting.key("v", nulls_first=True)).collect()] == [None, -7, -5]
    other = spark.createDataFrame([(None, 1), (3, 2)], "kk int, z int")
    assert joins.join(df, other, F.col("k") == F.col("kk"), "full").count() == 4
    assert joins.union_join(df, other).count() == 5
    with pytest.raises(joins.JoinError):
        joins.natural(df, df.select(F.col("k").cast("string").alias("k")))
    with pytest.raises(setops.SetError):
        setops.union(df, other.select("z"))


def test_joins_of_generated_pairs(spark):
    outer = spark.range(50).select(F.col("id").alias("a"))
    inner = spark.range(1, 50, 2).select(F.col("id").alias("b"))
    assert joins.cross(outer, inner).count() == 1250
    for strategy in (None, *joins.STRATEGIES):
        assert joins.join(outer, inner, F.col("a") == F.col("b"), strategy=strategy).count() == 25


def test_types_and_promotion(spark):
    assert promoted("int", "float") == "float" and promoted("float", "float") == "double" and promoted("bigint", "float") == "double" and promoted("int", "bigint") == "bigint"
    with pytest.raises(SchemaError):
        schema_of([("a", "int"), ("A", "int")])
    with pytest.raises(SchemaError):
        schema_of([("a", "interval")])
    df = spark.createDataFrame([(7, 2, 1.5)], "a int, b int, c double")
    got = df.select(scalar.arithmetic(df, "a", "/", "b").alias("q"), scalar.arithmetic(df, "a", "%", "b").alias("r"), scalar.arithmetic(df, "a", "*", "c").alias("p")).first()
    assert tuple(got) == (3, 1, 10.5)


def test_addresses(spark):
    df = spark.createDataFrame([("10.0.0.1",), ("255.255.255.255",), ("256.1.1.1",), ("x",), (None,)], "t string")
    got = df.select(ipv4.pack(F.col("t")).alias("p")).withColumn("u", ipv4.unpack(F.col("p"))).withColumn("m", ipv4.matches_subnet(F.col("p"), "10.0.0.0", 8)).collect()
    assert [tuple(r) for r in got] == [(167772161, "10.0.0.1", True), (4294967295, "255.255.255.255", False), (None, None, None), (None, None, None), (None, None, None)]


def test_functions_resolve_by_type(spark):
    r = builtins()
    df = spark.createDataFrame([(1, 2.0), (3, 4.0)], "i int, d double")
    assert tuple(df.agg(r.call(df, "sum", "i").alias("a"), r.call(df, "avg", "d").alias("b"), r.call(df, "count").alias("c")).first()) == (4, 3.0, 2)
    with pytest.raises(FunctionError):
        r.resolve("sum", ["string"])
    with pytest.raises(FunctionError):
        r.scalar("random", ["int"], "int", lambda n: n)
    r.drop("random", ["int"])
    with pytest.raises(FunctionError):
        r.resolve("random", ["int"])


def test_indexes(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    w.catalog.register("t1", spark.range(1000).select(F.col("id").alias("a"), (F.col("id") % 10).alias("b")))
    w.sql("create unique index ia on t1 using bst (a); create index iab on t1 using hash (a, b)")
    assert layout.chosen(w.catalog.indexes("t1"), {"a", "b", "c"}).name == "iab"
    assert [tuple(r) for r in w.catalog.find("t1", a=42).collect()] == [(42, 2)]
    assert w.catalog.find("t1", b=3).count() == 100
    assert layout.load(spark, w.catalog.indexes("t1")[0].path).unique
    with pytest.raises(layout.IndexingError):
        w.sql("create unique index ib on t1 using bst (b)")
    w.sql("drop index ia")
    assert len(w.catalog.indexes("t1")) == 1


def test_indexes_follow_their_table(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    w.sql("ix1 := select id as a, id % 10 as b from range(100); create unique index ia on ix1 using bst (a desc null first) with ('ranges' = '2'); create index ib on ix1 using btree (b)")
    w.sql("insert into ix1 values (1000, 3), (null, 3)")
    assert rows(w.catalog.find("ix1", a=1000)) == [(1000, 3)] and w.catalog.find("ix1", b=3).count() == 12
    got = w.sql("select a from ix1 where b = 3 and a > 50")
    assert "/ix1.index/ib" in got.inputFiles()[0] and got.count() == 6
    assert "/ix1.index/" not in w.sql("select a from ix1 where b = 3 or a = 1").inputFiles()[0]
    for text in ("insert into ix1 values (1000, 4)", "insert into ix1 values (2000, 4), (2000, 5)"):
        with pytest.raises(layout.IndexingError):
            w.sql(text)
    assert w.sql("select count(*) as n from ix1").first()[0] == 102 and w.catalog.get("ix1").stats["rows"] == 102
    assert w.catalog.get("ix1").stats["columns"]["a"] | {"ndv": 0} == {"nulls": 1, "min": "0", "max": "1000", "ndv": 0}
    path = w.catalog.get("ix1").path
    w.sql("detach ix1")
    other = Warehouse(spark, str(tmp_path / "elsewhere"))
    other.sql(f"attach again '{path}'")
    ia = next(i for i in other.catalog.indexes("again") if i.name == "ia")
    assert ia.keys == (layout.Key("a", True, True),) and ia.options == {"ranges": "2"} and ia.unique
    assert rows(other.sql("select again.a, b from again where again.a = 1000")) == [(1000, 3)]
    files_ = [[r[0] for r in spark.read.parquet(f).collect()] for f in spark.read.parquet(ia.path).inputFiles()]
    assert all(x == sorted(x, key=lambda v: (v is not None, -(v or 0))) for x in files_)
    other.sql("drop table again")
    assert other.catalog.indexes() == [] and not (tmp_path / "ix1.index" / "ia").exists()
    other.sql("again := select 1 as a, 2 as b")
    assert rows(other.catalog.find("again", a=1)) == [(1, 2)] and other.catalog.find("again", a=1000).isEmpty()


def test_delimited_text_that_would_break_rows(spark, tmp_path):
    from millrace.sources import files

    schema = schema_of([("a", "int"), ("b", "string")])
    rows = [(1, "a|b"), (2, "x\ny"), (3, "\\n\\"), (4, "\\\n|\r"), (5, None)]
    df = spark.createDataFrame(rows, schema)
    files.write(df, str(tmp_path / "escaped"), "csv", {files.ESCAPE: "\\"})
    assert sorted(map(tuple, files.read(spark, str(tmp_path / "escaped"), "csv", schema, {files.ESCAPE: "\\"}).collect())) == rows
    with pytest.raises(Exception, match="csvfile.escape"):
        files.write(df, str(tmp_path / "plain"), "csv")


def test_all_types_through_every_format(spark, tmp_path):
    from millrace.sources import files

    schema = schema_of([("a", "bool"), ("b", "byte"), ("c", "char"), ("d", "short"), ("e", "int"), ("f", "long"), ("g", "float"), ("h", "double"), ("i", "string"), ("j", "bytes"), ("k", "ipv4")])
    rows = [(True, bytearray(b"\x07"), "x", 1, 2, 3, 4.5, 5.5, "täxt", bytearray(b"\x00\xff"), 167772161), (None,) * 11]
    df = spark.createDataFrame(rows, schema)
    for fmt in ("csv", "parquet", "orc", "raw", "rcfile"):
        files.write(df, str(tmp_path / fmt), fmt)
        assert sorted(map(tuple, files.read(spark, str(tmp_path / fmt), fmt, schema).collect()), key=str) == sorted(rows, key=str)


def test_stream_appends_new_files_once(spark, tmp_path):
    from millrace.streaming import ingest

    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(5).write.parquet(src)
    schema = spark.read.parquet(src).schema
    for want in (5, 5, 8):
        if want == 8:
            spark.range(3).write.mode("append").parquet(src)
        ingest.append_available(ingest.stream(spark, src, schema), out, str(tmp_path / "ck"))
        assert spark.read.parquet(out).count() == want


def test_windowed_counts_of_a_stream(spark, tmp_path):
    from millrace.streaming import ingest

    src = str(tmp_path / "src")
    rows = [("2024-01-01 10:05:00", "a"), ("2024-01-01 10:55:00", "a"), ("2024-01-01 11:05:00", "a"), ("2024-01-01 10:10:00", "b"), ("2024-01-01 20:00:00", "b")]
    spark.createDataFrame(rows, "t string, k string").select(F.col("t").cast("timestamp").alias("t"), "k").write.parquet(src)
    counts = ingest.windowed_counts(ingest.stream(spark, src, spark.read.parquet(src).schema), "t", "k")
    counts.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = sorted((str(r["window_start"])[11:13], r["k"], r["n"]) for r in spark.table("windowed").collect())
    assert got == [("10", "a", 2), ("10", "b", 1), ("11", "a", 1), ("20", "b", 1)]
