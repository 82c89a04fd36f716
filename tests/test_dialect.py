import pytest
from pyspark.sql import functions as F

from millrace import dialect
from millrace.functions.registry import FunctionError
from millrace.operators import layout
from millrace.session import Warehouse, typer


def sql(text, **options):
    return dialect.rewrite(dialect.tokens(text), **options)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("select a from t where a ~= 1 and b ^= 2", "select a from t where a <> 1 and b <> 2"),
        ("select a // note\n from t /* x */", "select a from t"),
        ("select a from t order by a", "select a from t order by a nulls last"),
        ("select a from t order by a desc null first, f(b, c) asc limit 3", "select a from t order by a desc nulls first , f ( b , c ) asc nulls last limit 3"),
        ("select count(*) from t group by ()", "select count ( * ) from t group by grouping sets ( ( ) )"),
        ("select * from a union join b where x = 1", "select * from a full outer join b on false where x = 1"),
        ("select random(10) as r", "select cast ( floor ( rand ( ) * ( 10 ) ) as int ) as r"),
        ("select 'it\\'s ; \"x\"'", "select 'it\\'s ; \"x\"'"),
        ("select '\\u0041\\n'", "select 'A\n'"),
    ],
)
def test_rewriting(text, want):
    assert sql(text) == want


def test_division_of_integers(spark):
    spark.createDataFrame([(7, 2, 7.5)], "a int, b bigint, x double").createOrReplaceTempView("div1")
    spark.createDataFrame([(7.5,)], "a double").createOrReplaceTempView("div2")
    one = lambda text, **options: tuple(spark.sql(sql(text, types=typer(spark), **options)).first())
    assert one("select a / 2, (a + b) / b, t.a / b, a / 2.0, x / 2, 7 / 2, 7 / 2.0 from div1 t") == (3, 4, 3, 3.5, 3.75, 3, 3.5)
    assert one("select a / 2 from div2") == (3.75,)
    assert one("select 2.5 * a / b, x * a / b, a / b * x, a * b / 4 / 2, -a / b from div1")[1:] == (26.25, 22.5, 1, -3)
    assert one("select q / 2, y / 2 from (select a / b as q, a / x as y from div1) s") == (1, 7 / 7.5 / 2)
    assert one("with s as (select a / b as q from div1) select q / 2 from s where exists (select 1 from div2 where s.q / 2 = 1)") == (1,)
    assert one("select sum(a) / count(*), sum(x) / count(*), a / max(b) from div1 group by a") == (7, 7.5, 3)
    assert one("select case when a > 1 then a else b end / 2 as c from div1 union all select 9 / 2 from div2 order by c") == (3,)


def test_functions_in_queries(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    w.catalog.register("fn1", spark.createDataFrame([(3, "x"), (4, "y")], "a int, s string"))
    w.functions.scalar("plus", ["int", "int"], "int", lambda a, b: a + b)
    w.functions.scalar("plus", ["string", "string"], "string", lambda a, b: F.concat(a, b))
    w.functions.aggregate("range_of", ["int"], "int", lambda c: {"lo": F.min(c), "hi": F.max(c)}, lambda lo, hi: hi - lo)
    assert [tuple(r) for r in w.sql("select plus(a, plus(a, 1)) as p, plus(s, 'z') as q, plus(a, 1) / 2 as h from fn1 where plus(a, 0) > 3").collect()] == [(9, "yz", 2)]
    assert w.sql("select range_of(a) as r from fn1 having range_of(a) < 2").first()[0] == 1
    with pytest.raises(FunctionError):
        w.sql("select plus(s, a) as p from fn1")
    with pytest.raises(dialect.DialectError):
        w.sql("select plus(nothing, a) as p from fn1")


def test_union_join_and_like(spark):
    got = sql("select * from a union join (select b / 2 as c from t) as x where c = 1")
    assert got == "select * from a full outer join ( select b / 2 as c from t ) as x on false where c = 1"
    assert sql("select * from a union join d.b x join c on x.k = c.k") == "select * from a full outer join d . b x on false join c on x . k = c . k"
    for text in ("select a like b", "select a like 'x' || b", "select a like concat('x', b)"):
        with pytest.raises(dialect.DialectError):
            sql(text, strict_like=True)


def test_equalities_of_one_table():
    of = lambda text: dialect.equalities(dialect.tokens(text))
    assert of("select a from t x where x.a = 3 and b = 'y' and c > 2 order by a") == (3, {"a": "3", "b": "'y'"})
    for text in ("select a from t where a = 3 or b = 1", "select a from t, u where a = 3", "select a from t join u on b = c where a = 3", "select a from t where a = 3 union select 1", "select a from (select 1 as a) x where a = 1", "select a from t"):
        assert of(text) is None


def test_like_of_the_dialect():
    assert sql("select a like 'x?%'", strict_like=True) == "select a rlike '(?is)^(?:x..*)$'"
    assert sql("select a not like 'a.b'", strict_like=True) == "select a not rlike '(?is)^(?:a\\\\.b)$'"
    assert sql("select a like 'x?%'") == "select a like 'x?%'"


def test_statements_are_parsed():
    parse = lambda text: dialect.parse(dialect.tokens(text))
    s = parse("create table T (Id long, name string) using csv location '/x' with ('csvfile.delimiter'=',')")
    assert (s.kind, s.name, s.columns, s.fmt, s.location, s.options) == ("create", "t", [("id", "long"), ("name", "string")], "csv", "/x", {"csvfile.delimiter": ","})
    s = parse("create unique index i on t using bst (a asc null first, b desc)")
    assert (s.kind, s.unique, s.table, s.method, s.keys) == ("create_index", True, "t", "bst", [layout.Key("a", False, True), layout.Key("b", True)])
    assert parse("x := select 1").kind == "create_as"
    assert parse("\\d t").kind == parse("desc t").kind == parse("show table t").kind == "describe"
    assert parse("\\t").kind == "show_tables" and parse("\\f").kind == "show_functions"
    assert parse("attach t /a/b").location == "/a/b"


@pytest.mark.parametrize("text", ["session clear", "set union t", "frobnicate", "create table t (a int)", "select 'open", "drop table"])
def test_bad_statements_are_refused(text):
    with pytest.raises(dialect.DialectError):
        dialect.parse(dialect.tokens(text))


def test_session_end_to_end(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "wh"), strict_like=True)
    (tmp_path / "in.csv").write_text("1|filled|\n2||\n 3 | filled |extra\n")
    w.sql(f"create table nulltable (col1 int, col2 string) using csv location '{tmp_path}/in.csv'")
    rows = w.sql("select * from nulltable order by col2, col1").collect()
    assert [tuple(r) for r in rows] == [(1, "filled"), (3, "filled"), (2, None)]
    assert w.sql("select col1 from nulltable where col2 is null").first()[0] == 2
    assert [r[0] for r in w.sql("select col1 / 2 as h from nulltable order by h").collect()] == [0, 1, 1]
    assert w.sql("select count(*) as n from nulltable where col2 like 'F?LL%'").first()[0] == 2
    w.sql("copy1 := select col1, col2 from nulltable where col1 > 1")
    assert {r[0] for r in w.sql("show tables").collect()} == {"nulltable", "copy1"}
    assert [tuple(r) for r in w.sql("desc copy1").collect()] == [("col1", "int"), ("col2", "string")]
    path = w.catalog.get("copy1").path
    assert w.catalog.get("copy1").stats["rows"] == 2
    w.sql("detach copy1")
    other = Warehouse(spark, str(tmp_path / "wh"))
    other.sql(f"attach again {path}")
    assert other.sql("select count(*) as n from again").first()[0] == 2
    other.sql("drop table again")
    assert not (tmp_path / "wh" / "copy1").exists()
    assert w.sql("\\f").count() > 20 and w.sql("\\c").count() == 1
