import json

import pytest

from plumbline.operators import checks, duplicates, rule
from plumbline.operators.table import Table, classify
from plumbline.sources import faults, readers, writers

from .helpers import AS_OF, DATA, found


@pytest.mark.parametrize("path, kind", [
    ("a.csv", "csv"), ("a.PARQUET", "parquet"), ("x/a.pq?v=1", "parquet"), ("a.json#f", "json"), ("a.jsonl", "json"),
    ("noext", "csv"), ("dir.v1/file", "csv"), ("s3://b/a.parquet/", "parquet")])
def test_format_detection(path, kind):
    assert readers.format_of(path) == kind


def test_remote_paths():
    assert readers.is_remote("s3://b/k") and readers.is_remote("https://h/x") and not readers.is_remote("/tmp/x")


def test_csv_null_tokens_and_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c,d\n1,1.5,x,NA\n2,null,N/A,\n3,2,None,NaN\n")
    df = readers.read_file(spark, str(tmp_path / "a.csv"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "string", "string"]
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, 1.5, "x", None), (2, None, None, None), (3, 2.0, None, None)]


def test_json_array_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1}, {"a": 2}], indent=1))
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    for name in ("a.json", "b.jsonl"):
        assert sorted(r["a"] for r in readers.read_file(spark, str(tmp_path / name)).collect()) == [1, 2]


def test_failed_read_raises(spark, tmp_path):
    with pytest.raises(Exception):
        readers.read_file(spark, str(tmp_path / "missing.parquet"))


def test_pages(spark, tmp_path):
    for i in (1, 2):
        page = {"meta": {"n": i}, "data": {"records": [{"Id": i, "Geo": {"Zip-Code": f"z{i}", "in": {"x": i}}}]}}
        (tmp_path / f"p{i}.json").write_text(json.dumps(page))
    df = readers.read_pages(spark, str(tmp_path), "data.records")
    assert sorted(df.columns) == ["geo_in_x", "geo_zip_code", "id"]
    assert sorted(r["id"] for r in df.collect()) == [1, 2]
    assert readers.read_pages(spark, str(tmp_path), "data.nothing.records", max_rows=1).count() == 1


def test_pages_with_different_columns(spark):
    a, b = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int")
    assert sorted(map(tuple, readers.combine_pages([a, b]).collect()), key=str) == [(1, None), (None, 2)]
    with pytest.raises(ValueError):
        readers.combine_pages([])
    with pytest.raises(ValueError):
        readers.combine_pages([a.limit(0)])


def test_jdbc_options():
    options = readers.jdbc_options("PostgreSQL", "h", "d", "u", "p")
    assert options == {"url": "jdbc:postgresql://h:5432/d", "user": "u", "password": "p"}
    split = readers.table_options(options, "t", "id", (1, 100), 4)
    assert (split["dbtable"], split["lowerBound"], split["numPartitions"]) == ("t", "1", "4")
    assert readers.jdbc_options("SQL Server", "h", "d")["url"] == "jdbc:sqlserver://h:1433;databaseName=d"
    with pytest.raises(ValueError):
        readers.jdbc_options("nosuch")
    with pytest.raises(ValueError):
        readers.first_table([])


def test_credentials_are_masked(spark):
    row = readers.describe(spark, "database", "postgresql://u:secret@h/d", password="secret", db="d").first()
    assert "secret" not in str(row) and row["notes"]["db"] == "d"


def test_classification(spark):
    df = spark.sql("SELECT 1 AS n, 'a' AS s, current_date() AS d, true AS b")
    assert {r["column_name"]: r["kind"] for r in classify(df).collect()} == {
        "n": "numeric", "s": "categorical", "d": "datetime", "b": "categorical"}


def test_xml_names_and_nulls(spark, tmp_path):
    path = writers.write_xml(spark.createDataFrame([(1, None), (2, "x")], "`a b` int, `c-d` string").coalesce(1), str(tmp_path / "o.xml"))
    text = next((tmp_path / "o.xml").glob("part*")).read_text()
    assert "<DQCleanedDataset>" in text and "<a_b>1</a_b>" in text and "<c_d>x</c_d>" in text and path.endswith("o.xml")


def test_writers_never_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, ["x"])], "a int, l array<string>")
    writers.write_csv(df, str(tmp_path), "d", "s")
    with pytest.raises(Exception):
        writers.write_csv(df, str(tmp_path), "d", "s")


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(5000).withColumnRenamed("id", "k").selectExpr("k", "'v' AS v")
    a = {r["k"] for r in faults.inject_nulls(df.repartition(1), "v", 0.1, "k").where("v IS NULL").collect()}
    b = {r["k"] for r in faults.inject_nulls(df.repartition(9), "v", 0.1, "k").where("v IS NULL").collect()}
    assert a == b and 400 < len(a) < 600


def test_copies_are_found_again(spark):
    df = spark.range(1000).selectExpr("id AS k", "concat('n', id) AS name")
    out = faults.append_copies(df, 0.06, "k", {"k": faults.F.col("k") + 10_000})
    extra = out.count() - 1000
    assert 30 < extra < 90
    assert duplicates.repeated_rows(out, ["name"]).first()["duplicate_rows"] == extra


@pytest.mark.parametrize("domain", list(faults.DOMAINS))
def test_domains_have_their_faults(spark, domain):
    df = spark.read.parquet(f"{DATA}/sf0.001/orders.parquet")
    t = Table(faults.domain_table(domain, df, "o_orderkey"), "row_key")
    total = t.df.count()
    got = found(rule.measure(t, checks.completeness(t) + checks.validity(t, AS_OF) + checks.consistency(t)
                             + checks.business(t)))
    assert total > 1500

    def near(key, rate):
        assert abs(got[key] / total - rate) < 0.03, (key, got[key] / total)
    if domain == "healthcare":
        near(("diagnosis_code", "missing_values"), 0.12)
        near(("age", "range_violation"), 0.02)
        near(("ssn", "pattern_violation"), 0.04)
    elif domain == "finance":
        near(("account_id", "missing_values"), 0.07)
        near(("amount", "type_mismatch"), 0.05)
    elif domain == "insurance":
        near(("claim_amount vs coverage_amount", "business_rule_violation"), 0.05)
        near(("zip_code", "pattern_violation"), 0.04)
    elif domain == "supply_chain":
        near(("inspector", "missing_values"), 0.15)
        near(("quantity", "range_violation"), 0.06)
    else:
        near(("vin", "pattern_violation"), 0.06)
        near(("cost", "calculation_inconsistency"), 0.07)


def test_json_layouts(spark, tmp_path):
    rows = ['{"a": 1}', '{"a": 2}', '{"a": 3}']
    for name, text in (("lines", "\n".join(rows)), ("array", "[" + ",\n".join(rows) + "]"),
                       ("spread", '[\n {\n  "a": 1\n },\n {"a": 2}, {"a": 3}\n]')):
        path = tmp_path / f"{name}.json"
        path.write_text(text)
        assert sorted(r["a"] for r in readers.read_file(spark, str(path)).collect()) == [1, 2, 3]
    one = tmp_path / "one.json"
    one.write_text('{\n "a": 1\n}')
    assert readers.read_json(spark, str(one)).count() == 1


@pytest.mark.parametrize("domain", list(faults.DOMAINS))
def test_copies_have_keys_of_their_own(spark, domain):
    df = spark.range(1_234_567, 1_235_567).withColumnRenamed("id", "k")
    out = faults.domain_table(domain, df, "k")
    assert out.count() == out.select("row_key").distinct().count() > 1000
    first = {"healthcare": "patient_id", "insurance": "policy_id", "supply_chain": "order_id",
             "automotive": "service_id"}.get(domain)
    if first and domain != "healthcare":        # healthcare repeats an id on purpose
        assert out.select(first).distinct().count() == out.count()


@pytest.mark.parametrize("keys", [range(10, 410), [k * 7 + k % 3 for k in range(400)]])
def test_copies_take_ids_of_other_rows(spark, keys):
    """With dense keys and with gaps: every copy has the id of another row, each id at most twice."""
    base = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(5)
    rows = faults.domain_table("finance", base, "k", 10_000).collect()
    own = {r["row_key"]: r["transaction_id"] for r in rows if r["row_key"] < 10_000}
    taken = {r["row_key"] - 10_000: r["transaction_id"] for r in rows if r["row_key"] >= 10_000}
    assert len(set(own.values())) == len(own) == 400 and 10 < len(taken) < 60
    assert len(set(taken.values())) == len(taken)
    assert all(t in own.values() and t != own[k] for k, t in taken.items())


def test_patients_in_conflict(spark):
    rows = faults.domain_table("healthcare", spark.range(1, 3001), "id", 100_000).collect()
    held = {}
    for r in rows:
        held.setdefault(r["patient_id"], []).append(r)
    torn = [p for p in held.values() if len(p) > 1]
    assert len(torn) > 30 and all(len({r["email"] for r in p}) > 1 or len({r["status"] for r in p}) > 1 for p in torn)
    layouts = [r["admission_date"] for r in rows if not r["admission_date"][:4].isdigit()]
    assert any("/" in d for d in layouts) and any("," in d for d in layouts) and any(d[2] == "-" for d in layouts)
    assert {r["age"] for r in rows} >= {-5, -1, 150, 200, 999}
    assert faults.domain_table("healthcare", spark.range(0), "id").count() == 0
    assert faults.domain_table("finance", spark.range(0), "id").count() == 0


def test_pages_are_cut_in_their_order(spark, tmp_path):
    """page2 comes before page10; whole pages first, then the first records of the next."""
    for i in (1, 2, 3, 10, 11):
        (tmp_path / f"page{i}.json").write_text(json.dumps({"data": [{"page": i, "n": j} for j in range(4)]}))
    for most in (1, 4, 6, 13, 20, 99):
        got = sorted((r["page"], r["n"]) for r in readers.read_pages(spark, str(tmp_path), "data", most).collect())
        assert got == [(i, j) for i in (1, 2, 3, 10, 11) for j in range(4)][:most]
    pages = [spark.range(k, k + 50, 1, 7).toDF("x") for k in (500, 0, 900)]
    got = sorted(r["x"] for r in readers.combine_pages(pages, 70).collect())
    assert got == [*range(0, 20), *range(500, 550)]


def test_layouts_are_found_per_file(spark, tmp_path):
    """An array file beside a lines file, and a file whose objects span lines."""
    (tmp_path / "a.json").write_text('[\n {"x": 1},\n {"x": 2}\n]\n')
    (tmp_path / "b.json").write_text('\n{"x": 3}\n{"x": 4}\n')
    (tmp_path / "c.json").write_text('{\n "x": 5\n}\n')
    assert sorted(r["x"] for r in readers.read_json(spark, str(tmp_path)).collect()) == [1, 2, 3, 4, 5]


def test_csv_is_split_where_no_value_is_broken(spark, tmp_path):
    plain, broken = tmp_path / "plain.csv", tmp_path / "broken.csv"
    plain.write_text('a,b\n' + "".join(f'{i},"say ""{i}"", x"\n' for i in range(3000)))
    broken.write_text('a,b\n1,"two\nlines"\n2,"one"\n')
    assert not readers.has_broken_lines(spark, str(plain)) and readers.has_broken_lines(spark, str(broken))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = readers.read_csv(spark, str(plain))
        assert df.rdd.getNumPartitions() > 3 and df.count() == 3000
        assert df.where("a = 7").first()["b"] == 'say "7", x'
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["b"] for r in readers.read_csv(spark, str(broken)).orderBy("a").collect()] == ["two\nlines", "one"]
