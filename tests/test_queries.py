"""Every query with SQL against DuckDB, streams and sources, and the shape of plans."""

from __future__ import annotations

import gzip
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

from ledgerloom.plans.spool import Spool
from ledgerloom.queries import catalogue
from ledgerloom.sources import documents, files
from ledgerloom.streaming import events as ev

@pytest.fixture(scope="module")
def duck(folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in os.listdir(folder):
        con.execute(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM '{folder}/{p}'")
    return con


def _norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, folder, duck, name):
    got = catalogue.queries()[name](spark, folder)
    columns = sorted(got.columns)
    result = duck.execute(catalogue.oracle_sql()[name])
    own = [c[0] for c in result.description]
    assert sorted(own) == columns
    want = sorted(tuple(_norm(r[own.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(_norm(r[c]) for c in columns) for r in got.collect()) == want


def test_registers_as_csv(spark, tmp_path):
    rows = 'a,b\n1,"x ""q"" y"\n2,"two\nlines"\n3,\n'
    with gzip.open(tmp_path / "p.csv.gz", "wt") as f:
        f.write(rows)
    df = files.read_register_csv(spark, str(tmp_path), ["a", "b"])
    assert [tuple(r) for r in df.orderBy("a").collect()] == [("1", 'x "q" y'), ("2", "two\nlines"), ("3", None)]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "labels.csv").write_text("case_id,label\nc1,yes\nc2,maybe\n")
    with pytest.raises(ValueError):
        files.read_labels(spark, str(tmp_path / "l"), {"case_id": "string", "label": "string"}, {"label": ["yes", "no"]})
    with pytest.raises(ValueError):
        files.read_labels(spark, str(tmp_path / "l"), {"case": "string", "label": "string"}, {})
    (tmp_path / "gaz.txt").write_text("GEOID\tINTPTLAT\tINTPTLONG  \n601\t18.18\t-66.75\n")
    assert files.read_gazetteer(spark, str(tmp_path / "gaz.txt")).collect() == [("00601", 18.18, -66.75)]


def test_pages_land_once_and_resume(tmp_path):
    calls = []

    def fetch(offset, size):
        calls.append(offset)
        return "".join(f"{i}\n" for i in range(offset, min(offset + size, 25)))

    assert files.land_pages(fetch, tmp_path, 10) == 3
    assert files.land_pages(fetch, tmp_path, 10) == 3 and calls == [0, 10, 20]


def numbers(offset: int, size: int, where: list) -> list[tuple]:
    """A paged source for the test below: a page of the numbers below 25 that the filters admit."""
    keep = {"=": lambda n, v: n == v, ">=": lambda n, v: n >= v, "is not null": lambda n, v: True}
    admitted = [n for n in range(25) if all(keep[s](n, v) for _, s, v in where)]
    return [(n, str(n)) for n in admitted[offset : offset + size]]


def test_paged_source(spark, monkeypatch):
    import types

    module = types.ModuleType("paged_numbers")
    module.numbers = numbers
    monkeypatch.setitem(sys.modules, "paged_numbers", module)
    options = {"schema": "n int, t string", "pages": "4", "size": "10", "fetch": "paged_numbers.numbers", "push": "n"}
    reader = files.PagedReader(options)
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == list(range(25))
    pushed = [GreaterThanOrEqual(("n",), 12), EqualTo(("t",), "13")]
    assert list(reader.pushFilters(pushed)) == pushed[1:] and reader.where == [("n", ">=", 12)]
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == list(range(12, 25))


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"CO": [[1, 2], [3, 4]]}')
    assert documents.read_raster(spark, tmp_path / "a.json").filter("iy = 1 and ix = 0").first()["value"] == 3.0
    (tmp_path / "b.json").write_text('{"k": 1, "k": 2}')
    with pytest.raises(ValueError):
        documents.read_config(tmp_path / "b.json")
    documents.write_sums(tmp_path)
    assert documents.verify_sums(tmp_path) == []
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "new").write_text("x")
    assert documents.verify_sums(tmp_path) == ["a.json", "new"]


def test_pages_with_line_ends_in_quotes_and_failing_fetches(spark, tmp_path):
    asked = []

    def fetch(offset: int, size: int) -> str:
        asked.append(offset)
        if len(asked) in (1, 3):
            raise OSError("busy")
        return 'a,"two\nlines"\nb,c\n' if offset == 0 else 'd,"one\nrow"\n'

    assert files.land_pages(fetch, tmp_path / "pages", 2, pause=0.0) == 2 and asked == [0, 0, 2, 2]
    with pytest.raises(OSError):
        files.land_pages(lambda o, s: (_ for _ in ()).throw(OSError("down")), tmp_path / "none", 2, tries=2, pause=0.0)
    df = spark.createDataFrame([("b", 1), ("a", 2)], "k string, n int")
    files.write_csv_once(df, str(tmp_path / "csv"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == [("a", "2"), ("b", "1")]
    with pytest.raises(Exception, match="exist"):
        files.write_csv_once(df, str(tmp_path / "csv"))


def test_export_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "a int, b string")
    m = files.export_ordered(df, str(tmp_path / "out"))
    assert m == files.manifest(df.repartition(3)) and m["rows"] == 2
    assert m["digest"] != files.manifest(df.limit(1))["digest"]
    with pytest.raises(ValueError):
        files.view_document(df, "v", 1)


STEP = """
import sys
sys.path.insert(0, sys.argv[3])
from pyspark.sql import functions as F
from ledgerloom.session import local_session
from ledgerloom.streaming import events as ev
spark = local_session(2, 2, "1g")
stream = spark.readStream.schema("k int, v string").parquet(sys.argv[1])
ev.incremental(spark, stream, lambda d: d.groupBy("k").agg(F.max("v").alias("v"), F.count("*").alias("n")), sys.argv[2])
"""


def test_incremental_resolution(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    resolve = lambda d: d.groupBy("k").agg(F.max("v").alias("v"), F.count("*").alias("n"))

    def arrive(*rows):
        spark.createDataFrame(list(rows), "k int, v string").coalesce(1).write.mode("append").parquet(str(source))

    def go(**how):
        stream = spark.readStream.schema("k int, v string").parquet(str(source))
        return {tuple(r) for r in ev.incremental(spark, stream, resolve, state, **how).collect()}

    arrive((1, "a"), (2, "b"))
    assert go() == {(1, "a", 1), (2, "b", 1)}
    arrive((2, "c"))
    # Another process picks up where this one stopped, and doubles nothing.
    subprocess.run([sys.executable, "-c", STEP, str(source), state, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))], check=True, timeout=120, capture_output=True)
    assert go() == {(1, "a", 1), (2, "c", 2)}
    arrive((3, "d"), (1, "0"))
    seen = []

    def touched(known, batch):
        out = known.join(batch.select("k").distinct(), "k", "left_semi")
        seen.append(out.count())
        return out

    assert go(key="k", touched=touched) == {(1, "a", 2), (2, "c", 2), (3, "d", 1)} and seen == [1]


def test_spooled_tables_are_broadcast_only_if_small(spark):
    spool = Spool(spark, "test")
    small = spool.save(spark.range(10).selectExpr("id", "repeat('x', 100) AS s"))
    large = spool.save(spark.range(60_000).selectExpr("id", "repeat('x', 100) AS s"))
    assert (small.spool_rows, large.spool_rows, spool.save(small.limit(0)).spool_rows) == (10, -1, 0)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan(spark.range(5_000_000).join(large.groupBy("id").count(), "id"))
    assert "BroadcastHashJoin" in plan(spark.range(5_000_000).join(small, "id"))
    spool.clear()


def test_blocked_joins_stay_equi_joins(spark, folder):
    for name in ("disjunctive_block_pairs", "pair_anti_swapped", "edit_distance_pairs", "scope_rows"):
        plan = catalogue.queries()[name](spark, folder)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan, name


def test_scans_are_pruned_and_filtered(spark, folder):
    plan = catalogue.queries()["gazetteer_harvest"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<name_clean:string>" in plan and "IsNotNull(name_clean)" in plan
