"""Groups, samples and splits against brute force, with nulls, ties, repeats, hubs and empty tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerloom.llm.components import boruvka, star_components
from ledgerloom.llm.linked import group_pairs
from ledgerloom.llm.sample import stable_sample
from ledgerloom.llm.splits import grouped_split

EDGES = "u string, v string"
PAIRS = "unique_id_l string, unique_id_r string, match_weight double, group_id string"


def _groups(edges: list[tuple[str, str]]) -> dict[str, str]:
    home: dict[str, set[str]] = {}
    for u, v in edges:
        if u is None or v is None or u == v:
            continue
        joined = home.get(u, {u}) | home.get(v, {v})
        for x in joined:
            home[x] = joined
    return {x: min(g) for x, g in home.items()}


def _random_edges(seed: int) -> list[tuple[str, str]]:
    rng = random.Random(seed)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    star = [("hub", f"s{i:03d}") for i in range(80)]
    loose = [(f"r{rng.randrange(120):03d}", f"r{rng.randrange(120):03d}") for _ in range(70)]
    edges = chain + star + loose + chain[:5] + [(v, u) for u, v in star[:7]] + [("lone", "lone"), (None, "x"), ("y", None)]
    rng.shuffle(edges)
    return edges


def test_boruvka_and_stars_match_union_find(spark):
    for seed in (1, 2):
        edges = _random_edges(seed)
        want = _groups(edges)
        df = spark.createDataFrame(edges, EDGES)
        assert {r["id"]: r["group_id"] for r in boruvka(spark, df).collect()} == want
        assert {r["id"]: r["component"] for r in star_components(spark, df).collect()} == want


def test_no_edges(spark):
    empty = spark.createDataFrame([], EDGES)
    assert boruvka(spark, empty).count() == 0
    assert star_components(spark, empty).count() == 0
    assert boruvka(spark, spark.createDataFrame([("a", "a"), (None, "b")], EDGES)).count() == 0


def test_group_pairs_weights_nulls_and_lone_ids(spark):
    nan = float("nan")
    rows = [
        ("b", "a", 5.0, "x"), ("a", "b", -99.0, "x"), ("b", "c", 9.0, None), ("d", "e", 4.999, "x"), ("f", "g", nan, "x"),
        ("g", "h", None, "x"), ("i", "i", 50.0, "x"), (None, "j", 50.0, "x"), ("k", None, 50.0, "x"), ("", "z", 7.0, "x"), (None, None, 7.0, "x"),
    ]
    out = group_pairs(spark, spark.createDataFrame(rows, PAIRS), "unique_id_l", "unique_id_r", "match_weight", 5.0)
    got = {r["unique_id"]: r["group_id"] for r in out.collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f", "g": "g", "h": "h", "i": "i", "j": "j", "k": "k", "": "", "z": ""}
    assert group_pairs(spark, spark.createDataFrame([], PAIRS), "unique_id_l", "unique_id_r", "match_weight", 5.0).count() == 0


def test_sample_is_stable_and_grows(spark):
    ids = [(f"id{i}", i) for i in range(4000)] + [("id7", -1), (None, -2), ("", -3)]
    df = spark.createDataFrame(ids, "key string, n int")
    first = {tuple(r) for r in stable_sample(df, "key", 0.1, "s:").collect()}
    again = {tuple(r) for r in stable_sample(df.repartition(13), "key", 0.1, "s:").collect()}
    assert first == again and 300 < len(first) < 500
    grown = df.union(spark.createDataFrame([(f"new{i}", i) for i in range(1000)], df.schema))
    assert first <= {tuple(r) for r in stable_sample(grown, "key", 0.1, "s:").collect()}
    assert first <= {tuple(r) for r in stable_sample(df, "key", 0.2, "s:").collect()}
    assert (("id7", 7) in first) == (("id7", -1) in first)
    assert not any(k is None for k, _ in first)
    assert stable_sample(df, "key", 0.0, "s:").count() == 0 and stable_sample(df, "key", 1.0, "s:").count() == len(ids) - 1
    assert stable_sample(df.limit(0), "key", 0.1, "s:").count() == 0


def test_split_keeps_related_rows_together_and_the_shares(spark):
    rng = random.Random(5)
    rows = [(f"case{i}", f"G{min(int(rng.paretovariate(0.9)), 400):X}") for i in range(6000)]
    rows += [(f"case{i}", f"g{rng.randrange(400):x}") for i in range(0, 300, 3)] + [("case1", None), (None, "gA"), (None, None), (None, None), ("case1", "G1")]
    df = spark.createDataFrame(rows, "case_id string, group_id string").withColumn("split_", F.lit("clash"))
    shares = {"train": 0.65, "validation": 0.15, "test": 0.2}
    out = grouped_split(spark, df, F.col("case_id"), F.lower("group_id"), shares, "t:").collect()
    assert len(out) == len(rows)
    home: dict[str, set[str]] = {}
    for r in out:
        for k in (r["case_id"] and "c" + r["case_id"], r["group_id"] and "g" + r["group_id"].lower()):
            if k:
                home.setdefault(k, set()).add(r["split"])
    assert all(len(s) == 1 for s in home.values())
    again = grouped_split(spark, df.repartition(7), F.col("case_id"), F.lower("group_id"), shares, "t:").collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    largest = max(sum(1 for r in out if r["component"] == c) for c in {r["component"] for r in out})
    for s, share in shares.items():
        assert abs(sum(r["split"] == s for r in out) - share * len(rows)) <= max(0.01 * len(rows), largest)


def test_split_of_small_and_empty_tables(spark):
    shares = {"train": 0.65, "validation": 0.15, "test": 0.2}
    schema = "case_id string, group_id string"
    assert grouped_split(spark, spark.createDataFrame([], schema), F.col("case_id"), F.col("group_id"), shares, "t:").count() == 0
    one = grouped_split(spark, spark.createDataFrame([("a", None), ("a", "g"), ("b", "g")], schema), F.col("case_id"), F.col("group_id"), shares, "t:").collect()
    assert len({r["split"] for r in one}) == 1 and len(one) == 3


def test_recorded_splits_hold_as_rows_come_in(spark):
    rng = random.Random(9)
    schema, shares = "case_id string, group_id string", {"train": 0.65, "validation": 0.15, "test": 0.2}
    first = [(f"case{i}", f"g{min(int(rng.paretovariate(0.9)), 300)}") for i in range(3000)]
    more = first + [(f"new{i}", f"g{rng.randrange(600)}") for i in range(1500)] + [("case1", "g599"), ("late", None), (None, "g1")]
    split = lambda rows, **how: grouped_split(spark, spark.createDataFrame(rows, schema), F.col("case_id"), F.lower("group_id"), shares, "t:", **how)
    before = {r["case_id"]: r["split"] for r in split(first).collect()}
    recorded = spark.createDataFrame([*before.items(), ("gone", "test"), (None, "test")], "record string, split string")
    after = split(more, recorded=recorded).collect()
    assert len(after) == len(more)
    sides: dict[str, set[str]] = {}
    for r in after:
        sides.setdefault(r["component"], set()).add(r["split"])
    assert all(len(s) == 1 for s in sides.values())
    moved = [r for r in after if r["case_id"] in before and r["split"] != before[r["case_id"]]]
    # Only what a new row has joined to a larger part of another side may move.
    joined = next(r["component"] for r in after if r["case_id"] == "case1")
    assert all(r["component"] == joined for r in moved)
    for s, share in shares.items():
        assert abs(sum(r["split"] == s for r in after) - share * len(more)) <= 0.12 * len(more)
