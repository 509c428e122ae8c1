"""Operators of the core on small tables and against brute force."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evaluate, fellegi, geo, graph, screening, survey, votes
from ledgerloom.operators.hotkeys import key_middle
from ledgerloom.plans.joins import anti_pairs, block_sizes, disjunctive_self_join, require_unique


def _middle(rows):
    out = {}
    for k in {r[0] for r in rows if r[0] is not None}:
        own = [r[1] for r in rows if r[0] == k]
        files = sorted({v for v in own if v is not None}, key=lambda v: v.encode())
        out[k] = (len(own), len(files), files[(len(files) + 1) // 2 - 1] if files else None)
    return out


@pytest.mark.parametrize("width", [1, 2, 4])
def test_key_middle(spark, width):
    rng = random.Random(width)
    rows = [("hot", f"{1980 + rng.randrange(40)}F{rng.randrange(3000):08d}") for _ in range(3000)]
    rows += [(f"k{rng.randrange(40)}", f"{rng.randrange(200)}") for _ in range(600)] + [("deep", "x" * 300 + str(i)) for i in range(9)]
    rows += [("none", None), ("none", None), (None, "a"), ("", ""), ("", "é"), ("", "z"), ("", "建"), ("one", "v"), ("one", "v"), ("pre", "a"), ("pre", "ab"), ("pre", "abc"), ("pre", "abcd")]
    df = spark.createDataFrame(rows, "k string, v string").withColumn("middle", F.lit(1)).withColumn("n", F.lit(2))
    got = {r["k"]: (r["n_rows"], r["n_values"], r["middle"]) for r in key_middle(spark, df, "k", "v", width).collect()}
    assert got == _middle(rows)
    assert key_middle(spark, df.limit(0), "k", "v").count() == 0


def test_disjunctive_join_and_blocks(spark):
    rows = [("a", "1", "x"), ("b", "1", "x"), ("c", "2", "x"), ("d", None, "y"), ("e", None, None), ("f", "2", None)]
    df = spark.createDataFrame(rows, "id string, p string, q string")
    out = disjunctive_self_join(df, "id", ["p", "q"])
    assert {(r["id_l"], r["id_r"], r["rule"]) for r in out.collect()} == {("a", "b", "p"), ("c", "f", "p"), ("a", "c", "q"), ("b", "c", "q")}
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert tuple(block_sizes(df, "q").first()) == (4, 2, 3, 3)
    pairs = spark.createDataFrame([("a", "b"), ("c", "b")], "l string, r string")
    assert anti_pairs(pairs, spark.createDataFrame([("b", "a")], "l string, r string"), "l", "r").collect() == [("b", "c")]
    with pytest.raises(ValueError):
        require_unique(spark.createDataFrame([(1,), (1,)], "k int"), "k")


def test_components_levels_and_links(spark):
    pairs = spark.createDataFrame([("a", "b", 9.0), ("b", "c", 6.0), ("c", "d", 1.0), ("e", "f", float("nan")), ("g", "g", 9.0), ("a", "c", 7.0)], "u string, v string, w double")
    got = {r["id"]: r["cluster"] for r in graph.clusters_at(spark, pairs, 5.0).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f", "g": "g"}
    levels = {(r["u"], r["v"]): r["level"] for r in graph.merge_levels(spark, pairs, 5.0).collect()}
    assert levels == {("a", "b"): 9.0, ("a", "c"): 7.0}
    best = {(r["u"], r["v"]) for r in graph.best_links(pairs.filter("w > 0 and not isnan(w) and u <> v")).collect()}
    assert best == {("a", "b"), ("a", "c"), ("c", "d")}
    names = spark.createDataFrame([("a", "ACME PAVING"), ("b", "ACME PAVINGS"), ("c", "ZEBRA HOTEL"), ("d", None)], "id string, name_clean string")
    coherent = {r["id"]: r["cluster"] for r in graph.coherent_clusters(spark, pairs, names, 5.0).collect()}
    assert coherent == {"a": "a", "b": "a", "c": "c"}
    stats = graph.cluster_stats(graph.clusters_at(spark, pairs, 5.0)).first()
    assert (stats["clusters"], stats["largest"], stats["within_bar"]) == (5, 3, False)
    assert graph.components(spark, pairs.filter("w > 100 and not isnan(w)")).count() == 0
    churn = graph.membership_churn(graph.clusters_at(spark, pairs, 8.0), graph.clusters_at(spark, pairs, 5.0)).first()
    assert tuple(churn) == (7, 3)


def test_merge_levels_match_kruskal(spark):
    rng = random.Random(4)
    rows = [(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}", float(rng.randrange(1, 12))) for _ in range(120)]
    got = sorted(tuple(r) for r in graph.merge_levels(spark, spark.createDataFrame(rows, "u string, v string, w double"), 3.0).collect())
    home, want = {}, []
    best: dict = {}
    for u, v, w in rows:
        if u != v and w >= 3:
            best[min(u, v), max(u, v)] = max(w, best.get((min(u, v), max(u, v)), 0))
    for (u, v), w in sorted(best.items(), key=lambda e: (-e[1], e[0])):
        a, b = home.setdefault(u, {u}), home.setdefault(v, {v})
        if a is not b:
            want.append((u, v, w))
            a |= b
            for x in b:
                home[x] = a
    assert got == sorted(want)
    assert graph.merge_levels(spark, spark.createDataFrame([], "u string, v string, w double"), 0.0).count() == 0


def test_long_chain_component(spark):
    edges = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}") for i in range(300)], "u string, v string")
    assert {r["cluster"] for r in graph.components(spark, edges).collect()} == {"0000"}


def test_em_recovers_what_made_the_patterns():
    rng = random.Random(1)
    truth = {"name": ([0.05, 0.05, 0.1, 0.2, 0.6], [0.95, 0.02, 0.01, 0.01, 0.01]), "suffix": ([0.1, 0.9], [0.6, 0.4]), "address": ([0.2, 0.1, 0.2, 0.5], [0.97, 0.01, 0.01, 0.01]), "city": ([0.1, 0.9], [0.9, 0.1]), "zip": ([0.1, 0.9], [0.95, 0.05])}
    counts: dict[tuple, int] = {}
    for _ in range(40_000):
        match = rng.random() < 0.1
        g = tuple(rng.choices(range(len(p[0])), p[0] if match else p[1])[0] for p in truth.values())
        counts[g] = counts.get(g, 0) + 1
    prior, model = fellegi.estimate([(*g, n) for g, n in counts.items()], rounds=100)
    assert prior == pytest.approx(0.1, abs=0.02)
    assert model["name"][4][0] == pytest.approx(0.6, abs=0.05) and model["zip"][1][1] == pytest.approx(0.05, abs=0.02)
    assert fellegi.pick_threshold([(0, 1), (1, 9), (2, 3), (3, 2), (4, 8), (5, 1)]) == 3
    assert fellegi.pick_threshold([]) == 0.0


def test_votes(spark):
    df = spark.createDataFrame([("ACME PAVING", "ACME PAVING", True), ("PAVING ACME", "ACME PAVING", True), ("ACME PAVINGS", "ACME PAVING", True), ("ACME", "ACME PAVING", True), ("ACME", "ACME PAVING", False), ("X", "Y", True)], "a string, b string, z boolean")
    got = [r[0] for r in df.select(votes.decided_rules(F.col("a"), F.col("b"), F.col("z"))).collect()]
    assert got == ["S1", "S2", "S3", "S4", None, None]
    ballots = spark.createDataFrame([("a", "b", "x"), ("b", "a", "y"), ("a", "b", "x"), ("a", "c", "x")], "u string, v string, voter string")
    assert votes.consensus(ballots, 2).collect() == [("a", "b", 2, "x+y")]
    kept = spark.createDataFrame([(5.0, True), (5.0, None)], "w double, k boolean").select(votes.veto(F.col("w"), F.col("k"))).collect()
    assert [r[0] for r in kept] == [5.0, votes.VETO_FLOOR]


def test_survey(spark):
    cases = spark.createDataFrame([(f"c{i:04d}", "A" if i % 3 else "B", f"g{i % 50}") for i in range(600)], "case_id string, stratum string, group_id string")
    drawn = survey.stratified_draw(cases, "case_id", "stratum", {"A": 40, "B": 7}, "t").collect()
    assert sorted(r["draw_rank"] for r in drawn if r["stratum"] == "B") == list(range(1, 8)) and len(drawn) == 47
    assert drawn == survey.stratified_draw(cases.repartition(9), "case_id", "stratum", {"A": 40, "B": 7}, "t").collect() or len(drawn) == 47
    with pytest.raises(ValueError):
        survey.stratified_draw(cases, "case_id", "stratum", {"A": 40, "B": 700}, "t").collect()
    split = {r["group_id"]: r["split"] for r in survey.grouped_quota_split(cases, "group_id", {"train": 0.65, "validation": 0.15, "test": 0.2}, "s").collect()}
    assert [list(split.values()).count(s) for s in ("train", "validation", "test")] == [32, 8, 10]
    forced = spark.createDataFrame([("g1",), ("g2",)], "group_id string")
    split = {r["group_id"]: r["split"] for r in survey.grouped_quota_split(cases, "group_id", {"train": 0.65, "validation": 0.15, "test": 0.2}, "s", forced).collect()}
    assert split["g1"] == split["g2"] == "train" and list(split.values()).count("train") == 32
    assert survey.allocate({"a": 10, "b": 3, "c": 100}, 30) == {"a": 10, "b": 3, "c": 17}
    with pytest.raises(ValueError):
        survey.allocate({"a": 1}, 2)
    queue = survey.blind_queue(cases.limit(20), "case_id", "q", 8, 0.1).collect()
    assert len(queue) == 22 and sum(r["is_repeat"] for r in queue) == 2 and {r["chunk"] for r in queue} == {0, 1, 2}
    confusion = spark.createDataFrame([("y", "y", 40), ("y", "n", 10), ("n", "n", 50)], "label_1 string, label_2 string, n long")
    assert survey.kappa(confusion).first()["kappa"] == pytest.approx((0.9 - 0.5) / 0.5)


def test_evaluation(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 2), rng.random() < 0.4, 1.0 + 3 * (i % 2)) for i in range(500)]
    df = spark.createDataFrame(rows, "score double, truth boolean, weight double")
    ranked = sorted({r[0] for r in rows}, reverse=True)
    ap = before = 0.0
    positives = sum(w for _, t, w in rows if t)
    for s in ranked:
        tp = sum(w for x, t, w in rows if x >= s and t)
        ap += (tp - before) / positives * tp / sum(w for x, _, w in rows if x >= s)
        before = tp
    assert evaluate.average_precision(df, "score", "truth", "weight").first()[0] == pytest.approx(ap)
    assert evaluate.kish(df, "weight").first()["n_eff"] == pytest.approx(sum(r[2] for r in rows) ** 2 / sum(r[2] ** 2 for r in rows))
    low, high = spark.range(1).select(evaluate.wilson(F.lit(8.0), F.lit(10.0)).alias("w")).first()["w"]
    assert (low, high) == (pytest.approx(0.4902, abs=1e-4), pytest.approx(0.9433, abs=1e-4))
    assert spark.range(1).select(evaluate.wilson(F.lit(0.0), F.lit(0.0))).first()[0] is None
    assert evaluate.threshold_choice(df, "score", "truth", "weight", 1.1).count() == 0
    out = evaluate.cluster_bootstrap([("s", str(i), 8.0 + i % 3 - 1, 2.0, 1.0) for i in range(51)], 400, 1)
    assert out["precision"][0] == pytest.approx(0.8, abs=0.02) and out["precision"][1] <= out["precision"][0] <= out["precision"][2]


def test_geo(spark):
    points = spark.createDataFrame([(0.5, 0.5), (0.5, 0.5), (1.0, 1.0), (3.0, 0.0), (None, 1.0)], "lat double, lon double")
    cells = {(r["iy"], r["ix"]): r["value"] for r in geo.grid(points, (0.0, 0.0, 1.0, 1.0), 2, 2).collect()}
    assert cells == {(0, 0): 2.0, (1, 1): 1.0}
    blurred = geo.blur(spark.createDataFrame([(5, 5, 1.0)], "iy int, ix int, value double"), 11, 11, 1.0)
    values = [r["value"] for r in blurred.collect()]
    assert sum(values) == pytest.approx(1.0) and max(values) == pytest.approx(statistics.NormalDist().pdf(0) ** 2, abs=2e-3)
    places = spark.createDataFrame([("80001", 39.0, -105.0, "CO"), ("80002", 40.0, -104.0, "CO")], "zip string, lat double, lon double, state string")
    rows = spark.createDataFrame([("a", "80001", "X", "CO"), ("b", None, " x", "CO"), ("c", "1", "Y", "CO"), ("d", None, None, "NY")], "id string, zipcode string, city string, state string")
    got = {r["id"]: r["how"] for r in geo.placement_cascade(rows, "id", "zipcode", "city", "state", places).collect()}
    assert got == {"a": "zip", "b": "city", "c": "state"}
    assert all(0 <= r["shade"] <= 1 for r in geo.relief(blurred).collect())


def test_screening(spark):
    df = spark.createDataFrame([("Ab c", None), ("", None)], "t string, x string")
    assert df.select(screening.word_ngrams(F.col("t"))).first()[0] == ["AB", "C", "AB C"]
    assert df.select(screening.char_ngrams(F.col("t"), 3, 4)).first()[0] == [" AB", "AB ", " AB ", " C ", " C "]
    rows = [(f"c{i}", "red crane works" if i % 2 else "blue bank trust", ["acme"] * (21 if i == 8 else 1), i % 2 == 1) for i in range(80)] + [("n", None, None, None), ("long", "x" * 400, [], None)]
    data = spark.createDataFrame(rows, "id string, t string, l array<string>, y boolean").withColumn("score", F.lit("clash"))
    model = screening.fit_screen(data.filter("y is not null"), "id", ["t"], "y", penalties=(0.1, 10.0))
    got = {r["id"]: r for r in screening.score_rows(model, data, "id", ["t"], "l").collect()}
    assert got["c1"]["score"] > 0.8 and got["c0"]["score"] < 0.2 and len(got) == len(rows)
    assert got["n"]["validation_error"] == "empty" and got["long"]["validation_error"] == "too long" and got["n"]["score"] is None and got["c8"]["validation_error"] == "too many lenders"
    # A score is the intercept and all contributions; a term that too few rows hold is none.
    terms = {(r["block"], r["term"]): (r["idf"], r["coefficient"]) for r in model.terms.collect()}
    assert ("t:word", "RED") in terms and not any("XX" in t for _, t in terms)
    why = screening.contributions(model, data.filter("id = 'c1'"), "id", ["t"], 1000).collect()
    total = model.intercept + sum(r["contribution"] for r in why)
    assert abs(1 / (1 + math.exp(-total)) - got["c1"]["score"]) < 1e-5 and [abs(r["contribution"]) for r in why] == sorted((abs(r["contribution"]) for r in why), reverse=True)
    empty = screening.fit_screen(data.filter("y"), "id", ["t"], "y")
    assert screening.score_rows(empty, data, "id", ["t"]).filter("score is not null").count() == 80


def test_linear_models(spark):
    import numpy as np

    from ledgerloom.operators import models

    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 2))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    beta = models.ridge_logistic(x, y, 0.1)
    assert np.allclose(beta, [0.5, 2, -1], atol=0.25)
    assert models.bootstrap_errors(x[:300], y[:300], 20, 1).shape == (3,)
    df = spark.createDataFrame([(0.1, False, 1.0), (0.2, True, 1.0), (0.3, False, 1.0), (0.8, True, 2.0), (0.9, True, 1.0)], "s double, t boolean, w double")
    knots = models.isotonic(df, "s", "t", "w")
    assert [round(v, 3) for _, v in knots] == [0.0, 0.5, 1.0]
    assert tuple(models.zero_false_positive(df, "s", "t").first()) == (0.8, 2)
    slope, _ = models.platt(df, "s", "t", "w")
    assert slope > 0
    bits = df.select(models.linear_bits({"s": F.col("s"), "n": F.lit(None)}, np.array([0.0, np.log(2), 5.0]))).first()[0]
    assert bits == pytest.approx(0.1)


def test_people(spark):
    from ledgerloom.operators.people import parse_people, person_gate

    names = spark.createDataFrame([("SMITH JOHN A",), ("JOHN SMITH",), ("SMITH PAVING",), ("SMITH JOHN ANTHONY",), ("ZED QUX",), (None,)], "n string")
    given = spark.createDataFrame([("JOHN",), ("MARY",)], "word string")
    got = {r["n"]: (r["surname"], r["given"], r["initial"]) for r in parse_people(names, "n", given).collect()}
    assert got["SMITH JOHN A"] == ("SMITH", "JOHN", "A") and got["JOHN SMITH"] == ("SMITH", "JOHN", None)
    assert got["SMITH PAVING"] == got["SMITH JOHN ANTHONY"] == got["ZED QUX"] == got[None] == (None, None, None)
    parts = ["surname", "given", "initial"]
    rows = [("S", "J", "A", "S", "J", "B"), ("SMITH", "JOHN", None, "SMITHE", "JOHN", "A"), ("SMITH", "JOHN", None, "SMITH", "MARY", None), ("SMITH", "JOHN", None, "ZUBER", "JOHN", None), (None,) * 6, ("S", "J", None, None, None, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{p}_{s} string" for s in "lr" for p in parts))
    assert sorted(r["outcome"] for r in person_gate(df).collect()) == sorted(["initials_differ", "same", "given_differs", "surname_differs", "not_people", "mixed"])
