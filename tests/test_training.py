"""The trained linker, labels and evaluation against brute force, and what they refuse."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evaluate, fellegi, labels, models, stages, training


def test_random_pairs_are_random_and_repeatable(spark):
    records = spark.createDataFrame([(f"r{i:04d}", i % 7) for i in range(400)], "k string, x int")
    out = {(r["k_l"], r["k_r"]): (r["x_l"], r["x_r"]) for r in training.random_pairs(records, "k", 1000).collect()}
    assert 600 < len(out) < 1500 and all(a < b for a, b in out)
    assert out == {(r["k_l"], r["k_r"]): (r["x_l"], r["x_r"]) for r in training.random_pairs(records.repartition(5), "k", 1000).collect()}
    same = sum(x == y for x, y in out.values()) / len(out)
    assert abs(same - 1 / 7) < 0.05
    assert training.random_pairs(records.limit(0), "k", 10).count() == 0


def test_m_is_found_with_the_blocked_column_held_out():
    rng = random.Random(3)
    m = {n: tuple((0.1 / (len(x) - 1),) * (len(x) - 1) + (0.9,)) for n, x in fellegi.GIVEN.items()}
    u = {n: tuple((0.9,) + (0.1 / (len(x) - 1),) * (len(x) - 1)) for n, x in fellegi.GIVEN.items()}
    counts: dict[tuple, int] = {}
    for i in range(20_000):
        p = m if i < 4000 else u
        row = tuple(1 if n == "zip" else rng.choices(range(len(p[n])), p[n])[0] for n in fellegi.GIVEN)
        counts[row] = counts.get(row, 0) + 1
    found = training.estimate_m([(*k, v) for k, v in counts.items()], u, "zip", 0.1, 200)
    assert "zip" not in found and all(abs(found[n][-1] - 0.9) < 0.03 for n in found)
    model = training.joined_model([found, {"zip": m["zip"], "name": m["name"]}], u)
    assert abs(model["name"][-1][0] - 0.9) < 0.03 and model["zip"][1] == (0.9, 0.1)


def test_models_are_saved_and_used_as_they_are(spark, tmp_path):
    path = str(tmp_path / "model")
    training.save_model(spark, path, fellegi.GIVEN, 0.001)
    assert training.load_model(spark, path) == (fellegi.GIVEN, 0.001)
    with pytest.raises(Exception, match="exist"):
        training.save_model(spark, path, fellegi.GIVEN, 0.001)


def test_curve_is_cross_validated(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        truth = i % 3 == 0
        rows.append((*[rng.randrange(max(0, len(x) - 2), len(x)) if truth else rng.randrange(0, max(1, len(x) - 1)) for x in fellegi.GIVEN.values()], truth, i % 5))
    df = spark.createDataFrame(rows, ", ".join(f"g_{n} int" for n in fellegi.GIVEN) + ", truth boolean, f int")
    u = {n: tuple(b for _, b in x) for n, x in fellegi.GIVEN.items()}
    curve = training.cross_validated_curve(df, F.col("f"), u, 0.01)

    def m_of(own):
        out = {}
        for i, (n, x) in enumerate(fellegi.GIVEN.items()):
            seen = [sum(r[i] == k for r in own) for k in range(len(x))]
            out[n] = tuple(s / len(own) if s else d for s, d in zip(seen, training.default_m()[n]))
        return out

    import math

    base = math.log2(0.01 / 0.99)
    weights = [base + training._bits(r[:5], m_of([q for q in rows if q[5] and q[6] != r[6]]), u) for r in rows]
    for bar, name, merged, tp, fp, _, _ in curve:
        if name == "cv":
            assert (merged, tp) == (sum(w >= bar for w in weights), sum(w >= bar and r[5] for w, r in zip(weights, rows))), bar
    assert training.pick_on_curve(curve) == min(r[0] for r in curve if r[1] == "cv" and r[2] >= 10 and r[5] >= 0.95)
    assert training.pick_on_curve([]) is None


def test_valley(spark):
    two = [(-5.0,)] * 50 + [(8.0 + i / 4,) for i in range(40)] + [(18.0,)] * 60 + [(1.0,), (float("nan"),), (None,)]
    row = training.valley_threshold(spark.createDataFrame(two, "w double"), "w").first()
    assert row["branch"] == "valley" and 0 < row["threshold"] < 15
    assert training.valley_threshold(spark.createDataFrame([], "w double"), "w").first()["threshold"] == 6.0


def test_stage_one_keeps_initials_and_places_apart(spark):
    rows = [
        ("a", "ROCKY MOUNTAIN PAVING", None, "X", "1"), ("b", "ROCKY MOUNTAIN PAVNG", None, "X", "2"), ("c", "ROCKYMOUNTAIN PAVING", None, "Y", "1"), ("d", "ROCKY MOUNT", None, "X", "9"),
        ("e", "SMITH JOHN A", None, "Z", "5"), ("f", "SMITH JOHN B", None, "Z", "5"), ("g", "SMITH JOHN A", "1 MAIN", "Q", "7"), ("h", None, None, "Z", "5"), ("i", "ROCKY MOUNTAIN PAVING", None, "W", "8"),
    ]
    df = spark.createDataFrame(rows, "id string, name_clean string, address1 string, city string, zipcode string").withColumn("rule", F.lit("clash"))
    got = {(r["u"], r["v"]): r["rule"] for r in stages.stage_one(df, "id").collect()}
    assert got == {("a", "b"): "S1c", ("a", "c"): "S1b", ("a", "d"): "S1d", ("b", "d"): "S1d"}
    scored = spark.createDataFrame([("b", "a", 3.0), ("e", "f", 2.0)], "u string, v string, w double")
    both = {(r["u"], r["v"]): (r["w"], r["stage"]) for r in stages.two_stages(stages.stage_one(df, "id"), scored).collect()}
    assert both[("a", "b")] == (100.0, 1) and both[("e", "f")] == (2.0, 2) and len(both) == 5


def test_differences(spark):
    want = {("A B", "B A"): "none", ("ACME ONE", "ACME TWO"): "enumerator", ("LOT 12", "LOT 13"): "enumerator", ("ACME NORTH", "ACME CO"): "other", ("", ""): "none"}
    df = spark.createDataFrame(list(want), "a string, b string")
    assert {(r[0], r[1]): r[2] for r in df.select("a", "b", stages.difference(F.col("a"), F.col("b"))).collect()} == want


PASS = "case_id string, label string, reason string, is_repeat boolean, labeller_id string"
TOLD = "case_id string, decision string, label string, note string"


def _pass(spark, name, *answers):
    return spark.createDataFrame([(c, label, f"why {name}", again, name) for c, label, again in answers], PASS)


def test_labels_are_assembled_by_the_table(spark):
    a = _pass(spark, "a", ("1", "yes", False), ("2", "yes", False), ("3", "no", False), ("4", "yes", False), ("5", "no", False), ("1", "no", True))
    b = _pass(spark, "b", ("1", "yes", False), ("2", "yes", False), ("3", "no", False), ("4", "no", False), ("5", "yes", False))
    told = spark.createDataFrame([("2", "confirmed", None, None), ("3", "overturned", "yes", "seen"), ("4", "adjudicated", "no", "read")], TOLD)
    out = {(r["case_id"], r["is_repeat"]): (r["label"], r["reason"], r["status"]) for r in labels.assemble(a, b, told).collect()}
    assert out == {
        ("1", False): ("yes", "why a", "model_agreed"), ("2", False): ("yes", "why a", "founder_confirmed"), ("3", False): ("yes", "seen", "founder_adjudicated"), ("4", False): ("no", "read", "founder_adjudicated"),
        ("5", False): (labels.OPEN, "pass a: no; pass b: yes", "blind_unresolved"), ("1", True): ("no", "why a", "blind_repeat"),
    }
    table = labels.assemble(a, b, told)
    assert {r["case_id"]: r["y"] for r in labels.resolve_labels(table, "yes", "no").collect()} == {"1": 1.0, "2": 1.0, "3": 1.0, "4": 0.0, "5": None}
    assert labels.resolve_labels(table, "yes", "no", True).count() == 4
    for wrong in ([("1", "adjudicated", "no", "x")], [("9", "confirmed", None, None)], [("2", "confirmed", None, None)] * 2):
        with pytest.raises(ValueError):
            labels.assemble(a, b, spark.createDataFrame(wrong, TOLD)).count()
    with pytest.raises(ValueError):
        labels.assemble(a, b, told, "error")
    with pytest.raises(ValueError):
        labels.merge_rounds([("x", table), ("y", table)])
    with pytest.raises(ValueError):
        labels.resolve_labels(table.unionByName(table.withColumn("label", F.lit("no"))), "yes", "no")


def test_bad_answers_are_refused(spark):
    queue = spark.createDataFrame([("q1", "1", False), ("q2", "2", False), ("q3", "1", True)], "queue_id string, case_id string, is_repeat boolean")
    good = spark.createDataFrame([("q1", "yes", "r"), ("q2", "no", "r"), ("q3", "yes", "r")], "queue_id string, label string, reason string")
    assert sorted((r["case_id"], r["is_repeat"]) for r in labels.import_pass(queue, good, "a", ["yes", "no"]).collect()) == [("1", False), ("1", True), ("2", False)]
    bad = spark.createDataFrame([("q1", "maybe", "r"), ("q2", "no", None), ("q9", "yes", "r")], good.schema)
    assert {tuple(r) for r in labels.check_answers(queue, bad, ["yes", "no"], 9).collect()} == {("q1", "label"), ("q2", "no_reason"), ("q3", "missing"), ("q9", "unknown")}
    with pytest.raises(ValueError):
        labels.import_pass(queue, bad, "a", ["yes", "no"])


def test_independent_draw_is_greedy(spark):
    rng = random.Random(6)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(120)})
    df = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "u string, v string")
    digest = {(r["u"], r["v"]): r["d"] for r in df.select("u", "v", labels.rank_digest("t", F.concat_ws("|", "u", "v")).alias("d")).collect()}
    used, want = set(), []
    for pair in sorted(digest, key=digest.get):
        if not used & set(pair):
            used |= set(pair)
            want.append(pair)
    got = [(r["u"], r["v"]) for r in labels.independent_draw(df, "u", "v", 12, "t").orderBy("draw_rank").collect()]
    assert got == want[:12] and labels.independent_draw(df.limit(0), "u", "v", 3, "t").count() == 0


def test_running_sums_match_one_window(spark):
    rng = random.Random(2)
    rows = [(round(rng.random() ** 3, rng.choice([1, 6])), float(rng.randrange(5))) for _ in range(3000)] + [(None, 7.0)]
    df = spark.createDataFrame(rows, "s double, w double")
    got = {r["s"]: r["up_w"] for r in evaluate.running_sums(df, "s", "w").collect()}
    want, total = {}, 0.0
    for s in sorted({r[0] for r in rows if r[0] is not None}, reverse=True):
        total += sum(w for x, w in rows if x == s)
        want[s] = total
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)
    assert evaluate.running_sums(df.limit(0), "s", "w").count() == 0


def test_thresholds_fall_back(spark):
    rows = [(0.9, True, 1.0), (0.8, False, 1.0), (0.7, True, 2.0), (0.1, False, 1.0)]
    df = spark.createDataFrame(rows, "s double, t boolean, w double")
    pick = lambda p, n: evaluate.select_threshold(df, "s", "t", "w", p, n).first()
    assert (pick(0.7, 2)["threshold"], pick(0.7, 2)["status"]) == (0.7, "production")
    assert (pick(0.99, 2)["threshold"], pick(0.99, 2)["fallback"]) == (0.7, "max_f1")
    assert (pick(0.5, 9)["threshold"], pick(0.5, 9)["fallback"], pick(0.5, 9)["positives"]) == (0.5, "too_few_cases", 3)
    assert models.choose_calibration(df, "t", "w", 1.5) == ("isotonic", 1.8) and models.choose_calibration(df, "t", "w", 2.0)[0] == "sigmoid"
