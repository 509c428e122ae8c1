"""Blocked pairs compared as tiles: the same as pair by pair, without a row for each."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.functions.keys import record_id
from ledgerloom.functions.similarity import Letters, jaro_winkler, jaro_winkler_batch
from ledgerloom.operators import fellegi, tiles


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _texts(rng: random.Random, alphabet: str, n: int, most: int = 64) -> list[str]:
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(most + 1))) for _ in range(n)]


@pytest.mark.parametrize("alphabet", ["AB", "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789", "Aé漢😀\0"])
def test_letters_are_jaro_winkler_and_near_leaves_nothing_out(alphabet):
    rng = random.Random(5)
    texts = [*_texts(rng, alphabet, 150), *_texts(rng, alphabet, 150, 9)]
    rows = Letters(texts)
    i, j = (x.ravel() for x in np.indices((len(texts), len(texts)))[:, ::3])
    own = np.array([jaro_winkler(texts[a], texts[b]) if texts[a] != texts[b] else 1.0 for a, b in zip(i, j)])
    apart = np.array([texts[a] != texts[b] for a, b in zip(i, j)])
    assert (rows.winkler(i, j)[apart] == own[apart]).all()
    high = apart & (own >= 0.7)
    assert high.any() and rows.near(i[:, None], j[:, None], 0.7)[high].all()
    assert (rows.winkler(i, j, least=0.7)[high] == own[high]).all()


def test_many_letters_and_long_strings_are_compared_too():
    wide = [chr(0x4E00 + k) * (1 + k % 3) + chr(0x4E00 + k + 1) for k in range(9000)]
    assert Letters(wide).places is None
    left, right = [*wide, "A" * 70, None], [*wide[1:], "B", "A" * 69, "A"]
    assert jaro_winkler_batch(left, right) == [None if x is None else jaro_winkler(x, y) for x, y in zip(left, right)]


@pytest.fixture(scope="module")
def odd_records(spark):
    """Records of one large ZIP, some middling and many small blocks, with nulls, blanks, long and foreign strings, and one id twice."""
    rng = random.Random(6)
    words = ["ACME", "ACNE", "NORTH", "NORHT", "PAVING", "PAVNIG", "ÉTÉ", "漢字", "L", "X" * 66]
    rows = []
    for k in range(420):
        name = rng.choice(["", " ".join(rng.choices(words, k=rng.randrange(1, 4))), "".join(rng.choices("AB", k=9))])
        street = rng.choice([None, "", f"{rng.randrange(30)} {rng.choice(['MAIN', 'MIAN', 'OAK'])} ST", f"{k} ELM {'Y' * rng.choice([1, 70])}"])
        zipcode = "80157" if k < 300 else rng.choice([None, "", "81612-4", "81612", f"8{k:04d}"])
        rows.append((name, rng.choice([None, "LLC", "INC"]), street, rng.choice([None, "", "DENVER", "AURORA"]), "CO", zipcode))
    rows += [("TWIN", None, "1 A ST", "DENVER", "CO", "80157"), ("TWIN", "", "1 A ST", "DENVER", "CO", "80157")]
    made = spark.createDataFrame(rows, ", ".join(f"{p} string" for p in fellegi.PARTS)).distinct()
    return made.withColumn("unique_id", record_id(*fellegi.PARTS)).localCheckpoint()


@pytest.mark.parametrize("part", [40, 8192])
def test_tiles_give_what_pairs_give(spark, monkeypatch, odd_records, part):
    monkeypatch.setattr(tiles, "PART", part)
    columns = [f"g_{n}" for n in fellegi.GIVEN]
    pairs = fellegi.gamma_vectors(fellegi.candidate_pairs(odd_records))
    head = (F.substring("name_clean_l", 1, 4) == F.substring("name_clean_r", 1, 4)).alias("same_head")
    wanted = sorted(map(tuple, pairs.groupBy(*columns, head).agg(F.count("*")).collect()))
    assert len(wanted) > 100 and sorted(map(tuple, tiles.counted(odd_records).collect())) == wanted
    assert sorted(map(tuple, fellegi.patterns(odd_records).collect())) == sorted(map(tuple, pairs.groupBy(*columns).agg(F.count("*")).collect()))
    # A model in which a higher level may weigh less, and one that leaves comparisons out.
    bent = fellegi.GIVEN | {"name": ((0.3, 0.1), (0.6, 0.05), (0.05, 0.4), (0.01, 0.3), (0.04, 0.15))}
    for model, prior, least in ((fellegi.GIVEN, fellegi.PRIOR, 0.0), (fellegi.GIVEN, 0.01, 12.0), (bent, 0.3, 4.0), ({"name": bent["name"], "city": bent["city"]}, 0.5, 3.0)):
        keep = ["unique_id_l", "unique_id_r", "name_clean_l", "name_clean_r", *columns, "match_weight"]
        rows = lambda df: sorted(map(tuple, df.filter(F.col("match_weight") >= least).select(*keep).collect()))
        expected = rows(fellegi.weigh(pairs, model, prior))
        assert expected and rows(fellegi.weighed_pairs(odd_records, least, model, prior)) == expected


def test_nothing_gives_nothing(spark, odd_records):
    none = odd_records.limit(0)
    assert fellegi.patterns(none).count() == 0 and fellegi.weighed_pairs(none, 0.0).count() == 0


@pytest.mark.parametrize("name", ["address_blind_arms", "gamma_patterns", "fs_weights", "fs_scores_all", "fs_weights_tf"])
def test_no_row_of_a_pair_reaches_python(spark, folder, name):
    plan = _plan(entry.queries()[name](spark, folder))
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("name", ["fs_em_by_rule", "resolve_clusters", "fs_em_parameters", "resolve_summary"])
def test_blocked_pairs_are_not_joined(spark, folder, monkeypatch, name):
    def refuse(records):
        raise AssertionError("joined")

    monkeypatch.setattr(fellegi, "candidate_pairs", refuse)
    assert entry.queries()[name](spark, folder).count()
