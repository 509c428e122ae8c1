"""Names, keys, rules and similarities against plain Python on fixed and random strings."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import keys, rules
from ledgerloom.functions.normalize import CLAUSE_WORDS, SUFFIXES, norm_key, normalize_name
from ledgerloom.functions.similarity import coherent, jaro_winkler, jw_always, jw_bound, jw_sql, token_min
from ledgerloom.plans.joins import udf_on_distinct

CASES = [
    ("Acme Co", "ACME", "CO"), ("Colorado Foliage, Inc.", "COLORADO FOLIAGE", "INC"), ("Smith & Sons Farm's L.L.C.", "SMITH AND SONS FARMS", "LLC"),
    ("Acme Holdings CO., LLC", "ACME HOLDINGS", "CO LLC"), ("160 Corp", "160", "CORP"), ("YM LLC, A COLORADO LIMITED LIABILITY COMPANY", "YM", "LLC"),
    ("Door Co (THE)", "DOOR", "CO"), ("SPRS, A DIVISION OF CSC", "SPRS A DIVISION OF CSC", None), ("HORNINGS INC., A", "HORNINGS INC A", None),
    ("Café Français Ltd", "CAF FRAN AIS", "LTD"), ("L.L.C.", None, "LLC"), ("   ", None, None), ("...", None, None), (None, None, None),
    ("X, A Professional Corporation", "X", "CORPORATION"), ("a\tb\nLLC", "A B", "LLC"), ("CO CO CO", None, "CO CO CO"),
]


def _plain(raw):
    """The rules once more, word by word."""
    if raw is None:
        return None, None
    text = raw.upper().replace("&", " AND ")
    for c in ".'’":
        text = text.replace(c, "")
    fallback = None
    while True:
        cut = re.sub(r"\(\s*THE\s*\)\s*$", "", text)
        found = re.search(r",\s*A\s+(\S.*)$", text)
        words = re.findall("[A-Z0-9]+", found[1]) if found else []
        if cut != text:
            text = cut.rstrip()
        elif words and all(w in CLAUSE_WORDS for w in words):
            fallback = fallback or (words[-1] if words[-1] in SUFFIXES else None)
            text = text[: found.start()].rstrip()
        else:
            break
    tokens = re.sub("[^A-Za-z0-9 ]", " ", text).split()
    k = len(tokens)
    while k and tokens[k - 1] in SUFFIXES:
        k -= 1
    return " ".join(tokens[:k]) or None, (" ".join(tokens[k:]) or (fallback if tokens else None)) or None


def test_normalize_fixed_and_random(spark):
    rng = random.Random(8)
    parts = ["ACME", "Smith", ", A ", "COLORADO", "LLC", "(THE)", " & ", "L.L.C.", "CO", "é", "'s", "OF", "corporation", "  ", "-", "9"]
    texts = [c[0] for c in CASES] + [" ".join(rng.choices(parts, k=rng.randrange(1, 7))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: (r["n"]["name_clean"], r["n"]["suffix"]) for r in df.select("i", normalize_name(F.col("t")).alias("n")).collect()}
    for i, (_, name, suffix) in enumerate(CASES):
        assert got[i] == (name, suffix), CASES[i]
    for i, t in enumerate(texts):
        assert got[i] == _plain(t), t


def test_keys(spark):
    df = spark.createDataFrame(
        [("SMITH JOHN A", "6482 East Kotrukon Road", "8000"), ("ACME PAVING", "P O Box 9", "80001-1234"), ("A1 B2", None, None), ("SOLO", "", "")], "n string, a string, z string"
    )
    n = F.col("n")
    got = [tuple(r) for r in df.select(keys.person_key(n), keys.address_key(F.col("a")), keys.zip5(F.col("z")), keys.name_rest(n), keys.signature(n), keys.first_two_blocks(n)).collect()]
    assert got[0] == ("SMITH|JOHN", "6482 E KOTRUKON RD", "08000", "JOHNA", "JOHN SMITH", "SMIT|JOHN")
    assert got[1][:3] == (None, "PO BOX 9", "80001")
    assert got[2][:3] == (None, "", None) and got[2][4] is None
    assert got[3][3] == "SOLO" and got[3][5] is None
    share = spark.range(5000).select(keys.is_holdout(F.col("id").cast("string")).cast("int").alias("h")).agg(F.avg("h")).first()[0]
    assert 0.08 < share < 0.12
    assert spark.createDataFrame([("  x ",)], "t string").select(norm_key(F.col("t"))).first()[0] == "X"


def test_rules(spark):
    words, names = ["CRANE", "PAVING", "DRILL", "QUARRY"], ["CRANE", "QUARRY"]
    want = {
        "BOBS CRANES": True, "JIMS CRANE": True, "JIM CRANE": False, "CRANE & SON, INC.": False, "DUFFY CRANE INC": True, "CRANE PAVING": True,
        "CRANEBROOK LLC": False, "CRANE ROBERT LLC": False, "MOD SQUAD DRILL TEAM": False, "ACME DRILL": True, None: False, "": False,
    }
    df = spark.createDataFrame([(k,) for k in want], "t string")
    got = {r[0]: r[1] for r in df.select("t", rules.has_trade_word(F.col("t"), words, names, r"\bDRILLS?\s+TEAM\b", r"\b(?:INC|LLC)\b", r"& SON\b")).collect()}
    assert got == want
    plurals = spark.createDataFrame([("WRENCHES",), ("WRENCHS",), ("BUS",), ("BUSS",)], "t string").select(rules.has_word(F.col("t"), ["WRENCH", "BUS"]))
    assert [r[0] for r in plurals.collect()] == [True, True, True, False]
    assert df.select(rules.mask(F.lit("ACME  CRANES paving co"), words)).first()[0] == "ACME CO"


def test_coherence(spark):
    want = {("WESTERN CLEAN UP", "WESTERN CLEANUP CORPERATION"): True, ("COOPERS CONST", "COOPERS CONSTRUCTION"): True, ("ACE", "ACE HARDWARE"): False,
            ("SMITH PAVING", "SMYTH PAVING"): True, ("", ""): True, ("A B", "ZETA"): False, ("ABCDEFGH", "ABCDEFGH IJKLMNOPQRSTU"): False}
    df = spark.createDataFrame(list(want), "a string, b string")
    assert {(r[0], r[1]): r[2] for r in df.select("a", "b", coherent(F.col("a"), F.col("b"))).collect()} == want
    assert [r[0] for r in df.select(coherent(F.col("b"), F.col("a"))).collect()] == list(want.values())


def test_jaro_winkler(spark):
    assert jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler("SCHULTE MARY J", "SCHULTE ALLEN J") == pytest.approx(0.9038, abs=1e-4)
    assert jaro_winkler("", "") == jaro_winkler("a", "") == 0.0
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(6)
    pairs = [("".join(rng.choices("ABCDE ", k=rng.randrange(1, 14))), "".join(rng.choices("ABCDE ", k=rng.randrange(1, 14)))) for _ in range(800)] + [(None, "A"), ("A", None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    scored = df.select("a", "b", jw_sql(a, b).alias("s"), jw_always(a, b).alias("t"), jw_bound(a, b).alias("u"), token_min(a, b).alias("m"), coherent(a, b).alias("c")).collect()
    con = duckdb.connect()
    for r in scored:
        if r["a"] is None or r["b"] is None:
            assert r["s"] is None
            continue
        assert r["s"] == pytest.approx(con.execute("SELECT jaro_winkler_similarity(?, ?)", [r["a"], r["b"]]).fetchall()[0][0], abs=1e-12)
        assert r["s"] <= r["u"] + 1e-12 and r["t"] <= r["u"] + 1e-12 and r["s"] <= r["t"] + 1e-12


def test_udf_on_distinct_keeps_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([("AB", "AC", 1), ("AB", "AC", 2), (None, "X", 3), ("AB", "ZZ", 4)], "a string, b string, _k0 int")
    out = udf_on_distinct(df.withColumnRenamed("_k0", "n"), ["a", "b"], jw_sql, "jw").collect()
    assert len(out) == 4 and sum(r["jw"] is None for r in out) == 1
