"""Records, comparison vectors and Fellegi-Sunter weights: given, estimated, adjusted for frequency."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.keys import record_id
from ledgerloom.functions.similarity import jw_bound, jw_sql
from ledgerloom.operators import tiles

PARTS = ("name_clean", "suffix", "address1", "city", "state", "zipcode")
#: Levels of each comparison from the highest; 0 is "else", -1 is a null on either side.
NAME_LEVELS, ADDRESS_LEVELS = tiles.NAME, tiles.ADDRESS
#: Published m and u of each level, by comparison; level 0 first.
GIVEN = {
    "name": ((0.05, 0.99), (0.05, 0.006), (0.1, 0.002), (0.2, 0.0015), (0.6, 0.0005)),
    "suffix": ((0.1, 0.6), (0.9, 0.4)),
    "address": ((0.2, 0.98), (0.1, 0.015), (0.2, 0.004), (0.5, 0.001)),
    "city": ((0.15, 0.95), (0.85, 0.05)),
    "zip": ((0.15, 0.97), (0.85, 0.03)),
}
PRIOR = 1e-4


def build_records(corpus: DataFrame, key: str, base_only: bool = False) -> DataFrame:
    """Distinct party records with a content id, their rows and their smallest party id.

    ``base_only`` leaves the hold-out away.  Rows without clean name make no record.
    """
    rows = corpus.filter("name_clean is not null")
    if base_only:
        rows = rows.filter("not is_holdout")
    return rows.groupBy(*PARTS).agg(F.count("*").alias("n_rows"), F.min(key).alias("example_party_id")).withColumn("unique_id", record_id(*PARTS))


def candidate_pairs(records: DataFrame) -> DataFrame:
    """Pairs of records that agree in ZIP or in the name's first four letters, each once, with their parts."""
    keyed = records.select("unique_id", *PARTS, F.substring("zipcode", 1, 5).alias("b1"), F.substring("name_clean", 1, 4).alias("b2"))
    left = keyed.select(*[F.col(c).alias(f"{c}_l") for c in keyed.columns])
    right = keyed.select(*[F.col(c).alias(f"{c}_r") for c in keyed.columns])
    ordered = F.col("unique_id_l") < F.col("unique_id_r")
    first = left.join(right, (F.col("b1_l") == F.col("b1_r")) & ordered)
    second = left.join(right, (F.col("b2_l") == F.col("b2_r")) & ordered & ~F.coalesce(F.col("b1_l") == F.col("b1_r"), F.lit(False)))
    return first.unionByName(second).drop("b1_l", "b1_r", "b2_l", "b2_r")


def _ladder(a: Column, b: Column, score: Column | None, levels: tuple[float, ...]) -> Column:
    out = F.when(a.isNull() | b.isNull(), -1).when(a == b, len(levels) + 1)
    for i, bar in enumerate(levels):
        out = out.when(score >= bar, len(levels) - i)
    return out.otherwise(0)


def gamma_vectors(pairs: DataFrame) -> DataFrame:
    """The pairs with the level of each comparison; strings whose bound misses the lowest bar reach Python as nulls.

    Records are distinct, and so are nearly all their pairs of names: they are compared where they are, without
    a join back.
    """
    for part, name in (("name_clean", "name"), ("address1", "address")):
        a, b = F.col(f"{part}_l"), F.col(f"{part}_r")
        near = a.isNotNull() & b.isNotNull() & (a != b) & (jw_bound(a, b) >= 0.7)
        pairs = pairs.withColumn(f"jw_{name}", jw_sql(F.when(near, a), F.when(near, b)))
    side = lambda c: (F.col(f"{c}_l"), F.col(f"{c}_r"))
    jw = lambda n: F.coalesce(F.col(f"jw_{n}"), F.lit(0.0))
    z = [F.substring(f"zipcode_{s}", 1, 5) for s in ("l", "r")]
    return pairs.select(
        "unique_id_l", "unique_id_r", "name_clean_l", "name_clean_r",
        _ladder(*side("name_clean"), jw("name"), NAME_LEVELS).alias("g_name"),
        _ladder(*side("suffix"), None, ()).alias("g_suffix"),
        _ladder(*side("address1"), jw("address"), ADDRESS_LEVELS).alias("g_address"),
        _ladder(*side("city"), None, ()).alias("g_city"),
        _ladder(*z, None, ()).alias("g_zip"),
    )


def weigh(gammas: DataFrame, model: dict = GIVEN, prior: float = PRIOR) -> DataFrame:
    """The vectors with match_weight in bits and match_probability; a null comparison adds nothing."""
    weight = F.lit(math.log2(prior / (1 - prior)))
    for name, levels in model.items():
        bits = F.lit(0.0)
        for level, (m, u) in enumerate(levels):
            bits = F.when(F.col(f"g_{name}") == level, math.log2(m / u)).otherwise(bits)
        weight = weight + bits
    return gammas.withColumn("match_weight", weight).withColumn("match_probability", 1 / (1 + F.pow(F.lit(2.0), -F.col("match_weight"))))


def weighed_pairs(records: DataFrame, least: float, model: dict = GIVEN, prior: float = PRIOR) -> DataFrame:
    """The blocked pairs of a weight of about ``least`` or more, weighed; the caller draws the line itself."""

    def bits(levels: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(levels[0]), math.log2(prior / (1 - prior)))
        for name, level in zip(GIVEN, levels):
            own = [math.log2(m / u) for m, u in model.get(name, ())]
            # The last entry is for a null, and for what the model leaves out.
            table = np.array([*own, *[0.0] * (len(GIVEN[name]) + 1 - len(own))])
            out += table[level]
        return out

    return weigh(tiles.weighty(records, bits, least - 1e-6), model, prior)


def adjust_frequency(weighed: DataFrame, records: DataFrame, model: dict = GIVEN) -> DataFrame:
    """Equal names weigh more the rarer they are: log2 of the level's u over the name's own frequency."""
    total = records.count()
    freq = records.groupBy(F.col("name_clean").alias("name_clean_l")).agg((F.count("*") / F.lit(float(max(total, 1)))).alias("tf"))
    u = model["name"][-1][1]
    bits = F.when(F.col("g_name") == len(model["name"]) - 1, F.log2(F.lit(u) / F.col("tf"))).otherwise(0.0)
    return weighed.join(freq, "name_clean_l", "left").withColumn("match_weight", F.col("match_weight") + F.coalesce(bits, F.lit(0.0))).drop("tf")


def patterns(records: DataFrame) -> DataFrame:
    """The comparison vectors of the blocked pairs with how many show each: a few hundred rows whatever the input."""
    return tiles.counted(records).groupBy(*[f"g_{n}" for n in GIVEN]).agg(F.sum("n").alias("n"))


def estimate(counts: list[tuple], prior: float = 0.01, rounds: int = 25, tolerance: float = 1e-4) -> tuple[float, dict]:
    """Prior, m and u by expectation maximisation over pattern counts (levels of each comparison, n).

    Runs on the driver: its input is the bounded table of patterns.  Null levels are left out of a comparison's
    m and u.  Starts from levels that favour agreement; ends when no m or u moves by ``tolerance``.
    """
    names = list(GIVEN)
    g = np.array([c[:-1] for c in counts], int)
    n = np.array([c[-1] for c in counts], float)
    m, u = {}, {}
    for k, name in enumerate(names):
        size = len(GIVEN[name])
        rise = np.arange(1, size + 1, dtype=float)
        m[name], u[name] = rise / rise.sum(), rise[::-1] / rise.sum()
    for _ in range(rounds):
        log_m, log_u = np.zeros(len(n)), np.zeros(len(n))
        for k, name in enumerate(names):
            known = g[:, k] >= 0
            log_m[known] += np.log(m[name][g[known, k]])
            log_u[known] += np.log(u[name][g[known, k]])
        a, b = prior * np.exp(log_m), (1 - prior) * np.exp(log_u)
        p = a / (a + b)
        moved = 0.0
        for k, name in enumerate(names):
            for model, weight in ((m, p * n), (u, (1 - p) * n)):
                fresh = np.array([weight[g[:, k] == level].sum() for level in range(len(GIVEN[name]))]) + 1e-6
                fresh /= fresh.sum()
                moved = max(moved, float(np.abs(fresh - model[name]).max()))
                model[name] = fresh
        prior = float(np.clip((p * n).sum() / n.sum(), 1e-9, 1 - 1e-9))
        if moved < tolerance:
            break
    return prior, {name: tuple(zip(m[name].tolist(), u[name].tolist())) for name in names}


def pick_threshold(bins: list[tuple[float, float]]) -> float:
    """The weight at the lowest point between the two highest peaks of a smoothed histogram; the last bin if there is one peak."""
    peaks = [i for i in range(1, len(bins) - 1) if bins[i - 1][1] <= bins[i][1] > bins[i + 1][1]]
    if len(peaks) < 2:
        return bins[-1][0] if bins else 0.0
    a, b = sorted(sorted(peaks, key=lambda i: (-bins[i][1], i))[:2])
    return min(bins[a : b + 1], key=lambda x: (x[1], x[0]))[0]


def deterministic_prior(records: DataFrame, recall: float = 0.8) -> DataFrame:
    """One row: pairs equal in name and ZIP, all pairs, and the prior they imply at the given recall."""
    same = records.filter("zipcode is not null").groupBy("name_clean", F.substring("zipcode", 1, 5)).agg(F.count("*").alias("c"))
    pairs = same.agg(F.coalesce(F.sum((F.col("c") * (F.col("c") - 1) / 2).cast("long")), F.lit(0)).alias("rule_pairs"))
    total = records.agg((F.count("*") * (F.count("*") - 1) / 2).cast("long").alias("all_pairs"))
    return pairs.crossJoin(F.broadcast(total)).withColumn("prior", F.col("rule_pairs") / F.lit(recall) / F.col("all_pairs"))
