"""Design-weighted evaluation: intervals, weighted confusion, thresholds, calibration, bootstrap."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959963984540054
#: Ranges of scores that are summed before the scores within them.
CELLS = 64


def wilson(hits: Column, n: Column, z: float = Z) -> Column:
    """struct(low, high) of the Wilson interval of hits among n; null for n = 0."""
    p = F.try_divide(hits, n)
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.struct(F.greatest(middle - half, F.lit(0.0)).alias("low"), F.least(middle + half, F.lit(1.0)).alias("high")))


def design_weights(sample: DataFrame, probability: str) -> DataFrame:
    """The sample with ``weight`` = 1 / inclusion probability."""
    return sample.withColumn("weight", F.try_divide(F.lit(1.0), F.col(probability)))


def reconstruction(sample: DataFrame, stratum: str, population: str) -> DataFrame:
    """For each stratum the sum of weights against its size, and whether they agree to a millionth."""
    out = sample.groupBy(stratum).agg(F.sum("weight").alias("estimate"), F.max(population).alias("size"))
    return out.withColumn("agrees", F.abs(F.col("estimate") - F.col("size")) <= 1e-6 * F.col("size"))


def weighted_confusion(scored: DataFrame, truth: str, decided: str, weight: str) -> DataFrame:
    """One row of weighted tp, fp, fn, tn, precision, recall and F1."""
    w, y, d = F.col(weight), F.col(truth), F.col(decided)
    cell = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))
    out = scored.agg(cell(y & d).alias("tp"), cell(~y & d).alias("fp"), cell(y & ~d).alias("fn"), cell(~y & ~d).alias("tn"))
    out = out.withColumns({"precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def stratified_precision(labelled: DataFrame, stratum: str, good: str, population: DataFrame) -> DataFrame:
    """One row (precision, standard_error, n): the strata's shares weighted by their sizes in ``population`` (stratum, size)."""
    s = labelled.groupBy(stratum).agg(F.count("*").alias("n"), F.avg(F.col(good).cast("double")).alias("p")).join(population, stratum)
    total = F.sum("size").over(Window.partitionBy())
    part = s.withColumn("share", F.col("size") / total)
    variance = F.pow("share", F.lit(2)) * F.col("p") * (1 - F.col("p")) / F.greatest(F.col("n") - 1, F.lit(1))
    return part.agg(F.sum(F.col("share") * F.col("p")).alias("precision"), F.sqrt(F.sum(variance)).alias("standard_error"), F.sum("n").alias("n"))


def running_sums(scored: DataFrame, score: str, *sums: str) -> DataFrame:
    """(score, sums, and each sum over all scores from the highest down to this one, as up_<sum>) for each distinct score.

    Distinct scores may be as many as rows, so no window runs over all of them: scores are cut into CELLS ranges by
    their quantiles, ranges are summed and added up first, and a range's scores then only within it.
    """
    per = scored.filter(F.col(score).isNotNull()).groupBy(score).agg(*[F.sum(s).alias(s) for s in sums])
    cuts = per.agg(F.percentile_approx(score, [k / CELLS for k in range(1, CELLS)], 10 * CELLS)).first()[0] or []
    cell = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c < F.col(score))) if cuts else F.lit(0)
    per = per.withColumn("_cell", cell)
    above = Window.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = per.groupBy("_cell").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    ranges = ranges.select("_cell", *[F.coalesce(F.sum(f"_{s}").over(above), F.lit(0.0)).alias(f"_{s}") for s in sums])
    within = Window.partitionBy("_cell").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.join(F.broadcast(ranges), "_cell").select(score, *sums, *[(F.col(f"_{s}") + F.sum(s).over(within)).alias(f"up_{s}") for s in sums])


def threshold_choice(scored: DataFrame, score: str, truth: str, weight: str, precision: float) -> DataFrame:
    """The lowest score at which weighted precision holds, hence the largest recall: (threshold, precision, recall); no row if none."""
    w = F.col(weight).cast("double")
    parts = scored.select(score, F.when(F.col(truth), w).otherwise(0.0).alias("t"), F.when(~F.col(truth), w).otherwise(0.0).alias("f"))
    total = parts.agg(F.sum("t")).first()[0]
    out = running_sums(parts, score, "t", "f").select(
        F.col(score).alias("threshold"), F.try_divide(F.col("up_t"), F.col("up_t") + F.col("up_f")).alias("precision"), F.try_divide(F.col("up_t"), F.lit(total)).alias("recall")
    )
    return out.filter(F.col("precision") >= precision).orderBy(F.desc("recall"), "threshold").limit(1)


def select_threshold(scored: DataFrame, score: str, truth: str, weight: str, precision: float, least: int) -> DataFrame:
    """One row (threshold, status, fallback, precision, recall, f1, positives): the threshold of a model to be shipped.

    Of the thresholds with ``least`` cases or more the one of most weighted recall whose weighted precision holds,
    ties by precision and then the higher one, is ``production``; else the one of best F1, or a half where no
    threshold has so many cases, is ``experimental`` with the reason.
    """
    w = F.col(weight).cast("double")
    parts = scored.select(score, F.when(F.col(truth), w).otherwise(0.0).alias("t"), F.when(~F.col(truth), w).otherwise(0.0).alias("f"), F.lit(1.0).alias("n"))
    total = parts.agg(F.sum("t")).first()[0] or 0.0
    p, r = F.try_divide(F.col("up_t"), F.col("up_t") + F.col("up_f")), F.try_divide(F.col("up_t"), F.lit(total))
    curve = running_sums(parts, score, "t", "f", "n").select(F.col(score).alias("threshold"), p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), F.col("up_n").cast("long").alias("positives"))
    enough = curve.filter(F.col("positives") >= least)
    held = enough.filter(F.col("precision") >= precision).orderBy(F.desc("recall"), F.desc("precision"), F.desc("threshold")).take(1)
    best = held or enough.orderBy(F.desc("f1"), F.desc("threshold")).take(1)
    status, why = ("production", None) if held else ("experimental", "max_f1" if best else "too_few_cases")
    if best:
        row = tuple(best[0])
    else:
        at = parts.filter(F.col(score) >= 0.5).agg(F.sum("t"), F.sum("f"), F.count("*")).first()
        hit, miss = at[0] or 0.0, at[1] or 0.0
        q, c = (hit / (hit + miss) if hit + miss else None), (hit / total if total else None)
        row = (0.5, q, c, 2 * q * c / (q + c) if q and c else 0.0, at[2])
    return scored.sparkSession.createDataFrame(
        [(row[0], status, why, *row[1:])], "threshold double, status string, fallback string, precision double, recall double, f1 double, positives long"
    )


def average_precision(scored: DataFrame, score: str, truth: str, weight: str) -> DataFrame:
    """One row: the weighted average precision, ties of a score counted together."""
    w = F.col(weight).cast("double")
    parts = scored.select(score, F.when(F.col(truth), w).otherwise(0.0).alias("t"), w.alias("w"))
    total = parts.agg(F.sum("t")).first()[0]
    out = running_sums(parts, score, "t", "w")
    return out.agg(F.sum(F.try_divide(F.col("t"), F.lit(total)) * F.try_divide(F.col("up_t"), F.col("up_w"))).alias("average_precision"))


def calibration(scored: DataFrame, score: str, truth: str, weight: str, bins: int = 10) -> DataFrame:
    """Bins of equal width with weight, mean score, share of truths and gap; ``ece`` is the weighted mean gap."""
    cell = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    per = scored.groupBy(cell.alias("bin")).agg(
        F.sum(weight).alias("w"), (F.sum(F.col(score) * F.col(weight)) / F.sum(weight)).alias("mean_score"),
        (F.sum(F.col(truth).cast("double") * F.col(weight)) / F.sum(weight)).alias("share"),
    )
    out = per.withColumn("gap", F.abs(F.col("mean_score") - F.col("share")))
    return out.withColumn("ece", F.sum(F.col("gap") * F.col("w")).over(Window.partitionBy()) / F.sum("w").over(Window.partitionBy()))


def kish(sample: DataFrame, weight: str) -> DataFrame:
    """One row: rows, sum of weights and the effective size (sum w)^2 / sum w^2."""
    return sample.agg(F.count("*").alias("n"), F.sum(weight).alias("w"), F.try_divide(F.pow(F.sum(weight), F.lit(2)), F.sum(F.col(weight) * F.col(weight))).alias("n_eff"))


def cluster_bootstrap(cells: list[tuple[str, str, float, float, float]], draws: int, seed: int) -> dict[str, tuple[float, float, float]]:
    """(mean, low, high) of precision and recall by a Bayesian bootstrap of clusters within strata.

    ``cells`` are (stratum, cluster, tp, fp, fn) sums, made by a distributed aggregation of a labelled sample,
    which is bounded by the labelling.  Each draw weighs a stratum's clusters by Dirichlet weights, and a
    Jeffreys half is added to either side of a share.
    """
    rng = np.random.default_rng(seed)
    strata = sorted({c[0] for c in cells})
    sums = np.zeros((draws, 3))
    for s in strata:
        part = np.array([c[2:] for c in sorted(cells) if c[0] == s], float)
        weights = rng.gamma(1.0, size=(draws, len(part)))
        sums += len(part) * (weights / weights.sum(axis=1, keepdims=True)) @ part
    out = {}
    for name, other in (("precision", 1), ("recall", 2)):
        share = (sums[:, 0] + 0.5) / (sums[:, 0] + sums[:, other] + 1)
        out[name] = (float(share.mean()), float(np.quantile(share, 0.025)), float(np.quantile(share, 0.975)))
    return out


def probability_gate(scored: DataFrame, score: str, truth: str, weight: str, most: float = 0.10, region: float = 0.3, region_most: float = 0.15, least: int = 20) -> DataFrame:
    """One row (ece, region_ece, region_cases, score_type): whether a score may be called a probability.

    It may if the weighted calibration error is small over all cases and over those at ``region`` or above, of which
    there must be ``least``.
    """
    gap = lambda df: (df.agg(F.max("ece")).first() or [None])[0]
    upper = scored.filter(F.col(score) >= region)
    cases = upper.count()
    ece = gap(calibration(scored, score, truth, weight))
    own = gap(calibration(upper, score, truth, weight)) if cases >= least else None
    good = ece is not None and ece <= most and own is not None and own <= region_most
    return scored.sparkSession.createDataFrame([(ece, own, cases, "calibrated_probability" if good else "raw_score")], "ece double, region_ece double, region_cases long, score_type string")


def banded_precision(labelled: DataFrame, scored: DataFrame, score: str, truth: str, edges: list[float]) -> DataFrame:
    """(threshold, precision, low, high, n, recall): precision from each band of scores up, the bands weighted by their sizes.

    ``labelled`` is a sample with ``truth``, ``scored`` all that was scored; recall is the share of the estimated true
    ones.  Bands without labels count for nothing.
    """
    band = lambda c: sum((F.col(c) >= e).cast("int") for e in edges[1:-1]) if len(edges) > 2 else F.lit(0)
    inside = lambda df: df.filter((F.col(score) >= edges[0]) & (F.col(score) < edges[-1]))
    own = inside(labelled).groupBy(band(score).alias("band")).agg(F.count("*").alias("n"), F.avg(F.col(truth).cast("double")).alias("p"))
    sized = own.join(inside(scored).groupBy(band(score).alias("band")).agg(F.count("*").alias("size")), "band")
    # Bands are as few as the edges.
    up = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    true, all_ = F.sum(F.col("size") * F.col("p")), F.sum(F.col("size") * F.col("p")).over(Window.partitionBy())
    rows = sized.select("band", F.sum("n").over(up).alias("n"), F.sum("size").over(up).alias("s"), true.over(up).alias("t"), all_.alias("all"),
                        F.sum(F.pow("size", F.lit(2)) * F.col("p") * (1 - F.col("p")) / F.col("n")).over(up).alias("v"))
    p, half = F.col("t") / F.col("s"), Z * F.sqrt("v") / F.col("s")
    at = F.element_at(F.array(*[F.lit(float(e)) for e in edges[:-1]]), F.col("band") + 1)
    return rows.select(at.alias("threshold"), p.alias("precision"), F.greatest(p - half, F.lit(0.0)).alias("low"), F.least(p + half, F.lit(1.0)).alias("high"), "n", F.try_divide(F.col("t"), F.col("all")).alias("recall"))


def replicate_sums(sample: DataFrame, stratum: str, cluster: str, draws: int, seed: str, **sums: Column) -> DataFrame:
    """(draw, sums): the sums over all rows in each of ``draws`` Bayesian bootstrap replicates of the clusters.

    A cluster's weight in a draw is an exponential number made of the digest of draw and cluster, over the mean of its
    stratum's; so replicates are made where the rows are, and one row a draw is what leaves them.
    """
    per = sample.groupBy(stratum, cluster).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    each = per.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "draw", cluster)), 1, 8), 16, 10).cast("long")
    each = each.withColumn("g", -F.log((digits + 0.5) / float(1 << 32)))
    scaled = each.groupBy("draw", stratum).agg(F.avg("g").alias("mean"), *[F.sum(F.col("g") * F.col(k)).alias(k) for k in sums])
    return scaled.groupBy("draw").agg(*[F.sum(F.try_divide(F.col(k), F.col("mean"))).alias(k) for k in sums])


def split_report(scored: DataFrame, parts: dict[str, Column], stratum: str, cluster: str, truth: str, decided: str, baseline: str, weight: str, draws: int, seed: str) -> DataFrame:
    """(part, arm, n, precision, precision_low, precision_high, recall, recall_low, recall_high) of a model and of the rules it replaces.

    ``parts`` are the values of each dimension by which a split is reported; ``all`` comes first.  Intervals are those
    of ``draws`` replicates of the clusters, a Jeffreys half on either side of each share; the low end of precision is
    at 5 %, one-sided.
    """
    y, out = F.col(truth), None
    for part, value in {"all": F.lit("all"), **parts}.items():
        for arm, said in (("model", F.col(decided)), ("rules", F.col(baseline))):
            cell = lambda c: F.when(c, F.col(weight)).otherwise(0.0)
            own = scored.withColumns({"_part": F.concat_ws(":", F.lit(part), value), "_tp": cell(y & said), "_fp": cell(~y & said), "_fn": cell(y & ~said)})
            point = own.groupBy("_part").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("_tp", "_fp", "_fn")])
            inner = own.withColumns({"_s": F.concat_ws("|", "_part", stratum), "_c": F.concat_ws("|", "_part", cluster)})
            reps = replicate_sums(inner.withColumn("_k", F.struct("_part", "_s")), "_k", "_c", draws, seed, tp=F.col("_tp"), fp=F.col("_fp"), fn=F.col("_fn")) if part == "all" else None
            rate = lambda a, b: (F.col(a) + 0.5) / (F.col(a) + F.col(b) + 1)
            row = point.select(
                F.col("_part").alias("part"), F.lit(arm).alias("arm"), "n", F.try_divide(F.col("_tp"), F.col("_tp") + F.col("_fp")).alias("precision"), F.try_divide(F.col("_tp"), F.col("_tp") + F.col("_fn")).alias("recall")
            )
            if reps is not None:
                ends = reps.agg(
                    F.percentile(rate("tp", "fp"), 0.05).alias("precision_low"), F.percentile(rate("tp", "fp"), 0.975).alias("precision_high"),
                    F.percentile(rate("tp", "fn"), 0.025).alias("recall_low"), F.percentile(rate("tp", "fn"), 0.975).alias("recall_high"),
                )
                row = row.crossJoin(F.broadcast(ends))
            else:
                row = row.select("*", *[F.lit(None).cast("double").alias(c) for c in ("precision_low", "precision_high", "recall_low", "recall_high")])
            out = row if out is None else out.unionByName(row)
    return out
