"""Records, comparison vectors, weights, votes and clusters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.similarity import edit_ratio, token_jaccard
from ledgerloom.operators import fellegi, graph, models, people, votes
from ledgerloom.sources.tables import table

FLOOR = 5.0


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Scored pairs, each unordered pair once with its largest weight."""
    p = table(spark, folder, "predictions_debtors").filter("unique_id_l is not null and unique_id_r is not null and unique_id_l <> unique_id_r and not isnan(match_weight)")
    return p.groupBy(F.least("unique_id_l", "unique_id_r").alias("u"), F.greatest("unique_id_l", "unique_id_r").alias("v")).agg(F.max("match_weight").alias("w")).filter("w is not null")


def _corpus_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "corpus_debtors_eq").filter("unique_id is not null").groupBy(F.col("unique_id").alias("id")).agg(F.min("name_clean").alias("name_clean"), F.min("zipcode").alias("zip"))


def _named_pairs(spark: SparkSession, folder: str) -> DataFrame:
    names = _corpus_names(spark, folder)
    left = names.select(F.col("id").alias("u"), F.col("name_clean").alias("a"), F.substring("zip", 1, 5).alias("zu"))
    right = names.select(F.col("id").alias("v"), F.col("name_clean").alias("b"), F.substring("zip", 1, 5).alias("zv"))
    return _pairs(spark, folder).join(left, "u").join(right, "v")


def party_records(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct party records of the corpus with their ids."""
    return fellegi.build_records(table(spark, folder, "corpus_debtors_eq"), "unique_id").select("unique_id", "n_rows", "example_party_id", *fellegi.PARTS)


def record_redundancy(spark: SparkSession, folder: str) -> DataFrame:
    """Rows for each record, with and without the hold-out."""
    corpus = table(spark, folder, "corpus_debtors_eq")
    part = lambda base: fellegi.build_records(corpus, "unique_id", base).agg(F.count("*").alias("records"), F.sum("n_rows").alias("n_rows"), F.max("n_rows").alias("most")).withColumn("base_only", F.lit(base))
    return part(False).unionByName(part(True))


def _built(spark: SparkSession, folder: str) -> DataFrame:
    return fellegi.build_records(table(spark, folder, "corpus_debtors_eq"), "unique_id")


def gamma_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Comparison patterns of the blocked pairs with their counts."""
    return fellegi.patterns(_built(spark, folder))


def fs_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Blocked pairs of a positive weight under the given m and u."""
    weighed = fellegi.weighed_pairs(_built(spark, folder), 0.0).filter("match_weight > 0")
    return weighed.select("unique_id_l", "unique_id_r", F.round("match_weight", 6).alias("match_weight"), F.round("match_probability", 6).alias("match_probability"))


def fs_weights_tf(spark: SparkSession, folder: str) -> DataFrame:
    """The same with equal names weighed by how rare they are."""
    records = _built(spark, folder)
    weighed = fellegi.adjust_frequency(fellegi.weighed_pairs(records, 0.0).filter("match_weight > 0"), records)
    return weighed.select("unique_id_l", "unique_id_r", F.round("match_weight", 6).alias("match_weight"))


def fs_prior(spark: SparkSession, folder: str) -> DataFrame:
    """The prior that deterministic pairs imply."""
    out = fellegi.deterministic_prior(fellegi.build_records(table(spark, folder, "corpus_debtors_eq"), "unique_id"))
    return out.select("rule_pairs", "all_pairs", F.round("prior", 12).alias("prior"))


def fs_em_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """m and u of every level by expectation maximisation over the patterns."""
    counts = sorted(tuple(r) for r in gamma_patterns(spark, folder).select(*[f"g_{n}" for n in fellegi.GIVEN], "n").collect())
    prior, model = fellegi.estimate(counts)
    rows = [(n, level, float(m), float(u), float(math.log2(m / u)), float(prior)) for n, levels in model.items() for level, (m, u) in enumerate(levels)]
    return spark.createDataFrame(rows, "comparison string, level int, m double, u double, bits double, prior double")


def cluster_map(spark: SparkSession, folder: str) -> DataFrame:
    """The cluster of every id at the floor."""
    return graph.clusters_at(spark, _pairs(spark, folder), FLOOR)


def cluster_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of the clusters and the bar on the largest."""
    return graph.cluster_stats(cluster_map(spark, folder))


def best_links(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs that are the best of one of their ends."""
    return graph.best_links(_pairs(spark, folder).filter(F.col("w") >= FLOOR))


def merge_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The merges of single linkage with their levels, one less than the ids of each cluster."""
    return graph.merge_levels(spark, _pairs(spark, folder), FLOOR)


def coherent_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters whose names all cohere."""
    return graph.coherent_clusters(spark, _pairs(spark, folder), _corpus_names(spark, folder).select("id", "name_clean"), FLOOR)


def churn_base_vs_full(spark: SparkSession, folder: str) -> DataFrame:
    """How many ids change companions when the hold-out joins."""
    pairs = _pairs(spark, folder)
    base = table(spark, folder, "corpus_debtors_eq").filter("not is_holdout and unique_id is not null").select(F.col("unique_id").alias("u")).distinct()
    early = pairs.join(base, "u", "left_semi").join(base.withColumnRenamed("u", "v"), "v", "left_semi").select("u", "v", "w")
    return graph.membership_churn(graph.clusters_at(spark, early, FLOOR), graph.clusters_at(spark, pairs, FLOOR))


def name_floor_grid(spark: SparkSession, folder: str) -> DataFrame:
    """For each name gate the pairs kept and vetoed above the floor."""
    named = _named_pairs(spark, folder).filter("a is not null and b is not null")
    gates = votes.name_floors(F.col("a"), F.col("b"))
    each = named.select("w", F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), votes.veto(F.col("w"), c).alias("w2")) for n, c in gates.items()])).alias("x"))
    return each.groupBy(F.col("x.gate").alias("gate")).agg(F.count_if(F.col("x.w2") >= FLOOR).alias("kept"), F.count_if((F.col("w") >= FLOOR) & (F.col("x.w2") < FLOOR)).alias("vetoed"))


def stage_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Scored pairs by the deterministic rule that decides them, and the undecided."""
    named = _named_pairs(spark, folder).filter("a is not null and b is not null")
    rule = votes.decided_rules(F.col("a"), F.col("b"), F.coalesce(F.col("zu") == F.col("zv"), F.lit(False)))
    return named.groupBy(F.coalesce(rule, F.lit("undecided")).alias("rule")).agg(F.count("*").alias("pairs"))


def consensus_votes(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that at least two of three voters hold: weight, name and ZIP."""
    named = _named_pairs(spark, folder)
    vote = lambda name, c: named.filter(F.coalesce(c, F.lit(False))).select("u", "v", F.lit(name).alias("voter"))
    ballots = vote("weight", F.col("w") >= FLOOR).unionByName(vote("name", F.col("a") == F.col("b"))).unionByName(vote("zip", F.col("zu") == F.col("zv")))
    return votes.consensus(ballots, 2)


def combo_vetoes(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs above the floor that pass a name gate and a ZIP gate, by which gates hold."""
    named = _named_pairs(spark, folder).filter((F.col("w") >= FLOOR) & F.col("a").isNotNull() & F.col("b").isNotNull())
    name_ok = votes.name_floors(F.col("a"), F.col("b"))["edit_60"]
    zip_ok = F.coalesce(F.col("zu") == F.col("zv"), F.lit(True))
    return named.groupBy(name_ok.alias("name_ok"), zip_ok.alias("zip_ok")).agg(F.count("*").alias("pairs"), F.round(F.avg(votes.veto(F.col("w"), name_ok & zip_ok)), 4).alias("mean_weight"))


def threshold_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Precision and recall of the weights against equal names, at several thresholds."""
    named = _named_pairs(spark, folder).filter("a is not null and b is not null").withColumn("truth", F.col("a") == F.col("b"))
    return votes.threshold_grid(named, "w", "truth", [0.0, 2.0, 4.0, 6.0, 8.0, 10.0])


def gazetteer_harvest(spark: SparkSession, folder: str) -> DataFrame:
    """Given names and surnames by the pattern of a middle initial."""
    return votes.harvest_given_names(table(spark, folder, "corpus_debtors_eq").select("name_clean").filter("name_clean is not null").distinct())


def person_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Scored pairs by what the gate for people says."""
    named = _named_pairs(spark, folder).filter("a is not null and b is not null").select("u", "v", "a", "b")
    given = gazetteer_harvest(spark, folder).filter("role = 'given'")
    parsed = people.parse_people(_corpus_names(spark, folder).select("name_clean").filter("name_clean is not null").distinct(), "name_clean", given)
    side = lambda s, c: parsed.select(F.col("name_clean").alias(c), *[F.col(p).alias(f"{p}_{s}") for p in ("surname", "given", "initial")])
    return people.person_gate(named.join(side("l", "a"), "a").join(side("r", "b"), "b")).groupBy("outcome").agg(F.count("*").alias("pairs"))


def linear_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs above the floor scored by a linear model fitted on a bounded sample of equal and unequal names."""
    named = _named_pairs(spark, folder).filter("a is not null and b is not null")
    features = {"edit": edit_ratio(F.col("a"), F.col("b")), "words": token_jaccard(F.col("a"), F.col("b")), "zip": (F.col("zu") == F.col("zv")).cast("int")}
    sample = named.orderBy(F.md5(F.concat("u", "v"))).limit(400).select((F.col("w") >= FLOOR).cast("int").alias("y"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in features.items()])
    data = np.array([tuple(r) for r in sample.collect()], float).reshape(-1, 4)
    beta = models.ridge_logistic(data[:, 1:], data[:, 0]) if len(data) else np.zeros(4)
    return named.filter(F.col("w") >= FLOOR).select("u", "v", F.round(models.linear_bits(features, beta), 6).alias("bits"))


QUERIES = {f.__name__: f for f in (
    party_records, record_redundancy, gamma_patterns, fs_weights, fs_weights_tf, fs_prior, fs_em_parameters, cluster_map, cluster_summary, best_links,
    merge_levels, coherent_clusters, churn_base_vs_full, name_floor_grid, stage_rules, consensus_votes, combo_vetoes, threshold_curve, gazetteer_harvest,
    person_gate, linear_scores,
)}

_RECORDS = """r AS (SELECT name_clean, suffix, address1, city, state, zipcode, count(*) AS n_rows, min(unique_id) AS example_party_id,
    substr(md5(concat_ws('|', name_clean, coalesce(suffix, ''), coalesce(address1, ''), coalesce(city, ''), coalesce(state, ''), coalesce(zipcode, ''))), 1, 16) AS unique_id
    FROM corpus_debtors_eq WHERE name_clean IS NOT NULL GROUP BY ALL)"""


def _sql_ladder(a: str, levels: tuple[float, ...]) -> str:
    bars = "".join(f" WHEN jaro_winkler_similarity(l.{a}, r.{a}) >= {b} THEN {len(levels) - i}" for i, b in enumerate(levels))
    return f"CASE WHEN l.{a} IS NULL OR r.{a} IS NULL THEN -1 WHEN l.{a} = r.{a} THEN {len(levels) + 1}{bars} ELSE 0 END"


_GAMMAS = f"""{_RECORDS}, c AS (SELECT *, substr(zipcode, 1, 5) AS z FROM r),
    g AS (SELECT l.unique_id AS unique_id_l, r.unique_id AS unique_id_r, l.name_clean AS nl, {_sql_ladder("name_clean", fellegi.NAME_LEVELS)} AS g_name, {_sql_ladder("suffix", ())} AS g_suffix,
          {_sql_ladder("address1", fellegi.ADDRESS_LEVELS)} AS g_address, {_sql_ladder("city", ())} AS g_city, {_sql_ladder("z", ())} AS g_zip
          FROM c l JOIN c r ON l.unique_id < r.unique_id AND (l.z = r.z OR substr(l.name_clean, 1, 4) = substr(r.name_clean, 1, 4)))"""
_BITS = " + ".join(
    "CASE " + " ".join(f"WHEN g_{n} = {i} THEN {math.log2(m / u)!r}e0" for i, (m, u) in enumerate(levels)) + " ELSE 0 END" for n, levels in fellegi.GIVEN.items()
)
_WEIGHED = f"{_GAMMAS}, w AS (SELECT *, {math.log2(fellegi.PRIOR / (1 - fellegi.PRIOR))!r}e0 + {_BITS} AS mw FROM g)"
_SCORED = """p AS (SELECT least(unique_id_l, unique_id_r) AS u, greatest(unique_id_l, unique_id_r) AS v, max(match_weight) AS w FROM predictions_debtors
    WHERE unique_id_l IS NOT NULL AND unique_id_r IS NOT NULL AND unique_id_l <> unique_id_r AND match_weight IS NOT NULL AND NOT isnan(match_weight) GROUP BY 1, 2)"""
_NAMED = f"""{_SCORED}, n AS (SELECT unique_id AS id, min(name_clean) AS nc, substr(min(zipcode), 1, 5) AS z FROM corpus_debtors_eq WHERE unique_id IS NOT NULL GROUP BY 1),
    q AS (SELECT p.*, x.nc AS a, y.nc AS b, x.z AS zu, y.z AS zv FROM p JOIN n x ON x.id = p.u JOIN n y ON y.id = p.v)"""
_RATIO = "(1 - levenshtein(a, b) / greatest(length(a), length(b), 1))"
_WORDS = "list_sort(string_split(a, ' ')) = list_sort(string_split(b, ' '))"
_GATES = {
    "none": "true", "first_letter": "substr(a, 1, 1) = substr(b, 1, 1)", "edit_50": f"{_RATIO} >= 0.5", "edit_60": f"{_RATIO} >= 0.6", "edit_72": f"{_RATIO} >= 0.72",
    "edit_80": f"{_RATIO} >= 0.8", "edit_90": f"{_RATIO} >= 0.9", "equal_words": _WORDS, "equal": "a = b",
}
_CLUSTERS = f"""{_SCORED}, e AS (SELECT u AS a, v AS b FROM p WHERE w >= {FLOOR} UNION SELECT v, u FROM p WHERE w >= {FLOOR}), i AS (SELECT u AS id FROM p UNION SELECT v FROM p),
    s AS (SELECT id, id AS seen FROM i UNION SELECT s.id, e.b FROM s JOIN e ON s.seen = e.a), m AS (SELECT id, min(seen) AS cluster FROM s GROUP BY 1)"""

ORACLE = {
    "party_records": f"WITH {_RECORDS} SELECT * FROM r",
    "record_redundancy": " UNION ALL ".join(
        f"SELECT count(*) AS records, CAST(sum(n) AS BIGINT) AS n_rows, max(n) AS most, {str(b).lower()} AS base_only FROM (SELECT count(*) AS n FROM corpus_debtors_eq WHERE name_clean IS NOT NULL {'AND NOT is_holdout' if b else ''} GROUP BY name_clean, suffix, address1, city, state, zipcode)"
        for b in (False, True)
    ),
    "gamma_patterns": f"WITH {_GAMMAS} SELECT g_name, g_suffix, g_address, g_city, g_zip, count(*) AS n FROM g GROUP BY ALL",
    "fs_weights": f"WITH {_WEIGHED} SELECT unique_id_l, unique_id_r, round(mw, 6) AS match_weight, round(1 / (1 + pow(2.0, -mw)), 6) AS match_probability FROM w WHERE mw > 0",
    "fs_weights_tf": f"""WITH {_WEIGHED}, f AS (SELECT name_clean, count(*) / (SELECT count(*) FROM r) AS tf FROM r GROUP BY 1)
        SELECT unique_id_l, unique_id_r, round(mw + CASE WHEN g_name = 4 THEN log2({fellegi.GIVEN["name"][-1][1]}e0 / tf) ELSE 0 END, 6) AS match_weight FROM w JOIN f ON f.name_clean = nl WHERE mw > 0""",
    "fs_prior": f"""WITH {_RECORDS}, s AS (SELECT count(*) AS c FROM r WHERE zipcode IS NOT NULL GROUP BY name_clean, substr(zipcode, 1, 5)), t AS (SELECT count(*) AS n FROM r)
        SELECT CAST(coalesce((SELECT sum(c * (c - 1) // 2) FROM s), 0) AS BIGINT) AS rule_pairs, n * (n - 1) // 2 AS all_pairs,
               round(coalesce((SELECT sum(c * (c - 1) // 2) FROM s), 0) / 0.8 / (n * (n - 1) // 2), 12) AS prior FROM t""",
    "cluster_map": f"WITH RECURSIVE {_CLUSTERS} SELECT id, cluster FROM m",
    "cluster_summary": f"""WITH RECURSIVE {_CLUSTERS}, z AS (SELECT count(*) AS n FROM m GROUP BY cluster)
        SELECT count(*) AS clusters, CAST(median(n) AS DOUBLE) AS p50, CAST(quantile_cont(n, 0.95) AS DOUBLE) AS p95, max(n) AS largest, CAST(sum(n) AS BIGINT) AS ids,
               round(100 * max(n) / sum(n), 4) AS largest_pct, round(100 * max(n) / sum(n), 4) <= 1.0 AS within_bar FROM z""",
    "churn_base_vs_full": f"""
        WITH RECURSIVE {_CLUSTERS}, b AS (SELECT DISTINCT unique_id AS id FROM corpus_debtors_eq WHERE NOT is_holdout AND unique_id IS NOT NULL), p0 AS (SELECT p.* FROM p WHERE u IN (SELECT id FROM b) AND v IN (SELECT id FROM b)),
        e0 AS (SELECT u AS a, v AS b FROM p0 WHERE w >= {FLOOR} UNION SELECT v, u FROM p0 WHERE w >= {FLOOR}), i0 AS (SELECT u AS id FROM p0 UNION SELECT v FROM p0),
        s0 AS (SELECT id, id AS seen FROM i0 UNION SELECT s0.id, e0.b FROM s0 JOIN e0 ON s0.seen = e0.a), m0 AS (SELECT id, min(seen) AS cluster FROM s0 GROUP BY 1),
        j AS (SELECT m0.id, m0.cluster AS c0, m.cluster AS c1 FROM m0 JOIN m ON m.id = m0.id), c AS (SELECT *, count(*) OVER (PARTITION BY c0) AS n0, count(*) OVER (PARTITION BY c1) AS n1, count(*) OVER (PARTITION BY c0, c1) AS n01 FROM j)
        SELECT count(*) AS ids, count(*) FILTER (WHERE n01 < n0 OR n01 < n1) AS changed FROM c""",
    "best_links": f"""WITH {_SCORED}, s AS (SELECT u AS node, * FROM p WHERE w >= {FLOOR} UNION ALL SELECT v, * FROM p WHERE w >= {FLOOR}),
        k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, u, v) AS rn FROM s) SELECT DISTINCT u, v, w FROM k WHERE rn = 1""",
    "name_floor_grid": f"WITH {_NAMED} " + " UNION ALL ".join(
        f"SELECT '{g}' AS gate, count(*) FILTER (WHERE w >= {FLOOR} AND {c}) AS kept, count(*) FILTER (WHERE w >= {FLOOR} AND NOT ({c})) AS vetoed FROM q WHERE a IS NOT NULL AND b IS NOT NULL" for g, c in _GATES.items()
    ),
    "stage_rules": f"""WITH {_NAMED} SELECT CASE WHEN a = b THEN 'S1' WHEN {_WORDS} THEN 'S2' WHEN least(length(a), length(b)) >= 8 AND levenshtein(a, b) <= 1 THEN 'S3'
        WHEN coalesce(zu = zv, false) AND CASE WHEN length(a) >= length(b) THEN starts_with(a, b || ' ') ELSE starts_with(b, a || ' ') END THEN 'S4' ELSE 'undecided' END AS rule,
        count(*) AS pairs FROM q WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""",
    "consensus_votes": f"""WITH {_NAMED}, b AS (SELECT u, v, 'weight' AS voter FROM q WHERE w >= {FLOOR} UNION ALL SELECT u, v, 'name' FROM q WHERE a = b UNION ALL SELECT u, v, 'zip' FROM q WHERE zu = zv)
        SELECT u, v, count(DISTINCT voter) AS votes, string_agg(DISTINCT voter, '+' ORDER BY voter) AS voters FROM b GROUP BY 1, 2 HAVING count(DISTINCT voter) >= 2""",
    "combo_vetoes": f"""WITH {_NAMED}, k AS (SELECT w, {_RATIO} >= 0.6 AS name_ok, coalesce(zu = zv, true) AS zip_ok FROM q WHERE w >= {FLOOR} AND a IS NOT NULL AND b IS NOT NULL)
        SELECT name_ok, zip_ok, count(*) AS pairs, round(avg(CASE WHEN name_ok AND zip_ok THEN w ELSE -999.0 END), 4) AS mean_weight FROM k GROUP BY 1, 2""",
    "threshold_curve": f"""WITH {_NAMED}, t AS (SELECT unnest([0.0, 2.0, 4.0, 6.0, 8.0, 10.0])::DOUBLE AS threshold),
        k AS (SELECT threshold, count(*) FILTER (WHERE w >= threshold) AS merged, count(*) FILTER (WHERE w >= threshold AND a = b) AS tp, count(*) FILTER (WHERE w >= threshold AND a <> b) AS fp,
              count(*) FILTER (WHERE a = b) AS pos FROM q, t WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1)
        SELECT threshold, merged, tp, fp, CASE WHEN merged > 0 THEN round(tp / merged, 6) END AS precision, CASE WHEN pos > 0 THEN round(tp / pos, 6) END AS recall FROM k""",
    "gazetteer_harvest": """
        WITH n AS (SELECT DISTINCT string_split(name_clean, ' ') AS t FROM corpus_debtors_eq WHERE name_clean IS NOT NULL AND NOT regexp_matches(name_clean, '[0-9]')),
        k AS (SELECT t[1] AS word, 'surname' AS role FROM n WHERE len(t) = 3 AND length(t[3]) = 1 UNION ALL SELECT t[2], 'given' FROM n WHERE len(t) = 3 AND length(t[3]) = 1),
        c AS (SELECT word, role, count(*) AS n FROM k GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, role DESC) AS rn FROM c)
        SELECT word, role, n FROM r WHERE rn = 1 AND n >= 2""",
}
