"""The trained linker, deterministic stages and choices on labelled pairs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.keys import bucket, first_two_blocks, signature, squeezed_prefix
from ledgerloom.operators import fellegi, graph, stages, tiles, training, votes
from ledgerloom.operators.people import parse_people, person_gate
from ledgerloom.queries.linkage import _GATES, _GAMMAS, _NAMED, _RECORDS, _SCORED, _built, _named_pairs, _pairs, gazetteer_harvest, _corpus_names
from ledgerloom.sources.tables import table

#: Random pairs for u; the weight from which records are one; what a labelled pair is.
RANDOM_PAIRS, RESOLVE_FLOOR, LABELLED_PERCENT = 2_000_000, 12.0, 20


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return fellegi.build_records(table(spark, folder, "corpus_debtors_eq"), "unique_id").select("unique_id", *fellegi.PARTS)


def _u_counts(spark: SparkSession, folder: str) -> DataFrame:
    return training.level_counts(fellegi.gamma_vectors(training.random_pairs(_records(spark, folder), "unique_id", RANDOM_PAIRS)))


def _labelled_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """A fifth of the blocked pairs by digest, true if the names are equal, or alike at a like address."""
    g = fellegi.gamma_vectors(fellegi.candidate_pairs(_built(spark, folder))).withColumn("pair", F.concat("unique_id_l", "unique_id_r"))
    truth = (F.col("g_name") == 4) | ((F.col("g_name") == 3) & (F.col("g_address") >= 2))
    return g.filter(bucket(F.col("pair"), "labelled") < LABELLED_PERCENT).withColumn("truth", truth)


def fs_u_random(spark: SparkSession, folder: str) -> DataFrame:
    """How often each level shows among pairs drawn at random: u."""
    return _u_counts(spark, folder)


def fs_em_by_rule(spark: SparkSession, folder: str) -> DataFrame:
    """m by expectation maximisation, a pass for each blocking rule with the blocked column held out; u from random pairs."""
    u = training.shares(_u_counts(spark, folder))
    columns = [f"g_{n}" for n in fellegi.GIVEN]
    counts = sorted(tuple(r) for r in tiles.counted(_built(spark, folder)).select(*columns, "same_head", "n").collect())
    zip_ = [(*c[:5], c[6]) for c in counts if c[4] == 1]
    head = [(*c[:5], c[6]) for c in counts if c[5]]
    model = training.joined_model([training.estimate_m(zip_, u, "zip"), training.estimate_m(head, u, "name")], u)
    return spark.createDataFrame(training.model_rows(model), "comparison string, level int, m double, u double, bits double")


def fs_supervised_m(spark: SparkSession, folder: str) -> DataFrame:
    """m of each level from the labelled pairs that are true, a default where none shows it."""
    m = training.shares(training.level_counts(_labelled_vectors(spark, folder).filter("truth")), training.default_m())
    return spark.createDataFrame([(n, k, round(x, 9)) for n, own in m.items() for k, x in enumerate(own)], "comparison string, level int, m double")


def fs_cv_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Precision and recall by threshold, cross-validated and in sample."""
    u = {n: tuple(x[1] for x in levels) for n, levels in fellegi.GIVEN.items()}
    rows = training.cross_validated_curve(_labelled_vectors(spark, folder), bucket(F.col("pair"), "fold", 5), u, fellegi.PRIOR)
    return spark.createDataFrame(rows, "threshold double, curve string, merged long, tp long, fp long, precision double, recall double")


def valley_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The threshold that the rule stated beforehand takes from the histogram of scored pairs."""
    return training.valley_threshold(_pairs(spark, folder), "w")


def fs_scores_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every blocked pair of a weight of -50 or more, in bins of one bit."""
    weighed = fellegi.weigh(fellegi.patterns(_built(spark, folder))).filter("match_weight >= -50")
    return weighed.groupBy(F.floor(F.round("match_weight", 9)).alias("bits")).agg(F.sum("n").alias("pairs"))


def resolve_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """The cluster of every record, resolved from the corpus by its own scores."""
    return training.resolve(spark, table(spark, folder, "corpus_debtors_eq"), "unique_id", fellegi.GIVEN, fellegi.PRIOR, RESOLVE_FLOOR)


def resolve_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of those clusters."""
    return graph.cluster_stats(resolve_clusters(spark, folder))


def stage_one_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records that a deterministic rule decides, with the rule."""
    return stages.stage_one(_records(spark, folder), "unique_id")


def _corpus_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "corpus_debtors_eq").filter("unique_id is not null")
    return rows.groupBy("unique_id").agg(*[F.min(c).alias(c) for c in ("name_clean", "address1", "city", "zipcode")])


def two_stage_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of corpus ids that the rules decide, and the scored ones that they leave open."""
    return stages.two_stages(stages.stage_one(_corpus_rows(spark, folder), "unique_id"), _pairs(spark, folder))


def redesigned_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Scored pairs by the level of the redesigned comparison of their names."""
    return stages.redesigned_level(_named_pairs(spark, folder), "a", "b").groupBy("level").agg(F.count("*").alias("pairs"))


def address_blind_arms(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs above -3 and above -6 bits when only names, forms and towns count."""
    arms = []
    for arm, (kept, least) in stages.ARMS.items():
        # Levels below the arm's least count as no agreement; what the arm leaves out is as null.
        name = F.when(F.col("g_name").between(1, least - 1), 0).otherwise(F.col("g_name"))
        arms.append(F.struct(F.lit(arm).alias("arm"), *[(name if n == "name" else F.col(f"g_{n}") if n in kept else F.lit(-1)).alias(f"g_{n}") for n in fellegi.GIVEN]))
    weighed = fellegi.weigh(fellegi.patterns(_built(spark, folder)).select("n", F.explode(F.array(*arms)).alias("x")).select("n", "x.*"))
    above = lambda arm, bar: F.coalesce(F.sum(F.when((F.col("arm") == arm) & (F.col("match_weight") > bar), F.col("n"))), F.lit(0))
    sums = weighed.agg(*[above(arm, bar).alias(f"{arm}{bar}") for arm in stages.ARMS for bar in (-3, -6)])
    rows = [F.struct(F.lit(arm).alias("arm"), F.col(f"{arm}-3").alias("above_minus_3"), F.col(f"{arm}-6").alias("above_minus_6")) for arm in stages.ARMS]
    return sums.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def blocking_report(spark: SparkSession, folder: str) -> DataFrame:
    """What each block keeps of the scored pairs, true if their names have the same words."""
    named = _named_pairs(spark, folder).filter("a is not null and b is not null")
    for c, s in (("a", "l"), ("b", "r")):
        n = F.col(c)
        named = named.withColumns({f"zip_{s}": F.col("zu" if s == "l" else "zv"), f"first4_{s}": F.substring(n, 1, 4), f"first2_4_{s}": first_two_blocks(n), f"sig4_{s}": signature(n, 4), f"desp12_{s}": squeezed_prefix(n)})
    truth = F.array_sort(F.split("a", " ")) == F.array_sort(F.split("b", " "))
    return stages.blocking_report(named.withColumn("truth", truth), ["zip", "first4", "first2_4", "sig4", "desp12"])


def _named_truth(spark: SparkSession, folder: str) -> DataFrame:
    return _named_pairs(spark, folder).filter("a is not null and b is not null").withColumn("truth", F.coalesce(F.col("zu") == F.col("zv"), F.lit(False)))


BARS = [0.0, 2.0, 4.0, 6.0, 8.0, 10.0]


def floor_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every name gate at every threshold against equal ZIPs."""
    named = _named_truth(spark, folder)
    return stages.floor_grid(named, "w", "truth", votes.name_floors(F.col("a"), F.col("b")), BARS)


def chosen_floor(spark: SparkSession, folder: str) -> DataFrame:
    """The gate and threshold of that grid that the rule picks."""
    return stages.choose_floor(floor_grid(spark, folder))


def chosen_votes(spark: SparkSession, folder: str) -> DataFrame:
    """The fewest of four votes at which no pair differs in ZIP."""
    named = _named_truth(spark, folder)
    ballots = [F.col("w") >= 5.0, F.col("a") == F.col("b"), F.substring("a", 1, 4) == F.substring("b", 1, 4), F.levenshtein("a", "b", 2) >= 0]
    count = sum((F.coalesce(b, F.lit(False)).cast("int") for b in ballots[1:]), F.coalesce(ballots[0], F.lit(False)).cast("int"))
    return stages.choose_votes(named.select(count.alias("votes"), "truth"))


def residual_risk(spark: SparkSession, folder: str) -> DataFrame:
    """What tells the names of pairs above the floor apart."""
    named = _named_pairs(spark, folder).filter("a is not null and b is not null and w >= 5")
    return named.groupBy(stages.difference(F.col("a"), F.col("b")).alias("difference")).agg(F.count("*").alias("pairs"), F.round(F.avg("w"), 6).alias("mean_weight"))


def probe_strata(spark: SparkSession, folder: str) -> DataFrame:
    """Scored pairs by what a labeller should probe: alike names elsewhere, other names at one ZIP, the rest."""
    named = _named_pairs(spark, folder).filter("a is not null and b is not null")
    ratio = 1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"), F.lit(1))
    same_zip = F.coalesce(F.col("zu") == F.col("zv"), F.lit(False))
    probe = F.when(same_zip & (ratio < 0.5), "same_place_other_name").when(~same_zip & (ratio >= 0.8), "same_name_elsewhere").otherwise("rest")
    return named.groupBy(probe.alias("probe"), (F.col("w") >= 5.0).alias("merged")).agg(F.count("*").alias("pairs"))


def token_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Scored pairs above the floor by whether every word has a partner, on both sides."""
    named = _named_pairs(spark, folder).filter("a is not null and b is not null and w >= 5")
    return stages.tokens_agree(named, "a", "b").groupBy("agree").agg(F.count("*").alias("pairs"))


def vetoed_people(spark: SparkSession, folder: str) -> DataFrame:
    """Scored pairs with the veto of the gate for people: kept at VETO_PERSON where two people differ."""
    named = _named_pairs(spark, folder).filter("a is not null and b is not null").select("u", "v", "a", "b", "w")
    given = gazetteer_harvest(spark, folder).filter("role = 'given'")
    parsed = parse_people(_corpus_names(spark, folder).select("name_clean").filter("name_clean is not null").distinct(), "name_clean", given)
    side = lambda s, c: parsed.select(F.col("name_clean").alias(c), *[F.col(p).alias(f"{p}_{s}") for p in ("surname", "given", "initial")])
    gated = person_gate(named.join(side("l", "a"), "a").join(side("r", "b"), "b"))
    return gated.select("u", "v", votes.veto(F.col("w"), F.col("outcome").isin("same", "mixed", "not_people"), votes.VETO_PERSON).alias("w"))


QUERIES = {f.__name__: f for f in (
    fs_u_random, fs_em_by_rule, fs_supervised_m, fs_cv_curve, valley_threshold, fs_scores_all, resolve_clusters, resolve_summary, stage_one_pairs, two_stage_pairs,
    redesigned_levels, address_blind_arms, blocking_report, floor_grid, chosen_floor, chosen_votes, residual_risk, probe_strata, token_agreement, vetoed_people,
)}


def _bits(names: tuple[str, ...], level: str = "g_{0}") -> str:
    return " + ".join("CASE " + " ".join(f"WHEN {level.format(n)} = {i} THEN {math.log2(m / u)!r}e0" for i, (m, u) in enumerate(fellegi.GIVEN[n])) + " ELSE 0 END" for n in names)


_BASE = f"{math.log2(fellegi.PRIOR / (1 - fellegi.PRIOR))!r}e0"
_LADDER = "CASE WHEN l.{0} IS NULL OR r.{0} IS NULL THEN -1 WHEN l.{0} = r.{0} THEN {1}{2} ELSE 0 END"
_bars = lambda c, levels: "".join(f" WHEN jaro_winkler_similarity(l.{c}, r.{c}) >= {b} THEN {len(levels) - i}" for i, b in enumerate(levels))
_VECTOR = ", ".join([
    _LADDER.format("name_clean", 4, _bars("name_clean", (0.92, 0.88, 0.7))) + " AS name", _LADDER.format("suffix", 1, "") + " AS suffix",
    _LADDER.format("address1", 3, _bars("address1", (0.9, 0.7))) + " AS address", _LADDER.format("city", 1, "") + " AS city", _LADDER.format("z", 1, "") + " AS zip",
])
_COUNTED = "SELECT comparison, level, count(*) AS n FROM (UNPIVOT {0} ON name, suffix, address, city, zip INTO NAME comparison VALUE level) WHERE level >= 0 GROUP BY ALL"
_LABELLED = f"""{_GAMMAS}, lv AS (SELECT g_name AS name, g_suffix AS suffix, g_address AS address, g_city AS city, g_zip AS zip, (g_name = 4 OR (g_name = 3 AND g_address >= 2)) AS truth
    FROM g WHERE CAST('0x' || substr(md5('labelled:' || unique_id_l || unique_id_r), 1, 8) AS BIGINT) % 100 < {LABELLED_PERCENT})"""
_STAGE = """s AS (SELECT a.id AS u, b.id AS v, CASE WHEN a.nm = b.nm THEN 'S1a' WHEN replace(a.nm, ' ', '') = replace(b.nm, ' ', '') THEN 'S1b'
    WHEN levenshtein(a.nm, b.nm) <= 1 AND list_sort(list_filter(string_split(a.nm, ' '), lambda t: length(t) = 1)) = list_sort(list_filter(string_split(b.nm, ' '), lambda t: length(t) = 1)) THEN 'S1c'
    WHEN least(length(a.nm), length(b.nm)) >= 8 AND ((length(a.nm) < length(b.nm) AND starts_with(b.nm, a.nm) AND substr(b.nm, length(a.nm) + 1, 1) <> ' ')
         OR (length(b.nm) < length(a.nm) AND starts_with(a.nm, b.nm) AND substr(a.nm, length(b.nm) + 1, 1) <> ' ')) THEN 'S1d' END AS rule
    FROM rr a JOIN rr b ON a.id < b.id AND (a.city = b.city OR a.zip = b.zip OR (a.ad <> '' AND a.ad = b.ad)) AND (substr(a.nm, 1, 3) = substr(b.nm, 1, 3) OR right(a.nm, 3) = right(b.nm, 3)
         OR replace(a.nm, ' ', '') = replace(b.nm, ' ', '')))"""
_RR = "rr AS (SELECT {0} AS id, name_clean AS nm, coalesce(city, '') AS city, coalesce(zipcode, '') AS zip, coalesce(address1, '') AS ad FROM {1} WHERE name_clean IS NOT NULL)"
_CORPUS_ROWS = "cr AS (SELECT unique_id, min(name_clean) AS name_clean, min(address1) AS address1, min(city) AS city, min(zipcode) AS zipcode FROM corpus_debtors_eq WHERE unique_id IS NOT NULL GROUP BY 1)"
_RESOLVED = f"""{_GAMMAS}, w AS (SELECT unique_id_l, unique_id_r, {_BASE} + {_bits(tuple(fellegi.GIVEN))} AS mw FROM g), e AS (SELECT unique_id_l AS a, unique_id_r AS b FROM w WHERE mw >= {RESOLVE_FLOOR}
    UNION SELECT unique_id_r, unique_id_l FROM w WHERE mw >= {RESOLVE_FLOOR}), sn AS (SELECT unique_id AS id, unique_id AS seen FROM r UNION SELECT sn.id, e.b FROM sn JOIN e ON sn.seen = e.a),
    m AS (SELECT id, min(seen) AS cluster FROM sn GROUP BY 1)"""
_GRID = f"""{_NAMED}, t AS (SELECT unnest({BARS})::DOUBLE AS threshold), qt AS (SELECT *, coalesce(zu = zv, false) AS truth FROM q WHERE a IS NOT NULL AND b IS NOT NULL),
    gg AS (""" + " UNION ALL ".join(f"SELECT '{g}' AS gate, {i} AS place, w, truth, ({c}) AS op FROM qt" for i, (g, c) in enumerate(_GATES.items())) + """),
    gr AS (SELECT gate, place, threshold, count(*) FILTER (WHERE op AND w >= threshold) AS merged, count(*) FILTER (WHERE op AND w >= threshold AND truth) AS tp,
           count(*) FILTER (WHERE op AND w >= threshold AND NOT truth) AS fp, count(*) FILTER (WHERE truth) AS pos FROM gg, t GROUP BY ALL),
    grid AS (SELECT gate, threshold, merged, tp, fp, CASE WHEN merged > 0 THEN round(tp / merged, 6) END AS precision, CASE WHEN pos > 0 THEN round(tp / pos, 6) END AS recall, place FROM gr)"""
_NS = "replace({0}, ' ', '')"
_REST = "coalesce(nullif(replace(regexp_extract({0}, '^[^ ]+ (.*)$', 1), ' ', ''), ''), replace({0}, ' ', ''))"
_SIG4 = "nullif(array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split({0}, ' '), lambda w: length(w) >= 3 AND NOT list_contains(['THE', 'AND', 'OF', 'A', 'AN', 'FOR', 'IN', 'ON', 'AT', 'BY'], w)), lambda w: substr(w, 1, 4)))), ' '), '')"
_F24 = "CASE WHEN len(string_split({0}, ' ')) >= 2 THEN substr(string_split({0}, ' ')[1], 1, 4) || '|' || substr(string_split({0}, ' ')[2], 1, 4) END"
_BLOCK_SQL = {"zip": "{1}", "first4": "substr({0}, 1, 4)", "first2_4": _F24, "sig4": _SIG4, "desp12": "substr(replace({0}, ' ', ''), 1, 12)"}
_ENUM = "[" + ", ".join(f"'{w}'" for w in stages.ENUMERATORS) + "]"

ORACLE = {
    "fs_u_random": f"""
        WITH {_RECORDS}, c AS (SELECT *, substr(zipcode, 1, 5) AS z FROM r), n AS (SELECT greatest(count(*) // 2, 1) AS n FROM r), k AS (SELECT unnest(range(least(CAST(ceil({RANDOM_PAIRS // 2} / n) AS BIGINT), {training.ROUNDS}))) AS i, n FROM n),
        b AS (SELECT c.*, i, CAST('0x' || substr(md5('u' || i || ':' || unique_id), 1, 8) AS BIGINT) % n AS cell, n FROM c, k),
        q AS (SELECT DISTINCT l.unique_id AS ul, r.unique_id AS ur FROM b l JOIN b r ON l.i = r.i AND l.cell = r.cell AND l.unique_id < r.unique_id WHERE l.cell < least(l.n, {RANDOM_PAIRS // 2} - l.i * l.n)),
        v AS (SELECT {_VECTOR} FROM q JOIN c l ON l.unique_id = ul JOIN c r ON r.unique_id = ur) {_COUNTED.format("v")}""",
    "fs_supervised_m": f"""
        WITH {_LABELLED}, tl AS (SELECT name, suffix, address, city, zip FROM lv WHERE truth), k AS ({_COUNTED.format("tl")}), s AS (SELECT comparison, sum(n) AS t FROM k GROUP BY 1),
        a AS (SELECT * FROM (VALUES ('name', 4), ('suffix', 1), ('address', 3), ('city', 1), ('zip', 1)) x(comparison, top)), f AS (SELECT comparison, top, unnest(range(top + 1)) AS level FROM a)
        SELECT f.comparison, CAST(f.level AS INTEGER) AS level, round(coalesce(k.n / s.t, CASE WHEN f.level = top THEN 0.95 ELSE 0.05::DOUBLE / top END), 9) AS m
        FROM f LEFT JOIN k ON k.comparison = f.comparison AND k.level = f.level LEFT JOIN s ON s.comparison = f.comparison""",
    "valley_threshold": f"""
        WITH {_SCORED}, h AS (SELECT least(CAST(floor((greatest(least(w, 25), -10) + 10) * 2) AS BIGINT), 69) AS b, count(*) AS n FROM p GROUP BY 1),
        z AS (SELECT i, coalesce(n, 0) AS n FROM (SELECT unnest(range(70)) AS i) LEFT JOIN h ON b = i), m AS (SELECT i, (n + coalesce(lag(n) OVER (ORDER BY i), 0) + coalesce(lead(n) OVER (ORDER BY i), 0)) / 3.0::DOUBLE AS s FROM z),
        v AS (SELECT * FROM m WHERE i BETWEEN 20 AND 49), b AS (SELECT max(i) AS i, min(s) AS s FROM v WHERE s <= (SELECT min(s) FROM v) + 1e-9)
        SELECT CASE WHEN i IN (20, 49) THEN 6.0 ELSE i * 0.5 - 10 END::DOUBLE AS threshold, CASE WHEN i IN (20, 49) THEN 'fallback' ELSE 'valley' END AS branch, CASE WHEN i NOT IN (20, 49) THEN s END AS smoothed FROM b""",
    "fs_scores_all": f"WITH {_GAMMAS}, w AS (SELECT {_BASE} + {_bits(tuple(fellegi.GIVEN))} AS mw FROM g) SELECT CAST(floor(round(mw, 9)) AS BIGINT) AS bits, count(*) AS pairs FROM w WHERE mw >= -50 GROUP BY 1",
    "resolve_clusters": f"WITH RECURSIVE {_RESOLVED} SELECT id, cluster FROM m",
    "resolve_summary": f"""WITH RECURSIVE {_RESOLVED}, z AS (SELECT count(*) AS n FROM m GROUP BY cluster)
        SELECT count(*) AS clusters, CAST(median(n) AS DOUBLE) AS p50, CAST(quantile_cont(n, 0.95) AS DOUBLE) AS p95, max(n) AS largest, CAST(sum(n) AS BIGINT) AS ids,
               round(100 * max(n) / sum(n), 4) AS largest_pct, round(100 * max(n) / sum(n), 4) <= 1.0 AS within_bar FROM z""",
    "stage_one_pairs": f"WITH {_RECORDS}, {_RR.format('unique_id', 'r')}, {_STAGE} SELECT u, v, rule FROM s WHERE rule IS NOT NULL",
    "two_stage_pairs": f"""WITH {_SCORED}, {_CORPUS_ROWS}, {_RR.format('unique_id', 'cr')}, {_STAGE}, d AS (SELECT u, v FROM s WHERE rule IS NOT NULL)
        SELECT u, v, 100.0::DOUBLE AS w, 1 AS stage FROM d UNION ALL SELECT u, v, w, 2 FROM p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.u = p.u AND d.v = p.v)""",
    "redesigned_levels": f"""
        WITH {_NAMED}, k AS (SELECT a, b, {_NS.format('a')} AS na, {_NS.format('b')} AS nb, {_REST.format('a')} AS ra, {_REST.format('b')} AS rb FROM q),
        j AS (SELECT *, jaro_winkler_similarity(na, nb) AS whole, least(jaro_winkler_similarity(na, nb), jaro_winkler_similarity(ra, rb)) AS bo FROM k)
        SELECT CASE WHEN a IS NULL OR b IS NULL THEN -1 WHEN a = b THEN 7 WHEN na = nb THEN 6 WHEN bo >= 0.95 OR whole >= 0.95 THEN 5 WHEN bo >= 0.88 THEN 4 WHEN bo >= 0.80 THEN 3
               WHEN whole >= 0.85 THEN 2 WHEN whole >= 0.70 THEN 1 ELSE 0 END AS level, count(*) AS pairs FROM j GROUP BY 1""",
    "address_blind_arms": f"WITH {_GAMMAS} " + " UNION ALL ".join(
        f"SELECT '{arm}' AS arm, count(*) FILTER (WHERE b > -3) AS above_minus_3, count(*) FILTER (WHERE b > -6) AS above_minus_6 FROM (SELECT {_BASE} + {_bits(kept)} AS b FROM (SELECT * REPLACE (CASE WHEN g_name BETWEEN 1 AND {least - 1} THEN 0 ELSE g_name END AS g_name) FROM g))"
        for arm, (kept, least) in stages.ARMS.items()
    ),
    "blocking_report": f"WITH {_NAMED}, k AS (SELECT *, list_sort(string_split(a, ' ')) = list_sort(string_split(b, ' ')) AS truth FROM q WHERE a IS NOT NULL AND b IS NOT NULL), x AS (" + " UNION ALL ".join(
        f"SELECT '{n}' AS block, truth, coalesce({e.format('a', 'zu')} = {e.format('b', 'zv')}, false) AS kept FROM k" for n, e in _BLOCK_SQL.items()
    ) + """), z AS (SELECT block, count(*) FILTER (WHERE truth) AS same, count(*) FILTER (WHERE truth AND kept) AS s, count(*) FILTER (WHERE NOT truth) AS other, count(*) FILTER (WHERE NOT truth AND kept) AS d FROM x GROUP BY 1)
        SELECT block, CASE WHEN same > 0 THEN round(100 * s / same, 4) END AS same_pct, CASE WHEN other > 0 THEN round(100 * d / other, 4) END AS different_pct, CASE WHEN s + d > 0 THEN round(s / (s + d), 6) END AS ceiling FROM z""",
    "floor_grid": f"WITH {_GRID} SELECT * FROM grid",
    "chosen_floor": f"""WITH {_GRID}, e AS (SELECT * FROM grid WHERE merged >= 5) SELECT * FROM e WHERE precision = (SELECT max(precision) FROM e) ORDER BY recall DESC, threshold, place LIMIT 1""",
    "chosen_votes": f"""
        WITH {_NAMED}, k AS (SELECT coalesce(zu = zv, false) AS truth, (w >= 5)::INT + (a = b)::INT + (substr(a, 1, 4) = substr(b, 1, 4))::INT + (levenshtein(a, b) <= 2)::INT AS votes FROM q WHERE a IS NOT NULL AND b IS NOT NULL),
        x AS (SELECT k, truth FROM k, (SELECT unnest(range(1, 5)) AS k) WHERE votes >= k), pv AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE NOT truth) AS wrong FROM x GROUP BY 1)
        SELECT CAST(coalesce(min(k) FILTER (WHERE wrong = 0 AND n >= 20), max(k)) AS INTEGER) AS k FROM pv""",
    "residual_risk": f"""
        WITH {_NAMED}, k AS (SELECT w, list_distinct(list_filter(string_split(a, ' '), lambda t: t <> '')) AS x, list_distinct(list_filter(string_split(b, ' '), lambda t: t <> '')) AS y FROM q WHERE a IS NOT NULL AND b IS NOT NULL AND w >= 5),
        z AS (SELECT w, list_concat(list_filter(x, lambda t: NOT list_contains(y, t)), list_filter(y, lambda t: NOT list_contains(x, t))) AS apart FROM k)
        SELECT CASE WHEN len(apart) = 0 THEN 'none' WHEN len(list_filter(apart, lambda t: NOT (list_contains({_ENUM}, t) OR regexp_full_match(t, '[0-9]+')))) = 0 THEN 'enumerator' ELSE 'other' END AS difference,
               count(*) AS pairs, round(avg(w), 6) AS mean_weight FROM z GROUP BY 1""",
    "probe_strata": f"""
        WITH {_NAMED}, k AS (SELECT w, coalesce(zu = zv, false) AS same_zip, 1 - levenshtein(a, b) / greatest(length(a), length(b), 1) AS ratio FROM q WHERE a IS NOT NULL AND b IS NOT NULL)
        SELECT CASE WHEN same_zip AND ratio < 0.5 THEN 'same_place_other_name' WHEN NOT same_zip AND ratio >= 0.8 THEN 'same_name_elsewhere' ELSE 'rest' END AS probe, w >= 5 AS merged, count(*) AS pairs FROM k GROUP BY 1, 2""",
    "token_agreement": f"""
        WITH {_NAMED}, k AS (SELECT list_filter(string_split(a, ' '), lambda t: t <> '') AS x, list_filter(string_split(b, ' '), lambda t: t <> '') AS y FROM q WHERE a IS NOT NULL AND b IS NOT NULL AND w >= 5)
        SELECT len(x) > 0 AND len(y) > 0 AND list_min(list_transform(x, lambda s: list_max(list_transform(y, lambda t: jaro_winkler_similarity(s, t))))) >= 0.85
               AND list_min(list_transform(y, lambda s: list_max(list_transform(x, lambda t: jaro_winkler_similarity(s, t))))) >= 0.85 AS agree, count(*) AS pairs FROM k GROUP BY 1""",
}
