"""Labels of a survey: cells, draws, passes, review, assembly, resolution, examples; and what they leave to audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.keys import SEED, bucket
from ledgerloom.functions.normalize import norm_key
from ledgerloom.operators import labels as ops
from ledgerloom.operators import survey
from ledgerloom.queries.linkage import _SCORED, _pairs
from ledgerloom.queries.survey import _CASES, _SPLIT, _bucket, _cases, grouped_split
from ledgerloom.sources.tables import table

QUOTA, PER_CELL = 7, 3
ROUTES, DECLARED = ["lender", "both"], r"\b(?:EXCAVATING|PAVING|DRILLING)\b"


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """Cases with the split of their group; those without group train."""
    c = _cases(spark, folder)
    return c.join(grouped_split(spark, folder), "group_id", "left").withColumn("split", F.coalesce("split", F.lit("train")))


def _flipped(truth, flip):
    return F.when(truth != flip, "yes").otherwise("no")


def _pass(spark: SparkSession, folder: str, name: str, percent: int) -> DataFrame:
    """A blind pass with hidden repeats of a tenth of the cases."""
    c = _cases(spark, folder)
    own = c.select("case_id", _flipped(F.col("truth"), bucket(F.col("case_id"), name) < percent).alias("label"), F.lit(f"reason {name}").alias("reason"), F.lit(False).alias("is_repeat"))
    again = c.filter(bucket(F.col("case_id"), "repeated") < 10)
    again = again.select("case_id", _flipped(F.col("truth"), bucket(F.col("case_id"), f"{name}2") < percent).alias("label"), F.lit(f"again {name}").alias("reason"), F.lit(True).alias("is_repeat"))
    return own.unionByName(again).withColumn("labeller_id", F.lit(name))


def _decisions(spark: SparkSession, folder: str) -> DataFrame:
    a, b = (_pass(spark, folder, n, p).filter("not is_repeat").select("case_id", F.col("label").alias(n)) for n, p in (("first", 5), ("flip", 12)))
    both = a.join(b, "case_id")
    k = bucket(F.col("case_id"), "decide")
    decision = F.when((F.col("first") != F.col("flip")) & (k < 50), "adjudicated").when((F.col("first") == F.col("flip")) & (k < 5), "confirmed").when((F.col("first") == F.col("flip")) & (k < 8), "overturned")
    return both.select("case_id", decision.alias("decision"), F.lit("no").alias("label"), F.lit("note").alias("note")).filter("decision is not null")


def cell_populations(spark: SparkSession, folder: str) -> DataFrame:
    """Cases of every split and stratum."""
    return ops.cell_populations(_placed(spark, folder), "split", "stratum")


def allocation_plan(spark: SparkSession, folder: str) -> DataFrame:
    """How a round of sixty cases is shared out over the strata, each getting four."""
    sizes = {r["stratum"]: r["population"] for r in ops.cell_populations(_cases(spark, folder), "stratum").collect()}
    return spark.createDataFrame(sorted(survey.allocate(sizes, min(60, sum(sizes.values())), 4).items()), "stratum string, cases long")


def main_draw(spark: SparkSession, folder: str) -> DataFrame:
    """Seven cases of every split and stratum by their digests."""
    placed = _placed(spark, folder)
    quota = placed.select("split", "stratum").distinct().withColumn("wanted", F.lit(QUOTA))
    drawn = ops.draw_cells(placed, "case_id", ["split", "stratum"], quota, "main")
    return drawn.select("case_id", "split", "stratum", "population", "draw_rank", F.round("inclusion_probability", 9).alias("inclusion_probability"))


def _queue(spark: SparkSession, folder: str) -> DataFrame:
    return _pass(spark, folder, "first", 5).select(F.concat_ws("#", "case_id", "is_repeat").alias("queue_id"), "case_id", "is_repeat")


def imported_pass(spark: SparkSession, folder: str) -> DataFrame:
    """A pass of answers by queue id, resolved to its cases."""
    answers = _pass(spark, folder, "first", 5).select(F.concat_ws("#", "case_id", "is_repeat").alias("queue_id"), "label", "reason")
    return ops.import_pass(_queue(spark, folder), answers, "blind_a", ["yes", "no"])


def bad_answers(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with a pass of which some answers are lost, invented, repeated or of no known label, by problem."""
    k = bucket(F.col("queue_id"), "spoilt")
    answers = _pass(spark, folder, "first", 5).select(F.concat_ws("#", "case_id", "is_repeat").alias("queue_id"), "label", "reason")
    spoilt = answers.select(
        F.when(k == 0, F.concat(F.lit("x"), "queue_id")).otherwise(F.col("queue_id")).alias("queue_id"), F.when(k == 1, "maybe").otherwise(F.col("label")).alias("label"),
        F.when(k == 2, " ").when(k == 3, F.repeat(F.lit("long "), 120)).otherwise(F.col("reason")).alias("reason"),
    ).unionByName(answers.filter(k == 4))
    return ops.check_answers(_queue(spark, folder), spoilt, ["yes", "no"], 500).groupBy("problem").agg(F.count("*").alias("n"))


def review_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Disagreements of two passes, and audits of what they agree on."""
    return ops.review_selection(_pass(spark, folder, "first", 5), _pass(spark, folder, "flip", 12), _placed(spark, folder), PER_CELL, "audit")


def assembled_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The labels of a round with their status."""
    return ops.assemble(_pass(spark, folder, "first", 5), _pass(spark, folder, "flip", 12), _decisions(spark, folder))


def label_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Two rounds merged and counted."""
    own = assembled_labels(spark, folder)
    early = bucket(F.col("case_id"), "round") < 40
    return ops.label_manifest(ops.merge_rounds([("pilot", own.filter(early)), ("main", own.filter(~early))]))


def resolved_labels(spark: SparkSession, folder: str) -> DataFrame:
    """One label for each case, as a number where it is one."""
    return ops.resolve_labels(assembled_labels(spark, folder), "yes", "no")


def repeat_consistency(spark: SparkSession, folder: str) -> DataFrame:
    """How often hidden repeats got the same answer."""
    return ops.answer_repeats(_pass(spark, folder, "first", 5))


def _twins(spark: SparkSession, folder: str) -> DataFrame:
    p = _pairs(spark, folder).filter("w >= 5").select("u", "v")
    once = p.withColumn("label", F.when(bucket(F.concat("u", "v"), "twin") < 70, "SAME").otherwise("DIFFERENT"))
    again = p.filter(bucket(F.concat("u", "v"), "stands") < 20).withColumn("label", F.when(bucket(F.concat("u", "v"), "twin") < 75, "SAME").otherwise("DIFFERENT"))
    return once.unionByName(again)


def twin_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """How often a pair shown twice got one label."""
    return ops.agreement_of_twins(_twins(spark, folder), ["u", "v"], "label")


def independent_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Forty scored pairs of which no record stands in two."""
    return ops.independent_draw(_pairs(spark, folder), "u", "v", 40, "independent")


def unseen_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of the second batch that the first did not show, counted."""
    p = _pairs(spark, folder)
    first = p.filter(bucket(F.col("u"), "batch") < 30)
    return ops.unseen(p, first, ["u", "v"]).agg(F.count("*").alias("pairs"), F.round(F.sum("w"), 4).alias("weight"))


def curated_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Examples of every stratum with few errors among them."""
    c = _cases(spark, folder).withColumn("wrong", F.col("truth") != (F.col("score") >= 0.5))
    caps = {f"{r}:{s}": n for r, n in (("CO", 6), ("CT", 4)) for s in ("accepted", "rejected")}
    return ops.curated_examples(c, "case_id", "stratum", "wrong", caps, 8, 30, 40, "examples")


def _screened(spark: SparkSession, folder: str) -> DataFrame:
    c = _placed(spark, folder)
    own = table(spark, folder, "candidates").filter("case_id is not null").groupBy("case_id").agg(F.min("borrower_name_raw").alias("name"))
    kinds = F.when(F.col("stratum").endswith("accepted"), F.when(bucket(F.col("case_id"), "route") < 40, "lender").otherwise("borrower"))
    return c.join(own, "case_id").select("case_id", F.substring_index("stratum", ":", 1).alias("region"), "split", "group_id", "name", F.col("stratum").endswith("accepted").alias("accepted"), kinds.alias("route"), "score")


def screen_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The screening cell of every case."""
    return ops.maker_cells(_screened(spark, folder), ROUTES, DECLARED, 0.02).select("case_id", "cell")


def cell_table(spark: SparkSession, folder: str) -> DataFrame:
    """Cases by region, cell and split."""
    return ops.cell_table(ops.maker_cells(_screened(spark, folder), ROUTES, DECLARED, 0.02), ["train", "validation", "test"])


def batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Cases by region, decision of the score and the rules' verdict."""
    c = _cases(spark, folder)
    return c.groupBy(F.substring_index("stratum", ":", 1).alias("region"), (F.col("score") >= 0.5).alias("decision"), F.col("stratum").endswith("accepted").alias("baseline")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def split_audit_full(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of an audit of splits: groups and cases on two sides, pilots in test and outside train, names across sides."""
    own = table(spark, folder, "candidates").filter("case_id is not null").groupBy("case_id").agg(F.min(norm_key(F.col("borrower_name_raw"))).alias("name"), F.min("borrower_name_clean").alias("clean"))
    rows = _placed(spark, folder).join(own, "case_id").withColumns({"pilot": bucket(F.col("case_id"), "pilot") < 2, "region": F.substring_index("stratum", ":", 1)})
    two = lambda name, *k: rows.filter(" and ".join(f"{x} is not null" for x in k)).groupBy(*k).agg(F.countDistinct("split").alias("s")).agg(F.lit(name).alias("audit"), F.count_if(F.col("s") > 1).alias("n"))
    one = lambda name, c: rows.agg(F.lit(name).alias("audit"), F.count_if(c).alias("n"))
    parts = [
        two("group_overlap", "group_id"), two("case_overlap", "case_id"), one("pilot_in_test", F.col("pilot") & (F.col("split") == "test")), one("pilot_not_in_train", F.col("pilot") & (F.col("split") != "train")),
        two("name_across_splits_within_region", "region", "name"), two("clean_name_across_regions_and_splits", "clean"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES = {f.__name__: f for f in (
    cell_populations, allocation_plan, main_draw, imported_pass, bad_answers, review_selection, assembled_labels, label_manifest, resolved_labels, repeat_consistency, twin_agreement,
    independent_pairs, unseen_pairs, curated_examples, screen_cells, cell_table, batch_summary, split_audit_full,
)}

_of = lambda key, seed, n=100: f"CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT) % {n}"
_flip = lambda seed, p: f"CASE WHEN truth <> ({_bucket(seed, 100)} < {p}) THEN 'yes' ELSE 'no' END"
_own_pass = lambda n, p: f"""{n} AS (SELECT case_id, {_flip(n, p)} AS label, 'reason {n}' AS reason, false AS is_repeat FROM c
    UNION ALL SELECT case_id, {_flip(n + "2", p)}, 'again {n}', true FROM c WHERE {_bucket("repeated", 100)} < 10)"""  # noqa: E731
_PLACED = f"{_SPLIT}, pl AS (SELECT c.*, coalesce(s.split, 'train') AS split FROM c LEFT JOIN s ON s.group_id = c.group_id)"
_TWO = f"{_own_pass('first', 5)}, {_own_pass('flip', 12)}"
_ASSEMBLED = f"""{_TWO}, ab AS (SELECT a.case_id, a.label AS la, b.label AS lb, a.reason AS ra, {_of("a.case_id", "decide")} AS k FROM first a JOIN flip b ON a.case_id = b.case_id AND NOT a.is_repeat AND NOT b.is_repeat),
    asm AS (SELECT case_id, CASE WHEN la <> lb AND k < 50 OR la = lb AND k BETWEEN 5 AND 7 THEN 'no' WHEN la <> lb THEN 'INSUFFICIENT_EVIDENCE' ELSE la END AS label,
        CASE WHEN la <> lb AND k < 50 OR la = lb AND k BETWEEN 5 AND 7 THEN 'note' WHEN la <> lb THEN 'pass a: ' || la || '; pass b: ' || lb ELSE ra END AS reason,
        CASE WHEN la <> lb AND k < 50 OR la = lb AND k BETWEEN 5 AND 7 THEN 'founder_adjudicated' WHEN la <> lb THEN 'blind_unresolved' WHEN k < 5 THEN 'founder_confirmed' ELSE 'model_agreed' END AS status, false AS is_repeat FROM ab
        UNION ALL SELECT case_id, label, reason, 'blind_repeat', true FROM first WHERE is_repeat UNION ALL SELECT case_id, label, reason, 'blind_repeat', true FROM flip WHERE is_repeat)"""
_SCREENED = f"""{_PLACED}, nm AS (SELECT case_id, min(borrower_name_raw) AS name, min(borrower_name_clean) AS clean FROM candidates WHERE case_id IS NOT NULL GROUP BY 1),
    sc AS (SELECT pl.case_id, string_split(stratum, ':')[1] AS region, split, group_id, name, ends_with(stratum, 'accepted') AS accepted,
           CASE WHEN ends_with(stratum, 'accepted') THEN CASE WHEN {_of("pl.case_id", "route")} < 40 THEN 'lender' ELSE 'borrower' END END AS route, score FROM pl JOIN nm ON nm.case_id = pl.case_id),
    mk AS (SELECT DISTINCT group_id FROM sc WHERE route IN ('lender', 'both') AND group_id IS NOT NULL), mm AS (SELECT sc.*, mk.group_id IS NOT NULL AS maker FROM sc LEFT JOIN mk ON mk.group_id = sc.group_id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY region, split, NOT accepted AND NOT maker ORDER BY score DESC, case_id) AS place, count(*) FILTER (WHERE NOT accepted AND NOT maker) OVER (PARTITION BY region, split) AS pool FROM mm),
    ce AS (SELECT *, CASE WHEN accepted THEN CASE WHEN coalesce(route IN ('lender', 'both'), false) THEN 'A1' ELSE 'A2' END WHEN maker THEN 'B1' WHEN place <= round_even(0.02 * pool, 0) THEN 'B2'
        WHEN regexp_matches(upper(coalesce(name, '')), '\\b(EXCAVATING|PAVING|DRILLING)\\b') THEN 'B3' ELSE 'B4' END AS cell FROM rk)"""
_two = lambda name, *k: f"SELECT '{name}' AS audit, count(*) AS n FROM (SELECT 1 FROM au WHERE {' AND '.join(f'{x} IS NOT NULL' for x in k)} GROUP BY {', '.join(k)} HAVING count(DISTINCT split) > 1)"
_STRIP = "regexp_replace(upper(coalesce({0}, '')), '^[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}]+|[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}]+$', '', 'g')".format("borrower_name_raw")

ORACLE = {
    "cell_populations": f"WITH {_PLACED} SELECT split, stratum, count(*) AS population FROM pl GROUP BY 1, 2",
    "main_draw": f"""WITH {_PLACED}, k AS (SELECT case_id, split, stratum, count(*) OVER (PARTITION BY split, stratum) AS population, row_number() OVER (PARTITION BY split, stratum ORDER BY sha256('main:{SEED}:' || case_id), case_id) AS draw_rank FROM pl)
        SELECT case_id, split, stratum, population, CAST(draw_rank AS INTEGER) AS draw_rank, round(least({QUOTA}, population) / population, 9) AS inclusion_probability FROM k WHERE draw_rank <= {QUOTA}""",
    "imported_pass": f"WITH {_CASES}, {_TWO} SELECT case_id, label, reason, is_repeat, 'blind_a' AS labeller_id FROM first",
    "bad_answers": f"""
        WITH {_CASES}, {_TWO}, a AS (SELECT case_id || '#' || is_repeat AS queue_id FROM first), k AS (SELECT queue_id, {_of("queue_id", "spoilt")} AS k FROM a),
        p AS (SELECT unnest(CASE k WHEN 0 THEN ['unknown', 'missing'] WHEN 1 THEN ['label'] WHEN 2 THEN ['no_reason'] WHEN 3 THEN ['long_reason'] WHEN 4 THEN ['repeated'] ELSE []::VARCHAR[] END) AS problem FROM k)
        SELECT problem, count(*) AS n FROM p GROUP BY 1""",
    "review_selection": f"""
        WITH {_PLACED}, {_TWO}, j AS (SELECT pl.case_id, split, stratum, a.label = b.label AS agreed FROM pl JOIN first a ON a.case_id = pl.case_id AND NOT a.is_repeat JOIN flip b ON b.case_id = pl.case_id AND NOT b.is_repeat),
        r AS (SELECT *, row_number() OVER (PARTITION BY agreed, split, stratum ORDER BY sha256('audit:{SEED}:' || case_id), case_id) AS rn FROM j)
        SELECT case_id, CASE WHEN agreed THEN 'audit' ELSE 'disagreement' END AS review_type, split, stratum FROM r WHERE NOT agreed OR rn <= {PER_CELL}""",
    "assembled_labels": f"WITH {_CASES}, {_ASSEMBLED} SELECT * FROM asm",
    "label_manifest": f"WITH {_CASES}, {_ASSEMBLED} SELECT CASE WHEN {_bucket('round', 100)} < 40 THEN 'pilot' ELSE 'main' END AS round, status, label, count(*) AS n FROM asm GROUP BY 1, 2, 3",
    "resolved_labels": f"WITH {_CASES}, {_ASSEMBLED} SELECT case_id, label, CASE label WHEN 'yes' THEN 1.0 WHEN 'no' THEN 0.0 END::DOUBLE AS y FROM asm WHERE NOT is_repeat",
    "repeat_consistency": f"""WITH {_CASES}, {_TWO}, j AS (SELECT a.label = b.label AS same FROM first a JOIN first b ON a.case_id = b.case_id AND NOT a.is_repeat AND b.is_repeat)
        SELECT count(*) AS repeats, count(*) FILTER (WHERE same) AS same, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE same) / count(*), 9) END AS share FROM j""",
    "twin_agreement": f"""WITH {_SCORED}, k AS (SELECT {_of("u || v", "twin")} AS t FROM p WHERE w >= 5 AND {_of("u || v", "stands")} < 20)
        SELECT count(*) AS twins, count(*) FILTER (WHERE t < 70 OR t >= 75) AS agreed, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE t < 70 OR t >= 75) / count(*), 9) END AS share FROM k""",
    "unseen_pairs": f"WITH {_SCORED} SELECT count(*) AS pairs, round(sum(w), 4) AS weight FROM p WHERE {_of('u', 'batch')} >= 30",
    "curated_examples": f"""
        WITH {_CASES}, g AS (SELECT case_id, stratum, truth <> (score >= 0.5) AS wrong, sha256('examples:{SEED}:' || case_id) AS d, CASE WHEN stratum LIKE 'CO:%' THEN 6 WHEN stratum LIKE 'CT:%' THEN 4 ELSE 0 END AS cap FROM c),
        e AS (SELECT *, row_number() OVER (PARTITION BY wrong ORDER BY d, case_id) AS en FROM g), f AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY d, case_id) AS rn FROM e WHERE NOT wrong OR en <= 8),
        o AS (SELECT case_id, stratum, wrong, rn <= cap AS chosen, row_number() OVER (ORDER BY rn <= cap DESC, d, case_id) AS place FROM f)
        SELECT case_id, stratum, wrong, CAST(place AS INTEGER) AS place FROM o WHERE place <= 40 AND (chosen OR place <= 30)""",
    "screen_cells": f"WITH {_SCREENED} SELECT case_id, cell FROM ce",
    "cell_table": f"WITH {_SCREENED} SELECT region, cell, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'validation') AS validation, count(*) FILTER (WHERE split = 'test') AS test, count(*) AS total FROM ce GROUP BY 1, 2",
    "batch_summary": f"WITH {_CASES} SELECT string_split(stratum, ':')[1] AS region, score >= 0.5 AS decision, ends_with(stratum, 'accepted') AS baseline, count(*) AS n, round(avg(score), 6) AS mean_score FROM c GROUP BY 1, 2, 3",
    "split_audit_full": f"""
        WITH {_PLACED}, ow AS (SELECT case_id, min({_STRIP}) AS name, min(borrower_name_clean) AS clean FROM candidates WHERE case_id IS NOT NULL GROUP BY 1),
        au AS (SELECT pl.*, name, clean, {_of("pl.case_id", "pilot")} < 2 AS pilot, string_split(stratum, ':')[1] AS region FROM pl JOIN ow ON ow.case_id = pl.case_id)
        {_two("group_overlap", "group_id")} UNION ALL {_two("case_overlap", "case_id")} UNION ALL SELECT 'pilot_in_test', count(*) FILTER (WHERE pilot AND split = 'test') FROM au
        UNION ALL SELECT 'pilot_not_in_train', count(*) FILTER (WHERE pilot AND split <> 'train') FROM au UNION ALL {_two("name_across_splits_within_region", "region", "name")} UNION ALL {_two("clean_name_across_regions_and_splits", "clean")}""",
}
