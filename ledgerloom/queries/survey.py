"""Cases, samples, splits, labels and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.keys import ADDRESS_CLEAN, ADDRESS_JUNK, SEED, address_clean, bucket, rank_digest
from ledgerloom.operators import cases as case_ops
from ledgerloom.operators import evaluate, models, survey
from ledgerloom.operators.scope import PLACEHOLDER_ADDRESSES
from ledgerloom.sources.tables import table

SHARES = {"train": 0.65, "validation": 0.15, "test": 0.20}


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct cases with stratum, group and a label and score made of digests."""
    c = table(spark, folder, "candidates").filter("case_id is not null").groupBy("case_id").agg(
        F.min("region").alias("region"), F.max("baseline_qualifies").alias("q"), F.min(F.lower("group_id")).alias("group_id")
    )
    stratum = F.concat(F.coalesce("region", F.lit("?")), F.lit(":"), F.when(F.col("q"), "accepted").otherwise("rejected"))
    return c.select(
        "case_id", "group_id", stratum.alias("stratum"), (bucket(F.col("case_id"), "label") < 40).alias("truth"), (bucket(F.col("case_id"), "score", 1000) / 1000.0).alias("score")
    )


def _extracted(spark: SparkSession, folder: str) -> DataFrame:
    """Cases of both registers."""
    co = case_ops.extract_cases(table(spark, folder, "co_filings"), table(spark, folder, "co_debtors"), table(spark, folder, "co_secured_parties"), "CO")
    return co.unionByName(case_ops.extract_cases(*case_ops.flat_register(table(spark, folder, "ct_filings")), "CT"))


def case_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Cases of both registers, lender lists as text."""
    out = _extracted(spark, folder)
    return out.select("case_id", "region", "file_id", "lineage_id", "borrower_name_raw", F.array_join("lender_names_raw", "|").alias("lenders"), "earliest_observed_date", "latest_observed_date", "source_row_count", "source_status")


def clean_lenders(spark: SparkSession, folder: str) -> DataFrame:
    """Cases by how many lenders they name, as written and cleaned."""
    out = _extracted(spark, folder)
    return out.groupBy("region", F.size("lender_names_raw").alias("n_raw"), F.size("lender_names_clean").alias("n_clean")).agg(F.count("*").alias("cases"))


def compare_extracts(spark: SparkSession, folder: str) -> DataFrame:
    """The cases extracted now against those of the table: what is missing, what is new, what changed."""
    old = table(spark, folder, "candidates").filter("case_id is not null").groupBy("case_id").agg(F.min("file_id").alias("file_id"), F.min("borrower_zip").alias("borrower_zip"))
    new = _extracted(spark, folder).groupBy("case_id").agg(F.min("file_id").alias("file_id"), F.min("borrower_zip").alias("borrower_zip"))
    return case_ops.compare_extracts(old, new, "case_id", ["file_id", "borrower_zip"])


def party_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus of debtors of both registers, one row an id."""
    co = table(spark, folder, "co_debtors").select(F.lit("CO").alias("region"), F.concat(F.lit("CO:"), "debtorid").alias("unique_id"), F.col("organizationname").alias("name_raw"), "city", "zipcode", F.col("recordstatus").alias("status"), F.col("actiontype").alias("action"))
    ct = table(spark, folder, "ct_filings").select(
        F.lit("CT").alias("region"), F.concat(F.lit("CT:"), "id_lien_flng_nbr").alias("unique_id"), F.col("debtor_nm_bus").alias("name_raw"), F.col("debtor_ad_city").alias("city"), F.col("debtor_ad_zip").alias("zipcode"),
        F.col("lien_status").alias("status"), F.col("cd_flng_type").alias("action"),
    )
    return case_ops.party_corpus(co.unionByName(ct))


def corpus_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Of each register's debtors the share with each part, and of those in force."""
    rows = table(spark, folder, "co_debtors").select(F.lit("CO").alias("region"), "organizationname", "address1", "city", "state", "zipcode", F.col("recordstatus").alias("status"), F.col("actiontype").alias("action")).unionByName(
        table(spark, folder, "ct_filings").select(
            F.lit("CT").alias("region"), F.col("debtor_nm_bus").alias("organizationname"), F.col("debtor_ad_str1").alias("address1"), F.col("debtor_ad_city").alias("city"), F.col("debtor_ad_state").alias("state"),
            F.col("debtor_ad_zip").alias("zipcode"), F.col("lien_status").alias("status"), F.col("cd_flng_type").alias("action"),
        )
    )
    given = [F.round(F.avg(F.coalesce(F.trim(c) != "", F.lit(False)).cast("double")), 9).alias(f"with_{c}") for c in ("organizationname", "address1", "city", "state", "zipcode")]
    active = case_ops.active_row(F.col("region"), F.col("status"), F.col("action"))
    return rows.groupBy("region").agg(F.count("*").alias("n"), F.count_if(active).alias("active"), *given)


def clean_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct addresses of debtors, cleaned for a labeller's sheet."""
    return table(spark, folder, "co_debtors").select("address1").distinct().select("address1", address_clean(F.col("address1")).alias("cleaned"))


def reconcile_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the cases against files of the filings."""
    left = table(spark, folder, "candidates").filter("region = 'CO'").select("file_id").filter("file_id is not null")
    right = table(spark, folder, "co_filings").select(F.col("fileid").alias("file_id")).filter("file_id is not null")
    return case_ops.reconcile(left, right, "file_id")


def domain_check(spark: SparkSession, folder: str) -> DataFrame:
    """Register actions outside the known ones."""
    return case_ops.check_domain(table(spark, folder, "co_debtors"), "actiontype", ["add", "change"])


def stratum_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Cases of each stratum, those without any included."""
    vocabulary = [f"{r}:{s}" for r in ("CO", "CT", "NY") for s in ("accepted", "rejected")]
    return survey.stratum_sizes(_cases(spark, folder), "stratum", vocabulary)


def hash_draw(spark: SparkSession, folder: str) -> DataFrame:
    """Ten cases of each large stratum by their digests."""
    c = _cases(spark, folder)
    wanted = {"CO:accepted": 10, "CO:rejected": 10, "CT:accepted": 5, "CT:rejected": 5}
    return survey.stratified_draw(c.filter(F.col("stratum").isin(*wanted)), "case_id", "stratum", wanted, "pilot")


def grouped_split(spark: SparkSession, folder: str) -> DataFrame:
    """Groups split by quota of groups in the order of their digests."""
    return survey.grouped_quota_split(_cases(spark, folder), "group_id", SHARES, "split")


def split_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """How many groups and cases stand on two sides of that split."""
    c = _cases(spark, folder)
    return survey.split_audit(c.join(grouped_split(spark, folder), "group_id").select("case_id", "group_id", "split"), "split", ["group_id", "case_id"])


def blind_queue(spark: SparkSession, folder: str) -> DataFrame:
    """A round of labelling for the drawn cases with hidden repeats."""
    return survey.blind_queue(hash_draw(spark, folder), "case_id", "round-1", 8, 0.1)


def _passes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    c = _cases(spark, folder)
    first = c.select("case_id", F.when(F.col("truth"), "yes").otherwise("no").alias("label"))
    flip = bucket(F.col("case_id"), "flip") < 12
    second = c.filter(bucket(F.col("case_id"), "second") < 90).select("case_id", F.when(F.col("truth") != flip, "yes").otherwise("no").alias("label"))
    return first, second


def agreement_report(spark: SparkSession, folder: str) -> DataFrame:
    """The confusion of two passes of labels."""
    return survey.agreement(*_passes(spark, folder), "case_id", "label")


def agreement_kappa(spark: SparkSession, folder: str) -> DataFrame:
    """Observed and expected agreement and kappa of those passes."""
    k = survey.kappa(agreement_report(spark, folder))
    return k.select("n", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")])


def _weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Every case with an inclusion probability by stratum."""
    p = F.when(F.col("stratum").endswith("accepted"), 0.5).otherwise(0.1)
    return evaluate.design_weights(_cases(spark, folder).withColumn("probability", p), "probability").withColumn("decided", F.col("score") >= 0.5)


def wilson_ci(spark: SparkSession, folder: str) -> DataFrame:
    """The share of true cases in each stratum with its Wilson interval."""
    s = _cases(spark, folder).groupBy("stratum").agg(F.count_if("truth").alias("hits"), F.count("*").alias("n"))
    ci = evaluate.wilson(F.col("hits").cast("double"), F.col("n").cast("double"))
    return s.select("stratum", "hits", "n", F.round(ci["low"], 9).alias("low"), F.round(ci["high"], 9).alias("high"))


def weighted_confusion(spark: SparkSession, folder: str) -> DataFrame:
    """Design-weighted confusion, precision, recall and F1 at a score of a half."""
    out = evaluate.weighted_confusion(_weighted(spark, folder), "truth", "decided", "weight")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def ht_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of the drawn cases' weights against the strata's sizes."""
    drawn = evaluate.design_weights(hash_draw(spark, folder), "inclusion_probability")
    return evaluate.reconstruction(drawn, "stratum", "pop_h").select("stratum", F.round("estimate", 6).alias("estimate"), "size", "agrees")


def stratified_precision(spark: SparkSession, folder: str) -> DataFrame:
    """Precision over strata weighted by size, with its standard error."""
    c = _weighted(spark, folder)
    sizes = c.groupBy("stratum").agg(F.count("*").alias("size"))
    out = evaluate.stratified_precision(c.filter("decided"), "stratum", "truth", sizes)
    return out.select(F.round("precision", 9).alias("precision"), F.round("standard_error", 9).alias("standard_error"), "n")


def threshold_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The threshold of largest recall at a weighted precision of 0.35."""
    out = evaluate.threshold_choice(_weighted(spark, folder), "score", "truth", "weight", 0.35)
    return out.select("threshold", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    """The weighted average precision of the score."""
    return evaluate.average_precision(_weighted(spark, folder), "score", "truth", "weight").select(F.round("average_precision", 9).alias("average_precision"))


def ece_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Calibration bins and the expected error."""
    out = evaluate.calibration(_weighted(spark, folder), "score", "truth", "weight")
    return out.select("bin", *[F.round(c, 9).alias(c) for c in ("w", "mean_score", "share", "gap", "ece")])


def kish_n(spark: SparkSession, folder: str) -> DataFrame:
    """The effective size of the weighted cases."""
    return evaluate.kish(_weighted(spark, folder), "weight").select("n", F.round("w", 6).alias("w"), F.round("n_eff", 6).alias("n_eff"))


def bootstrap_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals of precision and recall of the score by a bootstrap of groups within strata, over all cases."""
    c = _weighted(spark, folder).withColumn("cluster", F.coalesce("group_id", "case_id"))
    cell = lambda p: F.when(p, F.col("weight")).otherwise(0.0)
    reps = evaluate.replicate_sums(c, "stratum", "cluster", 200, "bootstrap", tp=cell(F.col("truth") & F.col("decided")), fp=cell(~F.col("truth") & F.col("decided")), fn=cell(F.col("truth") & ~F.col("decided")))
    rate = lambda b: (F.col("tp") + 0.5) / (F.col("tp") + F.col(b) + 1)
    each = reps.select(F.explode(F.array(F.struct(F.lit("precision").alias("metric"), rate("fp").alias("x")), F.struct(F.lit("recall").alias("metric"), rate("fn").alias("x")))).alias("m")).select("m.*")
    return each.groupBy("metric").agg(F.round(F.avg("x"), 9).alias("mean"), F.round(F.percentile("x", 0.025), 9).alias("low"), F.round(F.percentile("x", 0.975), 9).alias("high"))


def shipped_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The threshold to ship at a weighted precision of 0.35 and a hundred cases, or why there is none."""
    out = evaluate.select_threshold(_weighted(spark, folder), "score", "truth", "weight", 0.35, 20)
    return out.select("threshold", "status", "fallback", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "positives")


def probability_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the score may be called a probability."""
    out = evaluate.probability_gate(_weighted(spark, folder), "score", "truth", "weight")
    return out.select(F.round("ece", 9).alias("ece"), F.round("region_ece", 9).alias("region_ece"), "region_cases", "score_type")


def banded_precision(spark: SparkSession, folder: str) -> DataFrame:
    """Precision and estimated recall from each band of scores up, of a labelled fifth of the cases."""
    c = _cases(spark, folder)
    out = evaluate.banded_precision(c.filter(bucket(F.col("case_id"), "band") < 20), c, "score", "truth", [0.0, 0.25, 0.5, 0.75, 1.0])
    return out.select("threshold", "n", *[F.round(x, 9).alias(x) for x in ("precision", "low", "high", "recall")])


def split_report(spark: SparkSession, folder: str) -> DataFrame:
    """Precision and recall of the score and of the rules, over all, by region and by stratum."""
    c = _weighted(spark, folder).withColumns({"cluster": F.coalesce("group_id", "case_id"), "baseline": F.col("stratum").endswith("accepted")})
    out = evaluate.split_report(c, {"region": F.substring_index("stratum", ":", 1), "stratum": F.col("stratum")}, "stratum", "cluster", "truth", "decided", "baseline", "weight", 100, "report")
    return out.select("part", "arm", "n", *[F.round(x, 9).alias(x) for x in ("precision", "precision_low", "precision_high", "recall", "recall_low", "recall_high")])


def calibration_method(spark: SparkSession, folder: str) -> DataFrame:
    """Which calibration the true cases suffice for."""
    method, n = models.choose_calibration(_weighted(spark, folder), "truth", "weight", 200.0)
    return spark.createDataFrame([(method, round(n, 6))], "method string, n_eff double")


def fitted_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of the cases normalised over those with a group, by stratum."""
    p = F.when(F.col("stratum").endswith("accepted"), 0.5).otherwise(0.1)
    out = models.normalised_weights(_cases(spark, folder).withColumn("probability", p), "probability", F.col("group_id").isNotNull())
    return out.groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 9).alias("weight"))


def group_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Cases of each stratum by the fold of their group."""
    c = _cases(spark, folder)
    return c.groupBy("stratum", models.fold(F.coalesce("group_id", "case_id"), 5).alias("fold")).agg(F.count("*").alias("n"))


def isotonic_knots(spark: SparkSession, folder: str) -> DataFrame:
    """Knots of a calibration that never falls."""
    knots = [(x, round(y, 9)) for x, y in models.isotonic(_weighted(spark, folder), "score", "truth", "weight")]
    return spark.createDataFrame(knots, "score double, calibrated double")


def zero_fp_point(spark: SparkSession, folder: str) -> DataFrame:
    """The lowest score above every untrue case among the accepted, and the cases there."""
    return models.zero_false_positive(_cases(spark, folder).filter("stratum like '%:accepted'"), "score", "truth")


def unresolved_share(spark: SparkSession, folder: str) -> DataFrame:
    """The weighted share of cases whose two passes of labels differ, by stratum."""
    a, b = _passes(spark, folder)
    both = a.withColumnRenamed("label", "l1").join(b.withColumnRenamed("label", "l2"), "case_id").join(_weighted(spark, folder).select("case_id", "stratum", "weight"), "case_id")
    return both.groupBy("stratum").agg(F.round(F.sum(F.when(F.col("l1") != F.col("l2"), F.col("weight")).otherwise(0.0)) / F.sum("weight"), 9).alias("share"))


QUERIES = {f.__name__: f for f in (
    case_extract, reconcile_cases, domain_check, stratum_sizes, hash_draw, grouped_split, split_leaks, blind_queue, agreement_report, agreement_kappa, wilson_ci,
    weighted_confusion, ht_weights, stratified_precision, threshold_choice, average_precision, ece_bins, kish_n, bootstrap_intervals,
    clean_lenders, compare_extracts, party_corpus, corpus_completeness, clean_addresses, shipped_threshold, probability_gate, banded_precision, split_report, calibration_method, fitted_weights,
    group_folds, isotonic_knots, zero_fp_point, unresolved_share,
)}

_bucket = lambda seed, n: f"CAST('0x' || substr(md5('{seed}:' || case_id), 1, 8) AS BIGINT) % {n}"
_CASES = f"""c0 AS (SELECT case_id, min(region) AS region, max(baseline_qualifies) AS q, min(lower(group_id)) AS group_id FROM candidates WHERE case_id IS NOT NULL GROUP BY 1),
    c AS (SELECT case_id, group_id, coalesce(region, '?') || ':' || CASE WHEN q THEN 'accepted' ELSE 'rejected' END AS stratum, {_bucket("label", 100)} < 40 AS truth, {_bucket("score", 1000)} / 1000.0::DOUBLE AS score FROM c0)"""
_WEIGHTED = f"{_CASES}, w AS (SELECT *, CASE WHEN ends_with(stratum, 'accepted') THEN 1 / 0.5::DOUBLE ELSE 1 / 0.1::DOUBLE END AS weight, score >= 0.5 AS decided FROM c)"
_PASSES = f"""{_CASES}, a AS (SELECT case_id, CASE WHEN truth THEN 'yes' ELSE 'no' END AS label FROM c),
    b AS (SELECT case_id, CASE WHEN truth <> ({_bucket("flip", 100)} < 12) THEN 'yes' ELSE 'no' END AS label FROM c WHERE {_bucket("second", 100)} < 90),
    m AS (SELECT a.label AS label_1, b.label AS label_2, count(*) AS n FROM a JOIN b ON a.case_id = b.case_id GROUP BY 1, 2)"""
_DRAW = f"""{_CASES}, k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('pilot:{SEED}:' || case_id), case_id) AS draw_rank, count(*) OVER (PARTITION BY stratum) AS pop_h,
    CASE WHEN stratum LIKE 'CO:%' THEN 10 ELSE 5 END AS n_h FROM c WHERE stratum IN ('CO:accepted', 'CO:rejected', 'CT:accepted', 'CT:rejected')),
    d AS (SELECT case_id, stratum, pop_h, pop_h AS pool_h, n_h::BIGINT AS n_h, n_h / pop_h AS inclusion_probability, draw_rank FROM k WHERE draw_rank <= n_h)"""
_SPLIT = f"""{_CASES}, g AS (SELECT DISTINCT group_id FROM c WHERE group_id IS NOT NULL), t AS (SELECT count(*) AS n FROM g),
    o AS (SELECT group_id, row_number() OVER (ORDER BY sha256('split:{SEED}:' || group_id), group_id) AS pos FROM g),
    s AS (SELECT group_id, CASE WHEN pos <= round_even(0.65 * n, 0) THEN 'train' WHEN pos <= round_even(0.65 * n, 0) + round_even(0.15 * n, 0) THEN 'validation' ELSE 'test' END AS split FROM o, t)"""
_BORROWERS = "sha256(to_json([" + ", ".join(
    "regexp_replace(upper(coalesce({0}, '')), '^[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}]+|[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}]+$', '', 'g')".format(c) for c in ("organizationname", "address1", "city", "state", "zipcode")
) + "]))"
_JUNK = ", ".join(f"'{a}'" for a in PLACEHOLDER_ADDRESSES)
_extract = lambda region, f, d, l: f"""
    d{region} AS (SELECT fileid, min(TRY_CAST(substr(filingdate, 1, 10) AS DATE)) AS lo, max(TRY_CAST(substr(filingdate, 1, 10) AS DATE)) AS hi, min(masterdocumentid) AS ma, max(coalesce(terminationflag = 'true', false)) AS en FROM {f} WHERE substr(filingdate, 1, 4) >= '1990' GROUP BY 1),
    p{region} AS (SELECT fileid, {_BORROWERS} AS bk, min(organizationname) AS raw, min(zipcode) AS zip, count(*) AS n FROM {d} WHERE trim(organizationname) <> '' AND upper(trim(address1)) NOT IN ({_JUNK}) AND fileid IS NOT NULL GROUP BY 1, 2),
    l{region} AS (SELECT fileid, array_to_string(list_sort(list(DISTINCT organizationname)), '|') AS lenders FROM {l} WHERE trim(organizationname) <> '' GROUP BY 1),
    x{region} AS (SELECT sha256(to_json(['{region}', p.fileid, bk])) AS case_id, '{region}' AS region, p.fileid AS file_id, sha256(to_json(['{region}', coalesce(ma, p.fileid)])) AS lineage_id, raw AS borrower_name_raw, coalesce(lenders, '') AS lenders,
        lo AS earliest_observed_date, hi AS latest_observed_date, n AS source_row_count, CASE WHEN en THEN 'terminated' ELSE 'active' END AS source_status, zip AS borrower_zip
        FROM p{region} p JOIN d{region} d ON p.fileid = d.fileid LEFT JOIN l{region} l ON p.fileid = l.fileid)"""  # noqa: E731
_FLAT = """(SELECT id_lien_flng_nbr AS fileid, dt_accept AS filingdate, id_lien_flng_nbr AS masterdocumentid, CAST(lien_status <> 'Active' AS VARCHAR) AS terminationflag, debtor_nm_bus AS organizationname, debtor_ad_str1 AS address1,
    debtor_ad_city AS city, debtor_ad_state AS state, debtor_ad_zip AS zipcode FROM ct_filings)"""
_EXTRACT = _extract("CO", "co_filings", "co_debtors", "co_secured_parties") + ", " + _extract("CT", _FLAT, _FLAT, "(SELECT id_lien_flng_nbr AS fileid, sec_party_nm_bus AS organizationname FROM ct_filings)") + ", ex AS (SELECT * FROM xCO UNION ALL SELECT * FROM xCT)"
_CLEAN = "regexp_replace(upper(coalesce(address1, '')), '[^A-Z0-9 ]', ' ', 'g')"
for _word, _short in ADDRESS_CLEAN:
    _CLEAN = f"regexp_replace({_CLEAN}, '\\b{_word}\\b', '{_short}', 'g')"

ORACLE = {
    "case_extract": f"""WITH {_EXTRACT} SELECT case_id, region, file_id, lineage_id, borrower_name_raw, lenders, earliest_observed_date, latest_observed_date, source_row_count, source_status FROM ex""",
    "compare_extracts": f"""
        WITH {_EXTRACT}, o AS (SELECT case_id, min(file_id) AS file_id, min(borrower_zip) AS z FROM candidates WHERE case_id IS NOT NULL GROUP BY 1), n AS (SELECT case_id, min(file_id) AS file_id, min(borrower_zip) AS z FROM ex GROUP BY 1),
        b AS (SELECT o.case_id AS a, n.case_id AS b, coalesce(o.file_id <> n.file_id, false) AS cf, (o.z IS DISTINCT FROM n.z) AND o.case_id IS NOT NULL AND n.case_id IS NOT NULL AS cz FROM o FULL JOIN n ON o.case_id = n.case_id),
        s AS (SELECT count(a) AS ka, count(b) AS kb, count(*) FILTER (WHERE b IS NULL) AS gone, count(*) FILTER (WHERE a IS NULL) AS came, count(*) FILTER (WHERE cf) AS cf, count(*) FILTER (WHERE cz) AS cz, count(*) FILTER (WHERE a IS NULL OR b IS NULL OR cf OR cz) AS x FROM b),
        r AS (SELECT 'keys' AS measure, ka AS old, kb AS new FROM s UNION ALL SELECT 'missing', 0, gone FROM s UNION ALL SELECT 'extra', 0, came FROM s UNION ALL SELECT 'changed_file_id', 0, cf FROM s UNION ALL SELECT 'changed_borrower_zip', 0, cz FROM s UNION ALL SELECT 'parity', 0, x FROM s)
        SELECT measure, old, new, new - old AS delta, new = old AS equal FROM r""",
    "corpus_completeness": """
        WITH r AS (SELECT 'CO' AS region, organizationname, address1, city, state, zipcode, recordstatus = 'active' AND NOT coalesce(actiontype IN ('delete only', 'change and delete'), false) AS a FROM co_debtors
                   UNION ALL SELECT 'CT', debtor_nm_bus, debtor_ad_str1, debtor_ad_city, debtor_ad_state, debtor_ad_zip, lien_status = 'Active' AND NOT coalesce(cd_flng_type IN ('RELEASE ORIG', 'RELEASE', 'PARTIAL RELEASE'), false) FROM ct_filings)
        SELECT region, count(*) AS n, count(*) FILTER (WHERE a) AS active, """ + ", ".join(f"round(avg(CASE WHEN trim({c}) <> '' THEN 1.0 ELSE 0 END), 9) AS with_{c}" for c in ("organizationname", "address1", "city", "state", "zipcode")) + " FROM r GROUP BY 1",
    "clean_addresses": "SELECT address1, CASE WHEN t IN (" + ", ".join(f"'{a}'" for a in ADDRESS_JUNK) + ") THEN '' ELSE t END AS cleaned FROM (SELECT DISTINCT address1, trim(regexp_replace(" + _CLEAN + ", '\\s+', ' ', 'g')) AS t FROM co_debtors)",
    "banded_precision": f"""
        WITH {_CASES}, b AS (SELECT CAST(floor(score * 4) AS INTEGER) AS band, count(*) AS size, count(*) FILTER (WHERE l) AS n, count(*) FILTER (WHERE l AND truth) AS k FROM (SELECT *, {_bucket("band", 100)} < 20 AS l FROM c) GROUP BY 1),
        u AS (SELECT band, sum(n) OVER d AS n, sum(size) OVER d AS s, sum(size * k / n) OVER d AS t, sum(size * k / n) OVER () AS al, sum(size * size * (k / n) * (1 - k / n) / n) OVER d AS v FROM b WHERE n > 0 WINDOW d AS (ORDER BY band DESC ROWS UNBOUNDED PRECEDING))
        SELECT band * 0.25::DOUBLE AS threshold, CAST(n AS BIGINT) AS n, round(t / s, 9) AS precision, round(greatest(t / s - {evaluate.Z!r}::DOUBLE * sqrt(v) / s, 0), 9) AS low, round(least(t / s + {evaluate.Z!r}::DOUBLE * sqrt(v) / s, 1), 9) AS high, round(t / al, 9) AS recall FROM u""",
    "shipped_threshold": f"""
        WITH {_WEIGHTED}, s AS (SELECT score, sum(CASE WHEN truth THEN weight ELSE 0 END) AS t, sum(CASE WHEN truth THEN 0 ELSE weight END) AS f, count(*) AS n FROM w GROUP BY 1),
        u AS (SELECT score, sum(t) OVER d AS tp, sum(f) OVER d AS fp, sum(n) OVER d AS n, sum(t) OVER () AS p FROM s WINDOW d AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
        v AS (SELECT score AS threshold, tp / (tp + fp) AS pr, tp / p AS re, coalesce(2 * (tp / (tp + fp)) * (tp / p) / nullif(tp / (tp + fp) + tp / p, 0), 0) AS f1, n FROM u WHERE n >= 20),
        k AS (SELECT *, pr >= 0.35 AS held FROM v ORDER BY held DESC, CASE WHEN held THEN re ELSE f1 END DESC, CASE WHEN held THEN pr END DESC, threshold DESC LIMIT 1)
        SELECT threshold, CASE WHEN held THEN 'production' ELSE 'experimental' END AS status, CASE WHEN NOT held THEN 'max_f1' END AS fallback, round(pr, 9) AS precision, round(re, 9) AS recall, round(f1, 9) AS f1, CAST(n AS BIGINT) AS positives FROM k""",
    "isotonic_knots": f"""
        WITH {_WEIGHTED}, s AS (SELECT score, sum(CASE WHEN truth THEN weight ELSE 0 END) AS t, sum(weight) AS x FROM w GROUP BY 1),
        n AS (SELECT score, t, x, row_number() OVER (ORDER BY score) AS i, sum(t) OVER (ORDER BY score) AS ct, sum(x) OVER (ORDER BY score) AS cx FROM s),
        a AS (SELECT j.i AS j, k.i AS k, (k.ct - j.ct + j.t) / (k.cx - j.cx + j.x) AS mean FROM n j JOIN n k ON k.i >= j.i), f AS (SELECT j, k, min(mean) OVER (PARTITION BY j ORDER BY k DESC) AS least FROM a),
        y AS (SELECT k, round(max(least), 9) AS calibrated FROM f GROUP BY 1) SELECT min(score) AS score, calibrated FROM y JOIN n ON n.i = y.k GROUP BY calibrated""",
    "calibration_method": f"WITH {_WEIGHTED}, k AS (SELECT coalesce(sum(weight) * sum(weight) / sum(weight * weight), 0) AS n FROM w WHERE truth) SELECT CASE WHEN n >= 200 THEN 'isotonic' ELSE 'sigmoid' END AS method, round(n, 6) AS n_eff FROM k",
    "fitted_weights": f"WITH {_WEIGHTED} SELECT stratum, count(*) AS n, round(avg(weight / (SELECT avg(weight) FROM w WHERE group_id IS NOT NULL)), 9) AS weight FROM w GROUP BY 1",
    "bootstrap_intervals": f"""
        WITH {_WEIGHTED}, p AS (SELECT stratum, coalesce(group_id, case_id) AS cl, sum(CASE WHEN truth AND decided THEN weight ELSE 0 END) AS tp, sum(CASE WHEN NOT truth AND decided THEN weight ELSE 0 END) AS fp, sum(CASE WHEN truth AND NOT decided THEN weight ELSE 0 END) AS fn FROM w GROUP BY 1, 2),
        e AS (SELECT *, -ln((CAST('0x' || substr(md5('bootstrap:' || draw || ':' || cl), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE) AS g FROM p, (SELECT unnest(range(1, 201)) AS draw)),
        m AS (SELECT draw, stratum, sum(g * tp) / avg(g) AS tp, sum(g * fp) / avg(g) AS fp, sum(g * fn) / avg(g) AS fn FROM e GROUP BY 1, 2), r AS (SELECT draw, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM m GROUP BY 1),
        x AS (SELECT 'precision' AS metric, (tp + 0.5) / (tp + fp + 1) AS x FROM r UNION ALL SELECT 'recall', (tp + 0.5) / (tp + fn + 1) FROM r)
        SELECT metric, round(avg(x), 9) AS mean, round(quantile_cont(x, 0.025), 9) AS low, round(quantile_cont(x, 0.975), 9) AS high FROM x GROUP BY 1""",
    "reconcile_cases": """
        WITH a AS (SELECT DISTINCT file_id FROM candidates WHERE region = 'CO' AND file_id IS NOT NULL), b AS (SELECT DISTINCT fileid FROM co_filings WHERE fileid IS NOT NULL)
        SELECT count(file_id) AS left_keys, count(fileid) AS right_keys, count(*) FILTER (WHERE file_id IS NOT NULL AND fileid IS NOT NULL) AS both,
               count(*) FILTER (WHERE fileid IS NULL) AS left_only, count(*) FILTER (WHERE file_id IS NULL) AS right_only FROM a FULL JOIN b ON file_id = fileid""",
    "domain_check": """
        WITH b AS (SELECT actiontype FROM co_debtors WHERE NOT coalesce(actiontype IN ('add', 'change'), false))
        SELECT 'actiontype' AS "column", count(*) AS bad_rows, array_to_string((SELECT list_sort(list(DISTINCT substr(actiontype, 1, 40)))[1:5] FROM b WHERE actiontype IS NOT NULL), '|') AS examples FROM b""",
    "stratum_sizes": f"WITH {_CASES}, v AS (SELECT unnest(['CO:accepted', 'CO:rejected', 'CT:accepted', 'CT:rejected', 'NY:accepted', 'NY:rejected']) AS stratum) SELECT v.stratum, count(case_id) AS pop_h FROM v LEFT JOIN c ON v.stratum = c.stratum GROUP BY 1",
    "hash_draw": f"WITH {_DRAW} SELECT * FROM d",
    "grouped_split": f"WITH {_SPLIT} SELECT * FROM s",
    "split_leaks": f"WITH {_SPLIT}, j AS (SELECT case_id, c.group_id, split FROM c JOIN s ON c.group_id = s.group_id) SELECT 0 AS leaks, count(DISTINCT group_id) AS n_values, 'group_id' AS key FROM j UNION ALL SELECT 0, count(DISTINCT case_id), 'case_id' FROM j",
    "blind_queue": f"""
        WITH {_DRAW}, b AS (SELECT case_id, sha256('round-1:{SEED}:' || case_id) AS g, false AS is_repeat FROM d), n AS (SELECT CAST(floor(0.1 * count(*) + 0.5) AS BIGINT) AS k FROM b),
        r AS (SELECT case_id, row_number() OVER (ORDER BY sha256('round-1:repeat:{SEED}:' || case_id), case_id) AS rn FROM b),
        q AS (SELECT * FROM b UNION ALL SELECT case_id, sha256('round-1:again:{SEED}:' || case_id), true FROM r, n WHERE rn <= k),
        p AS (SELECT *, row_number() OVER (ORDER BY g, case_id) AS position FROM q)
        SELECT substr(g, 1, 16) AS queue_id, position, (position - 1) // 8 AS chunk, is_repeat, case_id FROM p""",
    "agreement_report": f"WITH {_PASSES} SELECT * FROM m",
    "agreement_kappa": f"""
        WITH {_PASSES}, r AS (SELECT label_1 AS l, sum(n) AS r FROM m GROUP BY 1), k AS (SELECT label_2 AS l, sum(n) AS k FROM m GROUP BY 1), t AS (SELECT sum(n) AS t, sum(n) FILTER (WHERE label_1 = label_2) AS same FROM m),
        e AS (SELECT sum(r * k) AS e FROM r JOIN k ON r.l = k.l)
        SELECT CAST(t AS BIGINT) AS n, round(same / t, 9) AS observed, round(e / (t * t), 9) AS expected, round((same / t - e / (t * t)) / (1 - e / (t * t)), 9) AS kappa FROM t, e""",
    "wilson_ci": f"""
        WITH {_CASES}, s AS (SELECT stratum, count(*) FILTER (WHERE truth) AS hits, count(*) AS n FROM c GROUP BY 1), z AS (SELECT *, hits / n AS p, {evaluate.Z!r}::DOUBLE AS z FROM s)
        SELECT stratum, hits, n, round(greatest((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 0), 9) AS low,
               round(least((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 1), 9) AS high FROM z""",
    "weighted_confusion": f"""
        WITH {_WEIGHTED}, k AS (SELECT sum(weight) FILTER (WHERE truth AND decided) AS tp, sum(weight) FILTER (WHERE NOT truth AND decided) AS fp, sum(weight) FILTER (WHERE truth AND NOT decided) AS fn, sum(weight) FILTER (WHERE NOT truth AND NOT decided) AS tn FROM w)
        SELECT round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn, round(tn, 6) AS tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM k""",
    "ht_weights": f"WITH {_DRAW} SELECT stratum, round(sum(1 / inclusion_probability), 6) AS estimate, max(pop_h) AS size, abs(sum(1 / inclusion_probability) - max(pop_h)) <= 1e-6 * max(pop_h) AS agrees FROM d GROUP BY 1",
    "stratified_precision": f"""
        WITH {_WEIGHTED}, z AS (SELECT stratum, count(*) AS size FROM w GROUP BY 1), s AS (SELECT w.stratum, count(*) AS n, avg(CASE WHEN truth THEN 1.0 ELSE 0.0 END) AS p FROM w WHERE decided GROUP BY 1),
        j AS (SELECT n, p, size / sum(size) OVER () AS share FROM s JOIN z ON s.stratum = z.stratum)
        SELECT round(sum(share * p), 9) AS precision, round(sqrt(sum(share * share * p * (1 - p) / greatest(n - 1, 1))), 9) AS standard_error, CAST(sum(n) AS BIGINT) AS n FROM j""",
    "threshold_choice": f"""
        WITH {_WEIGHTED}, s AS (SELECT score AS threshold, sum(CASE WHEN truth THEN weight ELSE 0 END) AS t, sum(CASE WHEN truth THEN 0 ELSE weight END) AS f FROM w GROUP BY 1),
        r AS (SELECT threshold, sum(t) OVER d AS tp, sum(f) OVER d AS fp, sum(t) OVER () AS p FROM s WINDOW d AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))
        SELECT threshold, round(tp / (tp + fp), 9) AS precision, round(tp / p, 9) AS recall FROM r WHERE tp / (tp + fp) >= 0.35 ORDER BY tp / p DESC, threshold LIMIT 1""",
    "average_precision": f"""
        WITH {_WEIGHTED}, s AS (SELECT score, sum(CASE WHEN truth THEN weight ELSE 0 END) AS t, sum(weight) AS a FROM w GROUP BY 1),
        r AS (SELECT t, sum(t) OVER d AS tp, sum(a) OVER d AS n, sum(t) OVER () AS p FROM s WINDOW d AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(t / p * (tp / n)), 9) AS average_precision FROM r""",
    "ece_bins": f"""
        WITH {_WEIGHTED}, b AS (SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, sum(weight) AS w, sum(score * weight) / sum(weight) AS mean_score, sum(CASE WHEN truth THEN weight ELSE 0 END) / sum(weight) AS share FROM w GROUP BY 1),
        g AS (SELECT *, abs(mean_score - share) AS gap FROM b)
        SELECT bin, round(w, 9) AS w, round(mean_score, 9) AS mean_score, round(share, 9) AS share, round(gap, 9) AS gap, round(sum(gap * w) OVER () / sum(w) OVER (), 9) AS ece FROM g""",
    "group_folds": f"WITH {_CASES} SELECT stratum, CAST('0x' || substr(sha256('fold:{SEED}:' || coalesce(group_id, case_id)), 1, 8) AS BIGINT) % 5 AS fold, count(*) AS n FROM c GROUP BY 1, 2",
    "zero_fp_point": f"WITH {_CASES}, a AS (SELECT * FROM c WHERE stratum LIKE '%:accepted'), w AS (SELECT max(score) AS worst FROM a WHERE NOT truth) SELECT min(score) AS threshold, count(*) AS merged FROM a, w WHERE worst IS NULL OR score > worst",
    "unresolved_share": f"""
        WITH {_WEIGHTED}, x AS (SELECT *, truth <> ({_bucket("flip", 100)} < 12) AS t2, {_bucket("second", 100)} < 90 AS seen FROM w)
        SELECT stratum, round(sum(CASE WHEN truth <> t2 THEN weight ELSE 0 END) / sum(weight), 9) AS share FROM x WHERE seen GROUP BY 1""",
    "kish_n": f"WITH {_WEIGHTED} SELECT count(*) AS n, round(sum(weight), 6) AS w, round(sum(weight) * sum(weight) / sum(weight * weight), 6) AS n_eff FROM w",
}
