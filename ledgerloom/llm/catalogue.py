"""Queries of the training-data problems, and SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.addresses import same_place
from ledgerloom.llm.formatting import collapse
from ledgerloom.llm.leaks import leaks, without_leaks
from ledgerloom.llm.linked import group_pairs
from ledgerloom.llm.names import same_name
from ledgerloom.llm.quality import corpus_stats, not_prose
from ledgerloom.llm.sample import stable_sample
from ledgerloom.llm.splits import grouped_split
from ledgerloom.llm.tokens import encode_corpus
from ledgerloom.sources.tables import table

SAMPLE_RATE, SAMPLE_SALT = 0.1, "sample-1:"
SPLIT_SHARES, SPLIT_SALT = {"train": 0.65, "validation": 0.15, "test": 0.20}, "split-1:"


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every id in the scored pairs, at a weight of 5 or more."""
    pairs = table(spark, folder, "predictions_debtors").select("unique_id_l", "unique_id_r", "match_weight")
    return group_pairs(spark, pairs, "unique_id_l", "unique_id_r", "match_weight", 5.0)


def p2_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the debtor corpus, by the hash of its ids."""
    rows = table(spark, folder, "corpus_debtors_eq").select("unique_id", "name_clean", "fileid", "recordstatus", "is_holdout")
    return stable_sample(rows, "unique_id", SAMPLE_RATE, SAMPLE_SALT)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of debtor records of either register that name the same person or organisation."""
    co, ct = table(spark, folder, "co_debtors"), table(spark, folder, "ct_filings")
    records = co.select(F.concat(F.lit("CO:"), "debtorid").alias("key"), F.col("organizationname").alias("name")).unionByName(
        ct.select(F.concat(F.lit("CT:"), "id_lien_flng_nbr").alias("key"), F.col("debtor_nm_bus").alias("name"))
    )
    return same_name(spark, records.filter("key is not null and name is not null").distinct())


def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The split of every row of the cases."""
    cases = table(spark, folder, "candidates").select("case_id", "group_id")
    out = grouped_split(spark, cases, F.col("case_id"), F.lower("group_id"), SPLIT_SHARES, SPLIT_SALT)
    return out.select("case_id", "group_id", "component", "split")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of debtor records of either register at the same place."""
    co, ct = table(spark, folder, "co_debtors"), table(spark, folder, "ct_filings")
    records = co.select(
        F.concat(F.lit("CO:"), "debtorid").alias("key"), F.col("address1").alias("street"), "city", F.col("zipcode").alias("code")
    ).unionByName(
        ct.select(
            F.concat(F.lit("CT:"), "id_lien_flng_nbr").alias("key"),
            F.col("debtor_ad_str1").alias("street"),
            F.col("debtor_ad_city").alias("city"),
            F.col("debtor_ad_zip").alias("code"),
        )
    )
    return same_place(spark, records.filter("key is not null and street is not null").distinct())


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records of either filing table that were delivered more than once, with their copies."""
    keys = {
        "co_filings": F.upper(F.regexp_replace("transactionid", r"[^\p{L}\p{N}]", "")),
        "ct_filings": F.col("id_lien_flng_nbr"),
    }
    parts = []
    for name, key in keys.items():
        rows = table(spark, folder, name)
        found = collapse(spark, rows, rows.columns)
        parts.append(found.select(F.lit(name).alias("source_table"), key.alias("record_key"), "n_copies"))
    return parts[0].unionByName(parts[1])


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document by the vocabulary byte_bpe_50k."""
    return encode_corpus(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", "byte_bpe_50k")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of a held-out item."""
    return p9_matches(spark, folder).select("doc_id", "item_id")


def p9_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The leaks with the longest verbatim match of each: its words and where it begins in the item and in the document."""
    return leaks(spark, table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that remain once those that leak are removed."""
    documents = table(spark, folder, "documents")
    return without_leaks(documents, "doc_id", p9_found(spark, folder)).select("doc_id", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are lists, tables or junk."""
    return not_prose(table(spark, folder, "documents"), "doc_id", "text")


def p10_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The quality statistics of every document."""
    return corpus_stats(table(spark, folder, "documents"), "doc_id", "text")


def queries() -> dict:
    """Name -> callable."""
    return {"p1_found": p1_found, "p2_sample": p2_sample, "p3_found": p3_found, "p4_splits": p4_splits, "p6_found": p6_found, "p7_found": p7_found, "p8_ids": p8_ids, "p9_found": p9_found, "p9_matches": p9_matches, "p9_clean": p9_clean,
        "p10_found": p10_found, "p10_stats": p10_stats,
    }


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL."""
    return {
        "p1_found": """
            WITH RECURSIVE e AS (
                SELECT unique_id_l AS a, unique_id_r AS b FROM predictions_debtors
                WHERE match_weight >= 5 AND NOT isnan(match_weight) AND unique_id_l <> unique_id_r),
            b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
            n AS (SELECT unique_id_l AS id FROM predictions_debtors WHERE unique_id_l IS NOT NULL
                  UNION SELECT unique_id_r FROM predictions_debtors WHERE unique_id_r IS NOT NULL),
            r AS (SELECT id AS unique_id, id AS seen FROM n
                  UNION SELECT r.unique_id, b.b FROM r JOIN b ON r.seen = b.a)
            SELECT unique_id, min(seen) AS group_id FROM r GROUP BY unique_id""",
        "p2_sample": f"""
            SELECT unique_id, name_clean, fileid, recordstatus, is_holdout FROM corpus_debtors_eq
            WHERE CAST('0x' || substr(md5('{SAMPLE_SALT}' || unique_id), 1, 13) AS BIGINT) / 4503599627370496.0 < {SAMPLE_RATE}""",
    }
