"""Cases: one borrower of one file with its whole set of lenders, and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.keys import borrower_key, case_id, group_id, is_holdout
from ledgerloom.functions.normalize import normalize_name
from ledgerloom.operators.scope import not_blank, real_address


def flat_register(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(filings, debtors, lenders) of a register that keeps lien, debtor and lender in one row, under the names of the others."""
    filings = rows.select(F.col("id_lien_flng_nbr").alias("fileid"), F.col("dt_accept").alias("filingdate"), F.col("cd_flng_type").alias("filingtype"), F.col("id_lien_flng_nbr").alias("masterdocumentid"), (F.col("lien_status") != "Active").cast("string").alias("terminationflag"))
    parts = {"organizationname": "debtor_nm_bus", "address1": "debtor_ad_str1", "city": "debtor_ad_city", "state": "debtor_ad_state", "zipcode": "debtor_ad_zip"}
    debtors = rows.select(F.col("id_lien_flng_nbr").alias("fileid"), *[F.col(v).alias(k) for k, v in parts.items()])
    return filings, debtors, rows.select(F.col("id_lien_flng_nbr").alias("fileid"), F.col("sec_party_nm_bus").alias("organizationname"))


def extract_cases(filings: DataFrame, debtors: DataFrame, lenders: DataFrame, region: str) -> DataFrame:
    """One row for each file and borrower with ids by content, dates, lineage, status, lender lists and source rows.

    Borrowers that differ by letter case or outer spaces are one; lender lists are distinct and sorted, blank
    lenders left out, and clean lists hold the distinct clean names; dates that cannot be read are null.  The lineage
    is that of the smallest master document; the status is terminated if any filing is.  Repeated rows count as
    source rows only.
    """
    day = F.try_to_date(F.substring("filingdate", 1, 10), "yyyy-MM-dd")
    dated = filings.filter(F.substring("filingdate", 1, 4) >= "1990").groupBy("fileid").agg(
        F.min(day).alias("earliest_observed_date"), F.max(day).alias("latest_observed_date"), F.min("filingtype").alias("source_filing_type"),
        F.min("masterdocumentid").alias("_master"), F.max(F.coalesce(F.col("terminationflag") == "true", F.lit(False))).alias("_ended"),
    )
    who = debtors.filter(not_blank(F.col("organizationname")) & real_address(F.col("address1")) & F.col("fileid").isNotNull())
    who = who.withColumn("borrower_key", borrower_key(*[F.col(c) for c in ("organizationname", "address1", "city", "state", "zipcode")]))
    people = who.groupBy("fileid", "borrower_key").agg(
        F.min("organizationname").alias("borrower_name_raw"), F.min("city").alias("borrower_city"), F.min("state").alias("borrower_state"), F.min("zipcode").alias("borrower_zip"), F.count("*").alias("source_row_count")
    )
    named = lenders.filter(not_blank(F.col("organizationname"))).select("fileid", "organizationname", normalize_name(F.col("organizationname"))["name_clean"].alias("clean"))
    lent = named.groupBy("fileid").agg(F.array_sort(F.collect_set("organizationname")).alias("lender_names_raw"), F.array_sort(F.collect_set("clean")).alias("lender_names_clean"))
    rows = people.join(dated, "fileid").join(lent, "fileid", "left")
    none = F.array().cast("array<string>")
    return rows.withColumn("name", normalize_name(F.col("borrower_name_raw"))).select(
        case_id(F.lit(region), F.col("fileid"), F.col("borrower_key")).alias("case_id"),
        F.lit(region).alias("region"),
        F.col("fileid").alias("file_id"),
        F.sha2(F.to_json(F.array(F.lit(region), F.coalesce("_master", "fileid"))), 256).alias("lineage_id"),
        "borrower_key", "borrower_name_raw",
        F.col("name.name_clean").alias("borrower_name_clean"),
        F.col("name.suffix").alias("borrower_suffix"),
        F.coalesce("lender_names_raw", none).alias("lender_names_raw"),
        F.coalesce("lender_names_clean", none).alias("lender_names_clean"),
        "earliest_observed_date", "latest_observed_date", "borrower_city", "borrower_state", "borrower_zip", "source_row_count", "source_filing_type",
        F.when(F.col("_ended"), "terminated").otherwise("active").alias("source_status"),
        group_id(F.lit(region), F.col("name.name_clean"), F.col("borrower_name_raw")).alias("group_id"),
    )


def active_row(region: Column, status: Column, action: Column) -> Column:
    """Whether a register's row is in force: by its own status, and not of an action that deletes or releases; false where unknown."""
    co = (status == "active") & ~F.coalesce(action.isin("delete only", "change and delete"), F.lit(False))
    ct = (status == "Active") & ~F.coalesce(action.isin("RELEASE ORIG", "RELEASE", "PARTIAL RELEASE"), F.lit(False))
    return F.coalesce(F.when(region == "CO", co).otherwise(ct), F.lit(False))


def party_corpus(rows: DataFrame) -> DataFrame:
    """The corpus of parties (region, unique_id, name_raw, name_clean, suffix, city, zipcode, is_active, is_holdout) of register rows.

    ``rows`` has region, unique_id, name_raw, city, zipcode, status and action.  Rows without a clean name can't be
    blocked and are left out; of an id's rows the smallest by all columns is kept.
    """
    n = normalize_name(F.col("name_raw"))
    read = rows.filter(not_blank(F.col("name_raw"))).select("region", "unique_id", "name_raw", n["name_clean"].alias("name_clean"), n["suffix"].alias("suffix"), "city", "zipcode", active_row(F.col("region"), F.col("status"), F.col("action")).alias("is_active"))
    read = read.filter("name_clean is not null and unique_id is not null")
    rest = [c for c in read.columns if c not in ("region", "unique_id")]
    first = read.groupBy("region", "unique_id").agg(F.min(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"o_{c}") for c in rest], *rest)).alias("m"))
    return first.select("region", "unique_id", *[F.col(f"m.{c}").alias(c) for c in rest]).withColumn("is_holdout", is_holdout(F.col("unique_id")))


def compare_extracts(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(measure, old, new, delta, equal): keys on either side, keys missing from each, and keys whose value changed, by value column.

    ``key`` is unique on both sides; the last measure, ``parity``, counts what differs at all.
    """
    a = old.select(key, F.lit(1).alias("_a"), *[F.col(v).alias(f"a_{v}") for v in values])
    b = new.select(key, F.lit(1).alias("_b"), *[F.col(v).alias(f"b_{v}") for v in values])
    both = a.join(b, key, "full")
    missing, extra = F.col("_b").isNull(), F.col("_a").isNull()
    changed = {v: ~missing & ~extra & ~F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}")) for v in values}
    anything = missing | extra
    for c in changed.values():
        anything = anything | c
    sums = both.agg(F.count("_a").alias("k_old"), F.count("_b").alias("k_new"), F.count_if(missing).alias("gone"), F.count_if(extra).alias("came"), *[F.count_if(c).alias(f"c_{v}") for v, c in changed.items()], F.count_if(anything).alias("any"))
    row = lambda name, x, y: F.struct(F.lit(name).alias("measure"), x.alias("old"), y.alias("new"))
    zero = F.lit(0).cast("long")
    rows = [row("keys", F.col("k_old"), F.col("k_new")), row("missing", zero, F.col("gone")), row("extra", zero, F.col("came")), *[row(f"changed_{v}", zero, F.col(f"c_{v}")) for v in values], row("parity", zero, F.col("any"))]
    return sums.select(F.explode(F.array(*rows)).alias("x")).select("x.*", (F.col("x.new") - F.col("x.old")).alias("delta"), (F.col("x.new") == F.col("x.old")).alias("equal"))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys on either side, in both, and missing from each."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full").agg(
        F.count("l").alias("left_keys"), F.count("r").alias("right_keys"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"),
        F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"),
    )


def check_domain(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """One row (column, bad_rows, examples): values outside the domain, up to five of them in order."""
    bad = df.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))
    return bad.agg(F.lit(column).alias("column"), F.count("*").alias("bad_rows"), F.array_join(F.slice(F.array_sort(F.collect_set(F.substring(column, 1, 40))), 1, 5), "|").alias("examples"))
