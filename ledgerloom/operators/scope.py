"""Filings with their parties: scope rows, entities with a history, published views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.keys import address_key, person_key_of
from ledgerloom.functions.normalize import normalize_name

# Addresses that name no place.
PLACEHOLDER_ADDRESSES = (
    "", "NONE", "UNKNOWN", "N/A", "NA", "SEE ATTACHED", "VARIOUS", "XX", "XXX", "ADDRESS UNKNOWN", "NOT PROVIDED", "NULL", "TBD", "-", "."
)


def not_blank(text: Column) -> Column:
    """Neither null nor spaces only."""
    return text.isNotNull() & (F.trim(text) != "")


def real_address(text: Column) -> Column:
    """Whether an address is given and no placeholder; null is not."""
    return F.coalesce(~F.upper(F.trim(text)).isin(*PLACEHOLDER_ADDRESSES), F.lit(False))


def scope_rows(filings: DataFrame, debtors: DataFrame, lenders: DataFrame, by_lender, by_borrower, since: str = "1990") -> DataFrame:
    """Distinct filing x borrower x lender rows that meet a criterion, of a register kept in three tables.

    ``by_lender`` and ``by_borrower`` make a predicate of a name column.  Files without lender stay, with an
    empty lender; years are compared as text; blank borrowers and placeholder addresses are left out.
    """
    who = debtors.select("fileid", F.col("organizationname").alias("borrower"), F.col("address1").alias("borrower_address"), F.col("city").alias("borrower_city"), F.col("state").alias("borrower_state"), F.col("zipcode").alias("borrower_zip"))
    who = who.filter(not_blank(F.col("borrower")) & real_address(F.col("borrower_address")))
    when = filings.filter(F.substring("filingdate", 1, 4) >= since).select("fileid", F.substring("filingdate", 1, 4).alias("loan_year"))
    lent = lenders.select("fileid", F.col("organizationname").alias("lender"))
    rows = when.join(who, "fileid").join(lent, "fileid", "left").withColumn("lender", F.coalesce("lender", F.lit("")))
    return _flag(rows.withColumn("region", F.lit("CO")), by_lender, by_borrower)


def scope_flat(liens: DataFrame, by_lender, by_borrower, since: str = "1990") -> DataFrame:
    """As ``scope_rows``, of a register that keeps a lien, its debtor and its lender on one row."""
    rows = liens.select(
        F.col("id_lien_flng_nbr").alias("fileid"),
        F.substring("dt_accept", 1, 4).alias("loan_year"),
        F.col("debtor_nm_bus").alias("borrower"),
        F.col("debtor_ad_str1").alias("borrower_address"),
        F.col("debtor_ad_city").alias("borrower_city"),
        F.col("debtor_ad_state").alias("borrower_state"),
        F.col("debtor_ad_zip").alias("borrower_zip"),
        F.coalesce("sec_party_nm_bus", F.lit("")).alias("lender"),
        F.lit("CT").alias("region"),
    )
    rows = rows.filter((F.col("loan_year") >= since) & not_blank(F.col("borrower")) & real_address(F.col("borrower_address")))
    return _flag(rows, by_lender, by_borrower)


def _flag(rows: DataFrame, by_lender, by_borrower) -> DataFrame:
    flagged = rows.withColumns({"route_a": by_lender(F.col("lender")), "route_b": by_borrower(F.col("borrower"))})
    columns = ["region", "fileid", "loan_year", "borrower", "borrower_address", "borrower_city", "borrower_state", "borrower_zip", "lender", "route_a", "route_b"]
    return flagged.filter("route_a or route_b").select(*columns).distinct()


def party_history(filings: DataFrame, debtors: DataFrame, lenders: DataFrame) -> DataFrame:
    """Entities by identity and address with their loan history.

    The identity is the person key, else the clean name; each file counts one lender, the smallest name; texts
    that differ within an entity are represented by the smallest, so the result does not depend on order.
    """
    one = lenders.filter(not_blank(F.col("organizationname"))).groupBy("fileid").agg(F.min("organizationname").alias("lender"))
    who = debtors.filter(not_blank(F.col("organizationname")) & real_address(F.col("address1")))
    loans = who.select("fileid", "organizationname", "address1", "city", "state", "zipcode").join(
        filings.filter(F.substring("filingdate", 1, 4) >= "1990").select("fileid", "filingdate", "continuation", "terminationflag"), "fileid"
    ).join(one, "fileid")
    name = normalize_name(F.col("organizationname"))
    keyed = loans.withColumns({"name_clean": name["name_clean"], "identity_key": F.coalesce(person_key_of(F.col("organizationname")), name["name_clean"]), "address_key": address_key(F.col("address1"))})
    lenders_of = F.slice(F.array_sort(F.collect_set("lender")), 1, 5)
    return keyed.groupBy("identity_key", "name_clean", "address_key").agg(
        F.min("organizationname").alias("name"),
        F.min("city").alias("city"),
        F.countDistinct("fileid").alias("loan_count"),
        F.min(F.substring("filingdate", 1, 10)).alias("first_loan"),
        F.max(F.substring("filingdate", 1, 10)).alias("last_loan"),
        F.countDistinct("lender").alias("distinct_lenders"),
        F.array_join(lenders_of, "|").alias("lenders"),
        F.count_if(F.col("terminationflag") == "true").alias("terminated"),
        F.count_if(F.col("continuation") == "true").alias("continued"),
    )
