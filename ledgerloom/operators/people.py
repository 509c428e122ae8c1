"""Telling people from organisations, and whether two people's names can be one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.keys import BUSINESS_WORDS
from ledgerloom.functions.similarity import jw_always
from ledgerloom.plans.joins import udf_on_distinct


def parse_people(names: DataFrame, name: str, given_names: DataFrame) -> DataFrame:
    """``names`` with ``surname``, ``given`` and ``initial``; all null for an organisation.

    A person has two or three words, none of business and no digit, one of the first two being a known given
    name; the other is the surname, the last one if both are known.  ``given_names`` is (word), each once.
    """
    t = F.split(name, " ")
    person = F.size(t).between(2, 3) & ~F.col(name).rlike("[0-9]") & ~F.exists(t, lambda w: w.isin(*BUSINESS_WORDS))
    person = person & ((F.size(t) == 2) | (F.length(F.get(t, F.lit(2))) == 1))
    marked = names.withColumns({"_a": F.when(person, F.get(t, F.lit(0))), "_b": F.when(person, F.get(t, F.lit(1))), "_i": F.when(person, F.get(t, F.lit(2)))})
    known = given_names.select("word")
    marked = marked.join(known.select(F.col("word").alias("_a"), F.lit(True).alias("_ka")), "_a", "left").join(known.select(F.col("word").alias("_b"), F.lit(True).alias("_kb")), "_b", "left")
    second = F.col("_kb").isNotNull()
    either = second | F.col("_ka").isNotNull()
    return marked.select(
        *names.columns,
        F.when(either, F.when(second, F.col("_a")).otherwise(F.col("_b"))).alias("surname"),
        F.when(either, F.when(second, F.col("_b")).otherwise(F.col("_a"))).alias("given"),
        F.when(either, F.col("_i")).alias("initial"),
    )


def person_gate(pairs: DataFrame) -> DataFrame:
    """Pairs of parsed names (surname, given, initial, each with _l and _r) with the gate's ``outcome``.

    ``not_people`` if neither is a person, ``mixed`` if one is; else the first that holds of ``initials_differ``,
    ``surname_differs`` (below 0.85), ``given_differs`` (below 0.80 and neither begins with the other) and ``same``.
    """
    people = F.col("surname_l").isNotNull() & F.col("surname_r").isNotNull()
    scored = udf_on_distinct(pairs, ["surname_l", "surname_r"], jw_always, "js", people)
    scored = udf_on_distinct(scored, ["given_l", "given_r"], jw_always, "jg", people)
    head = F.col("given_l").startswith(F.col("given_r")) | F.col("given_r").startswith(F.col("given_l"))
    outcome: Column = (
        F.when(F.col("surname_l").isNull() & F.col("surname_r").isNull(), "not_people")
        .when(~people, "mixed")
        .when(F.coalesce(F.col("initial_l") != F.col("initial_r"), F.lit(False)), "initials_differ")
        .when(F.col("js") < 0.85, "surname_differs")
        .when((F.col("jg") < 0.80) & ~head, "given_differs")
        .otherwise("same")
    )
    return scored.withColumn("outcome", outcome).drop("js", "jg")
