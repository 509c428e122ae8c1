"""Names, keys, word rules and string similarity over the corpus of debtors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import keys, rules
from ledgerloom.functions.normalize import ARTICLE, CLAUSE, CLAUSE_WORDS, PEEL, SUFFIXES, char_text, norm_key, normalize_name
from ledgerloom.functions.similarity import coherent, edit_ratio, jw_always, jw_bound, jw_sql, token_jaccard, token_min
from ledgerloom.plans.joins import udf_on_distinct
from ledgerloom.sources.tables import table

TRADE = ["EXCAVATING", "PAVING", "CRANE", "DRILLING", "DEMOLITION", "LOADER", "QUARRY"]
SURNAMES = ["CRANE", "LOADER", "QUARRY"]
#: Words of the lender rule, and what undoes it.
LENDER, VETO = ["EQUIPMENT", "MACHINERY", "CAPITAL", "LEASING"], r"\b(?:FARM|AGRICULTURAL)\b"
#: What only firms write in their name, and families' ways of naming.
FIRM, FAMILY = r"\b(?:INC|LLC|CORP|LTD|CO)\b", r"\b(?:BROS|BROTHERS|FAMILY)\b|& SONS?\b"
CLASSES = {"earth": ["EXCAVATING", "DRILLING", "QUARRY"], "road": ["PAVING", "ASPHALT"], "building": ["ROOFING", "MASONRY", "CARPENTRY"]}


def _names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "co_debtors").select("debtorid", "organizationname", "address1", "city", "state", "zipcode", "fileid").distinct()


def normalize_names(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct raw name with its clean name and suffix."""
    n = table(spark, folder, "co_debtors").select("organizationname").distinct()
    return n.select("organizationname", normalize_name(F.col("organizationname")).alias("p")).select("organizationname", "p.name_clean", "p.suffix")


def suffix_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Names by legal form."""
    return normalize_names(spark, folder).groupBy("suffix").agg(F.count("*").alias("n"))


def content_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids by content: record, party, borrower, case and group of every distinct debtor row."""
    d = _names(spark, folder)
    name, file = F.col("organizationname"), F.coalesce("fileid", F.lit(""))
    borrower = keys.borrower_key(*[F.col(c) for c in ("organizationname", "address1", "city", "state", "zipcode")])
    return d.select(
        "debtorid", "fileid",
        keys.record_id("organizationname", "address1", "city", "state", "zipcode").alias("record_id"),
        keys.party_id(F.col("fileid"), name, F.col("address1"), "CO").alias("party_id"),
        borrower.alias("borrower_key"),
        keys.case_id(F.lit("CO"), file, borrower).alias("case_id"),
    )


def holdout_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each corpus id belongs to the tenth that arrives later."""
    return table(spark, folder, "corpus_debtors_eq").select("unique_id").filter("unique_id is not null").distinct().withColumn("holdout", keys.is_holdout(F.col("unique_id")))


def address_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct addresses with their key and ZIP."""
    d = table(spark, folder, "co_debtors").select("address1", "zipcode").distinct()
    return d.select("address1", "zipcode", keys.address_key(F.col("address1")).alias("address_key"), keys.zip5(F.col("zipcode")).alias("zip5"))


def person_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct clean names with person and identity keys, and block keys."""
    c = table(spark, folder, "corpus_debtors_eq").filter("name_clean is not null").select("name_clean").distinct()
    n = F.col("name_clean")
    return c.select(
        "name_clean", keys.person_key(n).alias("pkey"), keys.identity_key(n).alias("ikey"), keys.name_without_spaces(n).alias("name_ns"),
        keys.name_rest(n).alias("name_rest"), keys.first_two_blocks(n).alias("first2_4"), keys.squeezed_prefix(n).alias("desp12"), keys.signature(n).alias("sig_full"), keys.signature(n, 4).alias("sig4"),
    )


def normal_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Names with white space settled, in two ways."""
    n = table(spark, folder, "ct_filings").select("debtor_nm_bus").filter("debtor_nm_bus is not null").distinct()
    return n.select("debtor_nm_bus", norm_key(F.col("debtor_nm_bus")).alias("norm_key"), char_text(F.col("debtor_nm_bus")).alias("char_text"))


def rule_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Which names meet the trade rule, plainly and with the surname guard, and the classes of their words."""
    n = table(spark, folder, "co_debtors").select("organizationname").distinct()
    name = F.col("organizationname")
    return n.select(
        "organizationname", rules.has_word(name, TRADE).alias("plain"), rules.has_trade_word(name, TRADE, SURNAMES, r"\bPAVING STONE\b", FIRM, FAMILY).alias("guarded"),
        F.array_join(rules.word_classes(name, CLASSES), "+").alias("classes"),
    )


def lender_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Which lenders' names meet the lender rule, which a veto's words undo."""
    n = table(spark, folder, "co_secured_parties").select("organizationname").distinct()
    return n.select("organizationname", rules.has_word(F.col("organizationname"), LENDER, unless=VETO).alias("qualifies"))


def plain_person_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct clean names with the person key that no business word vetoes."""
    c = table(spark, folder, "corpus_debtors_eq").filter("name_clean is not null").select("name_clean").distinct()
    return c.select("name_clean", keys.person_key(F.col("name_clean"), ()).alias("pkey"))


def rule_words(spark: SparkSession, folder: str) -> DataFrame:
    """Names by the plain trade rule and by the classes of their words."""
    return rule_flags(spark, folder).groupBy("plain", "classes").agg(F.count("*").alias("n"))


def case_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Cases by which criteria their lender lists and borrower names meet."""
    c = table(spark, folder, "candidates")
    lender = F.exists(F.coalesce("lender_names_raw", F.array().cast("array<string>")), lambda x: rules.has_word(x, ["TRACTOR", "MACHINERY"]))
    return c.groupBy(rules.route(lender, rules.has_word(F.col("borrower_name_raw"), TRADE)).alias("route")).agg(F.count("*").alias("n"))


def masked_names(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct clean names with the words of the rule taken out."""
    c = table(spark, folder, "corpus_debtors_eq").filter("name_clean is not null").select("name_clean").distinct()
    return c.select("name_clean", rules.mask(F.col("name_clean"), TRADE).alias("masked"))


def _same_zip_names(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different clean names that share ZIP and first letters."""
    c = table(spark, folder, "corpus_debtors_eq").filter("name_clean is not null and zipcode is not null")
    n = c.select("name_clean", F.substring("zipcode", 1, 5).alias("z"), F.substring("name_clean", 1, 3).alias("p")).distinct()
    a, b = n.withColumnRenamed("name_clean", "a"), n.withColumnRenamed("name_clean", "b")
    return a.join(b, ["z", "p"]).filter("a < b").select("a", "b").distinct()


def edit_distance_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Edit distance and ratio, shared words, and coherence of neighbouring names."""
    p = _same_zip_names(spark, folder)
    a, b = F.col("a"), F.col("b")
    return p.select("a", "b", F.levenshtein(a, b).alias("edits"), F.round(edit_ratio(a, b), 6).alias("ratio"), F.round(token_jaccard(a, b), 6).alias("jaccard"), coherent(a, b).alias("coheres"))


def jaro_winkler_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Jaro-Winkler of neighbouring names, run for those whose bound reaches 0.7 only."""
    p = _same_zip_names(spark, folder)
    scored = udf_on_distinct(p, ["a", "b"], jw_sql, "jw", jw_bound(F.col("a"), F.col("b")) >= 0.7)
    return scored.select("a", "b", F.round("jw", 9).alias("jw")).filter("jw >= 0.7")


def token_min_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring names with the worst of their words' best partners."""
    scored = udf_on_distinct(_same_zip_names(spark, folder), ["a", "b"], token_min, "tokmin")
    return scored.select("a", "b", F.round("tokmin", 9).alias("tokmin"))


def jaro_winkler_always(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring names with the prefix counted whatever jaro is, beside the other definition."""
    scored = udf_on_distinct(_same_zip_names(spark, folder), ["a", "b"], jw_always, "always")
    return udf_on_distinct(scored, ["a", "b"], jw_sql, "jw").select("a", "b", F.round("always", 9).alias("always"), F.round("jw", 9).alias("jw"))


def similarity_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring names by band of Jaro-Winkler."""
    jw = F.col("jw")
    band = F.when(jw >= 0.95, "95").when(jw >= 0.9, "90").when(jw >= 0.8, "80").otherwise("70")
    return jaro_winkler_pairs(spark, folder).groupBy(band.alias("band")).agg(F.count("*").alias("pairs"))


QUERIES = {f.__name__: f for f in (
    normalize_names, suffix_counts, content_ids, holdout_flags, address_keys, person_keys, normal_texts, rule_flags, lender_flags, plain_person_keys, rule_words, case_routes,
    masked_names, edit_distance_pairs, jaro_winkler_pairs, token_min_similarity, jaro_winkler_always, similarity_bands,
)}

_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
NORMALIZED = rf"""
    n0 AS (SELECT DISTINCT organizationname AS raw FROM co_debtors),
    n1 AS (SELECT raw, regexp_replace(regexp_replace(translate(replace(upper(raw), '&', ' AND '), '.''’', ''), '{ARTICLE}', ''), '\s+$', '') AS bare FROM n0),
    n2 AS (SELECT *, regexp_extract_all(regexp_extract(bare, '{CLAUSE}', 2), '[A-Z0-9]+') AS words, regexp_extract(bare, '{CLAUSE}', 1) AS head FROM n1),
    n3 AS (SELECT *, len(words) > 0 AND len(list_filter(words, lambda w: NOT list_contains({_list(CLAUSE_WORDS)}, w))) = 0 AS legal FROM n2),
    n4 AS (SELECT raw, legal, words, trim(regexp_replace(regexp_replace(CASE WHEN legal THEN regexp_replace(regexp_replace(regexp_replace(head, '\s+$', ''), '{ARTICLE}', ''), '\s+$', '') ELSE bare END,
                  '[^A-Za-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS plain FROM n3),
    n5 AS (SELECT raw, plain, regexp_extract(plain, '{PEEL}', 2) AS tail, regexp_extract(plain, '{PEEL}', 1) AS front,
                  CASE WHEN legal AND list_contains({_list(SUFFIXES)}, words[-1]) THEN words[-1] END AS fallback FROM n4),
    normalized AS (SELECT raw AS organizationname, nullif(trim(CASE WHEN tail <> '' THEN front ELSE plain END), '') AS name_clean,
                          CASE WHEN plain <> '' THEN coalesce(nullif(tail, ''), fallback) END AS suffix FROM n5)"""
_ZIPNAMES = """n AS (SELECT DISTINCT name_clean AS c, substr(zipcode, 1, 5) AS z, substr(name_clean, 1, 3) AS p FROM corpus_debtors_eq WHERE name_clean IS NOT NULL AND zipcode IS NOT NULL),
    p AS (SELECT DISTINCT x.c AS a, y.c AS b FROM n x JOIN n y ON x.z = y.z AND x.p = y.p AND x.c < y.c)"""
_TRADE_SQL = r"\b(EXCAVATINGS?|PAVINGS?|CRANES?|DRILLINGS?|DEMOLITIONS?|LOADERS?|QUARRYS?)\b"
_STRIP = "regexp_replace(upper(coalesce({0}, '')), '^[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}]+|[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}]+$', '', 'g')"
_BORROWER = "sha256(to_json([" + ", ".join(_STRIP.format(c) for c in ("organizationname", "address1", "city", "state", "zipcode")) + "]))"


def address_key_sql(column: str) -> str:
    """SQL of ``keys.address_key``."""
    text = f"' ' || regexp_replace(upper(coalesce({column}, '')), '[^\\p{{L}}\\p{{N}}]', ' ', 'g') || ' '"
    for long, short in keys.ADDRESS_SHORT:
        text = f"replace({text}, '{long}', '{short}')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def person_key_sql(name: str, suffix: str = "NULL") -> str:
    """SQL of ``keys.person_key`` for names without suffix."""
    t = f"string_split({name}, ' ')"
    plain = f"len({t}) BETWEEN 2 AND 3 AND NOT regexp_matches({name}, '[0-9]') AND NOT list_has_any({t}, {_list(keys.BUSINESS_WORDS)}) AND (len({t}) < 3 OR length({t}[3]) <= 2)"
    return f"CASE WHEN {suffix} IS NULL AND {plain} THEN {t}[1] || '|' || {t}[2] END"


ORACLE = {
    "normalize_names": f"WITH {NORMALIZED} SELECT * FROM normalized",
    "suffix_counts": f"WITH {NORMALIZED} SELECT suffix, count(*) AS n FROM normalized GROUP BY 1",
    "content_ids": f"""
        SELECT debtorid, fileid, substr(md5(concat_ws('|', coalesce(organizationname, ''), coalesce(address1, ''), coalesce(city, ''), coalesce(state, ''), coalesce(zipcode, ''))), 1, 16) AS record_id,
               'CO:' || substr(md5(concat_ws('|', coalesce(fileid, ''), coalesce(organizationname, ''), coalesce(address1, ''))), 1, 16) AS party_id,
               {_BORROWER} AS borrower_key, sha256(to_json(['CO', coalesce(fileid, ''), {_BORROWER}])) AS case_id
        FROM (SELECT DISTINCT debtorid, organizationname, address1, city, state, zipcode, fileid FROM co_debtors)""",
    "holdout_flags": "SELECT DISTINCT unique_id, CAST('0x' || substr(md5('20260830:' || unique_id), 1, 8) AS BIGINT) % 100 < 10 AS holdout FROM corpus_debtors_eq WHERE unique_id IS NOT NULL",
    "address_keys": f"SELECT DISTINCT address1, zipcode, {address_key_sql("address1")} AS address_key, lpad(regexp_replace(zipcode, '[^0-9]', '', 'g'), 5, '0') AS zip5 FROM co_debtors",
    "person_keys": f"""
        WITH c AS (SELECT DISTINCT name_clean, string_split(name_clean, ' ') AS t, replace(name_clean, ' ', '') AS ns FROM corpus_debtors_eq WHERE name_clean IS NOT NULL),
        k AS (SELECT *, list_sort(list_filter(t, lambda w: length(w) > 1)) AS kept, list_sort(list_distinct(list_filter(t, lambda w: length(w) >= 3 AND NOT list_contains({_list(keys.STOP_WORDS)}, w)))) AS sig,
                     list_sort(list_distinct(list_transform(list_filter(t, lambda w: length(w) >= 3 AND NOT list_contains({_list(keys.STOP_WORDS)}, w)), lambda w: substr(w, 1, 4)))) AS sig4 FROM c)
        SELECT name_clean, {person_key_sql("name_clean")} AS pkey, CASE WHEN len(t) BETWEEN 2 AND 3 AND len(kept) >= 2 AND NOT regexp_matches(name_clean, '[0-9]') THEN array_to_string(kept, ' ') ELSE name_clean END AS ikey, ns AS name_ns,
               coalesce(nullif(replace(regexp_extract(name_clean, '^[^ ]+ (.*)$', 1), ' ', ''), ''), ns) AS name_rest, CASE WHEN len(t) >= 2 THEN substr(t[1], 1, 4) || '|' || substr(t[2], 1, 4) END AS first2_4,
               substr(ns, 1, 12) AS desp12, nullif(array_to_string(sig, ' '), '') AS sig_full, nullif(array_to_string(sig4, ' '), '') AS sig4 FROM k""",
    "normal_texts": "SELECT DISTINCT debtor_nm_bus, " + _STRIP.format("debtor_nm_bus") + " AS norm_key, trim(regexp_replace(upper(debtor_nm_bus), '[\\s\\x{a0}\\x{2000}-\\x{200a}]+', ' ', 'g')) AS char_text FROM ct_filings WHERE debtor_nm_bus IS NOT NULL",
    "rule_flags": rf"""
        WITH n AS (SELECT DISTINCT upper(coalesce(organizationname, '')) AS u, organizationname FROM co_debtors),
        h AS (SELECT *, regexp_extract_all(regexp_replace(u, '\bPAVING STONE\b', ' ', 'g'), '{_TRADE_SQL}', 1) AS hits, string_split(trim(regexp_replace(u, '[,.\s]+', ' ', 'g')), ' ') AS parts FROM n),
        s AS (SELECT *, ['CRANE', 'LOADER', 'QUARRY'] AS risky FROM h)
        SELECT organizationname, regexp_matches(u, '{_TRADE_SQL}') AS plain,
               CASE WHEN len(hits) = 0 THEN false WHEN len(list_filter(hits, lambda x: NOT list_contains(risky, x))) > 0 THEN true WHEN regexp_matches(u, '\b(BROS|BROTHERS|FAMILY)\b|& SONS?\b') THEN false
                    WHEN regexp_matches(u, '\b(INC|LLC|CORP|LTD|CO)\b') AND NOT list_contains(risky, parts[1]) THEN true
                    ELSE len(list_filter(parts, lambda x: ends_with(x, 'S') AND NOT regexp_full_match(x, '{_TRADE_SQL}') AND NOT list_contains(risky, x))) > 0 END AS guarded,
               array_to_string(list_filter([CASE WHEN regexp_matches(u, '\b(ROOFINGS?|MASONRYS?|CARPENTRYS?)\b') THEN 'building' END,
               CASE WHEN regexp_matches(u, '\b(EXCAVATINGS?|DRILLINGS?|QUARRYS?)\b') THEN 'earth' END, CASE WHEN regexp_matches(u, '\b(PAVINGS?|ASPHALTS?)\b') THEN 'road' END], lambda x: x IS NOT NULL), '+') AS classes FROM s""",
    "lender_flags": r"""
        SELECT DISTINCT organizationname, regexp_matches(upper(coalesce(organizationname, '')), '\b(EQUIPMENTS?|MACHINERYS?|CAPITALS?|LEASINGS?)\b') AND NOT regexp_matches(upper(coalesce(organizationname, '')), '\b(FARM|AGRICULTURAL)\b') AS qualifies FROM co_secured_parties""",
    "plain_person_keys": """
        WITH c AS (SELECT DISTINCT name_clean, string_split(name_clean, ' ') AS t FROM corpus_debtors_eq WHERE name_clean IS NOT NULL)
        SELECT name_clean, CASE WHEN len(t) BETWEEN 2 AND 3 AND NOT regexp_matches(name_clean, '[0-9]') AND (len(t) < 3 OR length(t[3]) <= 2) THEN t[1] || '|' || t[2] END AS pkey FROM c""",
    "rule_words": rf"""
        WITH n AS (SELECT DISTINCT upper(coalesce(organizationname, '')) AS u, organizationname FROM co_debtors)
        SELECT regexp_matches(u, '{_TRADE_SQL}') AS plain, array_to_string(list_filter([CASE WHEN regexp_matches(u, '\b(ROOFINGS?|MASONRYS?|CARPENTRYS?)\b') THEN 'building' END,
               CASE WHEN regexp_matches(u, '\b(EXCAVATINGS?|DRILLINGS?|QUARRYS?)\b') THEN 'earth' END, CASE WHEN regexp_matches(u, '\b(PAVINGS?|ASPHALTS?)\b') THEN 'road' END], lambda x: x IS NOT NULL), '+') AS classes,
               count(*) AS n FROM n GROUP BY 1, 2""",
    "case_routes": rf"""
        WITH r AS (SELECT len(list_filter(coalesce(lender_names_raw, []), lambda x: regexp_matches(upper(coalesce(x, '')), '\b(TRACTORS?|MACHINERYS?)\b'))) > 0 AS l,
                          regexp_matches(upper(coalesce(borrower_name_raw, '')), '{_TRADE_SQL}') AS b FROM candidates)
        SELECT CASE WHEN l AND b THEN 'both' WHEN l THEN 'lender' WHEN b THEN 'borrower' ELSE 'neither' END AS route, count(*) AS n FROM r GROUP BY 1""",
    "masked_names": rf"SELECT DISTINCT name_clean, trim(regexp_replace(regexp_replace(upper(name_clean), '{_TRADE_SQL}', ' ', 'g'), '\s+', ' ', 'g')) AS masked FROM corpus_debtors_eq WHERE name_clean IS NOT NULL",
    "edit_distance_pairs": f"""
        WITH {_ZIPNAMES}, d AS (SELECT a, b, levenshtein(a, b) AS edits, greatest(length(a), length(b), 1) AS longest, replace(a, ' ', '') AS x, replace(b, ' ', '') AS y, list_distinct(string_split(a, ' ')) AS u, list_distinct(string_split(b, ' ')) AS v FROM p)
        SELECT a, b, CAST(edits AS INTEGER) AS edits, round(1 - edits / longest, 6) AS ratio, round(len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v))), 6) AS jaccard,
               a = b OR 1 - edits / longest >= 0.72 OR (length(x) >= 8 AND length(x) / length(y) >= 0.4 AND length(x) <= length(y) AND starts_with(y, x))
                 OR (length(y) >= 8 AND length(y) / length(x) >= 0.4 AND length(y) <= length(x) AND starts_with(x, y)) AS coheres FROM d""",
    "jaro_winkler_always": f"""
        WITH {_ZIPNAMES}, j AS (SELECT a, b, jaro_similarity(a, b) AS j, CASE WHEN substr(a, 1, 4) = substr(b, 1, 4) THEN least(length(a), length(b), 4) WHEN substr(a, 1, 3) = substr(b, 1, 3) THEN 3 WHEN substr(a, 1, 2) = substr(b, 1, 2) THEN 2
               WHEN substr(a, 1, 1) = substr(b, 1, 1) THEN 1 ELSE 0 END AS l FROM p)
        SELECT a, b, round(j + 0.1 * l * (1 - j), 9) AS always, round(jaro_winkler_similarity(a, b), 9) AS jw FROM j""",
    "jaro_winkler_pairs": f"WITH {_ZIPNAMES} SELECT a, b, round(jaro_winkler_similarity(a, b), 9) AS jw FROM p WHERE jaro_winkler_similarity(a, b) >= 0.7",
    "token_min_similarity": f"""
        WITH {_ZIPNAMES}, t AS (SELECT a, b, list_filter(string_split(a, ' '), lambda x: x <> '') AS u, list_filter(string_split(b, ' '), lambda x: x <> '') AS v FROM p),
        s AS (SELECT a, b, CASE WHEN len(u) <= len(v) THEN u ELSE v END AS small, CASE WHEN len(u) <= len(v) THEN v ELSE u END AS large FROM t)
        SELECT a, b, round(list_min(list_transform(small, lambda x: list_max(list_transform(large, lambda y: jaro_winkler_similarity(x, y))))), 9) AS tokmin FROM s""",
    "similarity_bands": f"WITH {_ZIPNAMES}, s AS (SELECT round(jaro_winkler_similarity(a, b), 9) AS jw FROM p) SELECT CASE WHEN jw >= 0.95 THEN '95' WHEN jw >= 0.9 THEN '90' WHEN jw >= 0.8 THEN '80' ELSE '70' END AS band, count(*) AS pairs FROM s WHERE jw >= 0.7 GROUP BY 1",
}
