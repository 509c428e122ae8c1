"""Relational shapes over the registers: joins, aggregations, windows, sets, top-k and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators.scope import not_blank
from ledgerloom.plans.joins import anti_pairs, block_sizes, canonical_pair, disjunctive_self_join
from ledgerloom.sources.tables import table


def semi_join_files(spark: SparkSession, folder: str) -> DataFrame:
    """Debtor rows of files that some tractor dealer secures."""
    dealt = table(spark, folder, "co_secured_parties").filter(F.upper("organizationname").rlike(r"\bTRACTOR\b")).select("fileid")
    return table(spark, folder, "co_debtors").join(dealt, "fileid", "left_semi").groupBy("state").agg(F.count("*").alias("debtors"))


def anti_join_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Debtor rows whose file is in no filing, and filings without any debtor."""
    filings, debtors = table(spark, folder, "co_filings"), table(spark, folder, "co_debtors")
    orphans = debtors.join(filings, "fileid", "left_anti").select(F.lit("debtor").alias("kind"), F.col("debtorid").alias("key"))
    bare = filings.join(debtors, "fileid", "left_anti").select(F.lit("filing").alias("kind"), F.col("transactionid").alias("key"))
    return orphans.unionByName(bare)


def file_parties_left(spark: SparkSession, folder: str) -> DataFrame:
    """Debtors, lenders and their product for each file, files without lender kept."""
    d, s = table(spark, folder, "co_debtors"), table(spark, folder, "co_secured_parties")
    rows = d.filter("fileid is not null").select("fileid", "debtorid").join(s.select("fileid", "spid"), "fileid", "left")
    return rows.groupBy("fileid").agg(F.count("*").alias("n_rows"), F.countDistinct("debtorid").alias("debtors"), F.countDistinct("spid").alias("lenders"))


def pair_anti_swapped(spark: SparkSession, folder: str) -> DataFrame:
    """Scored pairs below the bar that stand in neither order among those above it."""
    pairs = table(spark, folder, "predictions_debtors").filter("unique_id_l is not null and unique_id_r is not null and not isnan(match_weight)")
    low = pairs.filter("match_weight < 5").select("unique_id_l", "unique_id_r").distinct()
    return anti_pairs(low, pairs.filter("match_weight >= 5"), "unique_id_l", "unique_id_r").distinct()


def pair_canonical_max(spark: SparkSession, folder: str) -> DataFrame:
    """Each unordered pair once with its largest weight and number of rows."""
    pairs = table(spark, folder, "predictions_debtors").filter("unique_id_l is not null and unique_id_r is not null and not isnan(match_weight)")
    return canonical_pair(pairs, "unique_id_l", "unique_id_r").groupBy("unique_id_l", "unique_id_r").agg(F.max("match_weight").alias("weight"), F.count("*").alias("n_rows"))


def disjunctive_block_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of distinct lender names that agree in address or in file, counted by the first rule that finds them."""
    rows = table(spark, folder, "ct_filings").select(
        F.col("id_lien_flng_nbr").alias("id"), F.upper("debtor_nm_bus").alias("name"), F.upper("debtor_ad_str1").alias("address")
    ).filter(not_blank(F.col("name")) & not_blank(F.col("address"))).groupBy("id").agg(F.min("name").alias("name"), F.min("address").alias("address"))
    return disjunctive_self_join(rows, "id", ["name", "address"]).groupBy("rule").agg(F.count("*").alias("pairs"))


def blocking_cardinality(spark: SparkSession, folder: str) -> DataFrame:
    """What blocking the corpus by ZIP, by the name's first four letters or by the whole name would cost."""
    c = table(spark, folder, "corpus_debtors_eq")
    keyed = c.select(F.substring("zipcode", 1, 5).alias("zip"), F.substring("name_clean", 1, 4).alias("prefix"), F.col("name_clean").alias("name"))
    parts = [block_sizes(keyed, k).withColumn("block", F.lit(k)) for k in ("zip", "prefix", "name")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def spacing_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Names that differ by spacing only and share no four-letter prefix, and how many of them share a ZIP."""
    c = table(spark, folder, "corpus_debtors_eq").filter("name_clean is not null")
    n = c.select("name_clean").distinct().select("name_clean", F.replace("name_clean", F.lit(" "), F.lit("")).alias("sq"), F.substring("name_clean", 1, 4).alias("p4"))
    a, b = n.alias("a"), n.alias("b")
    lost = a.join(b, F.expr("a.sq = b.sq and a.name_clean < b.name_clean and a.p4 <> b.p4")).select(F.col("a.name_clean").alias("x"), F.col("b.name_clean").alias("y"))
    zips = c.filter("zipcode is not null").select("name_clean", F.substring("zipcode", 1, 5).alias("z")).distinct()
    # Only the lost pairs are looked up, first by the ZIPs of one name, then by name and ZIP of the other.
    near = lost.join(zips.select(F.col("name_clean").alias("x"), "z"), "x").join(zips.select(F.col("name_clean").alias("y"), "z"), ["y", "z"], "left_semi")
    shared = near.select("x", "y").distinct().withColumn("same", F.lit(1))
    return lost.join(shared, ["x", "y"], "left").agg(F.count("*").alias("lost_pairs"), F.count("same").alias("rescued_by_zip"))


def waterfall_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many debtor rows each exclusion takes, in order and alone, in one pass."""
    d = table(spark, folder, "co_debtors").join(table(spark, folder, "co_filings").select("fileid").distinct().withColumn("filed", F.lit(True)), "fileid", "left")
    no_file, no_name = F.col("filed").isNull(), ~F.coalesce(F.trim("organizationname") != "", F.lit(False))
    no_place = ~F.coalesce(F.trim("address1") != "", F.lit(False))
    return d.agg(
        F.count("*").alias("all_rows"),
        F.count_if(no_file).alias("orphan"),
        F.count_if(~no_file & no_name).alias("then_nameless"),
        F.count_if(~no_file & ~no_name & no_place).alias("then_placeless"),
        F.count_if(~no_file & ~no_name & ~no_place).alias("kept"),
        F.count_if(no_name).alias("alone_nameless"),
        F.count_if(no_place).alias("alone_placeless"),
    )


def verify_source(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, distinct keys, fully repeated rows and null keys of each register table."""
    parts = []
    for name, key in (("co_filings", "transactionid"), ("co_debtors", "debtorid"), ("co_secured_parties", "spid"), ("ct_filings", "id_lien_flng_nbr")):
        df = table(spark, folder, name)
        per = df.groupBy(*df.columns).agg(F.count("*").alias("c__"))
        parts.append(
            per.agg(
                F.sum("c__").alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.sum(F.col("c__") - 1).alias("repeated"),
                F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("c__"))), F.lit(0)).alias("null_keys"),
            ).withColumn("source", F.lit(name))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_row_values(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct identities as rows of values, nulls included, beside distinct single columns."""
    d = table(spark, folder, "co_debtors")
    return d.agg(
        F.countDistinct(F.struct("organizationname", "address1", "city", "zipcode")).alias("identities"),
        F.countDistinct("organizationname").alias("names"),
        F.countDistinct("zipcode").alias("zips"),
    )


def group_size_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Aggregates over group counts: groups, pairs within them, largest and median."""
    g = table(spark, folder, "co_debtors").filter("fileid is not null").groupBy("fileid").agg(F.count("*").alias("c"))
    return g.agg(
        F.count("*").alias("groups"), F.sum((F.col("c") * (F.col("c") - 1) / 2).cast("long")).alias("pairs"), F.max("c").alias("largest"), F.median("c").alias("median_size")
    )


def repeated_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Debtor ids that stand on more than one row, and whether their rows differ."""
    d = table(spark, folder, "co_debtors")
    keyed = d.groupBy("debtorid").agg(F.count("*").alias("n_rows"), F.countDistinct(F.struct(*[c for c in d.columns if c != "debtorid"])).alias("n_variants"))
    return keyed.filter("n_rows > 1")


def lender_lists(spark: SparkSession, folder: str) -> DataFrame:
    """For each file its lenders in order as one text, and the first five as another."""
    s = table(spark, folder, "co_secured_parties").filter(not_blank(F.col("organizationname")) & F.col("fileid").isNotNull())
    names = F.array_sort(F.collect_set("organizationname"))
    return s.groupBy("fileid").agg(F.array_join(names, "|").alias("lenders"), F.array_join(F.slice(names, 1, 5), "|").alias("first_five"), F.size(names).cast("long").alias("n_lenders"))


def status_crosstab(spark: SparkSession, folder: str) -> DataFrame:
    """Debtor rows by action and record status, statuses as columns."""
    d = table(spark, folder, "co_debtors").select(F.coalesce(F.lower("actiontype"), F.lit("none")).alias("action"), F.coalesce(F.lower("recordstatus"), F.lit("unknown")).alias("status"))
    return d.groupBy("action").pivot("status", ["active", "inactive", "unknown"]).count().na.fill(0)


def weight_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Weights in half-bit bins from -10 to 25, ends clipped, dense, with a three-bin moving average."""
    w = table(spark, folder, "predictions_debtors").filter("match_weight is not null and not isnan(match_weight)")
    cell = F.floor((F.least(F.greatest(F.col("match_weight"), F.lit(-10.0)), F.lit(25.0)) + 10) / 0.5).cast("int")
    counts = w.groupBy(F.least(cell, F.lit(69)).alias("bin")).agg(F.count("*").alias("n"))
    bins = spark.range(70).select(F.col("id").cast("int").alias("bin"))
    dense = bins.join(counts, "bin", "left").na.fill(0)
    around = Window.orderBy("bin").rowsBetween(-1, 1)
    return dense.select("bin", "n", F.round(F.sum("n").over(around) / 3, 6).alias("smooth"))


def best_row_per_key(spark: SparkSession, folder: str) -> DataFrame:
    """The first row of each corpus id in the order active first, then file, name and address."""
    c = table(spark, folder, "corpus_debtors_eq").filter("unique_id is not null")
    order = Window.partitionBy("unique_id").orderBy(F.desc("is_active"), F.asc_nulls_last("fileid"), F.asc_nulls_last("name_raw"), F.asc_nulls_last("address1"), F.asc_nulls_last("recordstatus"))
    return c.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("unique_id", "fileid", "name_raw", "address1", "is_active")


def page_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of a thousand orders whose first key does not follow the last key of the page before."""
    o = table(spark, folder, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 1000).alias("page"))
    pages = o.groupBy("page").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    before = F.lag("hi").over(Window.orderBy("page"))
    return pages.select("page", "lo", "hi", before.alias("before"), F.coalesce(before < F.col("lo"), F.lit(True)).alias("in_order"))


def running_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's orders with the running total and the gap to the order before."""
    o = table(spark, folder, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(
        "o_custkey", "o_orderkey",
        F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), 2).alias("running"),
        F.datediff(F.to_date("o_orderdate"), F.to_date(F.lag("o_orderdate").over(w))).alias("gap_days"),
        F.row_number().over(w).alias("rn"),
    )


def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Names of both registers: in both, in one only, by intersection and difference."""
    co = table(spark, folder, "co_debtors").select(F.upper("organizationname").alias("name")).filter("name is not null")
    ct = table(spark, folder, "ct_filings").select(F.upper("debtor_nm_bus").alias("name")).filter("name is not null")
    sides = {"both": co.intersect(ct), "co_only": co.subtract(ct), "ct_only": ct.subtract(co), "either": co.union(ct).distinct()}
    parts = [df.agg(F.count("*").alias("names")).withColumn("side", F.lit(k)) for k, df in sides.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def full_outer_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Files of debtors and of lenders with where each stands."""
    d = table(spark, folder, "co_debtors").select("fileid").distinct().withColumn("in_debtors", F.lit(True))
    s = table(spark, folder, "co_secured_parties").select("fileid").distinct().withColumn("in_lenders", F.lit(True))
    merged = d.join(s, "fileid", "full").filter("fileid is not null")
    side = F.when(F.col("in_debtors").isNotNull() & F.col("in_lenders").isNotNull(), "both").when(F.col("in_debtors").isNotNull(), "left_only").otherwise("right_only")
    return merged.groupBy(side.alias("merge")).agg(F.count("*").alias("files"))


def distinct_from(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus rows whose suffix is distinct from their status text, nulls comparable, by both."""
    c = table(spark, folder, "corpus_debtors_eq").filter(~F.col("suffix").eqNullSafe(F.col("recordstatus")))
    return c.groupBy("suffix", "recordstatus").agg(F.count("*").alias("n"))


def cube_filings(spark: SparkSession, folder: str) -> DataFrame:
    """Filings by type and document over all combinations of both."""
    return table(spark, folder, "co_filings").cube("filingtype", "documenttype").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def multi_value_split(spark: SparkSession, folder: str) -> DataFrame:
    """Lender names of the cases, each list entry a row, blanks dropped, counted."""
    c = table(spark, folder, "candidates").select(F.explode("lender_names_raw").alias("lender")).select(F.trim("lender").alias("lender"))
    return c.filter("lender <> ''").groupBy("lender").agg(F.count("*").alias("n"))


def nested_case_lists(spark: SparkSession, folder: str) -> DataFrame:
    """For each region the number of distinct lender names over all case lists, and the longest list."""
    c = table(spark, folder, "candidates")
    each = c.select("region", F.explode("lender_names_clean").alias("l")).groupBy("region").agg(F.countDistinct("l").alias("lenders"))
    longest = c.groupBy("region").agg(F.max(F.size("lender_names_clean")).cast("long").alias("longest"))
    return each.join(longest, "region")


def lineage_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions of each master document in order, with the days since the one before."""
    f = table(spark, folder, "co_filings").filter("masterdocumentid is not null")
    when = F.try_to_date(F.substring("filingdate", 1, 10), "yyyy-MM-dd")
    w = Window.partitionBy("masterdocumentid").orderBy(F.asc_nulls_last("filingdate"), F.asc_nulls_last("transactionid"), F.asc_nulls_last("fileid"), F.asc_nulls_last("documenttype"))
    steps = f.select("masterdocumentid", F.row_number().over(w).alias("step"), F.datediff(when, F.lag(when).over(w)).alias("days"))
    return steps.groupBy("masterdocumentid").agg(F.max("step").alias("steps"), F.max("days").alias("longest_gap"))


QUERIES = {f.__name__: f for f in (
    semi_join_files, anti_join_orphans, file_parties_left, pair_anti_swapped, pair_canonical_max, disjunctive_block_pairs, blocking_cardinality,
    spacing_loss, waterfall_counts, verify_source, distinct_row_values, group_size_stats, repeated_keys, lender_lists, status_crosstab,
    weight_histogram, best_row_per_key, page_boundaries, running_totals, set_operations, full_outer_merge, distinct_from, cube_filings,
    multi_value_split, nested_case_lists, lineage_chain,
)}

_PAIRS = "p AS (SELECT least(unique_id_l, unique_id_r) AS l, greatest(unique_id_l, unique_id_r) AS r, match_weight AS w FROM predictions_debtors WHERE unique_id_l IS NOT NULL AND unique_id_r IS NOT NULL AND match_weight IS NOT NULL AND NOT isnan(match_weight))"
ORACLE = {
    "semi_join_files": r"SELECT state, count(*) AS debtors FROM co_debtors WHERE fileid IN (SELECT fileid FROM co_secured_parties WHERE regexp_matches(upper(organizationname), '\bTRACTOR\b')) GROUP BY 1",
    "anti_join_orphans": """
        SELECT 'debtor' AS kind, debtorid AS key FROM co_debtors d WHERE NOT EXISTS (SELECT 1 FROM co_filings f WHERE f.fileid = d.fileid)
        UNION ALL SELECT 'filing', transactionid FROM co_filings f WHERE NOT EXISTS (SELECT 1 FROM co_debtors d WHERE f.fileid = d.fileid)""",
    "file_parties_left": "SELECT d.fileid, count(*) AS n_rows, count(DISTINCT debtorid) AS debtors, count(DISTINCT spid) AS lenders FROM co_debtors d LEFT JOIN co_secured_parties s ON d.fileid = s.fileid WHERE d.fileid IS NOT NULL GROUP BY 1",
    "pair_anti_swapped": f"WITH {_PAIRS} SELECT DISTINCT l AS unique_id_l, r AS unique_id_r FROM p WHERE w < 5 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.w >= 5 AND q.l = p.l AND q.r = p.r)",
    "pair_canonical_max": f"WITH {_PAIRS} SELECT l AS unique_id_l, r AS unique_id_r, max(w) AS weight, count(*) AS n_rows FROM (SELECT l, r, w FROM p UNION ALL SELECT least(unique_id_l, unique_id_r), greatest(unique_id_l, unique_id_r), NULL FROM predictions_debtors WHERE unique_id_l IS NOT NULL AND unique_id_r IS NOT NULL AND match_weight IS NULL) GROUP BY 1, 2",
    "disjunctive_block_pairs": """
        WITH r AS (SELECT id_lien_flng_nbr AS id, min(upper(debtor_nm_bus)) AS name, min(upper(debtor_ad_str1)) AS address FROM ct_filings
                   WHERE trim(debtor_nm_bus) <> '' AND trim(debtor_ad_str1) <> '' GROUP BY 1),
        n AS (SELECT count(*) AS c FROM r a JOIN r b ON a.name = b.name AND a.id < b.id),
        a AS (SELECT count(*) AS c FROM r a JOIN r b ON a.address = b.address AND a.id < b.id AND a.name <> b.name)
        SELECT 'name' AS rule, c AS pairs FROM n WHERE c > 0 UNION ALL SELECT 'address', c FROM a WHERE c > 0""",
    "blocking_cardinality": " UNION ALL ".join(
        f"""SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_blocks, CAST(coalesce(sum(c * (c - 1) // 2), 0) AS BIGINT) AS n_pairs, max(c) AS largest, '{b}' AS block
        FROM (SELECT {e} AS k, count(*) AS c FROM corpus_debtors_eq WHERE {e} IS NOT NULL GROUP BY 1)"""
        for b, e in (("zip", "substr(zipcode, 1, 5)"), ("prefix", "substr(name_clean, 1, 4)"), ("name", "name_clean"))
    ),
    "spacing_loss": """
        WITH n AS (SELECT DISTINCT name_clean AS nc, replace(name_clean, ' ', '') AS sq, substr(name_clean, 1, 4) AS p4 FROM corpus_debtors_eq WHERE name_clean IS NOT NULL),
        z AS (SELECT DISTINCT name_clean AS nc, substr(zipcode, 1, 5) AS z FROM corpus_debtors_eq WHERE name_clean IS NOT NULL AND zipcode IS NOT NULL)
        SELECT count(*) AS lost_pairs, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM z u JOIN z v ON u.z = v.z WHERE u.nc = a.nc AND v.nc = b.nc)) AS rescued_by_zip
        FROM n a JOIN n b ON a.sq = b.sq AND a.nc < b.nc AND a.p4 <> b.p4""",
    "waterfall_counts": """
        WITH d AS (SELECT NOT EXISTS (SELECT 1 FROM co_filings f WHERE f.fileid = x.fileid) AS o, NOT coalesce(trim(organizationname) <> '', false) AS n,
                          NOT coalesce(trim(address1) <> '', false) AS p FROM co_debtors x)
        SELECT count(*) AS all_rows, count(*) FILTER (WHERE o) AS orphan, count(*) FILTER (WHERE NOT o AND n) AS then_nameless,
               count(*) FILTER (WHERE NOT o AND NOT n AND p) AS then_placeless, count(*) FILTER (WHERE NOT o AND NOT n AND NOT p) AS kept,
               count(*) FILTER (WHERE n) AS alone_nameless, count(*) FILTER (WHERE p) AS alone_placeless FROM d""",
    "verify_source": " UNION ALL ".join(
        f"SELECT count(*) AS n_rows, count(DISTINCT {k}) AS n_keys, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS repeated, count(*) - count({k}) AS null_keys, '{t}' AS source FROM {t}"
        for t, k in (("co_filings", "transactionid"), ("co_debtors", "debtorid"), ("co_secured_parties", "spid"), ("ct_filings", "id_lien_flng_nbr"))
    ),
    "distinct_row_values": "SELECT (SELECT count(*) FROM (SELECT DISTINCT organizationname, address1, city, zipcode FROM co_debtors)) AS identities, count(DISTINCT organizationname) AS names, count(DISTINCT zipcode) AS zips FROM co_debtors",
    "group_size_stats": "SELECT count(*) AS groups, CAST(sum(c * (c - 1) // 2) AS BIGINT) AS pairs, max(c) AS largest, CAST(median(c) AS DOUBLE) AS median_size FROM (SELECT fileid, count(*) AS c FROM co_debtors WHERE fileid IS NOT NULL GROUP BY 1)",
    "repeated_keys": """
        WITH c AS (SELECT debtorid, count(*) AS n_rows FROM co_debtors GROUP BY 1), v AS (SELECT debtorid, count(*) AS n_variants FROM (SELECT DISTINCT * FROM co_debtors) GROUP BY 1)
        SELECT c.debtorid, n_rows, n_variants FROM c JOIN v ON c.debtorid IS NOT DISTINCT FROM v.debtorid WHERE n_rows > 1""",
    "lender_lists": """
        WITH s AS (SELECT fileid, list_sort(list(DISTINCT organizationname)) AS l FROM co_secured_parties WHERE trim(organizationname) <> '' AND fileid IS NOT NULL GROUP BY 1)
        SELECT fileid, array_to_string(l, '|') AS lenders, array_to_string(l[1:5], '|') AS first_five, len(l) AS n_lenders FROM s""",
    "status_crosstab": """
        SELECT coalesce(lower(actiontype), 'none') AS action, count(*) FILTER (WHERE lower(recordstatus) = 'active') AS active,
               count(*) FILTER (WHERE lower(recordstatus) = 'inactive') AS inactive, count(*) FILTER (WHERE coalesce(lower(recordstatus), 'unknown') = 'unknown') AS unknown FROM co_debtors GROUP BY 1""",
    "weight_histogram": """
        WITH c AS (SELECT least(CAST(floor((least(greatest(match_weight, -10.0), 25.0) + 10) / 0.5) AS INTEGER), 69) AS bin, count(*) AS n
                   FROM predictions_debtors WHERE match_weight IS NOT NULL AND NOT isnan(match_weight) GROUP BY 1),
        d AS (SELECT CAST(range AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(70) LEFT JOIN c ON range = bin)
        SELECT bin, n, round(sum(n) OVER (ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3, 6) AS smooth FROM d""",
    "best_row_per_key": """
        SELECT unique_id, fileid, name_raw, address1, is_active FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY is_active DESC NULLS LAST, fileid NULLS LAST,
               name_raw NULLS LAST, address1 NULLS LAST, recordstatus NULLS LAST) AS rn FROM corpus_debtors_eq WHERE unique_id IS NOT NULL) WHERE rn = 1""",
    "page_boundaries": """
        WITH p AS (SELECT o_orderkey // 1000 AS page, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1)
        SELECT page, lo, hi, lag(hi) OVER (ORDER BY page) AS before, coalesce(lag(hi) OVER (ORDER BY page) < lo, true) AS in_order FROM p""",
    "running_totals": """
        SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running,
               CAST(o_orderdate AS DATE) - CAST(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS gap_days,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders""",
    "set_operations": """
        WITH co AS (SELECT DISTINCT upper(organizationname) AS name FROM co_debtors WHERE organizationname IS NOT NULL), ct AS (SELECT DISTINCT upper(debtor_nm_bus) AS name FROM ct_filings WHERE debtor_nm_bus IS NOT NULL)
        SELECT count(*) AS names, 'both' AS side FROM (FROM co INTERSECT FROM ct) UNION ALL SELECT count(*), 'co_only' FROM (FROM co EXCEPT FROM ct)
        UNION ALL SELECT count(*), 'ct_only' FROM (FROM ct EXCEPT FROM co) UNION ALL SELECT count(*), 'either' FROM (FROM co UNION FROM ct)""",
    "full_outer_merge": """
        WITH d AS (SELECT DISTINCT fileid FROM co_debtors WHERE fileid IS NOT NULL), s AS (SELECT DISTINCT fileid FROM co_secured_parties WHERE fileid IS NOT NULL)
        SELECT CASE WHEN d.fileid IS NOT NULL AND s.fileid IS NOT NULL THEN 'both' WHEN d.fileid IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS merge, count(*) AS files
        FROM d FULL JOIN s ON d.fileid = s.fileid GROUP BY 1""",
    "distinct_from": "SELECT suffix, recordstatus, count(*) AS n FROM corpus_debtors_eq WHERE suffix IS DISTINCT FROM recordstatus GROUP BY 1, 2",
    "cube_filings": "SELECT filingtype, documenttype, count(*) AS n, CAST(grouping_id(filingtype, documenttype) AS BIGINT) AS level FROM co_filings GROUP BY CUBE (filingtype, documenttype)",
    "multi_value_split": "SELECT trim(l) AS lender, count(*) AS n FROM (SELECT unnest(lender_names_raw) AS l FROM candidates) WHERE trim(l) <> '' GROUP BY 1",
    "nested_case_lists": """
        WITH e AS (SELECT region, unnest(lender_names_clean) AS l FROM candidates), a AS (SELECT region, count(DISTINCT l) AS lenders FROM e GROUP BY 1),
        b AS (SELECT region, max(len(lender_names_clean)) AS longest FROM candidates GROUP BY 1) SELECT a.region, lenders, longest FROM a JOIN b ON a.region = b.region""",
    "lineage_chain": """
        WITH f AS (SELECT *, TRY_CAST(substr(filingdate, 1, 10) AS DATE) AS d FROM co_filings WHERE masterdocumentid IS NOT NULL),
        s AS (SELECT masterdocumentid, row_number() OVER w AS step, d - lag(d) OVER w AS days FROM f
              WINDOW w AS (PARTITION BY masterdocumentid ORDER BY filingdate NULLS LAST, transactionid NULLS LAST, fileid NULLS LAST, documenttype NULLS LAST))
        SELECT masterdocumentid, max(step) AS steps, max(days) AS longest_gap FROM s GROUP BY 1""",
}
