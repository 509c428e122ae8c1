"""Places, grids, screening models, streams and sources."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.keys import bucket
from ledgerloom.operators import geo, screening
from ledgerloom.sources.files import manifest
from ledgerloom.sources.tables import table
from ledgerloom.streaming import events as ev

BOX = (37.0, -109.0, 41.0, -102.0)
NY, NX = 24, 36


def _centroids(spark: SparkSession, folder: str) -> DataFrame:
    """A gazetteer made of digests: a point for most five-digit ZIPs of the debtors, by state."""
    z = table(spark, folder, "co_debtors").filter("length(zipcode) = 5").groupBy(F.col("zipcode").alias("zip")).agg(F.min("state").alias("state"))
    z = z.filter(bucket(F.col("zip"), "known") < 90)
    return z.select("zip", "state", (37 + bucket(F.col("zip"), "lat", 4000) / 1000.0).alias("lat"), (-109 + bucket(F.col("zip"), "lon", 7000) / 1000.0).alias("lon"))


def zip_geo_attach(spark: SparkSession, folder: str) -> DataFrame:
    """Debtors by state, with and without a placed ZIP."""
    d = geo.attach_centroids(table(spark, folder, "co_debtors"), "zipcode", _centroids(spark, folder).select("zip", "lat", "lon"))
    return d.groupBy("state").agg(F.count("*").alias("n_rows"), F.count("lat").alias("placed"))


def zip_dots(spark: SparkSession, folder: str) -> DataFrame:
    """One dot for each placed ZIP with its debtors."""
    d = geo.attach_centroids(table(spark, folder, "co_debtors"), "zipcode", _centroids(spark, folder).select("zip", "lat", "lon")).filter("lat is not null")
    return d.groupBy("zip").agg(F.count("*").alias("n"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


def placement_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """How debtors come to a place."""
    d = table(spark, folder, "co_debtors").groupBy("debtorid").agg(F.min("zipcode").alias("zipcode"), F.min("city").alias("city"), F.min("state").alias("state"))
    return geo.placement_cascade(d, "debtorid", "zipcode", "city", "state", _centroids(spark, folder)).groupBy("how").agg(F.count("*").alias("n"))


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    d = geo.attach_centroids(table(spark, folder, "co_debtors"), "zipcode", _centroids(spark, folder).select("zip", "lat", "lon"))
    return geo.grid(d.filter(geo.in_box(F.col("lat"), F.col("lon"), BOX)), BOX, NY, NX)


def density_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Debtors on a grid."""
    return _cells(spark, folder)


def density_blur(spark: SparkSession, folder: str) -> DataFrame:
    """That grid blurred."""
    out = geo.blur(_cells(spark, folder), NY, NX, 1.2)
    return out.select("iy", "ix", F.round("value", 6).alias("value"))


def density_relief(spark: SparkSession, folder: str) -> DataFrame:
    """The blurred grid as a shaded relief."""
    return geo.relief(geo.blur(_cells(spark, folder), NY, NX, 1.2))


def redraw_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty debtors of each state by a digest that holds the number of the draw."""
    d = table(spark, folder, "co_debtors").select("debtorid", "state").distinct().filter("state is not null")
    digest = F.md5(F.concat(F.lit("draw-3:"), "debtorid"))
    return d.withColumn("rn", F.row_number().over(Window.partitionBy("state").orderBy(digest, "debtorid"))).filter("rn <= 20")


def tfidf_top_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The terms of most TF-IDF in each source of documents."""
    d = table(spark, folder, "documents").filter("text is not null")
    out = screening.tfidf_terms(d, "doc_id", "text", "source", 15)
    return out.select("source", "term", "score", "rank")


def _screened_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Cases with their borrower's name, their lenders in one text, and the verdict of the rules."""
    c = table(spark, folder, "candidates").filter("case_id is not null").groupBy("case_id").agg(
        F.min("borrower_name_raw").alias("name"), F.min(F.array_join("lender_names_raw", " ")).alias("lenders"), F.min("lender_names_raw").alias("lender_list"),
        F.max("baseline_qualifies").alias("y"), F.min(F.lower("group_id")).alias("group_id"),
    )
    return c


def _screen(spark: SparkSession, folder: str) -> screening.Screen:
    return screening.fit_screen(_screened_cases(spark, folder).filter(F.trim("name") != ""), "case_id", ["name", "lenders"], "y", "group_id", (0.1, 1.0))


def screen_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every case scored by a model of its borrower's and lenders' names, fitted on a bounded sample; too long names and lists are refused."""
    return screening.score_rows(_screen(spark, folder), _screened_cases(spark, folder), "case_id", ["name", "lenders"], "lender_list")


def top_contributions(spark: SparkSession, folder: str) -> DataFrame:
    """For each case the five terms that move its score most."""
    out = screening.contributions(_screen(spark, folder), _screened_cases(spark, folder), "case_id", ["name", "lenders"], 5)
    return out.select("case_id", "place", "block", "term", F.round("contribution", 6).alias("contribution"))


def screen_terms(spark: SparkSession, folder: str) -> DataFrame:
    """In how many cases each term of the four blocks stands, and its idf, for terms that enough cases hold."""
    c = _screened_cases(spark, folder)
    n = c.count()
    known = screening.text_blocks(c, "case_id", ["name", "lenders"]).groupBy("block", "term").agg(F.count("*").alias("df"))
    least = F.when(F.col("block").endswith("word"), screening.LEAST_ROWS["word"]).otherwise(screening.LEAST_ROWS["char"])
    return known.filter(F.col("df") >= least).withColumn("idf", F.round(F.log((1.0 + n) / (1 + F.col("df"))) + 1, 9))


def map_modes(spark: SparkSession, folder: str) -> DataFrame:
    """The ten ZIPs of most rows in each way of counting: all debtors, distinct files, current records."""
    d = table(spark, folder, "co_debtors").filter("zipcode is not null").groupBy("zipcode").agg(
        F.count("*").alias("rows"), F.countDistinct("fileid").alias("files"), F.count_if(F.col("recordstatus") == "active").alias("active")
    )
    each = d.select("zipcode", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("n")) for m in ("rows", "files", "active")])).alias("x")).select("zipcode", "x.*").filter("n > 0")
    totals = each.groupBy("mode").agg(F.sum("n").alias("total"))
    part = Window.partitionBy("mode", F.pmod(F.xxhash64("zipcode"), F.lit(32))).orderBy(F.desc("n"), "zipcode")
    near = each.withColumn("r", F.row_number().over(part)).filter("r <= 10").drop("r")
    placed = near.withColumn("place", F.row_number().over(Window.partitionBy("mode").orderBy(F.desc("n"), "zipcode"))).filter("place <= 10")
    return placed.join(F.broadcast(totals), "mode").select("mode", "place", "zipcode", "n", "total")


def density_smooth(spark: SparkSession, folder: str) -> DataFrame:
    """The grid of debtors smoothed by twice averaging neighbours."""
    out = geo.box_smooth(_cells(spark, folder), NY, NX, 2)
    return out.select("iy", "ix", F.round("value", 6).alias("value"))


def map_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The dots of the map as compact JSON lines."""
    d = zip_dots(spark, folder)
    return d.select("zip", F.to_json(F.struct(F.col("zip").alias("z"), F.round("lat", 3).alias("y"), F.round("lon", 3).alias("x"), "n")).alias("line"))


def source_probes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and distinct keys of every register, as a source would be asked for them before it is walked."""
    keys = {"co_filings": "transactionid", "co_debtors": "debtorid", "co_secured_parties": "spid", "ct_filings": "id_lien_flng_nbr"}
    parts = [table(spark, folder, t).agg(F.lit(t).alias("source"), F.count("*").alias("n_rows"), F.countDistinct(k).alias("n_keys")) for t, k in keys.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def events_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    """Hours of events as a stream."""
    return ev.run_to_table(spark, ev.tumbling(ev.event_stream(spark, folder)), "start", "event_type")


def events_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping hours of events as a stream."""
    return ev.run_to_table(spark, ev.sliding(ev.event_stream(spark, folder)), "start", "event_type")


def events_session(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of users, over the table."""
    return ev.sessions(table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")))


def events_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Events without repeats, as a stream."""
    stream = ev.first_of_each(ev.event_stream(spark, folder), "event_id", late="3650 days").select("event_id", "user_id", "event_type", "value")
    return ev.run_to_table(spark, stream)


def source_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and order-free digests of the register tables."""
    rows = []
    for name in ("co_filings", "co_debtors", "co_secured_parties", "ct_filings"):
        m = manifest(table(spark, folder, name))
        rows.append((name, m["rows"], len(m["columns"])))
    return spark.createDataFrame(rows, "source string, n_rows long, n_columns int")


QUERIES = {f.__name__: f for f in (
    zip_geo_attach, zip_dots, placement_cascade, density_grid, density_blur, density_relief, redraw_sample, tfidf_top_terms, screen_scores, top_contributions, screen_terms, map_modes, density_smooth, map_rows, source_probes,
    events_tumbling, events_sliding, events_session, events_dedup, source_manifest,
)}

_b = lambda seed, n, key="zip": f"CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT) % {n}"
_PLACES = f"""z AS (SELECT zipcode AS zip, min(state) AS state FROM co_debtors WHERE length(zipcode) = 5 GROUP BY 1),
    g AS (SELECT zip, state, 37 + {_b("lat", 4000)} / 1000.0::DOUBLE AS lat, -109 + {_b("lon", 7000)} / 1000.0::DOUBLE AS lon FROM z WHERE {_b("known", 100)} < 90)"""
_ATTACHED = f"{_PLACES}, a AS (SELECT d.*, lpad(regexp_replace(zipcode, '[^0-9]', '', 'g'), 5, '0') AS z5 FROM co_debtors d), j AS (SELECT a.*, lat, lon FROM a LEFT JOIN g ON z5 = zip)"
_GRID = f"""{_ATTACHED}, c AS (SELECT CAST(round_even((lat - 37.0) / 4.0 * {NY - 1}, 0) AS INTEGER) AS iy, CAST(round_even((lon + 109.0) / 7.0 * {NX - 1}, 0) AS INTEGER) AS ix FROM j WHERE lat BETWEEN 37.0 AND 41.0 AND lon BETWEEN -109.0 AND -102.0),
    d AS (SELECT iy, ix, CAST(count(*) AS DOUBLE) AS value FROM c GROUP BY 1, 2)"""
_REACH = 4
ORACLE = {
    "zip_geo_attach": f"WITH {_ATTACHED} SELECT state, count(*) AS n_rows, count(lat) AS placed FROM j GROUP BY 1",
    "zip_dots": f"WITH {_ATTACHED} SELECT z5 AS zip, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM j WHERE lat IS NOT NULL GROUP BY 1",
    "placement_cascade": f"""
        WITH {_PLACES}, d AS (SELECT debtorid, min(zipcode) AS zipcode, min(city) AS city, min(state) AS state FROM co_debtors GROUP BY 1),
        j AS (SELECT d.debtorid, upper(trim(city)) AS town, d.state, lat FROM d LEFT JOIN g ON lpad(regexp_replace(zipcode, '[^0-9]', '', 'g'), 5, '0') = zip),
        t AS (SELECT DISTINCT town FROM j WHERE lat IS NOT NULL AND town IS NOT NULL), s AS (SELECT DISTINCT state FROM g WHERE state IS NOT NULL)
        SELECT CASE WHEN lat IS NOT NULL THEN 'zip' WHEN t.town IS NOT NULL THEN 'city' ELSE 'state' END AS how, count(*) AS n
        FROM j LEFT JOIN t ON j.town = t.town LEFT JOIN s ON j.state = s.state WHERE lat IS NOT NULL OR t.town IS NOT NULL OR s.state IS NOT NULL GROUP BY 1""",
    "density_grid": f"WITH {_GRID} SELECT * FROM d",
    "density_blur": f"""
        WITH {_GRID}, k0 AS (SELECT range - {_REACH} AS s, exp(-0.5 * pow((range - {_REACH}) / 1.2, 2)) AS k FROM range({2 * _REACH + 1})), k AS (SELECT s, k / (SELECT sum(k) FROM k0) AS k FROM k0),
        v AS (SELECT CAST(least(greatest(iy + s, 0), {NY - 1}) AS INTEGER) AS iy, ix, sum(value * k) AS value FROM d, k GROUP BY 1, 2),
        h AS (SELECT iy, CAST(least(greatest(ix + s, 0), {NX - 1}) AS INTEGER) AS ix, sum(value * k) AS value FROM v, k GROUP BY 1, 2) SELECT iy, ix, round(value, 6) AS value FROM h""",
    "redraw_sample": "WITH d AS (SELECT DISTINCT debtorid, state FROM co_debtors WHERE state IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY md5('draw-3:' || debtorid), debtorid) AS rn FROM d) SELECT * FROM r WHERE rn <= 20",
    "tfidf_top_terms": """
        WITH d AS (SELECT doc_id, source, text FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, source, unnest(list_filter(regexp_split_to_array(upper(text), '[^A-Z0-9]+'), lambda x: x <> '')) AS term FROM d),
        p AS (SELECT source, term, count(*) AS tf, count(DISTINCT doc_id) AS dg FROM w GROUP BY 1, 2), f AS (SELECT term, sum(dg) AS df FROM p GROUP BY 1), n AS (SELECT count(*) AS n FROM d),
        s AS (SELECT source, p.term, round(tf * (ln((1.0 + n) / (1 + df)) + 1), 6) AS score FROM p JOIN f ON p.term = f.term, n),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, term) AS rank FROM s) SELECT source, term, score, rank FROM r WHERE rank <= 15""",
    "map_modes": """
        WITH d AS (SELECT zipcode, count(*) AS rows, count(DISTINCT fileid) AS files, count(*) FILTER (WHERE recordstatus = 'active') AS active FROM co_debtors WHERE zipcode IS NOT NULL GROUP BY 1),
        e AS (SELECT 'rows' AS mode, zipcode, rows AS n FROM d UNION ALL SELECT 'files', zipcode, files FROM d UNION ALL SELECT 'active', zipcode, active FROM d),
        r AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY n DESC, zipcode) AS place, sum(n) OVER (PARTITION BY mode) AS total FROM e WHERE n > 0)
        SELECT mode, CAST(place AS INTEGER) AS place, zipcode, n, CAST(total AS BIGINT) AS total FROM r WHERE place <= 10""",
    "density_smooth": f"""
        WITH RECURSIVE {_GRID}, full0 AS (SELECT CAST(y.range AS INTEGER) AS iy, CAST(x.range AS INTEGER) AS ix FROM range({NY}) y, range({NX}) x), k AS (SELECT unnest([0, -1, 1, 0, 0]) AS dy, unnest([0, 0, 0, -1, 1]) AS dx, unnest([4, 1, 1, 1, 1]) / 8.0::DOUBLE AS w),
        s1 AS (SELECT f.iy, f.ix, sum(w * coalesce(value, 0)) AS value FROM full0 f, k LEFT JOIN d ON d.iy = least(greatest(f.iy + dy, 0), {NY - 1}) AND d.ix = least(greatest(f.ix + dx, 0), {NX - 1}) GROUP BY 1, 2),
        s2 AS (SELECT f.iy, f.ix, sum(w * coalesce(value, 0)) AS value FROM full0 f, k LEFT JOIN s1 d ON d.iy = least(greatest(f.iy + dy, 0), {NY - 1}) AND d.ix = least(greatest(f.ix + dx, 0), {NX - 1}) GROUP BY 1, 2)
        SELECT iy, ix, round(value, 6) AS value FROM s2 WHERE value > 0""",
    "source_probes": " UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS n_rows, count(DISTINCT {k}) AS n_keys FROM {t}" for t, k in (("co_filings", "transactionid"), ("co_debtors", "debtorid"), ("co_secured_parties", "spid"), ("ct_filings", "id_lien_flng_nbr"))),
    "events_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_sliding": """
        SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL (k * 15) MINUTE, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total
        FROM events, (SELECT range AS k FROM range(4)) GROUP BY 1, 2""",
    "events_session": """
        WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 17 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
        s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "events_dedup": "SELECT DISTINCT event_id, user_id, event_type, value FROM events",
    "source_manifest": " UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS n_rows, {n} AS n_columns FROM {t}" for t, n in (("co_filings", 9), ("co_debtors", 10), ("co_secured_parties", 10), ("ct_filings", 15))),
}
