"""The query on keys that hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators.hotkeys import key_middle
from ledgerloom.sources.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, distinct files and middle file of every lender name as written."""
    rows = table(spark, folder, "co_secured_parties").select("organizationname", "fileid")
    return key_middle(spark, rows, "organizationname", "fileid").withColumnsRenamed(
        {"n_values": "n_files", "middle": "mid_fileid"}
    )


QUERIES = {"p5_found": p5_found}

ORACLE = {
    "p5_found": """
        WITH f AS (SELECT organizationname, fileid, count(*) AS n FROM co_secured_parties
                   WHERE organizationname IS NOT NULL GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY organizationname ORDER BY fileid NULLS LAST) AS rn,
                     count(fileid) OVER (PARTITION BY organizationname) AS nf FROM f)
        SELECT organizationname, CAST(sum(n) AS BIGINT) AS n_rows, CAST(max(nf) AS BIGINT) AS n_files,
               max(CASE WHEN rn = (nf + 1) // 2 THEN fileid END) AS mid_fileid
        FROM r GROUP BY organizationname"""
}
