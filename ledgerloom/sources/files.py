"""Readers and writers: CSV as delivered, paged sources, gazetteers, exports with a manifest."""

from __future__ import annotations

import csv
import hashlib
import json
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_register_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV files, gzipped or not, with exactly these columns, all text, quotes doubled, line ends within quotes."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "enforceSchema": False}
    return spark.read.schema(schema).options(**options).csv(path)


def read_loose_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with their own header, all text; rows that do not fit are dropped."""
    return spark.read.options(header=True, inferSchema=False, mode="DROPMALFORMED", multiLine=True, quote='"', escape='"').csv(path)


def read_labels(spark: SparkSession, path: str, columns: dict[str, str], domains: dict[str, list[str]]) -> DataFrame:
    """A typed CSV whose header and values are checked; an error names the first offence."""
    head = spark.read.option("header", True).csv(path).columns
    if head != list(columns):
        raise ValueError(f"columns {head} where {list(columns)} are wanted")
    schema = T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in columns.items()))
    df = spark.read.schema(schema).options(header=True, mode="FAILFAST").csv(path)
    for column, allowed in domains.items():
        bad = df.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).select(column).take(1)
        if bad:
            raise ValueError(f"{column} holds {bad[0][0]!r}")
    return df


def read_gazetteer(spark: SparkSession, path: str, zip_column: str = "GEOID", lat: str = "INTPTLAT", lon: str = "INTPTLONG") -> DataFrame:
    """(zip, lat, lon) of a tab-separated gazetteer; header names may carry spaces."""
    raw = spark.read.options(header=True, sep="\t").csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    return raw.select(F.lpad(F.trim(zip_column), 5, "0").alias("zip"), F.trim(lat).cast("double").alias("lat"), F.trim(lon).cast("double").alias("lon"))


class PagedPartition(InputPartition):
    """One page of a paged source."""

    def __init__(self, offset: int):
        self.offset = offset


class PagedSource(DataSource):
    """A table behind a paged interface, one task for each page.

    Options: ``pages`` (how many), ``size`` (rows of a page), ``fetch``, the dotted path of a function
    (offset, size, where) -> list of tuples, and ``push``, the columns on which the source can filter.  Equality,
    comparison and null filters on these are handed over as (column, sign, value) and not applied again.  A
    page that comes short ends the table; pages beyond it are empty.
    """

    @classmethod
    def name(cls) -> str:
        """The format's name."""
        return "paged"

    def schema(self) -> str:
        """The declared columns."""
        return self.options["schema"]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        """A reader of all pages."""
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    """Reads the pages of a ``PagedSource``."""

    def __init__(self, options: dict):
        self.count, self.size, self.path = int(options["pages"]), int(options["size"]), options["fetch"]
        self.push = set(options.get("push", "").split())
        self.where: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        """Keeps what the source can do, gives back the rest."""
        signs = {"EqualTo": "=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "LessThan": "<", "LessThanOrEqual": "<=", "IsNull": "is null", "IsNotNull": "is not null"}
        for f in filters:
            sign = signs.get(type(f).__name__)
            if sign and len(f.attribute) == 1 and f.attribute[0] in self.push:
                self.where.append((f.attribute[0], sign, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """One partition for each page."""
        return [PagedPartition(i * self.size) for i in range(self.count)]

    def read(self, partition: PagedPartition) -> Iterator[tuple]:
        """The rows of a page."""
        import importlib

        module, _, function = self.path.rpartition(".")
        fetch: Callable = getattr(importlib.import_module(module), function)
        yield from fetch(partition.offset, self.size, self.where)


def land_pages(fetch: Callable[[int, int], str], folder: Path, size: int, tries: int = 4, pause: float = 1.0) -> int:
    """Pages landed as files, each by an atomic rename; pages already there are kept, so a stopped walk resumes.

    ``fetch`` gives a page as CSV text; the walk ends at the first page of fewer rows than ``size``, where a line end
    within quotes ends no row.  A fetch that fails is tried again after a pause that doubles each time.
    """
    folder.mkdir(parents=True, exist_ok=True)
    offset = 0
    while True:
        page = folder / f"{offset:09d}.csv"
        if not page.exists():
            part = page.with_suffix(".part")
            part.write_text(_fetched(fetch, offset, size, tries, pause))
            part.rename(page)
        with page.open(newline="") as rows:
            short = sum(1 for _ in csv.reader(rows)) < size
        if short:
            return offset // size + 1
        offset += size


def _fetched(fetch: Callable[[int, int], str], offset: int, size: int, tries: int, pause: float) -> str:
    for k in range(tries):
        try:
            return fetch(offset, size)
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(pause * 2**k)
    raise ValueError("no try was allowed")


def write_csv_once(df: DataFrame, path: str) -> None:
    """One CSV with a header, in order of all columns; a path that exists is an error, never overwritten."""
    df.orderBy(*[F.col(f"`{c}`") for c in df.columns]).coalesce(1).write.mode("error").option("header", True).csv(path)


def export_ordered(df: DataFrame, path: str) -> dict:
    """Parquet in zstd, rows in order of all columns, and its manifest: rows and a digest of their contents.

    The digest adds the rows' hashes, so it depends on neither order nor files.
    """
    ordered = df.orderBy(*[F.col(f"`{c}`") for c in df.columns])
    ordered.write.mode("error").option("compression", "zstd").parquet(path)
    return manifest(df)


def manifest(df: DataFrame) -> dict:
    """Rows, columns and an order-free digest of a table."""
    row = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    found = df.agg(F.count("*").alias("n"), F.sum(F.pmod(row, F.lit(1 << 40))).alias("s"), F.bit_xor(row).alias("x")).first()
    text = json.dumps([found["n"], found["s"], found["x"], df.columns])
    return {"rows": found["n"], "columns": df.columns, "digest": hashlib.sha256(text.encode()).hexdigest()}


def view_document(df: DataFrame, name: str, most: int = 1000) -> str:
    """A small view as a JSON document with its columns and rows; more than ``most`` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{name} has more than {most} rows")
    return json.dumps({"name": name, "cols": df.columns, "rows": [list(r) for r in rows]}, separators=(",", ":"), default=str)
