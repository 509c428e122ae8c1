"""Small documents beside the tables: configuration without repeated keys, digests of files, grids as rows."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read_config(path: str | Path) -> dict:
    """A JSON document; a key that stands twice in one object is an error."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        out: dict = {}
        for k, v in pairs:
            if k in out:
                raise ValueError(f"{path} holds {k!r} twice")
            out[k] = v
        return out

    return json.loads(Path(path).read_text(), object_pairs_hook=once)


def write_sums(folder: str | Path) -> Path:
    """SHA256SUMS of every file below a folder, in order of their paths."""
    folder = Path(folder)
    target = folder / "SHA256SUMS"
    names = sorted(p.relative_to(folder).as_posix() for p in folder.rglob("*") if p.is_file() and p != target)
    target.write_text("".join(f"{hashlib.sha256((folder / n).read_bytes()).hexdigest()}  {n}\n" for n in names))
    return target


def verify_sums(folder: str | Path) -> list[str]:
    """The files that are missing, changed or not listed."""
    folder = Path(folder)
    listed = dict(reversed(line.split("  ", 1)) for line in (folder / "SHA256SUMS").read_text().splitlines())
    found = {p.relative_to(folder).as_posix() for p in folder.rglob("*") if p.is_file() and p.name != "SHA256SUMS"}
    wrong = [n for n, d in listed.items() if n in found and hashlib.sha256((folder / n).read_bytes()).hexdigest() != d]
    return sorted({*wrong, *(listed.keys() ^ found)})


def read_raster(spark: SparkSession, path: str | Path) -> DataFrame:
    """(region, iy, ix, value) of a JSON document {region: [[value, ...], ...]}."""
    rows = [(r, iy, ix, float(v)) for r, grid in sorted(read_config(path).items()) for iy, line in enumerate(grid) for ix, v in enumerate(line)]
    return spark.createDataFrame(rows, "region string, iy int, ix int, value double")
