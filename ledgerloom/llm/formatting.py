"""Problem 7: rows that differ only in formatting, collapsed and counted.

A scan streams the code points of each Arrow column, a window at a time, through one lookup table that skips
white space and punctuation and folds letter case, into rolling polynomial hashes: one over a value in its
order and one over each of its words.  No canonical string is ever made.  Values are alike if either hash
agrees, rows if all their values are; they are then verified against one row of their bucket by a two-pointer
comparison that skips in the same way.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.components import star_components
from ledgerloom.plans.spool import Spool

#: Multipliers of the polynomial and of the final mixing: odd 64-bit numbers.
BASE = 0x9E3779B97F4A7C15
MIX = 0xBF58476D1CE4E5B9
MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """For each code point 0 if it is skipped, else the code point of its lower case."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind[0] in "ZCP" or ch.isspace() or (c < 128 and not ch.isalnum()):
            continue
        low = ch.lower()
        table[c] = ord(low) if len(low) == 1 else c
    return table


@lru_cache(maxsize=1)
def space_table() -> np.ndarray:
    """Whether a code point separates words."""
    table = np.zeros(sys.maxunicode + 1, bool)
    table[[c for c in range(sys.maxunicode + 1) if chr(c).isspace()]] = True
    return table


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


#: Code points that stream through the table at a time.
WINDOW = 1 << 16


class _Powers:
    """Powers of BASE modulo 2**64, made as far as they are asked for."""

    def __init__(self) -> None:
        self.known = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.known):
            out = np.full(max(n, 2 * len(self.known)), BASE, np.uint64)
            out[0] = 1
            self.known = np.multiply.accumulate(out, dtype=np.uint64)
        return self.known


_powers = _Powers()


def _add(total: np.ndarray, owner: np.ndarray, terms: np.ndarray) -> None:
    """``total[owner] += terms`` for owners in ascending order, modulo 2**64."""
    if len(owner):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        total[owner[first]] += np.add.reduceat(terms, first)


def column_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three hashes of each value of a string column.

    The first is a polynomial over the kept characters in their order, so white space inside a word does not
    matter; the second is the sum of the words' polynomials, so the order of the words does not matter; both are
    one for a value of one word.  The third sums the characters' own terms, the polynomial of degree 0: it
    agrees wherever either of the others does.  Null has hashes of its own.

    Characters roll by in windows; the places reached in the open value and word are carried on from one window
    to the next, so a value may be of any length.
    """
    n = len(column)
    texts = column.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    raw = memoryview(texts.buffers()[2])[offsets[0] : offsets[-1]] if n and texts.buffers()[2] is not None else b""
    data, offsets = np.frombuffer(raw, np.uint8), offsets - offsets[0]
    table, spaces = fold_table(), space_table()
    ordered, by_word, by_letter = (np.zeros(n, np.uint64) for _ in range(3))
    length = np.zeros(n, np.int64)
    # What is carried over: the open value, how many characters it and its open word have kept, that word's hash,
    # and whether white space came last.
    value, kept_in_value, kept_in_word, open_word, after_gap = -1, 0, 0, np.uint64(0), False
    at = 0
    while at < len(data):
        end = min(at + WINDOW, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        points = np.frombuffer(bytes(data[at:end]).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        leads = np.flatnonzero((data[at:end] & 0xC0) != 0x80)
        owner = np.searchsorted(offsets, leads + at, side="right") - 1
        terms = table[points].astype(np.uint64)
        keep = (terms != 0).astype(np.int64)
        before = np.cumsum(keep) - keep
        # Places in the value: kept characters since it began, here or in an earlier window.
        opens = np.concatenate([[owner[0] != value], owner[1:] != owner[:-1]])
        begins = np.maximum.accumulate(np.where(opens, np.arange(len(owner)), 0))
        place = before - before[begins] + np.where(owner == value, kept_in_value, 0) * (begins == 0)
        gap = spaces[points]
        breaks = opens | np.concatenate([[after_gap], gap[:-1]])
        word_begins = np.maximum.accumulate(np.where(breaks, np.arange(len(owner)), 0))
        carried = (word_begins == 0) & ~breaks[0]
        in_word = before - before[word_begins] + np.where(carried, kept_in_word, 0)
        powers = _powers.upto(int(place.max(initial=0)) + 2)
        _add(ordered, owner, terms * powers[place])
        _add(by_letter, owner, np.where(keep == 1, _mixed(terms * np.uint64(BASE)), np.uint64(0)))
        heads = np.flatnonzero(opens | (np.arange(len(owner)) == 0))
        length[owner[heads]] += np.add.reduceat(keep, heads)
        # Words end where the next one begins; the last one of the window stays open.
        starts = np.flatnonzero(breaks | (np.arange(len(owner)) == 0))
        hashes = np.add.reduceat(terms * powers[in_word], starts)
        if carried[0]:
            hashes[:1] += open_word
        elif value >= 0 and open_word:
            by_word[value : value + 1] += _mixed(np.array([open_word], np.uint64))
        closed = hashes[:-1]
        _add(by_word, owner[starts[:-1]], np.where(closed != 0, _mixed(closed), np.uint64(0)))
        value, open_word, after_gap = int(owner[-1]), hashes[-1], bool(gap[-1])
        kept_in_value, kept_in_word = int(place[-1] + keep[-1]), int(in_word[-1] + keep[-1])
        at = end
    if value >= 0 and open_word:
        by_word[value : value + 1] += _mixed(np.array([open_word], np.uint64))
    ordered = np.where(length > 0, _mixed(ordered), np.uint64(0))
    if column.null_count:
        gone = column.is_null().to_numpy(zero_copy_only=False)
        for out in (ordered, by_word, by_letter):
            out[gone] = np.uint64(MIX ^ BASE)
    return ordered, by_word, by_letter


def letter_hash(columns: list[pa.Array], n: int) -> np.ndarray:
    """One number of each row, the same for rows that could agree: its columns' letter hashes by position."""
    total = np.full(n, 1, np.uint64)
    for i, column in enumerate(columns):
        total = total * np.uint64(BASE) + _mixed(column_hashes(column)[2] * np.uint64((2 * i + 1) * MIX & MASK) + np.uint64(i))
    return total


def same_in_order(a: str, b: str) -> bool:
    """Whether two texts agree, compared by two pointers that pass over skipped characters."""
    table, i, j = fold_table(), 0, 0
    while True:
        while i < len(a) and not table[ord(a[i])]:
            i += 1
        while j < len(b) and not table[ord(b[j])]:
            j += 1
        if i == len(a) or j == len(b):
            return i == len(a) and j == len(b)
        if table[ord(a[i])] != table[ord(b[j])]:
            return False
        i, j = i + 1, j + 1


def same_words(a: str, b: str) -> bool:
    """Whether two texts have the same words in any order, each compared by two pointers."""
    left = [w for w in a.split() if not same_in_order(w, "")]
    right = [w for w in b.split() if not same_in_order(w, "")]
    if len(left) != len(right):
        return False
    for w in left:
        k = next((k for k, x in enumerate(right) if same_in_order(w, x)), None)
        if k is None:
            return False
        right.pop(k)
    return True


def same_field(a: str | None, b: str | None) -> bool:
    """Whether two values are one but for formatting; null equals only null."""
    if a is None or b is None:
        return a is b
    return a == b or same_in_order(a, b) or same_words(a, b)


def collapse(spark: SparkSession, df: DataFrame, columns: list[str]) -> DataFrame:
    """(``columns`` of one row, n_copies) for each record; records are rows that agree but for formatting.

    Two rows are one record if every column agrees once letter case, white space and punctuation are left
    out and the order of the words is ignored; null equals only null, and is not the empty string.  Exact
    repeats count as copies.  Columns are compared as strings; an empty table gives no rows.

    Exact repeats are added up before the shuffle.  A row that shares its letter hash with no other is done with.
    For the rest, each column's values are put into classes, two values being of one class if their ordered or
    their word-wise polynomials agree, directly or through others; rows whose classes agree in every column are a
    bucket.  So rows that are anagrams of one another part at once, and one round is enough unless 64-bit hashes
    collide or values agree only through a third: what the two-pointer comparison with the bucket's longest row
    rejects is no copy of it, and goes through again with the others so rejected.
    """
    spool = Spool(spark, "collapse")
    kept = [F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)]
    names = [f"c{i}" for i in range(len(columns))]
    strings = ", ".join(f"{c} string" for c in names)

    def lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(letter_hash(texts, batch.num_rows).view(np.int64))], names=[*names, "n", "hl"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, hl, place, ho, hw) for each value of each row."""
        for batch in batches:
            row, hl = batch.column(0), batch.column(1)
            for i in range(len(names)):
                ho, hw, _ = column_hashes(batch.column(2 + i))
                place = pa.array(np.full(batch.num_rows, i, np.int32))
                yield pa.RecordBatch.from_arrays([row, hl, place, pa.array(ho.view(np.int64)), pa.array(hw.view(np.int64))], names=["row", "hl", "place", "ho", "hw"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(i).to_pylist() for i in range(len(names))]
            rep = [batch.column(len(names) + i).to_pylist() for i in range(len(names))]
            same = [all(same_field(x[k], y[k]) for x, y in zip(own, rep)) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *batch.columns[-3:], pa.array(same, pa.bool_())], names=[*names, "row", "n", "bucket", "same"])

    repeats = df.select(*kept).groupBy(*names).agg(F.count("*").alias("n"))
    every = spool.save(repeats.mapInArrow(lettered, f"{strings}, n long, hl long"))
    shared = every.groupBy("hl").agg(F.sum("n").alias("total"), F.count("*").alias("variants")).filter("total > 1")
    met = spool.save(every.join(shared, "hl").select(*names, "n", "hl", "variants", F.monotonically_increasing_id().alias("row")))
    # The number of a row stays what it is because the table is written.
    out = met.filter("variants = 1").select(*names, F.col("n").alias("n_copies"))
    live = met.filter("variants > 1").select(*names, "n", "hl", "row")
    while True:
        cell = spool.save(live.select("row", "hl", *names).mapInArrow(cells, "row long, hl long, place int, ho long, hw long"))
        kinds = cell.groupBy("hl", "place", "hw", "ho").agg(F.count("*").alias("_n"))
        turned = kinds.groupBy("hl", "place", "hw").agg(F.min("ho").alias("least"), F.max("ho").alias("most")).filter("least <> most")
        node = lambda c: F.xxhash64("hl", "place", c)
        edges = kinds.join(turned.select("hl", "place", "hw", "least"), ["hl", "place", "hw"]).select(node("ho").alias("u"), node("least").alias("v"))
        edges = spool.save(edges.distinct())
        # A value read in one way only belongs to the least of its words; components settle those that are linked through others.
        if edges.groupBy("u").count().filter("count > 1").isEmpty():
            alike = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        else:
            alike = star_components(spark, edges)
        marked = cell.select("row", "place", node("ho").alias("id")).join(alike, "id", "left")
        # The bucket is the sum of what the columns' classes hash to, each under its place.
        signs = marked.groupBy("row").agg(F.bit_xor(F.xxhash64("place", F.coalesce("component", "id"))).alias("bucket"))
        live = spool.save(live.join(signs, "row"))
        # The representative has the most words, by its length: spread-out spellings compare with all others.
        whole = F.struct(F.length(F.concat_ws("", *names)).alias("size"), *names)
        reps = spool.save(live.groupBy("bucket").agg(F.sum("n").alias("total"), F.max(whole).alias("rep")).filter("total > 1"))
        rep = reps.select("bucket", *[F.col(f"rep.{c}").alias(f"r{c}") for c in names])
        pairs = live.join(rep, "bucket").select(*names, *[f"r{c}" for c in names], "row", "n", "bucket")
        checked = spool.save(pairs.mapInArrow(verified, f"{strings}, row long, n long, bucket long, same boolean"))
        counted = checked.filter("same").groupBy("bucket").agg(F.sum("n").alias("n_copies"))
        out = out.unionByName(rep.join(counted.filter("n_copies > 1"), "bucket").select(*[F.col(f"r{c}").alias(c) for c in names], "n_copies"))
        live = checked.filter("not same").select(*names, "n", F.col("bucket").alias("hl"), "row")
        if live.isEmpty():
            break
    return out.select(*[F.col(c).alias(column) for c, column in zip(names, columns)], "n_copies")
