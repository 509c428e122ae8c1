"""Similarity of strings: Jaro-Winkler in its two definitions, a bound that needs no Python, edit ratio, tokens.

Spark has no Jaro-Winkler, so it runs in Arrow batches, many pairs at once with the letters of a string as bits of a word, over distinct pairs and only those whose bound
reaches the bar; see ``ledgerloom.plans.joins.udf_on_distinct``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro(a: str, b: str) -> float:
    """Jaro similarity of two strings."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str, always: bool = False) -> float:
    """Jaro-Winkler with a prefix of up to four; the prefix counts above 0.7 only, or always."""
    j = jaro(a, b)
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return j + 0.1 * same * (1 - j) if always or j > 0.7 else j


#: Longest strings whose letters are bits of a word; pairs compared at once; cells of a table of places at most.
WIDE, TALL, CELLS = 64, 16_384, 4 << 20
_ONE = np.uint64(1)


class Letters:
    """Strings as rows: letters by number, for each letter a word of its places, and the bag of letters in two words.

    Longer strings than ``WIDE`` have no row of their own (``long``), and an alphabet too large leaves ``places`` None.
    """

    def __init__(self, texts: list[str]):
        self.long = np.array([len(t) > WIDE for t in texts], bool)
        texts = ["" if far else t for t, far in zip(texts, self.long)]
        self.n = np.array([len(t) for t in texts], np.uint8)
        rows, size = len(texts), int(self.n.max(initial=0))
        inside = np.arange(WIDE + 1) < self.n[:, None]
        # Letter 0 is none.
        letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        number = np.zeros(int(letters.max(initial=0)) + 1, np.int64)
        number[letters] = 1
        self.kinds = int(number.sum()) + 1
        at = np.zeros((rows, WIDE + 1), np.int64)
        at[inside] = np.cumsum(number)[letters]
        self.at, self.places, self.bags = at.ravel(), None, None
        if rows * self.kinds <= CELLS:
            places = np.zeros((rows, self.kinds), np.uint64)
            for p in range(size):
                own = np.flatnonzero(self.n > p)
                places[own, at[own, p]] |= _ONE << np.uint64(p)
            self.places = places.ravel()

    def _count(self) -> None:
        """Bits for the 128 most frequent of (letter, how many before it); what has none is counted."""
        at = self.at.reshape(-1, WIDE + 1)[:, : max(1, int(self.n.max(initial=0)))]
        sort = np.sort(at.astype(np.int32), axis=1)
        step = np.arange(at.shape[1])
        fresh = np.ones(sort.shape, bool)
        fresh[:, 1:] = sort[:, 1:] != sort[:, :-1]
        item = sort * (WIDE + 1) + step - np.maximum.accumulate(np.where(fresh, step, 0), axis=1)
        counts = np.bincount(item.ravel(), minlength=WIDE + 1)
        # The first items are of no letter.
        counts[: WIDE + 1] = 0
        first = np.argsort(-counts, kind="stable")[:128]
        bit = np.full(len(counts), 128)
        bit[first] = np.where(counts[first] > 0, np.arange(len(first)), 128)
        bit = bit[item]
        # The third word takes what has no bit, and is left.
        self.bags = np.zeros((3, len(at)), np.uint64)
        for p in step:
            b = bit[:, p]
            self.bags[b >> 6, np.arange(len(b))] |= _ONE << (b & 63).astype(np.uint64)
        self.spare = (self.n - np.bitwise_count(self.bags[:2]).sum(axis=0)).astype(np.uint8)
        self.spares = bool(self.spare.any())
        with np.errstate(divide="ignore"):
            self.share = np.where(self.n > 0, 1 / self.n.astype(np.float32), 0).astype(np.float32)

    def near(self, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        """Whether the common letters of rows i and j, wherever they stand, let jaro reach ``least``; shapes may broadcast."""
        if self.bags is None:
            self._count()
        common = np.bitwise_count(self.bags[0][i] & self.bags[0][j])
        common += np.bitwise_count(self.bags[1][i] & self.bags[1][j])
        if self.spares:
            common += np.minimum(self.spare[i], self.spare[j])
        out = common * (self.share[i] + self.share[j]) >= np.float32(3 * least - 1 - 1e-4)
        return out | self.long[i] | self.long[j] if self.long.any() else out

    def winkler(self, i: np.ndarray, j: np.ndarray, always: bool = False, least: float = 0.0) -> np.ndarray:
        """Jaro-Winkler of the rows i with the rows j; 0 where jaro is certain to stay below ``least``."""
        out = np.zeros(len(i))
        order = np.argsort(self.n[i], kind="stable")
        for start in range(0, len(i), TALL):
            part = order[start : start + TALL]
            out[part] = self._winkler(i[part], j[part], always, least)
        return out

    def _winkler(self, i: np.ndarray, j: np.ndarray, always: bool, least: float) -> np.ndarray:
        la, lb = self.n[i].astype(np.int64), self.n[j].astype(np.int64)
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        own, other = i * (WIDE + 1), j * self.kinds
        window = (_ONE << (reach + 1).astype(np.uint64)) - _ONE
        taken, hits = np.zeros(len(i), np.uint64), np.zeros(len(i), np.uint64)
        for p in range(int(la.max(initial=0))):
            can = self.places.take(other + self.at.take(own + p))
            can &= window
            can &= ~taken
            taken |= can & -can
            hits |= (can != 0).astype(np.uint64) << np.uint64(p)
            window <<= _ONE
            window |= reach > p
        m = np.bitwise_count(hits).astype(np.int64)
        out = np.zeros(len(i))
        with np.errstate(divide="ignore", invalid="ignore"):
            rows = np.flatnonzero((m > 0) & ((m / la + m / lb + 1) / 3 >= least - 1e-9))
        la, lb, m, own, other, hits, taken = (x[rows] for x in (la, lb, m, own, other, hits, taken))
        apart = np.zeros(len(rows), np.int64)
        for _ in range(int(m.max(initial=0))):
            x, y = hits & -hits, taken & -taken
            letter = self.at.take(own + np.bitwise_count(x - _ONE))
            apart += ((self.places.take(other + letter) & y) == 0) & (x != 0)
            hits ^= x
            taken ^= y
        jaro_of = (m / la + m / lb + (m - apart // 2) / m) / 3
        same, going = np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
        for p in range(4):
            going &= (p < np.minimum(la, lb)) & ((self.places.take(other + self.at.take(own + p)) >> np.uint64(p) & _ONE) != 0)
            same += going
        w = jaro_of + 0.1 * same * (1 - jaro_of)
        out[rows] = w if always else np.where(jaro_of > 0.7, w, jaro_of)
        return out


def jaro_winkler_batch(left: list[str | None], right: list[str | None], always: bool = False) -> list[float | None]:
    """``jaro_winkler`` of many pairs; null where either is null."""
    out: list[float | None] = [None] * len(left)
    wide = [k for k, (x, y) in enumerate(zip(left, right)) if x and y and len(x) <= WIDE and len(y) <= WIDE]
    rest = {*range(len(left))} - {*wide}
    for k in rest:
        if left[k] is not None and right[k] is not None:
            out[k] = jaro_winkler(left[k], right[k], always)
    todo = [wide[start : start + TALL] for start in range(0, len(wide), TALL)]
    while todo:
        part = todo.pop()
        rows = Letters([left[k] for k in part] + [right[k] for k in part])
        if rows.places is None:
            todo += [part[: len(part) // 2], part[len(part) // 2 :]]
            continue
        for k, v in zip(part, rows.winkler(np.arange(len(part)), np.arange(len(part), 2 * len(part)), always).tolist()):
            out[k] = v
    return out


@F.arrow_udf(T.DoubleType())
def _jw_sql(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in pairs:
        yield pa.array(jaro_winkler_batch(a.to_pylist(), b.to_pylist()), pa.float64())


@F.arrow_udf(T.DoubleType())
def _jw_always(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in pairs:
        yield pa.array(jaro_winkler_batch(a.to_pylist(), b.to_pylist(), True), pa.float64())


def jw_sql(a: Column, b: Column) -> Column:
    """Jaro-Winkler as SQL engines define it: the prefix counts where jaro is above 0.7."""
    return _jw_sql(a, b)


def jw_always(a: Column, b: Column) -> Column:
    """Jaro-Winkler with the prefix counted whatever jaro is."""
    return _jw_always(a, b)


def jw_bound(a: Column, b: Column) -> Column:
    """An upper bound of either Jaro-Winkler by lengths and common prefix, in generated code."""
    small, large = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b), F.lit(1))
    jaro_most = (2 + small / large) / 3
    same = sum((F.substring(a, 1, k) == F.substring(b, 1, k)).cast("int") * (small >= k).cast("int") for k in range(1, 5))
    return jaro_most + 0.1 * same * (1 - jaro_most)


def edit_ratio(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def head_extension(a: Column, b: Column, head: int = 8, share: float = 0.4) -> Column:
    """Whether one name begins with the other, spaces apart, the shorter having ``head`` letters and ``share`` of the longer."""
    x, y = F.replace(a, F.lit(" "), F.lit("")), F.replace(b, F.lit(" "), F.lit(""))
    short = F.when(F.length(x) <= F.length(y), x).otherwise(y)
    long = F.when(F.length(x) <= F.length(y), y).otherwise(x)
    return long.startswith(short) & (F.length(short) >= head) & (F.length(short) / F.length(long) >= share)


def coherent(a: Column, b: Column) -> Column:
    """Whether two clean names may stand in one cluster: few edits with the spaces, or a head extension without them."""
    return (a == b) | (edit_ratio(a, b) >= 0.72) | head_extension(a, b)


@F.arrow_udf(T.DoubleType())
def _token_min(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in pairs:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            u, v = (x or "").split(), (y or "").split()
            if not u or not v:
                out.append(None)
                continue
            small, large = (u, v) if len(u) <= len(v) else (v, u)
            out.append(min(max(jaro_winkler(s, t) for t in large) for s in small))
        yield pa.array(out, pa.float64())


def token_min(a: Column, b: Column) -> Column:
    """The worst of the best Jaro-Winkler partners of the shorter name's words; null if either has none."""
    return _token_min(a, b)


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two names."""
    u, v = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.size(F.array_intersect(u, v)) / F.size(F.array_union(u, v))
