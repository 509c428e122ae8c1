"""Problem 6: address records that mean the same place.

Addresses are read into parts, spellings that read alike are one case, and cases become candidates by MinHash
banding over shingles: the tokens and the q-grams of the street's name, each under its house number, since no
other number can be the same place.  A candidate is verified by affine-gap alignment of its tokens, whose
substitution costs look words up in abbreviation dictionaries: an abbreviation costs next to nothing, a typing
error little, and another number, street type or side too much.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.components import star_components
from ledgerloom.llm.spelling import distance, plain
from ledgerloom.plans.spool import Spool


def _table(text: str) -> dict[str, str]:
    """Word -> canonical word, from lines 'CANONICAL: variants'."""
    out: dict[str, str] = {}
    for line in text.strip().splitlines():
        head, _, rest = line.partition(":")
        for w in (head.strip(), *rest.split()):
            out[w] = head.strip()
    return out


# Abbreviations of postal addresses.
TYPES = _table("""
    ST: STREET STR
    AVE: AVENUE AV AVEN AVN
    BLVD: BOULEVARD BLV BOUL
    RD: ROAD
    DR: DRIVE DRV
    LN: LANE
    CT: COURT CRT
    PL: PLACE
    TER: TERRACE TERR
    TRL: TRAIL TR
    PKWY: PARKWAY PKY PWY PARKWY
    CIR: CIRCLE CRCL CIRC
    WAY: WY
    SQ: SQUARE
    LOOP: LP
    PLZ: PLAZA
    ALY: ALLEY
    XING: CROSSING
    RUN:
    PATH:
    RDG: RIDGE
""")
SIDES = _table("""
    N: NORTH NO
    S: SOUTH SO
    E: EAST
    W: WEST
    NE: NORTHEAST
    NW: NORTHWEST
    SE: SOUTHEAST
    SW: SOUTHWEST
""")
UNITS = _table("""
    U: UNIT SUITE STE APT APARTMENT # RM ROOM BLDG BLD BUILDING FLOOR FLR LOT SPC SPACE TRLR TRAILER
""")
TOWNS = _table("""
    HEIGHTS: HTS HGTS
    JUNCTION: JCT JCTN
    FALLS: FLS
    SPRINGS: SPGS SPRGS SPG SPR
    MOUNT: MT
    FORT: FT
    SAINT: ST
    NORTH: N
    SOUTH: S
    EAST: E
    WEST: W
    VILLAGE: VLG
    CENTER: CTR
    CITY: CTY
""")
# Abbreviations within the names of streets.
NAMES = _table("""
    MOUNT: MT
    MOUNTAIN: MTN MNTN
    FORT: FT
    SAINT: ST
    VALLEY: VLY
    CREEK: CRK CK
    LAKE: LK
    LAKES: LKS
    RIVER: RIV RVR
    HILL: HL
    HILLS: HLS
    HEIGHTS: HTS HGTS
    SPRING: SPG
    SPRINGS: SPGS SPRGS
    MEADOW: MDW
    MEADOWS: MDWS
    CANYON: CYN CANYN
    VIEW: VW
    VILLAGE: VLG VILL
    CENTER: CTR CENTRE CNTR
    JUNCTION: JCT JCTN
    INDUSTRIAL: IND INDL INDUS
    MEMORIAL: MEM MEML
    RANCH: RNCH
    GARDEN: GDN
    GARDENS: GDNS
    ORCHARD: ORCH
    POINT: PT
    PARK: PK PRK
""")
NUMBERS = {w: str(i) for i, w in enumerate("ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN TWELVE".split(), 1)}
ORDINALS = {
    w: str(i)
    for i, w in enumerate(
        "FIRST SECOND THIRD FOURTH FIFTH SIXTH SEVENTH EIGHTH NINTH TENTH ELEVENTH TWELFTH THIRTEENTH FOURTEENTH FIFTEENTH "
        "SIXTEENTH SEVENTEENTH EIGHTEENTH NINETEENTH TWENTIETH".split(),
        1,
    )
}
PLACEHOLDERS = {"", "NONE", "UNKNOWN", "NA", "N A", "SEE ATTACHED", "VARIOUS", "XX", "ADDRESS UNKNOWN", "NULL", "SAME", "TBD",
                "NO ADDRESS", "NOT PROVIDED", "NOT AVAILABLE", "NONE GIVEN", "GENERAL DELIVERY"}
CARE_OF = {"ATTN", "ATTENTION", "ACCOUNTS", "PAYABLE", "OFFICE", "MGR", "MANAGER", "DEPT", "DEPARTMENT", "C/O"}
COUNTY = re.compile(r"\b(?:(?:COUNTY|CNTY|CTY|CO) (?:ROAD|RD)|CR) (\d+)\b")
HIGHWAY = re.compile(r"\b(?:(?:(?:STATE|ST|US|U S) )?(?:HIGHWAY|HWY|ROUTE|RTE)|SH|SR) (\d+)\b")
BOX = re.compile(r"\b(?:BOX|POB|DRAWER) (?:# )?(?:NO )?(\d+)\b")
ORDINAL = re.compile(r"(\d+)(?:ST|ND|RD|TH)")
#: A house number with its letter or its grid: 123, 123A, N6W23001.
HOUSE = re.compile(r"\d+[A-Z]?|[NSEW]\d+[NSEW]\d+")


class Place(NamedTuple):
    """An address in parts; a part that is not given is empty."""

    number: str
    side: str
    name: str
    kind: str
    unit: str
    city: str
    zip: str


def zip5(text: str | None) -> str:
    """The five digits of a ZIP code, a leading zero restored; empty if it can't be one."""
    digits = re.sub(r"\D", "", text or "")
    if len(digits) in (4, 8):
        digits = "0" + digits
    return digits[:5] if len(digits) in (5, 9) and digits.strip("0") else ""


def town(text: str | None) -> str:
    """A town's name in one word, its abbreviations written out."""
    words = plain(text or "")
    joined = " ".join(words)
    if joined in PLACEHOLDERS:
        return ""
    return "".join(TOWNS.get(w, w) for w in words)


def read_address(street: str | None, city: str | None, code: str | None) -> Place | None:
    """The parts of an address; None for placeholders, for boxes without number, and where nothing but a number or only a street is given.

    A street without house number is a place of its own if a town or ZIP is given.
    """
    words = plain((street or "").upper().replace("C/O", " ATTN "))
    if " ".join(words) in PLACEHOLDERS:
        return None
    where = (town(city), zip5(code))
    text = " ".join(words)
    if box := BOX.search(text):
        return Place(box[1].lstrip("0") or "0", "", "#BOX", "", "", *where)
    if "BOX" in words or "POB" in words:
        return None
    text = " ".join(w for w in words if w not in CARE_OF)
    name = ""
    for pattern, mark in ((COUNTY, "#CR"), (HIGHWAY, "#HWY")):
        if found := pattern.search(text):
            name = mark + found[1]
            text = f"{text[: found.start()]} {text[found.end() :]}"
            break
    words, rest, unit, i = text.split(), [], "", 0
    while i < len(words):
        if words[i] in UNITS and (i or words[i] != "LOT"):
            j = i + 1
            while j < len(words) and (words[j] == "#" or words[j] in UNITS):
                j += 1
            if j < len(words) and (words[j].isdigit() or len(words[j]) <= 2 or any(c.isdigit() for c in words[j])) and words[j] not in TYPES:
                unit = unit or words[j].lstrip("0")
                j += 1
            i = j
        else:
            rest.append(words[i])
            i += 1
    number = ""
    if rest and HOUSE.fullmatch(rest[0]):
        number, rest = rest[0], rest[1:]
    elif rest and HOUSE.fullmatch(rest[-1]):
        number, rest = rest[-1], rest[:-1]
    elif len(rest) > 2 and rest[0] in NUMBERS:
        number, rest = NUMBERS[rest[0]], rest[1:]
    elif not any(where):
        return None
    side = kind = ""
    if name:
        side = next((SIDES[w] for w in rest if w in SIDES), "")
    else:
        if len(rest) > 1 and rest[0] in SIDES:
            side, rest = SIDES[rest[0]], rest[1:]
        if len(rest) > 1 and rest[-1] in SIDES:
            side, rest = side or SIDES[rest[-1]], rest[:-1]
        if len(rest) > 1 and rest[-1] in TYPES:
            kind, rest = TYPES[rest[-1]], rest[:-1]
        if len(rest) > 1 and rest[-1] in SIDES:
            side, rest = side or SIDES[rest[-1]], rest[:-1]
        name, joined = " ".join(rest), "".join(rest)
        if ordinal := ORDINAL.fullmatch(joined):
            name = "#" + ordinal[1]
        elif joined in ORDINALS:
            name = "#" + ORDINALS[joined]
        elif joined.isdigit():
            name = "#" + joined
    if not name:
        return None
    return Place(number and (number.lstrip("0") or "0"), side, name, kind, unit, *where)


@lru_cache(maxsize=100_000)
def written_out(name: str) -> str:
    """A street's name in one word, its abbreviations written out."""
    return name if name[0] == "#" else "".join(NAMES.get(w, w) for w in name.split())


#: Costs of an alignment; a candidate is the same place below LIMIT.  NEVER forbids a step.
NEVER, LIMIT = 100.0, 3.0
OPEN = {"side": 0.6, "kind": 0.6, "unit": 0.4, "town": 0.8}
EXTEND, EDIT, ABBREVIATED = 0.2, 0.7, 0.05


def _tokens(p: Place) -> list[tuple[str, str | tuple[str, str]]]:
    out: list = [("number", p.number)] if p.number else []
    out += [("side", p.side)] if p.side else []
    out.append(("name", p.name))
    out += [("kind", p.kind)] if p.kind else []
    out += [("unit", p.unit)] if p.unit else []
    out += [("town", (p.city, p.zip))] if p.city or p.zip else []
    return out


def _town_cost(a: tuple[str, str], b: tuple[str, str]) -> float:
    if a[0] and b[0]:
        d = distance(a[0], b[0], 3)
        return 0.3 * d if d <= 2 or (d == 3 and a[1] == b[1] and a[1]) else NEVER
    return (0.2 if a[1] == b[1] else NEVER) if a[1] and b[1] else 0.8


def _substitution(x: tuple, y: tuple) -> float:
    if x[0] != y[0]:
        return NEVER
    if x[0] == "town":
        return _town_cost(x[1], y[1])
    if x[1] == y[1]:
        return 0.0
    if x[0] == "name" and x[1][0] != "#" and y[1][0] != "#":
        # Two names that differ as typed, and not once written out, differ by abbreviations or spaces alone.
        a, b = written_out(x[1]), written_out(y[1])
        long = max(len(a), len(b))
        most = 1 if long <= 4 else 2 if long <= 9 else 3
        d = distance(a, b, most)
        return (EDIT * d or ABBREVIATED) if d <= most else NEVER
    return NEVER


def alignment_cost(a: Place, b: Place) -> float:
    """The least cost of aligning the tokens of two addresses, gaps being charged to open and to extend."""
    x, y = _tokens(a), _tokens(b)
    # A part may be missing from one address, not be left out of both.
    gap = [[NEVER if t[0] in dict(other) else OPEN.get(t[0], NEVER) for t in own] for own, other in ((x, y), (y, x))]
    inf = NEVER * 10
    m = [[inf] * (len(y) + 1) for _ in range(len(x) + 1)]
    left, up = [r[:] for r in m], [r[:] for r in m]
    m[0][0] = 0.0
    for i in range(len(x) + 1):
        for j in range(len(y) + 1):
            if i and j:
                m[i][j] = min(m[i - 1][j - 1], left[i - 1][j - 1], up[i - 1][j - 1]) + _substitution(x[i - 1], y[j - 1])
            if i:
                g = gap[0][i - 1]
                up[i][j] = min(min(m[i - 1][j], left[i - 1][j]) + g, up[i - 1][j] + (EXTEND if g < NEVER else NEVER))
            if j:
                g = gap[1][j - 1]
                left[i][j] = min(min(m[i][j - 1], up[i][j - 1]) + g, left[i][j - 1] + (EXTEND if g < NEVER else NEVER))
    return min(m[-1][-1], left[-1][-1], up[-1][-1])


#: Bands of the MinHash signature and the rows of a band.  Shingles hold the house number and buckets the town
#: or ZIP, so one row is selective enough: a pair that shares a fifth of its shingles is missed once in 16 times.
BANDS, ROWS = 12, 1


def shingles(p: Place) -> list[str]:
    """Token and q-gram shingles of an address, each under its number."""
    if p.name[0] == "#":
        return [f"{p.number}|{p.name}"]
    name = written_out(p.name)
    framed = f"^{name}$"
    return [f"{p.number}|{name}", *{f"{p.number}|{framed[i : i + 2]}" for i in range(len(framed) - 1)}]


def bands(places: list[Place]) -> np.ndarray:
    """The band hashes of each address, one row each."""
    if not places:
        return np.zeros((0, BANDS), np.int64)
    own = [shingles(p) for p in places]
    h = np.array([xxhash.xxh64_intdigest(s) for part in own for s in part], np.uint64)
    starts = np.cumsum([0] + [len(part) for part in own[:-1]])
    rng = np.random.default_rng(7)
    salts = rng.integers(1, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)
    out = np.zeros((len(places), BANDS), np.uint64)
    for k, salt in enumerate(salts):
        x = (h ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * salt
        least = np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)
        out[:, k // ROWS] = (out[:, k // ROWS] ^ least) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k // ROWS)
    return out.view(np.int64)


PLACE = "number string, side string, name string, kind string, unit string, city string, zip string"
_PARTS = [p.split()[0] for p in PLACE.split(", ")]


def read_places(df: DataFrame, key: str, street: str, city: str, code: str) -> DataFrame:
    """(key, parts) of each row whose address is a case."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            rows = [(k, p) for k, s, c, z in zip(*columns) if (p := read_address(s, c, z)) is not None]
            arrays = [pa.array([r[0] for r in rows], pa.string())]
            arrays += [pa.array([r[1][i] for r in rows], pa.string()) for i in range(len(_PARTS))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", *_PARTS])

    return df.select(F.col(key).cast("string"), street, city, code).mapInArrow(parse, f"key string, {PLACE}")


#: A ZIP's town is the one that at least this many of its addresses give, and this share of those that give any.
TOWN_VOTES, TOWN_SHARE = 3, 0.6


def with_towns(places: DataFrame) -> DataFrame:
    """The places, a town that is not given filled in by the town that most addresses of the ZIP give.

    ZIP codes are five digits, so the table of their towns has at most a hundred thousand rows.
    """
    given = places.filter("zip <> '' and city <> ''").groupBy("zip", "city").agg(F.count("*").alias("n"))
    most = given.groupBy("zip").agg(F.max(F.struct("n", "city")).alias("top"), F.sum("n").alias("all"))
    towns = most.filter((F.col("top.n") >= TOWN_VOTES) & (F.col("top.n") >= TOWN_SHARE * F.col("all"))).select("zip", F.col("top.city").alias("usual"))
    filled = F.when((F.col("city") == "") & F.col("usual").isNotNull(), F.col("usual")).otherwise(F.col("city"))
    return places.join(F.broadcast(towns), "zip", "left").withColumn("city", filled).drop("usual").select(*places.columns)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(bucket, id, text) of rows sorted by bucket, regrouped such that no bucket is cut."""
    held: list[pa.RecordBatch] = []

    def out() -> tuple[np.ndarray, np.ndarray, list[str]]:
        rows = pa.Table.from_batches(held)
        return rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).to_pylist()

    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column(0).to_numpy()
        if held and held[-1].column(0)[-1].as_py() == bucket[-1]:
            held.append(batch)
            continue
        cut = int(np.searchsorted(bucket, bucket[-1]))
        if cut:
            held.append(batch.slice(0, cut))
        if held:
            yield out()
        held = [batch.slice(cut)]
    if held:
        yield out()


#: Pairs looked at in one step.
STEP = 1 << 18


def _runs(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of each two places with one key, about STEP at a time."""
    order = np.argsort(key, kind="stable")
    n = len(order)
    ends = np.append(np.flatnonzero(key[order][1:] != key[order][:-1]) + 1, n)
    mates = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n) - 1
    total = np.cumsum(mates)
    at = 0
    while at < n and total[-1] > (done := total[at - 1] if at else 0):
        to = max(at + 1, int(np.searchsorted(total, done + STEP)))
        own = mates[at:to]
        left = np.repeat(np.arange(at, min(to, n)), own)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(own) - own, own)
        yield order[left], order[right]
        at = to


@lru_cache(maxsize=4096)
def _gap_cost(given_a: tuple[bool, ...], given_b: tuple[bool, ...]) -> float:
    """The cost of aligning two addresses that agree in all that both give."""
    parts = ("1", "N", "X", "ST", "1", "T")
    a, b = (Place(*(p if g else "" for p, g in zip(parts, given)), "") for given in (given_a, given_b))
    return alignment_cost(a, b)


_town_price = lru_cache(maxsize=100_000)(_town_cost)


def _is_same(a: Place, b: Place, given_a: tuple[bool, ...], given_b: tuple[bool, ...]) -> bool:
    """Whether ``alignment_cost`` is below LIMIT, for addresses with no other number, side, type and unit.

    Parts that both give are always aligned with one another, so costs of gaps and of substitutions add up.
    """
    cost = _gap_cost(given_a, given_b)
    if a.name != b.name:
        cost += _substitution(("name", a.name), ("name", b.name))
    if given_a[5] and given_b[5] and (a.city != b.city or not a.city):
        cost += _town_price((a.city, a.zip), (b.city, b.zip))
    # Where rounding could tell, the alignment itself does.
    return cost < LIMIT if abs(cost - LIMIT) > 1e-6 else alignment_cost(a, b) < LIMIT


def _same_within(bucket: np.ndarray, ids: np.ndarray, texts: list[str], banded: bool) -> tuple[list[int], list[int]]:
    """Ids a < b of the addresses of one bucket that are one place; ``banded``: of those that share a band, and a town or ZIP unless one lacks both."""
    places = [Place(*t.split("|")) for t in texts]
    n = len(places)

    def codes(values: Iterator[str]) -> np.ndarray:
        known = {"": 0}
        return np.fromiter((known.setdefault(v, len(known)) for v in values), np.int64, n)

    number, name = codes(p.number for p in places), codes(p.name for p in places)
    optional = [codes(p[i] for p in places) for i in (1, 3, 4)]
    where = [codes(p.zip for p in places), codes(p.city[:3] for p in places), codes(p.city[-5:] for p in places)]
    lost = (where[0] == 0) & (where[1] == 0)
    marked = np.fromiter((p.name[0] == "#" for p in places), bool, n)
    flat = [written_out(p.name) for p in places]
    letters = np.frombuffer("".join(flat).encode("utf-32-le"), np.uint32) & 31
    bags = np.bincount(np.repeat(np.arange(n), [len(f) for f in flat]) * 32 + letters, minlength=n * 32).reshape(n, 32).astype(np.int16)
    given = [(p.number != "", p.side != "", True, p.kind != "", p.unit != "", bool(p.city or p.zip)) for p in places]
    signs = bands(places) if banded else np.zeros((n, 1), np.int64)
    a_out: list[int] = []
    b_out: list[int] = []
    for k in range(signs.shape[1]):
        # Buckets are mixed in, and compared below.
        for i, j in _runs(signs[:, k] ^ (bucket * np.int64(0x5851F42D4C957F2D))):
            keep = (bucket[i] == bucket[j]) & (signs[i, k] == signs[j, k]) & (number[i] == number[j]) & (ids[i] != ids[j])
            if banded:
                keep &= lost[i] | lost[j] | np.logical_or.reduce([(w[i] == w[j]) & (w[i] > 0) for w in where])
            for c in optional:
                keep &= (c[i] == c[j]) | (c[i] == 0) | (c[j] == 0)
            keep &= (name[i] == name[j]) | ~(marked[i] | marked[j])
            i, j = i[keep], j[keep]
            if k:
                # A pair that met in an earlier band is done with.
                keep = ~(signs[i, :k] == signs[j, :k]).any(axis=1)
                i, j = i[keep], j[keep]
            # An edit takes one letter away and adds one at most; names differ by three edits at most.
            apart = bags[i] - bags[j]
            keep = np.maximum(np.maximum(apart, 0).sum(axis=1), np.maximum(-apart, 0).sum(axis=1)) <= 3
            for x, y in zip(i[keep].tolist(), j[keep].tolist()):
                if ids[x] > ids[y]:
                    x, y = y, x
                if _is_same(places[x], places[y], given[x], given[y]):
                    a_out.append(int(ids[x]))
                    b_out.append(int(ids[y]))
    return a_out, b_out


def _verified_within(bucketed: DataFrame, banded: bool) -> DataFrame:
    """(a, b): of (bucket, id, text) the pairs of one bucket that are one place."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches):
            a, b = _same_within(*rows, banded)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return bucketed.select("bucket", "id", "text").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(check, "a long, b long")


#: A number that this share of the cases has, and at least so many of them, is spread over towns, ZIPs and bands.
HOT_SHARE, HOT_CASES = 1 / 2000, 5000


def _links(cases: DataFrame) -> DataFrame:
    """(a, b): ids of cases (id, text) that share a band, and a town or ZIP, or lack both on one side, and whose alignment costs less than LIMIT.

    No other number is the same place, so a case is sent once, to the others of its number; its bands are made there.
    """
    numbered = cases.withColumn("number", F.substring_index("text", "|", 1))
    counts = numbered.groupBy("number").count()
    least = max(HOT_CASES, HOT_SHARE * cases.count())
    hot = [r["number"] for r in counts.filter(F.col("count") >= least).select("number").collect()]
    usual = numbered.filter(~F.col("number").isin(hot)).select(F.xxhash64("number").alias("bucket"), "id", "text")
    if not hot:
        return _verified_within(usual, True)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [Place(*t.split("|")) for t in batch.column(1).to_pylist()]
            keys = [[w for w in ("Z" + p.zip, "B" + p.city[:3], "E" + p.city[-5:]) if len(w) > 1] for p in places]
            for own, p, row in zip(keys, places, bands(places).tolist()):
                # An address without town and ZIP has a number, and meets all of its bands.
                own += [f"{k} {h}" for k, h in enumerate(row)] if p.number else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.string()))], names=["id", "text", "keys"])

    split = numbered.filter(F.col("number").isin(hot)).select("id", "text").mapInArrow(spread, "id long, text string, keys array<string>")
    split = split.select("id", "text", F.explode("keys").alias("key")).select(F.xxhash64(F.substring_index("text", "|", 1), "key").alias("bucket"), "id", "text")
    return _verified_within(usual, True).union(_verified_within(split, True)).distinct()


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(rec_a, rec_b) of different records of one case, or of two linked cases; smaller key first, each once.

    ``members`` is (key, id), ``links`` (a, b) between ids, each once.
    """
    own = members.distinct()
    other = own.select(F.col("key").alias("other"), "id")
    within = own.join(other, "id").filter("key < other").select(F.col("key").alias("rec_a"), F.col("other").alias("rec_b"))
    first = own.select(F.col("key").alias("x"), F.col("id").alias("a"))
    second = own.select(F.col("key").alias("y"), F.col("id").alias("b"))
    across = links.join(first, "a").join(second, "b").filter("x <> y")
    across = across.select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b"))
    return within.union(across).distinct()


def place_links(spark: SparkSession, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, id), (a, b)): the cases that each record's address reads as, and the pairs of cases that are one place, each once.

    ``records`` is (key, street, city, code).  A unit, side, street type, town or ZIP given by one of the two
    only, misspelt words and abbreviations make no other place; another number, street, street type, side or
    town does.  Nulls, placeholders and boxes without a number make no case, nor does a street without number,
    town and ZIP.  Copies of an address are one case and are compared once.

    A missing town is that of the ZIP, as most addresses of the ZIP give it.  Verified candidates are closed over
    groups by large-star small-star, and each pair of a group's cases is verified in turn, so that a record
    without a side joins neither of two sides to the other.
    """
    spool = Spool(spark, "places")
    parsed = spool.save(read_places(records, "key", "street", "city", "code"))
    read = spool.save(with_towns(parsed).select("key", F.xxhash64(*_PARTS).alias("id"), F.concat_ws("|", *_PARTS).alias("text")))
    spool.drop(parsed)
    cases = spool.save(read.select("id", "text").distinct())
    members = spool.save(read.select("key", "id").distinct())
    spool.drop(read)
    links = spool.save(_links(cases))
    groups = star_components(spark, links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # Links are pairs of a group too, and are found again.
    closed = spool.save(_verified_within(groups.join(cases, "id").withColumnRenamed("component", "bucket"), False))
    spool.drop(cases, links)
    return members, closed


def same_place(spark: SparkSession, records: DataFrame) -> DataFrame:
    """(rec_a, rec_b) for each pair of different keys whose addresses mean the same place, as ``place_links`` finds them.

    A key with several addresses is paired by any of them; an empty table gives no rows.
    """
    return record_pairs(*place_links(spark, records))
