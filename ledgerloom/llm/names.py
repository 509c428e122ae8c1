"""Problem 3: records that name the same person or organisation in variant spellings.

Names are read into a distinctive part and common words, with legal forms, titles and initials left out and
abbreviations and nicknames written out.  Which words are common is counted over all names.  Distinct readings
are sparse vectors of character trigrams, weighted by their rarity, under their common words.  A distributed
sparse join finds the pairs whose cosine reaches a bar; of these an edit distance drops what is another name.
The pairs are grouped by average linkage over the cosines of all pairs of two groups, merging mutual best pairs
round by round.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.addresses import record_pairs
from ledgerloom.llm.spelling import distance, plain
from ledgerloom.plans.spool import Spool

# Legal forms, titles and fillers of names.
LEGAL = frozenset(
    """LLC LC LLP LP LTD LIMITED INC INCORP INCORPORATED CORP CORPO CORPORATION CO COMPANY COMP LIABILITY LIABIL LIAB PLLC PC PA
    PLC NA DBA ET AL ETAL ETUX AKA FKA""".split()
)
TITLES = frozenset("THE MR MRS MS MISS DR PROF REV HON SR JR II III IV ESQ AND OF".split())
PLACEHOLDERS = frozenset({"", "UNKNOWN", "NA", "N A", "NONE", "SEE ATTACHED", "NULL", "VARIOUS", "SAME", "TBD", "NOT PROVIDED"})
# Abbreviations of trades and other words of firms' names.
ABBREVIATIONS = {
    short: full
    for full, shorts in {
        "AMERICAN": "AMER AMERN",
        "ASSOCIATES": "ASSOC ASSOCS",
        "BROTHERS": "BROS",
        "CARPENTRY": "CARP CARPTRY",
        "CENTRAL": "CENT CTRL",
        "CONCRETE": "CONC CONCR",
        "CONSTRUCTION": "CONST CONSTR CONSTRUCT CONSTRN CONS",
        "DEMOLITION": "DEMO DEMOL",
        "DRILLING": "DRILL DRLG",
        "EASTERN": "EASTN",
        "ELECTRIC": "ELEC ELECT",
        "ENTERPRISES": "ENT ENTPRS",
        "EQUIPMENT": "EQUIP EQPT",
        "EXCAVATING": "EXC EXCAV EXCVTG EXCVG",
        "FORESTRY": "FOREST FRSTRY",
        "HYDRAULICS": "HYD HYDR",
        "INDUSTRIES": "IND INDS",
        "INSULATION": "INSUL",
        "INTERNATIONAL": "INTL INTERNATL",
        "IRRIGATION": "IRRIG IRR",
        "LANDSCAPING": "LANDSCP LNDSCPG LANDSC LNDSCP",
        "LOGISTICS": "LOGIS LOG",
        "MACHINERY": "MCHY MACH MACHY",
        "MANUFACTURING": "MFG MANUF MANUFG",
        "NATIONAL": "NATL",
        "NORTHERN": "NORTHN NORTH",
        "PARTNERS": "PTNRS PTRS",
        "PLUMBING": "PLBG PLUMB PLMBG",
        "REFRIGERATION": "REFRIG REFR",
        "SERVICES": "SVC SVCS SERV",
        "SOUTHERN": "SO SOUTHN SOUTH",
        "SURVEYING": "SURV SURVEY SURVG",
        "TELECOM": "TELCOM TELECOMM",
        "TRANSPORTATION": "TRANS TRANSP",
        "TRUCKING": "TRUCKG TRKG TRUCK",
        "UNITED": "UTD",
        "VETERINARY": "VET",
        "WAREHOUSING": "WHSG WHSE WAREHSG",
        "WESTERN": "WESTN",
    }.items()
    for short in shorts.split()
    if short not in ("FOREST", "NORTH", "SOUTH")
}
# Short forms of given names.
NICKNAMES = {
    short: full
    for full, shorts in {
        "ALEXANDER": "ALEX",
        "ANDREW": "ANDY DREW",
        "ANTHONY": "TONY ANTH",
        "BARBARA": "BARB BARBIE",
        "BEATRICE": "BEA TRIXIE",
        "BENJAMIN": "BEN BENJ",
        "CATHERINE": "CATHY",
        "CHARLES": "CHUCK CHAS CHARLIE",
        "CHRISTOPHER": "CHRIS",
        "DANIEL": "DAN DANL DANNY",
        "DAVID": "DAVE DAVY",
        "DEBORAH": "DEBBIE DEB",
        "DONALD": "DON",
        "DOROTHY": "DOTTIE DOT DOLLY",
        "DOUGLAS": "DOUG",
        "EDWARD": "ED EDDIE EDW NED TED",
        "ELIZABETH": "BETTY BETH ELIZ LIZ LIZZIE",
        "FREDERICK": "FRED FREDK",
        "GEORGE": "GEO",
        "GERALD": "JERRY",
        "GERTRUDE": "TRUDY GERT",
        "GREGORY": "GREG",
        "HAROLD": "HAL HARRY",
        "JAMES": "JIM JAS JIMMY",
        "JENNIFER": "JENNY JEN",
        "JOHN": "JACK JNO",
        "JOSEPH": "JOE JOS",
        "KATHERINE": "KATE KATHY KATIE KATH",
        "KENNETH": "KEN KENNY",
        "LAWRENCE": "LARRY LAWR",
        "LEONARD": "LEN LENNY",
        "MARGARET": "PEGGY MAGGIE MARGT MEG",
        "MATTHEW": "MATT",
        "MICHAEL": "MIKE MICHL",
        "NICHOLAS": "NICK",
        "PATRICIA": "PATTY PAT TRICIA",
        "PHILLIP": "PHIL",
        "RAYMOND": "RAY",
        "REBECCA": "BECKY BECCA",
        "RICHARD": "DICK RICK RICHD RICH",
        "ROBERT": "BOB ROBT ROB BOBBY",
        "RONALD": "RON",
        "SAMUEL": "SAM SAML",
        "STEPHEN": "STEVE STEVEN",
        "SUSAN": "SUE SUSIE",
        "THERESA": "TESS TERRI TERESA",
        "THOMAS": "TOM THOS",
        "TIMOTHY": "TIM",
        "VINCENT": "VINCE VIN",
        "VIRGINIA": "GINNY",
        "WALTER": "WALT",
        "WILLIAM": "BILL WILL WM BILLY",
    }.items()
    for short in shorts.split()
}

#: A word is common if it stands beside at least this many different words, in this share of distinct names;
#: so there are at most some ten thousand common words, whatever the size of the input.
MATES, SHARE = 12, 1 / 2000
#: Least cosine of a pair, and least average cosine within a group.
COSINE, LINKAGE = 0.2, 0.2
#: Places of a trigram that are one cell of the join.
CELL = 8
#: Letters up to which a part travels with its trigrams; longer ones are looked up once a pair is known.
SHORT = 64
#: Rare words of a name of which every order is read.
ORDERS = 4


def name_words(raw: str | None) -> list[str] | None:
    """The words of a name that distinguish it; None for a placeholder."""
    words = [w for w in plain((raw or "").replace("&", " and ")) if w != "#"]
    if " ".join(words) in PLACEHOLDERS:
        return None
    words = [("NORTHERN" if w == "NO" else w) for w, following in zip(words, [*words[1:], ""]) if not (w == "NO" and following.isdigit())]
    kept = [w for w in words if w not in LEGAL and w not in TITLES and len(w) > 1]
    kept = [ABBREVIATIONS.get(w) or NICKNAMES.get(w) or w for w in kept]
    return kept or [w for w in words if len(w) > 1] or words


def _deletions(w: str, most: int) -> set[str]:
    """The word and what is left of it after up to ``most`` letters are taken out."""
    out = last = {w}
    for _ in range(most):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out = out | last
    return out


def _edits(w: str) -> int:
    """Typing errors that a common word of this length may hold."""
    return 2 if len(w) >= 8 else 1 if len(w) >= 4 else 0


class Vocabulary:
    """The common words, and the common word that a typed one stands for.

    ``counts`` are words with the number of names that hold them.  A word that is a cut or mistyped form of one
    at least FORM times as frequent is no word of its own.
    """

    FORM = 4

    def __init__(self, counts: dict[str, int]):
        self.words: set[str] = set()
        self.longest = max(map(len, counts), default=0)
        self.near: dict[str, list[str]] = {}
        self.longer: dict[str, list[str]] = {}
        self.skeletons: dict[str, list[str]] = {}
        self.known: dict[str, tuple[str, ...]] = {}
        for w, n in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0])):
            larger = self._stands_for(w)
            if larger and counts[larger] >= self.FORM * n:
                continue
            self.words.add(w)
            for x in _deletions(w, _edits(w)):
                self.near.setdefault(x, []).append(w)
            for k in range(3, len(w)):
                self.longer.setdefault(w[:k], []).append(w)
            self.skeletons.setdefault(self._skeleton(w), []).append(w)

    @staticmethod
    def _skeleton(w: str) -> str:
        return w[:1] + "".join(c for c in w[1:] if c not in "AEIOU")

    def _nearest(self, w: str) -> str | None:
        """The closest common word within the edits that both lengths allow."""
        most = _edits(w) if len(w) <= self.longest + 2 else 0
        near = {v for x in _deletions(w, most) for v in self.near.get(x, ())} if most else set()
        rated = [(distance(v, w, most), v[0] != w[0], v) for v in near]
        return min((r for r in rated if r[0] <= min(most, _edits(r[2]))), default=(0, 0, None))[2]

    def _stands_for(self, w: str) -> str | None:
        if w in self.words:
            return w
        if near := self._nearest(w):
            return near
        for alike in (self.longer.get(w, []), self.skeletons.get(w, []) if len(w) >= 3 else []):
            if len(alike) == 1:
                return alike[0]
        return None

    def read(self, w: str) -> tuple[str, ...]:
        """What a word is read as: a common word, itself, or a rare and a common word written together."""
        if w in self.known:
            return self.known[w]
        out: tuple[str, ...] = (w,)
        if found := self._stands_for(w):
            out = (found,)
        else:
            for k in range(len(w) - 4, 3, -1):
                if w[-k:] in self.words:
                    out = (w[:-k], w[-k:])
                    break
                if w[:k] in self.words:
                    out = (w[:k], w[k:])
                    break
        if len(self.known) < 500_000:
            self.known[w] = out
        return out


def _read(words: list[str], vocabulary: Vocabulary) -> tuple[list[str], list[str]]:
    """(rare words in their order, common words sorted)."""
    read = [x for w in words for x in vocabulary.read(w)]
    return [x for x in read if x not in vocabulary.words], sorted({x for x in read if x in vocabulary.words})


def read_name(words: list[str], vocabulary: Vocabulary) -> tuple[str, str]:
    """(distinctive part, common words): rare words in one, in their order; common ones sorted.

    A name of common words only is all distinctive, so that it is compared letter by letter.
    """
    rare, common = _read(words, vocabulary)
    if not rare:
        return "".join(common), ""
    return "".join(rare), " ".join(NICKNAMES.get(x) or ABBREVIATIONS.get(x) or x for x in common)


def name_readings(words: list[str], vocabulary: Vocabulary) -> list[tuple[str, str]]:
    """``read_name`` for each order of the rare words, the typed one first.

    Of up to ORDERS rare words all orders are read; of more, the rotations of the typed and of the sorted order.
    """
    typed, common = read_name(words, vocabulary)
    rare = _read(words, vocabulary)[0]
    if len(rare) < 2:
        return [(typed, common)]
    if len(rare) <= ORDERS:
        orders = [list(p) for p in itertools.permutations(rare)]
    else:
        orders = [w[i:] + w[:i] for w in (rare, sorted(rare)) for i in range(len(w))]
    return list(dict.fromkeys([(typed, common), *(("".join(o), common) for o in orders)]))


def same_spelling(a: str, b: str) -> bool:
    """Whether two distinctive parts are typed variants of one: an edit in short ones, two in long ones."""
    most = 0 if min(len(a), len(b)) <= 3 else 1 if max(len(a), len(b)) <= 7 else 2
    return distance(a, b, most) <= most


def common_words(names: DataFrame, words: str) -> dict[str, int]:
    """The common words and in how many names they stand, of ``names``, distinct rows with an array column: bounded by SHARE."""
    total = names.count()
    pairs = names.select(F.explode(words).alias("w"), F.col(words).alias("all")).select("w", F.explode("all").alias("mate"))
    mates = pairs.filter("w <> mate and length(mate) > 2").distinct()
    counts = mates.groupBy("w").agg(F.count("*").alias("mates"))
    held = names.select(F.explode(F.array_distinct(words)).alias("w")).groupBy("w").agg(F.count("*").alias("held"))
    found = held.filter(F.col("held") >= SHARE * total).join(counts.filter(F.col("mates") >= MATES), "w")
    return {r["w"]: r["held"] for r in found.select("w", "held").collect()}


def gram_vectors(cases: DataFrame, floor: float = COSINE) -> DataFrame:
    """(id, g, n, at, w, first) of cases (id, part): the weighted vector of the padded part's trigrams, of length 1.

    ``g`` is a trigram's hash, ``n`` how many of it there are in all, ``at`` its places in the part, and ``w``
    the root of its count times the root of its logarithmic rarity.  ``first`` marks those that, rarest first,
    stand before less than ``floor`` of the vector's length is left.  Cases are sent by id before they are taken
    apart, so that trigrams are counted, weighed and ordered where they are made.
    """
    spool = Spool(cases.sparkSession, "grams")
    total = cases.count()
    cases = cases.select("id", "part").repartition("id")
    # By letters and not by substrings, of which each one reads the part from its start.
    letters = cases.select("id", F.split(F.concat(F.lit("^^"), "part", F.lit("$$")), "").alias("x")).withColumn("x", F.filter("x", lambda c: c != ""))
    grams = F.arrays_zip(F.col("x").alias("p"), F.slice("x", F.lit(2), F.size("x")).alias("q"), F.slice("x", F.lit(3), F.size("x")).alias("r"))
    each = letters.select("id", F.posexplode(grams).alias("at", "s")).filter("s.r is not null").select("id", F.xxhash64(F.concat("s.p", "s.q", "s.r")).alias("g"), "at")
    held = each.groupBy("id", "g").agg(F.count("*").alias("tf"), F.collect_list("at").alias("at"))
    counts = spool.save(each.groupBy("g").agg(F.count("*").alias("n")))
    counts = F.broadcast(counts) if counts.spool_rows >= 0 else counts
    weighed = held.join(counts, "g").withColumn("w", F.sqrt("tf") * F.sqrt(F.log(1 + F.lit(float(total)) / F.col("n"))))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    before = Window.partitionBy("id").orderBy("n", "g").rowsBetween(Window.unboundedPreceding, -1)
    left_over = 1 - F.coalesce(F.sum(F.col("w") * F.col("w")).over(before), F.lit(0.0))
    return weighed.select("id", "g", "n", "at", (F.col("w") / norm).alias("w")).withColumn("first", left_over >= floor * floor)


def _odd_letters(part: Column) -> Column:
    """A bit for each letter that stands in a part an odd number of times; an edit changes two of them at most."""
    bit = lambda odd, c: odd.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64))
    return F.aggregate(F.split(part, ""), F.lit(0).cast("long"), bit)


def cosine_pairs(spool: Spool, cases: DataFrame, vectors: DataFrame, floor: float) -> DataFrame:
    """(a, b, s) of cases (id, part, block) of one block whose cosine ``s`` reaches ``floor`` and whose letters differ by few edits.

    The rarest trigrams that two vectors share must be among the first of each, rarest first, that leave less than
    ``floor`` of its length: the rest alone can't reach it.  Only these prefixes are joined, so frequent trigrams
    meet nothing, and no partner is capped.  Two errors move a trigram by two places and cost four edits at most,
    which is looked at where the prefixes meet, before any pair is written: first at letters that stand an odd
    number of times, then at the edits.  The cosine is then the sum over all trigrams.  ``vectors`` are those of
    ``floor``, or a lower one.
    """
    prefix = vectors.filter("first").select("id", "g", "at")
    known = cases.select("id", "block", F.when(F.length("part") <= SHORT, F.col("part")).alias("part"), F.length("part").alias("long"), _odd_letters(F.col("part")).alias("odd"))
    filed = spool.save(prefix.join(known, "id").select("id", "part", "long", "odd", "at", F.xxhash64("block", "g").alias("gram")))
    # A trigram repeated within a cell is filed there once; one side looks into the cells that lie two places around.
    own = F.array_distinct(F.transform("at", lambda x: F.floor(x / CELL)))
    around = F.array_distinct(F.flatten(F.transform("at", lambda x: F.array(F.floor((x - 2) / CELL), F.floor((x + 2) / CELL)))))
    left = filed.select(F.col("id").alias("a"), F.col("part").alias("pa"), F.col("long").alias("la"), F.col("odd").alias("oa"), "gram", F.explode(own).alias("cell"))
    right = filed.select(F.col("id").alias("b"), F.col("part").alias("pb"), F.col("long").alias("lb"), F.col("odd").alias("ob"), "gram", F.explode(around).alias("cell"))
    # As ``same_spelling`` has it: one edit in short parts, two in long ones, none in the shortest.
    short = F.greatest("la", "lb") <= 7
    most = F.when(short, 1).otherwise(2)
    alike = (F.abs(F.col("la") - F.col("lb")) <= most) & (F.least("la", "lb") > 3) & (F.bit_count(F.col("oa").bitwiseXOR(F.col("ob"))) <= 2 * most)
    edits = F.when(short, F.levenshtein("pa", "pb", 2) >= 0).otherwise(F.levenshtein("pa", "pb", 4) >= 0)
    met = left.join(right, ["gram", "cell"]).filter((F.col("a") < F.col("b")) & alike & F.coalesce(edits, F.lit(True)))
    pairs = spool.save(met.select("a", "b").distinct())
    return _dots(pairs, vectors.select(F.col("id").alias("cluster"), "g", "w")).filter(F.col("s") >= floor)


def _dots(pairs: DataFrame, sums: DataFrame) -> DataFrame:
    """(a, b, s): for each pair of clusters the dot product of their summed vectors, the sum of all cross cosines."""
    left = sums.select(F.col("cluster").alias("a"), "g", F.col("w").alias("wa"))
    right = sums.select(F.col("cluster").alias("b"), "g", F.col("w").alias("wb"))
    met = pairs.join(left, "a").join(right, ["b", "g"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("s"))
    return pairs.join(met, ["a", "b"], "left").select("a", "b", F.coalesce("s", F.lit(0.0)).alias("s"))


def average_linkage(spark: SparkSession, edges: DataFrame, floor: float, vectors: DataFrame | None = None) -> DataFrame:
    """(id, cluster) for every id on an edge (a, b, s): average-linkage clusters of similarity ``floor`` or more.

    With ``vectors`` (id, g, w), of length 1, the average is that of the cosines of all pairs of two clusters,
    on an edge or not, as the dot product of their summed vectors; edges only tell which clusters may merge.  So
    the number of spellings of a case does not thin its average out.  Without them a pair without an edge has
    similarity 0, and since an average lies between its parts, merging in rounds gives the clusters of merging the
    best pair each time.  In each round every two clusters that are each other's most similar merge.  Ties go to
    the smaller pair of ids, so at least one pair merges as long as any reaches the floor.
    """
    spool = Spool(spark, "linkage")
    live = spool.save(edges.select("a", "b", "s"))
    home = spool.save(live.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("cluster"), F.lit(1).alias("size")))
    own = None
    if vectors is not None:
        own = spool.save(vectors.join(home.select("id"), "id").select("id", "g", "w"))
    while live.spool_rows:
        sizes = home.groupBy("cluster").agg(F.count("*").alias("n"))
        rated = (
            live.join(sizes.select(F.col("cluster").alias("a"), F.col("n").alias("na")), "a")
            .join(sizes.select(F.col("cluster").alias("b"), F.col("n").alias("nb")), "b")
            .select("a", "b", (F.col("s") / (F.col("na") * F.col("nb"))).alias("mean"))
            .filter(F.col("mean") >= floor)
        )
        order = F.struct(F.round(-F.col("mean"), 9).alias("m"), "a", "b")
        sides = rated.select(F.explode(F.array(F.struct(F.col("a").alias("c"), order.alias("o")), F.struct(F.col("b").alias("c"), order.alias("o")))).alias("e")).select("e.*")
        best = sides.groupBy("c").agg(F.min("o").alias("o"))
        merged = spool.save(best.groupBy("o.a", "o.b").count().filter("count = 2").select(F.col("b").alias("old"), F.col("a").alias("new")))
        if not merged.spool_rows:
            break
        moved = home.join(merged, home["cluster"] == merged["old"], "left").select("id", F.coalesce("new", "cluster").alias("cluster"), "size")
        turned = (
            live.join(merged.select(F.col("old").alias("a"), F.col("new").alias("ta")), "a", "left")
            .join(merged.select(F.col("old").alias("b"), F.col("new").alias("tb")), "b", "left")
            .select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y"), "s")
            .filter("x <> y")
            .groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .agg(F.sum("s").alias("s"))
        )
        before = [live, home]
        home, live = spool.save(moved), spool.save(turned)
        if own is not None and live.spool_rows:
            # Only pairs with a cluster that has grown have another sum than in the round before.
            grown = merged.select(F.col("new").alias("c"))
            touched = live.join(grown.withColumnRenamed("c", "a"), "a", "left_semi").union(live.join(grown.withColumnRenamed("c", "b"), "b", "left_semi"))
            pairs = spool.save(touched.select("a", "b").distinct())
            wanted = pairs.select(F.explode(F.array("a", "b")).alias("cluster")).distinct()
            sums = spool.save(home.join(wanted, "cluster").join(own, "id").groupBy("cluster", "g").agg(F.sum("w").alias("w")))
            summed = spool.save(live.join(pairs, ["a", "b"], "left_anti").select("a", "b", "s").unionByName(_dots(pairs, sums)))
            before += [live, pairs, sums]
            live = summed
        spool.drop(*before, merged)
    return home.select("id", "cluster")


def same_name(spark: SparkSession, records: DataFrame) -> DataFrame:
    """(rec_a, rec_b) for each pair of different keys whose names mean the same person or organisation.

    ``records`` is (key, name).  Legal form, title, middle initial, order of words, abbreviations, nicknames,
    words written together or apart, and typing errors make no other entity; another given name or line of
    business does.  Null, blank and placeholder names make no case; copies of a name are compared once; a key
    with several names is paired by any of them; an empty table gives no rows.
    """
    spool = Spool(spark, "names")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [name_words(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["name", "words"])

    distinct = records.select("name").filter("name is not null").distinct()
    names = spool.save(distinct.mapInArrow(split, "name string, words array<string>").filter("words is not null"))
    sent = spark.sparkContext.broadcast(common_words(names, "words"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(sent.value)
        for batch in batches:
            rows = [(n, *r) for n, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in name_readings(w, vocabulary)]
            parts = [pa.array([r[i] for r in rows], pa.string()) for i in (0, 1, 2)]
            yield pa.RecordBatch.from_arrays(parts, names=["name", "part", "block"])

    readings = names.mapInArrow(read, "name string, part string, block string").withColumn("id", F.xxhash64("part", "block"))
    readings = spool.save(readings)
    cases = spool.save(readings.select("id", "part", "block").dropDuplicates(["id"]))
    vectors = spool.save(gram_vectors(cases))
    similar = cosine_pairs(spool, cases, vectors, COSINE)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [same_spelling(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield batch.select([0, 1, 2]).filter(pa.array(good, pa.bool_()))

    parts = cases.select("id", "part")
    wide = similar.join(parts.select(F.col("id").alias("a"), F.col("part").alias("pa")), "a").join(parts.select(F.col("id").alias("b"), F.col("part").alias("pb")), "b")
    edges = spool.save(wide.select("a", "b", "s", "pa", "pb").mapInArrow(verify, "a long, b long, s double"))
    clusters = spool.save(average_linkage(spark, edges, LINKAGE, vectors))
    members = records.join(readings.select("name", "id"), "name").join(clusters, "id", "left")
    members = spool.save(members.select("key", F.col("id").alias("case"), F.coalesce("cluster", "id").alias("id")).distinct())
    # A verified pair stays a pair where the averages part its ends.
    home = lambda c: clusters.select(F.col("id").alias(c), F.col("cluster").alias(f"c{c}"))
    across = edges.join(home("a"), "a").join(home("b"), "b").filter("ca <> cb").select("a", "b")
    own = members.select("key", F.col("case").alias("id")).distinct()
    within = record_pairs(members.select("key", "id").distinct(), across.limit(0))
    return within.union(record_pairs(own.join(across.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id"), across)).distinct()
