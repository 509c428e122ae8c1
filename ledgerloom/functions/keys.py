"""Keys made of content alone: records, cases, people, addresses, blocks, ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import norm_key, normalize_name

#: Seed of hold-out and draws.
SEED = 20260830
# Words that make a name a business however short it is.
BUSINESS_WORDS = tuple(
    """CONSTRUCTION TRUCKING BROTHERS BROS EQUIPMENT SERVICES SERVICE SUPPLY RENTAL RENTALS LEASING EXCAVATING EXCAVATION PAVING
    GRADING CONCRETE DRILLING CONTRACTORS CONTRACTING BUILDERS ENTERPRISES INDUSTRIES MACHINE MACHINERY MOTORS AUTO FARMS RANCH
    RANCHES DAIRY UNIVERSITY COLLEGE SCHOOL DISTRICT COUNTY CITY STATE BANK CREDIT FINANCIAL CAPITAL TRUST HOLDINGS PROPERTIES
    REALTY DEVELOPMENT PARTNERS GROUP ASSOCIATES COMPANIES SYSTEMS SOLUTIONS TRANSPORT TRANSPORTATION LOGISTICS ENERGY OIL GAS
    MINING AGGREGATE READY MIX ASPHALT ROOFING PLUMBING ELECTRIC ELECTRICAL MECHANICAL WELDING FABRICATION STEEL LUMBER FEED GRAIN
    SEED LANDSCAPING LANDSCAPE NURSERY GREENHOUSE SEPTIC UTILITIES UTILITY PIPELINE SPECIALTIES CONSTRUCTORS TRUCKS TRACTOR
    IMPLEMENT SALES CENTER CENTRE""".split()
)
# What an address key writes shorter, in this order.
ADDRESS_SHORT = (
    (" STREET", " ST"),
    (" AVENUE", " AVE"),
    (" ROAD", " RD"),
    (" DRIVE", " DR"),
    (" BOULEVARD", " BLVD"),
    (" HIGHWAY", " HWY"),
    (" STATE HWY", " HWY"),
    (" COUNTY ROAD", " CO RD"),
    (" COUNTY RD", " CO RD"),
    (" SUITE", " STE"),
    (" NORTH ", " N "),
    (" SOUTH ", " S "),
    (" EAST ", " E "),
    (" WEST ", " W "),
    (" POST OFFICE BOX", " PO BOX"),
    (" P O BOX", " PO BOX"),
)
# Words that carry no identity in a signature.
STOP_WORDS = ("THE", "AND", "OF", "A", "AN", "FOR", "IN", "ON", "AT", "BY")


def record_id(*parts: str) -> Column:
    """Sixteen hexadecimal digits of the md5 of the parts joined by a bar, null as empty."""
    return F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(p), F.lit("")) for p in parts])), 1, 16)


def party_id(fileid: Column, name: Column, address: Column, register: str) -> Column:
    """A register's prefix and the digest of file, name and address, for registers without party ids."""
    joined = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (fileid, name, address)])
    return F.concat(F.lit(f"{register}:"), F.substring(F.md5(joined), 1, 16))


def bucket(key: Column, seed: int | str = SEED, buckets: int = 100) -> Column:
    """A bucket in [0, buckets) by the first 32 bits of the md5 of seed and key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8)
    return F.conv(digits, 16, 10).cast("long") % buckets


def is_holdout(key: Column, percent: int = 10) -> Column:
    """Whether a key belongs to the hold-out that arrives later."""
    return bucket(key) < percent


def rank_digest(purpose: str, key: Column, seed: int | str = SEED) -> Column:
    """A digest to order by instead of a random number: sha256 of purpose, seed and key."""
    return F.sha2(F.concat(F.lit(f"{purpose}:{seed}:"), key), 256)


def borrower_key(name: Column, address: Column, city: Column, state: Column, zipcode: Column) -> Column:
    """sha256 of the compact JSON list of the five normalised parts."""
    return F.sha2(F.to_json(F.array(*[norm_key(c) for c in (name, address, city, state, zipcode)])), 256)


def case_id(region: Column, fileid: Column, borrower: Column) -> Column:
    """sha256 of the compact JSON list of region, file and borrower key."""
    return F.sha2(F.to_json(F.array(region, fileid, borrower)), 256)


def group_id(region: Column, name_clean: Column, raw: Column) -> Column:
    """sha256 of region and clean name, or of the raw name marked as such."""
    return F.sha2(F.to_json(F.array(region, F.coalesce(name_clean, F.concat(F.lit("RAW:"), norm_key(raw))))), 256)


def zip5(text: Column) -> Column:
    """The digits of a ZIP code, padded to or cut at five; null stays null."""
    return F.lpad(F.regexp_replace(text, "[^0-9]", ""), 5, "0")


def address_key(address: Column) -> Column:
    """An address in one spelling: letters and digits, usual words shortened in a fixed order."""
    text = F.concat(F.lit(" "), F.regexp_replace(F.upper(F.coalesce(address, F.lit(""))), r"[^\p{L}\p{N}]", " "), F.lit(" "))
    for long, short in ADDRESS_SHORT:
        text = F.replace(text, F.lit(long), F.lit(short))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# What a cleaned address writes shorter, in this order, and what is none.
ADDRESS_CLEAN = (
    ("STREET", "ST"), ("AVENUE", "AVE"), ("ROAD", "RD"), ("DRIVE", "DR"), ("BOULEVARD", "BLVD"), ("NORTH", "N"), ("SOUTH", "S"), ("EAST", "E"), ("WEST", "W"), ("SUITE", "STE"),
    ("POST OFFICE BOX", "PO BOX"), (r"P\s*O\s*BOX", "PO BOX"), ("COUNTY ROAD", "CO RD"), ("HIGHWAY", "HWY"),
)
ADDRESS_JUNK = (
    "", "NONE", "NONE PROVIDED", "NA", "N A", "UNKNOWN", "SAME", "COMPANY", "NOT PROVIDED", "NOT AVAILABLE", "ADDRESS UNKNOWN", "NO ADDRESS", "X", "XX", "TBD", "PO BOX", "BOX", "SEE ATTACHED", "VARIOUS",
)


def address_clean(address: Column) -> Column:
    """An address in capitals with whole words shortened; empty for null, blank and what is no address."""
    text = F.regexp_replace(F.upper(F.coalesce(address, F.lit(""))), "[^A-Z0-9 ]", " ")
    for word, short in ADDRESS_CLEAN:
        text = F.regexp_replace(text, rf"\b{word}\b", short)
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(text.isin(*ADDRESS_JUNK), "").otherwise(text)


def person_key(name_clean: Column, business: tuple[str, ...] = BUSINESS_WORDS) -> Column:
    """FIRST|SECOND of a name of two words, or of three if the third has two letters or fewer; null for others.

    A business word or a digit anywhere makes the name no person's.
    """
    t = F.split(name_clean, " ")
    n = F.size(t)
    person = n.between(2, 3) & ~name_clean.rlike("[0-9]")
    if business:
        person = person & ~F.exists(t, lambda w: w.isin(*business))
    person = person & ((n < 3) | (F.length(F.element_at(F.when(n >= 3, t), 3)) <= 2))
    return F.when(person, F.concat(t[0], F.lit("|"), F.element_at(F.when(n >= 2, t), 2)))


def person_key_of(raw: Column) -> Column:
    """The person key of a raw name; null if it carries a legal form."""
    parts = normalize_name(raw)
    return F.when(parts["suffix"].isNull(), person_key(parts["name_clean"]))


def identity_key(name_clean: Column) -> Column:
    """Sorted words without initials for names of two or three words, else the name itself."""
    t = F.split(name_clean, " ")
    kept = F.array_sort(F.filter(t, lambda w: F.length(w) > 1))
    person = F.size(t).between(2, 3) & (F.size(kept) >= 2) & ~name_clean.rlike("[0-9]")
    return F.when(person, F.array_join(kept, " ")).otherwise(name_clean)


def name_without_spaces(name_clean: Column) -> Column:
    """The clean name in one word."""
    return F.replace(name_clean, F.lit(" "), F.lit(""))


def name_rest(name_clean: Column) -> Column:
    """What follows the first word, in one word; the whole name if nothing does."""
    rest = F.replace(F.regexp_extract(name_clean, "^[^ ]+ (.*)$", 1), F.lit(" "), F.lit(""))
    return F.coalesce(F.nullif(rest, F.lit("")), name_without_spaces(name_clean))


def signature(name_clean: Column, prefix: int = 0, least: int = 3) -> Column:
    """The set of a name's significant words in order, each cut to ``prefix`` letters if given; null if none."""
    words = F.filter(F.split(name_clean, " "), lambda w: (F.length(w) >= least) & ~w.isin(*STOP_WORDS))
    cut = F.transform(words, lambda w: F.substring(w, 1, prefix)) if prefix else words
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(cut)), " "), F.lit(""))


def first_two_blocks(name_clean: Column, letters: int = 4) -> Column:
    """The first letters of the first two words, a block key; null for names of one word."""
    t = F.split(name_clean, " ")
    return F.when(F.size(t) >= 2, F.concat(F.substring(t[0], 1, letters), F.lit("|"), F.substring(F.element_at(F.when(F.size(t) >= 2, t), 2), 1, letters)))


def squeezed_prefix(name_clean: Column, letters: int = 12) -> Column:
    """The first letters of the name without spaces, a block key that ignores spacing."""
    return F.substring(name_without_spaces(name_clean), 1, letters)
