"""Names of organisations and people as a key to block on and a legal form to compare.

Everything is one Column expression, so the normaliser stays inside generated code and needs no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms that end a name.
SUFFIXES = ("LLC", "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LIMITED", "LP", "LLP", "PLLC", "PC", "NA")
# Words of which a trailing clause ", A <clause>" may consist.
CLAUSE_WORDS = tuple(
    """CORPORATION CORP COMPANY CO INCORPORATED INC LIMITED LIABILITY PARTNERSHIP LP LLP LLC GENERAL PROFESSIONAL BANKING BANK
    SAVINGS LOAN ASSOCIATION NATIONAL FEDERAL FEDERALLY CHARTERED STATE STOCK CREDIT UNION AND NON PROFIT NONPROFIT ORGANIZATION
    CORPORATE BODY COOPERATIVE MUTUAL TRUST PUBLIC PRIVATE FOREIGN DOMESTIC BENEFIT SOLE PROPRIETORSHIP JOINT VENTURE UNINCORPORATED
    COLORADO DELAWARE CALIFORNIA TEXAS WYOMING NEVADA NEBRASKA FLORIDA KANSAS UTAH ARIZONA MONTANA MINNESOTA MISSOURI ILLINOIS IOWA
    OKLAHOMA OHIO GEORGIA VIRGINIA MICHIGAN WISCONSIN INDIANA NEW YORK JERSEY MEXICO HAMPSHIRE DAKOTA SOUTH NORTH WEST EAST CAROLINA
    PENNSYLVANIA MARYLAND MASSACHUSETTS OREGON WASHINGTON IDAHO ARKANSAS TENNESSEE KENTUCKY ALABAMA LOUISIANA CONNECTICUT RHODE ISLAND
    MAINE VERMONT ALASKA HAWAII MISSISSIPPI US USA UNITED STATES""".split()
)
ARTICLE = r"(?:\(\s*THE\s*\)\s*)+$"
CLAUSE = r"^(.*?),\s*A\s+(\S.*)$"
_ANY = "|".join(sorted(SUFFIXES, key=len, reverse=True))
PEEL = rf"^(.*?)(?:^| )((?:{_ANY})(?: (?:{_ANY}))*)$"


def _rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def normalize_name(raw: Column) -> Column:
    """struct(name_clean, suffix) of a name; either is null rather than empty.

    In order: upper case; ``&`` becomes AND; stops and apostrophes vanish; a trailing "(THE)" and a trailing
    clause ", A ..." made of legal and place words only are dropped; every other character that is no ASCII
    letter or digit becomes a space; legal forms are peeled off the right.  The clause's last word is the
    suffix if none was peeled.  Null, blank and punctuation give two nulls.
    """
    text = F.translate(F.replace(F.upper(raw), F.lit("&"), F.lit(" AND ")), ".'’", "")
    bare = _rstrip(F.regexp_replace(text, ARTICLE, ""))
    words = F.regexp_extract_all(F.regexp_extract(bare, CLAUSE, 2), F.lit("([A-Z0-9]+)"), 1)
    legal = (F.size(words) > 0) & F.forall(words, lambda w: w.isin(*CLAUSE_WORDS))
    last = F.element_at(F.when(F.size(words) > 0, words), -1)
    kept = F.when(legal, _rstrip(F.regexp_replace(_rstrip(F.regexp_extract(bare, CLAUSE, 1)), ARTICLE, ""))).otherwise(bare)
    plain = F.trim(F.regexp_replace(F.regexp_replace(kept, "[^A-Za-z0-9 ]", " "), " +", " "))
    peeled = F.regexp_extract(plain, PEEL, 2)
    name = F.when(peeled != "", F.regexp_extract(plain, PEEL, 1)).otherwise(plain)
    fallback = F.when(legal & last.isin(*SUFFIXES), last)
    suffix = F.when(plain != "", F.coalesce(F.nullif(peeled, F.lit("")), fallback))
    return F.struct(F.nullif(F.trim(name), F.lit("")).alias("name_clean"), suffix.alias("suffix"))


def norm_key(text: Column) -> Column:
    """Upper case without white space at either end; null becomes empty."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s\x{a0}\x{2000}-\x{200a}]+|[\s\x{a0}\x{2000}-\x{200a}]+$", ""))


def char_text(text: Column) -> Column:
    """Upper case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"[\s\x{a0}\x{2000}-\x{200a}]+", " "))
