"""Word-list classifiers as predicates: whole words in any listed form, with guards against other senses.

The lists are parameters; the library holds no business rules of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

def whole_words(words: list[str], plural: bool = True) -> str:
    """A pattern of any of the words as a whole word, the longest first; a space stands for any white space.

    With ``plural`` a word also stands for its plural: S, or ES after a hiss; a word that ends in S has none.
    """
    parts = []
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        ending = ""
        if plural and not word.endswith("S"):
            ending = "(?:E?S)?" if word.endswith(("CH", "SH", "X", "Z")) else "S?"
        parts.append(r"\s+".join(map(re.escape, word.split())) + ending)
    return rf"\b(?:{'|'.join(parts)})\b"


def has_word(text: Column, words: list[str], plural: bool = True, unless: str | None = None) -> Column:
    """Whether a text holds one of the words and not the pattern ``unless``; false for null."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    found = upper.rlike(whole_words(words, plural))
    return found & ~upper.rlike(unless) if unless else found


def has_trade_word(
    text: Column, words: list[str], surnames: list[str], other_sense: str | None = None, firm: str | None = None, family: str | None = None
) -> Column:
    """``has_word`` where some of the words are surnames too, and some hits are meant in another sense.

    ``other_sense``, ``firm`` and ``family`` are patterns: of hits that count for nothing, of what only firms write
    in their name, and of names handed down in a family.  The first line that applies decides:

    | what the name shows                                             | trade word |
    |-----------------------------------------------------------------|------------|
    | no hit, or hits in another sense only                           | no         |
    | a hit that is no bare surname, such as a plural or another word | yes        |
    | a family's way of naming                                        | no         |
    | a firm's mark, and no surname at the head                       | yes        |
    | an owner before it, as a word that ends in S and is not listed  | yes        |
    | nothing of these                                                | no         |
    """
    name = F.upper(F.coalesce(text, F.lit("")))
    listed = whole_words(words)
    hits = F.regexp_extract_all(F.regexp_replace(name, other_sense, " ") if other_sense else name, F.lit(f"({listed})"), 1)
    bare = F.filter(hits, lambda h: h.isin(*surnames))
    parts = F.split(F.trim(F.regexp_replace(name, r"[,.\s]+", " ")), " ")
    owner = F.exists(parts, lambda t: t.endswith("S") & ~t.rlike(f"^{listed}$") & ~t.isin(*surnames))
    verdicts = [(F.size(hits) == 0, False), (F.size(bare) < F.size(hits), True)]
    if family:
        verdicts.append((name.rlike(family), False))
    if firm:
        verdicts.append((name.rlike(firm) & ~parts[0].isin(*surnames), True))
    verdicts.append((owner, True))
    return F.coalesce(*[F.when(shown, F.lit(verdict)) for shown, verdict in verdicts], F.lit(False))


def route(lender: Column, borrower: Column) -> Column:
    """Which of two criteria hold: both, lender, borrower or neither."""
    return F.when(lender & borrower, "both").when(lender, "lender").when(borrower, "borrower").otherwise("neither")


def mask(text: Column, words: list[str]) -> Column:
    """The text with every listed word taken out, so that a model cannot lean on it."""
    gone = F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), whole_words(words), " ")
    return F.trim(F.regexp_replace(gone, r"\s+", " "))


def word_classes(text: Column, classes: dict[str, list[str]]) -> Column:
    """The names of the classes of which a text holds a word, in order."""
    found = F.array(*[F.when(has_word(text, words), name) for name, words in sorted(classes.items())])
    return F.filter(found, lambda x: x.isNotNull())
