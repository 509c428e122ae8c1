"""Edit distance with transpositions, and the folding that names and addresses share."""

from __future__ import annotations

import re
import unicodedata

#: Digits that stand for a letter inside a word.
DIGIT_LETTERS = str.maketrans({"0": "O", "1": "I", "5": "S", "8": "B"})
_MARKS = re.compile(r"[.'’‘`´]")
_OTHER = re.compile(r"[^\w#]|_")
_TYPED = re.compile(r"[A-Z]{2,}[0158]+[A-Z]+|[A-Z]+[0158]+[A-Z]{2,}|^[0158][A-Z]{4,}$")


def plain(text: str) -> list[str]:
    """Upper-case words without accents and punctuation; stops and apostrophes leave no gap."""
    text = unicodedata.normalize("NFKD", text).upper()
    if not text.isascii():
        text = "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Cf"))
    words = _OTHER.sub(" ", _MARKS.sub("", text)).replace("#", " # ").split()
    return [w.translate(DIGIT_LETTERS) if any(c.isdigit() for c in w) and _TYPED.search(w) else w for w in words]


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) from ``a`` to ``b``; ``most`` + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        following = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, following[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            following.append(cost)
        if min(following) > most:
            return most + 1
        before, row = row, following
    return min(row[-1], most + 1)
