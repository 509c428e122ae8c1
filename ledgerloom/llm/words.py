"""Words of a text such that letter case, accents, layout and the way a letter is drawn make no difference."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of other scripts that are drawn like a Latin one.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ԍ": "g", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ү": "y", "ё": "e",
    "ї": "i", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ζ": "z", "μ": "m", "γ": "y", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ß": "ss", "æ": "ae", "œ": "oe",
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ɴ": "n", "ʀ": "r", "ѡ": "w", "ս": "u", "օ": "o", "ո": "n", "հ": "h", "ց": "g",
}
#: Small digits and signs of which a folded number may be made.
BREAK = re.compile(r"(?<=[^\W\d_])[-‐‑¬][ \t]*\r?\n[ \t]*(?=[^\W\d_])")
WORD = re.compile(r"[^\W_]+(?:(?<=\d)[.,](?=\d{3}(?!\d))\d{3})*")


class _Folding(dict):
    """The folded form of each character, made when first asked for; drops marks and invisible ones."""

    def __missing__(self, point: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(point)).casefold():
            for d in unicodedata.normalize("NFKD", c):
                if unicodedata.category(d) not in ("Mn", "Me", "Cf"):
                    out += LOOKALIKES.get(d, d)
        self[point] = out
        return out


@lru_cache(maxsize=1)
def _folding() -> _Folding:
    return _Folding()


def fold(text: str) -> str:
    """The text in plain lower-case letters, words broken at a line's end rejoined."""
    if text.isascii():
        return BREAK.sub("", text).lower() if "-" in text else text.lower()
    return BREAK.sub("", text.replace("­\n", "").translate(_folding()))


def words_of(text: str | None) -> list[str]:
    """The words of a text in order; signs between digits of one number do not split it."""
    return [w.replace(",", "").replace(".", "") if not w.isalnum() else w for w in WORD.findall(fold(text))] if text else []
