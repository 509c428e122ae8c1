"""Problem 10: statistics of each text, and what they say: natural prose, list, table or junk.

Tables show in delimiters that stand under one another, or as often, in line after line; lists in short lines of
much the same length, or whose lengths or indents come back period by period; junk in characters and words of no
language.  Word, symbol and punctuation ratios are combined with these; each text is read whole and by itself, so
the scan needs no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent words of several languages.
COMMON = frozenset(
    """the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were
    when we there can an your which their said if do will each about how up out them then she many some so these would other
    into has more her him see could no than been its who now my over did only use may after because although once unless while
    since whenever under without despite against where any until before was de la que el en y los se del las un por con una su
    para es al lo como más pero sus le ya fue este ha sí porque esta son entre está cuando muy sin sobre ser hasta hay donde
    han desde todo nos durante ni contra ese aunque allí puede tras le les des et est dans pour qui une sur pas par plus avec
    ce sont au der die das und ist von nicht mit dem den ein eine auf für im zu sich auch wird il di che non per è della sono
    uma não com os as do da em mais foi""".split()
)
#: What may open an item of a list.
MARKER = re.compile(r"\s*(?:[-*•·‣◦▪–—+>☐☑✓]|\(?\d{1,3}[.):]|\(?[a-zA-Z][.)]|(?:item|unit|qty|no|lot|pos)\.?\s*\d+\s*:?)\s*\S", re.I)
LINE_END = tuple(".!?:;,…。！？\"'”’)»")
STOP = tuple(".!?…。！？")
PLAIN = frozenset(".,;:'\"-()!?/&%$€£#¿¡’‘“”–—…«»、。，．：；！？（）'")
WORD = re.compile(r"\w+")
SPLITTERS = {"pipe": re.compile(r"\s*\|\s*"), "tab": re.compile(r"\t"), "comma": re.compile(r","), "semicolon": re.compile(r";"), "gap": re.compile(r"(?<=\S) {2,}(?=\S)")}
SIGNS = {"pipe": "|", "tab": "\t", "comma": ",", "semicolon": ";", "gap": "  "}
VOWELS = frozenset("aeiouyáéíóúàèìòùâêîôûäëïöüãõåæœø")

STATS = (
    "n_chars long, n_words long, mean_word_length double, symbol_share double, punct_line_share double, common_share double, "
    "n_lines long, words_per_line double, table_share double, columns long, cell_length double, marker_share double, stop_share double, "
    "indent_period double, length_autocorrelation double, length_spread double, aligned_share double, letter_share double, odd_word_share double, vowel_share double, "
    "char_variety double, word_variety double"
)
_NAMES = [part.split()[0] for part in STATS.split(", ")]


#: Lines after which a pattern may come back, and the fewest lines that can show it.
LAGS, PATTERN_LINES = (1, 2, 3, 4), 6


def autocorrelation(values: list[int]) -> float:
    """How much a sequence of numbers follows itself some lines on: the largest correlation of deviations from the mean over LAGS.

    Near 1 where the numbers come back period by period, about 0 where they are drawn at random; 0 where they
    are all alike or too few.
    """
    x = np.array(values, float)
    x = x - x.mean() if len(x) else x
    power = float((x * x).sum())
    if len(x) < PATTERN_LINES or not power:
        return 0.0
    # Each lag is weighed by the lines it leaves, so that a long lag is not worth less.
    return max(float((x[k:] * x[:-k]).sum()) / power * len(x) / (len(x) - k) for k in LAGS if len(x) > k + 1)


class Table(NamedTuple):
    """The best delimiter of a text: the share of lines that it divides alike, the number of cells, their mean length,
    and the share of lines in which it stands under itself."""

    share: float = 0.0
    columns: int = 1
    cell: float = 0.0
    aligned: float = 0.0


def find_table(lines: list[str]) -> Table:
    """The table that a text's lines make, by the delimiter that divides most of them alike.

    Lines are alike if they have the usual number of cells, or if a delimiter of theirs ends where it does in half of
    all lines: columns of a set width stand under one another even where cells are empty.
    """
    best = Table()
    if len(lines) < 2:
        return best
    whole = "\n".join(lines)
    for name, splitter in SPLITTERS.items():
        if SIGNS[name] not in whole:
            continue
        # A frame around the rows is no delimiter; an open end is an empty cell.
        rows = [line.strip().strip("|") if name == "pipe" and line.lstrip().startswith("|") else line for line in lines]
        cells = [splitter.split(row) for row in rows]
        counts = Counter(len(c) for c in cells)
        usual, n = max(counts.items(), key=lambda kv: (kv[1], kv[0]))
        ends = [{m.end() for m in splitter.finditer(row)} for row in rows]
        places = Counter(e for own in ends for e in own)
        under = sum(any(places[e] >= max(2, 0.5 * len(lines)) for e in own) for own in ends)
        if name == "gap":  # an empty cell leaves no gap of its own, so only the places tell
            usual, n = max(counts, key=lambda k: (k > 1, counts[k], k)), under
        if usual < 2 and under < n:
            continue
        usual = max(usual, 2 if under else 1)
        if usual < 2:
            continue
        found = Table(max(n if counts[usual] or name == "gap" else 0, under) / len(lines), usual, float(np.mean([len(x) for c in cells for x in c])), under / len(lines))
        if found.share > best.share:
            best = found
    return best


def text_stats(text: str | None) -> tuple | None:
    """The statistics of one text in the order of STATS; None for a text that is null or blank."""
    if text is None or not text.strip():
        return None
    words = WORD.findall(text)
    lowered = [unicodedata.normalize("NFKC", w).lower() if not w.isascii() else w.lower() for w in words]
    lines = [line for line in text.splitlines() if line.strip()]
    counts = {c: k for c, k in Counter(text).items() if not c.isspace() and unicodedata.category(c) not in ("Cf", "Mn")}
    n = max(1, sum(counts.values()))
    letters = sum(k for c, k in counts.items() if c.isalpha())
    symbols = sum(k for c, k in counts.items() if not c.isalnum() and c not in PLAIN)
    vowels = consonants = 0
    for c, k in counts.items():
        if c.isalpha():
            for x in unicodedata.normalize("NFKC", c).lower():
                vowels += k * (x in VOWELS)
                consonants += k * ("a" <= x <= "z" and x not in VOWELS)
    # A letter inside a run of other signs, a digit inside letters, or no vowel at all: no word of a language.
    kinds = Counter(lowered)
    odd = sum(
        k
        for w, k in kinds.items()
        if "_" in w
        or (w.isalpha() and w.isascii() and len(w) > 2 and VOWELS.isdisjoint(w))
        or (not w.isalpha() and not w.isdigit() and any(c.isalpha() for c in w))
    )
    table = find_table(lines)
    lengths = [len(line.strip()) for line in lines]
    variety = -sum(k / n * np.log2(k / n) for k in counts.values())
    return (
        len(text),
        len(words),
        sum(map(len, words)) / len(words) if words else 0.0,
        symbols / n,
        sum(line.rstrip().endswith(LINE_END) for line in lines) / len(lines),
        sum(k for w, k in kinds.items() if w in COMMON) / max(1, len(words)),
        len(lines),
        len(words) / len(lines),
        table.share,
        table.columns,
        table.cell,
        sum(bool(MARKER.match(line)) for line in lines) / len(lines),
        sum(line.rstrip().endswith(STOP) for line in lines) / len(lines),
        autocorrelation([len(line) - len(line.lstrip()) for line in lines]),
        autocorrelation(lengths),
        float(np.std(lengths) / np.mean(lengths)),
        table.aligned,
        letters / n,
        odd / max(1, len(words)),
        vowels / (vowels + consonants) if vowels + consonants else -1.0,
        float(variety),
        len(kinds) / max(1, len(words)),
    )


def corpus_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, statistics) of every row; the statistics are null where the text is null, empty or blank."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, {STATS}"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64() if part.endswith("long") else pa.float64() for part in STATS.split(", ")]
        for batch in batches:
            rows = [text_stats(t) or (None,) * len(_NAMES) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(_NAMES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *_NAMES])

    return df.select(key, text).mapInArrow(measure, schema)


#: Deviation of line lengths, as a share of their mean, up to which they are even; autocorrelation from which a pattern comes back.
SPREAD, PERIOD = 0.5, 0.6


def kind() -> Column:
    """``table``, ``list`` or ``junk`` by the statistics; null for prose and for texts without any."""
    c = F.col
    prose = c("common_share") >= 0.20
    structured = ~prose & (c("symbol_share") < 0.30)
    single = (c("words_per_line") <= 9) & (c("n_lines") >= 2)
    marked = structured & single & (c("marker_share") >= 0.5) & ~((c("columns") > 2) & (c("table_share") >= 0.9))
    table = structured & ~marked & (c("n_lines") >= 2) & (c("table_share") > 0) & (c("columns") >= 2) & (c("table_share") >= 0.6) & (c("cell_length") <= 40)
    # Lines of much the same length name one thing each; longer ones are a list if their lengths or indents come back.
    even = (c("words_per_line") <= 5) & (c("length_spread") <= SPREAD)
    recurring = (c("indent_period") >= PERIOD) | (c("length_autocorrelation") >= PERIOD)
    listed = marked | (structured & single & (c("n_lines") >= 3) & (c("stop_share") <= 0.05) & (c("odd_word_share") < 0.5) & (even | recurring))
    broken = (
        (c("symbol_share") >= 0.10)
        | (c("odd_word_share") >= 0.35)
        | ((c("vowel_share") >= 0) & (c("vowel_share") < 0.22) & (c("n_words") >= 3))
        | (c("letter_share") < 0.45)
        | ((c("char_variety") < 2.0) & (c("n_chars") >= 20))
        | ((c("word_variety") < 0.1) & (c("n_words") >= 12))
        | ((c("word_variety") * c("n_words") < 2.5) & (c("n_words") >= 6))
        | ((c("mean_word_length") <= 2.1) & (c("n_words") >= 6) & (c("vowel_share") >= 0) & (c("n_lines") < 3))
        | ((c("mean_word_length") > 25) & (c("vowel_share") >= 0))
    )
    junk = broken & ((c("common_share") < 0.20) | (c("symbol_share") >= 0.15))
    # Encoded lines mix letters, digits and signs in long unbroken runs; a list's or table's serials are short.
    runs = (c("odd_word_share") >= 0.35) & (c("n_chars") / c("n_words") > 6.5) & (c("marker_share") < 0.5)
    runs = runs | ((c("odd_word_share") >= 0.6) & (c("mean_word_length") >= 10.5))
    encoded = ~prose & (c("columns") < 2) & runs
    return F.when(c("n_words").isNull(), None).when(table & ~encoded, "table").when(listed & ~encoded, "list").when(junk, "junk")


def not_prose(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind) of every row whose text is no natural prose; null, empty and blank texts are no case.

    Repeated rows each count.  Letter case, layout and punctuation of prose make no difference, nor does the
    script: a language without any of the common words is junk only if its characters or words are broken.
    """
    return corpus_stats(df, key, text).select(key, kind().alias("kind")).filter("kind is not null")
