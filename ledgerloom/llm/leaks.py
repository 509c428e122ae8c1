"""Problem 9: passages of held-out items within a training corpus, by suffix arrays of the corpus.

Each task sorts the suffixes of its shard of the corpus, as words and to their full length, and binary-searches
every suffix of every item in it: what stands beside the place found shares the longest verbatim match.  Around
it lie all places that share at least SEED words; their maximal matches, with length and location, are leaks if
they are long enough and seed an alignment otherwise, which allows single words to be altered, missing or added.
The corpus is never shuffled: a shard needs nothing but the items, and the items are read in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.words import words_of

#: Fewest words of a passage, and the words of which one may differ.
PASSAGE, ONE_IN = 16, 6
#: A passage of 16 words or more with a sixth of them altered has 4 words in a row that are not.
SEED = 4
#: Words of a shard, and characters of a block of items; both bound memory, not the input.
SHARD_WORDS, BLOCK_CHARS = 1_500_000, 16 << 20
#: Places of a shard that are laid out at a time.
SLICE = 2_000_000


class Items:
    """The items as one array of word numbers, 0 between items."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.number: dict[str, int] = {}
        self.ids, self.words, self.starts = [], [], []
        flat: list[int] = []
        for item, text in rows:
            own = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            self.ids.append(item)
            self.words.append(own)
            self.starts.append(len(flat))
            flat += [*own, 0]
        self.flat = np.array(flat, np.int64)
        self.owner = np.repeat(np.arange(len(rows)), [len(w) + 1 for w in self.words])

    def numbers(self, text: str | None) -> list[int]:
        """A text's words by number; 0 for a word of no item."""
        get = self.number.get
        return [get(w, 0) for w in words_of(text)]


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order; a suffix ends at the next 0, and those at a 0 are left out.

    Prefix doubling: suffixes ordered by k words are ordered by 2k through the ranks of their halves, until all
    differ or the longest has been read whole.
    """
    n = len(tokens)
    at = np.flatnonzero(tokens)
    if not len(at):
        return at
    ends = np.flatnonzero(np.concatenate([tokens == 0, [True]]))
    longest = int(np.diff(np.concatenate([[-1], ends])).max()) - 1
    rank, k = tokens.astype(np.int64), 1
    while k < longest:
        ahead = np.zeros(n, np.int64)
        ahead[: n - k] = rank[k:]
        key = rank[at] * (int(rank.max()) + 2) + ahead[at]
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[1], (np.diff(key[order]) != 0).astype(np.int64)]).cumsum()
        rank = np.zeros(n, np.int64)
        rank[at[order]] = fresh
        if fresh[-1] == len(at):
            break
        k *= 2
    return at[np.argsort(rank[at], kind="stable")]


def common_words_ahead(tokens: np.ndarray, at: np.ndarray, items: np.ndarray, wanted: np.ndarray, most: int | None = None) -> np.ndarray:
    """For each pair of a place in the corpus and one in the items, the words that agree from there on, up to ``most``."""
    out, live = np.zeros(len(at), np.int64), np.arange(len(at))
    while len(live) and (most is None or out[live[0]] < most):
        have, want = tokens[np.minimum(at[live] + out[live], len(tokens) - 1)], items[np.minimum(wanted[live] + out[live], len(items) - 1)]
        live = live[(have == want) & (want != 0) & (at[live] + out[live] < len(tokens)) & (wanted[live] + out[live] < len(items))]
        out[live] += 1
    return out


def search(tokens: np.ndarray, order: np.ndarray, items: np.ndarray, wanted: np.ndarray, most: int | None = None, after: bool = False) -> np.ndarray:
    """For each item suffix its place among the corpus' sorted suffixes, comparing up to ``most`` words; ``after`` those that equal it."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
    padded, own = np.append(tokens, 0), np.append(items, 0)
    while (low < high).any():
        middle = (low + high) // 2
        at = order[np.minimum(middle, len(order) - 1)]
        same = common_words_ahead(tokens, at, items, wanted, most)
        less = padded[at + same] < own[wanted + same]
        if most is not None:
            less = np.where(same >= most, after, less)
        going = low < high
        low, high = np.where(going & less, middle + 1, low), np.where(going & ~less, middle, high)
    return low


def matches(tokens: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item position, corpus position, words) of every maximal verbatim match of at least SEED words."""
    none = np.zeros(0, np.int64)
    order, starts = suffix_array(tokens), np.flatnonzero(items.flat)
    if not len(order) or not len(starts):
        return none, none, none
    # The longest match of an item's suffix stands next to its place; shorter ones than SEED are of no use.
    place = search(tokens, order, items.flat, starts)
    beside = [common_words_ahead(tokens, order[np.clip(place + step, 0, len(order) - 1)], items.flat, starts) for step in (-1, 0)]
    starts = starts[np.maximum(*beside) >= SEED]
    first, last = (search(tokens, order, items.flat, starts, SEED, after) for after in (False, True))
    found, done = [], 0
    total = np.cumsum(last - first)
    while done < len(starts):
        end = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + SLICE, side="right")))
        count = (last - first)[done:end]
        where = np.repeat(starts[done:end], count)
        at = order[np.repeat(first[done:end] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        # A match that could begin a word earlier is part of a longer one.
        before = np.where((where > 0) & (at > 0), tokens[at - 1] == items.flat[where - 1], False) & (items.flat[where - 1] != 0)
        where, at = where[~before], at[~before]
        found.append((where, at, common_words_ahead(tokens, at, items.flat, where)))
        done = end
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none, none)


def _reach(item: list[int], doc: list[int], i0: int, j0: int, step: int) -> list[int]:
    """For each number of edits the most item words covered from (i0, j0) on, forward or backward.

    The cell that reaches furthest is kept on each diagonal.  It ends where edits run three ahead of ONE_IN, since
    a passage that is good as a whole has a good part on the other side then.
    """
    n, m = (len(item) - i0, len(doc) - j0) if step > 0 else (i0 + 1, j0 + 1)
    front, out = {0: 0}, []
    while front:
        for d, i in front.items():
            j = i + d
            while i < n and j < m and item[i0 + step * i] == doc[j0 + step * j] and item[i0 + step * i]:
                i, j = i + 1, j + 1
            front[d] = i
        out.append(max(front.values()))
        if len(out) * ONE_IN > len(item) or (len(out) - 4) * ONE_IN > out[-1]:
            break
        following: dict[int, int] = {}
        for d, i in front.items():
            for e, x in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):
                if x <= n and 0 <= x + e <= m and following.get(e, -1) < x:
                    following[e] = x
        front = following
    return out


def holds(item: list[int], doc: list[int], seeds: list[tuple[int, int]]) -> bool:
    """Whether the document has PASSAGE successive words of the item, one in ONE_IN altered, missing or added.

    A passage reaches from a seed forward and backward, each with some of its edits; words altered at its ends
    count as edits too.
    """
    for i0, j0 in seeds:
        onward = _reach(item, doc, i0, j0, 1)
        if onward[0] >= PASSAGE:
            return True
        back = _reach(item, doc, i0 - 1, j0 - 1, -1) if i0 and j0 else [0]
        for e, x in enumerate(onward):
            for f, y in enumerate(back):
                if x + y >= PASSAGE and (e + f) * ONE_IN <= x + y:
                    return True
    return False


def shard_leaks(docs: list, texts: list[list[int]], items: Items) -> list[tuple]:
    """(document, item, words, item position, document position) of every leak in a shard, with its longest verbatim match."""
    tokens = np.array([t for own in texts for t in (*own, 0)], np.int64)
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(own) + 1 for own in texts])])
    where, place, words = matches(tokens, items)
    row = np.searchsorted(starts, place, side="right") - 1
    owner = items.owner[where] if len(where) else where
    pair = row * len(items.ids) + owner
    order = np.lexsort((place, -words, pair))
    cuts = np.flatnonzero(np.diff(pair[order])) + 1
    found = []
    for part in np.split(order, cuts) if len(order) else []:
        best = part[0]
        r, o = int(row[best]), int(owner[best])
        i, j = where[part] - items.starts[o], place[part] - starts[r]
        if words[best] >= PASSAGE or holds(items.words[o], texts[r], list(zip(i.tolist(), j.tolist()))):
            found.append((docs[r], items.ids[o], int(words[best]), int(i[0]), int(j[0])))
    return found


def leaks(spark: SparkSession, corpus: DataFrame, key: str, text: str, held: DataFrame, item: str, passage: str) -> DataFrame:
    """(key, item, words, item_at, doc_at) for each document and item of which the document holds a passage.

    ``words`` is the length of their longest verbatim match, and ``item_at`` and ``doc_at`` are the words before it.

    A passage is PASSAGE or more successive words of the item, of which one in ONE_IN may be altered, missing
    or added.  Letter case, accents, punctuation, layout, invisible characters and look-alike letters make no
    difference.  Null, empty and shorter texts and items give no rows; repeated documents and items each
    count; documents of any length are searched whole.  An empty table on either side gives no rows.

    The items are held-out material of bounded size: they are sent to the tasks in blocks of BLOCK_CHARS
    characters, each block being one pass over the corpus.
    """
    held = held.select(item, passage).filter(F.col(passage).isNotNull())
    chars = held.agg(F.sum(F.length(passage))).first()[0] or 0
    blocks = int(chars // BLOCK_CHARS) + 1
    schema = f"`{key}` {corpus.schema[key].dataType.simpleString()}, `{item}` {held.schema[item].dataType.simpleString()}, words int, item_at int, doc_at int"
    texts = corpus.select(key, text).filter(F.length(text) > 0)
    out: DataFrame | None = None
    for block in range(blocks):
        part = held.filter(F.pmod(F.xxhash64(item), F.lit(blocks)) == block).orderBy(item) if blocks > 1 else held.orderBy(item)
        sent = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value)
            docs: list[int] = []
            words: list[list[int]] = []
            held_words = 0

            def flush() -> pa.RecordBatch:
                found = shard_leaks(docs, words, items)
                kinds = [*types, pa.int32(), pa.int32(), pa.int32()]
                columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
                return pa.RecordBatch.from_arrays(columns, names=[key, item, "words", "item_at", "doc_at"])

            types = [pa.int64(), pa.int64()]
            for batch in batches:
                types[0] = batch.schema.field(0).type
                types[1] = pa.array(items.ids).type if items.ids else pa.int64()
                for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = items.numbers(value)
                    docs.append(doc)
                    words.append(own)
                    held_words += len(own)
                    if held_words >= SHARD_WORDS:
                        yield flush()
                        docs.clear()
                        words.clear()
                        held_words = 0
            if docs:
                yield flush()

        found = texts.mapInArrow(find, schema)
        out = found if out is None else out.unionByName(found)
    return out.groupBy(key, item).agg(F.max(F.struct("words", (-F.col("item_at")).alias("i"), (-F.col("doc_at")).alias("d"))).alias("m")).select(
        key, item, "m.words", (-F.col("m.i")).alias("item_at"), (-F.col("m.d")).alias("doc_at")
    )


def without_leaks(corpus: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """The corpus without the documents that leak anything; a null key is kept."""
    return corpus.join(found.select(key).distinct(), key, "left_anti")
