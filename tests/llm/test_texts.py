"""Encoding, leaks and quality of texts: round trips, brute force and small cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import leaks as lk
from ledgerloom.llm import quality
from ledgerloom.llm.quality import PERIOD, Table, autocorrelation, corpus_stats, find_table, not_prose, text_stats
from ledgerloom.llm.tokens import DEFAULT_FOLDER, encode_corpus, read_ranks, tokenizer
from ledgerloom.llm.words import words_of

TEXTS = [
    "The quick brown fox.", "", None, "   \n\t ", "<|endoftext|> don't", "naïve café 建設 🚜🏗 ​", "x" * 20_000, "\x00\r\n\r\n  a", "12 345,67 €", "ﬁ" * 7, "The quick brown fox.",
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_ids_equal_the_other_libraries():
    tiktoken = pytest.importorskip("tiktoken")
    path = f"{DEFAULT_FOLDER}/byte_bpe_50k.tiktoken"
    ours = tokenizer(path)
    ranks = {t: i for i, t in enumerate(read_ranks(path))}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    drawn = ["".join(rng.choice("ab c'1.\n é建🚜") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts = TEXTS + drawn
    ids = ours.encode_batch(texts)
    assert ids == [other.encode_ordinary(t) if t else [] for t in texts]
    assert [ours.decode(i) for i in ids] == [t or "" for t in texts]


def test_encode_corpus(spark, documents):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(df, "doc_id", "text", "byte_bpe_50k").collect()}
    assert got[1] == got[2] == [] and got[0] == got[10] and len(got) == len(TEXTS)
    assert encode_corpus(df.limit(0), "doc_id", "text", "byte_bpe_50k").count() == 0
    assert encode_corpus(documents, "doc_id", "text", "byte_bpe_50k").count() == documents.count()


def test_words_ignore_how_letters_are_drawn():
    plain = words_of("Each levy covers 548088 dollars of the combine")
    assert words_of("ＥＡＣＨ lе​vy — covеrs: 548,088 dóllars of the com-\n  bine.") == plain
    assert words_of("EACH LEVY\r\ncovers 548088 dol­lars (of) the combine") == plain
    assert words_of(None) == words_of("") == words_of(" \n ") == []


def test_suffix_array_is_sorted_to_full_length():
    rng = np.random.default_rng(1)
    for high in (2, 4, 9):
        tokens = rng.integers(0, high, 400).astype(np.int64)
        tokens[100:180] = 1
        order = lk.suffix_array(tokens)
        whole = lambda i: tokens[i : i + int(np.argmax(np.append(tokens[i:], 0) == 0))].tolist()
        assert [whole(i) for i in order] == sorted(whole(i) for i in order)
        assert sorted(order.tolist()) == np.flatnonzero(tokens).tolist()
    assert len(lk.suffix_array(np.zeros(5, np.int64))) == len(lk.suffix_array(np.zeros(0, np.int64))) == 0


def _brute_matches(tokens, flat):
    same = lambda i, j: 0 <= i < len(flat) and 0 <= j < len(tokens) and flat[i] and flat[i] == tokens[j]
    out = set()
    for i in range(len(flat)):
        for j in range(len(tokens)):
            if same(i, j) and not same(i - 1, j - 1):
                n = next(n for n in range(len(flat) + 1) if not same(i + n, j + n))
                if n >= lk.SEED:
                    out.add((i, j, n))
    return out


def test_maximal_matches_equal_brute_force(monkeypatch):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(5)]
    items = lk.Items([(1, " ".join(rng.choices(vocabulary, k=40))), (2, " ".join(rng.choices(vocabulary, k=30))), (3, None), (4, "")])
    tokens = np.array(items.numbers(" ".join(rng.choices([*vocabulary, "other"], k=300))) + [0], np.int64)
    for size in (lk.SLICE, 7):
        monkeypatch.setattr(lk, "SLICE", size)
        where, place, words = lk.matches(tokens, items)
        assert set(zip(where.tolist(), place.tolist(), words.tolist())) == _brute_matches(tokens.tolist(), items.flat.tolist())


def test_longest_matches_have_their_place(spark):
    passage = [f"w{i}" for i in range(40)]
    docs = [(1, " ".join(["x", "y", *passage[5:25], "z", *passage[5:30]])), (2, " ".join([*passage[:8], "z", *passage[9:19]])), (3, "x")]
    held = spark.createDataFrame([(7, " ".join(passage))], "item_id long, text string")
    corpus = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit("clash"))
    got = {tuple(r) for r in lk.leaks(spark, corpus, "doc_id", "text", held, "item_id", "text").collect()}
    assert got == {(1, 7, 25, 5, 23), (2, 7, 10, 9, 9)}


def _edit(words: list[str], rng: random.Random, edits: int) -> list[str]:
    out, spots = list(words), sorted(rng.sample(range(1, len(words) - 1), edits), reverse=True)
    for s in spots:
        kind = rng.randrange(3)
        if kind == 0:
            out[s] = "altered"
        elif kind == 1:
            del out[s]
        else:
            out.insert(s, "added")
    return out


def test_leaks_are_found(spark):
    rng = random.Random(9)
    item_words = [[f"i{n}x{k}" for k in range(60)] for n in range(6)]
    items = [(n, " ".join(w)) for n, w in enumerate(item_words)] + [(90, None), (91, ""), (92, "Refer to schedule A.")]
    filler = lambda n: [f"f{rng.randrange(50)}" for _ in range(n)]
    docs, want = [], set()
    for d in range(120):
        n = rng.randrange(6)
        length = rng.randrange(16, 40)
        start = rng.randrange(60 - length)
        passage = item_words[n][start : start + length]
        if d % 4 == 0:
            passage = passage[:11]
        elif d % 4 == 1:
            passage = sorted(passage, key=lambda w: hash((w, d)))
        else:
            passage = _edit(passage, rng, length // 6 - 1)
            want.add((d, n))
        text = " ".join(filler(20) + passage + filler(15))
        docs.append((d, text.upper() if d % 3 else text.replace(" ", " ; ")))
    docs += [(500, None), (501, ""), (502, "Refer to schedule A."), (503, docs[2][1]), (504, "word " * 30_000)]
    want.add((503, next(i for d, i in want if d == 2)))
    corpus = spark.createDataFrame(docs, "doc_id long, text string")
    held = spark.createDataFrame(items, "item_id long, text string")
    got = {(r[0], r[1]) for r in lk.leaks(spark, corpus.repartition(5), "doc_id", "text", held, "item_id", "text").collect()}
    assert got == want
    assert lk.without_leaks(corpus, "doc_id", spark.createDataFrame(list(got), "doc_id long, item_id long")).count() == len(docs) - len({d for d, _ in got})
    assert lk.leaks(spark, corpus.limit(0), "doc_id", "text", held, "item_id", "text").count() == 0
    assert lk.leaks(spark, corpus, "doc_id", "text", held.limit(0), "item_id", "text").count() == 0


def test_holds_at_the_bound():
    item = list(range(1, 40))
    exact = item[5:21]
    assert lk.holds(item, exact, [(5, 0)])
    assert not lk.holds(item, item[5:16], [(5, 0)])
    two = [*item[5:10], 0, *item[11:16], 0, *item[17:21]]
    assert lk.holds(item, two, [(5, 0)])
    many = [w if k % 4 else 0 for k, w in enumerate(item)]
    assert not lk.holds(item, many, [(1, 1)])


KINDS = {
    "list": ["Items\n1. Winch AD771282\n2. Grader PS766421\n3. Pump TS206579", "used crane\nnew pump\nidle baler\nheavy hoist\nrebuilt auger", "- idle pump, S/N DF5\n- used drill, S/N RE4\n- new crane, S/N AB1"],
    "table": ["SERIAL|YEAR|TYPE\nAB1|1999|pump\nCD2|2001|\nEF3|2004|crane", "a,1990,pump,55.10\nb,1991,drill,\nc,1992,crane,1.00", "SN1   1990   pump\nSN2   1991   crane\nSN3   1992   hoist"],
    "junk": ["cdgt sqhvlbr hjfnqq tpkvk flpmdz knw", "0" * 300, "█□■" * 40, "3b ec fb ef 33 5c 96 db 2e fe 41 b6", "pump " * 15, "+r86XwdI7n8DwMqWJdpTO7IB9VDoDK2shQXevAVHCrncIA4YTocqy5nDPju9dnKp5n+ai7dYi6sI\nK7z3OWylD2f/aZosH5uLj2JKuC+lOaS2Pm9TxQ==", "$e$c:[9d#^o9 |='[<9|e%mo~%r5a@;1>] te#m0_]l>=a^5"],
    None: [
        "The crane was moved to the yard in March, and it was sold.", "THE CRANE WAS MOVED TO THE YARD AND IT WAS SOLD", "Since the firm closed,\nits press has been\nused by the dealer.",
        "La deuda es de 418,035 dólares y la caldera la respalda en el patio.", "建設機械は倉庫にあります。所有者は銀行です。", "", "   ", None,
    ],
}


def test_kinds(spark):
    rows, want = [], {}
    for kind, texts in KINDS.items():
        for t in texts:
            rows.append((len(rows), t))
            if kind:
                want[len(rows) - 1] = kind
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["kind"] for r in not_prose(df, "doc_id", "text").collect()} == want
    stats = {r["doc_id"]: r for r in corpus_stats(df, "doc_id", "text").collect()}
    assert len(stats) == len(rows) and stats[len(rows) - 1]["n_words"] is None
    assert corpus_stats(df.limit(0), "doc_id", "text").count() == 0


def test_statistics_by_hand():
    names = "n_chars n_words mean_word_length symbol_share punct_line_share common_share n_lines".split()
    s = dict(zip(names, text_stats("The old crane.\nIt was sold")))
    assert (s["n_chars"], s["n_words"], s["n_lines"], s["punct_line_share"]) == (26, 6, 2, 0.5)
    assert s["mean_word_length"] == pytest.approx(20 / 6) and s["common_share"] == 0.5 and s["symbol_share"] == 0
    assert text_stats(None) is None and text_stats(" \n") is None
    assert text_stats("a " * 200_000)[1] == 200_000


def test_structure_is_measured():
    rng = random.Random(1)
    drawn = [autocorrelation([rng.randrange(20, 80) for _ in range(40)]) for _ in range(200)]
    assert sum(x >= PERIOD for x in drawn) == 0 and autocorrelation([0] * 30) == autocorrelation([]) == autocorrelation([3, 9]) == 0.0
    assert autocorrelation([12, 40] * 8) > 0.9 and autocorrelation([0, 4, 4] * 6) > 0.9
    ragged = ["PUMP      |2003 |x|y", "CRANE     |1999", "LOADER    |      | |", "DOZER     |1987 |z"]
    assert find_table(ragged).aligned == 1.0 and find_table(ragged).share == 1.0
    assert find_table(["one line"]) == find_table([]) == Table()


def test_recurring_lengths_and_indents_decide(spark, monkeypatch):
    rng = random.Random(2)
    things = "PUMP CRANE LOADER DOZER WINCH BALER LATHE AUGER MIXER PRESS".split()
    tail = "serial number plate fitted diesel hydraulic reconditioned warehouse depot yard".split()
    by_length = "\n".join(f"{t}\nKRT{rng.randrange(10**3)} {' '.join(rng.sample(tail, 7))}" for t in things)
    by_indent = "\n".join(f"{t} {' '.join(rng.sample(tail, 5))}\n    {' '.join(rng.sample(tail, 6))}\n    {' '.join(rng.sample(tail, 6))}" for t in things)
    df = spark.createDataFrame([(1, by_length), (2, by_indent)], "doc_id long, text string")
    assert {tuple(r) for r in not_prose(df, "doc_id", "text").collect()} == {(1, "list"), (2, "list")}
    # Without the two measures neither is told from prose of unknown words.
    monkeypatch.setattr(quality, "PERIOD", 2.0)
    assert not_prose(df, "doc_id", "text").count() == 0
    aligned = "\n".join(f"{t:<12}" + ("|".join(rng.sample(tail, 1 + k % 4))) for k, t in enumerate(things))
    ones = spark.createDataFrame([(3, aligned)], "doc_id long, text string")
    assert [r["kind"] for r in not_prose(ones, "doc_id", "text").collect()] == ["table"]
