"""Problem 8: a corpus encoded by a public byte-level tokenizer, through a sentencepiece model.

A sentencepiece BPE model is serialised directly from the ranks of the vocabulary: each token's bytes are
mapped to printable characters, and a piece scores the negative of its rank, so that the best pair is the
one of lowest rank.  Normalisation is the identity.  Texts are cut into pre-tokens by the vocabulary's own
pattern, each is mapped and encoded, and decoding inverts the mapping.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; the argument or this variable of the environment name another place.
DEFAULT_FOLDER = os.environ.get("LEDGERLOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how the vocabulary's own tokenizer cuts a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers; more are encoded again, with the same ids.
REMEMBERED = 200_000


def byte_letters() -> list[str]:
    """For each byte a printable character: itself where printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b if b in plain else spare))
        spare += b not in plain
    return letters


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of their ids."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model with these tokens as pieces, their ids unchanged; the last id is the unknown piece."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    letters, model = byte_letters(), pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(letters[b] for b in token), score=-float(rank), type=1)
    model.pieces.add(piece="<unk>", score=0.0, type=2)
    model.trainer_spec.model_type = 2
    model.trainer_spec.vocab_size = len(tokens) + 1
    model.trainer_spec.unk_id = len(tokens)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class PieceTokenizer:
    """Encodes and decodes text by a byte-level vocabulary."""

    def __init__(self, path: str):
        import regex
        import sentencepiece

        tokens = read_ranks(path)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.find = regex.compile(PATTERN).findall
        letters = byte_letters()
        self.mapping = {b: letter for b, letter in enumerate(letters)}
        self.inverse = {ord(letter): b for b, letter in enumerate(letters)}
        self.pieces = [self.processor.id_to_piece(i) for i in range(len(tokens))]
        self.known: dict[str, list[int]] = {}

    def _fill(self, words: list[str]) -> dict[str, list[int]]:
        mapped = [w.encode("utf-8", "replace").decode("latin-1").translate(self.mapping) for w in words]
        return dict(zip(words, self.processor.encode(mapped, num_threads=1))) if words else {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; null and empty ones have none."""
        cut = [self.find(t) if t else [] for t in texts]
        fresh = self._fill([w for w in {w for words in cut for w in words} if w not in self.known])
        out = []
        for words in cut:
            ids: list[int] = []
            for w in words:
                ids += fresh[w] if w in fresh else self.known[w]
            out.append(ids)
        if len(self.known) < REMEMBERED:
            self.known.update(fresh)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids."""
        raw = bytes(self.inverse[ord(c)] for i in ids for c in self.pieces[i])
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer for each vocabulary in a worker."""
    return PieceTokenizer(path)


def encode_column(text: Column, vocabulary: str, folder: str | None = None) -> Column:
    """The token ids of a text column as an array of integers."""
    path = f"{folder or DEFAULT_FOLDER}/{vocabulary}.tiktoken"

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = tokenizer(path)
        for batch in batches:
            yield pa.array(tok.encode_batch(batch.to_pylist()), pa.list_(pa.int32()))

    return encode(text)


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str, folder: str | None = None) -> DataFrame:
    """(key, ids) of every row; a null or empty text has the empty list.

    Special tokens' strings in a text are ordinary text.  Texts are encoded whole, of any length and with any
    characters; equal texts get equal ids, repeated rows stay repeated, and an empty table gives no rows.
    """
    return df.select(F.col(key), encode_column(F.col(text), vocabulary, folder).alias("ids"))
