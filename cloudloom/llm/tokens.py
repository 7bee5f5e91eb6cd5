"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.runtime import spread

#: Folder of the vocabulary files, and the file used. Every node must have it; files are never copied.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
TOKENIZER = "byte_bpe_multi_50k.tiktoken"

#: How a byte-level BPE cuts text before merging (fixed value of the public vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters of a piece given to the tokenizer at once. A longer run without white space is cut there, so that no
#: piece takes the quadratic time that merging a huge one needs; each cut adds at most one token.
PIECE_CHARS = 4096


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def vocabulary() -> Iterator[str]:
    """Tokens of the vocabulary that are text by themselves."""
    for token in ranks_of(f"{TOKENIZER_DIR}/{TOKENIZER}"):
        try:
            yield token.decode()
        except UnicodeDecodeError:
            pass


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    ranks = ranks_of(path)
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """The text in parts of at most ``PIECE_CHARS`` characters, cut before white space where there is some."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut = max(text.rfind(" ", at + 1, at + PIECE_CHARS), text.rfind("\n", at + 1, at + PIECE_CHARS))
        cut = cut if cut > at else at + PIECE_CHARS
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode(text: str, path: str) -> list[int]:
    # lone surrogates can't be written as UTF-8
    text = text.encode("utf-8", "replace").decode()
    e = encoder(path)
    return [t for part in pieces(text) for t in e.encode_ordinary(part)]


def token_sizes(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """Columns ``keep`` plus ``n_tokens``; a null text has 0 tokens, texts are taken whole."""
    path = path or f"{TOKENIZER_DIR}/{TOKENIZER}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [0 if t is None else len(encode(t, path)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    flat = spread(docs.select(*keep, F.col(text).alias("__text")))
    kinds = ", ".join(f"`{c}` {flat.schema[c].dataType.simpleString()}" for c in keep)
    return flat.mapInArrow(run, f"{kinds}, n_tokens long")
