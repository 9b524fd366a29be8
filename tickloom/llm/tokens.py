"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary file lies; a parameter of every operator that counts tokens.
VOCABULARY = os.environ.get("TICKLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Pre-tokenisation of the public byte-level BPE vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The tokenizer of a ``.tiktoken`` rank file, loaded once a worker process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def _tokens(enc, text: str) -> int:
    """Tokens of one text; runs of white space that exhaust the tokenizer's own matcher included.

    The same pattern is then applied by a matcher that does not recurse, and its pieces are
    merged one by one: the count is the one the tokenizer would give.
    """
    try:
        return len(enc.encode_ordinary(text))
    except BaseException as e:  # the native panic is no Exception
        if type(e).__name__ != "PanicException":
            raise
    import regex

    return sum(len(enc._encode_single_piece(m.group(0))) for m in regex.finditer(PATTERN, text))


def count_tokens(texts: list[str | None], path: str = VOCABULARY) -> list[int]:
    """Tokens of each text; null and empty texts have none. Strings of special tokens are ordinary text."""
    enc = encoder(path)
    seen: dict[str, int] = {}
    out = []
    for s in texts:
        if not s:
            out.append(0)
            continue
        if s not in seen:  # copies in a batch are counted once
            seen[s] = _tokens(enc, s)
        out.append(seen[s])
    return out


def with_token_counts(docs: DataFrame, keep: dict[str, str], *, text: str = "text", out: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` (new name -> column of ``docs``) and ``out``, the text's number of tokens.

    One pass over the whole texts where they are read; only the narrow rows go on.
    """
    slim = docs.select(*[F.col(c).alias(n) for n, c in keep.items()], F.col(text).alias("_text"))
    schema = slim.drop("_text").schema.add(out, T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array(count_tokens(b.column(b.num_columns - 1).to_pylist(), path), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keep, out])

    return slim.mapInArrow(run, schema)
