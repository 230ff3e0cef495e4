"""Encoding of a corpus with a public byte-level BPE tokenizer, as a monoid over text halves.

A text is halved until the leaves are short; leaves are encoded and neighbours joined. At a join
only a window around the seam is encoded again. It grows on either side until it ends at a *sure*
boundary: a position where a space or line feed follows a character that is no white space. No
word piece of the tokenizer's splitting pattern spans such a position and none looks across it
from the left, so the tokens outside the window are proven to be those of the whole text. The
tokens of the tree's root are therefore those of encoding the text in one go, and the bytes of the
tokens, concatenated up the tree, are the text.

Defined results: null and empty texts have the empty list; strings that look like special tokens
are ordinary text; repeated rows are encoded each; nothing is cut off.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

DEFAULT_FOLDER = "/opt/tokenizers"
LEAF = 16_384
#: Fixed value: the splitting pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Codec:
    """A vocabulary with the lengths of its tokens in bytes."""

    def __init__(self, folder: str, name: str) -> None:
        import tiktoken

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = [0] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.length[v] = len(k)

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        if len(text) <= leaf:
            return self.enc.encode_ordinary(text)
        mid = len(text) // 2
        left, right = text[:mid], text[mid:]
        return self.join(left, self.encode(left, leaf), right, self.encode(right, leaf))

    def join(self, left: str, a: list[int], right: str, b: list[int], window: int = 64) -> list[int]:
        """Tokens of ``left + right`` from those of its parts."""
        i, j = last_sure(left, window), first_sure(right, window)
        keep = len(a)
        need = len(left[i:].encode())
        while need > 0:
            keep -= 1
            need -= self.length[a[keep]]
        skip, need = 0, len(right[:j].encode())
        while need > 0:
            need -= self.length[b[skip]]
            skip += 1
        return a[:keep] + self.encode(left[i:] + right[:j], max(LEAF, len(left) - i + j)) + b[skip:]


def _sure(text: str, p: int) -> bool:
    return text[p] in " \n" and not text[p - 1].isspace()


def last_sure(text: str, window: int) -> int:
    """The last sure boundary, looked for in growing windows; 0 where there is none."""
    n, w, done = len(text), window, len(text)
    while True:
        low = max(1, n - w)
        for p in range(done - 1, low - 1, -1):
            if _sure(text, p):
                return p
        if low == 1:
            return 0
        done, w = low, w * 2


def first_sure(text: str, window: int) -> int:
    """The first sure boundary; the text's length where there is none."""
    n, w, done = len(text), window, 1
    while done < n:
        for p in range(done, min(n, w)):
            if _sure(text, p):
                return p
        done, w = min(n, w), w * 2
    return n


@lru_cache(maxsize=4)
def codec(folder: str, name: str) -> Codec:
    return Codec(folder, name)


def _encode_all(texts: list[str | None], c: Codec) -> list[list[int]]:
    short = [i for i, t in enumerate(texts) if t and len(t) <= LEAF]
    out: list[list[int]] = [[] for _ in texts]
    for i, ids in zip(short, c.enc.encode_ordinary_batch([texts[i] for i in short], num_threads=1)):
        out[i] = ids
    for i, t in enumerate(texts):
        if t and len(t) > LEAF:
            out[i] = c.encode(t)
    return out


def encode(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """(key, ids) for every row of ``df``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(folder, tokenizer)
        for b in batches:
            yield pd.DataFrame({key: b[key], "ids": _encode_all(b[text].tolist(), c)})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, ids array<int>")


def lengths(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """(key, n_tokens): only the counts leave the Python workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(folder, tokenizer)
        for b in batches:
            yield pd.DataFrame({key: b[key], "n_tokens": [len(x) for x in _encode_all(b[text].tolist(), c)]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, n_tokens long")
