"""Problem 6: byte-level BPE encoding of a corpus in batched numpy merge rounds."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refloom.session import spread

SHIFT = np.int64(1 << 20)  # larger than any id, so that a pair is one integer
NONE = np.int64(1 << 40)
CACHE_WORDS = 200_000  # distinct words whose ids a worker remembers


def tokenizer_file(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """Path of a public vocabulary: of ``folder`` if given, else of the installed package."""
    if folder:
        return f"{folder}/{name}"
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Bytes that are printable in Latin-1 stand for themselves; the others are
    numbered from code point 256 in their own order.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class MergeTable:
    """Sorted pair keys with the rank and the id of what each pair becomes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] for a, _ in pairs], np.int64) * SHIFT + np.array([vocab[b] for _, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys = key[order]
        self.rank = order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        shown = byte_symbols()
        self.first = np.array([vocab[shown[b]] for b in range(256)], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE where it never merges) and its place in the table."""
        key = left * SHIFT + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE), at

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of many words at once.

        All symbols lie in one flat array. In each round every unfinished word
        merges all occurrences of its own lowest-ranked pair, from the left;
        finished words leave the array.
        """
        out: list = [None] * len(words)
        live = np.array([i for i, w in enumerate(words) if w], np.int64)
        for i, w in enumerate(words):
            if not w:
                out[i] = np.empty(0, np.int32)
        if not len(live):
            return out
        size = np.array([len(words[i]) for i in live], np.int64)
        sym = self.first[np.frombuffer(b"".join(words[i] for i in live), np.uint8)]
        while len(live):
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            word = np.repeat(np.arange(len(live)), size)
            rank = np.full(len(sym), NONE, np.int64)
            at = np.zeros(len(sym), np.int64)
            if len(sym) > 1:
                rank[:-1], at[:-1] = self.ranks(sym[:-1], sym[1:])
                rank[:-1][word[:-1] != word[1:]] = NONE
            least = np.minimum.reduceat(rank, start)
            done = least == NONE
            if done.any():
                ends = start + size
                for k in np.flatnonzero(done):
                    out[live[k]] = sym[start[k] : ends[k]].astype(np.int32)
                stay = ~done[word]
                sym, rank, at, word = sym[stay], rank[stay], at[stay], word[stay]
                live, size, least = live[~done], size[~done], least[~done]
                word = np.repeat(np.arange(len(live)), size)
                if not len(live):
                    break
            hit = rank == least[word]
            # runs of touching hits (the same symbol repeated): take every second one, from the left
            place = np.arange(len(sym))
            begins = hit & ~np.concatenate(([False], hit[:-1]))
            run = np.maximum.accumulate(np.where(begins, place, -1))
            hit &= (place - run) % 2 == 0
            where = np.flatnonzero(hit)
            sym[where] = self.made[at[where]]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            size = size - np.bincount(word[where], minlength=len(live))
            sym = sym[keep]
        return out


@functools.lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


@functools.lru_cache(maxsize=1)
def splitter():
    """What cuts a text into words before any merge."""
    import regex

    try:
        from public_tokenizers import PATTERN
    except ImportError:
        PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return regex.compile(PATTERN)


class Encoder:
    """Encodes batches of texts; remembers the ids of words it has met."""

    def __init__(self, path: str):
        self.table = merge_table(path)
        self.known: dict[str, np.ndarray] = {}

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty texts both give an empty array."""
        cut = splitter().findall
        parts = [cut(t) if t else [] for t in texts]
        fresh = list({w for p in parts for w in p} - self.known.keys())
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known = {}
            fresh = list({w for p in parts for w in p})
        self.known.update(zip(fresh, self.table.encode_words([w.encode("utf-8", "replace") for w in fresh]), strict=True))
        known, none = self.known, np.empty(0, np.int32)
        return [np.concatenate([known[w] for w in p]) if p else none for p in parts]


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), *, path: str | None = None, lengths_only: bool = False, into: str = "ids") -> DataFrame:
    """Token ids (or their number) of every text.

    Null and empty texts give an empty list (length 0); a blank text is encoded
    like any other; strings of special tokens are ordinary text. Output columns
    are ``keep`` and ``into``; other columns of ``df`` are not read. Rows are
    neither dropped nor merged, so repeated rows stay repeated. Words of any
    length are encoded whole. The only exchange is the one of ``spread``.
    """
    file = path or tokenizer_file()
    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([T.StructField(k, kinds[k]) for k in keep] + [T.StructField(into, T.IntegerType() if lengths_only else T.ArrayType(T.IntegerType()))])
    taken = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col(text).alias("body"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder(file)
        for b in batches:
            for s in range(0, len(b), 256):
                part = b.iloc[s : s + 256]
                ids = enc.batch(part["body"].tolist())
                yield pd.DataFrame({k: part[f"k{i}"] for i, k in enumerate(keep)} | {into: [len(x) for x in ids] if lengths_only else ids})

    return spread(taken).mapInPandas(run, schema)
