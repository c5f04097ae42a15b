"""Character bigram model of a column, learned over all its rows; its size is bounded by the alphabet, not by the data."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = "\x02"


def kind(c: str) -> str:
    """A character itself below U+0500; above, one stand-in for each 256 code points."""
    k = ord(c)
    return c if k < 0x500 else chr(0xE000 + (k >> 8))


def grams(word: str) -> list[str]:
    """Bigrams of a word with both edges."""
    s = [EDGE, *map(kind, word), EDGE]
    return [a + b for a, b in zip(s, s[1:], strict=False)]


class Bigrams:
    """Smoothed log-probabilities of a character after another."""

    def __init__(self, counts: dict[str, float]):
        first: Counter = Counter()
        for g, n in counts.items():
            first[g[0]] += n
        self.size = len(first) + 1
        self.log = {g: math.log((n + 0.1) / (first[g[0]] + 0.1 * self.size)) for g, n in counts.items()}
        self.none = {c: math.log(0.1 / (n + 0.1 * self.size)) for c, n in first.items()}
        self.new = math.log(1 / self.size) - 3

    def step(self, a: str, b: str) -> float:
        g = kind(a) + kind(b)
        x = self.log.get(g)
        return x if x is not None else self.none.get(g[0], self.new)

    def mean(self, word: str) -> float:
        s = [EDGE, *word, EDGE]
        return sum(self.step(a, b) for a, b in zip(s, s[1:], strict=False)) / (len(s) - 1)


def learn(words: DataFrame, word: str = "word", weight: str = "n") -> Bigrams:
    """Counts over all rows of ``words`` (each weighted); only the bounded table of bigrams reaches the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for b in batches:
            for w, n in zip(b["w"], b["n"], strict=True):
                for g in grams(w):
                    c[g] += n
        if c:
            yield pd.DataFrame({"g": list(c.keys()), "n": [float(x) for x in c.values()]})

    got = words.select(F.col(word).alias("w"), F.col(weight).cast("double").alias("n")).mapInPandas(run, "g string, n double")
    return Bigrams({r["g"]: r["n"] for r in got.groupBy("g").agg(F.sum("n").alias("n")).collect()})
