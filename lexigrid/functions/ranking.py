"""Weights and scores as Column functions of tf, df, the number of documents and lengths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: score(tf, df, n, length, average length) -> Column
Ranker = Callable[[Column, Column, Column, Column, Column], Column]


def classic_idf(n: Column, df: Column) -> Column:
    return F.when((n > 0) & (df > 0), F.log(n / df)).otherwise(0.0)


def bm25_idf(n: Column, df: Column) -> Column:
    return F.when((n > 0) & (df > 0), F.log(1 + (n - df + 0.5) / (df + 0.5))).otherwise(0.0)


def sublinear_tf(tf: Column) -> Column:
    return F.when(tf > 0, 1 + F.log(tf.cast("double"))).otherwise(0.0)


def binary(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    return F.when(tf > 0, 1.0).otherwise(0.0)


def tfidf(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    return sublinear_tf(tf) * classic_idf(n, df)


def bm25(k1: float = 1.2, b: float = 0.75) -> Ranker:
    def score(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
        below = tf + k1 * (1 - b + b * length / average)
        found = bm25_idf(n, df) * (tf * (k1 + 1)) / below
        return F.when((tf > 0) & (length > 0) & (average > 0) & (below != 0), found).otherwise(0.0)

    return score


RANKERS: dict[str, Ranker] = {"binary": binary, "tfidf": tfidf, "bm25": bm25()}
