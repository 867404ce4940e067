"""Language ID by hyperdimensional profiles: letter vectors are bound into n-gram vectors, bundled, compared by cosine."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices

DIMENSIONS, GRAM = 1024, 3
#: Labelled documents of each language that a model is fitted on, about.
FIT_ROWS = 2000
UNKNOWN = "und"
#: Code points below TABLE have their class in an array from the start, the others in one that is made when a text has any.
TABLE = 0x3000


@lru_cache(maxsize=2)
def _classes(n: int) -> np.ndarray:
    """For code points below n: the code point of the lower-case letter, or 0 for what isn't a letter."""
    return np.array([ord(x.lower()[0]) if (x := chr(c)).isalpha() else 0 for c in range(n)], dtype=np.int32)


class Encoder:
    """Documents as bundles of n-gram vectors in {-1, 1}^dimensions, a letter's vector being random by its code point.

    A gram's vector is the product of its letters' vectors, the one at place i from its end shifted round by i places
    (bound and permuted). Runs of anything but letters are one space. A document's bundle is the sum of its grams'.
    """

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM):
        self.dimensions, self.gram, self.vectors = dimensions, gram, {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.vectors:
            if len(self.vectors) > 20_000:
                self.vectors.clear()
            seed = int.from_bytes(hashlib.sha256(f"letter {code}".encode()).digest()[:8], "little")
            self.vectors[code] = np.random.default_rng(seed).integers(0, 2, self.dimensions).astype(np.int8) * 2 - 1
        return self.vectors[code]

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        return _classes(TABLE if points.max(initial=0) < TABLE else 0x110000)[points].astype(np.int64)

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The distinct grams, each as one number of 21 bits a letter, and how often they occur."""
        codes = self.codes(text)
        letters = codes > 0
        if not letters.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keep = letters | np.concatenate([[False], letters[:-1]])
        codes = np.concatenate([[0], codes[keep], [0]]) if letters[-1] else np.concatenate([[0], codes[keep]])
        if len(codes) < self.gram:
            codes = np.concatenate([codes, np.zeros(self.gram - len(codes), np.int64)])
        n = len(codes) - self.gram + 1
        packed = np.zeros(n, dtype=np.int64)
        for i in range(self.gram):
            packed = (packed << 21) | codes[i : i + n]
        return np.unique(packed, return_counts=True)

    def gram_vectors(self, packed: np.ndarray) -> np.ndarray:
        out = np.ones((len(packed), self.dimensions), dtype=np.int8)
        for i in range(self.gram):
            codes = (packed >> (21 * i)) & 0x1FFFFF
            own, at = np.unique(codes, return_inverse=True)
            out *= np.roll(np.stack([self.letter(int(c)) for c in own]), i, axis=1)[at]
        return out

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text, of length 1; zero for a text without letters."""
        found = [self.grams(t or "") for t in texts]
        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        some = [i for i, (g, _) in enumerate(found) if len(g)]
        for at in range(0, len(some), 64):
            group = some[at : at + 64]
            own, where = np.unique(np.concatenate([found[i][0] for i in group]), return_inverse=True)
            counts = np.zeros((len(group), len(own)), dtype=np.float32)
            counts[np.repeat(np.arange(len(group)), [len(found[i][0]) for i in group]), where] = np.concatenate([found[i][1] for i in group])
            for low in range(0, len(own), 8192):  # a bound on the gram vectors in memory
                out[group] += counts[:, low : low + 8192] @ self.gram_vectors(own[low : low + 8192]).astype(np.float32)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)


def _sums(dimensions: int):
    def run(batches):
        encoder, sums = Encoder(dimensions), {}
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for lang, v in zip(part.column(1).to_pylist(), encoder.bundles(part.column(0).to_pylist())):
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    return run


def fit(labelled: DataFrame, *, dimensions: int = DIMENSIONS, rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """The languages of `labelled` (doc_id, text, lang), by code point, and their prototypes: the bundled documents, of length 1, centred.

    It is fitted on a bounded sample: of each language the documents whose hashed id falls under `rows` / (documents
    of the language), so all of a rare one; every language counts, however many there are (the driver gets one vector
    for each). Rows without text, letters or lang teach nothing. The mean of the prototypes, what all languages share, is
    taken off each.
    """
    labelled = labelled.where("lang is not null and text is not null")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).select(F.col("lang").alias("__lang"), F.least(F.lit(1.0), F.lit(float(rows)) / F.col("n")).alias("rate"))
    chance = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    # a row for each language, of which the driver holds a whole vector anyway; texts must not be shuffled by language
    sample = labelled.join(F.broadcast(counts), F.col("lang") == F.col("__lang")).where(chance < F.col("rate")).select("text", "lang")
    parts = sample.mapInArrow(_sums(dimensions), "lang string, v array<double>")
    # sums of each component, so that the driver gets one vector a language
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    vectors = {}
    for r in sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect():
        vectors[r["lang"]] = np.array([e["x"] for e in r["v"]])  # all components are there
    langs = sorted(lang for lang, v in vectors.items() if np.linalg.norm(v) > 0)
    if not langs:
        return [], np.zeros((0, dimensions), np.float32)
    units = np.stack([np.round(vectors[lang] / np.linalg.norm(vectors[lang]), 6) for lang in langs])
    return langs, units.astype(np.float32)


def _predict(langs: list[str], prototypes: np.ndarray, dimensions: int):
    mean = prototypes.mean(axis=0) if len(langs) > 1 else np.zeros(dimensions, np.float32)
    own = prototypes - mean
    own = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)

    def run(batches):
        encoder = Encoder(dimensions)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                bundles = encoder.bundles(part.column(1).to_pylist())
                there = np.abs(bundles).sum(axis=1) > 0
                if langs:
                    centred = bundles - mean
                    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)
                    cosines = centred @ own.T
                    best = cosines.argmax(axis=1)
                    scores = np.clip(cosines[np.arange(len(best)), best], 0, 1).astype(float)
                    names = [langs[b] if t else UNKNOWN for b, t in zip(best, there)]
                else:
                    names, scores = [UNKNOWN] * len(there), np.zeros(len(there))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(np.where(there, scores, 0.0))], names=["doc_id", "lang_pred", "score"])

    return run


def held_out(doc_id):
    """Column: whether a document is kept out of fitting."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, *, dimensions: int = DIMENSIONS, rows: int = FIT_ROWS) -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, lang_pred, score.

    A model is fitted on documents with crc32(doc_id) mod 4 other than 2 (see `fit`); only a text's letters enter its
    prediction. score is the cosine with the language's prototype, both less the prototypes' mean, cut to [0, 1].
    A null or empty text, one without a letter, and any text if nothing could be learned: lang_pred `und`, score 0.
    Ties go to the language first by code point. Long texts count whole; repeated rows each give their row; a null
    doc_id isn't held out. An empty table gives no rows. Other columns aren't read.
    """
    labelled = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")))
    langs, prototypes = fit(labelled, dimensions=dimensions, rows=rows)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_predict(langs, prototypes, dimensions), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _filter(names: list[str], langs: list[str], prototypes: np.ndarray, dimensions: int, least: float):
    predict = _predict(langs, prototypes, dimensions)

    def run(batches):
        for batch in batches:
            at = names.index("text")
            for part in slices(batch, "text", 1 << 20):
                probe = pa.RecordBatch.from_arrays([pa.nulls(part.num_rows, pa.int64()), part.column(at)], names=["doc_id", "text"])
                mask = [p and s >= least for got in predict([probe]) for p, s in zip((x != UNKNOWN for x in got.column(1).to_pylist()), got.column(2).to_pylist())]
                yield part.filter(pa.array(mask, pa.bool_()))

    return run


def known_language(docs: DataFrame, *, least: float = 0.0, dimensions: int = DIMENSIONS, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of `docs`, all columns as they are, without those that `identify` calls `und` or scores below `least`."""
    labelled = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")))
    langs, prototypes = fit(labelled, dimensions=dimensions, rows=rows)
    return docs.mapInArrow(_filter(docs.columns, langs, prototypes, dimensions, least), docs.schema)
