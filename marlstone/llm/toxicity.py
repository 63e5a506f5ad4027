"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text, with exception phrases.

The lexicon is learned from labelled rows: folded words and word beginnings whose presence has
high log odds for label 1. Phrases that hold a match but speak for label 0 become exceptions and
void the match. A document's matched weight, as such and per word, goes through a logistic curve
fitted on the same rows.

Learning reads at most `most_rows` labelled rows of each class, those with the smallest hash of
their id, so what reaches the driver is bounded whatever the table's size: counts of the features
of these rows that pass a support threshold, and four numbers per sampled row. Every feature that
passes is an entry or exception. Scoring is one pass over all texts without a shuffle.

Defined cases: null and empty texts get the score of a text without matches; without a labelled
row of each class every score is the share of label 1 (0 without any labels); null labels and ids
take no part in learning; of rows with one id the text that sorts last is learned from; repeated rows
are scored alike; a null id is not held out; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, give_back, values

# Characters that stand for Latin letters they look like, Cyrillic and Greek.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m",
    "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "i",
    "ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d",
}
# Digits and signs written for letters. l, I and 1 are one class.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "l": "i"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}

#: Labelled rows of each class that learning reads at most.
MOST_ROWS = 5000
#: Lengths of word beginnings tried.
PREFIXES = range(3, 9)
CHANCE = 1e6
THRESHOLD = 0.3

_SIGN_IN_WORD = re.compile(r"(?<=[^\W_])[@$!|€+]{1,2}(?=[^\W_])")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_INVISIBLE = re.compile("[­​-‏⁠﻿]")


class _Folding(dict):
    """str.translate table, filled as characters come up: a letter to its plain form, else a space."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        if unicodedata.category(ch).startswith("M"):  # a combining mark goes with its letter
            self[code] = ""
            return ""
        plain = ""
        for x in unicodedata.normalize("NFKD", ch).lower():
            x = HOMOGLYPHS.get(x, DIGITS.get(x, x))
            if not unicodedata.category(x[0]).startswith("M"):
                plain += x if x.isalnum() else " "
        self[code] = plain
        return plain


_FOLDING = _Folding()


def fold(text: str | None) -> str:
    """' word word ': letters alone, lower-case, without accents, look-alikes and digits as letters."""
    if not text:
        return " "
    text = _INVISIBLE.sub("", text)
    text = _SIGN_IN_WORD.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text)
    return f" {' '.join(text.translate(_FOLDING).split())} "


@dataclass
class Model:
    """Entries begin with a space (a word begins there); one that ends with a space is a whole word."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coef: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    base: float | None = None
    _automaton: ahocorasick.Automaton | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self) -> ahocorasick.Automaton | None:
        if self._automaton is None and self.entries:
            found: dict[str, list] = {}
            for e, w in self.entries.items():
                found.setdefault(e, [0.0, False])[0] = w
            for e in self.exceptions:
                found.setdefault(e, [0.0, False])[1] = True
            a = ahocorasick.Automaton()
            for e, (w, void) in found.items():
                a.add_word(e, (len(e), w, void))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def matches(self, folded: str) -> dict[int, float]:
        """Start of each matched word -> the largest weight there; words inside exceptions are out."""
        automaton = self.automaton()
        best: dict[int, float] = {}
        void: list[tuple[int, int]] = []
        if automaton is None:
            return best
        for end, (size, weight, is_void) in automaton.iter(folded):
            at = end - size + 1
            if is_void:
                void.append((at, end))
            if weight > best.get(at, 0.0):
                best[at] = weight
        for a, b in void:
            for at in [x for x in best if a <= x < b]:
                del best[at]
        return best

    def features(self, folded: str) -> tuple[float, float, float]:
        words = max(1, folded.count(" ") - 1)
        total = sum(self.matches(folded).values())
        return math.log1p(total), math.log1p(100.0 * total / words), math.log1p(words)

    def score(self, text: str | None) -> float:
        if self.base is not None:
            return self.base
        x = (1.0, *self.features(fold(text)))
        z = sum(a * b for a, b in zip(self.coef, x))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def held_out(id_column: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2: rows that learning must not read."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))


def _candidates(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in PREFIXES if n <= len(w))
    return out


def _contexts(model: Model, folded: str) -> set[str]:
    """Matched words with the word before, the word after, and both."""
    out = set()
    for at in model.matches(folded):
        end = folded.find(" ", at + 1)
        before = folded.rfind(" ", 0, at)
        after = folded.find(" ", end + 1)
        if before >= 0:
            out.add(folded[before : end + 1])
        if after >= 0:
            out.add(folded[at : after + 1])
        if before >= 0 and after >= 0:
            out.add(folded[before : after + 1])
    return out


def _counted(sample: DataFrame, features) -> DataFrame:
    """sample(text, y) -> (feature, pos, neg): in how many rows of either label a feature is."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            counts = (Counter(), Counter())
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[y].update(features(fold(text)))
            keys = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())],
                ["feature", "pos", "neg"],
            )

    return (
        sample.mapInArrow(batches, "feature string, pos long, neg long")
        .groupBy("feature")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )


def _odds(n_pos: int, n_neg: int) -> Column:
    return F.log((F.col("pos") + 0.5) / F.lit(n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(n_neg + 1.0))


def _vague(rows: dict[str, int]) -> set[str]:
    """Beginnings found in about the same rows as a longer entry: the longer one is meant, so that a
    word isn't taken for its beginning."""
    return {e[:n] for e in rows for n in range(2, len(e)) if rows.get(e[:n], 0) * 0.9 <= rows[e]}


def _without_covered(odds: dict[str, float]) -> dict[str, float]:
    """Strongest first, short before long; an entry that a kept beginning covers as well is not kept."""
    kept: dict[str, float] = {}
    for e, w in sorted(odds.items(), key=lambda x: (-round(x[1], 1), len(x[0]), x[0])):
        if not any(kept.get(e[:n], -1e9) >= w - 0.5 for n in range(2, len(e))):
            kept[e] = w
    return kept


def _signature(folded: str) -> list[int]:
    """Four min-hashes of the 5-word shingles."""
    w = folded.split()
    shingles = [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
    h = np.array([xxhash.xxh64_intdigest(x) for x in set(shingles)], dtype=np.uint64)
    return [int((h * m).min()) >> 1 for m in _MULTIPLIERS]


def _unlike(sample: DataFrame) -> DataFrame:
    """One row of each set of near copies: a text copied many times must not lend all its rare words
    the weight of its copies. The sample is bounded, so its signatures may meet on the driver."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = [_signature(fold(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int64()))], ["id", "sig"])

    seen: set[int] = set()
    kept = []
    for r in sorted(sample.select("id", "text").mapInArrow(batches, "id long, sig array<long>").collect()):
        if seen.isdisjoint(r["sig"]):
            kept.append((r["id"],))
        seen.update(r["sig"])
    ids = sample.sparkSession.createDataFrame(kept, "id long")
    return sample.join(F.broadcast(ids), "id").select("text", "y")


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * beta
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        beta -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled rows that are not held out, at most most_rows of each class."""
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    rows = rows.groupBy("id").agg(F.max("y").alias("y"))
    all_n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = all_n.get(1, 0) / max(1, sum(all_n.values()))
    picked = [rows.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most_rows) for y in (0, 1)]
    ids = picked[0].unionAll(picked[1])
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # 2 * most_rows ids at most, so this side may be broadcast at any size of the tables
    sample = _unlike(cut(texts.join(F.broadcast(ids), "id").groupBy("id").agg(F.max("text").alias("text"), F.max("y").alias("y"))))
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos or not n_neg:
        return Model(base=share)
    # by chance alone a feature of so many rows would be in label 1 rows only once in CHANCE
    least = max(3, math.ceil(math.log(CHANCE) / -math.log(n_pos / (n_pos + n_neg))))
    found = (
        _counted(sample, _candidates)
        .withColumn("odds", _odds(n_pos, n_neg))
        .filter((F.col("pos") >= least) & (F.col("odds") >= 2.0) & (F.col("pos") >= 4 * F.col("neg")))
        .collect()
    )
    vague = _vague({r["feature"]: r["pos"] for r in found})
    entries = _without_covered({r["feature"]: r["odds"] for r in found if r["feature"] not in vague})
    model = Model(entries=entries)
    against = (
        _counted(sample, lambda folded: _contexts(model, folded))
        .filter((F.col("neg") >= 2) & (_odds(n_pos, n_neg) < -1.0))
        .collect()
    )
    model = Model(entries=entries, exceptions=sorted(r["feature"] for r in against))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = [model.features(fold(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in x], pa.float64()) for i in range(3)] + [batch.column(1)], ["a", "b", "c", "y"])

    got = np.array([tuple(r) for r in sample.mapInArrow(batches, "a double, b double, c double, y int").collect()], dtype=float)
    got = got[np.lexsort(got.T)]  # the order of rows must not reach the fit
    y = got[:, 3]
    weight = np.where(y == 1, share / n_pos, (1 - share) / n_neg) * len(y)
    coef = _fit(np.column_stack([np.ones(len(y)), got[:, :3]]), y, weight)
    return Model(entries=entries, exceptions=model.exceptions, coef=tuple(float(c) for c in coef))


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column `out`: the score of each text; all other columns stay as they are."""
    text_at = [c.lower() for c in docs.columns].index(text_col.lower())
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            scores = [model.score(t) for t in values(batch.column(text_at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, "score"])
        give_back()

    schema = StructType([*plain.schema.fields, StructField("score", DoubleType())])
    return plain.mapInArrow(batches, schema).toDF(*docs.columns, out)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **learning) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    model = learn(docs, labels, id_col=id_col, text_col=text_col, **learning)
    scored = with_scores(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), model)
    return scored.select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
