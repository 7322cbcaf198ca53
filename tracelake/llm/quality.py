"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Training uses at most ``TRAIN_ROWS`` labelled documents, those with the smallest hash of their id;
everything else about it is exact. Each partition sums its part of the normal equations, the sums
meet in a few rows, and the driver solves one small system. Scores of the training documents,
counted in ``BINS`` bins, give the isotonic calibration. The model is some tens of kilobytes
and goes out with the scoring function; scoring reads whole texts, document by document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import keep, query, table

TRAIN_ROWS = 50_000
FEATURES = 256
RIDGE = 1e-3
BINS = 1000
THRESHOLD = 0.3
FOLDS = 5
_PARTS = 16

_SYMBOLS = frozenset(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_VOWELS = re.compile("[aeiouyäöüáéíóúàèùâêîôûœæ]", re.IGNORECASE)
STATISTICS = 24


@lru_cache(1 << 14)
def _kinds(c: str) -> tuple[bool, bool, bool, bool, bool]:
    """Whether a character is a letter, upper case, a digit, a symbol, a vowel."""
    return c.isalpha(), c.isupper(), c.isdigit(), c in _SYMBOLS, _VOWELS.match(c) is not None


def statistics(text: str | None) -> np.ndarray:
    """Numbers that describe a whole text; defined for null and empty texts.

    Characters and words are counted first, and only distinct ones are looked at.
    """
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, n_words, n_lines = max(len(text), 1), max(len(words), 1), max(len(lines), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    characters, counts = Counter(text), Counter(words)
    letters = upper = digits = symbols = vowels = 0
    for c, times in characters.items():
        letter, capital, digit, symbol, vowel = _kinds(c)
        letters += letter * times
        upper += capital * times
        digits += digit * times
        symbols += symbol * times
        vowels += vowel * times
    ends = alphabetic = capitals = edged = 0
    for w, times in counts.items():
        if w.isalpha():
            alphabetic += times
        else:
            ends += (w[-1] in ".!?") * times
            edged += (not w[0].isalnum() or not w[-1].isalnum()) * times
        if w.isupper():
            capitals += times
    following = words[1:]
    pairs = len(set(zip(words, following, strict=False)))
    triples = len(set(zip(words, following, words[2:], strict=False)))
    top = max(counts.values(), default=0)
    p = np.fromiter(characters.values(), np.float64) / n if characters else np.ones(1)
    return np.array([
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)),
        lengths.mean(), lengths.std(), np.log1p(lengths.max()), letters / n, upper / max(letters, 1), digits / n, symbols / n,
        len(counts) / n_words, np.log1p(n_words / max(len(counts), 1)), top / n_words,
        1 - len(set(lines)) / n_lines, 1 - pairs / max(len(words) - 1, 1) if words else 0.0,
        1 - triples / max(len(words) - 2, 1) if len(words) > 2 else 0.0,
        ends / n_words, sum(x.rstrip()[-1] in ".!?\"'" for x in lines) / n_lines,
        np.log1p(len(words) / n_lines), alphabetic / n_words, capitals / n_words,
        vowels / max(letters, 1), -(p * np.log2(np.maximum(p, 1e-12))).sum(),
        edged / n_words,
    ])


@dataclass
class Model:
    """Standardisation, Fourier frequencies, ridge weights and the calibration curve."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return expanded((stats - self.mean) / self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0.0, 1.0)


def expanded(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel, the standardised statistics and a constant."""
    rng = np.random.default_rng(9)
    width = 1.5 * np.sqrt(STATISTICS)
    w, b = rng.normal(0, 1 / width, (STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip(z, -8, 8)
    return np.hstack([np.cos(z @ w + b) * np.sqrt(2 / FEATURES), z / 10, np.ones((len(z), 1))])


@pandas_udf(ArrayType(DoubleType()))
def _statistics(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts])


_SUMS = StructType([StructField("part", DoubleType()), StructField("sums", ArrayType(DoubleType()))])


def _summed(rows: DataFrame, of) -> np.ndarray:
    """Sum over all rows of the vector ``of(statistics, quality)``: within partitions, then over their few rows."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                part = of(np.array(batch["stats"].tolist()), batch["quality"].to_numpy(np.float64))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"part": [0.0], "sums": [total.tolist()]})

    parts = rows.mapInPandas(sums, _SUMS).collect()  # at most _PARTS rows of fixed size
    return np.sum([r["sums"] for r in parts], axis=0) if parts else np.zeros(0)


def _isotonic(weight: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: non-decreasing rates of ``hits / weight``."""
    blocks: list[list[float]] = []
    for w, h in zip(weight, hits, strict=True):
        blocks.append([w, h, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.repeat([b[1] / b[0] for b in blocks], [int(b[2]) for b in blocks])


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, ridge: float = RIDGE) -> Model | None:
    """A model of ``labels.quality``; None if no document has a label.

    Documents of the held-out fold (crc32 of the id as text, modulo ``FOLDS``, is 0) are never
    read. A document with several labels counts with their mean, rounded.
    """
    marks = labels.where("doc_id is not null AND quality is not null").groupBy("doc_id").agg(F.round(F.avg("quality")).alias("quality"))
    taught = marks.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    chosen = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # broadcast: TRAIN_ROWS ids and marks of 16 bytes at most, so that no text is shuffled but the sample's
    rows = keep(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition(_PARTS, F.xxhash64("doc_id"))
                .select("quality", _statistics(F.coalesce("text", F.lit(""))).alias("stats")))
    moments = _summed(rows, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]))
    if not len(moments):
        return None
    n = moments[0]
    mean = moments[2:2 + STATISTICS] / n
    scale = np.sqrt(np.maximum(moments[2 + STATISTICS:] / n - mean**2, 1e-12)) + 1e-9
    rate = moments[1] / n
    weight = (0.5 / max(1 - rate, 1e-3), 0.5 / max(rate, 1e-3))  # both classes count alike

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        e, w = expanded((x - mean) / scale), np.where(y > 0.5, weight[1], weight[0])
        return np.concatenate([(e.T @ (e * w[:, None])).ravel(), e.T @ (w * y)])

    sums = _summed(rows, normal)
    size = FEATURES + STATISTICS + 1
    gram, right = sums[:size * size].reshape(size, size), sums[size * size:]
    model = Model(mean, scale, np.linalg.solve(gram + ridge * n * np.eye(size), right), np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip((model.raw(x) + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)])

    counts = _summed(rows, binned)
    used = counts[:BINS] > 0
    model.knots = (np.flatnonzero(used) + 0.5) / BINS * 2 - 0.5
    model.levels = _isotonic(counts[:BINS][used], counts[BINS:][used])
    return model


def scored(text: Column, model: Model | None) -> Column:
    """Calibrated probability of label 1 for each text; 0.5 without a model. Null counts as empty."""
    if model is None:
        return F.lit(0.5)

    @pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts])) if len(texts) else [], dtype="float64")

    return score(F.coalesce(text, F.lit("")))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document.

    Repeated rows each get a row; a null doc_id is held out from nothing and gets a score too.
    Other columns are ignored. An empty table gives an empty result.
    """
    model = fit(docs, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), scored(F.col("text"), model).alias("score")).select(
        "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def of_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` whose score reaches the threshold, with all their columns."""
    return docs.where(scored(F.col("text"), fit(docs, labels)) >= threshold)


@query("op9_quality_classifier")
def op9(spark, folder):
    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
