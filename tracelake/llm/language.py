"""Language identification: known words first, shorter and shorter character n-grams for the others.

Training counts words and character n-grams per language over all documents it may learn from,
in Spark. A model keeps, of each language, the ``WORDS`` most frequent words and the ``GRAMS`` most
frequent n-grams of each length, with their frequencies in all languages: that bounds its size per language,
not the documents it counts, and a small language keeps its own pieces however large others grow. A word
that the model knows adds its log frequency in each language. An unknown word falls back to its
n-grams: at each place the longest known one counts, from ``LONGEST`` down to 1 letters.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import keep, query, table

WORDS = 20_000
GRAMS = 5_000
LONGEST = 4
FOLDS, HELD_OUT = 4, 2
SMOOTH = 0.5
UNKNOWN = "und"
_FLUSH, _HELD = 300_000, 50_000_000  # pieces counted and characters read before counts leave a task
_SEEN, _SHORT = 200_000, 64  # pieces remembered while predicting, and their length

_RUN = re.compile(r"[^\W\d_]+")


def words_in(piece: str) -> list[str]:
    """Runs of letters of a piece; numerals such as fractions and Roman numbers are no letters."""
    found = _RUN.findall(piece)
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def windows_of(word: str) -> list[str]:
    """``LONGEST`` or, at the end, fewer characters from each place of a word between borders."""
    padded = f"<{word}>"
    return [padded[i:i + LONGEST] for i in range(len(padded))]


def pieces_of(text: str | None) -> Counter:
    """What stands between white space in a whole text, lower-cased, with counts.

    A word is a run of letters and never crosses white space, so each distinct piece is searched
    for words once, however often it occurs.
    """
    return Counter((text or "").lower().split())


_COUNTS = "lang string, size int, piece string, n long"


def _counts_of(pieces: dict[str, Counter]) -> pd.DataFrame:
    """Rows of words (size 0) and n-grams for counted pieces per language."""
    langs, sizes, found, numbers = [], [], [], []
    for lang, counts in pieces.items():
        words: dict[str, int] = defaultdict(int)
        for piece, n in counts.items():
            for word in words_in(piece):
                words[word] += n
        # n-grams of all lengths are the starts of the windows at each place: words touch one count a place
        windows: dict[str, int] = defaultdict(int)
        for word, n in words.items():
            for window in windows_of(word):
                windows[window] += n
        by_size = [words, *(defaultdict(int) for _ in range(LONGEST))]
        for window, n in windows.items():
            for size in range(1, len(window) + 1):
                by_size[size][window[:size]] += n
        for size, grams in enumerate(by_size):
            langs += [lang] * len(grams)
            sizes += [size] * len(grams)
            found += grams.keys()
            numbers += grams.values()
    return pd.DataFrame({
        "lang": pd.Series(langs, dtype="object"), "size": pd.Series(sizes, dtype="int32"),
        "piece": pd.Series(found, dtype="object"), "n": pd.Series(numbers, dtype="int64")})


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts within a partition, flushed before they grow large."""
    pieces: dict[str, Counter] = {}
    held = 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            pieces.setdefault(lang, Counter()).update(text.lower().split())
            held += len(text)
            if held > _HELD or sum(map(len, pieces.values())) > _FLUSH:
                yield _counts_of(pieces)
                pieces, held = {}, 0
    if pieces:
        yield _counts_of(pieces)


@dataclass
class Model:
    """Log frequencies per language: a row of ``logs`` for each known word and n-gram."""

    langs: list[str] = field(default_factory=list)
    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


class Reader:
    """Applies a model to texts and remembers what words and short pieces add, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        # log frequencies of a piece and number of its words; the model's own rows come first
        self.sums = np.hstack([model.logs, np.ones((len(model.logs), 1))]) if model.langs else model.logs
        self._forget()

    def _forget(self) -> None:
        self.at, self.longest, self.used = dict(self.model.words), {}, len(self.model.logs)

    def _rows(self, parts: list[list[int]], mean: bool, none: list[float]) -> range:
        """New rows, each the sum or mean of the rows of a part; ``none`` for a part of no rows."""
        first = self.used
        self.used += len(parts)
        while self.used > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        new = np.tile(np.array(none), (len(parts), 1))
        sizes = np.fromiter(map(len, parts), int, len(parts))
        full = sizes > 0
        if full.any():
            starts = (np.cumsum(sizes) - sizes)[full]
            found = np.add.reduceat(self.sums[list(chain.from_iterable(parts))], starts, axis=0)
            new[full] = found / sizes[full, None] if mean else found
        self.sums[first:self.used] = new
        return range(first, self.used)

    def _gram(self, window: str) -> int | None:
        """The longest known n-gram at the start of a window of ``LONGEST`` or fewer characters."""
        if window not in self.longest:
            known = self.model.grams
            self.longest[window] = next((known[window[:n]] for n in range(len(window), 0, -1) if window[:n] in known), None)
        return self.longest[window]

    def _words(self, words: list[str]) -> dict[str, int]:
        """Rows of unknown words: the mean of the longest known n-grams at their places."""
        parts, longest = [], self.longest
        for word in words:
            grams = [longest[window] if window in longest else self._gram(window) for window in windows_of(word)]
            parts.append([gram for gram in grams if gram is not None])
        return dict(zip(words, self._rows(parts, True, [0.0] * len(self.model.langs) + [1.0]), strict=True))

    def _pieces(self, pieces: list[str]) -> dict[str, int]:
        """Rows of pieces that were not met yet, found together; short ones are remembered, with their words."""
        inside = {piece: words_in(piece) for piece in pieces}
        new = self._words([w for w in dict.fromkeys(chain.from_iterable(inside.values())) if w not in self.at])
        self.at.update((word, at) for word, at in new.items() if len(word) <= _SHORT)
        row = lambda word: new[word] if word in new else self.at[word]
        rows = {piece: row(words[0]) for piece, words in inside.items() if len(words) == 1}
        others = [piece for piece in pieces if piece not in rows]
        sums = self._rows([list(map(row, inside[piece])) for piece in others], False, [0.0] * (len(self.model.langs) + 1))
        rows.update(zip(others, sums, strict=True))
        self.at.update((piece, at) for piece, at in rows.items() if len(piece) <= _SHORT)
        return rows

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its share of the posterior; ``und`` and 0 for a text without a letter."""
        counts = pieces_of(text)
        if not counts or not self.model.langs:
            return UNKNOWN, 0.0
        if self.used > len(self.model.logs) + _SEEN or len(self.longest) + len(self.at) > len(self.model.words) + 4 * _SEEN:
            self._forget()
        rows = list(map(self.at.get, counts))
        if None in rows:
            new = self._pieces([piece for piece, at in zip(counts, rows, strict=True) if at is None])
            rows = [new[piece] if at is None else at for piece, at in zip(counts, rows, strict=True)]
        *total, words = np.fromiter(counts.values(), float, len(counts)) @ self.sums[rows]
        if not words:
            return UNKNOWN, 0.0
        # words of a text depend on each other: the evidence of a text grows with the root of its length
        total = np.array(total) / math.sqrt(words)
        odds = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.model.langs[best], float(odds[best] / odds.sum())


def fit(docs: DataFrame) -> Model:
    """A model of ``docs(text, lang)``, all of them; rows with a null language or text teach nothing."""
    taught = docs.where("lang is not null AND text is not null").select("lang", "text")
    counts = keep(
        taught.mapInPandas(_counted, _COUNTS).groupBy("lang", "size", "piece").agg(F.sum("n").alias("n"))
    )
    totals = counts.groupBy("lang", "size").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
    langs = sorted({r["lang"] for r in totals})
    if not langs:
        return Model()
    at = {lang: i for i, lang in enumerate(langs)}
    model, logs = Model(langs), []
    for size in range(LONGEST + 1):
        base = np.full(len(langs), 1.0)
        for r in totals:
            if r["size"] == size:
                base[at[r["lang"]]] = r["n"] + SMOOTH * r["kinds"]
        rows = counts.where(F.col("size") == size)
        # each task cuts its pieces to the wanted number of each language before any move
        ranked = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "piece"))
        wanted = rows.withColumn("rank", ranked).where(F.col("rank") <= (WORDS if size == 0 else GRAMS)).select("piece").distinct()
        kept = keep(
            rows.join(wanted, "piece").groupBy("piece").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).orderBy("piece"))
        target = model.words if size == 0 else model.grams
        for r in kept.collect():  # the model: a fixed number of rows per language
            n = np.full(len(langs), SMOOTH)
            for lang, c in r["by"].items():
                n[at[lang]] += c
            target[r["piece"]] = len(logs)
            logs.append(np.log(n / base))
    model.logs = np.array(logs).reshape(-1, len(langs))
    return model


_SAID = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def predicted(text: Column, model: Model) -> Column:
    """``struct(lang_pred, score)`` of a whole text. The model travels with the function; its parameters bound its size."""

    @pandas_udf(_SAID)
    def say(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader(model)
        for texts in batches:
            yield pd.DataFrame([reader.predict(t) for t in texts], columns=["lang_pred", "score"])

    return say(text)


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per document.

    Documents whose crc32 of the id as text is ``HELD_OUT`` modulo ``FOLDS`` teach nothing. A null
    doc_id is not held out. Text alone decides a prediction; null or letterless texts give ``und``
    with score 0, as does every text if nothing can be learned. Repeated rows each get a row.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    model = fit(docs.where(~held))
    return docs.select("doc_id", held.alias("held_out"), predicted(F.col("text"), model).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score")


@query("op8_language_id")
def op8(spark, folder):
    return languages(table(spark, folder, "documents"))
