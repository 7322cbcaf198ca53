"""Helpers that the text operators share: words, written tables, registry of queries."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_shuffles, folder_of, shared_folder

WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

# tables written and not removed yet, by the caller they are kept for
_kept: dict[str, list[str]] = defaultdict(list)
_caller: ContextVar[str] = ContextVar("caller", default="")


def query(name: str, check: str | None = None):
    """Register ``fn(spark, folder) -> DataFrame`` under a name, with its check SQL if there is one."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keep(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    ``discard``, ``release`` of the caller it is kept for, or the end of the application removes it.
    ``compression`` is Parquet's, that of the session if not given.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/text/{uuid.uuid4().hex}"
    files, place = folder_of(spark, path)
    files.deleteOnExit(place)
    df.write.parquet(path, compression=compression)
    _kept[_caller.get()].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at, out.kept_for = path, _caller.get()
    return out


def discard(kept: DataFrame) -> None:
    """Remove a kept table that nothing will read again, and let Spark drop the shuffles behind tables already written."""
    spark = kept.sparkSession
    files, place = folder_of(spark, kept.kept_at)
    files.delete(place, True)
    _kept[kept.kept_for].remove(kept.kept_at)
    drop_shuffles(spark)


@contextmanager
def keeping_for(caller: str) -> Iterator[None]:
    """Tables kept inside are those of ``caller``, who may release them without touching others'."""
    token = _caller.set(caller)
    try:
        yield
    finally:
        _caller.reset(token)


def release(spark: SparkSession, caller: str) -> None:
    """Remove the tables kept for a caller, who has written every result that reads them."""
    while _kept[caller]:
        files, place = folder_of(spark, _kept[caller].pop())
        files.delete(place, True)


# a filter of at most 16 MB, for up to so many keys; of more keys it lets more rows through, which the join then drops
_FILTERS = {
    "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "256MB", "maxNumItems": "16000000", "maxNumBits": "134217728",
}


@contextmanager
def filtered_joins(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark may filter the large side of a join by a Bloom filter of the small side, at any table size."""
    names = {f"spark.sql.optimizer.runtime.bloomFilter.{k}": v for k, v in _FILTERS.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores in front until ``df`` has no such column, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; a lone surrogate becomes a question mark, as in the JVM."""
    return (text or "").encode("utf-8", "replace")


def lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space as UTF-8, A-Z lower-cased; none for null."""
    return utf8(text).translate(LOWER).split()


def sql_crc32(text: str) -> str:
    """Check SQL for the unsigned CRC-32 of an ASCII text expression."""
    eight = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    codes = f"list_transform(string_split({text}, ''), lambda x: unicode(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {eight}), 4294967295)"


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased, null as empty.

    Texts without other capitals, nearly all, take the fast built-in; the rest go character by character. A text of
    as many bytes as characters is ASCII and not searched for them.
    """
    given = F.coalesce(text, F.lit(""))
    slow = F.translate(given, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    others = (F.octet_length(given) > F.length(given)) & given.rlike(r"[[^\x00-\x7F]&&[\p{IsUppercase}\p{Lt}]]")
    return F.when(others, slow).otherwise(F.lower(given))


def words_of(text: Column) -> Column:
    """Words between ASCII white space, in order; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
