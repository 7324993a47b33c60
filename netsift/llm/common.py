"""Shared pieces of the training-data operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null: white space becomes one blank, then word starts are counted."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_count(spaced, F.lit("[^ ]+")).cast("long")


def text_digest(text: Column) -> Column:
    """128 bits of SHA-256; null stays null."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def salted_join(many: DataFrame, few: DataFrame, on: list[str], spread: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join with ``few`` (at most one row per key) when one key may hold a large part of ``many``: the
    rows of a key are dealt over ``salts`` by the hash of column ``spread``, ``few`` is repeated.

    ``few`` is repeated by a join, whose size Spark multiplies out. Behind an ``explode`` its estimate would
    hold one copy, and a table somewhat below the broadcast threshold would go to the driver ``salts`` times."""
    dealt = many.withColumn("salt__", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    numbers = few.sparkSession.range(0, salts, 1, 1).select(F.col("id").cast("int").alias("salt__"))
    return dealt.join(few.crossJoin(numbers), [*on, "salt__"], how).drop("salt__")


def free_name(base: str, taken: list[str]) -> str:
    """A column name that none of ``taken`` has, compared as Spark does, without case."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


def docs_of(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, so extra columns never clash with working names."""
    return df.select(*[F.col(c) for c in columns])
