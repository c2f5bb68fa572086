"""Joins and look-ups that a hot key does not hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_salted(rows: DataFrame, table: DataFrame, key: str, by: str, counts: DataFrame | None = None, least: int = 256, most: int = 1 << 16) -> DataFrame:
    """``rows`` joined on ``key`` to ``table``, which has one row a key; the rows of a hot key are dealt to several tasks.

    A key with ``least`` rows or more is hot and takes a part for each ``least`` of them; ``by`` deals its rows, and its row of ``table``
    is copied to each part.  Only the hot keys and their numbers of parts are broadcast, ``most`` of them at most (the hottest;
    any other has less than a share of 1 / ``most`` of all rows).  ``counts(key, n)`` spares counting; ``rows`` are read
    twice without it.
    """
    n = counts if counts is not None else rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = n.filter(F.col("n") >= least).orderBy(F.desc("n"), key).limit(most).select(key, F.ceil(F.col("n") / least).cast("int").alias("_parts"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts").cast("long")), F.lit(0).cast("long"))).drop("_parts")
    copied = table.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts"), F.lit(1)).cast("long") - 1))).drop("_parts")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def hinted(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows (which are counted), else as it is; for stored tables of narrow rows."""
    return F.broadcast(df) if df.count() <= most else df


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as keep it apart from ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out
