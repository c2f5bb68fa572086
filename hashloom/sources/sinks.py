"""Sinks: CSV results, prefetch files, signature JSON, zip archives, manifests, cluster tables and text reports."""

from __future__ import annotations

import gzip
import io
import json
import os
import sys
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hashloom.functions.hashing import max_hash, unsigned
from hashloom.functions.metrics import ident
from hashloom.model import Sketches
from hashloom.operators import cluster as C

#: Names that an exchange format fixes and its readers may ask for: pass a changed copy to the writers to match them.
FORMAT = {"class": "signature", "manifest_title": "# MANIFEST-VERSION: 1.0", "manifest_member": "MANIFEST.csv"}


def write_csv(df: DataFrame, path: str | None, single: bool = False) -> None:
    """Results as CSV: a folder written in parallel; with ``single`` (or no path: standard output) one file streamed by the driver."""
    if path and not single:
        df.write.mode("overwrite").option("header", True).csv(path)
        return
    out = open(path, "w", newline="") if path else sys.stdout
    try:
        import csv

        w, first = csv.writer(out, lineterminator="\n"), True
        for row in df.toLocalIterator():
            if first:
                w.writerow(df.columns)
                first = False
            w.writerow(["" if v is None else str(v).lower() if isinstance(v, bool) else v for v in row])
    finally:
        if path:
            out.close()


def write_prefetch(df: DataFrame, path: str, by_query: bool = False) -> None:
    """Prefetch rows, names quoted; ``by_query`` makes a folder for each query, so equal short names do not collide."""
    out = df.withColumn("query", ident(F.col("query_name"))) if by_query else df
    w = out.write.mode("overwrite").option("header", True).option("quoteAll", True)
    (w.partitionBy("query") if by_query else w).csv(path)


def signature_rows(sk: Sketches) -> DataFrame:
    """Manifest rows with ``mins`` and ``abunds`` in unsigned order; what is collected is one sketch at a time."""
    cells = sk.postings.groupBy("sketch_id").agg(F.array_sort(F.collect_list(F.struct(unsigned(F.col("hash")).alias("m"), F.col("abund").alias("a")))).alias("c"))
    return sk.manifest.join(cells, "sketch_id", "left").select("*", F.transform(F.coalesce("c", F.array().cast("array<struct<m:decimal(20,0),a:bigint>>")), lambda x: x["m"]).alias("mins"), F.transform("c", lambda x: x["a"]).alias("abunds")).drop("c")


def signature(r, names: dict = FORMAT) -> dict:
    """One manifest row with its hashes as a signature object."""
    s = {"num": r["num"], "ksize": r["ksize_nt"], "seed": 42, "max_hash": max_hash(r["scaled"]) if r["scaled"] else 0, "mins": [int(m) for m in r["mins"]], "md5sum": r["md5"], "molecule": "dna" if r["moltype"] == "DNA" else r["moltype"]}
    if r["with_abundance"]:
        s["abundances"] = list(r["abunds"] or [])
    return {"class": names["class"], "email": "", "hash_function": "0.murmur64", "filename": r["filename"] or "", "name": r["name"] or "", "license": "CC0", "version": 0.4, "signatures": [s]}


def write_signatures(sk: Sketches, path: str, names: dict = FORMAT) -> None:
    """All sketches in one JSON file, streamed row by row (gzip by its name; ``-`` is standard output)."""
    body = (json.dumps(signature(r, names)) for r in signature_rows(sk).toLocalIterator())
    out = sys.stdout if path == "-" else gzip.open(path, "wt") if path.endswith(".gz") else open(path, "w")
    try:
        out.write("[")
        for k, text in enumerate(body):
            out.write("," * bool(k) + text)
        out.write("]")
    finally:
        if path != "-":
            out.close()


def manifest_rows(sk: Sketches) -> DataFrame:
    """The manifest in its interchange columns; equal md5s get numbered locations."""
    again = F.row_number().over(Window.partitionBy("md5").orderBy("name", "sketch_id")) - 1
    place = F.concat(F.lit("signatures/"), F.col("md5"), F.when(F.col("_n") > 0, F.concat(F.lit("_"), F.col("_n").cast("string"))).otherwise(""), F.lit(".sig.gz"))
    return sk.manifest.withColumn("_n", again).select(
        "sketch_id", place.alias("internal_location"), "md5", F.substring("md5", 1, 8).alias("md5short"), "ksize", "moltype", "num", "scaled", "n_hashes", F.col("with_abundance").cast("int").alias("with_abundance"), "name", "filename"
    )


def manifest_text(rows: DataFrame, names: dict = FORMAT) -> Iterator[str]:
    import csv

    yield names["manifest_title"] + "\n"
    columns = [c for c in rows.columns if c != "sketch_id"]
    for row in [columns, *([r[c] for c in columns] for r in rows.orderBy("internal_location").toLocalIterator())]:
        buf = io.StringIO()
        csv.writer(buf, lineterminator="\n").writerow(["" if v is None else v for v in row])
        yield buf.getvalue()


def write_manifest(sk: Sketches, path: str, names: dict = FORMAT) -> None:
    with open(path, "w", newline="") as f:
        f.writelines(manifest_text(manifest_rows(sk), names))


def write_zip(sk: Sketches, path: str, names: dict = FORMAT) -> None:
    """A zip archive for exchange: a gzip JSON member for each sketch, then the manifest."""
    if not path.endswith(".zip"):
        raise ValueError("Output must be a zip file.")
    rows = manifest_rows(sk)
    placed = signature_rows(sk).join(rows.select("sketch_id", "internal_location"), "sketch_id")
    with zipfile.ZipFile(path + ".part", "w", zipfile.ZIP_STORED) as z:
        for r in placed.toLocalIterator():
            z.writestr(r["internal_location"], gzip.compress(json.dumps([signature(r, names)]).encode(), mtime=0))
        z.writestr(names["manifest_member"], "".join(manifest_text(rows, names)))
    os.replace(path + ".part", path)


def write_saved_matches(matches: DataFrame, path: str) -> None:
    """``(query_id, hash)`` rows, a folder for each query."""
    matches.write.mode("overwrite").partitionBy("query_id").parquet(path)


def write_clusters(clusters: DataFrame, path: str, sizes_path: str | None = None) -> None:
    C.members(clusters).write.mode("overwrite").option("header", True).csv(path)
    if sizes_path:
        C.sizes(clusters).write.mode("overwrite").option("header", True).csv(sizes_path)


def tenths(value: Column) -> Column:
    """A double of 0 or more as text with one decimal: the nearest to its exact binary value, a tie to the even digit, as C's printf does.

    Spark's own format rounds the shortest decimal text half up (6.25 to 6.3).  The rest below one is split in two, so that its distance to the
    middle between two tenths is exact; from 2^50 on, where no tenths are left to round, Spark's format is used.
    """
    whole = F.floor(value)
    rest = value - whole
    high = F.floor(rest * (1 << 26)) / (1 << 26)
    digit = F.floor(rest * 10)
    past = (high * 20 - (digit * 2 + 1)) + (rest - high) * 20  # its sign is exact
    up = (past > 0) | ((past == 0) & (digit % 2 == 1))
    n = whole * 10 + digit + F.when(up, 1).otherwise(0)
    text = F.concat(((n - n % 10) / 10).cast("bigint").cast("string"), F.lit("."), (n % 10).cast("string"))
    return F.when((value >= 0) & (value < float(1 << 50)), text).otherwise(F.format_string("%.1f", value))


def pretty(results: DataFrame) -> DataFrame:
    """Manysearch results as aligned text lines, by query name."""
    name, percent = F.substring("query_name", 1, 17), tenths(F.col("containment") * 100)
    # a null has a text of its own when it is formatted
    weighted = F.when(F.col("average_abund").isNull(), "N/A").otherwise(tenths(F.col("average_abund")))
    share = F.when(F.col("f_weighted_target_in_query").isNull(), "N/A").otherwise(F.concat(tenths(F.col("f_weighted_target_in_query") * 100), F.lit("%")))
    return results.orderBy("query_name", "match_name").select(F.format_string("%-17s %6s%%  %6s     %6s     %s", name, percent, weighted, share, F.col("match_name")).alias("line"))
