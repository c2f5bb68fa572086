"""CSV files that list samples: assemblies, reads, or path prefixes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLAVOURS = {
    ("name", "genome_filename", "protein_filename"): "assembly",
    ("name", "read1", "read2"): "reads",
    ("name", "input_moltype", "prefix", "exclude"): "prefix",
}


def duplicates(paths: DataFrame) -> DataFrame:
    """``(path, n)`` of the paths that appear more than once."""
    return paths.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def matching(spark: SparkSession, prefix: str) -> set[str]:
    """Files whose path starts with ``prefix``, a glob, on any store that Spark reads; local paths come without their scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{prefix}*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return {re.sub("^file:/+", "/", s.getPath().toString()) for s in found if s.isFile()}


def read_fromfile(spark: SparkSession, path: str, force: bool = False) -> DataFrame:
    """``(name, input_moltype, paths)`` for each sample; whole repeated rows count once.

    The header says which kind of file it is.  An empty cell is skipped, an empty ``exclude`` excludes nothing.  Paths that
    several rows of a prefix file share are an error unless ``force``.
    """
    table = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    flavour = FLAVOURS.get(tuple(table.columns))
    if flavour is None:
        raise ValueError(f"Invalid header: {','.join(table.columns)}")
    rows = table.dropDuplicates()
    if flavour == "assembly":
        cells = F.array(*[F.struct(F.lit(kind).alias("input_moltype"), F.col(c).alias("path")) for kind, c in (("dna", "genome_filename"), ("protein", "protein_filename"))])
        return rows.select("name", F.explode(cells).alias("c")).filter("c.path is not null").select("name", "c.input_moltype", F.array("c.path").alias("paths"))
    if flavour == "reads":
        return rows.select("name", F.lit("dna").alias("input_moltype"), F.array_compact(F.array("read1", "read2")).alias("paths"))
    out = []
    for r in rows.collect():  # a list of globs is a driver-side table
        if (r["input_moltype"] or "").lower() not in ("dna", "protein"):
            raise ValueError(f"Invalid 'input_moltype' field value: {r['input_moltype']}")
        found = matching(spark, r["prefix"]) - (matching(spark, r["exclude"]) if r["exclude"] else set())
        if found:
            out.append((r["name"], r["input_moltype"].lower(), sorted(found)))
    samples = spark.createDataFrame(out, "name string, input_moltype string, paths array<string>")
    if not force and not duplicates(samples.select(F.explode("paths").alias("path"))).isEmpty():
        raise ValueError("Duplicated FASTA files found. Please use --force to bypass this check.")
    return samples
