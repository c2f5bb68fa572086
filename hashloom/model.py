"""The engine's two tables.

A collection of sketches is a manifest (one row for each sketch) and postings (one row for each sketch and
hash).  Hashes are 64-bit patterns kept in a signed BIGINT; equality, joins and grouping need no more, and the
few operations that depend on unsigned order go through the helpers in :mod:`hashloom.functions.hashing`.
The same operators serve k-mers, text shingles and any keyed table.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.functions.hashing import at_most

MANIFEST = (
    "sketch_id string, name string, md5 string, filename string, location string, moltype string, ksize int, ksize_nt int, "
    "scaled int, num int, with_abundance boolean, n_hashes bigint"
)
POSTINGS = "sketch_id string, hash bigint, abund bigint"
MULTI_SELECTION = {"dna": ("DNA", "skipm1n3", "skipm2n3"), "protein": ("protein", "dayhoff", "hp")}
TRIPLED = ("protein", "dayhoff", "hp")


@dataclass(frozen=True)
class Sketches:
    """``manifest`` and ``postings`` of a collection; ``bits`` is the width of its hash space."""

    manifest: DataFrame
    postings: DataFrame
    bits: int = 64

    @property
    def spark(self) -> SparkSession:
        return self.manifest.sparkSession

    def select(self, ksize: int | None = None, moltype: str | None = None, scaled: int | None = None, abund: bool | None = None, num: int | None = None) -> Sketches:
        """Sketches that fit, downsampled to ``scaled``; a sketch coarser than ``scaled`` is left out."""
        m = self.manifest
        if ksize is not None:
            m = m.filter(F.col("ksize") == ksize)
        if moltype is not None:
            m = m.filter(F.lower("moltype") == moltype.lower())
        if abund is not None:
            m = m.filter(F.col("with_abundance") == abund)
        if num is not None:
            m = m.filter(F.col("num") == num)
        if scaled is not None:
            m = m.filter((F.col("scaled") != 0) & (F.col("scaled") <= scaled))
        p = self.postings
        if m is not self.manifest:
            p = p.join(m.select("sketch_id"), "sketch_id", "left_semi")
        if scaled is not None:
            p = p.filter(at_most(F.col("hash"), scaled, self.bits))
            m = m.withColumn("scaled", F.lit(scaled))
        return replace(self, manifest=m, postings=p)

    def any_of(self, input_moltype: str) -> Sketches:
        """Sketches of all molecule types that an input of ``input_moltype`` (dna or protein) can give."""
        m = self.manifest.filter(F.col("moltype").isin(*MULTI_SELECTION[input_moltype.lower()]))
        return replace(self, manifest=m, postings=self.postings.join(m.select("sketch_id"), "sketch_id", "left_semi"))

    def max_scaled(self) -> int | None:
        return self.manifest.agg(F.max("scaled")).first()[0]

    def min_max_scaled(self) -> tuple[int | None, int | None]:
        return tuple(self.manifest.agg(F.min("scaled"), F.max("scaled")).first())

    def first(self) -> DataFrame:
        """The manifest row of the first sketch by id."""
        return self.manifest.orderBy("sketch_id").limit(1)

    def union(self, other: Sketches) -> Sketches:
        return replace(self, manifest=self.manifest.unionByName(other.manifest), postings=self.postings.unionByName(other.postings))

    def in_manifest(self, picked: DataFrame) -> Sketches:
        """Sketches whose (name, md5) is in ``picked``."""
        m = self.manifest.join(picked.select("name", "md5").distinct(), ["name", "md5"], "left_semi")
        return replace(self, manifest=m, postings=self.postings.join(m.select("sketch_id"), "sketch_id", "left_semi"))

    def not_in_manifest(self, other: DataFrame) -> Sketches:
        """Sketches whose name and parameters are not in ``other``."""
        key = ["name", "moltype", "ksize", "scaled", "num", "with_abundance"]
        m = self.manifest.join(other.select(*key).distinct(), key, "left_anti")
        return replace(self, manifest=m, postings=self.postings.join(m.select("sketch_id"), "sketch_id", "left_semi"))

    def parameters(self) -> DataFrame:
        """Distinct sketch parameters."""
        return self.manifest.select("ksize", "moltype", "with_abundance", "num", "scaled").distinct()

    def sizes(self) -> DataFrame:
        """``(sketch_id, n, total, square)``: distinct hashes, their abundances and the squares' sum; 0 for empty sketches."""
        got = self.postings.groupBy("sketch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("abund").alias("total"), F.sum(F.col("abund") * F.col("abund")).alias("square"))
        return self.manifest.select("sketch_id").join(got, "sketch_id", "left").na.fill(0, ["n", "total", "square"])


def from_rows(rows: DataFrame, id_col: str, hash_col: str, name: str | None = None, abund: bool = True, bits: int = 64, moltype: str = "DNA", ksize: int = 31, scaled: int = 1, keep: DataFrame | None = None) -> Sketches:
    """A collection from any table of (id, hash) rows; repeated rows make the abundance.

    ``keep`` may give all ids, so that those without a row become empty sketches.  Nulls in either column are left out.
    """
    postings = rows.select(F.col(id_col).alias("sketch_id"), F.col(hash_col).cast("bigint").alias("hash")).filter("sketch_id is not null and hash is not null")
    postings = postings.groupBy("sketch_id", "hash").agg(F.count(F.lit(1)).alias("abund"))
    if not abund:
        postings = postings.withColumn("abund", F.lit(1).cast("bigint"))
    ids = (keep.select(F.col(id_col).alias("sketch_id")) if keep is not None else rows.select(F.col(id_col).alias("sketch_id"))).filter("sketch_id is not null").distinct()
    text = F.col("sketch_id").cast("string")
    manifest = ids.select(
        "sketch_id",
        (F.concat(F.lit(name), text) if name else text).alias("name"),
        F.md5(text.cast("binary")).alias("md5"),
        F.lit(None).cast("string").alias("filename"),
        F.lit(None).cast("string").alias("location"),
        F.lit(moltype).alias("moltype"),
        F.lit(ksize).alias("ksize"),
        F.lit(ksize * 3 if moltype in TRIPLED else ksize).alias("ksize_nt"),
        F.lit(scaled).alias("scaled"),
        F.lit(0).alias("num"),
        F.lit(abund).alias("with_abundance"),
        F.lit(None).cast("bigint").alias("n_hashes"),
    )
    return Sketches(manifest, postings, bits)
