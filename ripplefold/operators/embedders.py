"""What turns units into vectors: a seam for any embedder, and the built-in one of hashed shingles."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefold.operators import similarity
from ripplefold.sources.sinks import checked_width


class Embedder(Protocol):
    """Vectors are comparable only between the same ``name``, ``version`` and ``dimensions``."""

    name: str
    dimensions: int
    version: int

    def embed(self, units: DataFrame) -> DataFrame:
        """(unit, embedding) of ``units(unit, tokens)``; embeddings have unit length or are all zero."""


@dataclass(frozen=True)
class ShingleEmbedder:
    """Signed hashing of shingles, normalised; it asks no service and gives the same vectors everywhere."""

    dimensions: int = similarity.WIDTH
    name: str = "shingle-hash"
    version: int = 1

    def embed(self, units: DataFrame) -> DataFrame:
        prints = similarity.fingerprints(units, width=checked_width(self.dimensions))
        sparse = prints.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("int"), F.col("w").cast("double")))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w")).cast("double")).alias("length"))
        one = lambda i: (F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0.0)) / F.coalesce("length", F.lit(1.0))).cast("float")
        dense = F.transform(F.sequence(F.lit(0), F.lit(self.dimensions - 1)), one)
        return units.select("unit").distinct().join(sparse, "unit", "left").select("unit", dense.alias("embedding"))


def stored(embedder: Embedder, units: DataFrame) -> DataFrame:
    """(unit, embedding, embedder, fingerprint_version): vectors with what makes them comparable, checked for their width."""
    made = embedder.embed(units)
    fits = F.when(F.size("embedding") == embedder.dimensions, F.col("embedding")).otherwise(F.raise_error(F.lit(f"{embedder.name} must give {embedder.dimensions} numbers")))
    return made.select("unit", fits.alias("embedding"), F.lit(embedder.name).alias("embedder"), F.lit(embedder.version).alias("fingerprint_version"))


def dense_cosine(a, b):
    """Cosine of two dense columns; vectors of different width are an error, and one of length zero is like nothing."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(a, a) * dot(b, b))
    same = F.when(F.size(a) == F.size(b), F.when(length == 0, 0.0).otherwise(dot(a, b) / F.when(length == 0, 1.0).otherwise(length)))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.coalesce(same, F.raise_error(F.lit("vectors differ in width")).cast("double")))
