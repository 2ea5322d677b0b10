"""Exact search of a stated set of query vectors in a store, block against block.

Vectors of a group are packed into blocks; every query block meets every store block of its group and gives the
best k of it by one matrix product, so what travels is blocks, and what comes out is k rows per query and block.
The stores' blocks of a group are dealt to several parts and the query blocks, which are few, copied to each, so a
group that holds most vectors is still spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors to a block, and parts to which a group's store blocks are dealt.
BLOCK = 2048
PARTS = 16


def _blocks(df: DataFrame, key: str, by: list[str], scope: str, vector: str) -> DataFrame:
    """(g, ids, scopes, data): unit vectors of one group packed by the partition they are read in."""
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(vector, lambda e: e != 0)
    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite).select(F.to_json(F.struct(*by, F.size(vector).alias("_n"))).alias("g"), F.col(key).cast("long").alias("id"), F.xxhash64(scope).alias("s"), F.col(vector).cast("array<float>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.array(batch.column(0).to_pylist(), dtype=object)
            for g in sorted(set(groups)):
                at = np.flatnonzero(groups == g)
                for part in (at[i : i + BLOCK] for i in range(0, len(at), BLOCK)):
                    x = batch.column(3).take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1).astype(np.float64)
                    x /= np.linalg.norm(x, axis=1)[:, None]
                    ids, scopes = (batch.column(c).take(pa.array(part)).to_numpy() for c in (1, 2))
                    yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([ids.astype(np.int64).tobytes()]), pa.array([scopes.astype(np.int64).tobytes()]), pa.array([x.tobytes()], pa.binary())], ["g", "ids", "scopes", "data"])

    return rows.mapInArrow(run, "g string, ids binary, scopes binary, data binary")


def _best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qs, q, si, ss, s in zip(*(batch.column(i).to_pylist() for i in range(6))):
                qids, qscopes, sids, sscopes = (np.frombuffer(x, dtype=np.int64) for x in (qi, qs, si, ss))
                sims = np.frombuffer(q).reshape(len(qids), -1) @ np.frombuffer(s).reshape(len(sids), -1).T
                sims = np.where(qscopes[:, None] == sscopes[None, :], -2.0, sims)
                worst = np.partition(sims, -min(k, len(sids)), axis=1)[:, -min(k, len(sids)), None]
                rows, cols = np.nonzero((sims >= worst - 1e-12) & (sims > -1.5))  # the best k of each query and their ties
                order = np.lexsort((sids[cols], -np.round(sims[rows, cols], 12), rows))
                rows, cols = rows[order], cols[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                rows, cols = rows[place < k], cols[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(qids[rows]), pa.array(sids[cols]), pa.array(sims[rows, cols])], ["query", "other", "similarity"])

    return run


def search(queries: DataFrame, store: DataFrame, key: str, by: list[str], scope: str, vector: str, k: int = 3, least: float = 0.85, parts: int = PARTS) -> DataFrame:
    """(query, other, similarity, r): the k nearest stored vectors of another scope, then those of ``least`` or more.

    Only equal group columns and lengths meet. The k nearest are taken before the threshold. Ties go to the
    smaller id; similarities are compared at twelve places.
    """
    q = _blocks(queries, key, by, scope, vector).select("g", F.col("ids").alias("qi"), F.col("scopes").alias("qs"), F.col("data").alias("q"))
    copied = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = _blocks(store, key, by, scope, vector).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    met = copied.join(dealt, ["g", "part"]).select("qi", "qs", "q", "ids", "scopes", "data")
    found = met.mapInArrow(_best(k), "query bigint, other bigint, similarity double")
    order = W.partitionBy("query").orderBy(F.desc(F.round("similarity", 12)), "other")
    return found.withColumn("r", F.row_number().over(order)).where((F.col("r") <= k) & (F.col("similarity") >= least))
