"""Vector top-k (V1-V4).

The corpus is the large side. A query set of a checked size is broadcast, and
every task keeps its best ``k`` for each query while its vectors pass, so only
k rows a query and task are shuffled. A larger query set is dealt by blocks
over tiles of its scope's vectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "inner_product")
QUERY_BLOCK, VECTOR_TILE = 512, 8192
#: Query numbers (queries times dimensions) up to which they are broadcast: 32 MB.
BROADCAST_NUMBERS = 4_000_000


def score_pairs(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Higher is better: cosine similarity, minus distance, or dot product. A zero vector has no cosine."""
    dot = q @ v.T
    if metric == "inner_product":
        return dot
    qq, vv = (q * q).sum(1), (v * v).sum(1)
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return dot / np.sqrt(qq[:, None] * vv[None, :])
    return -np.sqrt(np.maximum(qq[:, None] + vv[None, :] - 2 * dot, 0))


def scored(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Scores rounded to 6 places; no score is the lowest."""
    s = np.round(score_pairs(metric, q, v), 6)
    return np.where(np.isnan(s), -np.inf, s)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` of each row of ``score``; equal scores go by id. ``ids``: of the columns, or of each cell."""
    if ids.ndim == 1:
        by_id = np.argsort(ids, kind="stable")
        score, ids = score[:, by_id], np.broadcast_to(ids[by_id], score.shape)
    else:
        by_id = np.argsort(ids, axis=1, kind="stable")
        score, ids = np.take_along_axis(score, by_id, 1), np.take_along_axis(ids, by_id, 1)
    top = np.argsort(-score, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(score, top, 1), np.take_along_axis(ids, top, 1)


def _rows(query_ids: np.ndarray, score: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    value = score.ravel()
    return pd.DataFrame({"query_id": np.repeat(query_ids, score.shape[1]), "chunk_id": ids.ravel(), "score": np.where(np.isneginf(value), np.nan, value)})


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", by: str | Sequence[str] | None = None, query_id: str = "query_id", chunk_id: str = "chunk_id") -> DataFrame:
    """Best ``k`` of ``vectors`` (chunk_id, embedding, the columns ``by``) for each of ``queries`` (query_id, embedding, the same), within equal ``by``.

    Returns query_id, chunk_id, score, rank; equal scores go by chunk id. Scores
    are rounded to 6 places before they are ranked. ``by`` may name any columns,
    such as index_id and embed_signature; a null there matches nothing. Only
    vectors of the query's length are compared, and none that is null, empty or
    holds nulls: ``check_dims`` (E5) reports indexes where lengths differ.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    by = [by] if isinstance(by, str) else list(by or ())
    spark = queries.sparkSession
    schema = f"query_id {queries.schema[query_id].dataType.simpleString()}, chunk_id {vectors.schema[chunk_id].dataType.simpleString()}, score double"
    # one text that is equal where all columns and the lengths are: vectors of another length are not compared
    scope = F.to_json(F.array(*[F.col(c).cast("string") for c in by], F.size("embedding").cast("string")))
    known = lambda df: df.where(" AND ".join(["size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL)", *[f"`{c}` IS NOT NULL" for c in by]]))
    q = known(queries).select(F.col(query_id).alias("query_id"), F.col("embedding").cast("array<double>").alias("e"), scope.alias("s"))
    v = known(vectors).select(F.col(chunk_id).alias("chunk_id"), F.col("embedding").cast("array<double>").alias("e"), scope.alias("s"))
    if k <= 0:
        return q.select("query_id").join(v.select("chunk_id"), F.lit(False)).select("query_id", "chunk_id", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    if (q.agg(F.sum(F.size("e"))).first()[0] or 0) <= BROADCAST_NUMBERS:
        asked: dict[str, tuple] = {}
        for s, g in q.orderBy("query_id").toPandas().groupby("s"):
            asked[s] = (g["query_id"].to_numpy(), np.stack(g["e"].to_list()))
        known_queries = spark.sparkContext.broadcast(asked)

        def pass_by(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            for b in batches:
                for s, g in b.groupby("s"):
                    if s not in known_queries.value:
                        continue
                    score, ids = best(scored(metric, known_queries.value[s][1], np.stack(g["e"].to_list())), g["chunk_id"].to_numpy(), k)
                    if s in held:
                        score, ids = best(np.hstack([held[s][0], score]), np.hstack([held[s][1], ids]), k)
                    held[s] = (score, ids)
            for s, (score, ids) in held.items():
                yield _rows(known_queries.value[s][0], score, ids)

        local = v.mapInPandas(pass_by, schema)
    else:
        nq = q.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("nq"))
        nv = v.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / VECTOR_TILE).cast("int").alias("nv"))
        size = nq.join(nv, "s")
        own = lambda: size.select(*[F.col(c).alias(c) for c in ("s", "nq", "nv")])  # noqa: E731  columns of its own for either side
        dealt_q = q.join(own(), "s").withColumn("b", F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)))
        dealt_v = v.join(own(), "s").withColumn("t", F.pmod(F.xxhash64("chunk_id"), F.col("nv")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))

        def met(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": a["query_id"][:0], "chunk_id": b["chunk_id"][:0], "score": np.zeros(0)})
            return _rows(a["query_id"].to_numpy(), *best(scored(metric, np.stack(a["e"].to_list()), np.stack(b["e"].to_list())), b["chunk_id"].to_numpy(), k))

        local = dealt_q.groupBy("s", "b", "t").cogroup(dealt_v.groupBy("s", "b", "t")).applyInPandas(met, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "chunk_id"))
    return local.withColumn("score", F.nanvl("score", F.lit(None))).withColumn("rank", rank).where(F.col("rank") <= k)
