"""Embeddings: signatures, batches, alignment, upserts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.sources.staging import release, stage

CONFIG = ("batch_size", "dimensions", "model", "provider")
KEY = ["index_id", "chunk_id", "embed_signature"]


def embed_signature(provider: Column, model: Column, batch_size: Column, dimensions: Column) -> Column:
    """SHA-256 of compact JSON with sorted keys; nulls are kept."""
    fields = dict(zip(CONFIG, (batch_size, dimensions, model, provider)))
    return F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"}), 256)


def invalid_configs(df: DataFrame, column: str = "config") -> DataFrame:
    """Rows whose configuration has unknown keys."""
    unknown = F.array_except(F.json_object_keys(column), F.array(*[F.lit(k) for k in CONFIG]))
    return df.withColumn("unknown_keys", unknown).where(F.size("unknown_keys") > 0)


def hashing_embedder(dimensions: int = 64) -> Callable[[list[str]], list[np.ndarray]]:
    """Offline: signed counts of hashed words, of unit length; a blank text is all zero. Each different word of a call is hashed once.

    A text whose counts cancel out, or that has nothing but rarer kinds of white space, counts as one word.
    """
    digest = lambda w: int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")

    def embed(texts: list[str]) -> list[np.ndarray]:
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.string())))
        words, of = lists.flatten().dictionary_encode(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        h = np.array([digest(w) for w in words.dictionary.to_pylist()], dtype=np.uint64)
        blank = np.array([not w for w in words.dictionary.to_pylist()], dtype=bool)
        code = words.indices.to_numpy(zero_copy_only=False)
        sign = np.where(blank, 0.0, np.where(h >> np.uint64(63), 1.0, -1.0))
        counts = np.bincount(of * dimensions + (h % np.uint64(dimensions)).astype(np.int64)[code], sign[code], minlength=len(texts) * dimensions) if len(code) else np.zeros(len(texts) * dimensions)
        v = counts.reshape(len(texts), dimensions)
        for i in np.flatnonzero(~v.any(1)):
            if texts[i].strip(" \t\n\f\r"):
                one = digest(texts[i].lower())
                v[i, one % dimensions] = -1.0 if one >> 63 == 0 else 1.0
        n = np.sqrt((v * v).sum(1, keepdims=True))
        return list(np.divide(v, n, out=v, where=n > 0))

    return embed


def embed(df: DataFrame, text_col: str = "text", embed_fn: Callable | None = None, batch_size: int = 16) -> DataFrame:
    """``embedding`` by ``embed_fn`` over lists of at most ``batch_size`` texts (64 if not positive)."""
    call, size = embed_fn or hashing_embedder(), batch_size if batch_size > 0 else 64

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            texts = [t or "" for t in b]
            vectors: list = []
            for s in range(0, len(texts), size):
                got = list(call(texts[s : s + size]))
                if len(got) != len(texts[s : s + size]):
                    raise ValueError("the embedder returned another number of vectors than texts")
                vectors += got
            yield pd.Series(vectors, dtype=object)

    return df.withColumn("embedding", F.pandas_udf(run, "array<double>")(F.col(text_col)))


def align_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors by (index_id, chunk_index)."""
    return chunks.join(vectors, ["index_id", "chunk_index"])


def alignment_errors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    a = chunks.select("index_id", "chunk_index", F.lit(True).alias("has_chunk"))
    b = vectors.select("index_id", "chunk_index", F.lit(True).alias("has_vector"))
    return a.join(b, ["index_id", "chunk_index"], "full").where("has_chunk IS NULL OR has_vector IS NULL")


def check_dims(df: DataFrame) -> DataFrame:
    """E5: indexes whose vectors differ in dimension."""
    return df.groupBy("index_id", "embed_signature").agg(F.countDistinct(F.size("embedding")).alias("n_dims")).where("n_dims > 1")


def upsert_embeddings(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Rows by key; an update replaces, its last ``seq`` wins if it has one."""
    seq = F.col("seq") if "seq" in updates.columns else F.lit(0)
    new = updates.withColumns({"_new": F.lit(1), "_seq": seq.cast("long")}).select(*target.columns, "_new", "_seq")
    every = target.withColumns({"_new": F.lit(0), "_seq": F.lit(0).cast("long")}).unionByName(new)
    newest = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("_new").desc(), F.col("_seq").desc()))
    return every.withColumn("_r", newest).where("_r = 1").drop("_r", "_new", "_seq")


def upsert_table(updates: DataFrame, path: str, replaced: DataFrame | None = None, parts: int | None = None, files: int = 8) -> None:
    """E6 on a stored table: only the partitions of the indexes that change are read and written again, into few files.

    The table is partitioned by ``index_id``, or by its hash into ``parts`` where
    there are very many small indexes; ``parts`` must not change over its life. Rows
    are upserted by key. Indexes that ``replaced`` (index_id) names are replaced:
    what they had before goes, even if ``updates`` has nothing for them. The same
    call again changes nothing. An index, or a part, is spread over ``files`` files.
    """
    spark = updates.sparkSession
    rest = [c for c in updates.columns if c != "seq"]
    cut = "index_id" if parts is None else "_part"
    part = lambda df: df if parts is None else df.withColumn("_part", F.pmod(F.xxhash64("index_id"), F.lit(parts)).cast("int"))
    new = stage(upsert_embeddings(updates.select(*rest).limit(0), updates), "upsert-new")
    gone = None if replaced is None else replaced.select("index_id").distinct()
    changed = new.select("index_id") if gone is None else new.select("index_id").unionByName(gone)
    touched = stage(part(changed).select(cut).distinct(), "upsert-touched")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files_of = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    every = part(new)
    if files_of.exists(folder):
        now = spark.read.schema(every.schema).parquet(path).join(touched, cut, "left_semi").select(*rest)
        now = now if gone is None else now.join(gone, "index_id", "left_anti")
        every = part(upsert_embeddings(now, new))
    # written apart first: a partition is not replaced while it is read
    every = stage(every, "upsert-merged")
    every.repartition(F.col(cut), F.pmod(F.xxhash64("chunk_id"), F.lit(files))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(cut).parquet(path)
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for r in touched.join(every.select(cut).distinct(), cut, "left_anti").toLocalIterator():  # nothing is left of these
        files_of.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, names.getPartitionPathString(cut, str(r[0]))), True)
    release(new, touched, every)


def delete_embeddings(df: DataFrame, keys: DataFrame) -> DataFrame:
    """By index, or by index and signature if ``keys`` has it."""
    return df.join(keys.distinct(), [c for c in ("index_id", "embed_signature") if c in keys.columns], "left_anti")


def has_embeddings(indexes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``has`` for each (index_id, embed_signature)."""
    there = embeddings.select("index_id", "embed_signature").distinct().withColumn("has", F.lit(True))
    return indexes.join(there, ["index_id", "embed_signature"], "left").withColumn("has", F.coalesce("has", F.lit(False)))
