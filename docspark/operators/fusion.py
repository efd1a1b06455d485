"""Fusion of vector and text hits into ranked, cited context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

W_VECTOR, W_TEXT = 0.65, 0.35
SPREAD = 1e-12


def minmax_scores(matches: DataFrame, by=("query_id", "q_idx", "source")) -> DataFrame:
    """F1: ``norm`` within each list; a list of equal scores is all 1."""
    w = Window.partitionBy(*by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return matches.withColumn("norm", F.when(high - low < SPREAD, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)))


def hybrid_scores(vec: DataFrame, fts: DataFrame, w_vec: float = W_VECTOR, w_fts: float = W_TEXT) -> DataFrame:
    """weighted sum of ``norm`` over the union of hits; a missing side is 0; the source is the vector's where there is one."""
    key = ["query_id", "q_idx", "chunk_id"]
    v, t = vec.select(*key, F.col("norm").alias("v")), fts.select(*key, F.col("norm").alias("t"))
    score = F.lit(w_vec) * F.coalesce("v", F.lit(0.0)) + F.lit(w_fts) * F.coalesce("t", F.lit(0.0))
    return v.join(t, key, "full").select(*key, score.alias("score"), F.when(F.col("v").isNotNull(), "vector").otherwise("fts").alias("source"))


def dedupe_rewrites(hits: DataFrame) -> DataFrame:
    """a row per query and chunk: its best score (the first rewrite wins ties) and all rewrites that found it."""
    best = F.max_by(F.struct("score", "source", "q_idx"), F.struct("score", -F.col("q_idx")))
    return hits.groupBy("query_id", "chunk_id").agg(best.alias("b"), F.sort_array(F.collect_set("q_idx")).alias("matched_by")).select("query_id", "chunk_id", "b.score", "b.source", "matched_by")


def fuse_topk(hits: DataFrame, k: int, order: str = "chunk_index") -> DataFrame:
    """rank by score, then chunk order, then id."""
    by = [F.col("score").desc(), *([F.col(order)] if order in hits.columns else []), F.col("chunk_id")]
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where(F.col("rank") <= k)


def fusion_stats(vec: DataFrame, fts: DataFrame, selected: DataFrame) -> DataFrame:
    """hits, distinct chunks and selected chunks per query."""
    every = vec.select("query_id", "chunk_id").unionByName(fts.select("query_id", "chunk_id"))
    told = every.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_candidates"), F.countDistinct("chunk_id").alias("unique_candidates"))
    chosen = selected.groupBy("query_id").agg(F.count(F.lit(1)).alias("selected"))
    return told.join(chosen, "query_id", "left").withColumn("selected", F.coalesce("selected", F.lit(0)))


def hydrate(ranked: DataFrame, chunks: DataFrame, key=("chunk_id",)) -> DataFrame:
    """chunk rows of the ranked ids; ids not found are dropped."""
    return ranked.join(chunks, list(key))


def apply_rerank(ranked: DataFrame, order: DataFrame, top_n: int) -> DataFrame:
    """Listed ids first, in listed order, the rest as they were; only for two candidates and more; scores stay.

    ``order``: query_id, ranking (array of chunk ids). Duplicates and unknown ids in a ranking are ignored.
    """
    listed = order.select("query_id", F.posexplode("ranking").alias("pos", "chunk_id")).groupBy("query_id", "chunk_id").agg(F.min("pos").alias("pos"))
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    placed = ranked.join(listed, ["query_id", "chunk_id"], "left").withColumn("_n", n)
    pos = F.when(F.col("_n") > 1, F.col("pos"))
    again = F.row_number().over(Window.partitionBy("query_id").orderBy(pos.asc_nulls_last(), "rank"))
    return placed.withColumn("final_rank", again).where(F.col("final_rank") <= top_n).drop("pos", "_n")


def build_context_pack(ranked: DataFrame, rank: str = "rank", queries: DataFrame | None = None) -> DataFrame:
    """a row per query with its chunks in rank order; a score that is absent is 0.

    A chunk has its index, its meta and, as citation, a copy of the meta (null
    where that is null or empty), and the rewrites that found it. Columns that
    ``ranked`` lacks are null. ``queries``: query_id and what else a pack shall
    tell (index, project, question, rewrites, metric); queries without hits get no chunks.
    """
    there = {f.name: f.dataType for f in ranked.schema}
    own = lambda c, kind: F.col(c) if c in there else F.lit(None).cast(kind)
    meta = own("meta", "map<string,string>")
    empty = F.size(meta) == 0 if there.get("meta", T.MapType(T.StringType(), T.StringType())).typeName() in ("map", "array") else meta.isNull()
    chunk = F.struct(
        F.col(rank).alias("rank"), F.col("chunk_id"), own("chunk_index", "int").alias("chunk_index"), F.col("text"), F.coalesce("score", F.lit(0.0)).alias("score"),
        own("matched_by", "array<int>").alias("matched_by"), F.to_json(meta).alias("meta"), F.when(~empty, F.to_json(meta)).alias("citation"),
    )
    packs = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    if queries is None:
        return packs
    none = F.array().cast(packs.schema["chunks"].dataType)
    return queries.join(packs, "query_id", "left").withColumn("chunks", F.coalesce("chunks", none))


def render_context(packs: DataFrame, max_chars: int = 12_000) -> DataFrame:
    """``[i] text`` with blank lines between, cut at ``max_chars``."""
    lines = F.transform("chunks", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["text"]))
    return packs.withColumn("context", F.substring(F.array_join(lines, "\n\n"), 1, max_chars))


def rerank_prompts(packs: DataFrame) -> DataFrame:
    """the supporting sub-queries, if ``packs`` has ``sub_queries`` that are not blank, and one card per candidate.

    A card is numbered from 0 and tells id, chunk index, score and text, and as
    signals the rewrites that found it, where these are known. Scores have six
    digits, as C prints them (``format_string`` would round the shortest decimal).
    """
    score = lambda x: F.coalesce(F.replace(F.format_number(x["score"], 6), F.lit(","), F.lit("")), F.lit("null"))
    index = lambda x: F.when(x["chunk_index"].isNotNull(), F.concat(F.lit(" index="), x["chunk_index"].cast("string"))).otherwise("")
    signals = lambda x: F.when(x["matched_by"].isNotNull(), F.concat(F.lit("\nsignals: matched_by=["), F.array_join(x["matched_by"].cast("array<string>"), ", "), F.lit("]"))).otherwise("")
    card = lambda x, i: F.concat(F.lit("#"), i.cast("string"), F.lit(" id="), x["chunk_id"].cast("string"), index(x), F.lit(" score="), score(x), F.lit("\n"), x["text"], signals(x))
    prompt = F.array_join(F.transform("chunks", card), "\n---\n")
    if "sub_queries" in packs.columns:
        asked = F.filter(F.transform("sub_queries", lambda q: F.trim(q)), lambda q: q != "")
        head = F.concat(F.lit("Supporting sub-queries:\n"), F.array_join(F.transform(asked, lambda q: F.concat(F.lit("- "), q)), "\n"), F.lit("\n\n"))
        prompt = F.concat(F.when(F.size(asked) > 0, head).otherwise(""), prompt)
    return packs.withColumn("prompt", prompt)
