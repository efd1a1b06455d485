"""Query preparation (Q1-Q5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.normalize import collapse_ws

MAX_K, MAX_N, MAX_REWRITES, MIN_REWRITES = 20, 5, 4, 2


def _first_of_each(items: Column) -> Column:
    """Case-insensitive distinct that keeps the first spelling."""
    return F.aggregate(
        items, F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )


def normalize_rewrites(df: DataFrame) -> DataFrame:
    """Q1: ``queries`` from ``rewrites`` (array) and ``original``."""
    clean = F.filter(F.transform(F.coalesce("rewrites", F.array().cast("array<string>")), collapse_ws), lambda x: x != "")
    few = F.slice(_first_of_each(clean), 1, MAX_REWRITES)
    original = collapse_ws(F.col("original"))
    out = df.withColumns({"_few": few, "_o": original})
    short = (F.size("_few") < MIN_REWRITES) & ~F.exists("_few", lambda y: F.lower(y) == F.lower(F.col("_o")))
    return out.withColumn("queries", F.when(F.size("_few") == 0, F.array("_o")).when(short, F.concat("_few", F.array("_o"))).otherwise(F.col("_few"))).drop("_few", "_o")


def parse_rewrites(df: DataFrame, column: str = "reply") -> DataFrame:
    """Q2: ``rewrites`` and ``strategy`` from JSON; a single string is one query, whatever it begins with; bad JSON has none."""
    many = F.from_json(column, "queries array<string>, strategy string")
    one = F.from_json(column, "queries string, strategy string")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.col(column)), "$.queries", "variant"))
    single = F.when(kind == "STRING", F.array(one["queries"]))
    return df.withColumns({"rewrites": F.coalesce(many["queries"], single, F.array().cast("array<string>")), "strategy": F.coalesce(many["strategy"], one["strategy"])})


def expand_queries(df: DataFrame) -> DataFrame:
    """Q3: (query_id, q_idx, text): rewrites that are not blank, the original, then acronyms of 2 to 8 capitals."""
    kept = F.filter(F.coalesce("rewrites", F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    base = F.when(F.size(kept) == 0, F.array("original")).otherwise(F.when(F.array_contains(kept, F.col("original")), kept).otherwise(F.concat(kept, F.array("original"))))
    out = df.withColumn("_b", base)
    acronyms = F.array_distinct(F.flatten(F.transform("_b", lambda x: F.regexp_extract_all(x, F.lit(r"(?U)\b[A-Z]{2,8}\b"), F.lit(0)))))
    every = F.concat("_b", F.array_except(acronyms, F.col("_b")))
    return out.select("query_id", F.posexplode(every).alias("q_idx", "text"))


def validate_queries(df: DataFrame) -> DataFrame:
    """Q4: ``valid`` and clamped ``top_k`` in [1, 20], ``top_n`` in [1, 5] and at most ``top_k``."""
    k = F.least(F.greatest(F.col("top_k"), F.lit(1)), F.lit(MAX_K))
    n = F.least(F.greatest(F.col("top_n"), F.lit(1)), F.lit(MAX_N), k)
    return df.withColumns({"valid": collapse_ws(F.col("query")) != "", "top_k": k, "top_n": n})


def authorize_queries(queries: DataFrame, indexes: DataFrame, projects: DataFrame) -> DataFrame:
    """Q5: ``reason`` is null for a query on a ready run of a project that its owner has."""
    q = queries.join(indexes.select(F.col("id").alias("index_id"), F.col("project_id").alias("_p"), "status"), "index_id", "left")
    q = q.join(projects.select(F.col("id").alias("_p"), F.col("owner_id").alias("_o")), "_p", "left")
    foreign = F.coalesce((F.col("_o") != F.col("owner_id")) | (F.col("_p") != F.col("project_id")), F.lit(True))
    reason = F.when(F.col("status").isNull() | foreign, "not_found").when(F.col("status") != "READY", "not_ready")
    return q.withColumn("reason", reason).drop("_p", "_o")
