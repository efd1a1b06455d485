"""Queries of the training-data operators, one for each, and their SQL where SQL can express them.

``url_rules``, ``pii_counts``, ``shard_sizes`` and ``whitening_deviations`` hold
the parts of operators 4, 3, 6 and 13 that SQL can express, so that an engine of
its own confirms them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import embedding_neardup, lm_scoring, mixing, ngram_join, packing, pii, quality_model, quality_rules, sharding, spelling, toxicity, url_filter, whitening
from .staging import read_table


def url_rules(spark, d):
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    return read_table(spark, d, "pages").select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", url_filter.rule_of(F.col("host"), F.col("path"))["rule"])


def pii_counts(spark, d):
    return pii.report(read_table(spark, d, "documents")).select("doc_id", *[f"n_{k}" for k in pii.BASE_KINDS])


def shard_sizes(spark, d):
    out = sharding.report(read_table(spark, d, "documents"))
    return out.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("slots"), F.min("slot").alias("first"), F.max("slot").alias("last"))


def whitening_deviations(spark, d):
    return whitening.report(read_table(spark, d, "embeddings")).where("component = 1").select("vec_id", "n", "deviation")


QUERIES = {
    "op1_mix_sources": lambda spark, d: mixing.report(read_table(spark, d, "documents")),
    "op2_embedding_neardup": lambda spark, d: embedding_neardup.report(read_table(spark, d, "embeddings")),
    "op3_pii": lambda spark, d: pii.report(read_table(spark, d, "documents")),
    "op4_url_filter": lambda spark, d: url_filter.report(read_table(spark, d, "pages")),
    "op5_ngram_jaccard_join": lambda spark, d: ngram_join.report(read_table(spark, d, "documents")),
    "op6_hilbert_shards": lambda spark, d: sharding.report(read_table(spark, d, "documents")),
    "op7_best_two_fit": lambda spark, d: packing.report(read_table(spark, d, "documents")),
    "op8_quality_classifier": lambda spark, d: quality_model.report(read_table(spark, d, "documents")),
    "op9_quality_rules": lambda spark, d: quality_rules.report(read_table(spark, d, "documents")),
    "op10_subword_lattice": lambda spark, d: lm_scoring.report(read_table(spark, d, "documents")),
    "op11_toxicity": lambda spark, d: toxicity.report(read_table(spark, d, "documents"), read_table(spark, d, "labels")),
    "op12_spelling_variants": lambda spark, d: spelling.report(read_table(spark, d, "documents")),
    "op13_embedding_whitening": lambda spark, d: whitening.report(read_table(spark, d, "embeddings")),
    "pii_counts": pii_counts,
    "shard_sizes": shard_sizes,
    "url_rules": url_rules,
    "whitening_deviations": whitening_deviations,
}

_RULES = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
)
_LUHN = "list_sum(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN i % 2 = 1 THEN s[len(s) + 1 - i]::INTEGER ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][s[len(s) + 1 - i]::INTEGER + 1] END)) % 10 = 0"

ORACLE_SQL = {
    "op1_mix_sources": mixing.ORACLE_SQL,
    "op2_embedding_neardup": embedding_neardup.ORACLE_SQL,
    "op5_ngram_jaccard_join": ngram_join.ORACLE_SQL,
    "op9_quality_rules": quality_rules.ORACLE_SQL,
    "op12_spelling_variants": spelling.ORACLE_SQL,
    "url_rules": rf"""SELECT page_id, host, path, CASE {_RULES} END AS rule FROM (
      SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)""",
    "pii_counts": rf"""SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
      len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: len(ltrim(p, '0')) > 3 OR try_cast('0' || right(p, 4) AS INTEGER) > 255)) = 0))::BIGINT AS n_ip,
      len(list_filter(list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[ -]', '', 'g')), lambda s: len(s) BETWEEN 12 AND 19 AND {_LUHN}))::BIGINT AS n_card,
      len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: len(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15))::BIGINT AS n_phone
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "shard_sizes": """SELECT s::INTEGER AS shard, n, n AS slots, 0::BIGINT AS "first", n - 1 AS "last" FROM (
      SELECT s, (((s + 1) * m + 39) // 40 - (s * m + 39) // 40)::BIGINT AS n FROM range(40) r(s), (SELECT count(*) AS m FROM documents)) WHERE n > 0""",
    "whitening_deviations": whitening.DEVIATIONS_SQL,
}
