"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree (domain, language, source). A node that cannot
use its share returns the shortage to its siblings, in proportion to their
weights; only what all siblings together cannot use goes back to the parent's
siblings. Each leaf then takes whole epochs and a token prefix of one more
epoch, in an order seeded by (seed, epoch, document).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import free_name, release, stage

#: Leaves up to this many are broadcast (about 100 bytes each); a larger tree is joined by a shuffle.
BROADCAST_LEAVES = 50_000
#: A leaf's epoch order is cut into runs of about so many documents by its order keys, so that a leaf of a third of all rows is many groups.
RUN_ROWS = 16_384


class Order(NamedTuple):
    """The order of an epoch: what is kept of a text, and the key (any long, spread evenly) from seed, epoch, id and that."""

    digest: Callable[[Column], Column]
    key: Callable[[int, Column, Column, Column], Column]


HASHED = Order(F.xxhash64, lambda seed, epoch, doc, text: F.xxhash64(F.lit(seed), epoch.cast("long"), doc, text))


def _md5_key(seed: int, epoch: Column, doc: Column, text: Column) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("")), text))
    return F.shiftleft(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") - F.lit(1 << 59), 4)


#: The first 60 bits of an MD5, which other SQL engines can compute; a null id or text counts as an empty one.
MD5 = Order(lambda text: F.md5(F.coalesce(text, F.lit(""))), _md5_key)


def count_tokens(text: Column) -> Column:
    """White-space tokens of the whole text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _water_fill(nodes: DataFrame, parent: list[str], target: Column) -> DataFrame:
    """Split each parent's ``target`` over its children: ``min(cap, level * weight)``.

    Children sorted by cap/weight: those before the level are filled, the rest
    share what is left by weight, which is the fixed point of repeated redistribution.
    """
    by = Window.partitionBy(*parent).orderBy(F.col("ratio").asc(), *[F.col(c).asc_nulls_first() for c in nodes.columns if c.startswith("_k")])
    before, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parent)
    zero = F.lit(0.0)
    out = nodes.withColumn("_target", target).withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    out = out.withColumns({
        "_full": F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("cap")).otherwise(zero)).over(before), zero),
        "_used": F.coalesce(F.sum("weight").over(before), zero),
        "_all": F.sum("weight").over(every),
    })
    level = (F.col("_target") - F.col("_full")) / (F.col("_all") - F.col("_used"))
    out = out.withColumn("_fits", (F.col("weight") > 0) & (F.col("_all") - F.col("_used") > 1e-12) & (F.col("ratio") > level))
    # levels rise up to the first child that is not filled, and fall behind it
    out = out.withColumn("_level", F.max(F.when(F.col("_fits"), level)).over(every))
    share = F.when(F.col("weight") <= 0, zero).otherwise(F.least(F.col("cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("cap"))))
    return out.withColumn("alloc", F.greatest(share, zero)).drop("_target", "ratio", "_full", "_used", "_all", "_fits", "_level")


def node_levels(leaves: DataFrame, tree: list[str], weights: dict[str, Column], max_epochs: float) -> list[DataFrame]:
    """Nodes of each depth (``_k0`` …, cap, weight, tokens), each with the weight its level gives it among its siblings.

    ``weights``: an expression over the names down to a level; a level without
    one, and a null, count 1. A node can use what its children with a weight can.
    """
    keys = [f"_k{i}" for i in range(len(tree))]
    out: list[DataFrame] = []
    below = leaves.withColumn("cap", F.col("tokens") * F.lit(float(max_epochs)))
    for depth in range(len(tree), 0, -1):
        nodes = below.groupBy(*tree[:depth]).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        weight = F.coalesce(weights.get(tree[depth - 1], F.lit(1.0)).cast("double"), F.lit(1.0))
        nodes = nodes.withColumn("weight", F.greatest(weight, F.lit(0.0)))
        below = nodes.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0))
        out.insert(0, nodes.select(*[F.col(c).alias(k) for c, k in zip(tree[:depth], keys)], "cap", "weight", "tokens"))
    return out


def allocate(leaves: DataFrame, tree: list[str], budget: Column, max_epochs: float, weights: dict[str, Column] | None = None) -> DataFrame:
    """Leaf allocations. ``leaves``: the tree's columns, ``tokens`` (supply) and, without ``weights``, ``weight`` (the leaf's own, at least 0).

    ``weights`` gives targets to the nodes of each level among their siblings
    (``node_levels``). Without it a node's weight is the sum of its leaves'
    weights, its capacity the sum of their supply times ``max_epochs``. Null
    names are a group of their own.
    """
    keys = [f"_k{i}" for i in range(len(tree))]
    if weights is None:
        base = leaves.select(*[F.col(c).alias(k) for k, c in zip(keys, tree)], (F.col("tokens") * F.lit(float(max_epochs))).alias("cap"), F.col("weight").cast("double").alias("weight"), "tokens")
        sums = [F.sum(c).alias(c) for c in ("cap", "weight", "tokens")]
        levels = [base.groupBy(*keys[:depth]).agg(*sums) for depth in range(1, len(tree) + 1)]
    else:
        levels = node_levels(leaves, tree, weights, max_epochs)
    above = None
    for depth, own in enumerate(levels, 1):
        if above is None:
            level = _water_fill(own.withColumn("_root", F.lit(0)), ["_root"], budget).drop("_root")
        else:
            up = above.select(*[F.col(k).alias(f"_u{k}") for k in keys[: depth - 1]], F.col("alloc").alias("_up"))
            same = [F.col(k).eqNullSafe(F.col(f"_u{k}")) for k in keys[: depth - 1]]
            joined = own.join(up, same).drop(*[f"_u{k}" for k in keys[: depth - 1]])
            level = _water_fill(joined, keys[: depth - 1], F.col("_up")).drop("_up")
        above = level
    return above.select(*[F.col(k).alias(c) for k, c in zip(keys, tree)], "tokens", "alloc")


def mix(
    docs: DataFrame,
    tree: dict[str, Column],
    weight: Column | dict[str, Column],
    fraction: float = 0.6,
    max_epochs: int = 4,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: Order = HASHED,
) -> DataFrame:
    """``docs`` repeated by epoch, and last the struct ``_mix`` (the tree's levels, tokens, epoch from 0).

    ``weight``: by level the weights of its nodes, or one expression for the
    leaves, which their ancestors add up; both over the tree's names.
    ``fraction``: the budget as a part of all tokens. The prefix never exceeds a
    leaf's allocation; documents with equal order keys (exact repeats of a row)
    are in or out together. Documents without tokens (null and empty texts) are
    in every whole epoch of their leaf; a leaf without tokens or weight gives
    nothing. Null names group together. Very long texts are counted whole; one
    longer than what is left of its leaf's share ends the prefix. An empty table
    gives no rows. Columns of ``docs`` stay whatever their names: if one is
    called ``_mix``, the struct is ``_mix_``.
    """
    names = list(tree)
    level = {f"_t{i}": c.cast("string") for i, c in enumerate(tree.values())}
    keys = list(level)
    narrow = stage(
        docs.select(*[c.alias(k) for k, c in level.items()], count_tokens(F.col(text_col)).alias("_tokens"), F.col(id_col).alias("_id"), order.digest(F.col(text_col)).alias("_text")), "mix-tokens"
    )
    sums = stage(narrow.groupBy(*keys).agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-leaves")
    totals = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    hint = (lambda df: F.broadcast(df)) if totals["n"] <= BROADCAST_LEAVES else (lambda df: df)
    equal = lambda a, b: [F.col(f"{a}{i}").eqNullSafe(F.col(f"{b}{i}")) for i in range(len(names))]
    leaves = sums.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "tokens")
    by_level = weight if isinstance(weight, dict) else None
    if by_level is None:
        leaves = leaves.withColumn("weight", F.coalesce(weight, F.lit(0.0)))
    plan = allocate(leaves, names, F.lit(float(totals["t"] * fraction)), max_epochs, by_level).where(F.col("tokens") > 0).select(
        *[F.col(n).alias(f"_p{i}") for i, n in enumerate(names)],
        F.floor(F.col("alloc") / F.col("tokens")).cast("int").alias("_whole"),
        F.floor(F.col("alloc")).cast("long").alias("_alloc"), F.col("tokens").alias("_supply"),
    )
    bits = F.greatest(F.ceil(F.log2(F.col("docs") / RUN_ROWS)), F.lit(1)).cast("int")
    plan = plan.join(hint(sums.select(*keys, bits.alias("_bits"))), equal("_p", "_t")).drop(*keys)
    plan = stage(plan.withColumn("_rest", F.col("_alloc") - F.col("_whole") * F.col("_supply")), "mix-plan")
    at = order.key(seed, F.col("_whole"), F.col("_id"), F.col("_text"))
    run = F.expr("shiftright(_o, 64 - _bits)")  # runs follow the order of the keys
    dealt = narrow.join(hint(plan), equal("_t", "_p")).where("_rest > 0").select(*keys, "_tokens", "_rest", "_bits", at.alias("_o")).withColumn("_run", run)
    by_run = dealt.groupBy(*keys, "_run").agg(F.sum("_tokens").alias("_n"), F.max("_rest").alias("_rest"))
    through = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = by_run.withColumn("_through", through).where(F.col("_through") > F.col("_rest")).groupBy(*keys).agg(
        F.min_by(F.struct("_run", (F.col("_through") - F.col("_n")).alias("_before")), "_run").alias("_cut")
    )
    cut = cut.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], F.col("_cut._run").alias("_cut_run"), "_cut._before")
    inside = dealt.join(hint(cut), equal("_t", "_c")).where("_run = _cut_run")
    reach = F.col("_before") + F.sum("_tokens").over(Window.partitionBy(*keys).orderBy("_o"))
    # the first order key beyond the prefix; a leaf whose last epoch fits whole has none
    stop = inside.withColumn("_reach", reach).where(F.col("_reach") > F.col("_rest")).groupBy(*keys).agg(F.min("_o").alias("_stop"))
    stop = stop.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], "_stop")
    final = stage(plan.join(stop, equal("_p", "_c"), "left").drop(*[f"_c{i}" for i in range(len(names))]), "mix-cuts")
    release(narrow, sums, plan)
    whole = docs.select(
        F.struct("*").alias("_row"), *[c.alias(k) for k, c in level.items()], F.col(id_col).alias("_id"), order.digest(F.col(text_col)).alias("_text"), count_tokens(F.col(text_col)).alias("_tokens")
    )
    taken = F.col("_whole") + ((F.col("_rest") > 0) & (F.col("_stop").isNull() | (at < F.col("_stop")))).cast("int")
    rows = whole.join(hint(final), equal("_t", "_p")).withColumn("_taken", taken).where("_taken > 0")
    rows = rows.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_taken") - 1)))
    mixed = F.struct(*[F.col(f"_t{i}").alias(n) for i, n in enumerate(names)], F.col("_tokens").alias("tokens"), F.col("_epoch").alias("epoch"))
    return rows.select("_row.*", mixed.alias(free_name(docs.columns, "_mix")))


def resample(docs: DataFrame, *args, **kwargs) -> DataFrame:
    """``mix`` with the columns of ``docs`` only; nulls, empty and long texts, ties, repeated rows and an empty table as there."""
    mixed = mix(docs, *args, **kwargs)
    return mixed.drop(mixed.columns[-1])


def corpus_tree() -> dict[str, Column]:
    """Domain, language, source: four domains deal the sources by their number."""
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), r"([0-9]{1,9})\z", 1)
    domain = F.when(number == "", "other").otherwise(F.concat(F.lit("domain"), F.pmod(number.cast("int"), F.lit(4))))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def corpus_weight() -> Column:
    """English counts double, domain0 half as much again; a language the table lacks counts once."""
    lang = F.when(F.col("lang") == "en", 2.0).otherwise(1.0)
    return lang * F.when(F.col("domain") == "domain0", 1.5).otherwise(1.0)


def corpus_weights() -> dict[str, Column]:
    """Targets by level: domain0 half as much again as each other domain, in each domain English twice as much as each other language, its sources alike."""
    return {"domain": F.when(F.col("domain") == "domain0", 1.5).otherwise(1.0), "lang": F.when(F.col("lang") == "en", 2.0).otherwise(1.0)}


def report(docs: DataFrame) -> DataFrame:
    """Rows of query ``op1``: one per document and epoch taken."""
    out = mix(docs.select("doc_id", "text", "lang", "source"), corpus_tree(), corpus_weights(), order=MD5)
    return out.select("doc_id", "_mix.domain", "_mix.lang", "_mix.source", F.col("_mix.tokens").alias("n_tokens"), F.col("_mix.epoch").alias("epoch"))


def _filled(nodes: str, parent: str, keys: str) -> str:
    """SQL of ``_water_fill``: ``nodes`` (cap, weight, target) with ``alloc``."""
    return f"""SELECT *, greatest(least(cap, coalesce(lvl * weight, cap)), 0) AS alloc FROM (
      SELECT *, max(CASE WHEN weight > 0 AND every - used > 1e-12 AND ratio > l THEN l END) OVER (PARTITION BY {parent}) AS lvl FROM (
        SELECT *, (target - below) / (every - used) AS l FROM (
          SELECT *, coalesce(sum(cap) OVER w, 0::DOUBLE) AS below, coalesce(sum(weight) OVER w, 0::DOUBLE) AS used, sum(weight) OVER (PARTITION BY {parent}) AS every
          FROM (SELECT *, cap / weight AS ratio FROM ({nodes})) WINDOW w AS (PARTITION BY {parent} ORDER BY ratio, {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))))"""


_NODES = "SELECT n.*, up.alloc AS target FROM ({nodes}) n JOIN {up} up ON {same}"
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN num = '' THEN 'other' ELSE 'domain' || (num::INTEGER % 4) END AS domain, lang, source, len(regexp_extract_all(t, '[^ 	-
]+'))::BIGINT AS n_tokens, md5(t) AS h
  FROM (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})\z', 1) AS num FROM documents)),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS tokens, 4 * sum(n_tokens)::DOUBLE AS cap, 1::DOUBLE AS weight FROM d GROUP BY domain, lang, source),
langs AS (SELECT domain, lang, sum(cap) AS cap, (CASE WHEN lang = 'en' THEN 2 ELSE 1 END)::DOUBLE AS weight FROM leaf GROUP BY domain, lang),
domains AS (SELECT domain, sum(cap) AS cap, (CASE WHEN domain = 'domain0' THEN 1.5 ELSE 1 END)::DOUBLE AS weight, (SELECT sum(n_tokens) FROM d)::DOUBLE * 0.6::DOUBLE AS target FROM langs GROUP BY domain),
a1 AS ({_filled("SELECT * FROM domains", "1", "domain NULLS FIRST")}),
a2 AS ({_filled(_NODES.format(nodes="SELECT * FROM langs", up="a1", same="n.domain IS NOT DISTINCT FROM up.domain"), "domain", "domain NULLS FIRST, lang NULLS FIRST")}),
a3 AS ({_filled(_NODES.format(nodes="SELECT * FROM leaf", up="a2", same="n.domain IS NOT DISTINCT FROM up.domain AND n.lang IS NOT DISTINCT FROM up.lang"), "domain, lang", "domain NULLS FIRST, lang NULLS FIRST, source NULLS FIRST")}),
plan AS (SELECT domain, lang, source, floor(alloc / tokens)::BIGINT AS whole, floor(alloc)::BIGINT - floor(alloc / tokens)::BIGINT * tokens::BIGINT AS rest FROM a3 WHERE tokens > 0),
o AS (
  SELECT d.*, whole, rest, ('0x' || md5('42:' || whole || ':' || coalesce(doc_id::VARCHAR, '') || ':' || h)[1:15])::BIGINT AS o
  FROM d JOIN plan p ON d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY o) AS reach FROM o),
t AS (SELECT *, whole + (rest > 0 AND o < coalesce(min(CASE WHEN reach > rest THEN o END) OVER (PARTITION BY domain, lang, source), 1 << 61))::INTEGER AS taken FROM r)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, taken))::INTEGER AS epoch FROM t
"""
