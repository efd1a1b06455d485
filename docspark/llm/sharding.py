"""Sharding along a Hilbert curve through metadata space.

Each metadata dimension is quantised to ``bits`` bits: names by their rank among
the distinct names, weighted by their rows where there are more names than
steps, numbers by their logarithm. The cells' places on a Hilbert curve give one
sort order, names break ties inside a cell, and that order is cut into runs of
equal row counts. A shard then covers a compact box, so minimum/maximum
statistics of its files prune on every dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import free_name, parallelism, stage

#: Rows of a curve cell are spread over sub-runs of about so many, so that a cell of a third of all rows is many groups.
RUN_ROWS = 4096
DIMENSION_BITS = 4
#: Names up to this many are broadcast with their steps; more are joined by a shuffle.
BROADCAST_NAMES = 50_000
#: Rows of a written file.
FILE_ROWS = 1_000_000


def _xor(a: str, b: str) -> str:
    return f"(({a}) + ({b}) - 2 * (({a}) & ({b})))"


def hilbert_steps(n: int, bits: int) -> list[dict[str, str]]:
    """Hilbert index of coordinates ``x0..`` as successive SQL projections (Skilling's axes-to-transpose form).

    Every step maps column names to expressions over the step before. Only
    ``+ - * & >>`` and CASE are used, which any SQL engine reads alike.
    """
    steps: list[dict[str, str]] = []
    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for i in range(n):
            if i == 0:
                steps.append({"x0": f"CASE WHEN (x0 & {q}) <> 0 THEN {_xor('x0', str(p))} ELSE x0 END"})
                continue
            swap = f"({_xor('x0', f'x{i}')} & {p})"
            steps.append({"t": swap, "s": f"(x{i} & {q})"})
            steps.append({
                "x0": f"CASE WHEN s <> 0 THEN {_xor('x0', str(p))} ELSE {_xor('x0', 't')} END",
                f"x{i}": f"CASE WHEN s <> 0 THEN x{i} ELSE {_xor(f'x{i}', 't')} END",
            })
    for i in range(1, n):
        steps.append({f"x{i}": _xor(f"x{i}", f"x{i - 1}")})
    steps.append({"t": "0"})
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        steps.append({"t": f"CASE WHEN (x{n - 1} & {q}) <> 0 THEN {_xor('t', str(q - 1))} ELSE t END"})
    steps.append({f"x{i}": _xor(f"x{i}", "t") for i in range(n)})
    index = " + ".join(f"(((x{i} >> {b}) & 1) * {1 << (b * n + n - 1 - i)})" for i in range(n) for b in range(bits))
    steps.append({"hilbert": index})
    return steps


def curve(spark: SparkSession, n: int, bits: int = DIMENSION_BITS) -> DataFrame:
    """``cell`` and ``hilbert`` for every cell of an n-dimensional grid: 2**(n*bits) rows, whatever the data.

    Written once, so that the steps stay out of the plan that sorts the data.
    """
    out = spark.range(1 << (n * bits)).select(
        F.col("id").alias("cell"), *[F.expr(f"cast((id >> {bits * (n - 1 - i)}) & {(1 << bits) - 1} AS int)").alias(f"x{i}") for i in range(n)], F.lit(0).alias("t"), F.lit(0).alias("s")
    )
    for step in hilbert_steps(n, bits):
        out = out.withColumns({k: F.expr(v) for k, v in step.items()})
    return stage(out.select("cell", F.col("hilbert").cast("long").alias("hilbert")), "hilbert-curve")


def with_hilbert(df: DataFrame, dims: list[Column], bits: int = DIMENSION_BITS) -> DataFrame:
    """Add ``hilbert`` (long) for quantised ``dims``, each within ``[0, 2**bits)``; the curve's table is small by its shape."""
    cell = F.lit(0).cast("long")
    for d in dims:
        cell = cell * (1 << bits) + d.cast("long")
    table = curve(df.sparkSession, len(dims), bits).withColumnRenamed("cell", "_place")
    return df.withColumn("_at", cell).join(F.broadcast(table), F.col("_at") == F.col("_place"), "left").drop("_at", "_place")


def quantise_log(value: Column, bits: int = DIMENSION_BITS) -> Column:
    """Whole steps of the base-2 logarithm; null and 0 are step 0."""
    return F.least(F.lit((1 << bits) - 1), F.length(F.bin(F.greatest(F.coalesce(value, F.lit(0)).cast("long"), F.lit(0)))) - 1)


def name_steps(df: DataFrame, column: str, bits: int = DIMENSION_BITS, weight: str | None = None, many: int | None = None) -> DataFrame:
    """(``_name``, ``_step``) of the distinct names: their order cut into ``2**bits`` steps.

    ``weight``: rows that a row stands for; ``many``: the number of names, if known.

    Names that fit the steps get one each, spread evenly; more names get the
    step at which their rows begin, so a frequent name has a step to itself.
    More than ``BROADCAST_NAMES`` names are ordered over ranges of values, whose
    number is bounded, not in one task.
    """
    counted = df.groupBy(F.col(column).alias("_name")).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
    zero, steps = F.lit(0).cast("long"), 1 << bits
    step = F.when(F.col("_c1") <= steps, F.expr(f"_rank * {steps} div _c1")).otherwise(F.expr(f"_rows * {steps} div _m1")).cast("int").alias("_step")
    if (counted.count() if many is None else many) <= BROADCAST_NAMES:
        before, every = Window.orderBy(F.col("_name").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
        whole = counted.select("_name", F.coalesce(F.sum("_n").over(before), zero).alias("_rows"), F.count(F.lit(1)).over(before).alias("_rank"), F.sum("_n").over(every).alias("_m1"), F.count(F.lit(1)).over(every).alias("_c1"))
        return whole.select("_name", step)
    counted = stage(counted.repartitionByRange("_name").withColumn("_part", F.spark_partition_id()), "names")
    parts = counted.groupBy("_part").agg(F.sum("_n").alias("_m"), F.count(F.lit(1)).alias("_c"))
    before, every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    starts = parts.select(
        "_part", *[F.coalesce(F.sum(c).over(before), zero).alias(f"{c}0") for c in ("_m", "_c")], *[F.sum(c).over(every).alias(f"{c}1") for c in ("_m", "_c")]
    )
    inside = Window.partitionBy("_part").orderBy(F.col("_name").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.join(F.broadcast(starts), "_part").select(
        "_name", "_m1", "_c1", (F.col("_m0") + F.coalesce(F.sum("_n").over(inside), zero)).alias("_rows"), (F.col("_c0") + F.count(F.lit(1)).over(inside)).alias("_rank")
    )
    return stage(placed.select("_name", step), "name-steps")


def exact_ranks(df: DataFrame, cell: str, names: list[str], order: list[Column], spread: Column) -> DataFrame:
    """Add ``_rank`` (long, gapless from 0) and ``_total`` in the order of (cell, names, sub-run, ``order``).

    Counts are summed before anything moves; sums run over sub-runs inside a
    cell, then over cells (bounded by the curve). Rows are only sorted within a sub-run.
    """
    total = F.sum("_m").over(Window.partitionBy())
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy(F.col(cell).alias("_cell")).agg(F.count(F.lit(1)).alias("_m")).select(
        "_cell", F.ceil(F.col("_m") / RUN_ROWS).alias("_subs"), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_at"), total.alias("_total")
    )
    cells = stage(cells, "cells")
    keyed = df.join(F.broadcast(cells.select("_cell", "_subs")), F.col(cell) == F.col("_cell")).withColumn("_sub", F.pmod(spread, F.col("_subs"))).drop("_subs")
    group = ["_cell", *names, "_sub"]
    runs = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy("_cell").orderBy(*[F.col(n).asc_nulls_first() for n in names], "_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(cells), "_cell").select(
        *[F.col(g).alias(f"_o{k}") for k, g in enumerate(group)], (F.col("_at") + F.col("_in")).alias("_offset"), "_total"
    )
    row = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    same = [F.col(g).eqNullSafe(F.col(f"_o{k}")) for k, g in enumerate(group)]
    return keyed.withColumn("_row", row).join(offsets, same).withColumn("_rank", F.col("_offset") + F.col("_row") - 1)


def assign_shards(docs: DataFrame, n_shards: int, names: tuple[str, ...], dims: tuple[Column, ...] = (), bits: int = DIMENSION_BITS, keys: tuple[str, ...] = ("doc_id", "text_crc32")) -> DataFrame:
    """``docs`` and last ``hilbert``, ``shard`` and ``slot``: runs of the curve order, counts at most one apart.

    Dimensions are the columns ``names``, quantised by rank, and ``dims``,
    expressions for steps within ``[0, 2**bits)``. Names, then ``keys`` break
    ties within a cell; rows equal in all of them may swap places. Nulls are
    names and keys of their own. An empty table gives an empty result; fewer
    rows than shards leave some empty. Texts are not read here. Columns of
    ``docs`` stay whatever their names: an added column whose name is taken
    gets underscores behind it.
    """
    own = [f"_d{i}" for i in range(len(names))]
    steps = [f"_q{i}" for i in range(len(names) + len(dims))]
    tied = [f"_y{i}" for i in range(len(keys))]
    whole = docs.select(
        F.struct("*").alias("_row_"), *[F.col(f"`{c}`").alias(n) for c, n in zip(names, own)], *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, tied)], *[d.alias(q) for d, q in zip(dims, steps[len(names) :])]
    )
    # one count of all combinations, from which each column's names are counted
    combined = stage(whole.groupBy(*own).agg(F.count(F.lit(1)).alias("_n")), "name-counts") if own else None
    many = combined.agg(*[F.count_distinct(F.struct(n)) for n in own]).first() if own else ()
    for n, q, m in zip(own, steps, many):
        table = name_steps(combined, n, bits, "_n", m)
        table = F.broadcast(table) if m <= BROADCAST_NAMES else table
        whole = whole.join(table, F.col(n).eqNullSafe(F.col("_name"))).drop("_name").withColumnRenamed("_step", q)
    placed = with_hilbert(whole, [F.col(q) for q in steps], bits)
    ranked = exact_ranks(placed, "hilbert", own, [F.col(n).asc_nulls_first() for n in tied], F.xxhash64(*tied))
    shard = F.expr(f"_rank * {n_shards} div _total")
    first = F.expr(f"((_rank * {n_shards} div _total) * _total + {n_shards - 1}) div {n_shards}")
    added = {"hilbert": F.col("hilbert"), "shard": shard.cast("int"), "slot": (F.col("_rank") - first).cast("long")}
    return ranked.select("_row_.*", *[c.alias(free_name(docs.columns, n)) for n, c in added.items()])


def write_shards(sharded: DataFrame, path: str, file_rows: int = FILE_ROWS, shard: str = "shard", slot: str = "slot") -> None:
    """One folder per shard, rows in slot order, files of about ``file_rows`` rows, so that file statistics prune.

    Tasks are ranges of (shard, slot): a large shard is many tasks, each with a run of slots.
    """
    tasks = max(parallelism(sharded.sparkSession), -(-sharded.count() // file_rows))
    ordered = sharded.repartitionByRange(tasks, shard, slot).sortWithinPartitions(shard, slot)
    ordered.write.option("maxRecordsPerFile", file_rows).partitionBy(shard).parquet(path)


def metadata(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", "lang", "source",
        (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )


def report(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Rows of query ``op6``: law ``rows``; curve over language, source and size; null texts count as empty."""
    narrow = stage(metadata(docs), "shard-metadata")
    out = assign_shards(narrow, n_shards, ("lang", "source"), (quantise_log(F.col("size") / 16),))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
