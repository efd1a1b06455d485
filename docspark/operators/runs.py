"""Index runs, ownership and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE, TERMINAL = ("PENDING", "RUNNING"), ("READY", "FAILED", "CANCELLED")
STATUSES = ACTIVE + TERMINAL
# Progress at the start of each step.
STEP_PROGRESS = {"QUEUED": 0, "EXTRACTING": 5, "CHUNKING": 20, "EMBEDDING": 60, "STORING": 85, "FINALIZING": 95}


def _newest() -> list[Column]:
    """Order keys whose minimum is the newest run and, of these, the one with the smallest id, which may be of any type."""
    return [F.col("created_at").isNull().alias("_none"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("_age"), F.col("id").alias("_tie")]


def latest_runs(indexes: DataFrame, by: tuple[str, ...] = ("project_id",), statuses=None, signature: str | None = None, projects: DataFrame | None = None) -> DataFrame:
    """Newest run by key; one pass with map-side combine, no sort."""
    df = indexes
    if statuses:
        df = df.where(F.col("status").isin(*statuses))
    if signature is not None:
        df = df.where(F.col("embed_signature") == signature)
    if projects is not None:
        df = scope_to_owner(df, projects)
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*_newest())).alias("r")).select(*by, *[f"r.{c}" for c in rest])


def current_run(indexes: DataFrame, signature: str) -> DataFrame:
    """The newest READY run with the signature, else the newest active one."""
    rank = F.when((F.col("status") == "READY") & (F.col("embed_signature") == signature), 2).when(F.col("status").isin(*ACTIVE), 1)
    df = indexes.withColumn("_rank", rank).where("_rank IS NOT NULL")
    best = F.min_by(F.struct("id", "status", "created_at"), F.struct((-F.col("_rank")).alias("_first"), *_newest()))
    return df.groupBy("project_id").agg(best.alias("r")).select("project_id", "r.*")


def scope_to_owner(df: DataFrame, projects: DataFrame, owner: Column | None = None) -> DataFrame:
    """Rows of projects that exist, with ``owner_id``; only ``owner``'s if given."""
    out = df.join(projects.select(F.col("id").alias("project_id"), "owner_id"), "project_id")
    return out if owner is None else out.where(F.col("owner_id") == owner)


def plan_runs(requests: DataFrame, projects: DataFrame, indexes: DataFrame) -> DataFrame:
    """I4: ``action`` (new, reuse, rejected), ``reason`` and the reused ``run_id`` for (owner_id, project_id, document_id, embed_signature)."""
    p = projects.select(F.col("id").alias("project_id"), F.col("owner_id").alias("_o"), F.col("primary_document_id").alias("_d"))
    active = latest_runs(indexes, ("project_id", "embed_signature"), ACTIVE).select("project_id", "embed_signature", F.col("id").alias("run_id"))
    df = requests.join(p, "project_id", "left").join(active, ["project_id", "embed_signature"], "left")
    reason = F.when(F.col("_o").isNull() | (F.col("_o") != F.col("owner_id")), "project_not_found").when(F.col("_d").isNull() | (F.col("_d") != F.col("document_id")), "document_not_found")
    action = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("run_id").isNotNull(), "reuse").otherwise("new")
    out = df.withColumn("reason", reason).withColumn("action", action)
    return out.withColumn("run_id", F.when(F.col("action") == "reuse", F.col("run_id"))).drop("_o", "_d")


def progress(status: Column, step: Column, done: Column, total: Column) -> Column:
    """By status, else by step; embedding goes from 60 to 85 by part done."""
    steps = F.create_map(*[F.lit(x) for pair in STEP_PROGRESS.items() for x in pair])
    embedding = F.lit(60) + F.floor(25 * done / total)
    by_step = F.when((step == "EMBEDDING") & (total > 0), embedding).otherwise(F.coalesce(F.try_element_at(steps, step), F.lit(0)))
    return F.when(status == "READY", 100).when(status.isin("FAILED", "CANCELLED"), 0).otherwise(by_step).cast("int")


def apply_status(indexes: DataFrame, updates: DataFrame, fields=("status", "progress")) -> DataFrame:
    """The last update (by ``seq``) replaces all its fields."""
    last = updates.groupBy("id").agg(F.max_by(F.struct(*fields), "seq").alias("_u"))
    out = indexes.join(last, "id", "left")
    return out.select(*[F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in indexes.columns])


def apply_cancels(indexes: DataFrame, requests: DataFrame) -> DataFrame:
    """Flags runs that are neither terminal nor flagged; ``message`` tells it."""
    asked = requests.select("id").distinct().withColumn("_asked", F.lit(True))
    hit = F.coalesce(F.col("_asked"), F.lit(False)) & ~F.col("status").isin(*TERMINAL) & ~F.col("cancel_requested")
    out = indexes.join(asked, "id", "left").withColumn("_hit", hit)
    return out.withColumns({"cancel_requested": F.col("cancel_requested") | F.col("_hit"), "message": F.when(F.col("_hit"), "Cancellation requested")}).drop("_asked", "_hit")


def _cascade(tables: dict[str, tuple], ids: DataFrame):
    """(name, rows, column that points to the parent, keys of the parent that go) for each table, parents first."""
    keys: dict[str, DataFrame] = {}
    above = None
    for name, (df, key, parent, *of) in tables.items():
        gone = ids.select(F.col("id").alias("_gone")) if parent is None else keys[of[0] if of else above]
        at = key if parent is None else parent
        keys[name] = df.join(gone, F.col(at) == F.col("_gone"), "left_semi").select(F.col(key).alias("_gone"))
        yield name, df, at, gone
        above = name


def cascade_delete(tables: dict[str, tuple], ids: DataFrame) -> dict[str, DataFrame]:
    """I8: removes ``ids`` (column id) from the first table, and in each next the rows whose parent is gone.

    ``tables``: name to (rows, own key, key of the parent, name of the parent),
    parents first; without a name the parent is the table before.
    """
    return {name: df.join(gone, F.col(at) == F.col("_gone"), "left_anti") for name, df, at, gone in _cascade(tables, ids)}


def cascade_files(tables: dict[str, tuple], ids: DataFrame, paths: dict[str, str]) -> DataFrame:
    """I8: (name, path) of the stored files that go with the rows ``cascade_delete`` removes; ``paths``: table to its column."""
    out = None
    for name, df, at, gone in _cascade(tables, ids):
        if name in paths:
            files = df.join(gone, F.col(at) == F.col("_gone"), "left_semi").where(F.col(paths[name]).isNotNull()).select(F.lit(name).alias("name"), F.col(paths[name]).alias("path"))
            out = files if out is None else out.unionByName(files)
    return out.distinct()


def check_integrity(rows: DataFrame, key: list[str], parent: DataFrame | None = None, foreign: str | None = None, checks: dict[str, Column] | None = None) -> DataFrame:
    """(rule, n) of broken rules: repeated keys, missing parents, failed checks."""
    found = [rows.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unique_key").alias("rule"), "n")]
    if parent is not None:
        orphans = rows.where(F.col(foreign).isNotNull()).join(parent.select(F.col(parent.columns[0]).alias(foreign)), foreign, "left_anti")
        found.append(orphans.agg(F.count(F.lit(1)).alias("n")).select(F.lit("foreign_key").alias("rule"), "n"))
    for name, ok in (checks or {}).items():
        found.append(rows.agg(F.sum((~F.coalesce(ok, F.lit(False))).cast("long")).alias("n")).select(F.lit(name).alias("rule"), F.coalesce("n", F.lit(0)).alias("n")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
