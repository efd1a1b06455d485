"""Tables that cut lineage, and names and parts for the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from docspark.sources.staging import mark, read_table, release, release_since, shared_folder, stage  # noqa: F401


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, with as many underscores behind it as it takes to be none of ``columns`` (in either case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def parallelism(spark: SparkSession) -> int:
    """Parts for a small table whose rows are much work each."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
