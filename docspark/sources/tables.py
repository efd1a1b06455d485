"""Reading, writing and the schemas of the corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.sources.staging import read_table
from docspark.sources.staging import shared_folder as work_folder  # noqa: F401  the folder that all executors share

CITATIONS = (
    "struct<index_id:string,embed_signature:string,metric:string,top_k:int,model:string,query:string,rewritten_query:string,"
    "rewritten_queries:array<string>,rewrite_strategy:string,original_query:string,"
    "chunks:array<struct<chunk_id:string,score:double,matched_by:array<int>>>>"
)
METRICS = "struct<prompt:struct<system:bigint,context:bigint,history:bigint,question:bigint>,completion:bigint,latency:struct<rewrite:double,retrieval:double,generation:double>>"


def read_documents(spark: SparkSession, glob: str) -> DataFrame:
    """Stored documents as (path, length, content)."""
    return spark.read.format("binaryFile").load(glob).select("path", "length", "content")


def read_markup(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(glob).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("markup"))


def parse_storage_path(df: DataFrame, path: str = "path") -> DataFrame:
    """Owner, project and file name of ``…/owner/project/file``."""
    parts = F.split(F.regexp_replace(F.col(path), r"[?#].*", ""), "/")
    return df.withColumns({"owner_id": F.try_element_at(parts, F.lit(-3)), "project_id": F.try_element_at(parts, F.lit(-2)), "file_name": F.try_element_at(parts, F.lit(-1))})


EMBED_CONFIG = "struct<provider:string,model:string,batch_size:int,dimensions:int>"
#: The eight tables of a deployment; ``meta`` and the JSON columns are read as text and parsed where they are used.
SCHEMAS = {
    "document_indexes": f"id string, project_id string, document_id string, storage_path string, status string, progress int, message string, error string, cancel_requested boolean, chunker_version string, embed_config {EMBED_CONFIG}, embed_signature string, meta string, created_at timestamp, updated_at timestamp",
    "chunks": "id string, index_id string, chunk_index int, text string, text_norm string, meta string, created_at timestamp",
    "chunk_embeddings": "id string, index_id string, chunk_id string, chunk_index int, embed_signature string, embedding array<float>, created_at timestamp",
    "projects": "id string, owner_id string, name string, created_at timestamp, primary_document_id string",
    "project_documents": "id string, project_id string, original_filename string, storage_path string, content_type string, size_bytes bigint, uploaded_at timestamp",
    "chats": "id string, owner_id string, project_id string, title string, created_at timestamp, updated_at timestamp",
    "chat_messages": "id string, chat_id string, role string, content string, created_at timestamp, citations string, metrics string",
    "users": "id string, email string, name string, is_active boolean, created_at timestamp",
}


def load_tables(spark: SparkSession, folder: str, names=tuple(SCHEMAS), schemas: dict[str, str] = SCHEMAS) -> dict[str, DataFrame]:
    """S3: tables by name; one that ``schemas`` knows has these columns and types whatever its files hold (a missing column is null)."""
    at = lambda n: f"{folder}/{n}.parquet"
    return {n: spark.read.schema(schemas[n]).parquet(at(n)) if n in schemas else spark.read.parquet(at(n)) for n in names}


def load_database(spark: SparkSession, url: str, names=tuple(SCHEMAS), parts: int = 16, **options: str) -> dict[str, DataFrame]:
    """S3 from a database that Spark reads by JDBC, each table in ``parts`` ranges of creation time where ``lowerBound`` and ``upperBound`` are given."""
    ranged = {"partitionColumn": "created_at", "numPartitions": str(parts)} if {"lowerBound", "upperBound"} <= set(options) else {}
    return {n: spark.read.format("jdbc").options(url=url, dbtable=n, **ranged, **options).load() for n in names}


def write_chunks(df: DataFrame, path: str, by: tuple[str, ...] = ("index_id",), batch: int | None = None) -> None:
    """Append; nothing happens for no rows. With ``batch`` the rows have a folder of their own, so writing them again replaces them."""
    if df.isEmpty():
        return
    if batch is None:
        df.write.mode("append").partitionBy(*by).parquet(path)
    else:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch={batch}")


def nest_blocks(blocks: DataFrame, key: list[str], order: str = "pos") -> DataFrame:
    """A row per key with its blocks in order. A document is bounded; documents are the scale."""
    rest = [c for c in blocks.columns if c not in (*key, order)]
    return blocks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("blocks"))


def unnest_blocks(df: DataFrame, column: str = "blocks") -> DataFrame:
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.inline(column))


def concat_pages(pages: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Page texts joined in page order."""
    from docspark.functions.normalize import strip

    sorted_pages = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return pages.groupBy(key).agg(strip(F.array_join(F.transform(sorted_pages, lambda x: x["t"]), "\n")).alias("text"))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


def projects(spark: SparkSession, d: str) -> DataFrame:
    """Customers as projects of their nation."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("c_custkey") * 60)
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("owner_id"), F.col("c_name").alias("name"), at.alias("created_at"), F.col("c_custkey").alias("primary_document_id")
    )


def index_runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as index runs: the user is the project, the type the status."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.create_map(*[F.lit(x) for pair in STATUS_OF.items() for x in pair])
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("project_id"), F.col("user_id").alias("document_id"), status[F.col("event_type")].alias("status"),
        F.least(F.greatest(k, F.lit(0)), F.lit(100)).alias("progress"), F.concat(F.lit("sig"), k % 3).alias("embed_signature"), (k % 10 == 0).alias("cancel_requested"), F.col("ts").alias("created_at"),
    )


STATUS_OF = {"signup": "PENDING", "view": "RUNNING", "click": "READY", "error": "FAILED", "purchase": "CANCELLED"}


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as chat messages, a minute apart."""
    return table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("chat_id"), "role", F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(1735689600) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("created_at"),
    )


def chats(spark: SparkSession, d: str) -> DataFrame:
    """One chat for each conversation, owned through its project."""
    first = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"))
    at = F.timestamp_seconds(F.lit(1735689600) + F.col("conv_id") * 3600)
    return first.select(F.col("conv_id").alias("id"), (F.col("conv_id") % 50).alias("project_id"), (F.col("conv_id") % 50 % 7).alias("owner_id"), F.concat(F.lit("chat "), "conv_id").alias("title"), at.alias("created_at"), at.alias("updated_at"))


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))
