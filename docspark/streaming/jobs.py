"""Continuous jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docspark.operators.blocks import extract_html
from docspark.operators.chunking import chunk_chars, pack_blocks
from docspark.operators.embedding import embed, upsert_embeddings, upsert_table
from docspark.operators.runs import TERMINAL
from docspark.sources.staging import release, stage


def index_batch(docs: DataFrame, max_chars: int = 1200, overlap: int = 200) -> DataFrame:
    chunks = chunk_chars(docs, max_chars, overlap).withColumnRenamed("doc_id", "index_id")
    rows = embed(chunks.withColumn("chunk_id", F.sha2(F.concat_ws(":", "index_id", "chunk_index"), 256)))
    return rows.withColumn("embed_signature", F.lit("hash-64")).select("index_id", "chunk_id", "chunk_index", "text", "embed_signature", "embedding")


def stream_index(docs: DataFrame, sink: str, checkpoint: str):
    """Chunks and embeddings of documents as they arrive. A batch writes its own folder, so a replay replaces what it wrote; ``read_index`` upserts the batches."""

    def write(batch: DataFrame, batch_id: int) -> None:
        index_batch(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, sink: str) -> DataFrame:
    """What ``stream_index`` wrote, upserted by (index, chunk, signature): the newest batch of a key wins."""
    rows = spark.read.parquet(sink)
    columns = [c for c in rows.columns if c != "batch"]
    return upsert_embeddings(rows.select(*columns).limit(0), rows.withColumnRenamed("batch", "seq"))


INDEX_COLUMNS = "index_id, chunk_id, chunk_index, text, text_norm, dominant_head, embed_signature, embedding"


def index_pages(pages: DataFrame, max_chars: int = 1200, overlap: int = 200, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Chunks with vectors of whole pages: blocks (X1), normalised (N3), packed (C4), embedded (E3). An index is a page."""
    return _indexed(extract_html(pages, id_col, html_col), max_chars, overlap)


def _indexed(blocks: DataFrame, max_chars: int = 1200, overlap: int = 200) -> DataFrame:
    chunks = pack_blocks(blocks, max_chars, overlap).withColumnRenamed("doc_id", "index_id")
    rows = embed(chunks.withColumn("chunk_id", F.sha2(F.concat_ws(":", "index_id", "chunk_index"), 256)), "text_norm")
    return rows.withColumn("embed_signature", F.lit("hash-64")).selectExpr(*INDEX_COLUMNS.split(", "))


def stream_index_pages(pages: DataFrame, table: str, checkpoint: str, parts: int = 64, order: str | None = None, id_col: str = "page_id", html_col: str = "html"):
    """T1 from markup into one table: each batch replaces what its pages had there.

    ``table`` is partitioned into ``parts`` by the hash of the page; a batch rewrites
    the parts of its pages only, into few files, so it never needs compacting. A
    page that comes again with fewer chunks loses the others, one without text
    loses all. Of several versions in a batch the largest ``order`` stays (else any,
    but always the same one). A replayed batch changes nothing. Pages without an
    id are left out.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        last = F.row_number().over(Window.partitionBy(id_col).orderBy(*[F.col(c).desc_nulls_last() for c in [order] if c], F.xxhash64(html_col), html_col))
        newest = batch.where(F.col(id_col).isNotNull()).withColumn("_n", last).where("_n = 1")
        # packing reads the blocks twice, and a page is parsed once
        blocks = stage(extract_html(newest, id_col, html_col), "page-blocks")
        upsert_table(_indexed(blocks), table, batch.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("index_id")), parts)
        release(blocks)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The state of a run: its first end, its last event and its first request to cancel, each with its place, and its number of events.
_STATE = "end_none boolean, end_seq long, end_status string, last_none boolean, last_seq long, last_status string, asked_none boolean, asked_seq long, n long"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunStates(StatefulProcessor):
    """One run: see ``stream_run_states``."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("run", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (None,) * 8 + (0,)
        end, last, asked, n = (held[0:3] if held[0] is not None else None), (held[3:6] if held[3] is not None else None), (held[6:8] if held[6] is not None else None), held[8]
        place = lambda x: (x[0], x[1] or 0, *x[2:])  # noqa: E731  null ones come last
        for part in rows:
            for seq, status in zip(part["seq"], part["status"]):
                n += 1
                at = (bool(pd.isna(seq)), None if pd.isna(seq) else int(seq))
                if status == "CANCEL":
                    asked = min(filter(None, (asked, at)), key=place)
                    continue
                event = (*at, status)
                if status in TERMINAL:
                    end = min(filter(None, (end, event)), key=place)
                if status is not None:
                    last = max(filter(None, (last, event)), key=place)
        self.state.update((*(end or (None,) * 3), *(last or (None,) * 3), *(asked or (None,) * 2), n))
        if end is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        flag = asked is not None and (end is None or place(asked) <= place(end[:2]))
        status = end[2] if end else last[2] if last else "PENDING"
        yield pd.DataFrame({"run_id": [key[0]], "status": [status], "cancel_requested": [flag], "n_events": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_run_states(events: DataFrame, keep_seconds: float = 86_400) -> DataFrame:
    """T2 with a state that ends: the rows of ``stream_run_status``, and a finished run is forgotten ``keep_seconds`` after its last event.

    An event of a run that was forgotten begins a new one. The state is kept by
    the RocksDB provider, which the session must name in
    ``spark.sql.streaming.stateStore.providerClass`` (``ROCKS_DB``).
    """
    told = f"run_id {events.schema['run_id'].dataType.simpleString()}, status string, cancel_requested boolean, n_events long"
    rows = events.select("run_id", F.col("seq").cast("long").alias("seq"), "status")
    return rows.groupBy("run_id").transformWithStateInPandas(RunStates(int(keep_seconds * 1000)), told, "Update", "processingTime")


def stream_run_status(events: DataFrame) -> DataFrame:
    """(run_id, status, cancel_requested, n_events) after each batch of (run_id, seq, status).

    The first terminal state by ``seq`` is final; CANCEL sets a flag while a run
    is active. The state is order-free, so neither frames nor batches need to
    arrive in order. Equal ``seq`` go by status, null ones come last.
    """
    at = [F.col("seq").isNull().alias("none"), F.col("seq").alias("seq")]
    event, cancel = F.struct(*at, F.col("status").alias("status")), F.col("status") == "CANCEL"
    seen = events.groupBy("run_id").agg(
        F.min(F.when(F.col("status").isin(*TERMINAL), event)).alias("end"),
        F.max(F.when(~cancel, event)).alias("last"),
        F.min(F.when(cancel, F.struct(*at))).alias("asked"),
        F.count(F.lit(1)).alias("n_events"),
    )
    flag = F.col("asked").isNotNull() & (F.col("end").isNull() | (F.col("asked") <= F.struct(F.col("end.none").alias("none"), F.col("end.seq").alias("seq"))))
    return seen.select("run_id", F.coalesce("end.status", "last.status", F.lit("PENDING")).alias("status"), F.coalesce(flag, F.lit(False)).alias("cancel_requested"), "n_events")


def distinct_messages(messages: DataFrame, within: str = "1 hour", id_col: str = "id", at: str = "created_at") -> DataFrame:
    """A stream of messages without those that were sent again ``within`` that time: ids are remembered no longer, so the state is bounded."""
    return messages.withWatermark(at, within).dropDuplicatesWithinWatermark([id_col])


def stream_chat_activity(messages: DataFrame, sink: str, checkpoint: str, within: str = "1 hour"):
    """Messages without repetitions, counted by chat. A batch writes its own folder, so a replay replaces it; ``read_chat_activity`` adds the batches up."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n_messages"), F.max("created_at").alias("updated_at")).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return distinct_messages(messages, within).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_chat_activity(spark: SparkSession, sink: str) -> DataFrame:
    """(chat_id, n_messages, updated_at) of what ``stream_chat_activity`` wrote."""
    return spark.read.parquet(sink).groupBy("chat_id").agg(F.sum("n_messages").alias("n_messages"), F.max("updated_at").alias("updated_at"))


def stream_touch_chats(messages: DataFrame) -> DataFrame:
    """Newest message time by chat, in update mode."""
    return messages.groupBy("chat_id").agg(F.max("created_at").alias("updated_at"))
