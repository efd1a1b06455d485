"""Projects, chats, messages, citations and metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.normalize import clip_text, collapse_ws, strip
from docspark.sources.tables import CITATIONS, METRICS


def project_catalog(projects: DataFrame, documents: DataFrame) -> DataFrame:
    """M1: projects with their primary document, ``place`` from the newest by owner.

    Projects are ranked inside an hour of their owner; counts by hour, which are
    small, give the places before it.
    """
    docs = documents.select(F.col("id").alias("primary_document_id"), "original_filename")
    listed = projects.join(docs, "primary_document_id").withColumn("_hour", F.coalesce(F.floor(F.unix_seconds("created_at") / 3600), F.lit(-(1 << 62))))
    hours = listed.groupBy("owner_id", "_hour").agg(F.count(F.lit(1)).alias("_n"))
    later = Window.partitionBy("owner_id").orderBy(F.col("_hour").desc()).rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select(F.col("owner_id").alias("_o"), F.col("_hour").alias("_h"), F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("owner_id", "_hour").orderBy(F.col("created_at").desc(), "id"))
    placed = listed.withColumn("_in", inside).join(hours, F.col("owner_id").eqNullSafe(F.col("_o")) & (F.col("_hour") == F.col("_h")))
    return placed.withColumn("place", (F.col("_before") + F.col("_in")).cast("int")).drop("_hour", "_in", "_o", "_h", "_before")


def apply_renames(projects: DataFrame, updates: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """M2: renamed projects, and the updates that are refused.

    A trimmed name has 1 to 200 characters. Of several renames of an id the one
    with the largest ``order`` wins (a column such as ``seq`` or ``updated_at``).
    Where there is no such column, or its largest value has different names, none
    can be told to be the last, and all of these are refused.
    """
    u = updates.withColumn("name", strip(F.coalesce("name", F.lit(""))))
    good = F.length("name").between(1, 200)
    last = F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("at")) if order else F.lit(0)
    tops = u.where(good).groupBy("id", last.alias("_at")).agg(F.min("name").alias("_name"), F.max("name").alias("_other"))
    tops = tops.groupBy("id").agg(F.max_by(F.struct("_name", "_other"), "_at").alias("_n"), F.max("_at").alias("_at")).select("id", "_n.*", "_at")
    clear = F.col("_name") == F.col("_other")
    named = tops.where(clear).select("id", "_name")
    doubt = tops.where(~clear).select(F.col("id").alias("_i"), F.col("_at").alias("_a"))
    unclear = u.where(good).join(doubt, (F.col("id") == F.col("_i")) & (last == F.col("_a")), "left_semi")
    return projects.join(named, "id", "left").withColumn("name", F.coalesce("_name", "name")).drop("_name"), u.where(~good).unionByName(unclear)


def owned(df: DataFrame, projects: DataFrame, owner: str = "owner_id") -> DataFrame:
    """Rows of chats whose project has the same owner."""
    return df.join(projects.select(F.col("id").alias("project_id"), F.col("owner_id").alias("_o")), "project_id").where(F.col(owner) == F.col("_o")).drop("_o")


def owned_chats(chats: DataFrame, projects: DataFrame, owner=None) -> DataFrame:
    """Chats of projects that exist, with the project's owner as ``owner_id``; only ``owner``'s if given."""
    rest = [c for c in chats.columns if c != "owner_id"]
    out = chats.select(*rest).join(projects.select(F.col("id").alias("project_id"), "owner_id"), "project_id")
    return out if owner is None else out.where(F.col("owner_id") == F.lit(owner))


def page_chats(chats: DataFrame, by=("owner_id", "project_id"), limit: int = 50, offset: int = 0, projects: DataFrame | None = None, owner=None) -> DataFrame:
    """M3: newest updated first, rows offset+1 to offset+limit of each key; with ``projects`` the owner is the project's."""
    chats = chats if projects is None else owned_chats(chats, projects, owner)
    n = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("updated_at").desc(), "id"))
    return chats.withColumn("place", n).where((F.col("place") > offset) & (F.col("place") <= offset + limit))


def recent_messages(messages: DataFrame, n: int = 20, before: Column | None = None, chats: DataFrame | None = None, projects: DataFrame | None = None, owner=None) -> DataFrame:
    """M4: the last ``n`` messages of each chat (strictly before a time), ``place`` from the oldest.

    With ``chats`` and ``projects``: of chats whose project exists and is ``owner``'s, if given.
    """
    df = messages if before is None else messages.where(F.col("created_at") < before)
    if chats is not None:
        df = df.join(owned_chats(chats, projects, owner).select(F.col("id").alias("chat_id")), "chat_id", "left_semi")
    last = F.row_number().over(Window.partitionBy("chat_id").orderBy(F.col("created_at").desc(), F.col("id").desc()))
    kept = df.withColumn("_r", last).where(F.col("_r") <= n)
    return kept.withColumn("place", F.count(F.lit(1)).over(Window.partitionBy("chat_id")) - F.col("_r") + 1).drop("_r")


def touch_chats(chats: DataFrame, new_messages: DataFrame, touch: bool = True) -> DataFrame:
    """M5: ``updated_at`` becomes the time of the newest message, if it is later."""
    if not touch:
        return chats
    newest = new_messages.groupBy("chat_id").agg(F.max("created_at").alias("_at"))
    return chats.join(newest, F.col("id") == F.col("chat_id"), "left").withColumn("updated_at", F.greatest("updated_at", F.coalesce("_at", "updated_at"))).drop("_at", "chat_id")


def delete_messages(messages: DataFrame, chat_ids: DataFrame, chats: DataFrame | None = None, projects: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """M6: what stays, and the count deleted by chat.

    ``chat_ids``: chat_id of owned chats; or, with ``chats`` and ``projects``,
    (chat_id, owner_id) as asked for, of which those of another owner's projects are left alone.
    """
    if chats is not None:
        mine = owned_chats(chats, projects).select(F.col("id").alias("chat_id"), "owner_id")
        chat_ids = chat_ids.join(mine, ["chat_id", "owner_id"], "left_semi").select("chat_id").distinct()
    gone = messages.join(chat_ids, "chat_id", "left_semi").groupBy("chat_id").agg(F.count(F.lit(1)).alias("deleted"))
    return messages.join(chat_ids, "chat_id", "left_anti"), gone


def history_text(messages: DataFrame, max_turns: int = 6, limit: int = 6000) -> DataFrame:
    """M7: ``role: text`` lines of the last turns; blanks are left out after the cut to ``max_turns``."""
    last = recent_messages(messages, max_turns).where(collapse_ws(F.col("content")) != "")
    lines = F.array_sort(F.collect_list(F.struct("place", F.concat("role", F.lit(": "), collapse_ws(F.col("content"))).alias("line"))))
    return last.groupBy("chat_id").agg(clip_text(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), limit).alias("history"))


def build_citations(packs: DataFrame, messages: DataFrame) -> DataFrame:
    """M8: ``citations`` (JSON) for assistant messages that have context chunks."""
    joined = messages.join(packs, "message_id", "left")
    body = F.to_json(F.struct("index_id", "metric", F.transform("chunks", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["score"].alias("score"), x["matched_by"].alias("matched_by"))).alias("chunks")))
    return joined.withColumn("citations", F.when((F.col("role") == "assistant") & (F.size("chunks") > 0), body)).drop("chunks", "index_id", "metric")


def parse_citations(df: DataFrame, column: str = "citations") -> DataFrame:
    """M9: JSON to a typed struct; absent keys are null."""
    return df.withColumn("cited", F.from_json(column, CITATIONS))


def serialize_citations(df: DataFrame, column: str = "cited") -> DataFrame:
    return df.withColumn("citations", F.to_json(column))


def hydrate_citations(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(message_id, place, chunk_id, score, matched_by, text): text of each cited chunk, null where it is gone; every field stays."""
    rows = parse_citations(messages).select("message_id", F.col("cited.index_id").alias("index_id"), F.posexplode_outer("cited.chunks").alias("place", "c"))
    rows = rows.select("message_id", "index_id", "place", "c.chunk_id", "c.score", "c.matched_by")
    return rows.join(chunks.select("index_id", "chunk_id", "text"), ["index_id", "chunk_id"], "left")


def hydrated_messages(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every message with ``cited``: its citations, each chunk with its ``content`` (null where the chunk is gone); null without citations."""
    found = hydrate_citations(messages, chunks).where("place IS NOT NULL")
    one = F.struct("place", "chunk_id", "score", "matched_by", F.col("text").alias("content"))
    lists = found.groupBy(F.col("message_id").alias("_m")).agg(F.array_sort(F.collect_list(one)).alias("_c"))
    out = parse_citations(messages).join(lists, F.col("message_id") == F.col("_m"), "left")
    chunk = lambda x: F.struct(*[x[c].alias(c) for c in ("chunk_id", "score", "matched_by", "content")])
    fields = [f.name for f in out.schema["cited"].dataType.fields if f.name != "chunks"]
    cited = F.struct(*[F.col(f"cited.{f}").alias(f) for f in fields], F.transform(F.coalesce("_c", F.array().cast(lists.schema["_c"].dataType)), chunk).alias("chunks"))
    return out.withColumn("cited", F.when(F.col("cited").isNotNull(), cited)).drop("_m", "_c")


def parse_metrics(df: DataFrame, column: str = "metrics") -> DataFrame:
    """Token and latency totals; absent parts are 0, bad JSON is tolerated."""
    m = df.withColumn("_m", F.from_json(column, METRICS))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    prompt = zero("_m.prompt.system") + zero("_m.prompt.context") + zero("_m.prompt.history") + zero("_m.prompt.question")
    stages = [F.col(f"_m.latency.{x}") for x in ("rewrite", "retrieval", "generation")]
    any_stage = stages[0].isNotNull() | stages[1].isNotNull() | stages[2].isNotNull()
    out = m.withColumns({"prompt_tokens": prompt, "completion_tokens": zero("_m.completion")})
    latency = F.when(any_stage, sum((F.coalesce(s, F.lit(0.0)) for s in stages), F.lit(0.0)))
    return out.withColumns({"total_tokens": F.col("prompt_tokens") + F.col("completion_tokens"), "latency": latency}).drop("_m")


#: Size of the quantile sketches: ranks are within about 1.65 % with 99 % confidence.
SKETCH_K = 200


def metrics_cube(parsed: DataFrame, sets: tuple[tuple[str, ...], ...] = (("chat_id",), ("project_id",), ())) -> DataFrame:
    """Answers, total_tokens, latency sums and a quantile sketch by each of ``sets`` of columns, in one pass.

    A column that a set does not have is null there; ``level`` is the number of
    the set. Sketches can be merged, over days or levels, by ``merge_metrics``, and
    read by ``latency_quantile``. Answers without a latency count, and are not in
    its sum and sketch.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    kept = parsed.select(*columns, "total_tokens", F.col("latency").cast("double").alias("latency"))
    level = F.grouping_id(*columns)
    names = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s): n for n, s in enumerate(sets)}
    told = kept.groupingSets([list(s) for s in sets], *columns).agg(
        level.alias("_id"), F.count(F.lit(1)).alias("answers"), F.sum("total_tokens").alias("total_tokens"), F.count("latency").alias("timed"), F.sum("latency").alias("latency"), F.kll_sketch_agg_double("latency", F.lit(SKETCH_K)).alias("sketch"),
    )
    number = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return told.select(number[F.col("_id").cast("int")].alias("level"), *columns, "answers", "total_tokens", "timed", "latency", "sketch")


def merge_metrics(cubes: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Rows of ``metrics_cube`` added up by ``by``, their sketches merged."""
    return cubes.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("answers", "total_tokens", "timed", "latency")], F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"))


def latency_quantile(q: float) -> Column:
    return F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))


def metrics_rollup(parsed: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """M12 of one level."""
    return parsed.groupBy(*by).agg(F.count(F.lit(1)).alias("answers"), F.sum("total_tokens").alias("total_tokens"), F.avg("latency").alias("avg_latency"), F.percentile_approx("latency", 0.5).alias("p50_latency"))


def display_queries(df: DataFrame) -> DataFrame:
    """Rewrites, else the single rewrite, else the original question."""
    many = F.when(F.size("rewritten_queries") > 0, F.col("rewritten_queries"))
    one = F.when(F.trim("rewritten_query") != "", F.array("rewritten_query"))
    return df.withColumn("shown", F.coalesce(many, one, F.array("original_query")))


def latest_answer(messages: DataFrame) -> DataFrame:
    """M14."""
    best = F.max_by(F.struct("id", "content", "created_at"), F.struct("created_at", "id"))
    return messages.where("role = 'assistant'").groupBy("chat_id").agg(best.alias("m")).select("chat_id", "m.*")


# Fixed value: a run of word characters, or one character that is neither of a word nor white space.
TOKEN = r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f]"


def token_count(text: Column, tokenizer: Callable[[str], int] | None = None) -> Column:
    """Tokens of a text, built in unless a tokenizer is plugged in; null and empty are 0."""
    if tokenizer is None:
        return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([tokenizer(t) if t else 0 for t in b], dtype="int64")

    return F.pandas_udf(run, "long")(text)


def count_tokens(df: DataFrame, text_col: str = "text", tokenizer: Callable[[str], int] | None = None) -> DataFrame:
    """``n_tokens``."""
    return df.withColumn("n_tokens", token_count(F.col(text_col), tokenizer))


def count_message_tokens(messages: DataFrame, by: str = "chat_id", tokenizer: Callable[[str], int] | None = None) -> DataFrame:
    """3 a message and its content, 1 more if it is named, 3 once for the reply."""
    named = F.when(F.col("name").isNotNull(), 1).otherwise(0) if "name" in messages.columns else F.lit(0)
    return count_tokens(messages, "content", tokenizer).groupBy(by).agg((F.sum(3 + F.col("n_tokens") + named) + 3).alias("n_tokens"))


def history_tokens(messages: DataFrame, max_turns: int = 6, tokenizer: Callable[[str], int] | None = None) -> DataFrame:
    """``messages`` with ``history_tokens``: of the last ``max_turns`` messages of the chat before each, blank ones counting 0. One sort by chat, no join."""
    before = Window.partitionBy("chat_id").orderBy("created_at", "id").rowsBetween(-max_turns, -1)
    n = F.when(collapse_ws(F.col("content")) != "", F.col("_n")).otherwise(F.lit(0))
    counted = messages.withColumn("_n", token_count(F.col("content"), tokenizer))
    return counted.withColumn("history_tokens", F.coalesce(F.sum(n).over(before), F.lit(0))).drop("_n")


def prompt_breakdown(questions: DataFrame, history: DataFrame | None = None, tokenizer: Callable[[str], int] | None = None) -> DataFrame:
    """System, context, question and history tokens by question_id; blank turns do not count.

    ``history``: turns (question_id, content) of each question; without it, ``questions`` has ``history_tokens``.
    """
    own = questions.select("question_id", *[token_count(F.col(c), tokenizer).alias(f"{c}_tokens") for c in ("system", "context", "question")], *([] if history is not None else ["history_tokens"]))
    if history is None:
        return own
    turns = count_tokens(history.where(collapse_ws(F.col("content")) != ""), "content", tokenizer).groupBy("question_id").agg(F.sum("n_tokens").alias("history_tokens"))
    return own.join(turns, "question_id", "left").withColumn("history_tokens", F.coalesce("history_tokens", F.lit(0)))


def assemble_answers(pieces: DataFrame) -> DataFrame:
    """Pieces by ``seq`` into one answer with its token sum."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("t"))))
    return pieces.groupBy("answer_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias("text"), F.sum("n_tokens").alias("n_tokens"))


def duplicate_users(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New rows whose e-mail exists or repeats among the new; null is no e-mail. Repeats are counted before they meet their rows."""
    repeated = new.groupBy("email").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("email")
    return new.join(existing.select("email").union(repeated).distinct(), "email", "left_semi")
