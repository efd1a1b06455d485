"""Full-text retrieval on posting tables (L1-L4).

A query is a list of clauses of which one must hold; a clause is a list of words
and phrases that a chunk must hold, and of others that it must not. Rank is by
cover density: a cover is a smallest stretch of places that holds all words and
phrases of some clause that the chunk satisfies, and no smaller such stretch. It
counts 0.1 / (1 + its places beyond as many as the clause has terms).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from docspark.functions.stem import ENGLISH_STOP_WORDS, english, stem
from docspark.operators import rowsearch
from docspark.sources.staging import stage

# Frequent English words that carry no meaning of their own.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it its my not of on or our she so that the "
    "their them they this to was we were what when which who will with you your"
).split()
TERM = r"[\p{L}\p{N}]+"
#: Different query terms up to this many are looked up in the row that holds the words; more meet the postings by a join.
BROADCAST_TERMS = 500_000
#: Questions of at most so many terms in all are sent to the rows of chunks that have no postings.
QUESTION_TERMS = 200_000
#: Clauses of negations only that meet all chunks of their scope at a time.
QUERY_BLOCK = 10_000
#: Different terms that a search of a table of postings names one by one.
BUCKET_TERMS = 1000


def build_postings(
    chunks: DataFrame, id_col: str = "chunk_id", stop_words: Iterable[str] | None = None, stemmed: bool = False, by: tuple[str, ...] = (), only: DataFrame | None = None,
) -> DataFrame:
    """L1: (chunk_id, the columns ``by``, term, positions, tf), terms stemmed on demand.

    A chunk is one row, and its postings are gathered inside it: nothing is
    shuffled. ``text_norm`` is read where there is one, else ``text``; stop words
    keep their position and are ``STOP_WORDS``, for stems the longer English list.
    ``only`` (term): positions are gathered for these terms (or stems) alone. Null
    and empty texts have no postings; a repeated row has its own again.
    """
    words = _words(chunks, id_col, by)
    stop = frozenset((ENGLISH_STOP_WORDS if stemmed else STOP_WORDS) if stop_words is None else stop_words)
    asked, wanted = None, None
    if only is not None:
        asked = only.select("term").distinct()
        wanted = frozenset(r["term"] for r in asked.collect()) if asked.count() <= BROADCAST_TERMS else None
    kept = ["chunk_id", *by]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(s, e - s) for b in batches for s, e in rowsearch.pieces(b, b["words"])):
            lists = pa.concat_arrays([b["words"]])  # from its first word
            flat = lists.flatten().dictionary_encode()
            known = flat.dictionary.to_pylist()
            keep = np.array([w not in stop for w in known], dtype=bool)
            if stemmed:
                known = [english(w) for w in known]
            number = {w: i for i, w in enumerate(dict.fromkeys(known))}
            names, code = list(number), np.array([number[w] for w in known], dtype=np.int64)
            if wanted is not None:
                keep &= np.array([w in wanted for w in known], dtype=bool)
            raw = flat.indices.to_numpy(zero_copy_only=False)
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            many = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            place = np.arange(len(raw)) - (np.cumsum(many) - many)[row] + 1
            left = keep[raw] if len(raw) else np.zeros(0, dtype=bool)
            row, place, term = row[left], place[left], code[raw[left]]
            group = row.astype(np.int64) * max(len(names), 1) + term
            order = np.argsort(group, kind="stable")
            group, place = group[order], place[order]
            first = np.flatnonzero(np.diff(group, prepend=-1))
            ends = np.append(first, len(group))
            rows, terms = group[first] // max(len(names), 1), group[first] % max(len(names), 1)
            yield pa.RecordBatch.from_arrays(
                [*(b[c].take(pa.array(rows)) for c in kept), pa.array(names, pa.string()).take(pa.array(terms)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32())), pa.array(np.diff(ends))],
                [*kept, "term", "positions", "tf"],
            )

    told = StructType([*(words.schema[c] for c in kept), StructField("term", StringType()), StructField("positions", ArrayType(IntegerType())), StructField("tf", LongType())])
    out = words.mapInArrow(gather, told)
    return out if asked is None or wanted is not None else out.join(asked, "term", "left_semi").select(*kept, "term", "positions", "tf")


def _words(chunks: DataFrame, id_col: str, by: tuple[str, ...]) -> DataFrame:
    source = F.coalesce("text_norm", "text") if "text_norm" in chunks.columns else F.col("text")
    return chunks.select(F.col(id_col).alias("chunk_id"), *by, F.regexp_extract_all(F.lower(source), F.lit(TERM), F.lit(0)).alias("words"))


def write_postings(postings: DataFrame, table: str, buckets: int = 200) -> None:
    """A table of postings in ``buckets`` files by the hash of the term, each sorted by term."""
    postings.repartition(buckets, "term").write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(table)


def read_postings(spark: SparkSession, table: str, parsed: DataFrame) -> DataFrame:
    """The postings of the terms of ``parsed``: only their buckets are opened, and in these only the parts that hold them.

    More than ``BUCKET_TERMS`` different terms meet the table by a join that needs no shuffle of it.
    """
    postings = spark.table(table)
    terms = [r["term"] for r in parsed.select("term").distinct().limit(BUCKET_TERMS + 1).collect()]
    return postings.where(F.col("term").isin(terms)) if len(terms) <= BUCKET_TERMS else postings.join(parsed.select("term").distinct(), "term", "left_semi").select(postings.columns)


def parse_queries(queries: DataFrame, stop_words: Iterable[str] | None = None, stemmed: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """L2: web-search syntax to (query_id, the columns ``by``, clause, kind, phrase, size, pos, term).

    Words are joined by and, ``or`` opens another clause, a quoted phrase keeps
    its word distances, a leading ``-`` forbids what it stands before: a word, or a
    phrase (in quotes, or several words that signs join). ``phrase`` numbers the
    pieces, ``size`` counts the terms of each. Stop words are no terms.
    """
    stop = sorted((ENGLISH_STOP_WORDS if stemmed else STOP_WORDS) if stop_words is None else stop_words)
    piece = r'-?"[^"]*"|\S+'
    rows = queries.select("query_id", *by, F.posexplode(F.regexp_extract_all(F.lower("query"), F.lit(piece), F.lit(0))).alias("n", "piece"))
    opens = (F.col("piece") == "or").cast("int")
    clause = F.sum(opens).over(Window.partitionBy("query_id").orderBy("n"))
    rows = rows.withColumn("clause", clause).where("piece <> 'or'")
    words = F.transform(F.regexp_extract_all("piece", F.lit(TERM), F.lit(0)), lambda w, i: F.struct(i.alias("pos"), w.alias("term")))
    rows = rows.withColumn("terms", F.filter(words, lambda w: ~w["term"].isin(*stop)) if stop else words)
    size = F.size("terms")
    kind = F.when(F.col("piece").startswith("-"), F.when(size > 1, "not_phrase").otherwise("not")).when(F.col("piece").contains('"'), "phrase").otherwise("word")
    terms = rows.select("query_id", *by, F.col("clause").cast("int").alias("clause"), kind.alias("kind"), F.col("n").alias("phrase"), size.alias("size"), F.explode("terms").alias("w"))
    terms = terms.select("query_id", *by, "clause", "kind", "phrase", "size", "w.pos", "w.term")
    return terms.withColumn("term", stem(F.col("term"))) if stemmed else terms


def _starts(rows: Column, phrase: Column) -> Column:
    """Where the first term of a phrase stands with all its others at their places; ``rows`` are the found terms (phrase, size, pos, positions)."""
    own = F.array_distinct(F.filter(rows, lambda r: r["phrase"] == phrase))  # a repeated chunk has its postings twice
    lead = F.get(F.array_sort(own), F.lit(0))
    holds = lambda s: F.forall(own, lambda r: F.array_contains(r["positions"], s - lead["pos"] + r["pos"]))
    return F.when(F.size(own) == lead["size"], F.filter(lead["positions"], holds)).otherwise(F.array().cast("array<int>"))


def _phrases(rows: Column) -> Column:
    """Each phrase among the found terms as (starts, width)."""
    width = lambda p: F.array_max(F.transform(F.filter(rows, lambda r: r["phrase"] == p), lambda r: r["pos"])) - F.array_min(F.transform(F.filter(rows, lambda r: r["phrase"] == p), lambda r: r["pos"])) + 1
    return F.transform(F.array_distinct(F.transform(rows, lambda r: r["phrase"])), lambda p: F.struct(_starts(rows, p).alias("starts"), width(p).alias("width")))


def fts_match(postings: DataFrame, parsed: DataFrame, by: tuple[str, ...] = (), chunks: DataFrame | None = None) -> DataFrame:
    """L3: (query_id, chunk_id, clauses) of chunks that satisfy a clause: all its words and phrases, and none of what it forbids.

    ``clauses`` are those that hold: ``terms``, how many different ones it asks for,
    and its ``literals``, each with the ``starts`` where it stands and its ``width``.
    The rarest term of a clause names its candidates; only these meet the
    postings of its other terms (of the same ``by``), by equi-joins that Spark
    can split where a term is frequent. A clause that only forbids is met by all
    chunks of its scope but those that hold what it forbids: ``chunks`` (chunk_id,
    ``by``) names them, else all that have postings. ``postings`` is read several
    times and should be a table.
    """
    clause = ["query_id", "clause"]
    asks = F.col("kind").isin("word", "phrase")
    found = postings.select("term", *by, "chunk_id", "positions")
    rows = found.groupBy("term", *by).agg(F.count(F.lit(1)).alias("df"))
    # a clause with a term that no chunk holds has no chunk
    leads = parsed.where(asks).select(*clause, *by, "term").distinct().join(rows, ["term", *by], "left").groupBy(*clause, *by).agg(
        F.count(F.lit(1)).alias("need"), F.count("df").alias("known"), F.min_by("term", F.struct("df", "term")).alias("term")
    ).where("need = known").select(*clause, *by, "need", "term")
    candidates = leads.join(found.select("term", *by, "chunk_id"), ["term", *by]).select(*clause, "chunk_id", "need")
    part = F.struct("phrase", "size", "pos", "positions")
    held = candidates.join(parsed, clause).join(found, ["term", *by, "chunk_id"]).groupBy(*clause, "chunk_id").agg(
        F.max("need").alias("need"), F.collect_set(F.when(asks, F.col("term"))).alias("terms"), F.collect_set(F.when(F.col("kind") == "word", F.struct(F.col("positions").alias("starts"), F.lit(1).alias("width")))).alias("words"),
        F.collect_list(F.when(F.col("kind") == "phrase", part)).alias("phrases"), F.bool_or(F.col("kind") == "not").alias("banned"), F.collect_list(F.when(F.col("kind") == "not_phrase", part)).alias("barred"),
    ).where((F.size("terms") == F.col("need")) & ~F.col("banned"))
    held = held.withColumn("phrases", _phrases(F.col("phrases"))).where(F.forall("phrases", lambda p: F.size(p["starts"]) > 0) & ~F.exists(_phrases(F.col("barred")), lambda p: F.size(p["starts"]) > 0))
    full = held.select(*clause, "chunk_id", F.struct(F.col("need").cast("int").alias("terms"), F.concat("words", "phrases").alias("literals")).alias("c"))
    pure = parsed.groupBy(*clause, *by).agg(F.bool_or(asks).alias("asks")).where("NOT asks").select(*clause, *by)
    if many := pure.count():
        scope = (postings if chunks is None else chunks).select("chunk_id", *by).distinct()
        barred = pure.join(parsed, [*clause, *by]).join(found, ["term", *by]).groupBy(*clause, "chunk_id").agg(F.bool_or(F.col("kind") == "not").alias("banned"), F.collect_list(F.when(F.col("kind") == "not_phrase", part)).alias("barred"))
        barred = barred.where(F.col("banned") | F.exists(_phrases(F.col("barred")), lambda p: F.size(p["starts"]) > 0)).select(*clause, "chunk_id")
        none = F.struct(F.lit(0).alias("terms"), F.array().cast(full.schema["c"].dataType["literals"].dataType).alias("literals"))
        blocks = -(-many // QUERY_BLOCK)
        for i in range(blocks):
            block = F.broadcast(pure.where(F.pmod(F.xxhash64(*clause), F.lit(blocks)) == i))
            open_ = (scope.join(block, list(by)) if by else scope.join(block)).join(barred, [*clause, "chunk_id"], "left_anti")
            full = full.unionByName(open_.select(*clause, "chunk_id", none.alias("c")))
    return full.groupBy("query_id", "chunk_id").agg(F.collect_list("c").alias("clauses"))


def _covers(clause: np.ndarray, many: np.ndarray, literal: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(clause, start, end) of stretches that hold every literal of a clause, the shortest for each end, by one sweep over the places.

    One entry for each place of a literal (its number in its clause, of which
    there are ``many``). The stretch that ends at a place begins at the least of
    the last starts of all literals.
    """
    span = int(end.max()) + 2
    alone = many[clause] == 1
    if alone.any() and not alone.all():  # each place of the only literal is such a stretch: no need to sweep
        swept = _covers(clause[~alone], many, literal[~alone], start[~alone], end[~alone])
        return tuple(np.concatenate(x) for x in zip(swept, (clause[alone], start[alone], end[alone])))
    base = clause.astype(np.int64) * span
    order = np.argsort(base + end, kind="stable")
    clause, literal, base, first, end = clause[order], literal[order], base[order], (base + start)[order], end[order]
    begin = np.full(len(end), np.iinfo(np.int64).max)
    for t in range(int(many.max())):
        last = np.maximum.accumulate(np.where(literal == t, first, -1))
        asked = many[clause] > t
        begin[asked] = np.minimum(begin[asked], last[asked])
    new = begin >= base
    new[1:] &= begin[1:] != begin[:-1]
    return clause[new], (begin - base)[new], end[new]


def query_scores(clauses: pa.ListArray) -> np.ndarray:
    """Cover density of each list of held clauses (terms, literals of (starts, width)); 0 where none asks for anything."""
    out = np.zeros(len(clauses))
    numpy = lambda a: a.to_numpy(zero_copy_only=False)
    each = clauses.flatten()
    row_of, literals = numpy(pc.list_parent_indices(clauses)), pc.struct_field(each, "literals")
    many = numpy(pc.list_value_length(literals).fill_null(0))
    every = literals.flatten()
    clause_of, starts = numpy(pc.list_parent_indices(literals)), pc.struct_field(every, "starts")
    number = np.arange(len(clause_of)) - (np.cumsum(many) - many)[clause_of] if len(clause_of) else np.zeros(0, dtype=np.int64)
    literal, start = numpy(pc.list_parent_indices(starts)), numpy(starts.flatten()).astype(np.int64)
    if not len(start):
        return out
    end = start + numpy(pc.struct_field(every, "width"))[literal] - 1
    return density(len(out), row_of, numpy(pc.struct_field(each, "terms")), many, clause_of[literal], number[literal], start, end)


def density(n: int, row_of: np.ndarray, terms_of: np.ndarray, many: np.ndarray, clause: np.ndarray, literal: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Cover density of ``n`` rows: clauses with their row, their terms and how many literals they have; entries as in ``_covers``."""
    clause, start, end = _covers(clause, many, literal, start, end)
    row, terms = row_of[clause], terms_of[clause]
    # of all clauses' stretches those stay that hold no other: from the right, each must end before all that begin behind it
    order = np.lexsort((-terms, end, -start, row))
    row, start, end, terms = row[order], start[order], end[order], terms[order]
    placed = end - row.astype(np.int64) * (int(end.max(initial=0)) + 1)
    least = np.minimum.accumulate(placed)
    kept = np.concatenate([[True], placed[1:] < least[:-1]])
    width = (end - start + 1 - terms)[kept]
    return np.bincount(row[kept], 0.1 / (1 + np.maximum(width, 0)), minlength=n)


def cover_scores(lists: pa.ListArray) -> np.ndarray:
    """``query_scores`` of single clauses of words, each a list of the positions of its terms."""
    flat, many = lists.flatten(), pc.list_value_length(lists).fill_null(0)
    literals = pa.StructArray.from_arrays([flat, pa.array(np.ones(len(flat), dtype=np.int32))], ["starts", "width"])
    ends = pa.array(np.concatenate([[0], np.cumsum(many.to_numpy(zero_copy_only=False))]), pa.int32())
    clauses = pa.StructArray.from_arrays([many, pa.ListArray.from_arrays(ends, literals)], ["terms", "literals"])
    return query_scores(pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1), pa.int32()), clauses))


def cover_density(lists: list[list[int]]) -> float:
    return float(cover_scores(pa.array([lists], pa.list_(pa.list_(pa.int32()))))[0]) if all(lists) else 0.0


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, 2000):
            part = b.slice(s, 2000)
            yield pa.RecordBatch.from_arrays([part["query_id"], part["chunk_id"], pa.array(query_scores(pa.concat_arrays([part["clauses"]])))], ["query_id", "chunk_id", "score"])


def fts_topk(queries: DataFrame, postings: DataFrame, k: int, stemmed: bool = False, by: tuple[str, ...] = (), parsed: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """L4: query_id, chunk_id, score, rank by cover density, best first; blank queries and k <= 0 give nothing.

    Only chunks with the query's ``by`` (such as index_id) are ranked. What only
    negations find scores 0. ``chunks``: see ``fts_match``.
    """
    parsed = parse_queries(queries, stemmed=stemmed, by=by) if parsed is None else parsed
    places = fts_match(postings, parsed, by, chunks)
    kinds = ", ".join(f"{c} {places.schema[c].dataType.simpleString()}" for c in ("query_id", "chunk_id"))
    ranked = places.mapInArrow(_rank, f"{kinds}, score double").withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= max(k, 0))


def search_text(queries: DataFrame, chunks: DataFrame, k: int, stemmed: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """L1-L4 of chunks that have no postings yet: they are searched in their rows, or from postings of the queries' terms where these are very many.

    A chunk that is repeated counts once; rows of one id should hold the same text.
    """
    parsed = stage(parse_queries(queries, stemmed=stemmed, by=by), "parsed-queries")
    found = _in_rows(chunks, parsed, max(k, 0), stemmed, by)
    if found is None:
        return fts_topk(queries, asked_postings(chunks, parsed, stemmed, by), k, stemmed, by, parsed, chunks)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id"))
    return found.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)


def match_text(chunks: DataFrame, parsed: DataFrame, stemmed: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """L1-L3 of chunks that have no postings yet: (query_id, chunk_id) of the chunks that satisfy a clause. ``parsed`` should be a table."""
    found = _in_rows(chunks, parsed, None, stemmed, by)
    return fts_match(asked_postings(chunks, parsed, stemmed, by), parsed, by, chunks).select("query_id", "chunk_id") if found is None else found.distinct()


def _in_rows(chunks: DataFrame, parsed: DataFrame, k: int | None, stemmed: bool, by: tuple[str, ...]) -> DataFrame | None:
    """Found chunks, with ``k`` the best of each task; nothing if the questions have too many terms to send them to the tasks."""
    asked = parsed.limit(QUESTION_TERMS + 1).collect()
    if len(asked) > QUESTION_TERMS:
        return None
    id_type = parsed.schema["query_id"].dataType
    told = StructType([StructField("query_id", id_type), StructField("chunk_id", chunks.schema["chunk_id"].dataType), *([] if k is None else [StructField("score", DoubleType())])])
    stop = pa.array(sorted(ENGLISH_STOP_WORDS if stemmed else STOP_WORDS), pa.string())
    run = rowsearch.task(rowsearch.Questions(asked, by), by, stop, english if stemmed else None, k, density, to_arrow_type(id_type))
    return _words(chunks.where("chunk_id IS NOT NULL"), "chunk_id", by).mapInArrow(run, told)


def asked_postings(chunks: DataFrame, parsed: DataFrame, stemmed: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    return stage(build_postings(chunks, stemmed=stemmed, by=by, only=parsed.select("term")), "asked-postings")
