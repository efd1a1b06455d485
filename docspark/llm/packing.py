"""Best-two-fit packing of token pieces into sequences of equal capacity.

Tokenizing and cutting run in tasks; Spark counts pieces by length. Lengths
are at most the capacity, so that histogram is small whatever the corpus, and
the packing itself is planned on it: each plan step is one filling of a bin,
repeated as often as the counts allow. Pieces then find their bin by their
rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

CAPACITY = 1024
END = 2
#: Ranks inside a length are taken in runs of about so many pieces by hash, so that a hot length is many groups.
RUN_ROWS = 16_384
#: Characters for which both tokenizer libraries are known to split words alike; other texts take the slower one.
PLAIN = r"[\t\n\r\x20-\x7E¡-ɏΑ-ώЀ-џ‐-‧‰-⁞€一-龥]*"


def _encoder():
    """ids(text): the vocabulary of ``byte_bpe_50k``, as uint32."""
    import base64
    import os
    import re

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain, wide = re.compile(PLAIN), re.compile(r"\s{2000}")
    slow = []

    def ids(text: str) -> np.ndarray:
        if plain.fullmatch(text) and "<|" not in text and not wide.search(text):
            return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)
        if not slow:
            slow.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
        return np.asarray(slow[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return ids


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenize(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32). A null text is empty: one piece, its end id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _encoder()
        end = np.array([END], dtype=np.uint32)
        for b in batches:
            rows = []
            for doc, text in zip(b["_id"], b["_text"]):
                all_ids = np.concatenate([ids(text if isinstance(text, str) else ""), end]).astype("<u4")
                rows += [(doc, i, s, n, zlib.crc32(all_ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(all_ids), capacity))]
            out = pd.DataFrame(rows, columns=["_id", "piece", "start", "length", "ids_crc32"])
            out["_id"] = out["_id"].astype(b["_id"].dtype if len(b) else object)
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    pieces = plain.mapInPandas(run, "_id string, piece int, start long, length long, ids_crc32 long")
    return pieces.select(F.col("_id").cast(kind).alias(id_col), "piece", "start", "length", "ids_crc32")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Fillings (how many bins, the lengths in one bin), from counts by length.

    A bin takes the longest length left, then best-fits the longest that its
    gap holds. Then its smallest is exchanged for the two unpacked lengths that
    fit the expanded gap more tightly, if there are any. The filling repeats
    while the counts allow, so there are about as many steps as lengths.
    """
    left = {n: c for n, c in histogram.items() if c > 0 and n > 0}
    order = sorted(left)
    out = []
    while order:
        use: dict[int, int] = {}

        def free(n: int) -> int:
            return left[n] - use.get(n, 0)

        gap = capacity
        while True:
            i = bisect_right(order, gap) - 1
            while i >= 0 and free(order[i]) <= 0:
                i -= 1
            if i < 0:
                break
            use[order[i]] = use.get(order[i], 0) + 1
            gap -= order[i]
        if not use:  # longer than the capacity: a bin of its own
            use[order[-1]] = 1
            gap = 0
        if gap > 0:
            smallest = min(use)
            room, best = gap + smallest, (smallest, None)
            j = bisect_right(order, room) - 1
            for i in range(len(order)):
                a = order[i]
                if a * 2 > room or free(a) <= 0:
                    if a * 2 > room:
                        break
                    continue
                j = bisect_right(order, room - a) - 1
                while j >= i and (free(order[j]) <= 0 or (order[j] == a and free(a) < 2)):
                    j -= 1
                if j >= i and a + order[j] > best[0]:
                    best = (a + order[j], (a, order[j]))
                    if best[0] == room:
                        break
            if best[1]:
                use[smallest] -= 1
                if not use[smallest]:
                    del use[smallest]
                for n in best[1]:
                    use[n] = use.get(n, 0) + 1
        times = min(left[n] // k for n, k in use.items())
        for n, k in use.items():
            left[n] -= times * k
        order = [n for n in order if left[n] > 0]
        out.append((times, tuple(sorted((n for n, k in use.items() for _ in range(k)), reverse=True))))
    return out


def _places(fillings) -> dict[int, tuple[np.ndarray, list]]:
    """By length: the ranks at which a filling begins, and there (first sequence, pieces of this length, their offsets)."""
    starts: dict[int, list] = {}
    told: dict[int, list] = {}
    used: dict[int, int] = {}
    first = 0
    for times, lengths in fillings:
        offsets: dict[int, list[int]] = {}
        at = 0
        for n in lengths:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, where in offsets.items():
            starts.setdefault(n, []).append(used.get(n, 0))
            told.setdefault(n, []).append((first, len(where), where))
            used[n] = used.get(n, 0) + times * len(where)
        first += times
    return {n: (np.array(starts[n], dtype=np.int64), told[n]) for n in starts}


def place(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``pieces`` must be a written table: it is read twice.

    Lengths must be from 1 to ``capacity`` (``tokenize`` gives no others, a null or
    empty text one id). Pieces of one length are alike to the plan; their order by
    id, number, start and checksum says which goes where, null ids first, and
    rows equal in all of these may swap places. No pieces give no rows.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    places = spark.sparkContext.broadcast(_places(plan(histogram, capacity)))
    runs_of = spark.createDataFrame([(n, -(-c // RUN_ROWS)) for n, c in histogram.items()], "_length long, _runs long")
    keyed = pieces.join(F.broadcast(runs_of), F.col("length") == F.col("_length")).withColumn("_run", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.col("_runs")))
    runs = keyed.groupBy("length", "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("length", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_run").orderBy(F.col(id_col), "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("_row", F.row_number().over(inside)).join(runs, ["length", "_run"])
    ranked = ranked.select(*[F.col(c) for c in pieces.columns], (F.col("_before") + F.col("_row") - 1).alias("_rank"))

    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        table = places.value
        for lengths, ranks in batches:
            n, r = lengths.to_numpy(), ranks.to_numpy()
            seq, off = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
            for length in np.unique(n):
                begin, told = table[int(length)]
                rows = np.flatnonzero(n == length)
                step = np.searchsorted(begin, r[rows], side="right") - 1
                for s in np.unique(step):
                    mine = rows[step == s]
                    first, per, where = told[s]
                    q = r[mine] - begin[s]
                    seq[mine] = first + q // per
                    off[mine] = np.asarray(where)[q % per]
            yield pd.DataFrame({"sequence_id": seq, "offset": off})

    found = F.pandas_udf(find, "sequence_id long, offset long")
    return ranked.withColumn("_p", found("length", "_rank")).select(*[F.col(c) for c in pieces.columns], "_p.sequence_id", "_p.offset")


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all ``docs`` with their places.

    Null and empty texts are one piece of one id; long ones are cut; repeated
    rows are packed as often as they occur; an empty table gives no rows. Very
    long texts are tokenized whole. Other columns are not carried, so their
    names cannot clash: pieces join back by id.
    """
    return place(stage(tokenize(docs, capacity, id_col, text_col), "pack-pieces"), capacity, id_col)


def report(docs: DataFrame) -> DataFrame:
    """Rows of query ``op7``."""
    return pack(docs.select("doc_id", "text"))
