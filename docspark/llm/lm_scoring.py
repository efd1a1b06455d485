"""Language-model scoring by subword lattice likelihood.

An existing subword vocabulary spans a lattice over each word: every way to cut
the word into pieces is a path, weighted by the pieces' unigram probabilities.
The vocabulary's own scores start the weights; expectation passes over the most
frequent words bring them near, and one over the words of all training
documents sets them. A forward recursion in log space
sums over all paths, so a document's score is its marginal probability under
the piece unigram, one word after another, then one end.

Word counts and lattice sums are made once per distinct word and joined back;
very frequent words, whose number is bounded by their share, are looked up in
the task instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import release, stage

#: A word with at least one in so many of the training tokens is looked up in the task: at most so many words.
FREQUENT = 65_536
#: Counts added to every piece.
SMOOTHING = 0.01
LONG_WORD = 256
#: Expectation passes over the frequent words only, before the one over all.
WARM_PASSES = 4
_BASE = np.uint64(0x9E3779B97F4A7C15)


def load_pieces(path: str | None = None) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (word start: a space) and starting log weights from the vocabulary's scores.

    The scores of this vocabulary are ranks, read as Zipf weights; all 256 bytes are pieces.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        if sp.is_byte(i):
            piece, w = bytes([int(sp.id_to_piece(i)[1:-1], 16)]), 1e-7
        else:
            piece, w = sp.id_to_piece(i).replace("▁", " ").encode(), 1.0 / (10.0 + min(-sp.get_score(i), 1e6))
        if b" " in piece[1:]:
            continue
        weight[piece] = max(w, weight.get(piece, 0.0))
    pieces = sorted(weight)
    p = np.array([weight[x] for x in pieces])
    return pieces, np.log(p / p.sum())


class Lattice:
    """Forward (and backward) sums over all segmentations, for many words at once."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp = pieces, np.append(logp, -np.inf)
        self.lengths = sorted({len(x) for x in pieces})
        self.powers = _BASE ** np.arange(self.lengths[-1] + 1, dtype=np.uint64)
        hashes = np.array([self._hash(x) for x in pieces], dtype=np.uint64)
        self.bits = max(12, len(pieces).bit_length() + 4)
        self.key, self.slot = np.append(hashes, np.uint64(0)), np.full(1 << self.bits, len(pieces), dtype=np.int32)
        self.rest: dict[int, int] = {}
        crowded = np.zeros(1 << self.bits, dtype=bool)
        at = self._slot(hashes).astype(np.int64)
        for i, s in enumerate(at):
            if self.slot[s] == len(pieces):
                self.slot[s] = i
            else:
                crowded[s] = True
                self.rest[int(hashes[i])] = i
        self.crowded = crowded
        self.index = {x: i for i, x in enumerate(pieces)}

    def _hash(self, x: bytes) -> int:
        h = 0
        for c in x:
            h = (h * int(_BASE) + c + 1) & ((1 << 64) - 1)
        return h

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)

    def _find(self, h: np.ndarray) -> np.ndarray:
        s = self._slot(h)
        i = self.slot[s]
        miss = self.key[i] != h
        if miss.any():
            again = np.flatnonzero(miss & self.crowded[s])
            i = np.where(miss, len(self.pieces), i)
            for r in again:
                i[r] = self.rest.get(int(h[r]), len(self.pieces))
        return i

    def _blocks(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = np.array([len(w) for w in words])
        order = np.argsort(size, kind="stable")
        order = order[size[order] <= LONG_WORD]
        lengths = size[order]
        for n in np.unique(lengths):
            same = order[np.searchsorted(lengths, n) : np.searchsorted(lengths, n, side="right")]
            for s in range(0, len(same), 8192):
                rows = same[s : s + 8192]
                yield rows, np.frombuffer(b"".join(words[r] for r in rows), dtype=np.uint8).reshape(len(rows), n)

    def _arcs(self, data: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
        """For each end position: (start, piece of every word, the last number for none)."""
        w, n = data.shape
        prefix = np.zeros((n + 1, w), dtype=np.uint64)
        for j in range(n):
            prefix[j + 1] = prefix[j] * _BASE + data[:, j].astype(np.uint64) + np.uint64(1)
        out = []
        for j in range(1, n + 1):
            out.append([(j - k, self._find(prefix[j] - prefix[j - k] * self.powers[k])) for k in self.lengths if k <= j])
        return out

    @staticmethod
    def _sum(terms: list[np.ndarray]) -> np.ndarray:
        x = np.stack(terms)
        top = x.max(0)
        low = np.where(np.isfinite(top), top, 0.0)
        return np.where(np.isfinite(top), low + np.log(np.exp(x - low).sum(0)), -np.inf)

    def _forward(self, arcs, w: int) -> list[np.ndarray]:
        alpha = [np.zeros(w)]
        for ends in arcs:
            alpha.append(self._sum([alpha[s] + self.logp[p] for s, p in ends]))
        return alpha

    def _long(self, word: bytes) -> tuple[list[float], list[list[tuple[int, int]]]]:
        alpha, arcs = [0.0], []
        for j in range(1, len(word) + 1):
            ends = [(j - k, i) for k in self.lengths if k <= j and (i := self.index.get(word[j - k : j])) is not None]
            terms = [alpha[s] + self.logp[i] for s, i in ends]
            top = max(terms)
            alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
            arcs.append(ends)
        return alpha, arcs

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural-log marginal probability of each word over all its segmentations."""
        out = np.zeros(len(words))
        for rows, data in self._blocks(words):
            out[rows] = self._forward(self._arcs(data), len(rows))[-1]
        for r in (r for r, w in enumerate(words) if len(w) > LONG_WORD):
            out[r] = self._long(words[r])[0][-1]
        return out

    def expected_counts(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in ``counts`` occurrences of each word."""
        out = np.zeros(len(self.pieces) + 1)
        for rows, data in self._blocks(words):
            arcs = self._arcs(data)
            alpha = self._forward(arcs, len(rows))
            n = len(arcs)
            after: list[list[np.ndarray]] = [[] for _ in range(n + 1)]
            beta: list[np.ndarray] = [np.zeros(0)] * (n + 1)
            for j in range(n, -1, -1):
                beta[j] = np.zeros(len(rows)) if j == n else self._sum(after[j])
                for s, p in arcs[j - 1] if j else []:
                    path = self.logp[p] + beta[j]
                    after[s].append(path)
                    out += np.bincount(p, np.exp(alpha[s] + path - alpha[-1]) * counts[rows], minlength=len(out))
        for r in (r for r, w in enumerate(words) if len(w) > LONG_WORD):
            alpha, arcs = self._long(words[r])
            after = [[] for _ in range(len(arcs) + 1)]
            for j in range(len(arcs), 0, -1):
                b = 0.0 if j == len(arcs) else (max(after[j]) + math.log(sum(math.exp(t - max(after[j])) for t in after[j])) if after[j] else -math.inf)
                for s, i in arcs[j - 1]:
                    path = self.logp[i] + b
                    after[s].append(path)
                    out[i] += math.exp(alpha[s] + path - alpha[-1]) * counts[r]
        return out[:-1]


def warm_start(pieces: list[bytes], logp: np.ndarray, words: list[bytes], counts: np.ndarray, passes: int = WARM_PASSES) -> np.ndarray:
    """Log weights after expectation passes over the frequent words; a twentieth of the start stays, so that no piece dies."""
    start = np.exp(logp)
    for _ in range(passes if len(words) else 0):
        e = Lattice(pieces, logp).expected_counts(words, counts)
        mixed = e + 0.05 * e.sum() * start
        logp = np.log(mixed / mixed.sum())
    return logp


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in a row, A-Z folded, and the text each is of. Null texts have none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, of = lists.flatten(), pc.list_parent_indices(lists)
    keep = pc.not_equal(flat, "")
    return flat.filter(keep), of.filter(keep).to_numpy(zero_copy_only=False)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = []
        for piece in _slices([b], 2000):
            words, of = split_words(piece["_text"])
            coded = words.dictionary_encode()
            train = ~piece["_held"].to_numpy(zero_copy_only=False)[of]
            n = np.bincount(coded.indices.to_numpy()[train], minlength=len(coded.dictionary))
            parts.append(pa.table({"word": coded.dictionary, "c": pa.array(n, pa.int64())}))
        if parts:
            summed = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("c", "sum")])
            yield from summed.select(["word", "c_sum"]).rename_columns(["word", "c"]).to_batches()


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty: one token, its end. A null id counts as an empty id (in
    training). Words of any length are scored whole. Repeated rows count and are
    scored as often as they occur. Without training documents every count is 0
    and pieces keep their starting weights. An empty table gives no rows. Other
    columns are not carried, so their names cannot clash. Rows must come from
    files or a written table: they are numbered in the order they are read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("string").alias("_id"), held_out(id_col).alias("_held"), F.col(text_col).alias("_text"))
    counted = source.select("_held", "_text").mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
    vocabulary = stage(counted, "lm-words")
    held = source.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("_held").cast("long")), F.lit(0)).alias("h")).first()
    ends = held["n"] - held["h"]
    sums = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    total, distinct = sums["n"] + ends, sums["v"] + (ends > 0)
    pieces, start = load_pieces(piece_path)
    # at most FREQUENT words can have this share of all tokens: they bring the starting weights near before the pass over all words
    top = vocabulary.where(F.col("c") * FREQUENT >= max(total, 1)).orderBy("word").toPandas() if total else pd.DataFrame({"word": [], "c": []})
    first = spark.sparkContext.broadcast((pieces, warm_start(pieces, start, [b" " + w.encode() for w in top["word"]], top["c"].to_numpy(dtype=np.float64))))

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(*first.value)
        e = np.zeros(len(first.value[0]))
        for b in batches:
            e += lattice.expected_counts([b" " + w.encode() for w in b["word"]], b["c"].to_numpy(dtype=np.float64))
        some = np.flatnonzero(e)
        yield pd.DataFrame({"piece": some.astype(np.int32), "e": e[some]})

    uses = vocabulary.where("c > 0").mapInPandas(expect, "piece int, e double").groupBy("piece").agg(F.sum("e").alias("e")).collect()  # as many as pieces
    if uses:
        e = np.zeros(len(pieces))
        e[[r["piece"] for r in uses]] = [r["e"] for r in uses]
        whole = e.sum() + ends + SMOOTHING * (len(pieces) + 1)
        logp, log_end = np.log((e + SMOOTHING) / whole), math.log((ends + SMOOTHING) / whole)
    else:
        logp, log_end = start, float(np.log(0.5))
    trained = spark.sparkContext.broadcast((pieces, logp))
    ln10 = math.log(10)

    def lattice_scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lattice = Lattice(*trained.value)
        for b in batches:
            yield pd.Series(lattice.log_probability([b" " + w.encode() for w in b]) / ln10)

    table = stage(vocabulary.select("word", "c", F.pandas_udf(lattice_scores, "double")("word").alias("s")), "lm-scores")
    release(vocabulary)
    top_scores = Lattice(pieces, logp).log_probability([b" " + w.encode() for w in top["word"]]) / ln10
    frequent = spark.sparkContext.broadcast((top["word"].tolist(), top["c"].to_numpy(dtype=np.float64), top_scores))
    scale = total + 0.5 * (distinct + 1)
    end_base, end_score, end_known = math.log10((ends + 0.5) / scale), log_end / ln10, int(ends > 0)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c, s = frequent.value
        known = pa.array(names, pa.string())
        base = np.append(np.log10((c + 0.5) / scale), 0.0)
        model = np.append(s, 0.0)
        for b in _slices(batches):
            n = b.num_rows
            words, of = split_words(b["_text"])
            at = pc.fill_null(pc.index_in(words, value_set=known), len(names)).to_numpy(zero_copy_only=False)
            rare = np.flatnonzero(at == len(names))
            tokens = np.bincount(of, minlength=n)
            seen = tokens - np.bincount(of[rare], minlength=n)
            row = b["_row"].to_numpy(zero_copy_only=False)
            # a document's own line has a word of its own, which no text can hold: it has a space
            own = pa.array([f"{r} " for r in row], pa.string())
            m = len(rare)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([own, words.take(pa.array(rare))]),
                pa.array(np.concatenate([row, row[of[rare]]]), pa.int64()),
                pa.array(np.concatenate([tokens + 1, np.zeros(m, dtype=np.int64)]), pa.int64()),
                pa.array(np.concatenate([seen + end_known, np.zeros(m, dtype=np.int64)]), pa.int64()),
                pa.array(np.concatenate([np.bincount(of, base[at], minlength=n) + end_base, np.zeros(m)]), pa.float64()),
                pa.array(np.concatenate([np.bincount(of, model[at], minlength=n) + end_score, np.zeros(m)]), pa.float64()),
                pa.concat_arrays([b["_id"], pa.nulls(m, pa.string())]),
            ], ["word", "row", "n_tokens", "n_known", "base", "model", "_id"])

    numbered = source.select("_id", "_text", F.monotonically_increasing_id().alias("_row"))
    lines = numbered.mapInArrow(look_up, "word string, row long, n_tokens long, n_known long, base double, model double, _id string")
    joined = lines.join(table, "word", "left")
    rare = F.col("n_tokens") == 0
    sums = joined.groupBy("row").agg(
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(rare & (F.col("c") > 0), 1).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum(F.when(rare, F.log10((F.col("c") + 0.5) / F.lit(scale))).otherwise(F.col("base"))).alias("base_score"),
        F.sum(F.when(rare, F.col("s")).otherwise(F.col("model"))).alias("score"),
        F.max(F.col("_id")).alias("_id"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    return sums.select(
        F.col("_id").cast(kind).alias(id_col), held_out("_id").alias("held_out"), F.col("n_tokens").cast("long"), F.col("n_known").cast("long"),
        F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
    )


def report(docs: DataFrame) -> DataFrame:
    """Rows of query ``op10``."""
    return score(docs.select("doc_id", "text"))
