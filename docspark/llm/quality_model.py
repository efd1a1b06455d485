"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document.
Expectation-maximisation estimates how accurate each labeller is from their
agreement alone, on the counts of all vote patterns. The patterns' posterior
labels train a linear scorer on hashed features, which then scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import Shingler, _mix
from .quality_rules import STOP_WORDS
from .staging import free_name, release, stage

BUCKETS = 1 << 16
#: The scorer is trained on a sample by hash of about so many documents, and of these on so many as have this many feature values (64 MB); the vote model uses all.
TRAIN_ROWS, TRAIN_VALUES = 8192, 8_000_000
EPOCHS = 6
GOOD, BAD, NONE = 1, 0, -1


# The labellers, in the order of their votes.
LABELLERS = ("length", "symbols", "stop_words", "dup_lines", "repeats", "word_length", "letters", "stutter")


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


class Text:
    """One text as numbers: its bytes, its words' places and their hashes (A-Z folded)."""

    def __init__(self, shingler: Shingler, text: str):
        self.text = text
        self.data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
        self.start, self.end = shingler.edges(self.data)
        self.words = shingler.hashes(self.data, self.start, self.end)
        self.stutter = int((self.words[1:] == self.words[:-1]).sum())


class Labellers:
    """Votes of the heuristics on a text; all of them read it whole."""

    def __init__(self):
        shingler = Shingler()
        self.stop = np.unique(np.array([shingler.word_hashes(w)[0] for w in STOP_WORDS], dtype=np.uint64))
        self.symbol, self.letter = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
        self.symbol[list(b"#*$%&|<>")] = True
        self.letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

    def __call__(self, t: Text) -> tuple[int, ...]:
        n = len(t.words)
        chars = int(((t.data & 0xC0) != 0x80).sum()) - int((t.data <= 32).sum())
        symbols = int(self.symbol[t.data].sum())
        stop = int(np.isin(t.words, self.stop).sum())
        lines = [x for x in t.text.split("\n") if x.strip()]
        dup = len(lines) - len(set(lines))
        repeats = 0
        if n >= 3:
            windows = _mix(_mix(t.words[:-2]) + _mix(t.words[1:-1] ^ np.uint64(1)) * np.uint64(3) + t.words[2:])
            _, of, count = np.unique(windows, return_inverse=True, return_counts=True)
            repeats = int((count[of.reshape(-1)] > 1).sum())
        lettered = int((np.add.reduceat(np.append(self.letter[t.data], False).astype(np.int64), np.stack([t.start, t.end], 1).ravel())[::2] > 0).sum()) if n else 0
        return (
            _vote(n < 20, n >= 100), _vote(10 * symbols > n, symbols == 0), _vote(100 * stop < 6 * n, 100 * stop > 12 * n), _vote(100 * dup > 30 * len(lines), dup == 0 and len(lines) >= 2),
            _vote(100 * repeats > 30 * n, 100 * repeats < 8 * n), _vote(10 * chars < 38 * n or 10 * chars > 68 * n, 42 * n < 10 * chars < 60 * n), _vote(100 * lettered < 80 * n, 100 * lettered > 97 * n),
            _vote(100 * t.stutter > 6 * n, 100 * t.stutter < 2 * n),
        )


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior of good for each vote pattern (rows of -1/0/1), by EM over their counts.

    Each labeller has an accuracy for either class; silence tells nothing. The
    majority vote starts the labels, and a pseudo-count keeps accuracies off 0 and 1.
    """
    voted, good = patterns != NONE, patterns == GOOD
    n = np.maximum(voted.sum(1), 1)
    post = np.clip(np.where(voted.any(1), (good & voted).sum(1) / n, 0.5), 0.05, 0.95)
    for _ in range(rounds):
        w1, w0 = counts * post, counts * (1 - post)
        prior = np.clip((w1.sum() + 1) / (counts.sum() + 2), 0.01, 0.99)
        right1 = ((w1[:, None] * (good & voted)).sum(0) + 4) / ((w1[:, None] * voted).sum(0) + 5)
        right0 = ((w0[:, None] * (~good & voted)).sum(0) + 4) / ((w0[:, None] * voted).sum(0) + 5)
        odds = np.log(prior / (1 - prior)) + np.where(voted, np.where(good, np.log(right1 / (1 - right0)), np.log((1 - right1) / right0)), 0.0).sum(1)
        post = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    return post


class Features:
    """Hashed features of a text: its words, their shapes, and steps of its repetition and length. Values are of unit length."""

    def __init__(self):
        self.shingler = Shingler()
        table = np.arange(256)
        table[[*range(65, 91), *range(97, 123), *range(128, 256)]] = ord("a")
        table[48:58] = ord("0")
        self.shape = table.astype(np.uint8)

    def __call__(self, t: Text) -> tuple[np.ndarray, np.ndarray]:
        h, shaped = t.words, self.shape[t.data]
        shapes = self.shingler.hashes(shaped, t.start, t.end)
        n, different = len(h), len(np.unique(h))
        steps = np.array([int(10 * different / n) if n else 11, 20 + n.bit_length(), 60 + int(50 * t.stutter / n) if n else 59], dtype=np.uint64)
        every = np.concatenate([h, shapes ^ np.uint64(0x5555), _mix(steps + np.uint64(1 << 40))])
        ids, count = np.unique(every & np.uint64(BUCKETS - 1), return_counts=True)
        value = np.log1p(count.astype(np.float64))
        return ids.astype(np.int32), (value / np.sqrt((value * value).sum())).astype(np.float32)


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by adaptive gradient steps, classes weighted alike; rows in a fixed order."""
    w, g, b, gb = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6), 0.0, 1e-6
    mean = float(np.mean([y for *_, y in rows])) if rows else 0.5
    up, down = 0.5 / max(mean, 0.02), 0.5 / max(1 - mean, 0.02)
    for _ in range(EPOCHS):
        for ids, value, y in rows:
            p = 1 / (1 + np.exp(-np.clip(w[ids] @ value + b, -30, 30)))
            step = y * up * (p - 1) + (1 - y) * down * p
            d = step * value
            g[ids] += d * d
            w[ids] -= 0.3 * d / np.sqrt(g[ids])
            gb += step * step
            b -= 0.3 * step / np.sqrt(gb)
    return w, b


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` and last the struct ``_quality``: weak_label (posterior of the votes), score (the linear scorer's), kept.

    Null and empty texts are judged by the same votes (of no words) and features;
    very long ones are read whole; repeated rows are judged alike; an empty table
    gives no rows. ``kept`` is ``score >= threshold``. Columns of ``docs`` stay
    whatever their names: if one is called ``_quality``, the struct is ``_quality_``.
    Texts are read twice: for the counts of the votes, and to score them.
    """
    source = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def voted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f, shingler = Labellers(), Shingler()
        for b in batches:
            yield pd.Series([f(Text(shingler, t if isinstance(t, str) else "")) for t in b], dtype=object)

    pattern = F.pandas_udf(voted, "array<int>")(F.col("_text"))
    counted = source.select(pattern.alias("votes")).groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()  # at most 3 ** labellers rows
    patterns = np.array([list(r["votes"]) for r in counted]).reshape(-1, len(LABELLERS))
    labels = {tuple(map(int, p)): float(x) for p, x in zip(patterns, fit_votes(patterns, np.array([r["n"] for r in counted], dtype=np.float64)))} if len(patterns) else {}
    part = min(1.0, TRAIN_ROWS / max(sum(r["n"] for r in counted), 1))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, g, shingler = Features(), Labellers(), Shingler()
        for b in batches:
            texts = [Text(shingler, t if isinstance(t, str) else "") for t in b["_text"]]
            rows = [f(t) for t in texts]
            yield pd.DataFrame({
                "h": b["_h"], "ids": pd.Series([i.tobytes() for i, _ in rows], dtype=object), "value": pd.Series([v.tobytes() for _, v in rows], dtype=object), "y": [labels[g(t)] for t in texts],
            })

    chosen = source.select("_text", F.xxhash64("_id", "_text").alias("_h")).where(F.col("_h") / 2.0**64 + 0.5 < part)
    kept = stage(chosen.mapInPandas(featured, "h long, ids binary, value binary, y double"), "quality-sample")
    sizes = kept.groupBy("h").agg(F.sum(F.octet_length("ids") / 4).alias("n")).orderBy("h").collect()
    room = np.cumsum([r["n"] for r in sizes]) <= TRAIN_VALUES if sizes else np.zeros(0, dtype=bool)
    last = sizes[int(room.sum()) - 1]["h"] if room.any() else None
    sample = kept.where(F.col("h") <= F.lit(last)).collect() if last is not None else []
    release(kept)
    rows = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["value"], np.float32), r["y"]) for r in sorted(sample, key=lambda r: (r["h"], r["y"]))]
    model = docs.sparkSession.sparkContext.broadcast(train_scorer(rows))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f, g, shingler, (w, b) = Features(), Labellers(), Shingler(), model.value
        for batch in batches:
            out = []
            for t in batch:
                text = Text(shingler, t if isinstance(t, str) else "")
                ids, value = f(text)
                out.append((labels[g(text)], 1 / (1 + np.exp(-np.clip(w[ids] @ value.astype(np.float64) + b, -30, 30)))))
            yield pd.DataFrame(out, columns=["weak_label", "score"], dtype=np.float64)

    out = source.withColumn("_q", F.pandas_udf(scored, "weak_label double, score double")(F.col("_text")))
    return out.select("_row.*", F.struct(F.col("_q.weak_label"), F.col("_q.score"), (F.col("_q.score") >= threshold).alias("kept")).alias(free_name(docs.columns, "_quality")))


def report(docs: DataFrame) -> DataFrame:
    """Rows of query ``op8``."""
    return classify(docs.select("doc_id", "text")).select("doc_id", "_quality.weak_label", "_quality.score", "_quality.kept")
