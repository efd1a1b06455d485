"""Search of chunks in their rows (L3, L4): a counted set of questions goes to the tasks, and nothing of a chunk is shuffled.

What a clause and its score are is told in ``lexical``. All questions are
asked of a few chunks at a time on arrays; a task keeps the best k chunks of a
question while its chunks pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Words, and pairs of a chunk and a clause that it touches, that are looked at together.
WORDS, PAIRS = 100_000, 1_000_000
#: Found chunks that a task gathers before it keeps the best again.
GATHERED = 500_000


class Lookup:
    """Values by whole-number key, from rows of ``width`` numbers of which the first is the key."""

    def __init__(self, rows: list[tuple], width: int):
        rows = sorted(set(rows))
        table = np.array(rows, dtype=np.int64).reshape(len(rows), width)
        self.keys, at = np.unique(table[:, 0], return_index=True)
        self.ends, self.values = np.append(at, len(table)), table[:, 1:].T

    def counts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the values of each key begin, and how many there are."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.ends[i], np.where(self.keys[i] == keys, self.ends[i + 1] - self.ends[i], 0)

    def expand(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each key's number in ``keys`` with each of its values."""
        begin, many = self.counts(keys)
        of = np.repeat(np.arange(len(keys)), many)
        at = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(len(of))
        return of, *(v[at] for v in self.values)


def _in(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Number of each value among the sorted ones, -1 if it is not there."""
    if not len(sorted_values):
        return np.full(len(values), -1)
    i = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return np.where(sorted_values[i] == values, i, -1)


def rounded(scores: np.ndarray, digits: int = 6) -> np.ndarray:
    """As Spark rounds: halves up, by the shortest decimal that names the number."""
    scaled = scores * 10**digits
    whole = np.floor(scaled)
    out = whole + (scaled - whole >= 0.5)
    near = np.flatnonzero(np.abs(scaled - whole - 0.5) < 1e-4)
    values, of = np.unique(scores[near], return_inverse=True)
    out[near] = np.array([float((Decimal(repr(float(x))) * 10**digits).to_integral_value(ROUND_HALF_UP)) for x in values])[of] if len(near) else 0
    return out / 10**digits


class Questions:
    """Parsed questions as arrays. A key is a term in a scope (the values of ``by``)."""

    def __init__(self, parsed: list, by: tuple[str, ...]):
        parsed = [r for r in parsed if all(r[c] is not None for c in by) and r["query_id"] is not None]
        number = lambda values: {v: i for i, v in enumerate(dict.fromkeys(values))}
        self.ids = list(dict.fromkeys(r["query_id"] for r in parsed))
        query = number(self.ids)
        self.scopes, terms = number(tuple(r[c] for c in by) for r in parsed), number(r["term"] for r in parsed)
        self.terms = pa.array(list(terms), pa.string())
        clause = number((r["query_id"], r["clause"], tuple(r[c] for c in by)) for r in parsed)
        phrase = number((r["query_id"], r["clause"], tuple(r[c] for c in by), r["phrase"]) for r in parsed if "phrase" in r["kind"])
        n = len(clause)
        self.query = np.array([query[c[0]] for c in clause], dtype=np.int64)
        asks, words, bans, parts = [], [], [], []
        self.size, self.barred, self.of = np.zeros(len(phrase), dtype=np.int64), np.zeros(len(phrase), dtype=bool), np.zeros(len(phrase), dtype=np.int64)
        for r in parsed:
            scope = tuple(r[c] for c in by)
            key, c = self.scopes[scope] * len(terms) + terms[r["term"]], clause[r["query_id"], r["clause"], scope]
            if r["kind"] in ("word", "phrase"):
                asks.append((key, c))
            if r["kind"] == "word":
                words.append((key, c))
            elif r["kind"] == "not":
                bans.append((key, c))
            else:
                p = phrase[r["query_id"], r["clause"], scope, r["phrase"]]
                self.size[p], self.barred[p], self.of[p] = r["size"], r["kind"] == "not_phrase", c
                parts.append((key, p, r["pos"]))
        self.asks, self.bans, self.parts = Lookup(asks, 2), Lookup(bans, 2), Lookup(parts, 3)
        self.need = np.bincount([c for _, c in set(asks)], minlength=n) if asks else np.zeros(n, dtype=np.int64)
        # the literals of a clause: its words, then its phrases
        each = sorted({(c, key) for key, c in words})
        self.many, numbered = np.zeros(n, dtype=np.int64), []
        for c, key in each:
            numbered.append((key, c, self.many[c]))
            self.many[c] += 1
        self.words, self.phrases, self.literal = Lookup(numbered, 3), np.zeros(n, dtype=np.int64), np.zeros(len(phrase), dtype=np.int64)
        self.first, last = np.full(len(phrase), 1 << 30), np.zeros(len(phrase), dtype=np.int64)
        for _, p, pos in parts:
            self.first[p], last[p] = min(self.first[p], pos), max(last[p], pos)
        self.width = last - self.first + 1
        for p in np.flatnonzero(~self.barred):
            self.literal[p] = self.many[self.of[p]]
            self.many[self.of[p]] += 1
            self.phrases[self.of[p]] += 1
        scope_of = np.zeros(n, dtype=np.int64)
        for (_, _, scope), c in clause.items():
            scope_of[c] = self.scopes[scope]
        self.pure = Lookup([(scope_of[c], c) for c in np.flatnonzero(self.need == 0)], 2)
        #: Clauses of one word that forbid nothing: each place of it is a stretch that holds no other.
        self.single = (self.need == 1) & (self.many == 1) & (self.phrases == 0)
        self.single[[c for _, c in bans] + [int(c) for c in self.of[self.barred]]] = False
        once = {}
        for key, c in asks:
            if self.single[c]:
                once.setdefault((key, self.query[c]), c)
        self.counted = np.zeros(n, dtype=bool)
        self.counted[list(once.values())] = True

    def held(self, row: np.ndarray, key: np.ndarray, place: np.ndarray, scope: np.ndarray) -> tuple:
        """Sorted pairs (row * clauses + clause) that hold, the different (row, key) with their counts, and where phrases stand."""
        n, keys = max(len(self.query), 1), max(len(self.scopes) * len(self.terms), 1)
        there, tf = np.unique(row * keys + key, return_counts=True)
        there_row, there_key = there // keys, there % keys
        of, clause = self.asks.expand(there_key)
        pairs, found = np.unique(there_row[of] * n + clause, return_counts=True)
        pairs = pairs[found == self.need[pairs % n]]
        of, clause = self.pure.expand(scope)
        if len(of):
            pairs = np.sort(np.concatenate([pairs, of * n + clause]))
        of, clause = self.bans.expand(there_key)
        banned = [there_row[of] * n + clause]
        at = (np.zeros(0, dtype=np.int64),) * 3
        if len(self.size):
            of, phrase, pos = self.parts.expand(key)
            # a phrase stands where all its terms have the same place less their own one
            shift = int((self.first + self.width).max())
            span = int(place.max(initial=0)) + shift + 1
            begun, found = np.unique((row[of] * len(self.size) + phrase) * span + place[of] - pos + shift, return_counts=True)
            phrase = begun // span % len(self.size)
            whole = found == self.size[phrase]
            begun, phrase = begun[whole], phrase[whole]
            at = (begun // span // len(self.size), phrase, begun % span - shift + self.first[phrase])
            pair = at[0] * n + self.of[phrase]
            banned.append(pair[self.barred[phrase]])
            each = np.unique((pair * len(self.size) + phrase)[~self.barred[phrase]])
            have, many = np.unique(each // len(self.size), return_counts=True)
            wants, i = self.phrases[pairs % n], _in(have, pairs)
            pairs = pairs[(wants == 0) | ((i >= 0) & (np.append(many, 0)[i] == wants))]
        pairs = pairs[_in(np.unique(np.concatenate(banned)), pairs) < 0]
        return pairs, there_row, there_key, tf, at

    def scores(self, pairs: np.ndarray, row: np.ndarray, key: np.ndarray, place: np.ndarray, there_row, there_key, tf, at, density: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, question, score) of the pairs that hold."""
        n, q = max(len(self.query), 1), max(len(self.ids), 1)
        clause = pairs % n
        asked, of = np.unique(pairs // n * q + self.query[clause], return_inverse=True)
        out = np.zeros(len(asked))
        spread = np.zeros(len(asked), dtype=bool)
        spread[of[~self.single[clause] & (self.need[clause] > 0)]] = True
        # one-word clauses only: as many stretches as the words have places
        e, c = self.asks.expand(there_key)
        counted = self.counted[c]
        e, c = e[counted], c[counted]
        i = _in(asked, there_row[e] * q + self.query[c])
        kept = (i >= 0) & (_in(pairs, there_row[e] * n + c) >= 0)
        kept[kept] = ~spread[i[kept]]
        out += np.bincount(i[kept], 0.1 * tf[e[kept]], minlength=len(out))
        if spread.any():
            rest = pairs[spread[of]]
            near = np.flatnonzero(_in(np.unique(rest // n), row) >= 0)
            e, c, literal = self.words.expand(key[near])
            e = near[e]
            i = _in(rest, row[e] * n + c)
            e, literal, i = e[i >= 0], literal[i >= 0], i[i >= 0]
            start, end = place[e], place[e]
            p_row, phrase, begin = at
            j = _in(rest, p_row * n + self.of[phrase])
            good = (j >= 0) & ~self.barred[phrase]
            phrase, begin, j = phrase[good], begin[good], j[good]
            start, end = np.concatenate([start, begin]), np.concatenate([end, begin + self.width[phrase] - 1])
            got = density(len(asked), of[spread[of]], self.need[rest % n], self.many[rest % n], np.concatenate([i, j]), np.concatenate([literal, self.literal[phrase]]), start, end)
            out = np.where(spread, got, out)
        return asked // q, asked % q, rounded(out)


def pieces(b: pa.RecordBatch, words: pa.ListArray, limit: int = WORDS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` words, one row at least."""
    ends = np.cumsum(pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < b.num_rows:
        before = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, before + limit, side="right")), at + 1)
        yield at, to
        at = to


def task(questions: Questions, by: tuple[str, ...], stop: pa.Array, stem: Callable | None, k: int | None, density: Callable, id_type: pa.DataType):
    """What a task does with its chunks (chunk_id, ``by``, words): rows (query_id, chunk_id), with ``k`` also score, the best k of each question."""
    names = ["query_id", "chunk_id"] + (["score"] if k is not None else [])
    ids = pa.array(questions.ids, id_type)
    n_terms = len(questions.terms)

    def best(found: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(found, ignore_index=True).sort_values(["q", "score", "chunk"], ascending=[True, False, True], kind="stable")
        return rows.drop_duplicates(["q", "chunk"]).groupby("q", sort=False).head(k)

    def split(row, key, n_rows, at_row):
        """Ranges of rows that touch at most ``PAIRS`` clauses."""
        load = np.bincount(row, questions.asks.counts(key)[1] + questions.parts.counts(key)[1], minlength=n_rows) + questions.pure.counts(at_row)[1]
        ends, at = np.cumsum(load), 0
        while at < n_rows:
            to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")), at + 1)
            yield at, to
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, gathered, kept, floor, schema = [], 0, 0, np.full(len(questions.ids), -1.0), None
        for b in batches:
            schema = b.schema
            for s, e in pieces(b, b["words"]):
                part = b.slice(s, e - s)
                lists = pa.concat_arrays([part["words"]])
                flat = lists.flatten().dictionary_encode()
                known = flat.dictionary if stem is None else pa.array([stem(w) for w in flat.dictionary.to_pylist()], pa.string())
                code = pc.index_in(known, value_set=questions.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                code[pc.is_in(flat.dictionary, value_set=stop).to_numpy(zero_copy_only=False)] = -1
                row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                many = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
                place = np.arange(len(row)) - (np.cumsum(many) - many)[row] + 1 if len(row) else np.zeros(0, dtype=np.int64)
                scope = np.array([questions.scopes.get(v, -1) for v in zip(*(part[c].to_pylist() for c in by))], dtype=np.int64) if by else np.zeros(len(lists), dtype=np.int64)
                term = code[flat.indices.to_numpy(zero_copy_only=False)] if len(row) else np.zeros(0, dtype=np.int64)
                left = (term >= 0) & (scope[row] >= 0)
                row, place, key = row[left], place[left], (scope[row] * n_terms + term)[left]
                for a, z in split(row, key, len(lists), scope):
                    i, j = np.searchsorted(row, [a, z])
                    r, w, p = row[i:j] - a, key[i:j], place[i:j]
                    pairs, *where = questions.held(r, w, p, scope[a:z])
                    chunk = part["chunk_id"].slice(a, z - a)
                    if k is None:
                        n, q = max(len(questions.query), 1), max(len(questions.ids), 1)
                        told = np.unique(pairs // n * q + questions.query[pairs % n])
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(told % q)), chunk.take(pa.array(told // q))], names)
                        continue
                    rows, q, score = questions.scores(pairs, r, w, p, *where, density)
                    good = score >= floor[q]
                    found.append(pd.DataFrame({"q": q[good], "score": score[good], "chunk": chunk.take(pa.array(rows[good])).to_pandas()}))
                    gathered += int(good.sum())
                    if gathered > max(GATHERED, kept):
                        found, gathered = [best(found)], 0
                        kept = len(found[0])
                        full = found[0].groupby("q")["score"].agg(["size", "min"])
                        full = full[full["size"] >= k]
                        floor[full.index.to_numpy()] = full["min"].to_numpy()
        if k is not None and found:
            rows = best(found)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows["q"].to_numpy())), pa.array(rows["chunk"].tolist(), schema.field("chunk_id").type), pa.array(rows["score"].to_numpy())], names)

    return run
