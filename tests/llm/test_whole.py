"""Whole results of operators 1, 4, 6, 7, 8 and 10 against brute force; columns with clashing names; odd rows."""

import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docspark.llm import embedding_neardup, lm_scoring, mixing, ngram_join, packing, pii, quality_model, quality_rules, queries, sharding, url_filter

DIR = "/root/testdata/sf0.001"
SPACE = r"[\x20\x09-\x0D]+"


def fold(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def words_of(text):
    return [w for w in re.split(SPACE, text) if w]


# --- columns of the input stay, whatever their names ----------------------------------------------


CLASHES = (
    "_row", "_row_", "_mix", "_pii", "_quality", "_url_verdict", "_m", "_broken", "_kept", "_l", "_w", "_h", "_c", "_s", "_r", "_t", "_t0", "_p0", "_id", "_text", "_tokens", "_whole", "_epoch", "_taken",
    "Hilbert", "SHARD", "slot", "_cell", "_sub", "_rank", "_total", "_d0", "_q0", "_y0", "_name", "_step", "_url", "_host", "_path", "_rule", "_score", "_q", "_key", "key", "sig", "rep", "n", "first", "unit", "num", "length", "piece", "_run",
)


def test_clashing_names(spark):
    rows = [(1, "some words of one text, mail a@b.org", "en", "src1", "http://x.org/es/"), (2, None, None, None, None), (2, "more words " * 30, "de", "src2", "s://y.net/1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string").select("*", *[(F.length("text") + i).alias(c) for i, c in enumerate(CLASHES)])
    kept = lambda df, cols=docs.columns: sorted(map(str, df.select(*[df[c] for c in cols]).collect()))
    want = kept(docs)
    for out, added in (
        (pii.detect(docs), 1), (url_filter.judge(docs), 1), (quality_model.classify(docs), 1), (quality_rules.apply_rules(docs), 3), (quality_rules.measure(docs), 1),
        (mixing.mix(docs, mixing.corpus_tree(), mixing.corpus_weights(), 4.0, 4), 1), (sharding.assign_shards(docs, 2, ("lang", "source"), (sharding.quantise_log(F.col("doc_id")),), keys=("doc_id", "text")), 3),
    ):
        assert out.columns[: len(docs.columns)] == docs.columns and len(set(map(str.lower, out.columns))) == len(docs.columns) + added
        lost = {x for x in want if "text=None" in x} if "mix" in out.columns[-1] else set()  # a leaf without tokens gives nothing
        assert set(kept(out)) == set(want) - lost
    assert kept(pii.mask(docs), [c for c in docs.columns if c != "text"]) == kept(docs, [c for c in docs.columns if c != "text"])
    assert mixing.resample(docs, mixing.corpus_tree(), mixing.corpus_weights(), 4.0, 4).columns == docs.columns
    assert ngram_join.keep_one(docs).columns == docs.columns == quality_rules.filter_quality(docs).columns
    assert packing.pack(docs).count() == lm_scoring.score(docs).count() == ngram_join.near_duplicates(docs).count() == 3


# --- 1 ---------------------------------------------------------------------------------------------


def test_weights_by_node(spark):
    """A domain's target does not grow with its number of sources, and what a node without weight holds goes to its siblings."""
    leaves = [("a", "en", f"s{i}", 1000) for i in range(9)] + [("b", "en", "s", 100_000), ("c", "en", "s", 50), ("d", "en", "s", 9000), ("d", "fr", "s", 9000)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    weights = {"domain": F.when(F.col("domain") == "d", 2.0).otherwise(1.0), "lang": F.when(F.col("lang") == "fr", 0.0)}
    got = Counter()
    for r in mixing.allocate(df, ["domain", "lang", "source"], F.lit(10_000.0), 1, weights).collect():
        got[r["domain"], r["lang"]] += r["alloc"]
    # c gives 50; the rest is shared 1 : 1 : 2
    assert got["c", "en"] == 50 and got["d", "fr"] == 0
    assert got["a", "en"] == pytest.approx(9950 / 4) == got["b", "en"] and got["d", "en"] == pytest.approx(9950 / 2)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    show = lambda x: "NULL" if x is None or x != x else (repr(float(x)) if isinstance(x, float) else str(x))
    rows = lambda found, columns: sorted(tuple(show(x) for _, x in sorted(zip(columns, r), key=lambda p: p[0])) for r in found)
    got, told = queries.QUERIES[name](spark, DIR), duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in told.description]
    assert sorted(got.columns) == sorted(columns) and rows(got.collect(), got.columns) == rows(told.fetchall(), columns)


# --- 2, 5 ------------------------------------------------------------------------------------------


def test_joins_of_repeated_and_null_ids(spark):
    v = [[1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [0.0, 0.0, 1.0]]
    rows = [(3, v[0]), (3, v[0]), (3, v[2]), (None, v[1]), (None, None), (5, v[1]), (5, None)]
    out = embedding_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted(key((r["vec_id"], r["n_links"], r["component_id"])) for r in out)
    assert got == [(-1, 0, -1), (-1, 3, 3), (3, 0, 3), (3, 3, 3), (3, 3, 3), (5, 0, 5), (5, 3, 3)]
    text = " ".join(f"a{i}" for i in range(80))
    rows = [(3, text), (3, text), (3, "other words"), (None, text + " b"), (None, None), (5, text + " c"), (5, "")]
    out = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(key((r["doc_id"], r["n_links"], r["component_id"])) for r in out)
    assert got == [(-1, 1, 5), (-1, 3, 3), (3, 0, 3), (3, 3, 3), (3, 3, 3), (5, 1, 5), (5, 3, 3)]


# --- 4 ---------------------------------------------------------------------------------------------


def test_url_verdicts(spark):
    """Training, calibration and verdicts of all pages, with dictionaries."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    more = spark.createDataFrame([(9001, "s://q.net/" + "ab/" * 20_000), (9002, "s://q.net/x"), (9002, "s://q.net/x"), (9003, ""), (9004, None), (9005, "né://ü.example/é?1")], "page_id long, url string")
    pages = pages.union(more)
    out = url_filter.report(pages).collect()
    urls = {r["url"]: r["held"] for r in pages.select("url", (F.pmod(F.xxhash64("url"), F.lit(url_filter.HOLD_OUT)) == 0).alias("held")).distinct().collect() if r["url"] is not None}
    rule = {}
    for u in urls:
        rest = u.split("://", 1)[1] if "://" in u else None
        host = fold(re.split("[/?#]", rest)[0]) if rest is not None else ""
        path = re.split("[?#]", rest[len(host) :])[0] if rest is not None else ""
        fits = [(len(h + p), v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule[u] = max(fits)[1] if fits else None
    n, k = url_filter.ORDER, url_filter.BACKOFF
    count, context = [Counter(), Counter()], [Counter(), Counter()]
    padded = {u: "\x02" * n + u + "\x03" for u in urls}
    for u, held in urls.items():
        if rule[u] and not held:
            g, p = rule[u] == "allow", padded[u]
            for i in range(n, len(p)):
                for m in range(n + 1):
                    count[g][p[i - m : i + 1]] += 1
                    context[g][p[i - m : i]] += 1

    def prob(g, gram):
        return (count[g][gram] + k * (1 / url_filter.ALPHABET if len(gram) == 1 else prob(g, gram[1:]))) / (context[g][gram[:-1]] + k)

    seen = {}

    def ratio(gram):
        if gram not in seen:
            seen[gram] = math.log(prob(1, gram)) - math.log(prob(0, gram))
        return seen[gram]

    score = {u: sum(ratio(p[i - n : i + 1]) for i in range(n, len(p))) / (len(p) - n) for u, p in padded.items()}
    judged = [(score[u], rule[u] == "allow") for u, held in urls.items() if rule[u] and held]
    good, bad = sum(g for _, g in judged), sum(not g for _, g in judged)
    assert good and bad
    step = (url_filter.HIGH - url_filter.LOW) / url_filter.BINS
    bins = sorted({int((s - url_filter.LOW) / step) for s, _ in judged})
    gain = lambda b: sum(1 / bad for s, g in judged if not g and int((s - url_filter.LOW) / step) <= b) - sum(1 / good for s, g in judged if g and int((s - url_filter.LOW) / step) <= b)
    best = max(round(gain(b), 9) for b in bins)
    ends = [url_filter.LOW + (b + 1) * step for b in bins if round(gain(b), 9) == best]
    wrong = 0
    assert all(r["verdict"] in ("allow", "block") for r in out)
    told = {r["page_id"]: r for r in out}
    for r in pages.collect():
        got, s = told[r["page_id"]], score.get(r["url"], 0.0)
        assert got["score"] == pytest.approx(s, abs=1e-7)
        if r["url"] is not None and rule[r["url"]]:
            assert got["verdict"] == rule[r["url"]] and got["by_rule"]
        else:
            wrong += all(("allow" if s >= e else "block") != got["verdict"] for e in ends)
    assert wrong == 0 and len(out) == pages.count()


# --- 6 ---------------------------------------------------------------------------------------------


def test_shards_prune(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = sharding.assign_shards(sharding.metadata(docs), 40, ("lang", "source"), (sharding.quantise_log(F.col("size") / 16),))
    sharding.write_shards(out, str(tmp_path / "s"), 10)
    back = spark.read.parquet(str(tmp_path / "s")).withColumn("file", F.input_file_name()).toPandas()
    assert len(back) == 1000 and back.groupby("file")["shard"].nunique().max() == 1 and back.groupby("file").size().max() <= 10 and back["file"].nunique() >= 100
    for _, g in back.groupby("file"):  # a file is a run of slots
        assert g["slot"].max() - g["slot"].min() == len(g) - 1
    lang, source = (back.groupby(c)["shard"].nunique() for c in ("lang", "source"))
    share = back["lang"].value_counts(normalize=True)
    for x in lang.index:  # its rows fill share * 40 shards; a hash would put it in all 40
        assert lang[x] <= 40 * share[x] + 8
    assert back.groupby("shard")["lang"].nunique().mean() < 1.5 and source.mean() < 14


def test_name_steps(spark):
    names = spark.createDataFrame([(f"n{i:03d}",) for i in range(100) for _ in range(1 if i != 50 else 100)] + [(None,)], "name string")
    steps = {r["_name"]: r["_step"] for r in sharding.name_steps(names, "name", 3).collect()}
    order = sorted(steps, key=lambda x: (x is not None, x))
    assert [steps[x] for x in order] == sorted(steps.values()) and steps[None] == 0 and max(steps.values()) == 7
    assert sum(s == steps["n050"] for s in steps.values()) < 27  # half of all rows are its own
    few = spark.createDataFrame([("en",)] * 90 + [("de",), ("es",), ("fr",)], "name string")
    assert sorted(r["_step"] for r in sharding.name_steps(few, "name", 4).collect()) == [0, 4, 8, 12]


# --- 7 ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing._encoder()


def test_ids_of_all_documents(spark, tokenizer):
    slow, fast = tokenizer
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for t, e in zip(texts, slow.encode_batch(texts, add_special_tokens=False)):
        assert fast(t).tolist() == e.ids


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aZé Ωж9.,'’-\n\t\r 　😀<|>ſİ₂½་", max_size=60), st.text(alphabet=" \n\t'sSdDlL0a", max_size=60)))
def test_ids_of_any_text(tokenizer, text):
    slow, fast = tokenizer
    text = text.encode("utf-8", "ignore").decode()
    assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids


# --- 8 ---------------------------------------------------------------------------------------------


def test_classifier_by_hand(spark):
    """Votes, posteriors and scores of all documents with plain loops."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a"), (-4, "the the the " * 400), (-4, "the the the " * 400)], "doc_id long, text string")
    docs = docs.union(odd)
    rows = [(r["doc_id"], r["text"] or "", r["h"]) for r in docs.withColumn("h", F.xxhash64("doc_id", "text")).collect()]
    mask, base = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    def hashed(data):
        return mix((sum((b + 1) * pow(base, k, 1 << 64) for k, b in enumerate(data)) + len(data)) & mask)

    def vote(bad, good):
        return 0 if bad else 1 if good else -1

    memo = {}

    def once(data):
        if data not in memo:
            memo[data] = hashed(data)
        return memo[data]

    letter = set(range(65, 91)) | set(range(97, 123)) | set(range(128, 256))

    def shape(w):
        return bytes(97 if b in letter else 48 if 48 <= b < 58 else b for b in w)

    def look(text):
        data = text.encode().lower()
        w = [x for x in re.split(rb"[\x20\x09-\x0D]+", data) if x]
        n = len(w)
        chars = sum((b & 0xC0) != 0x80 for b in data) - sum(b <= 32 for b in data)
        symbols, stop = sum(b in b"#*$%&|<>" for b in data), sum(x.decode() in set(quality_rules.STOP_WORDS) for x in w)
        lines = [x for x in text.split("\n") if x.strip()]
        dup = len(lines) - len(set(lines))
        windows = Counter(zip(w, w[1:], w[2:]))
        repeats = sum(c for c in windows.values() if c > 1)
        lettered, stutter = sum(any(b in letter for b in x) for x in w), sum(a == b for a, b in zip(w, w[1:]))
        votes = (
            vote(n < 20, n >= 100), vote(symbols / max(n, 1e-9) > 0.1 if n else symbols > 0, symbols == 0), vote(stop < 0.06 * n - 1e-9, stop > 0.12 * n + 1e-9), vote(10 * dup > 3 * len(lines), dup == 0 and len(lines) > 1),
            vote(10 * repeats > 3 * n, 25 * repeats < 2 * n), vote(5 * chars < 19 * n or 5 * chars > 34 * n, 21 * n < 5 * chars < 30 * n), vote(5 * lettered < 4 * n, 100 * lettered > 97 * n), vote(50 * stutter > 3 * n, 50 * stutter < n),
        )
        steps = [10 * len(set(w)) // n if n else 11, 20 + n.bit_length(), 60 + 50 * stutter // n if n else 59]
        features = Counter(once(x) % quality_model.BUCKETS for x in w)
        features.update((once(shape(x)) ^ 0x5555) % quality_model.BUCKETS for x in w)
        features.update(mix(s + (1 << 40)) % quality_model.BUCKETS for s in steps)
        value = {k: math.log1p(c) for k, c in features.items()}
        size = math.sqrt(sum(v * v for v in value.values()))
        return votes, {k: v / size for k, v in value.items()}

    seen = [look(t) for _, t, _ in rows]
    votes = [v for v, _ in seen]
    post = [min(max(sum(x == 1 for x in v) / m, 0.05), 0.95) if (m := sum(x >= 0 for x in v)) else 0.5 for v in votes]
    for _ in range(60):
        prior = min(max((sum(post) + 1) / (len(post) + 2), 0.01), 0.99)
        right = []
        for k in range(8):
            on = [(p, v[k]) for p, v in zip(post, votes) if v[k] >= 0]
            right.append(((sum(p for p, x in on if x == 1) + 4) / (sum(p for p, _ in on) + 5), (sum(1 - p for p, x in on if x == 0) + 4) / (sum(1 - p for p, _ in on) + 5)))
        odds = [math.log(prior / (1 - prior)) + sum(math.log(r1 / (1 - r0)) if x == 1 else math.log((1 - r1) / r0) for x, (r1, r0) in zip(v, right) if x >= 0) for v in votes]
        post = [1 / (1 + math.exp(-min(max(o, -40), 40))) for o in odds]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][2], post[i]))
    mean = sum(post) / len(post)
    up, down = 0.5 / max(mean, 0.02), 0.5 / max(1 - mean, 0.02)
    w, g, b, gb = defaultdict(float), defaultdict(lambda: 1e-6), 0.0, 1e-6
    for _ in range(quality_model.EPOCHS):
        for i in order:
            value, y = seen[i][1], post[i]
            p = 1 / (1 + math.exp(-min(max(sum(w[k] * v for k, v in value.items()) + b, -30), 30)))
            step = y * up * (p - 1) + (1 - y) * down * p
            for k, v in value.items():
                d = step * v
                g[k] += d * d
                w[k] -= 0.3 * d / math.sqrt(g[k])
            gb += step * step
            b -= 0.3 * step / math.sqrt(gb)
    want = Counter()
    for (i, _, _), p, (_, value) in zip(rows, post, seen):
        want[i, round(p, 4), round(1 / (1 + math.exp(-sum(w[k] * v for k, v in value.items()) - b)), 3)] += 1
    got = Counter((r["doc_id"], round(r["weak_label"], 4), round(r["score"], 3)) for r in quality_model.report(docs).collect())
    assert sum((got & want).values()) >= len(rows) - 6  # a few may round to the other side
    near = {k[0]: k for k in want}
    assert all(abs(k[1] - near[k[0]][1]) < 1e-3 and abs(k[2] - near[k[0]][2]) < 5e-3 for k in got)


# --- 10 --------------------------------------------------------------------------------------------


def test_lattice_scores_by_hand(spark):
    """The score of every document with sums over all segmentations in plain dictionaries."""
    import zlib

    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "q" * 300), (-4, "Ünïcode 😀 \x00x"), (-4, "Ünïcode 😀 \x00x"), (None, "the of")], "doc_id long, text string")
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").limit(60).union(odd)
    docs = spark.createDataFrame(docs.collect(), "doc_id long, text string").repartition(3).persist()
    rows = [(r["doc_id"], words_of(fold(r["text"] or ""))) for r in docs.collect()]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    count, ends = Counter(), 0
    for i, ws in rows:
        if not held(i):
            count.update(ws)
            ends += 1
    pieces, start = lm_scoring.load_pieces()
    longest = max(map(len, pieces))

    def forward(word, p):
        alpha = [1.0]
        for j in range(1, len(word) + 1):
            alpha.append(sum(alpha[s] * p.get(word[s:j], 0.0) for s in range(max(0, j - longest), j)))
        return alpha

    def expected(p):
        out = defaultdict(float)
        for w, c in count.items():
            word = (" " + w).encode()
            if len(word) > 120:  # its sums leave the range of floating numbers
                return None
            alpha, beta = forward(word, p), [0.0] * len(word) + [1.0]
            for s in range(len(word) - 1, -1, -1):
                beta[s] = sum(p.get(word[s:j], 0.0) * beta[j] for j in range(s + 1, min(len(word), s + longest) + 1))
            for s in range(len(word)):
                for j in range(s + 1, min(len(word), s + longest) + 1):
                    if word[s:j] in p:
                        out[word[s:j]] += c * alpha[s] * p[word[s:j]] * beta[j] / alpha[-1]
        return out

    first = dict(zip(pieces, np.exp(start)))
    p = first
    long_words = [w for w in count if len(w) > 110]
    for w in long_words:
        del count[w]
    docs_used = docs.where("NOT (doc_id <=> -3)")
    rows = [r for r in rows if r[0] != -3]
    ends -= not held(-3)
    for _ in range(lm_scoring.WARM_PASSES):
        e = expected(p)
        total = sum(e.values())
        mixed = {x: e[x] + 0.05 * total * first[x] for x in pieces}
        whole = sum(mixed.values())
        p = {x: v / whole for x, v in mixed.items()}
    e = expected(p)
    whole = sum(e.values()) + ends + lm_scoring.SMOOTHING * (len(pieces) + 1)
    p = {x: (e[x] + lm_scoring.SMOOTHING) / whole for x in pieces}
    end = math.log10((ends + lm_scoring.SMOOTHING) / whole)
    want = sorted((-9 if i is None else i, round(end + sum(math.log10(forward((" " + w).encode(), p)[-1]) for w in ws), 5)) for i, ws in rows)
    got = sorted((-9 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in lm_scoring.score(docs_used).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-6, abs=1e-4)


def hilbert_of(point, bits):
    """Place of a cell on the curve, by halving the box bit by bit (axes to transposed index and its bits interleaved)."""
    x, n = list(point), len(point)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = x[0] ^ t, x[i] ^ t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    for level in range(bits - 1, 0, -1):
        if x[-1] & (1 << level):
            t ^= (1 << level) - 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | ((v ^ t) >> b & 1)
    return out


def plain_shards(rows, n_shards=40, bits=4):
    """doc to (size, crc, shard, slot): every row placed by sorting all of them."""
    import zlib

    name = lambda v: (v is not None, v or "")  # noqa: E731  nulls first
    step = {}
    for c in ("lang", "source"):
        names = sorted({r[c] for r in rows}, key=name)
        before = 0
        for rank, v in enumerate(names):
            step[c, v] = (rank << bits) // len(names) if len(names) <= 1 << bits else (before << bits) // len(rows)
            before += sum(r[c] == v for r in rows)
    placed = []
    for r in rows:
        data = (r["text"] or "").encode()
        size, crc = len(data) + 16, zlib.crc32(data)
        at = hilbert_of((step["lang", r["lang"]], step["source", r["source"]], min((1 << bits) - 1, max(int(size / 16), 0).bit_length() - 1)), bits)
        placed.append((at, name(r["lang"]), name(r["source"]), (r["doc_id"] is not None, r["doc_id"] or 0), crc, r["doc_id"], size))
    out = []
    for rank, (*_, crc, doc, size) in enumerate(sorted(placed)):
        shard = rank * n_shards // len(rows)
        out.append((doc, size, crc, shard, rank - -(-shard * len(rows) // n_shards)))
    return out


@pytest.mark.parametrize("names", [50_000, 3])
def test_shards_of_all_documents_by_sorting(spark, monkeypatch, names):
    """Operator 6 as a whole, with names ordered in one task and over ranges."""
    from docspark.llm import sharding

    monkeypatch.setattr(sharding, "BROADCAST_NAMES", names)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(-1, None, None, None), (-2, "", "", "s"), (-3, "x" * 70_000, "en", None), (None, "a", "en", "src1")], docs.schema)
    every = docs.unionByName(odd)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.report(every).collect())
    assert got == sorted((d is not None, d or 0, s, c, h, t) for d, s, c, h, t in plain_shards([r.asDict() for r in every.collect()]))
