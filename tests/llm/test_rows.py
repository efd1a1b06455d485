"""Operators 3, 4, 6, 7, 8, 9, 10 and 1 against brute force on small tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docspark.llm import lm_scoring, mixing, packing, pii, quality_model, quality_rules, sharding, url_filter

DIR = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "word " * 20_000), (6, "x" * 60_000), (7, "a b c a b c\nq\nq\n a b"), (7, "a b c a b c\nq\nq\n a b"), (None, "é ... the\n- of"), (9, "😀 &&& ### the of\x0band\r\n")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")


# --- 3 -----------------------------------------------------------------------------------------


def base_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


ANCHORS = pii.automaton()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1234567890@.+-() İé:/_%", max_size=80))
def test_pii_base_spans(text):
    assert [s for s in pii.find_spans(text, ANCHORS) if s[0] in pii.BASE_KINDS] == base_spans(text)


def test_pii_rows(spark, odd):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    for r, (i, t) in zip(pii.report(docs).orderBy("doc_id").collect(), sorted(tuple(x) for x in docs.collect())):
        want = base_spans(t)
        assert r["doc_id"] == i and r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in want) for k in pii.BASE_KINDS]
    assert pii.report(odd).count() == len(ODD) and pii.mask(odd).columns == odd.columns
    t = "mail a.b@c.org or https://me:pw@host.org/x, iban GB82 WEST 1234 5698 7654 32, account no. 12345678 end"
    spans = pii.find_spans(t, ANCHORS)
    assert {"email", "url", "iban", "account"} <= {s[0] for s in spans}
    clean = pii.redact(t, spans)
    assert "@" not in clean and "12345678" not in clean and clean.startswith("mail <EMAIL> or <URL>") and clean.endswith(" end")


# --- 4 -----------------------------------------------------------------------------------------


def test_url_parts(spark):
    urls = ["https://A.Example.ORG/es/x?q#f", "http://x.org?y", "no scheme", None, "", "s://evilexample.org/es/", "s://b.example.org/en/12", "s://q.com/fr/1", "s://q.com/de/", "a://b://c.org/"]
    rows = [r.asDict() for r in url_filter.report(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).orderBy("page_id").collect()]
    assert [(r["host"], r["path"], r["rule"]) for r in rows] == [
        ("a.example.org", "/es/x", "example.org/es/"), ("x.org", "", None), ("", "", None), ("", "", None), ("", "", None), ("evilexample.org", "/es/", "org/"),
        ("b.example.org", "/en/12", "example.org/en/1"), ("q.com", "/fr/1", "com/fr/"), ("q.com", "/de/", "com/de/"), ("b:", "//c.org/", None),
    ]
    assert all(r["verdict"] in ("allow", "block") for r in rows)
    assert url_filter.report(spark.createDataFrame([], "page_id int, url string")).count() == 0


def test_url_model(spark):
    """Scores equal a model counted with dictionaries."""
    urls = spark.read.parquet(f"{DIR}/pages.parquet").select(F.col("url").alias("_url")).distinct().collect()
    good = [(r["_url"], zlib.crc32(r["_url"].encode()) % 2 == 0) for r in urls]
    df = spark.createDataFrame(good, "_url string, _good boolean")
    count = [Counter(), Counter()]
    for u, g in good:
        p = "\x02" * url_filter.ORDER + u + "\x03"
        for i in range(url_filter.ORDER, len(p)):
            for k in range(1, url_filter.ORDER + 2):
                count[g][p[i - k + 1 : i + 1]] += 1
    context = [Counter(), Counter()]
    for g in (0, 1):
        for gram, n in count[g].items():
            context[g][(len(gram), gram[:-1])] += n

    def prob(g, gram):
        low = 1 / url_filter.ALPHABET if len(gram) == 1 else prob(g, gram[1:])
        return (count[g][gram] + url_filter.BACKOFF * low) / (context[g][(len(gram), gram[:-1])] + url_filter.BACKOFF)

    have = {r["_url"]: r["_score"] for r in url_filter.score(df, url_filter.train(df)).collect()}
    for u, _ in good[:20]:
        p = "\x02" * url_filter.ORDER + u + "\x03"
        grams = [p[i - url_filter.ORDER : i + 1] for i in range(url_filter.ORDER, len(p))]
        assert have[u] == pytest.approx(sum(math.log(prob(1, x) / prob(0, x)) for x in grams) / len(grams), abs=1e-6)


def test_url_model_on_untrained_urls(spark, monkeypatch):
    """URLs that were not trained on score the full difference of the smoothed models, by broadcast or by shuffle."""
    trained = [(f"s://kept{i % 7}.net/common/{i}", True) for i in range(300)] + [(f"s://gone{i % 5}.net/shop?{i}", False) for i in range(200)]
    count, context = [Counter(), Counter()], [Counter(), Counter()]
    padded = lambda u: "\x02" * url_filter.ORDER + u + "\x03"
    for u, g in trained:
        p = padded(u)
        for i in range(url_filter.ORDER, len(p)):
            for k in range(1, url_filter.ORDER + 2):
                count[g][p[i - k + 1 : i + 1]] += 1
                context[g][p[i - k + 1 : i]] += 1

    def prob(g, gram):
        low = 1 / url_filter.ALPHABET if len(gram) == 1 else prob(g, gram[1:])
        return (count[g][gram] + url_filter.BACKOFF * low) / (context[g][gram[:-1]] + url_filter.BACKOFF)

    new = ["s://kept3.net/commoX", "s://gone9.net/comZ", "t://kept1.net/shop?7", "\u00fc\U0001f600", ""]
    model = url_filter.train(spark.createDataFrame(trained, "_url string, _good boolean"))
    for frequent in (16_384, 30, 0):
        monkeypatch.setattr(url_filter, "FREQUENT", frequent)
        have = {r["_url"]: r["_score"] for r in url_filter.score(spark.createDataFrame([(u,) for u in new], "_url string"), model).collect()}
        assert set(have) == set(new)
        for u in new:
            p = padded(u)
            grams = [p[i - url_filter.ORDER : i + 1] for i in range(url_filter.ORDER, len(p))]
            assert have[u] == pytest.approx(sum(math.log(prob(1, x) / prob(0, x)) for x in grams) / len(grams), abs=1e-8)


# --- 6 -----------------------------------------------------------------------------------------


def test_hilbert_is_a_walk(spark):
    rows = sharding.curve(spark, 3, 2).orderBy("hilbert").collect()
    assert [r["hilbert"] for r in rows] == list(range(64))
    at = [((r["cell"] >> 4) & 3, (r["cell"] >> 2) & 3, r["cell"] & 3) for r in rows]
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(at, at[1:]))


def test_shards(spark, odd):
    docs = odd.withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") > 3, "src3"), "hilbert_": F.lit(1)})
    for df, n in ((docs, len(ODD)), (spark.read.parquet(f"{DIR}/documents.parquet"), 200), (docs.limit(0), 0)):
        out = sharding.report(df).toPandas()
        assert len(out) == n
        if n:
            sizes = out.groupby("shard")["slot"].agg(["count", "max", "nunique"])
            per = sizes["count"].reindex(range(40), fill_value=0)
            assert per.max() - per.min() <= 1 and (sizes["max"] + 1 == sizes["count"]).all() and (sizes["nunique"] == sizes["count"]).all()
            order = out.sort_values(["shard", "slot"])["hilbert"]
            assert order.is_monotonic_increasing
    row = sharding.report(docs).where("doc_id = 9").first()
    assert row["size"] == len(ODD[-1][1].encode()) + 16 and row["text_crc32"] == zlib.crc32(ODD[-1][1].encode())


# --- 7 -----------------------------------------------------------------------------------------


def test_packing(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").limit(120).union(odd).union(spark.createDataFrame([(77, "end <|endoftext|> and ﷽\u180e x" + " " * 3000)], "doc_id long, text string"))
    out = packing.report(docs).toPandas()
    want = []
    for r in docs.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        want += [(r["doc_id"] if r["doc_id"] is not None else -1, i, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    have = out.fillna({"doc_id": -1}).astype({"doc_id": int})[["doc_id", "piece", "start", "length", "ids_crc32"]]
    assert sorted(map(tuple, have.itertuples(index=False))) == sorted(want)
    placed = out.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id")["length"].cumsum() - placed["length"] == placed["offset"]).all()
    full = placed.groupby("sequence_id")["length"].sum()
    assert full.max() <= 1024 and len(full) <= -(-full.sum() // 1024) * 1.03 + 2
    assert packing.report(odd.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plan_places_all(counts):
    done = Counter()
    for times, lengths in packing.plan(counts, 64):
        assert times > 0 and sum(lengths) <= 64
        for n in lengths:
            done[n] += times
    assert done == Counter(counts)


def test_two_fit_is_tighter():
    # greedy alone fills 10 with 6+3; 2+2 in place of 3 leaves no gap
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10)[0] == (1, (6, 2, 2))


# --- 9, 8 --------------------------------------------------------------------------------------


def measured(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, odd):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    for df in (docs, odd):
        have = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.report(df).collect())
        assert have == Counter((r["doc_id"], *measured(r["text"])) for r in df.collect())
    clash = docs.withColumns({c: F.lit(1) for c in ("_m", "_w", "_kept", "_row", "n_words")})
    kept = quality_rules.filter_quality(clash)
    assert kept.columns == clash.columns and kept.first()["_m"] == 1
    assert kept.count() == quality_rules.report(docs).where("kept").count() > 100
    assert quality_rules.report(docs.limit(0)).count() == 0


def test_labeller_model():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.7
    accuracy = np.array([0.95, 0.8, 0.7, 0.6, 0.85])
    votes = np.where(rng.random((20_000, 5)) < accuracy, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = -1
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = quality_model.fit_votes(patterns, counts.astype(float))[inverse.reshape(-1)]
    assert ((post > 0.5) == truth).mean() > 0.9
    weights = np.log(accuracy / (1 - accuracy))
    best = (np.where(votes == -1, 0, 2 * votes - 1) @ weights + math.log(0.7 / 0.3)) > 0
    assert ((post > 0.5) == best).mean() > 0.98


def test_classifier_on_labels(spark, odd):
    d = "/root/testdata/sf0.01"
    out = quality_model.report(spark.read.parquet(f"{d}/documents.parquet"))
    told = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert (told["kept"] == (told["quality"] == 1)).mean() > 0.9 and told[told["quality"] == 1]["kept"].mean() > 0.97
    assert quality_model.report(odd).count() == len(ODD) and quality_model.report(odd.limit(0)).count() == 0


# --- 10 ----------------------------------------------------------------------------------------


def test_lattice_sums_all_paths():
    pieces = [b"a", b"b", b"ab", b"ba", b" ", b" a", b"abab"]
    p = np.array([0.2, 0.1, 0.25, 0.05, 0.1, 0.2, 0.1])
    lattice = lm_scoring.Lattice(pieces, np.log(p))
    weight = dict(zip(pieces, p))
    for word in (b" a", b" abab", b" babab", b" b"):
        paths = []
        for n in range(len(word)):
            for cut in itertools.combinations(range(1, len(word)), n):
                parts = [word[i:j] for i, j in zip((0, *cut), (*cut, len(word)))]
                if all(x in weight for x in parts):
                    paths.append((math.prod(weight[x] for x in parts), parts))
        total = sum(x for x, _ in paths)
        assert lattice.log_probability([word])[0] == pytest.approx(math.log(total))
        uses = lattice.expected_counts([word], np.array([3.0]))
        for i, x in enumerate(pieces):
            assert uses[i] == pytest.approx(3 * sum(q * parts.count(x) for q, parts in paths) / total)


def test_long_words_alike(monkeypatch):
    pieces, logp = lm_scoring.load_pieces()
    words = [b" the", " élève".encode(), b" " + b"ab" * 40, bytes(range(128, 140))]
    lattice = lm_scoring.Lattice(pieces, logp)
    a, c = lattice.log_probability(words), lattice.expected_counts(words, np.ones(4))
    monkeypatch.setattr(lm_scoring, "LONG_WORD", 0)
    assert np.allclose(a, lattice.log_probability(words)) and np.allclose(c, lattice.expected_counts(words, np.ones(4)))
    assert sum(n * len(x) for n, x in zip(c, pieces)) == pytest.approx(sum(map(len, words)))


def test_lm_rows(spark, odd):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").union(odd)
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    rows = [tuple(r) for r in docs.collect()]
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update(split(t))
            c["\n"] += 1
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, held(i), len(split(t)) + 1, sum(c[w] > 0 for w in split(t)) + 1, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*split(t), "\n"]), 4)) for i, t in rows)
    out = lm_scoring.report(docs).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in out) == want
    assert {r["train_tokens"] for r in out} == {n} and all(r["score"] < 0 for r in out)
    assert lm_scoring.report(odd.limit(0)).count() == 0


# --- 1 -----------------------------------------------------------------------------------------


def fill(target, children):
    """Water-filling by repeated redistribution of what the full ones leave."""
    alloc, open_ = dict.fromkeys(children, 0.0), {k for k, (cap, w) in children.items() if w > 0}
    while open_:
        left = target - sum(alloc[k] for k in children if k not in open_)
        total = sum(children[k][1] for k in open_)
        full = {k for k in open_ if children[k][0] <= left * children[k][1] / total + 1e-9}
        for k in full or open_:
            alloc[k] = children[k][0] if full else left * children[k][1] / total
        open_ = open_ - full if full else set()
    return alloc


def test_allocation(spark):
    rng = np.random.default_rng(2)
    leaves = [(f"d{a}", f"l{b}" if b else None, f"s{c}", int(rng.integers(1, 400)), float(rng.integers(0, 4))) for a in range(3) for b in range(3) for c in range(4)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long, weight double")
    for budget in (100.0, 3000.0, 1e9):
        have = {(r["domain"], r["lang"], r["source"]): r["alloc"] for r in mixing.allocate(df, ["domain", "lang", "source"], F.lit(budget), 2).collect()}

        def down(prefix, target, depth):
            keys = sorted({x[depth] for x in leaves if x[:depth] == prefix}, key=str)
            rows = lambda k: [x for x in leaves if x[: depth + 1] == (*prefix, k)]
            got = fill(target, {k: (2.0 * sum(x[3] for x in rows(k)), sum(x[4] for x in rows(k))) for k in keys})
            for k in keys:
                if depth == 2:
                    assert have[(*prefix, k)] == pytest.approx(got[k], abs=1e-6)
                else:
                    down((*prefix, k), got[k], depth + 1)

        down((), budget, 0)


def test_mixture(spark, odd):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source")
    seed = 42
    out = mixing.mix(docs, mixing.corpus_tree(), mixing.corpus_weight(), 0.9, 3, seed).collect()
    every = docs.select("doc_id", mixing.count_tokens(F.col("text")).alias("n"), *[c.alias(k) for k, c in mixing.corpus_tree().items()], *[F.xxhash64(F.lit(seed), F.lit(e).cast("long"), "doc_id", F.xxhash64("text")).alias(f"o{e}") for e in range(4)]).collect()
    total = sum(r["n"] for r in every)
    sums = Counter()
    for r in every:
        sums[r["domain"], r["lang"], r["source"]] += r["n"]
    leaves = spark.createDataFrame([(*k, n) for k, n in sums.items()], "domain string, lang string, source string, tokens long").withColumn("weight", mixing.corpus_weight())
    want = Counter()
    for a in mixing.allocate(leaves, ["domain", "lang", "source"], F.lit(total * 0.9), 3).collect():
        mine = [r for r in every if (r["domain"], r["lang"], r["source"]) == (a["domain"], a["lang"], a["source"])]
        if not a["tokens"]:
            continue
        whole = math.floor(a["alloc"] / a["tokens"])
        rest = math.floor(a["alloc"]) - whole * a["tokens"]
        want.update((r["doc_id"], e) for r in mine for e in range(whole))
        used = 0
        for r in sorted(mine, key=lambda r: r[f"o{min(whole, 3)}"]) if rest > 0 else []:
            used += r["n"]
            if used > rest:
                break
            want[r["doc_id"], whole] += 1
    assert Counter((r["doc_id"], r["_mix"]["epoch"]) for r in out) == want
    more = odd.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x"), "_t0": F.lit(1), "_row": F.lit(2)})
    mixed = mixing.mix(more, mixing.corpus_tree(), mixing.corpus_weight(), 1.0, 1)
    assert mixed.columns == [*more.columns, "_mix"] and mixed.count() == len(ODD)
    assert mixing.mix(more.limit(0), mixing.corpus_tree(), mixing.corpus_weight()).count() == 0
