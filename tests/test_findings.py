"""Queries on small tables that hold what made them differ from their SQL, and steps whose cost must stay bounded."""

import duckdb
import pandas as pd
import pytest

from docspark.operators import embedding as E
from docspark.plans.registry import ORACLE_SQL, QUERIES


def compared(spark, folder, query, **tables):
    """Rows of a query and of its SQL on the given tables."""
    c = duckdb.connect()
    for name, rows in tables.items():
        pd.DataFrame(rows).to_parquet(f"{folder}/{name}.parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = c.execute(ORACLE_SQL[query]).fetchdf()
    got = QUERIES[query](spark, str(folder)).toPandas()[list(want.columns)]
    return sorted(map(repr, got.itertuples(index=False, name=None))), sorted(map(repr, want.itertuples(index=False, name=None)))


def test_every_text_with_a_word_has_a_vector(spark, tmp_path):
    embed = E.hashing_embedder()
    one = {w: embed([w])[0] for w in (f"w{i}" for i in range(400))}
    pair = next(f"{a} {b}" for a in one for b in one if not (one[a] + one[b]).any())
    texts = [pair, pair.upper(), " ", " 　", "\x0b", " \t\n\f\r", "", "plain words", None]
    got, want = compared(spark, tmp_path, "e3_embed", documents={"doc_id": range(len(texts)), "text": texts})
    assert got == want
    assert list(embed([pair])[0]) == list(embed(["x", pair])[1])


def test_rewrites_with_sharp_s_in_capitals(spark, tmp_path):
    texts = ["Die Straße", "Straße eins. zwei", "STRAẞE. straße", "weiß! WEISS", "eins. zwei. drei", ""]
    got, want = compared(spark, tmp_path, "q1_rewrites", benchmark={"item_id": range(len(texts)), "text": texts})
    assert got == want


def test_references_without_semicolon(spark, tmp_path):
    from docspark.operators.html import page_blocks

    pages = ["<body><h1>a &amp;&amp</h1><p>b &am</p><p>&amp;quot; &quot;c&quot;</p></body>", "<p>&copy x &ampy;", "<p>&amp"]
    got, want = compared(spark, tmp_path, "x1_html_text", pages={"page_id": range(len(pages)), "html": pages})
    assert got == want
    assert [b[3] for b in page_blocks("<p>a &amp<p>&#65; &#x42;")] == ["a &", "A B"]
    assert [b[3] for b in page_blocks("<p>a &amp<p>&#65; &#x42; &nope;", closed=True)] == ["a &amp", "A B &nope;"]


@pytest.mark.parametrize("by", [(), ("lang",)])
def test_search_in_rows_equals_joins(spark, monkeypatch, by):
    """Questions sent to the rows of the chunks find and rank what the postings and their joins do, in slices of a few words too."""
    import random

    from docspark.operators import lexical as L
    from docspark.operators import rowsearch

    words, r = "ab bc cd de ef the a straße".split(), random.Random(7)
    some = lambda n: " ".join(r.choice(words) for _ in range(r.randint(1, n)))
    chunks = [(i, some(25), r.choice("xyz")) for i in range(60)] + [(60, None, "x"), (61, "", "y"), (62, "ab bc", None)]
    chunks += chunks[5:8]  # repeated rows
    piece = lambda: r.choice([some(1), f'"{some(3)}"', f"-{some(1)}", f'-"{some(3)}"', "or"])
    asked = [(i, " ".join(piece() for _ in range(r.randint(1, 6))), r.choice("xyz")) for i in range(120)] + [(120, "", "x"), (121, "-ab", "x"), (122, "ab or ab -bc", "z")]
    chunks = spark.createDataFrame(chunks, "chunk_id long, text string, lang string").repartition(3)
    asked = spark.createDataFrame(asked, "query_id long, query string, lang string")
    parsed = L.parse_queries(asked, by=by).cache()
    told = lambda df: sorted(map(tuple, df.collect()))
    monkeypatch.setattr(L, "QUESTION_TERMS", 0)
    joined = told(L.search_text(asked, chunks, 4, by=by).select("query_id", "chunk_id", "score", "rank"))
    matched = told(L.match_text(chunks, parsed, by=by))
    monkeypatch.setattr(L, "QUESTION_TERMS", 10_000)
    assert len(joined) > 200 and told(L.search_text(asked, chunks, 4, by=by).select("query_id", "chunk_id", "score", "rank")) == joined
    assert told(L.match_text(chunks, parsed, by=by)) == matched
    for name in ("WORDS", "PAIRS", "GATHERED"):
        monkeypatch.setattr(rowsearch, name, 20)
    assert told(L.search_text(asked, chunks, 4, by=by).select("query_id", "chunk_id", "score", "rank")) == joined
    assert L.search_text(asked, chunks, 0, by=by).count() == 0


def test_scores_are_rounded_as_spark_rounds(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from docspark.operators.rowsearch import rounded

    values = [0.1 / n for n in range(1, 3000)] + [0.0015625, 0.0000005, 0.1 / 3 + 0.0015625, 0.0, 12.3456785]
    want = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.round("v", 6)).collect()
    assert list(rounded(np.array(values))) == [r[0] for r in want]


def test_blocks_are_handed_on_in_slices(spark, monkeypatch):
    """Blocks of a few documents at a time are those of all at once."""
    from docspark.operators import blocks as X
    from docspark.operators import chunking as C

    docs = spark.createDataFrame(
        [(i, None if i == 3 else f"<TEI><text><body><div><head>h{i}</head><p>one {i}</p><p>two</p></div></body></text></TEI>", None if i == 4 else f"<h1>h{i}</h1><p>{'A sentence. ' * i}</p>") for i in range(9)], "id int, xml string, html string",
    ).coalesce(1)
    tei = lambda: sorted(map(tuple, X.extract_tei(docs.where("id <> 3"), "id").select("doc_id", "pos", "kind", "text").collect()))
    pages = lambda: sorted(map(tuple, C.split_oversize(X.extract_html(docs, "id"), 40).select("doc_id", "pos", "text").collect()))
    whole = tei(), pages()
    monkeypatch.setattr(X, "SLICE", 50)
    monkeypatch.setattr(C, "SLICE", 2)
    assert (tei(), pages()) == whole and len(whole[0]) == 24


def test_packing_holds_the_open_chunk_only(spark, monkeypatch):
    """F8: chunks come out while blocks are read, so neither a document nor a batch is held; batches and slices change nothing, null ids included."""
    from itertools import count

    from docspark.operators import chunking as C

    read = count()
    endless = ((("section_head", 0, f"head {i}") if i % 50 == 0 else ("paragraph", 0, f"text {i}") for i in iter(lambda: next(read), -1)))
    chunks = C.packed(endless, 60, 20)
    got = [next(chunks) for _ in range(1000)]
    assert next(read) <= sum(len(c) for c in got) + 60 and all(sum(len(b[2]) + 2 for b, _, _ in c) <= 62 for c in got)
    kind = ["section_head", "paragraph", "table", "paragraph", "list_item"]
    rows = [(None if d == 0 else 2**60 + d, p, kind[(p * p + d) % 5], p // 9, f"h{p // 9}", "Some words. " * ((p + d) % 12)) for d in range(12) for p in range(70)]
    blocks = spark.createDataFrame(rows, "doc_id long, pos int, kind string, div_index int, head string, text string")
    found = lambda: sorted(map(str, C.pack_blocks(blocks, 60, 20).collect()))
    whole = found()
    assert {r[0] for r in C.pack_blocks(blocks, 60, 20).select("doc_id").collect()} == {r[0] for r in rows}
    for name, n in (("SLICE", 2), ("HANDED", 50)):
        monkeypatch.setattr(C, name, n)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert found() == whole and len(whole) > 300
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_digests_of_files_read_in_splits(spark, tmp_path, monkeypatch):
    """a file beyond ``LARGE`` is read by many tasks, and its SHA-256 is that of the whole file whatever it holds."""
    import hashlib
    import random

    from docspark.sources import digests as D

    r = random.Random(3)
    body = r.randbytes(900_000)
    held = {
        "a.bin": body, "fed.bin": body + b"\n", "feeds.bin": b"\n" * 300_000, "none.bin": b"\x00" * 300_000, "mark.bin": b"\xef\xbb\xbf" + body, "mark fed%20é.bin": b"\xef\xbb\xbf" + body + b"\r\n\n",
        "cr.bin": b"\r\r\n\n\r" * 60_000, "part=1.bin": b"\n" + body, "small.bin": b"a\nb", "packed.gz": body, "edge.bin": body[:100_000], "past.bin": body[:100_001],
    }
    for name, data in held.items():
        (tmp_path / name).write_bytes(data)
    want = {(len(x), hashlib.sha256(x).hexdigest()) for x in held.values()}
    for name, n in (("LARGE", 100_000), ("ROUND", 150_000), ("PIECE", 10_000)):
        monkeypatch.setattr(D, name, n)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 65_536)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = D.read_digests(spark, f"{tmp_path}/*").collect()
    finally:
        for k in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{k}")
    assert {(x["length"], x["sha256"]) for x in got} == want and len(got) == len(held)
    assert {x["path"].rsplit("/", 1)[-1] for x in got} == set(held)


def test_cards_show_scores_as_their_sql_does(spark, tmp_path):
    """F1: a score between two of six digits goes where the number itself lies, not where its shortest decimal does."""
    from pyspark.sql import functions as F

    from docspark.operators import fusion as H

    near = [1.0, *(k / 100_000 for k in (419, 935, 4207, 9057, 17711, 30763, 51009, 77773)), 0.0]
    for texts in ([f"text {i}" for i in range(10)], [None, "text", *[None] * 8], [None] * 10):
        got, want = compared(
            spark, tmp_path, "f11_rerank_prompts", benchmark={"item_id": [0], "text": ["Unheard words"]}, embeddings={"vec_id": range(10), "embedding": [[c, (1 - c * c) ** 0.5] for c in near]},
            documents={"doc_id": range(10), "text": pd.Series(texts, dtype=object), "lang": ["en"] * 10, "source": ["web"] * 10},
        )
        assert got == want and len(got) == 1
    scores = [(1000 * i + 500) / 1e9 for i in range(3000)] + [1 / 128, 3 / 128, 1.0, 0.0, -0.0000015, 0.9999995, 1234567.0000005]
    packs = spark.createDataFrame([(i, 0, s, "t") for i, s in enumerate(scores)], "query_id int, chunk_id int, score double, text string").withColumn("rank", F.lit(1))
    shown = {r["query_id"]: r["prompt"] for r in H.rerank_prompts(H.build_context_pack(packs)).collect()}
    assert shown == {i: "#0 id=0 score=%.6f\nt" % s for i, s in enumerate(scores)}
