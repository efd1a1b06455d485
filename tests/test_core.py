import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.functions import normalize as N
from docspark.operators import blocks as X
from docspark.operators import chats as M
from docspark.operators import chunking as C
from docspark.operators import embedding as E
from docspark.operators import fusion as H
from docspark.operators import lexical as L
from docspark.operators import questions as Q
from docspark.operators import runs as R
from docspark.operators import vector as V

BLOCKS = "doc_id string, pos int, div_index int, kind string, head string, xml_id string, targets array<string>, equation_label string, text string, text_norm string"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text,want",
    [("im-\nproved", "improved"), ("of- floading", "offloading"), ("a\nb\n\nc", "a b\n\nc"), ("  a   b\t\tc ", "a b c"), ("a- Big", "a- Big"), (None, ""), ("élé-\nments", "éléments")],
)
def test_prose(spark, text, want):
    assert one(spark, text, N.normalize_prose) == want


def test_other_normalisers(spark):
    assert one(spark, "a\r\n b  c \r\n\n\n\nd", N.normalize_paragraphs) == "a\nb c\n\nd"
    assert one(spark, " a \n b ", N.collapse_ws) == "a b"
    assert one(spark, "x" * 12, lambda c: N.clip_text(c, 5)) == "xxxxx… [clipped]"
    assert one(spark, "The Big Thing", N.is_title) and not one(spark, "a small thing.", N.is_title)
    assert one(spark, "Done. The Origin of Species Darwin went home.", N.split_inline_titles) == "Done. \n\nThe Origin of Species\n\nDarwin went home."
    assert one(spark, "a  b\n c", lambda c: N.normalize_by_kind(c, F.lit("equation"))) == "a b\n c"


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>
<div><head>Introduction</head><p>See <ref target="#b1">[1]</ref> now.</p><formula xml:id="f"><label>1</label>E = mc</formula><note place="foot">n</note><div><p>inner</p></div></div>
<div type="references"><head>References</head><listBibl><bibl>A book</bibl></listBibl></div></body></text></TEI>"""


def test_tei(spark):
    docs = spark.createDataFrame([("d", TEI), ("none", "<TEI/>")], "doc_id string, xml string")
    rows = X.extract_tei(docs).orderBy("pos").collect()
    assert [r["kind"] for r in rows] == ["section_head", "paragraph", "equation", "footnote", "paragraph", "section_head", "reference"]
    assert rows[1]["targets"] == ["#b1"] and rows[1]["text"] == "See [1] now." and rows[2]["equation_label"] == "1" and rows[2]["text"] == "E = mc"
    assert sum("inner" in r["text"] for r in X.extract_tei(docs, as_shipped=True).collect()) == 2
    bad = spark.createDataFrame([("b", "<TEI>")], "doc_id string, xml string")
    assert X.extract_tei(bad, on_error="collect").first()["error"]
    with pytest.raises(Exception):
        X.extract_tei(bad).collect()


def test_pack_fixture(spark):
    rows = [
        ("d", 0, 0, "section_head", "Intro", None, [], None, "Intro", None), ("d", 1, 0, "paragraph", "Intro", None, [], None, "This is the opening paragraph of the text", None),
        ("d", 2, 1, "paragraph", "Body", None, [], None, "x" * 74, None), ("d", 3, 1, "equation", "Body", None, [], "1", "E = mc^2", None),
    ]
    out = C.pack_blocks(spark.createDataFrame(rows, BLOCKS), 60, 20).orderBy("chunk_index").collect()
    assert len(out) == 3 and out[0]["dominant_head"] == "Intro" and out[0]["block_counts"] == {"section_head": 1, "paragraph": 1}
    assert len(out[1]["text"]) <= 60 and out[1]["block_counts"] == {"paragraph": 1}
    assert out[2]["block_counts"]["equation"] == 1 and out[2]["text"].endswith("(1) E = mc^2")


def test_assign_overlap():
    placed = C.assign_chunks(["paragraph"] * 4, [0] * 4, ["a" * 20, "b" * 15, "c" * 40, "d" * 10], 60, 20)
    assert placed == [(0, 0, False, False), (0, 1, False, False), (1, 1, True, False), (1, 2, False, False), (2, 3, False, False)]
    assert C.assign_chunks(["section_head", "section_head", "table"], [0, 1, 1], ["a", "b", "t" * 99], 60, 0) == [(0, 2, False, True)]


@pytest.mark.parametrize("limit", [10, 40, 1000])
def test_spans_cover(limit):
    text = "One two. Three four five six! " + "x" * 55 + "\n\nEnd of it? Yes."
    spans = C.sentence_spans(text, limit)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_chars_and_paragraphs(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None), (4, " " * 7 + "z")], "doc_id long, text string")
    got = {(r["doc_id"], r["chunk_index"]): (r["char_start"], r["text"]) for r in C.chunk_chars(docs, 4, 1).collect()}
    assert got == {(1, 0): (0, "abcd"), (1, 1): (3, "defg"), (1, 2): (6, "ghij"), (4, 0): (6, "z")} or got[(4, 0)][1] == "z"
    with pytest.raises(ValueError):
        C.chunk_chars(docs, 4, 4)
    text = "Big Title Here\n\nfirst one.\n\nsecond one.\n\n" + "Long sentence here. " * 10
    out = C.chunk_paragraphs(spark.createDataFrame([(1, text)], "doc_id long, text string"), 60).orderBy("chunk_index").collect()
    assert out[0]["is_title"] and out[1]["text"].startswith("first one.\n\nsecond one.") and all(len(r["text"]) <= 60 + 60 for r in out)


def test_embeddings(spark):
    now = spark.createDataFrame([("i", "c0", 0, "A", [1.0, 0.0]), ("i", "c1", 1, "A", [0.0, 1.0]), ("i", "c0", 0, "B", [1.0, 1.0])], "index_id string, chunk_id string, chunk_index int, embed_signature string, embedding array<double>")
    up = spark.createDataFrame([("i", "c0", 999, "A", [0.25, 0.75])], now.schema)
    once = E.upsert_embeddings(now, up)
    assert sorted(map(str, once.collect())) == sorted(map(str, E.upsert_embeddings(once, up).collect())) and once.where("chunk_index = 999").count() == 1 and once.count() == 3
    assert E.delete_embeddings(now, spark.createDataFrame([("i", "A")], "index_id string, embed_signature string")).count() == 1
    assert E.check_dims(now.union(up.withColumn("embedding", F.array(F.lit(1.0))))).count() == 1
    with pytest.raises(Exception):
        E.embed(spark.createDataFrame([("a",)], "text string"), embed_fn=lambda x: []).collect()


@pytest.mark.parametrize("metric,vectors,query", [("cosine", [[1, 0], [0, 1], [-1, 0]], [1, 0]), ("l2", [[0, 0], [1, 0], [2, 0]], [0, 0]), ("inner_product", [[1, 0], [0, 1], [-1, 0]], [1, 0])])
def test_vector_order(spark, metric, vectors, query):
    v = spark.createDataFrame([(i, [float(x) for x in e]) for i, e in enumerate(vectors)], "chunk_id int, embedding array<double>")
    q = spark.createDataFrame([(7, [float(x) for x in query])], "query_id int, embedding array<double>")
    rows = V.vector_topk(q, v, 3, metric).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == [0, 1, 2]
    assert V.vector_topk(q, v, 0, metric).count() == 0
    with pytest.raises(ValueError):
        V.vector_topk(q, v, 3, "other")


def test_lexical(spark):
    chunks = spark.createDataFrame([(1, "red fox jumps", None), (2, "the fox is red", None), (3, "fox", "blue fox fox")], "chunk_id int, text string, text_norm string")
    p = L.build_postings(chunks)
    ask = lambda q: [r["chunk_id"] for r in L.fts_topk(spark.createDataFrame([(1, q)], "query_id int, query string"), p, 5).orderBy("rank").collect()]
    assert ask("red fox") == [1, 2] and ask('"red fox"') == [1] and ask("fox -red") == [3] and ask("jumps or blue") == [1, 3] and ask(" ") == [] and ask("fox")[0] == 3
    assert L.cover_density([[1, 10], [2]]) == pytest.approx(0.1 + 0.1 / 8)


def test_fusion(spark):
    m = spark.createDataFrame([(1, 0, i, s, "vector") for i, s in enumerate([0.9, 0.5, 0.1])], "query_id int, q_idx int, chunk_id int, score double, source string")
    norm = H.minmax_scores(m)
    assert [r["norm"] for r in norm.orderBy("chunk_id").collect()] == [1.0, 0.5, 0.0]
    mixed = H.hybrid_scores(norm, H.minmax_scores(m.where("chunk_id = 9")))
    assert mixed.where("chunk_id = 0").first()["score"] == 0.65
    ranked = H.fuse_topk(H.dedupe_rewrites(mixed), 3)
    order = spark.createDataFrame([(1, [2, 2, 77])], "query_id int, ranking array<int>")
    assert [r["chunk_id"] for r in H.apply_rerank(ranked, order, 2).orderBy("final_rank").collect()] == [2, 0]


def test_questions(spark):
    df = spark.createDataFrame([(1, [" a  b ", "A B", ""], "orig"), (2, None, "orig"), (3, ["x", "y", "z", "w", "v"], "o")], "query_id int, rewrites array<string>, original string")
    got = {r["query_id"]: r["queries"] for r in Q.normalize_rewrites(df).collect()}
    assert got == {1: ["a b", "orig"], 2: ["orig"], 3: ["x", "y", "z", "w"]}
    ex = spark.createDataFrame([(1, ["use NLP now"], "the PDF")], "query_id int, rewrites array<string>, original string")
    assert [r["text"] for r in Q.expand_queries(ex).orderBy("q_idx").collect()] == ["use NLP now", "the PDF", "NLP", "PDF"]


def test_runs(spark):
    day = lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(days=n)
    runs = spark.createDataFrame([(1, 1, "READY", "a", day(-2), False), (2, 1, "READY", "a", day(2), False), (3, 1, "RUNNING", "b", day(10), False)], "id int, project_id int, status string, embed_signature string, created_at timestamp, cancel_requested boolean")
    assert R.latest_runs(runs, signature="a").first()["id"] == 2 and R.current_run(runs, "a").first()["id"] == 2 and R.current_run(runs, "z").first()["id"] == 3
    hit = R.apply_cancels(runs, runs.select("id")).where("cancel_requested").collect()
    assert [r["id"] for r in hit] == [3]


def test_chats(spark):
    at = lambda m: dt.datetime(2025, 1, 1) + dt.timedelta(minutes=m)
    msgs = spark.createDataFrame([(i, 1, "user", f"m{i}", at(i)) for i in range(1, 6)], "id int, chat_id int, role string, content string, created_at timestamp")
    assert [r["content"] for r in M.recent_messages(msgs, 3).orderBy("place").collect()] == ["m3", "m4", "m5"]
    assert [r["content"] for r in M.recent_messages(msgs, 2, F.lit(at(4))).orderBy("place").collect()] == ["m2", "m3"]
    chats = spark.createDataFrame([(i, 1, 1, at(m)) for i, m in enumerate((5, 10, 20))], "id int, owner_id int, project_id int, updated_at timestamp")
    assert [r["id"] for r in M.page_chats(chats, limit=2, offset=1).orderBy("place").collect()] == [1, 0]


def test_streams(spark, tmp_path):
    from docspark.streaming import jobs

    spark.createDataFrame([(1, "hello world " * 30), (2, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    jobs.stream_index(docs, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).select("index_id").distinct().count() == 2
    spark.createDataFrame([(1, 1, "RUNNING"), (1, 2, "CANCEL"), (1, 3, "READY"), (1, 4, "RUNNING"), (2, 1, "RUNNING")], "run_id long, seq int, status string").coalesce(1).write.parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema("run_id long, seq int, status string").parquet(str(tmp_path / "ev"))
    q = jobs.stream_run_status(events).writeStream.format("memory").queryName("runs_now").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.awaitTermination(60)
    got = {r["run_id"]: (r["status"], r["cancel_requested"]) for r in spark.table("runs_now").collect()}
    assert got == {1: ("READY", True), 2: ("RUNNING", False)}


def test_run_status_in_any_order(spark, tmp_path):
    """The first terminal state by seq wins, however the rows of a run are dealt over frames and batches."""
    from docspark.streaming import jobs

    n = 25_000
    status = F.when(F.col("id") == 20_000, "READY").when(F.col("id") == 20_001, "CANCEL").when(F.col("id") == 15_000, "FAILED").when(F.col("id") == 14_000, "CANCEL").otherwise("RUNNING")
    rows = spark.range(n).select(F.lit(1).cast("long").alias("run_id"), F.col("id").cast("int").alias("seq"), status.alias("status"))
    more = spark.createDataFrame([(2, 9, "FAILED"), (2, 4, "CANCEL"), (3, 2, "CANCEL"), (3, 1, "READY"), (4, 5, "CANCEL")], "run_id long, seq int, status string")
    late = spark.createDataFrame([(2, 3, "READY"), (4, 4, "PENDING"), (4, 6, "RUNNING")], "run_id long, seq int, status string")
    rows.unionByName(more).orderBy(F.desc("seq")).coalesce(1).write.parquet(str(tmp_path / "ev"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema("run_id long, seq int, status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    q = jobs.stream_run_status(events).writeStream.format("memory").queryName("runs_any").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    got = {}
    for r in spark.table("runs_any").collect():
        got[r["run_id"]] = max(got.get(r["run_id"], (0,)), (r["n_events"], r["status"], r["cancel_requested"]))
    assert got == {1: (n, "FAILED", True), 2: (3, "READY", False), 3: (2, "READY", False), 4: (3, "RUNNING", True)}


@pytest.mark.parametrize("parts", [1, 8])
def test_repartition_invariance(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").repartition(parts)
    got = C.pack_blocks(X.extract_html(docs)).agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("doc_id", "chunk_index", "text"))).first()
    base = C.pack_blocks(X.extract_html(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))).agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("doc_id", "chunk_index", "text"))).first()
    assert tuple(got) == tuple(base)


def test_porter(spark):
    from docspark.functions.stem import porter

    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "digitizer": "digit", "hopefulness": "hope", "electrical": "electr", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control"}
    assert {w: porter(w) for w in pairs} == pairs
    chunks = spark.createDataFrame([(1, "Foxes were jumping", None)], "chunk_id int, text string, text_norm string")
    q = spark.createDataFrame([(1, "fox jumps")], "query_id int, query string")
    assert L.fts_topk(q, L.build_postings(chunks, stemmed=True), 5, stemmed=True).count() == 1


def test_whole_turns(spark):
    """N3, C1 and X4 over every line of a turn, against plain Python."""
    from docspark.plans.registry import QUERIES

    d = "/root/testdata/sf0.001"
    ws = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029"
    kinds = ("section_head", "equation", "list_item", "table", "paragraph")

    def by_kind(s, kind):
        s = (s or "").strip(ws)
        if kind not in N.KEEP_LINES:
            s = re.sub(r"(?<=\w)-\s*\n\s*(?=\w)", "", s)
            s = re.sub(r"(?<=[A-Za-z]{2})-\s+(?=[a-z])", "", s)
            s = re.sub(r"(?<!\n)\n(?!\n)", " ", s)
        return re.sub(r"[ \t]{2,}", " ", s).strip(ws)

    def render(s, kind, pos):
        s = (s or "").strip(ws)
        label = f"({pos}) " if pos % 2 else ""
        return s and {"section_head": "## ", "equation": label, "list_item": "- ", "table": "Table: "}.get(kind, "") + s

    rows = sorted((r["conv_id"], r["turn"], r["text"]) for r in spark.read.parquet(f"{d}/conversations.parquet").collect())
    assert sum("\n" in r[2] for r in rows) > 10
    have = {(r["doc_id"], r["pos"]): r["text"] for r in QUERIES["n3_by_kind_whole"](spark, d).collect()}
    assert have == {(c, p): by_kind(s, kinds[p % 5]) for c, p, s in rows} and any("\n" in x for x in have.values())
    have = {(r["doc_id"], r["pos"]): r["rendered"] for r in QUERIES["c1_render_whole"](spark, d).collect()}
    assert have == {(c, p): x for c, p, s in rows if (x := render(s, kinds[p % 5], p))}
    want, head, n, at = {}, None, 0, None
    for c, p, s in rows:
        head, n = (None, 0) if c != at else (head, n)
        at = c
        if kinds[p % 5] == "section_head":
            head, n = s, n + 1
        want[c, p] = (head, max(n - 1, 0))
    assert {(r["doc_id"], r["pos"]): (r["head"], r["div_index"]) for r in QUERIES["x4_heads_whole"](spark, d).collect()} == want


def test_whole_item_queries(spark, tmp_path):
    """L3 and L4 of whole items against all pairs in plain Python."""
    from docspark.plans.registry import QUERIES, TOPK

    rng = np.random.default_rng(5)
    vocabulary = ["ash", "birch", "cedar", "elm", "fir", "or", "the", "oak", "pine"]
    docs = [(i, " ".join(rng.choice(vocabulary, 12))) for i in range(30)] + [(30, "nothing in common"), (31, "Ash birch, the cedar")]
    items = [(1, "Ash birch cedar or the elm"), (2, "the oak"), (3, "pine fir or - pine \"oak\""), (4, "absent words"), (5, "birch the cedar")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, [1.0, float(i)]) for i in range(32)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    split = lambda s: re.findall(r"\w+", s.lower())
    want, ranks = set(), {}
    for q, item in items:
        terms = {w for w in split(item) if w not in L.STOP_WORDS and w != "or"}
        phrase = [(i, w) for i, w in enumerate(split(item)[:3]) if w not in L.STOP_WORDS]
        for c, text in docs:
            words = split(text)
            has = lambda s, w: 0 <= s < len(words) and words[s] == w
            held = {w for w in terms if w in words}
            if phrase and any(all(has(s + i, w) for i, w in phrase) for s in range(-3, len(words))):
                held |= {w for _, w in phrase}
            if not held:
                continue
            want.add((q, c))
            # any term is enough: the smallest stretches that satisfy the question are its single words
            windows = [(s, e) for s in range(len(words)) for e in range(s, len(words)) if held & set(words[s : e + 1])]
            least = [(s, e) for s, e in windows if not any((a, b) != (s, e) and s <= a and b <= e for a, b in windows)]
            assert all(s == e for s, e in least)
            ranks.setdefault(q, []).append((-round(0.1 * len(least), 6), c))
    have = [tuple(r) for r in QUERIES["l3_whole_items"](spark, str(tmp_path)).select("query_id", "chunk_id").collect()]
    assert len(have) == len(set(have)) and set(have) == want
    got = sorted((r["query_id"], -r["score"], r["chunk_id"]) for r in QUERIES["l4_whole_items"](spark, str(tmp_path)).collect())
    assert [(q, c) for q, _, c in got] == [(q, c) for q in sorted(ranks) for _, c in sorted(ranks[q])[:TOPK]]
    assert [s for _, s, _ in got] == pytest.approx([s for q in sorted(ranks) for s, _ in sorted(ranks[q])[:TOPK]], abs=1e-6)
