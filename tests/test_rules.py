"""Rules of chunking, search and bookkeeping against plain Python, and costs that must stay linear."""

import datetime as dt
import os
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docspark.functions import normalize as N
from docspark.operators import blocks as X
from docspark.operators import chats as M
from docspark.operators import chunking as C
from docspark.operators import embedding as E
from docspark.operators import fusion as H
from docspark.operators import lexical as L
from docspark.operators import runs as R
from docspark.operators import vector as V
from docspark.sources import tables as S

WS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　"


def column(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("x"))
    return [r["x"] for r in df.orderBy("i").collect()]


# --- normalisers -------------------------------------------------------------------------------------


def random_texts(n, alphabet, size, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(alphabet), int(rng.integers(0, size)))) for _ in range(n)]


def test_strip_and_prose(spark):
    texts = random_texts(3000, "ab-\n \t \x1c.Bé", 14, 1) + ["-\n" * 5 + "a", "ab-\n\n \n c", "a-\nb", "ab- \n c", "ab-  cd", "a-  cd"]
    assert column(spark, texts, N.strip) == [t.strip(WS) for t in texts]

    def prose(t):
        out, i = "", 0
        t = t.strip(WS)
        word = lambda c: c.isalnum() or c == "_"
        while i < len(t):  # a hyphen behind a word character, white space with a line end, a word character
            j = i + 1
            while t[i] == "-" and j < len(t) and t[j] in WS:
                j += 1
            if t[i] == "-" and i and word(t[i - 1]) and "\n" in t[i + 1 : j] and j < len(t) and word(t[j]):
                i = j
                continue
            out += t[i]
            i += 1
        t, out, i = out, "", 0
        while i < len(t):  # a hyphen behind two ASCII letters, white space, a small letter
            j = i + 1
            while t[i] == "-" and j < len(t) and t[j] in WS:
                j += 1
            if t[i] == "-" and i > 1 and re.fullmatch("[A-Za-z]{2}", t[i - 2 : i]) and j > i + 1 and j < len(t) and "a" <= t[j] <= "z":
                i = j
                continue
            out += t[i]
            i += 1
        t = "".join(" " if c == "\n" and t[k - 1 : k] != "\n" and t[k + 1 : k + 2] != "\n" else c for k, c in enumerate(out))
        return re.sub("[ \t]{2,}", " ", t).strip(WS)

    assert column(spark, texts, N.normalize_prose) == [prose(t) for t in texts]


def inline_titles(text):
    """N5 word by word."""
    gaps, words = re.split(r"\S+", text), text.split()
    if len(gaps) != len(words) + 1:
        return text
    capital = lambda w: re.fullmatch("[A-Z][a-z]+", w) is not None
    for i in range(1, len(words)):
        if words[i] not in N.ARTICLES or not re.search("""[.!?]["']?$""", words[i - 1]):
            continue
        for k in range(min(N.TITLE_WORDS[1], len(words) - i - 3), N.TITLE_WORDS[0] - 1, -1):
            if all(capital(w) or w in N.SMALL_WORDS for w in words[i + 1 : i + k + 1]) and capital(words[i + k + 1]) and re.match("[a-z]", words[i + k + 2]):
                title = words[i] + "".join(gaps[j] + words[j] for j in range(i + 1, i + k + 1))
                if len(title) <= N.TITLE_CHARS:
                    gaps[i] += "\n\n"
                    gaps[i + k + 1], gaps[i + k + 2] = "\n\n", " "
                break
    return "".join(g + w for g, w in zip(gaps, [*words, ""]))


def test_inline_titles(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["The", "A", "An", "Origin", "Of", "of", "the", "and", "in", "Species", "Darwin", "went", "home.", "so!", "Done.'", 'on?"', "x", "Längere", "Abcdefghijklmnopqrstuvwxyzabcdefghij", "B,"]
    texts = ["".join(w + str(rng.choice([" ", "  ", "\n", " "])) for w in rng.choice(vocabulary, int(rng.integers(0, 30)))) for _ in range(3000)]
    texts += ["Start here. The Origin of Species Darwin went on. The Way in the Old World Home was. A tail", "", " ", "x. The Origin of Species Darwin", None]
    want = [None if t is None else inline_titles(t) for t in texts]
    assert sum(a != b for a, b in zip(texts, want)) > 50
    assert column(spark, texts, N.split_inline_titles) == want


def test_spans_of_one_long_text(spark):
    text = "  " + " ".join(f"Sentence {i} of one long text." for i in range(60_000)) + "\n"
    began = time.time()
    rows = C.split_sentences(spark.createDataFrame([(1, text), (2, None), (3, " ")], "doc_id int, text string"), 600).drop("text").collect()
    assert time.time() - began < 20
    assert {r["doc_id"] for r in rows} == {1} and all(r["piece"] == text.strip()[r["start"] : r["end"]].strip() and len(r["piece"]) <= 600 for r in rows)
    assert [r["start"] for r in rows[1:]] == [r["end"] for r in rows[:-1]] and rows[0]["start"] == 0 and rows[-1]["end"] == len(text.strip())


def test_linear_cost(spark):
    """A million spaces inside a text, and a hundred thousand paragraphs, in seconds."""
    spaces = "a" + " " * 1_000_000 + "b"
    paragraphs = "\n\n".join(f"p{i}" for i in range(100_000))
    df = spark.createDataFrame([(1, spaces), (2, paragraphs)], "doc_id long, text string").persist()
    df.count()
    began = time.time()
    for f in (N.strip, N.normalize_prose, N.normalize_paragraphs, lambda c: N.clip_text(c, 10), N.split_inline_titles):
        df.select(F.length(f(F.col("text")))).collect()
    out = C.split_paragraphs(df.where("doc_id = 2"))
    last = out.orderBy(F.desc("para_index")).first()
    assert out.count() == 100_000 and last["text"] == "p99999" == paragraphs[last["char_start"] : last["char_end"]]
    assert C.chunk_paragraphs(df.where("doc_id = 2")).count() > 500
    assert time.time() - began < 60


# --- chunking ------------------------------------------------------------------------------------------


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab. !\n?X", max_size=120), st.integers(1, 30))
def test_spans_never_exceed_the_limit(text, limit):
    text = text.strip()
    spans = C.sentence_spans(text, limit)
    assert all(0 < b - a <= limit for a, b in spans) or not text
    assert [a for a, _ in spans] == [0, *[b for _, b in spans]][: len(spans)] and (not text or spans[-1][1] == len(text))
    # a sentence that fits is cut only by what precedes it in a span of its own
    for start, end in C.sentences(text):
        inside = [b for _, b in spans if start < b < end]
        assert not inside or end - start > limit or any(not text[a:start].strip() and a < start for a, b in spans if a < end <= a + limit or b in inside)


def test_spans_of_known_texts():
    assert C.sentence_spans("A word. " + "x" * 100 + ".", 20) == [(0, 8), (8, 28), (28, 48), (48, 68), (68, 88), (88, 108), (108, 109)]
    assert C.sentence_spans("One two. Three. Four five six.", 16) == [(0, 16), (16, 30)]
    assert C.sentence_spans("Short.", 10) == [(0, 6)]


def pieces_by_hand(text, limit):
    """C9 from its rule."""
    text = text.strip()
    if len(text) <= limit:
        return [text] if text else []
    parts, at = [], 0
    for i in range(1, len(text)):
        if text[i].isspace() and text[i - 1] in ".!?":
            j = i
            while j < len(text) and text[j].isspace():
                j += 1
            if j < len(text) and "A" <= text[j] <= "Z":
                parts.append(text[at:i])
                at = j
    parts.append(text[at:])
    lines = []
    for p in (x.strip() for x in parts):
        if lines and len(lines[-1]) + len(p) < limit:
            lines[-1] += " " + p
        else:
            lines.append(p)
    return [x for p in lines for k in range(0, len(p), limit) if (x := p[k : k + limit].strip())]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abX. !\n", max_size=150), st.integers(3, 40))
def test_long_paragraphs(text, limit):
    assert C.long_pieces(text, limit) == pieces_by_hand(text, limit)


def test_paragraph_chunks_by_hand(spark):
    rng = np.random.default_rng(3)
    words = ["alpha", "Beta", "gamma.", "Delta!", "of", "\n\n", "\n\n", "\n", "Title", "epsilon"]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 80)))) for _ in range(60)] + ["", None]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")  # ids repeat
    clean = column(spark, texts, lambda c: N.strip(N.split_inline_titles(N.normalize_paragraphs(c))))
    want = []
    for i, t in enumerate(clean):
        chunks, held = [], []
        for p in (x.strip() for x in t.split("\n\n")):
            lines = [x for x in (y.strip() for y in p.split("\n")) if x]
            ws = lines[0].split() if len(lines) == 1 else []
            lettered = [w for w in ws if any(c.isalpha() for c in w)]
            if len(ws) > 1 and lettered and len(lines[0]) <= 80 and lines[0][-1] not in ".!?:;," and sum(w[0].isupper() for w in lettered) >= 0.6 * len(lettered) and len(p) <= 60:
                chunks += ["\n\n".join(held)] if held else []
                chunks.append(p)
                held = []
                continue
            for piece in pieces_by_hand(p, 60):
                if held and sum(map(len, held)) + 2 * len(held) + len(piece) > 60:
                    chunks.append("\n\n".join(held))
                    held = held[-1:]
                held.append(piece)
        chunks += ["\n\n".join(held)] if held else []
        want += [(i // 2, k, c) for k, c in enumerate(chunks)]
    got = [(r["doc_id"], r["chunk_index"], r["text"]) for r in C.chunk_paragraphs(docs, 60, 1).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100
    plan = C.chunk_paragraphs(docs)._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_block_packing_by_hand(spark):
    """C3 to C6 over random blocks: texts, limits, heads, counts and flags."""
    rng = np.random.default_rng(4)
    kinds = ["section_head", "paragraph", "paragraph", "equation", "table", "reference"]
    rows = []
    for d in range(20):
        for p in range(int(rng.integers(0, 25))):
            kind = str(rng.choice(kinds))
            text = " ".join("w" * int(rng.integers(1, 9)) + ("." if rng.random() < 0.3 else "") for _ in range(int(rng.integers(0, 16 if kind != "section_head" else 4))))
            rows.append((d, p, int(p // 6), kind, f"h{p // 6}" if p % 3 else " ", None, text))
    blocks = spark.createDataFrame(rows, "doc_id long, pos int, div_index int, kind string, head string, equation_label string, text string")
    pieces = {}
    for r in C.split_oversize(blocks, 50).collect():
        pieces.setdefault((r["doc_id"], r["pos"]), []).append(r)
        if r["split_index"] is not None:
            assert len(r["text"]) <= 50 and r["char_end"] - r["char_start"] <= 50 and r["kind"] in C.SPLITTABLE
    for d, p, _, kind, _, _, text in rows:
        found = sorted(pieces[d, p], key=lambda r: r["split_index"] or 0)
        assert re.sub(r"\s", "", "".join(r["text"] for r in found)) == re.sub(r"\s", "", text) and len(found) == (found[0]["split_count"] or 1)
    out = C.pack_blocks(blocks, 50, 15).orderBy("doc_id", "chunk_index").collect()
    seen = {}
    for r in out:
        assert r["chunk_char_len"] == len(r["text"]) and (len(r["text"]) <= 50 or r["oversize"]) and set(r["block_counts"]) - {"section_head"}
        seen.setdefault(r["doc_id"], []).append(r)
    total = sum(sum(r["block_counts"].values()) for r in out)
    kept = sum(1 for r in C.split_oversize(blocks.where("text <> ''"), 50).collect() if r["kind"] != "section_head")
    assert kept <= total <= kept + sum(k == "section_head" for _, _, _, k, *_ in rows)
    for chunks in seen.values():
        assert [r["chunk_index"] for r in chunks] == list(range(len(chunks)))
        for a, b in zip(chunks, chunks[1:]):  # what overlaps ends one chunk and opens the next, in one division
            if b["has_overlap"]:
                first = b["text"].split("\n\n")[0]
                assert a["text"].endswith(first) or first in a["text"].split("\n\n")
                assert a["div_index"] == b["div_index"]
    assert any(r["has_overlap"] for r in out) and any(r["oversize"] for r in out)


def random_blocks(n_docs, n_blocks, seed):
    rng = np.random.default_rng(seed)
    kinds = ["paragraph", "section_head", "table", "list_item", "equation", "footnote"]
    rows = []
    for d in range(n_docs):
        div = None
        for p in range(int(rng.integers(0, n_blocks))):
            if rng.random() < 0.2:
                div = int(rng.integers(0, 4)) if rng.random() < 0.8 else None
            kind = str(rng.choice(kinds, p=[0.5, 0.12, 0.1, 0.14, 0.07, 0.07]))
            text = " ".join("word." if rng.random() < 0.3 else "ab" for _ in range(int(rng.integers(0, 30)))) if rng.random() < 0.95 else None
            rows.append((None if d == 0 else d, 3 * p, kind, div, f"h{div}", text))
    return rows


BLOCK_ROWS = "doc_id int, pos int, kind string, div_index int, head string, text string"


@pytest.mark.parametrize(("tile", "as_shipped"), [(1, False), (7, True)])
def test_packing_in_parts_equals_the_fold(spark, monkeypatch, tile, as_shipped):
    blocks = spark.createDataFrame(random_blocks(10, 80, tile), BLOCK_ROWS)
    rows = lambda: sorted((str(r["doc_id"]), r["chunk_index"], r["text"], r["text_norm"], r["div_index"], r["dominant_head"], r["has_overlap"], r["oversize"], r["chunk_char_len"], sorted(r["block_counts"].items())) for r in C.pack_blocks(blocks, 60, 20, as_shipped).collect())
    whole = rows()
    monkeypatch.setattr(C, "LONG_BLOCKS", 30)  # some documents are long, some are not
    monkeypatch.setattr(C, "TILE", tile)
    monkeypatch.setattr(C, "RUNS", 3)
    assert rows() == whole and len(whole) > 100
    assert C.pack_blocks(blocks.where("false")).count() == 0


def test_packing_pages_in_parts(spark, monkeypatch):
    blocks = X.extract_html(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    rows = lambda: sorted(map(str, C.pack_blocks(blocks).collect()))
    whole = rows()
    monkeypatch.setattr(C, "LONG_BLOCKS", 0)
    monkeypatch.setattr(C, "TILE", 5)
    monkeypatch.setattr(C, "RUNS", 1)
    assert rows() == whole


def test_a_long_document_is_many_groups(spark):
    """30,000 blocks of one document, a heading before each tenth: packed by run, numbered through."""
    n = 30_000
    blocks = spark.range(n).selectExpr("1 AS doc_id", "cast(id AS int) AS pos", "if(id % 10 = 0, 'section_head', 'paragraph') AS kind", "cast(id div 10 AS int) AS div_index", "'h' AS head", "concat('text of ', id) AS text")
    out = C.pack_blocks(blocks, 1200, 200)
    told = out.agg(F.count(F.lit(1)).alias("n"), F.min("chunk_index").alias("a"), F.max("chunk_index").alias("b"), F.count_distinct("chunk_index").alias("d"), F.max(F.col("chunk_index") != F.col("div_index")).alias("moved")).first()
    assert tuple(told) == (n // 10, 0, n // 10 - 1, n // 10, False)
    runs = C._runs(C.split_oversize(blocks, 1200).selectExpr("doc_id", "pos", "0 AS split", "div_index", "kind", "rendered"), 1200)
    assert runs.groupBy("run").count().agg(F.max("count")).first()[0] == 10 and runs.select("run").distinct().count() == n // 10


def test_html_blocks_by_hand(spark):
    """X1 of all pages with Python's own parser: the same texts, kinds and headings, and no character of the body is lost."""
    from html.parser import HTMLParser

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    extra = spark.createDataFrame([(-1, "<h2>A &lt;b&gt; &amp;lt; &quot;c&quot;</h2><p>x&nbsp;y<br>z</p><p></p>"), (-2, None), (-3, "")], "page_id long, html string")
    edges = "h[1-6]|p|li|ul|nav|div|article|footer|body|html"

    class Blocks(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.rows, self.kind, self.skip, self.shown = [["paragraph", ""]], [], 0, ""

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "head")
            if re.fullmatch(edges, tag):
                if self.kind and self.kind[-1] == "p":
                    self.kind.pop()
                self.kind.append(tag)
                self.begin()
            elif tag == "br":
                self.handle_data(" ")

        def begin(self):
            inner = next((k for k in reversed(self.kind) if re.fullmatch("h[1-6]|li", k)), "")
            self.rows.append(["list_item" if inner == "li" else "section_head" if inner else "paragraph", ""])

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "head")
            if re.fullmatch(edges, tag):
                if tag in self.kind:
                    del self.kind[len(self.kind) - 1 - self.kind[::-1].index(tag) :]
                self.begin()

        def handle_data(self, data):
            if not self.skip:
                self.rows[-1][1] += data
                self.shown += "".join(data.split())

    want, shown = [], 0
    for r in pages.union(extra).collect():
        p = Blocks()
        p.feed(r["html"] or "")
        p.close()
        shown += len(p.shown)
        head, n = None, 0
        for kind, text in ((k, " ".join(t.split())) for k, t in p.rows):
            if text:
                head, n = (text, n + 1) if kind == "section_head" else (head, n)
                want.append((r["page_id"], kind, text, head or "", max(n - 1, 0)))
    rows = X.extract_html(pages.union(extra)).collect()
    assert sorted((r["doc_id"], r["kind"], r["text"], r["head"] or "", r["div_index"]) for r in rows) == sorted(want) and len(want) > 100
    assert sum(len("".join(r["text"].split())) for r in rows) == shown > 10_000
    for doc in {r["doc_id"] for r in rows}:
        assert sorted(r["pos"] for r in rows if r["doc_id"] == doc) == list(range(sum(r["doc_id"] == doc for r in rows)))


# Fixed inputs: pages with their blocks as (kind, text).
PAGES = {
    "<P CLASS=x>One<p>two<DIV>three</DIV>four": [("paragraph", "One"), ("paragraph", "two"), ("paragraph", "three"), ("paragraph", "four")],
    "<pre>\n a  b\n c </pre><blockquote>q <b>bo</b>ld</blockquote>": [("code", "a  b\n c"), ("paragraph", "q bold")],
    "&eacute;&#233;&#xE9; &copy; &amp;lt; &unknown; a & b &lt": [("paragraph", "ééé © &lt; &unknown; a & b <")],
    "<ul><li>a<li>b <p>c</p>d<ul><li>e</ul>f</ul>g": [("list_item", "a"), ("list_item", "b"), ("list_item", "c"), ("list_item", "d"), ("list_item", "e"), ("list_item", "f"), ("paragraph", "g")],
    "<table><caption>T</caption><tr><td>1<td><p>2</p><h3>3</h3><tr><th>4<table><tr><td>in</table>5</table>x": [("table", "T 1 2 3 4 in 5"), ("paragraph", "x")],
    "<td>loose</td> cell": [("paragraph", "loose"), ("paragraph", "cell")],
    "<head><title>T</title><meta charset=x><p>shown": [("paragraph", "shown")],
    "<title>t</title><head>x": [("paragraph", "x")],
    "<script>if (a</b) '</p>' </script>a<style>p</style><!-- <p>no --> b<!DOCTYPE x><?php ?>c<template><p>no</p></template>d": [("paragraph", "a bcd")],
    "<script>never closed <p>x": [],
    "a<!-- never closed <p>x": [("paragraph", "a")],
    "<h1>H<h2>I</h2>t<textarea><b>raw &amp;</textarea><xmp><i></xmp>": [("section_head", "H"), ("section_head", "I"), ("paragraph", "t<b>raw &<i>")],
    "1 < 2 <3 a<b>c</b >d</>e</ f>g<": [("paragraph", "1 < 2 <3 acdeg<")],
    "<figure><img alt='>'><figcaption>cap<div>tion</div></figcaption></figure><select><option>o<option>p</select>": [("figure_caption", "cap"), ("figure_caption", "tion"), ("paragraph", "o"), ("paragraph", "p")],
    "<p title=\"a>b\" id='c'>t<p title=\"open>u": [("paragraph", "t"), ("paragraph", "u")],
    "a<hr>b<br>c<dl><dt>d<dd>e</dl>": [("paragraph", "a"), ("paragraph", "b c"), ("paragraph", "d"), ("paragraph", "e")],
    "<li><h2>x</h2>y</li></div></table>z": [("section_head", "x"), ("list_item", "y"), ("paragraph", "z")],
}


def test_html_pages():
    from docspark.operators.html import page_blocks

    for source, want in PAGES.items():
        assert [(kind, text) for _, kind, _, text, _, _ in page_blocks(source)] == want, source
    linked = page_blocks('<a HREF=x>1</a><a href="?a=1&amp;b=2"><p>2 <a href=\'z\'>3</a></a><link href=no><base href=n>')
    assert [(text, links) for _, _, links, text, _, _ in linked] == [("1", ["x", "?a=1&b=2"]), ("2 3", ["z"])]  # the second link begins behind the first block's text
    assert page_blocks(None) == page_blocks("") == []


@pytest.mark.parametrize("part", ["<div>", "<p title=\"", "<", "<a href='", "</p>", "<table><tr><td>", "<ul><li>", "<!--", "<b>x", "&", "<h1>", "<script>", "<pre>", "</div", "<!", "</ "])
def test_html_is_linear(part):
    from docspark.operators.html import page_blocks

    def took(n):
        began = time.process_time()
        page_blocks(part * n + "x")
        return time.process_time() - began

    took(1000)
    assert min(took(80_000) for _ in range(2)) < 3.0


# --- search ----------------------------------------------------------------------------------------------


def test_covers_by_hand():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    rows = []
    for _ in range(300):
        n, places = int(rng.integers(1, 5)), rng.permutation(40)
        cuts = np.sort(rng.choice(np.arange(1, 20), n, replace=False))
        rows.append([sorted(places[a:b].tolist()) for a, b in zip([0, *cuts[:-1]], cuts)])
    got = L.cover_scores(pa.array(rows, pa.list_(pa.list_(pa.int32()))))
    for lists, score in zip(rows, got):
        spots = sorted(p for x in lists for p in x)
        windows = [(s, e) for s in spots for e in spots if s <= e and all(any(s <= p <= e for p in x) for x in lists)]
        least = [(s, e) for s, e in windows if not any((a, b) != (s, e) and s <= a and b <= e for a, b in windows)]
        assert score == pytest.approx(sum(0.1 / (1 + max(0, e - s + 1 - len(lists))) for s, e in least))
    assert L.cover_density([]) == L.cover_density([[1], []]) == 0 and len(L.cover_scores(pa.array([], pa.list_(pa.list_(pa.int32()))))) == 0


def test_text_scope(spark):
    chunks = spark.createDataFrame([(1, "i", "red fox"), (2, "j", "red fox red"), (3, "j", "a fox"), (4, None, "red")], "chunk_id int, index_id string, text string")
    q = spark.createDataFrame([(1, "i", "red"), (2, "j", "red or fox"), (3, "k", "red"), (4, "j", '"fox red" -blue'), (5, "j", "-red")], "query_id int, index_id string, query string")
    for out in (L.search_text(q, chunks, 5, by=("index_id",)), L.fts_topk(q, L.build_postings(chunks, by=("index_id",)), 5, by=("index_id",))):
        # the last query only forbids: all chunks of its scope without the word
        assert [(r["query_id"], r["chunk_id"]) for r in out.orderBy("query_id", "rank").collect()] == [(1, 1), (2, 2), (2, 3), (4, 2), (5, 3)]
    assert L.search_text(q.drop("index_id"), chunks, 5).where("query_id = 1").count() == 3


def clauses_of(query):
    """A query as clauses of (kind, [(place, term)]), by a plain reading of the syntax."""
    out = [[]]
    for piece in re.findall(r'-?"[^"]*"|\S+', query.lower()):
        if piece == "or":
            out.append([])
            continue
        words = [(i, w) for i, w in enumerate(re.findall(r"[^\W_]+", piece)) if w not in L.STOP_WORDS]
        if not words:
            continue
        if piece.startswith("-"):
            out[-1].append(("forbid", words))
        elif '"' in piece:
            out[-1].append(("hold", words))
        else:
            out[-1] += [("hold", [w]) for w in words]
    return [c for c in out if c]


def brute_search(texts, query):
    """chunk to score, by trying every stretch of places of every chunk."""
    found = {}
    for chunk, text in texts.items():
        words = re.findall(r"[^\W_]+", text.lower())
        spans = lambda parts: [(s, s + parts[-1][0] - parts[0][0]) for s in range(len(words)) if all(s - parts[0][0] + i in range(len(words)) and words[s - parts[0][0] + i] == w for i, w in parts)]  # noqa: B023, E731
        held = [c for c in clauses_of(query) if all(bool(spans(parts)) == (kind == "hold") for kind, parts in c)]
        if not held:
            continue
        asks = [([spans(parts) for kind, parts in c if kind == "hold"], len({w for kind, parts in c if kind == "hold" for _, w in parts})) for c in held]
        inside = lambda s, e: [k for literals, k in asks if literals and all(any(s <= a and b <= e for a, b in lit) for lit in literals)]  # noqa: B023, E731
        good = {(s, e): max(inside(s, e)) for s in range(len(words)) for e in range(s, len(words)) if inside(s, e)}
        least = [x for x in good if not any(y != x and x[0] <= y[0] and y[1] <= x[1] for y in good)]
        found[chunk] = round(sum(0.1 / (1 + max(0, e - s + 1 - good[s, e])) for s, e in least), 6)
    return found


def test_boolean_search(spark):
    """Matches and ranks of generated questions against all stretches of generated texts."""
    rng = np.random.default_rng(12)
    words, odd = ["red", "fox", "blue", "dog", "the", "jumps", "or"], ["", "the", "state-run fox"]
    texts = {i: " ".join(rng.choice(words, int(rng.integers(0, 14)))) for i in range(60)} | {60 + i: t for i, t in enumerate(odd)}
    pieces = ["red", "fox", "blue", "dog", "the", '"red fox"', '"fox the dog"', '"blue blue"', "-red", "-dog", '-"red fox"', '-"fox the red"', "-the", '-"the dog"', "-state-run", "dog-fox", "or", "or", "-"]
    queries = [" ".join(rng.choice(pieces, int(rng.integers(1, 7)))) for _ in range(150)]
    queries += ["", "the", "-red", '-"red fox"', "red -red", "red red fox", 'red "red fox"', "red or red fox", "red fox or red", '"red fox" or fox', "or red", "red or", '"red', "-red or fox -dog", "Red OR Fox"]
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id int, text string")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    rows = L.search_text(asked, chunks, len(texts)).collect()
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], {})[r["chunk_id"]] = r["score"]
    for i, q in enumerate(queries):
        assert got.get(i, {}) == pytest.approx(brute_search(texts, q), abs=2e-6), q
    top = L.search_text(asked, chunks, 3).collect()
    assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in top} == {(r["query_id"], r["chunk_id"], r["rank"]) for r in rows if r["rank"] <= 3}


def test_search_that_was_wrong_before(spark):
    chunks = spark.createDataFrame([(1, "climate policy"), (2, "climate change"), (3, "policy only"), (4, "alpha"), (5, "alpha " + "x " * 60 + "beta"), (6, "change of climate policy")], "chunk_id int, text string")
    asked = spark.createDataFrame([(1, 'policy -"climate change"'), (2, "alpha or beta"), (3, "-climate")], "query_id int, query string")
    got = {}
    for r in L.search_text(asked, chunks, 9).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    twice = L.search_text(spark.createDataFrame([(1, '"climate change"'), (2, "change -\"climate policy\"")], "query_id int, query string"), chunks.union(chunks), 9)
    assert sorted((r["query_id"], r["chunk_id"]) for r in twice.collect()) == [(1, 2), (2, 2)]
    assert sorted(c for c, _ in got[1]) == [1, 3, 6] and got[2] == [(5, 0.2), (4, 0.1)] and got[3] == [(3, 0.0), (4, 0.0), (5, 0.0)]


def test_postings_of_a_row_need_no_exchange(spark):
    chunks = spark.createDataFrame([(1, "Red fox, red", "i"), (2, None, "i"), (3, "", "j"), (4, "the of", "j"), (5, "fox " * 5000 + "dog", None), (5, "fox", "k")], "chunk_id int, text string, index_id string")
    out = L.build_postings(chunks, by=("index_id",))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    rows = [tuple(r) for r in out.collect()]
    assert [r for r in rows if r[0] != 5] == [(1, "i", "red", [1, 3], 2), (1, "i", "fox", [2], 1)]
    assert sorted((r[1] or "", r[2], r[4]) for r in rows if r[0] == 5) == [("", "dog", 1), ("", "fox", 5000), ("k", "fox", 1)]
    only = L.build_postings(chunks, only=spark.createDataFrame([("dog",), ("none",)], "term string")).collect()
    assert [(r["chunk_id"], r["positions"]) for r in only] == [(5, [5001])]


def test_many_terms_are_joined(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_TERMS", 1)
    monkeypatch.setattr(L, "QUERY_BLOCK", 1)
    chunks = spark.createDataFrame([(1, "red fox"), (2, "blue dog")], "chunk_id int, text string")
    asked = spark.createDataFrame([(1, "red fox"), (2, "-red"), (3, "-dog"), (4, "-fox -dog")], "query_id int, query string")
    assert sorted((r["query_id"], r["chunk_id"]) for r in L.search_text(asked, chunks, 9).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_table_of_postings(spark, monkeypatch):
    """Ten terms open their buckets only, and searching the table gives what searching the chunks gives."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    L.write_postings(L.build_postings(docs), "some_postings", 64)
    terms = [r["term"] for r in L.build_postings(docs).groupBy("term").count().orderBy(F.xxhash64("term")).limit(10).collect()]
    asked = spark.createDataFrame(list(enumerate(terms)), "query_id int, query string")
    parsed = L.parse_queries(asked)
    part = L.read_postings(spark, "some_postings", parsed)

    def files(df):
        """Files that the scan opens."""
        parts = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).inputRDD().filePartitions()
        return {f.filePath().toString() for i in range(parts.size()) for f in parts.apply(i).files()}

    assert 1 <= len(files(part)) <= 10 and len(files(spark.table("some_postings"))) > 50
    rows = lambda x: sorted((r["query_id"], r["chunk_id"], r["score"]) for r in x.collect())
    want = rows(L.search_text(asked, docs, 20))
    assert rows(L.fts_topk(asked, part, 20)) == want and len(want) > 10
    monkeypatch.setattr(L, "BUCKET_TERMS", 3)
    more = L.read_postings(spark, "some_postings", parsed)
    assert sorted(map(str, more.collect())) == sorted(map(str, part.collect()))
    spark.sql("DROP TABLE some_postings")


# Words with their stems, from the published description of the algorithm and by its rules.
STEMS = {
    "consigned": "consign", "consignment": "consign", "consistency": "consist", "consistently": "consist", "consolatory": "consolatori", "consolidated": "consolid", "consolingly": "consol",
    "conspicuously": "conspicu", "conspiracy": "conspiraci", "constables": "constabl", "constancy": "constanc", "knackeries": "knackeri", "knaves": "knave", "kneading": "knead", "knelt": "knelt",
    "knightly": "knight", "knitting": "knit", "knives": "knive", "knockers": "knocker", "knotted": "knot", "generate": "generat", "generally": "general", "communism": "communism", "arsenic": "arsenic",
    "hopping": "hop", "hoping": "hope", "bled": "bled", "luxuriated": "luxuri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "cries": "cri", "ties": "tie", "cry": "cri", "by": "by", "say": "say",
    "news": "news", "skies": "sky", "innings": "inning", "proceed": "proceed", "rational": "ration", "relational": "relat", "happiness": "happi", "youth": "youth", "boyish": "boyish", "geology": "geolog",
    "replacement": "replac", "adoption": "adopt", "formalize": "formal", "nationality": "nation", "dying": "die", "hopefully": "hope", "naïve": "naïve", "b2b": "b2b", "a": "a", "yes": "yes", "sky": "sky",
}


def test_english_stems(spark):
    from docspark.functions.stem import ENGLISH_STOP_WORDS, english, stem

    assert {w: english(w) for w in STEMS} == STEMS and len(set(ENGLISH_STOP_WORDS)) == len(ENGLISH_STOP_WORDS) == 127
    assert column(spark, [*STEMS, None], stem) == [*STEMS.values(), None]
    chunks = spark.createDataFrame([(1, "We were generally hoping"), (2, "hopefully a general hopes")], "chunk_id int, text string")
    asked = spark.createDataFrame([(1, "hope"), (2, '"general hoped"'), (3, "were")], "query_id int, query string")
    assert sorted((r["query_id"], r["chunk_id"]) for r in L.search_text(asked, chunks, 5, stemmed=True).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_stemmed_postings(spark):
    chunks = spark.createDataFrame([(1, "jump jumps jumping over"), (2, "jumped")], "chunk_id int, text string")
    got = {(r["chunk_id"], r["term"]): (r["positions"], r["tf"]) for r in L.build_postings(chunks, stemmed=True).collect()}
    assert got[1, "jump"] == ([1, 2, 3], 3) and got[2, "jump"] == ([1], 1)
    q = spark.createDataFrame([(1, "jumps")], "query_id int, query string")
    assert [r["chunk_id"] for r in L.search_text(q, chunks, 5, stemmed=True).orderBy("rank").collect()] == [1, 2]


@pytest.mark.parametrize("numbers", [4_000_000, 0])
def test_vector_scope(spark, monkeypatch, numbers):
    """Two columns of scope, text ids, ties and null vectors, by either plan."""
    monkeypatch.setattr(V, "BROADCAST_NUMBERS", numbers)
    rng = np.random.default_rng(7)
    rows = [(f"c{i:03d}", str(i % 2), None if i % 31 == 0 else f"s{i % 3}", None if i % 29 == 0 else [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(200)]
    v = spark.createDataFrame(rows, "chunk_id string, index_id string, embed_signature string, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(1, "0", "s1", [1.0, 0.0, 1.0]), (2, "1", "s2", [0.0, 0.0, 0.0]), (3, "7", "s1", [1.0, 1.0, 1.0]), (4, None, "s1", [1.0, 1.0, 1.0])], "query_id int, index_id string, embed_signature string, embedding array<double>")
    for metric in V.METRICS:
        got = [(r["query_id"], r["chunk_id"]) for r in V.vector_topk(q, v, 7, metric, ["index_id", "embed_signature"]).orderBy("query_id", "rank").collect()]
        want = []
        for qid, i, s, e in [tuple(r) for r in q.collect()]:
            scores = []
            for c, ci, cs, ce in rows:
                if ce is None or cs is None or (ci, cs) != (i, s):
                    continue
                a, b = np.array(e), np.array(ce)
                with np.errstate(all="ignore"):
                    x = a @ b if metric == "inner_product" else -np.sqrt(((a - b) ** 2).sum()) if metric == "l2" else a @ b / np.sqrt((a @ a) * (b @ b))
                scores.append((np.inf if np.isnan(x) else -round(float(x), 6), c))
            want += [(qid, c) for _, c in sorted(scores)[:7]]
        assert got == want


# --- bookkeeping -------------------------------------------------------------------------------------------


def test_runs_with_text_ids(spark):
    day = lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(days=n)
    a, b, c, e = "0b1e-aaaa", "7fa0-bbbb", "11aa-cccc", "ffff-dddd"
    runs = spark.createDataFrame(
        [(a, "p", "d", "READY", "s", day(2)), (b, "p", "d", "READY", "s", day(2)), (c, "p", "d", "RUNNING", "t", day(5)), (e, "p", "d", "READY", "s", None)],
        "id string, project_id string, document_id string, status string, embed_signature string, created_at timestamp",
    )
    assert R.latest_runs(runs).first()["id"] == c and R.latest_runs(runs, signature="s").first()["id"] == a
    assert R.current_run(runs, "s").first()["id"] == a and R.current_run(runs, "none").first()["id"] == c
    projects = spark.createDataFrame([("p", "o", "d")], "id string, owner_id string, primary_document_id string")
    asked = spark.createDataFrame([(1, "o", "p", "d", "t"), (2, "o", "p", "d", "s"), (3, "x", "p", "d", "s"), (4, "o", "p", "e", "s")], "request_id int, owner_id string, project_id string, document_id string, embed_signature string")
    got = {r["request_id"]: (r["action"], r["run_id"], r["reason"]) for r in R.plan_runs(asked, projects, runs).collect()}
    assert got == {1: ("reuse", c, None), 2: ("new", None, None), 3: ("rejected", None, "project_not_found"), 4: ("rejected", None, "document_not_found")}


def test_cascade_of_two_children(spark):
    top = spark.createDataFrame([(1,), (2,)], "id int")
    left = spark.createDataFrame([(10, 1, "a"), (11, 2, "b")], "lid int, top int, path string")
    right = spark.createDataFrame([(20, 1, None), (21, 1, "c")], "rid int, top int, path string")
    tables = {"top": (top, "id", None), "left": (left, "lid", "top"), "right": (right, "rid", "top", "top")}
    gone = spark.createDataFrame([(1,)], "id int")
    kept = R.cascade_delete(tables, gone)
    assert [kept[n].count() for n in tables] == [1, 1, 0]
    assert sorted(tuple(r) for r in R.cascade_files(tables, gone, {"left": "path", "right": "path"}).collect()) == [("left", "a"), ("right", "c")]


def test_ownership(spark):
    projects = spark.createDataFrame([("p", "me"), ("q", "you")], "id string, owner_id string")
    at = dt.datetime(2025, 1, 1)
    chats = spark.createDataFrame([("c1", "me", "p", at), ("c2", "me", "q", at), ("c3", "me", "gone", at)], "id string, owner_id string, project_id string, updated_at timestamp")
    msgs = spark.createDataFrame([(i, f"c{i % 3 + 1}", "user", "t", at) for i in range(9)], "id int, chat_id string, role string, content string, created_at timestamp")
    assert [r["id"] for r in M.page_chats(chats, projects=projects, owner="me").collect()] == ["c1"]
    assert {r["chat_id"] for r in M.recent_messages(msgs, 2, chats=chats, projects=projects, owner="you").collect()} == {"c2"}
    asked = spark.createDataFrame([("c1", "me"), ("c2", "me"), ("c3", "me")], "chat_id string, owner_id string")
    left, told = M.delete_messages(msgs, asked, chats, projects)
    assert left.count() == 6 and [tuple(r) for r in told.collect()] == [("c1", 3)]


def test_catalog_places(spark):
    at = lambda m: dt.datetime(2025, 1, 1) + dt.timedelta(minutes=m)
    projects = spark.createDataFrame([(i, i % 2, at((i * 37) % 400), i) for i in range(50)] + [(90, 0, None, 90), (91, None, at(1), 91)], "id int, owner_id int, created_at timestamp, primary_document_id int")
    got = M.project_catalog(projects, projects.select("id", F.lit("f").alias("original_filename"))).collect()
    for owner in (0, 1, None):
        mine = sorted((r["place"], r["id"]) for r in got if r["owner_id"] == owner)
        order = sorted((r for r in got if r["owner_id"] == owner), key=lambda r: (r["created_at"] is None, -(r["created_at"] or at(0)).timestamp(), r["id"]))
        assert mine == [(k + 1, r["id"]) for k, r in enumerate(order)]


def test_hydrated_messages(spark):
    body = '{"index_id":"x","metric":"cosine","top_k":3,"chunks":[{"chunk_id":"b","score":0.5,"matched_by":[0,1]},{"chunk_id":"gone","score":0.4}]}'
    msgs = spark.createDataFrame([(1, body), (2, None), (3, '{"index_id":"x","chunks":[]}')], "message_id int, citations string")
    chunks = spark.createDataFrame([("x", "b", "text b"), ("y", "gone", "other index")], "index_id string, chunk_id string, text string")
    got = {r["message_id"]: r["cited"] for r in M.hydrated_messages(msgs, chunks).collect()}
    assert [(c["chunk_id"], c["score"], c["matched_by"], c["content"]) for c in got[1]["chunks"]] == [("b", 0.5, [0, 1], "text b"), ("gone", 0.4, None, None)]
    assert got[1]["metric"] == "cosine" and got[1]["top_k"] == 3 and got[2] is None and got[3]["chunks"] == []


def test_tokens_and_history(spark):
    rng = np.random.default_rng(9)
    texts = random_texts(500, "aé_1½ \t .-\x1c中", 12, 9) + ["", None]
    want = [len(re.findall(r"\w+|[^\w\s]", t or "")) for t in texts]
    assert [r["n_tokens"] for r in M.count_tokens(spark.createDataFrame([(t,) for t in texts], "text string")).collect()] == want
    assert M.count_tokens(spark.createDataFrame([("a b",)], "text string"), tokenizer=len).first()["n_tokens"] == 3
    rows = [(i, int(rng.integers(0, 4)), " " * (i % 3) + "w " * (i % 5), dt.datetime(2025, 1, 1) + dt.timedelta(minutes=i)) for i in range(60)]
    got = {r["id"]: r["history_tokens"] for r in M.history_tokens(spark.createDataFrame(rows, "id int, chat_id int, content string, created_at timestamp")).collect()}
    for i, chat, *_ in rows:
        assert got[i] == sum(len(x[2].split()) for x in [r for r in rows if r[1] == chat and r[0] < i][-6:])


def test_packs_and_cards(spark):
    ranked = spark.createDataFrame([(1, 1, "c", 4, "text", 0.5, [0, 2], {"page": "3"}), (1, 2, "d", None, "more", None, None, {}), (2, 1, "e", 0, "x", 1.0, [0], None)], "query_id int, rank int, chunk_id string, chunk_index int, text string, score double, matched_by array<int>, meta map<string,string>")
    queries = spark.createDataFrame([(1, "i", ["one", " "]), (2, "i", None), (3, "i", ["z"])], "query_id int, index_id string, sub_queries array<string>")
    packs = {r["query_id"]: r for r in H.rerank_prompts(H.build_context_pack(ranked, queries=queries)).collect()}
    assert [(c["chunk_id"], c["citation"], c["meta"], c["score"]) for c in packs[1]["chunks"]] == [("c", '{"page":"3"}', '{"page":"3"}', 0.5), ("d", None, "{}", 0.0)]
    assert packs[3]["chunks"] == [] and packs[2]["chunks"][0]["citation"] is None and packs[1]["index_id"] == "i"
    assert packs[1]["prompt"] == "Supporting sub-queries:\n- one\n\n#0 id=c index=4 score=0.500000\ntext\nsignals: matched_by=[0, 2]\n---\n#1 id=d score=0.000000\nmore"
    plain = ranked.drop("meta", "chunk_index", "matched_by")
    assert H.build_context_pack(plain).where("query_id = 2").first()["chunks"][0]["citation"] is None


# --- sources, streams --------------------------------------------------------------------------------------


def test_documents_tables_and_chunks(spark, tmp_path):
    (tmp_path / "o" / "p").mkdir(parents=True)
    (tmp_path / "o" / "p" / "f.pdf").write_bytes(b"%PDF")
    r = S.parse_storage_path(S.read_documents(spark, str(tmp_path / "o" / "*" / "*.pdf"))).first()
    assert (r["owner_id"], r["project_id"], r["file_name"], r["length"], bytes(r["content"])) == ("o", "p", "f.pdf", 4, b"%PDF")
    for name, kinds in S.SCHEMAS.items():
        spark.createDataFrame([], kinds).write.parquet(str(tmp_path / "t" / f"{name}.parquet"))
    tables = S.load_tables(spark, str(tmp_path / "t"))
    assert len(tables) == 8 and tables["document_indexes"].schema["embed_config"].dataType.simpleString().startswith("struct<provider:string") and all(t.count() == 0 for t in tables.values())
    rows = spark.createDataFrame([("i", 1), ("j", 2)], "index_id string, n int")
    at = str(tmp_path / "chunks")
    S.write_chunks(rows.limit(0), at)
    assert not os.path.exists(at)
    for batch in (1, 1, 2):
        S.write_chunks(rows, at, batch=batch)
    S.write_chunks(rows.limit(0), at, batch=3)
    assert spark.read.parquet(at).count() == 4
    S.write_chunks(rows, str(tmp_path / "more"))
    S.write_chunks(rows, str(tmp_path / "more"))
    assert spark.read.parquet(str(tmp_path / "more")).count() == 4


def test_streamed_index_upserts(spark, tmp_path):
    from docspark.streaming import jobs

    at = str(tmp_path)
    for text in ("first words of it " * 80, "second words of it " * 80):
        spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{at}/in")
        docs = spark.readStream.schema("doc_id long, text string").parquet(f"{at}/in")
        jobs.stream_index(docs, f"{at}/out", f"{at}/ck").awaitTermination(60)
    rows = jobs.read_index(spark, f"{at}/out").collect()
    assert rows and all(r["text"].find("first") < 0 for r in rows) and len({r["chunk_id"] for r in rows}) == len(rows)


def test_embedder_words(spark):
    """Each dimension is the sum of the signs of the words hashed to it."""
    import hashlib

    texts = ["One two  two\tthree", "", " \n", "É é one " * 50]
    for t, v in zip(texts, E.hashing_embedder(16)(texts)):
        want = np.zeros(16)
        for w in t.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            want[h % 16] += 1 if h >> 63 else -1
        n = np.sqrt((want**2).sum())
        assert np.allclose(v, want / n if n else want)
    assert E.hashing_embedder()([]) == []


def test_upsert_touches_what_changes(spark, tmp_path):
    """E6 on a table: partitions without changes keep their files, the same updates again give the same table, replaced indexes lose their rows."""
    schema = "index_id string, chunk_id int, embed_signature string, text string"
    at = str(tmp_path / "table")
    rows = lambda: sorted(tuple(r) for r in spark.read.schema(schema).parquet(at).select(*[c.split()[0] for c in schema.split(", ")]).collect())
    files = lambda i: {f: os.stat(f"{at}/index_id={i}/{f}").st_mtime_ns for f in os.listdir(f"{at}/index_id={i}") if f.endswith(".parquet")}
    first = [(i, c, "s", f"{i}{c}") for i in ("007", "b c", "x") for c in range(40)]
    E.upsert_table(spark.createDataFrame(first, schema), at)
    assert rows() == sorted(first)
    kept = {i: files(i) for i in ("007", "x")}
    change = spark.createDataFrame([("b c", 3, "s", "old", 1), ("b c", 3, "s", "new", 2), ("b c", 99, "s", "more", 1), ("b c", 3, "t", "other", 1)], f"{schema}, seq int")
    want = sorted([r for r in first if r[:2] != ("b c", 3)] + [("b c", 3, "s", "new"), ("b c", 99, "s", "more"), ("b c", 3, "t", "other")])
    for _ in range(2):
        E.upsert_table(change, at)
        assert rows() == want and {i: files(i) for i in ("007", "x")} == kept
    E.upsert_table(change.limit(0), at)
    assert rows() == want
    E.upsert_table(spark.createDataFrame([("x", 1, "s", "only")], schema), at, replaced=spark.createDataFrame([("x",), ("b c",)], "index_id string"))
    assert rows() == sorted([r for r in first if r[0] == "007"] + [("x", 1, "s", "only")]) and files("007") == kept["007"]


def test_pages_stream_into_a_table(spark, tmp_path):
    """T1 from markup: two batches of a page, fewer chunks than before, a page that is emptied, two versions in a batch, a batch again."""
    from docspark.streaming import jobs

    at, schema = str(tmp_path), "page_id string, html string, seq int"
    page = lambda n: "<h1>T</h1>" + "".join(f"<p>{'word ' * 150}{i}</p>" for i in range(n))

    def send(batch, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        jobs.stream_index_pages(spark.readStream.schema(schema).parquet(f"{at}/in"), f"{at}/table", f"{at}/state", parts=4, order="seq").awaitTermination(120)
        return sorted((r["index_id"], r["chunk_index"], r["text"]) for r in spark.read.parquet(f"{at}/table").collect())

    def want(pages):
        df = spark.createDataFrame([(k, v, 0) for k, v in pages.items()], schema)
        return sorted((r["index_id"], r["chunk_index"], r["text"]) for r in jobs.index_pages(df).collect())

    assert send(0, [("a", page(9), 1), ("b", page(3), 1), ("c", page(2), 1), (None, page(2), 1)]) == want({"a": page(9), "b": page(3), "c": page(2)})
    now = send(1, [("a", page(2), 1), ("b", None, 1), ("d", page(1), 1), ("d", page(4), 2)])
    assert now == want({"a": page(2), "c": page(2), "d": page(4)}) and len({k for k, *_ in now}) == 3
    # the last batch is read again: its commit is lost
    os.remove(f"{at}/state/commits/1")
    os.remove(f"{at}/state/commits/.1.crc")
    assert send(2, []) == now
    assert {len(r["embedding"]) for r in spark.read.parquet(f"{at}/table").collect()} == {64}


def test_run_states_end(spark, tmp_path):
    """T2 with a state that ends: the rows of the aggregation in any order of frames, and finished runs are forgotten."""
    from docspark.streaming import jobs

    rng = np.random.default_rng(3)
    status = ["PENDING", "RUNNING", "READY", "FAILED", "CANCEL", "CANCELLED", None]
    rows = [(int(rng.integers(0, 12)), None if rng.random() < 0.1 else int(rng.integers(0, 9)), status[int(rng.integers(0, 7))]) for _ in range(90)]
    schema, held = "run_id int, seq int, status string", {k: spark.conf.get(k) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS_DB)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for f in range(2):
            spark.createDataFrame(rows[f::2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

        def told(make, name, n):
            events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            q = make(events).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / name)).start()
            until = time.time() + 100  # timers keep such a query awake, so it does not end by itself
            while sum(p["numInputRows"] for p in q.recentProgress) < n and time.time() < until:
                time.sleep(0.2)
            q.stop()
            got = {}
            for r in spark.table(name).collect():
                got[r["run_id"]] = max(got.get(r["run_id"], (0,)), (r["n_events"], r["status"], r["cancel_requested"]))
            return got

        states = told(lambda e: jobs.stream_run_states(e, 3600), "states", len(rows))
        assert states == {r["run_id"]: (r["n_events"], r["status"], r["cancel_requested"]) for r in jobs.stream_run_status(spark.createDataFrame(rows, schema)).collect()}
        # kept for no time at all: what was finished in one frame is forgotten in the next, and one run that goes on stays
        spark.createDataFrame([(99, 1, "RUNNING")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        short = told(lambda e: jobs.stream_run_states(e, 0), "short", len(rows) + 1)
        assert short[99] == (1, "RUNNING", False) and max(n for n, *_ in short.values()) <= max(n for n, *_ in states.values())
        assert any(short[i][0] < states[i][0] for i in states)  # forgotten in between
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_replayed_messages(spark, tmp_path):
    """A message that comes again within the watermark does not count twice; beyond it, its id is forgotten."""
    from docspark.streaming import jobs

    at = lambda m: dt.datetime(2025, 1, 1) + dt.timedelta(minutes=m)
    schema = "id int, chat_id int, created_at timestamp"
    batches = [[(1, 1, at(0)), (1, 1, at(0)), (2, 1, at(5))], [(1, 1, at(10)), (3, 2, at(20))], [(4, 2, at(400))], [(3, 2, at(500)), (2, 1, at(1))]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.stream_chat_activity(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), "1 hour").awaitTermination(120)
    got = {r["chat_id"]: (r["n_messages"], r["updated_at"]) for r in jobs.read_chat_activity(spark, str(tmp_path / "out")).collect()}
    # 3 is counted again after its hour; 2, far behind the watermark, is late and left out
    assert got == {1: (2, at(5)), 2: (3, at(500))}


def test_metrics_by_chat_and_project(spark):
    """Every level in one pass, sketches within their error, and merged."""
    rng = np.random.default_rng(9)
    rows = [(i % 7, i % 7 % 3, int(rng.integers(0, 900)), None if i % 50 == 0 else float(rng.exponential(2))) for i in range(8000)]
    df = spark.createDataFrame(rows, "chat_id int, project_id int, total_tokens int, latency double")
    cube = M.metrics_cube(df).withColumn("p90", M.latency_quantile(0.9))
    got = {(r["level"], r["chat_id"], r["project_id"]): r for r in cube.collect()}
    assert len(got) == 7 + 3 + 1
    for (level, chat, project), r in got.items():
        part = [x for x in rows if (level != 0 or x[0] == chat) and (level != 1 or x[1] == project)]
        timed = sorted(x[3] for x in part if x[3] is not None)
        assert (r["answers"], r["total_tokens"], r["timed"]) == (len(part), sum(x[2] for x in part), len(timed)) and r["latency"] == pytest.approx(sum(timed))
        assert abs(np.searchsorted(timed, r["p90"]) / len(timed) - 0.9) < 0.03
    merged = M.merge_metrics(M.metrics_cube(df).where("level = 0").withColumn("project_id", F.col("chat_id") % 3), ("project_id",)).withColumn("p90", M.latency_quantile(0.9)).collect()
    for r in merged:
        one = got[1, None, r["project_id"]]
        assert (r["answers"], r["total_tokens"], r["timed"]) == (one["answers"], one["total_tokens"], one["timed"]) and r["p90"] == pytest.approx(one["p90"], rel=0.15)
    none = M.metrics_cube(spark.createDataFrame([(1, 1, 5, None)], df.schema)).withColumn("p", M.latency_quantile(0.5)).collect()
    assert len(none) == 3 and all(r["p"] is None and r["answers"] == 1 for r in none) and M.metrics_cube(df.where("false")).where("level < 2").count() == 0


def test_odd_vectors_questions_and_renames(spark):
    v = spark.createDataFrame([(1, "i", [1.0, 0.0]), (2, "i", [1.0, 0.0, 0.0]), (3, "i", None), (4, "i", [None, 1.0]), (5, "i", []), (6, "i", [0.5, 0.5])], "chunk_id int, index_id string, embedding array<double>")
    q = spark.createDataFrame([(1, "i", [1.0, 0.1]), (2, "i", [0.0, 0.0, 2.0]), (3, "i", [1.0])], "query_id int, index_id string, embedding array<double>")
    for metric in V.METRICS:
        for scope in ("index_id", None):
            out = V.vector_topk(q, v, 9, metric, scope).collect()
            assert sorted((r["query_id"], r["chunk_id"]) for r in out) == [(1, 1), (1, 6), (2, 2)]
    from docspark.operators import questions as Q

    replies = ['{"queries": "[draft] what", "strategy": "s"}', '{"queries": ["a", "b"]}', '{"queries": {"a": 1}}', '{"queries": 5}', '{"queries": null}', '{"queries": []}', "no", None, '{"queries": "plain"}']
    got = [r["rewrites"] for r in Q.parse_rewrites(spark.createDataFrame(list(enumerate(replies)), "i int, reply string")).orderBy("i").collect()]
    assert got == [["[draft] what"], ["a", "b"], [], [], [], [], [], [], ["plain"]]
    p = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (4, "four")], "id int, name string")
    u = spark.createDataFrame([(1, "z", 1), (1, "a", 2), (2, "x", 1), (2, "y", 1), (3, " ", 1), (3, "ok", None), (1, "a", 2)], "id int, name string, seq int")
    named, refused = M.apply_renames(p, u, "seq")
    assert sorted(tuple(r) for r in named.collect()) == [(1, "a"), (2, "two"), (3, "ok"), (4, "four")]
    assert sorted((r["id"], r["name"]) for r in refused.collect()) == [(2, "x"), (2, "y"), (3, "")]
    named, refused = M.apply_renames(p, u)
    assert sorted(tuple(r) for r in named.collect()) == [(1, "one"), (2, "two"), (3, "ok"), (4, "four")] and refused.count() == 6
