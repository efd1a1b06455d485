"""Spelling variant grouping: a join on asymmetric q-chunks.

Of two words that are one edit apart, the shorter one (or the smaller, at equal
length) is cut into two disjoint chunks. An edit touches one of them; the other
is a gram of the longer word, at its old place or one behind. So the first word
of a pair sends its two chunks, the second its grams at the places where a chunk
of a word of its length or one less can be, both meet by an equi-join, and the
edit distance verifies them.

A chunk that many words share is joined with a gram of what the words have
beyond it: the part that holds the edit is halved again, and again, until few
words share all that is outside of it. A part of one code point cannot be
halved, and no more words share the rest of it than there are letters. So the
candidates of a level are at most a constant times its rows, whatever the words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import release, stage

#: Maximal runs of these are words; only A-Z are lower-cased.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: In one of so many pairs of document and run a code point is deleted.
TYPOS = 97
MIN_LENGTH, MIN_COUNT = 5, 3
#: A word's form occurs at least so many times as often as the word.
RATIO = 2
#: Words of one length that may share a chunk before it is joined with more of them.
CROWD = 64


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of the whole texts and how often they occur.

    Where ``TYPOS`` divides h, the unsigned crc32 of ``<id>:<word>``, the word loses
    its code point h % length. Null and empty texts have no words, very long ones
    are read whole; a null id is written as nothing. Repeated rows count as rows.
    An empty table gives no rows; other columns are not read.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LETTERS), F.lit(0))).alias("w"))
    runs = runs.select("i", F.when(F.col("w").rlike("[A-Z]"), F.translate("w", UPPER, LOWER)).otherwise(F.col("w")).alias("w"))
    hashed = runs.select("w", F.crc32(F.concat("i", F.lit(":"), "w").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("w")).cast("int")
    word = F.when(F.col("h") % TYPOS == 0, F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.length("w")))).otherwise(F.col("w"))
    return hashed.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _keyed(parts: DataFrame) -> DataFrame:
    """With ``key``: a hash of all that is outside the part [lo, hi) of a word of ``size`` code points; a longer word has one more in it."""
    hi = F.col("hi") + F.col("longer").cast("int")
    outside = (F.substring(F.col("word"), F.lit(1), F.col("lo")), F.substring(F.col("word"), hi + 1, F.length("word")))
    return parts.withColumn("key", F.xxhash64("size", "lo", "hi", *outside))


def _halves(words: DataFrame) -> DataFrame:
    """Two rows for each row: its part [lo, hi) as two, of which one holds the edit."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    both = F.explode(F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi"))))
    return _keyed(words.select("word", "n", "size", "longer", both.alias("p")).select("word", "n", "size", "longer", "p.lo", "p.hi"))


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair of ``words`` (word, n) that differ by exactly one inserted, deleted or replaced code point.

    Words must be distinct and not null; the table is read several times. An
    empty table gives no rows.
    """
    sized = F.explode(F.array(F.struct(F.length("word").alias("size"), F.lit(False).alias("longer")), F.struct((F.length("word") - 1).alias("size"), F.lit(True).alias("longer"))))
    whole = words.select("word", "n", sized.alias("s")).select("word", "n", "s.size", "s.longer", F.lit(0).alias("lo"), F.col("s.size").alias("hi"))
    level, found, held = _halves(whole), [], []
    while True:
        sizes = level.groupBy("key").agg(F.count_if(~F.col("longer")).alias("many"), F.max(F.col("hi") - F.col("lo")).alias("width"))
        crowded = stage(sizes.where((F.col("many") > crowd) & (F.col("width") > 1)).select("key"), "crowded-chunks")
        quiet = level.join(crowded, "key", "left_anti")
        chunks = quiet.where("NOT longer").select("key", "word", "n")
        grams = quiet.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"), "longer")
        pairs = chunks.join(grams, "key").where((F.col("longer") | (F.col("word") < F.col("near"))) & (F.levenshtein("word", "near", 1) == 1))
        found.append(stage(pairs.select("word", "n", "near", "near_n"), "near-words"))
        more = not crowded.isEmpty()
        after = stage(_halves(level.join(crowded, "key", "left_semi")), "split-chunks") if more else None
        release(crowded, *held)
        if not more:
            break
        level, held = after, [after]
    # the same pair can meet at two parts: an edit between them, or in a row of equal letters
    pairs = reduce(DataFrame.unionByName, found).distinct()
    both = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return pairs.select(both.alias("p")).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last form that follows; each round doubles the steps, which are few as counts grow by ``RATIO`` with each."""
    now = forms.select("word", F.col("form").alias("root"))
    held: list[DataFrame] = []
    while True:
        next_ = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        jumped = stage(now.join(next_, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "word-roots")
        release(*held)
        now, held = jumped, [jumped]
        if jumped.where("moved").isEmpty():
            return now.select("word", "root")


def group_variants(words: DataFrame, ratio: int = RATIO, crowd: int = CROWD) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``words`` (word, n).

    The form is the near word that occurs most (ties: the smallest in code-point
    order), if at least ``ratio`` times as often as the word; the root is the last
    of the forms that follow from the word, or the word itself.
    """
    near = near_words(words, crowd).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"),
    ).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    fits = F.col("form_n") >= ratio * F.col("n")
    told = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"),
    )
    told = stage(told, "word-forms")
    roots = _roots(told.where("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    """Rows of query ``op12``."""
    return group_variants(stage(words_of(docs.select("doc_id", "text")), "words"))


#: crc32 byte by byte over a table of 256; words one deletion apart, or equal but for one place; forms followed one by one.
ORACLE_SQL = """
WITH RECURSIVE
tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS i, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
g AS (SELECT i, w, count(*) AS k, flatten(list_transform(string_split(i || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)) AS b FROM r GROUP BY i, w),
h AS (SELECT w, k, xor(list_reduce(list_prepend(4294967295::UBIGINT, b::UBIGINT[]), lambda c, x: xor(c >> 8, t[((xor(c, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) AS h FROM g, tab),
c AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % len(w))::BIGINT) || substr(w, (h % len(w))::BIGINT + 2) ELSE w END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM c WHERE len(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
d AS (SELECT DISTINCT word, n, left(word, i) || substr(word, i + 2) AS x FROM (SELECT word, n, unnest(range(len(word))) AS i FROM v)),
m AS (SELECT word, n, left(word, i) || '*' || substr(word, i + 2) AS x FROM (SELECT word, n, unnest(range(len(word))) AS i FROM v)),
e AS (SELECT a.word, b.word AS near, b.n AS k FROM m a JOIN m b ON a.x = b.x AND a.word <> b.word UNION ALL
      SELECT v.word, d.word, d.n FROM v JOIN d ON v.word = d.x UNION ALL SELECT d.word, v.word, v.n FROM v JOIN d ON v.word = d.x),
b AS (SELECT word, count(*) AS n_near, max(k) AS k, arg_min(near, (-k, near)) AS near FROM e GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN k >= 2 * n THEN near END AS form, CASE WHEN k >= 2 * n THEN k END::BIGINT AS form_n FROM v LEFT JOIN b USING (word)),
p(word, root) AS (SELECT word, word FROM f UNION SELECT p.word, f.form FROM p JOIN f ON f.word = p.root WHERE f.form IS NOT NULL),
z AS (SELECT p.word, p.root FROM p JOIN f ON f.word = p.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN z USING (word)
"""
