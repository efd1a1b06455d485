"""Quality rules: a threshold table compiled into one Spark projection.

No user function runs: words, lines and windows are arrays of built-in
functions, and every rule is a comparison of two columns of one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import free_name

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Windows of a text are numbered in so many bits beside their hash.
INDEX_BITS = 24

# Frequent function words of the four corpus languages.
STOP_WORDS = (
    "the of and to in a is that for on with as by at this from or are be "
    "der die das und den von zu mit ist ein eine im dem nicht auf des sich "
    "le la les de et un une du en que qui dans pour est au par sur "
    "el los las y por con se del al es como no lo su"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= 1000 * numerator / denominator <= high`` (an empty denominator passes)."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None


#: Ratios in thousandths, so that both sides of a comparison are whole numbers.
RULES = (
    Rule("mean_word_chars", "word_chars", "n_words", low=2500, high=12000),
    Rule("symbol_ratio", "n_symbols", "n_words", high=100),
    Rule("stop_word_ratio", "n_stop_words", "n_words", low=60),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", high=350),
    Rule("alpha_word_ratio", "n_alpha_words", "n_words", low=700),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", high=300),
    Rule("bullet_line_ratio", "n_bullet_lines", "n_lines", high=900),
)


def _repeat_words(words: Column, starts: Column) -> Column:
    """Words covered by the windows that ``starts`` (ascending) begin: no word counts twice."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("int").alias("last")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(3), i - acc["last"])).cast("long").alias("n"), i.cast("int").alias("last")
        ),
        lambda acc: acc["n"],
    )


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and last ``_m`` (``_m_`` where that name is taken), a struct of the whole-text measures; a null text counts as empty.

    Windows of three words are found equal in two steps: a sort of short hashes
    names the candidates, and an exact comparison of their words decides.
    """
    whole = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    text = F.col("_t")
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    word = lambda i: F.get(F.col("_w"), i)
    hashed = lambda i: F.shiftleft(F.xxhash64(word(i), word(i + 1), word(i + 2)), INDEX_BITS).bitwiseOR(i.cast("long"))
    cut = lambda x: F.shiftright(x, INDEX_BITS)
    index = lambda x: x.bitwiseAND(F.lit((1 << INDEX_BITS) - 1)).cast("int")
    twin = lambda arr, i, same: F.coalesce(same(F.get(arr, i - 1)), F.lit(False)) | F.coalesce(same(F.get(arr, i + 1)), F.lit(False))
    every = F.sequence(F.lit(0), F.size("_w") - 3)
    spelled = lambda i: F.struct(F.concat_ws(" ", word(i), word(i + 1), word(i + 2)).alias("w"), i.alias("i"))
    step = (
        whole.withColumns({"_w": words, "_l": lines})
        .withColumn(
            "_h",
            F.when(F.size("_w") < 3, F.array().cast("array<bigint>"))
            .when(F.size("_w") >= (1 << INDEX_BITS), F.array().cast("array<bigint>"))
            .otherwise(F.sort_array(F.transform(every, hashed))),
        )
        .withColumn(
            "_c",
            F.when(F.size("_w") < (1 << INDEX_BITS), F.transform(F.filter("_h", lambda x, i: twin(F.col("_h"), i, lambda y: cut(y) == cut(x))), index)).otherwise(every),
        )
        .withColumn("_s", F.sort_array(F.transform("_c", spelled)))
        .withColumn("_r", F.sort_array(F.transform(F.filter("_s", lambda x, i: twin(F.col("_s"), i, lambda y: y["w"] == x["w"])), lambda x: x["i"])))
    )
    total = lambda arr, test: F.size(F.filter(arr, test)).cast("long")
    measures = {
        "n_words": F.size("_w").cast("long"),
        "word_chars": (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_w"), F.col("_r")),
        "n_stop_words": F.regexp_count(text, F.lit(rf"(?i)(?<![^\x20\x09-\x0D])(?:{'|'.join(STOP_WORDS)})(?=[\x20\x09-\x0D.,;:!?]|\z)")).cast("long"),
        "n_alpha_words": F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]*+\p{L}")).cast("long"),
        "n_ellipsis_lines": total("_l", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*\z")),
        "n_bullet_lines": total("_l", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]")),
    }
    # a row number is never negative; it keeps a later filter from being moved below, where it would repeat this work
    once = F.monotonically_increasing_id() >= 0
    told = step.withColumn("_m", F.when(once, F.struct(*[c.alias(k) for k, c in measures.items()])))
    return told.select("_row.*", F.col("_m").alias(free_name(docs.columns, "_m")))


def base_failed(m: str = "_m") -> Column:
    return (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def compile_rules(rules=RULES, m: str = "_m") -> dict[str, Column]:
    """One boolean column per rule of the table: true where a text breaks it."""
    out = {}
    for r in rules:
        scaled, unit = 1000 * F.col(f"{m}.{r.numerator}"), F.col(f"{m}.{r.denominator}")
        broken = F.lit(False)
        if r.low is not None:
            broken = broken | (scaled < r.low * unit)
        if r.high is not None:
            broken = broken | (scaled > r.high * unit)
        out[r.name] = (unit > 0) & broken
    return out


def apply_rules(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """``docs`` and last the structs ``_m`` (measures), ``_broken`` (one flag per rule) and the flag ``_kept``.

    Null and empty texts have no words and are rejected; very long ones are read
    whole; repeated rows are judged alike; an empty table gives an empty result.
    Columns of ``docs`` stay whatever their names: an added column whose name is
    taken gets underscores behind it.
    """
    m, b, kept = (free_name(docs.columns, n) for n in ("_m", "_broken", "_kept"))
    measured = measure(docs, text_col)
    broken = compile_rules(rules, m)
    flags = measured.withColumn(b, F.struct(*[c.alias(k) for k, c in broken.items()]))
    failed = base_failed(m)
    for r in rules:
        failed = failed | F.col(f"{b}.{r.name}")
    return flags.withColumn(kept, ~failed)


def filter_quality(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """The documents that pass, with the columns they came with, whatever their names.

    Null and empty texts have no words and are rejected; very long ones are
    judged whole; repeated rows alike, all or none of them stay; a value that is
    equal to a threshold passes. An empty table gives no rows.
    """
    whole = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("text"))
    return apply_rules(whole, rules).where("_kept").select("_row.*")


def report(docs: DataFrame) -> DataFrame:
    """Rows of query ``op9``: base measures, base verdict, verdict, and the extra measures."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    more = ("n_lines", "n_stop_words", "n_alpha_words")
    return apply_rules(docs.select("doc_id", "text")).select(
        "doc_id", *[F.col(f"_m.{n}").alias(n) for n in names], base_failed().alias("base_failed"), F.col("_kept").alias("kept"), *[F.col(f"_m.{n}").alias(n) for n in more]
    )


ORACLE_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
wins AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM rep) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    len(ls)::BIGINT AS n_lines,
    len(list_filter(ws, lambda x: regexp_matches(x, '^(?i)({"|".join(STOP_WORDS)})([.,;:!?].*)?\z', 's')))::BIGINT AS n_stop_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_alpha_words,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*\z')))::BIGINT AS n_ellipsis_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{{2022}}]')))::BIGINT AS n_bullet_lines
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR (n_words > 0 AND (1000 * word_chars < 2500 * n_words OR 1000 * word_chars > 12000 * n_words
      OR 1000 * n_symbols > 100 * n_words OR 1000 * n_stop_words < 60 * n_words OR 1000 * n_alpha_words < 700 * n_words))
    OR (n_lines > 0 AND (1000 * n_dup_lines > 350 * n_lines OR 1000 * n_ellipsis_lines > 300 * n_lines
      OR 1000 * n_bullet_lines > 900 * n_lines))) AS kept,
  n_lines, n_stop_words, n_alpha_words
FROM b
"""
