"""URL filter: rules first, then a ratio of two character language models.

The URLs that a rule accepts and those that a rule rejects train two
variable-order Markov models over characters. A URL that no rule judges is
kept or dropped by its length-normalised log-likelihood difference, against a
threshold calibrated on rule-judged URLs left out of the training. Everything
is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import free_name, mark, parallelism, release_since, stage

# The rules (verdict, host, path prefix).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Longest context in characters.
ORDER = 4
#: A gram that makes up one in so many of the scored characters is joined by broadcast, so at most so many are; all others by a shuffle.
FREQUENT = 16_384
#: Weight of the shorter context in every smoothed probability, in counts.
BACKOFF = 4.0
#: One URL in so many is left out of the training, to calibrate.
HOLD_OUT = 5
#: Score range and bins of the calibration; five orders of counts up to 10**12 stay inside.
LOW, HIGH, BINS = -160.0, 160.0, 32_000
#: Size of the alphabet that the order below 0 spreads evenly over.
ALPHABET = 256


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; without ``://`` or null: empty."""
    rest = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct (rule, verdict); null if none does."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        told = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, told) if out is None else out.when(fits, told)
    return out


def _padded(url: Column) -> Column:
    return F.concat(F.lit("\u0002" * ORDER), url, F.lit("\u0003"))


def _grams(urls: DataFrame) -> DataFrame:
    """One row per character of ``_url``: the gram of ``ORDER`` context characters and the character."""
    every = F.transform(F.sequence(F.lit(1), F.length("_url") + 1), lambda i: F.substring(F.col("_padded"), i, F.lit(ORDER + 1)))
    return urls.withColumn("_padded", _padded(F.col("_url"))).withColumn("_gram", F.explode(every)).drop("_padded")


def train(urls: DataFrame) -> DataFrame:
    """Counts by class (``gram``, ``is_context``, ``g``, ``b``) from ``urls`` (``_url``, ``_good`` boolean).

    Every gram of 1 to ORDER + 1 characters is there, and every context with
    the counts of all characters that follow it.
    """
    full = _grams(urls).groupBy("_gram", "_good").agg(F.count(F.lit(1)).alias("n"))
    lengths = F.array(*[F.lit(k) for k in range(1, ORDER + 2)])
    cut = full.withColumn("k", F.explode(lengths)).select(F.expr("right(_gram, k)").alias("gram"), "_good", "n")
    counts = stage(cut.groupBy("gram").agg(
        F.sum(F.when(F.col("_good"), F.col("n")).otherwise(0)).alias("g"), F.sum(F.when(F.col("_good"), 0).otherwise(F.col("n"))).alias("b")
    ), "url-grams")
    contexts = counts.groupBy(F.expr("left(gram, length(gram) - 1)").alias("gram")).agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
    contexts = stage(contexts, "url-contexts")
    return counts.select("gram", F.lit(False).alias("is_context"), "g", "b").unionByName(contexts.select("gram", F.lit(True).alias("is_context"), "g", "b"))


def log_ratios(grams: DataFrame, model: DataFrame) -> DataFrame:
    """(``gram``, ``llr``) for the distinct ``_gram``: log-probability difference of its last character after the others.

    Both smoothed probabilities are worked out order by order for the grams
    asked, seen or not: an unseen gram counts 0 and still pays its context's
    back-off factor. A join key has at most one row per character of the alphabet.
    """
    below = None
    for k in range(1, ORDER + 2):
        level = grams.select(F.expr(f"right(_gram, {k})").alias("gram")).distinct()
        own = model.where(~F.col("is_context") & (F.length("gram") == k)).select("gram", "g", "b")
        context = model.where(F.col("is_context") & (F.length("gram") == k - 1)).select(F.col("gram").alias("_c"), F.col("g").alias("cg"), F.col("b").alias("cb"))
        level = level.join(own, "gram", "left").withColumn("_c", F.expr(f"left(gram, {k - 1})")).join(context, "_c", "left").na.fill(0, ["g", "b", "cg", "cb"])
        if below is None:
            level = level.withColumns({"pg0": F.lit(1.0 / ALPHABET), "pb0": F.lit(1.0 / ALPHABET)})
        else:
            level = level.withColumn("_s", F.expr(f"right(gram, {k - 1})")).join(below, "_s")
        level = level.select("gram", *[((F.col(c) + BACKOFF * F.col(f"p{c}0")) / (F.col(f"c{c}") + BACKOFF)).alias(f"p{c}") for c in "gb"])
        below = level.select(F.col("gram").alias("_s"), F.col("pg").alias("pg0"), F.col("pb").alias("pb0"))
    return level.select("gram", (F.log("pg") - F.log("pb")).alias("llr"))


def score(urls: DataFrame, model: DataFrame) -> DataFrame:
    """Mean log-likelihood difference per character for each distinct ``_url``.

    Each distinct gram is looked up once. The frequent ones meet the URLs by
    broadcast, where a key would gather too many rows, all others by a shuffle
    of the URL's hash. Sums are of whole billionths, so they do not depend on the order.
    """
    texts = urls.select("_url").where(F.col("_url").isNotNull()).distinct().withColumn("_id", F.unhex(F.md5("_url")))
    # written in many parts: a short table of URLs is a long one of characters
    texts = stage(texts.repartition(parallelism(urls.sparkSession), "_id"), "url-texts")
    asked = stage(_grams(texts).groupBy("_gram").agg(F.count(F.lit(1)).alias("n")), "url-asked")
    total = asked.agg(F.sum("n")).first()[0] or 0
    told = log_ratios(asked, model).select(F.col("gram").alias("_gram"), F.round(F.col("llr") * 1e9).cast("long").alias("_nano"))
    told = stage(asked.join(told, "_gram"), "url-ratios")
    frequent = F.col("n") * FREQUENT >= total
    rows = _grams(texts).select("_id", "_gram").join(F.broadcast(told.where(frequent).select("_gram", "_nano")), "_gram", "left")
    rare = rows.where(F.col("_nano").isNull()).drop("_nano").join(told.where(~frequent).select("_gram", "_nano"), "_gram")
    sums = rows.where(F.col("_nano").isNotNull()).select("_id", "_nano").unionByName(rare.select("_id", "_nano"))
    sums = sums.groupBy("_id").agg((F.sum("_nano") / F.count(F.lit(1)) / 1e9).alias("_score"))
    return texts.join(sums, "_id").select("_url", "_score")


def calibrate(scored: DataFrame) -> float:
    """The score that best parts accepted from rejected held-out URLs: equal error weights for both classes."""
    step = (HIGH - LOW) / BINS
    bin_of = F.least(F.greatest(F.floor((F.col("_score") - LOW) / step), F.lit(0)), F.lit(BINS - 1)).cast("int")
    hist = scored.groupBy(bin_of.alias("bin")).agg(F.sum(F.col("_good").cast("long")).alias("g"), F.sum((~F.col("_good")).cast("long")).alias("b"))
    through, every = Window.orderBy("bin"), Window.partitionBy()
    cum = hist.select("bin", F.sum("g").over(through).alias("cg"), F.sum("b").over(through).alias("cb"), F.sum("g").over(every).alias("tg"), F.sum("b").over(every).alias("tb"))
    gain = F.col("cb") / F.greatest(F.col("tb"), F.lit(1)) - F.col("cg") / F.greatest(F.col("tg"), F.lit(1))
    best = cum.where((F.col("tg") > 0) & (F.col("tb") > 0)).orderBy(gain.desc(), F.abs(F.col("bin") - BINS // 2), "bin").select("bin").first()
    return LOW + (best["bin"] + 1) * step if best else 0.0


def judge(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """``pages`` and last the struct ``_url_verdict`` (host, path, rule, verdict, score, by_rule).

    Null URLs and those without ``://`` have empty host and path and are judged
    by the model (a null one scores 0, an empty one as the end of a URL).
    Without rule-judged URLs of both kinds every score is 0, and 0 is accepted.
    Repeated rows are judged alike; equal URLs are scored once. Very long URLs
    are scored over all their characters. An empty table gives no rows. Columns
    of ``pages`` stay whatever their names: if one is called ``_url_verdict``,
    the struct is ``_url_verdict_``.
    """
    spark, point = pages.sparkSession, mark()
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    ruled = pages.select(F.col(url_col).alias("_url")).distinct().repartition(parallelism(spark), "_url")
    ruled = stage(ruled.withColumn("_rule", rule_of(host_of(F.col("_url")), path_of(F.col("_url")), rules)), "urls")
    taught = ruled.where(F.col("_rule").isNotNull() & F.col("_url").isNotNull()).select("_url", (F.col("_rule.verdict") == "allow").alias("_good"), (F.pmod(F.xxhash64("_url"), F.lit(HOLD_OUT)) == 0).alias("_held"))
    seen = taught.where(~F.col("_held"))
    kinds = seen.agg(F.bool_or("_good").alias("good"), F.bool_or(~F.col("_good")).alias("bad")).first()
    both = bool(kinds["good"] and kinds["bad"])
    model = train(seen.select("_url", "_good"))
    model = model if both else model.where(F.lit(False))
    scores = stage(score(ruled, model), "url-scores")
    threshold = calibrate(taught.where("_held").join(scores, "_url")) if both else 0.0
    release_since(point, spark, [scores])
    scored = pages.select(F.struct("*").alias("_row"), F.col(url_col).alias("_url"), host.alias("_host"), path.alias("_path")).withColumn("_rule", rule_of(F.col("_host"), F.col("_path"), rules))
    joined = scored.join(scores.withColumnRenamed("_url", "_scored_url"), F.col("_url") == F.col("_scored_url"), "left")
    value = F.coalesce(F.col("_score"), F.lit(0.0))
    told = F.struct(
        F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(value >= threshold, "allow").otherwise("block")).alias("verdict"),
        value.alias("score"), F.col("_rule").isNotNull().alias("by_rule"),
    )
    return joined.select("_row.*", told.alias(free_name(pages.columns, "_url_verdict")))


def report(pages: DataFrame) -> DataFrame:
    """Rows of query ``op4``."""
    out = judge(pages.select("page_id", "url"))
    return out.select("page_id", *[F.col(f"_url_verdict.{c}").alias(c) for c in ("host", "path", "rule", "verdict", "score", "by_rule")])
