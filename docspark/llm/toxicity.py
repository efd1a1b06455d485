"""Toxicity by weak supervision.

Voters of three kinds look at a whole text: lexicons (of words that labelled
toxic documents hold far more often than chance allows, and a short fixed one),
patterns of how such words occur, and signs of a harmless text. A generative
label model, a mixture of two trees fitted by expectation-maximisation on the
counts of all vote patterns, estimates for either class how often each voter
speaks and how that depends on another voter: each class has the tree of the
strongest dependences, so voters that say the same thing twice count once. The
posterior labels of the patterns train a linear classifier on hashed words and
votes, which scores every text.

Labels are learned from a bounded sample of labelled rows that are not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngram_join import Shingler, _mix
from .staging import free_name, release, stage

# Insults in four languages, and words by which somebody is addressed.
SEEDS = (
    "idiot idiots moron morons imbecile stupid dumb dumbass fool loser losers scum trash garbage filth vermin clown pathetic worthless disgusting retard bastard bitch whore slut asshole fuck fucking "
    "shit bullshit dickhead jerk scumbag pig freak parasite "
    "trottel vollidiot arschloch scheisse scheiße dreck dreckskerl wichser hurensohn schlampe abschaum missgeburt blödmann "
    "connard connasse salaud salope ordure merde putain enculé débile crétin abruti "
    "gilipollas cabrón puta puto mierda pendejo imbécil estúpido idiota basura escoria"
).split()
ADDRESS = "you your yours u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti usted ustedes tus vosotros".split()
#: What letters may be written as; a word with one of these and a letter is read with the letters instead.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
THRESHOLD = 0.3
#: Labelled rows that are learned from: a sample by hash of about so many.
LABELLED = 32_768
#: Words of the learned lexicons at most, the strongest first, and the lexicons that they are dealt to.
LEXICON, LEXICONS = 4096, 6
#: Share of the learned words that may be there by chance.
FALSE_WORDS = 0.05
#: The classifier is trained on about so many documents, half of them likely toxic, and of these on so many as have this many feature values; the label model uses all.
TRAIN_ROWS, TRAIN_VALUES = 8192, 8_000_000
BUCKETS, EPOCHS, ROUNDS = 1 << 16, 6, 30
#: All rows without labels weigh at most so many times what those with labels do.
UNLABELLED = 10.0
#: The voters behind the learned lexicons. All speak or are silent.
VOTERS = (*(f"lexicon_{i}" for i in range(LEXICONS)), "seeds", "dense", "varied", "addressed", "disguised", "shouted", "harmless", "calm")


def _letters(leet: bool = False) -> np.ndarray:
    """What each byte of a lower-case text becomes: a letter stays, all else is a space."""
    table = np.full(256, 32, dtype=np.uint8)
    table[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]
    if leet:
        for sign, letter in LEET.items():
            table[ord(sign)] = ord(letter)
    return table


class Text:
    """One text as the hashes of its words, which are runs of letters, lower-cased."""

    LETTERS, LEET = _letters(), _letters(True)

    def __init__(self, shingler: Shingler, text: str):
        self.text, self.shingler = text, shingler
        data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
        odd = np.zeros(len(data) + 2, dtype=bool)  # no-break spaces, quotes, dashes: signs of two and three bytes
        two = np.flatnonzero(data == 0xC2)
        three = np.flatnonzero((data[:-1] == 0xE2) & ((data[1:] == 0x80) | (data[1:] == 0x81)))
        for at, n in ((two, 2), (three, 3)):
            for i in range(n):
                odd[at + i] = True
        self.data = np.where(odd[: len(data)], np.uint8(32), data)
        self.plain = self.LETTERS[self.data]
        self.start, self.end = shingler.edges(self.plain)
        self.words = shingler.hashes(self.plain, self.start, self.end)

    def disguised(self) -> np.ndarray:
        """Hashes of the words that are partly written in signs, read as letters."""
        read = self.LEET[self.data]
        signs = (read != self.plain)[: len(read)]
        if not signs.any():
            return np.zeros(0, dtype=np.uint64)
        start, end = self.shingler.edges(read)
        count = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[end] - c[start]
        mixed = (count(signs) > 0) & (count(self.plain != 32) > 0)
        return self.shingler.hashes(read, start[mixed], end[mixed])

    def shouted(self) -> tuple[int, int]:
        """Words of three letters and more, and how many of them are in capitals."""
        long = [w for w in self.text.split() if len(w) > 2]
        return len(long), sum(w.isupper() for w in long)


def _hashes(words) -> np.ndarray:
    return np.unique(np.array([Shingler().word_hashes(w)[0] for w in words], dtype=np.uint64))


class Voters:
    """Votes on a text, all of them on its whole: 1 speaks, 0 is silent. Its own object in each task."""

    def __init__(self, lexicon: np.ndarray):
        self.lexicon, self.seeds, self.address = np.sort(lexicon), _hashes(SEEDS), _hashes(ADDRESS)
        self.all = np.union1d(self.lexicon, self.seeds)

    def __call__(self, t: Text) -> np.ndarray:
        hit = np.isin(t.words, self.all)
        hits, n = t.words[hit], len(t.words)
        different = np.unique(hits)
        learned = different[np.isin(different, self.lexicon)]
        places, address = np.flatnonzero(hit), np.flatnonzero(np.isin(t.words, self.address)) if len(hits) else np.zeros(0, dtype=int)
        near = bool(len(address)) and bool((np.abs(address[np.clip(np.searchsorted(address, places)[:, None] + [-1, 0], 0, len(address) - 1)] - places[:, None]) <= 3).any())
        disguised = bool(np.isin(t.disguised(), self.all).any())
        long, loud = t.shouted()
        shouted = long >= 5 and 2 * loud >= long
        votes = np.zeros(len(VOTERS), dtype=np.int8)
        votes[(_mix(learned) % np.uint64(LEXICONS)).astype(int)] = 1
        votes[LEXICONS:] = (
            np.isin(different, self.seeds).any(), len(hits) > 0 and 100 * len(hits) >= n, len(different) > 1, near, disguised, shouted,
            not len(hits) and not disguised and n >= 20, not shouted and "!" not in t.text,
        )
        return votes


def _tree(weights: np.ndarray, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent of each voter, the first being its own, and the chance that it speaks if its parent is silent or speaks) of the tree with the largest mutual information."""
    k, total = votes.shape[1], weights.sum() + 4.0
    on = votes.astype(np.float64)
    p11 = ((on * weights[:, None]).T @ on + 1.0) / total
    single = ((on * weights[:, None]).sum(0) + 2.0) / total
    cells = ((p11, single[:, None], single), (single[:, None] - p11, single[:, None], 1 - single), (single - p11, 1 - single[:, None], single), (1 - single[:, None] - single + p11, 1 - single[:, None], 1 - single))
    information = sum(np.maximum(p, 1e-12) * np.log(np.maximum(p, 1e-12) / (a * b)) for p, a, b in cells)
    parent, best = np.zeros(k, dtype=int), information[0].copy()
    best[0] = -np.inf
    joined = np.zeros(k, dtype=bool)
    joined[0] = True
    for _ in range(k - 1):
        i = int(np.where(joined, -np.inf, best).argmax())
        joined[i] = True
        closer = ~joined & (information[i] > best)
        parent[closer], best[closer] = i, information[i][closer]
    speaks = np.empty((k, 2))
    speaks[:, 1] = p11[np.arange(k), parent] / single[parent]
    speaks[:, 0] = (single - p11[np.arange(k), parent]) / (1 - single[parent])
    speaks[0] = single[0]
    return parent, np.clip(speaks, 1e-6, 1 - 1e-6)


def _log_chance(tree: tuple[np.ndarray, np.ndarray], votes: np.ndarray) -> np.ndarray:
    parent, speaks = tree
    p = speaks[np.arange(votes.shape[1]), votes[:, parent]]
    return np.log(np.where(votes == 1, p, 1 - p)).sum(1)


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Posterior of toxic for each vote pattern (rows of 0/1), by EM.

    ``counts``: rows of each pattern that are labelled clean, labelled toxic, not
    labelled. Labelled rows keep their class. Where no row is labelled toxic, a
    tenth of the rows of each pattern is, if a voter of the lexicons speaks, and
    else clean.
    """
    clean, toxic, rest = counts.astype(np.float64).T
    if not toxic.sum():
        loud = votes[:, : LEXICONS + 5].any(1)
        clean, toxic, rest = clean + 0.1 * rest * ~loud, 0.1 * rest * loud, 0.9 * rest
    known = clean.sum() + toxic.sum()
    if known and rest.sum():
        rest = rest * min(1.0, UNLABELLED * known / rest.sum())
    post = None
    for _ in range(rounds):
        w1, w0 = (toxic, clean) if post is None else (toxic + rest * post, clean + rest * (1 - post))
        prior = (w1.sum() + 1) / (w1.sum() + w0.sum() + 2)
        odds = np.log(prior / (1 - prior)) + _log_chance(_tree(w1, votes), votes) - _log_chance(_tree(w0, votes), votes)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post


class Features:
    """Hashed words of unit length, and the votes, how dense the hits are and how long the text is beside them."""

    def __init__(self, voters: Voters):
        self.voters = voters

    def __call__(self, t: Text, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, count = np.unique(t.words & np.uint64(BUCKETS - 1), return_counts=True)
        value = np.log1p(count.astype(np.float64))
        value /= np.sqrt((value * value).sum()) or 1.0
        hits, n = int(np.isin(t.words, self.voters.all).sum()), len(t.words)
        own = np.append(np.flatnonzero(votes), len(VOTERS) + 4 * min(hits.bit_length(), 9) + min(int(100 * hits / max(n, 1)), 3))
        return np.concatenate([ids.astype(np.int64), BUCKETS + own]).astype(np.int32), np.concatenate([value, np.full(len(own), 0.5)]).astype(np.float32)


#: Hashed words, votes, and steps of number and density of hits.
WIDTH = BUCKETS + len(VOTERS) + 40


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by adaptive gradient steps; rows in a fixed order."""
    w, g, b, gb = np.zeros(WIDTH), np.full(WIDTH, 1e-6), 0.0, 1e-6
    for _ in range(EPOCHS):
        for ids, value, y in rows:
            step = 1 / (1 + np.exp(-np.clip(w[ids] @ value + b, -30, 30))) - y
            d = step * value
            g[ids] += d * d
            w[ids] -= 0.3 * d / np.sqrt(g[ids])
            gb += step * step
            b -= 0.3 * step / np.sqrt(gb)
    return w, b


def learn_lexicon(texts: DataFrame, size: int = LEXICON) -> np.ndarray:
    """Hashes of the words that speak for toxic, of ``texts`` (_text, toxic), strongest first.

    A word is taken if half of the documents that hold it are toxic and that is
    too many for chance: of all taken, about ``FALSE_WORDS`` could be there by
    chance, given how many words were looked at. Documents count by
    the different words before the word, told apart by 64 bits, so a text
    that was copied often brings no words of its own.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for b in batches:
            parts = []
            for text, toxic in zip(b["_text"], b["toxic"]):
                h = Text(shingler, text if isinstance(text, str) else "").words
                if not len(h):
                    continue
                before = np.concatenate([np.zeros(1, dtype=np.uint64), h[:-1]]) if toxic else np.zeros(len(h), dtype=np.uint64)
                order = np.argsort(h, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
                parts.append((h[order][first], np.full(len(first), int(toxic)), np.bitwise_or.reduceat(np.uint64(1) << (before[order] & np.uint64(63)), first) if toxic else np.zeros(len(first), dtype=np.uint64)))
            if not parts:
                continue
            h, toxic, mask = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
            n, bad = np.diff(np.append(first, len(h))), np.add.reduceat(toxic[order], first)
            yield pd.DataFrame({"h": h[order][first].view(np.int64), "toxic": bad, "clean": n - bad, "before": np.bitwise_or.reduceat(mask[order], first).view(np.int64)})

    every = texts.mapInPandas(counted, "h long, toxic long, clean long, before long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("before").alias("before"))
    words = stage(every.where("toxic > 1"), "toxic-words")
    total = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    looked = words.count()
    if not looked or total["toxic"] in (0, total["n"]):
        release(words)
        return np.zeros(0, dtype=np.uint64)
    prior, share = F.lit(total["toxic"] / total["n"]), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    different = F.least(F.col("toxic"), 64 * F.log(64 / (64.5 - F.bit_count("before"))))
    apart = share * F.log(share / prior) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - prior))).otherwise(0.0)
    strength = different / share * apart  # of so many documents, so many toxic: how unlikely by chance
    found = words.where((share >= 0.5) & (share > prior)).select("h", strength.alias("s")).orderBy(F.col("s").desc(), "h").limit(size).collect()
    release(words)
    sure = [r["s"] >= np.log(looked / (FALSE_WORDS * k)) for k, r in enumerate(found, 1)]
    taken = max((k for k, x in enumerate(sure, 1) if x), default=0)
    return np.array([r["h"] for r in found[:taken]], dtype=np.int64).view(np.uint64)


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` and last the struct ``_toxicity``: weak_label (posterior of the votes), score, predicted (1 if ``score >= threshold``).

    ``labels`` (``id_col``, ``label_col`` 0 or 1) may cover a part of ``docs``; rows
    where ``held_out``, a condition on ``id_col``, holds are never learned from. Of
    several labels of an id the largest counts; null labels and ids are no
    labels. Null and empty texts are scored by the same votes and features; very
    long ones are read whole; repeated rows are scored alike; an empty table gives
    no rows, and without labels the fixed lexicon alone speaks. Columns of ``docs``
    stay whatever their names: if one is called ``_toxicity``, the struct is
    ``_toxicity_``. Texts are read twice: for the votes' counts, and to score them.
    """
    learn = labels.select(F.col(id_col).alias("_i"), F.col(label_col).cast("int").alias("toxic"))
    if held_out is not None:
        learn = labels.where(~held_out).select(F.col(id_col).alias("_i"), F.col(label_col).cast("int").alias("toxic"))
    learn = learn.where("_i IS NOT NULL AND toxic IN (0, 1)").groupBy("_i").agg(F.max("toxic").alias("toxic"))
    part = min(1.0, LABELLED / max(learn.count(), 1))
    # about LABELLED rows of an id and a number, whatever the table's size
    learn = F.broadcast(stage(learn.where(F.xxhash64("_i") / 2.0**64 + 0.5 < part), "toxic-labels"))
    source = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(learn, F.col("_id") == F.col("_i"), "left").select("_id", "_text", "toxic")
    lexicon = learn_lexicon(texts.where("toxic IS NOT NULL").select("_text", "toxic"))

    def voted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        voters, shingler = Voters(lexicon), Shingler()
        for b in batches:
            yield pd.Series([voters(Text(shingler, t if isinstance(t, str) else "")).tobytes() for t in b], dtype=object)

    pattern = F.pandas_udf(voted, "binary")(F.col("_text"))
    label = lambda x: F.count_if(F.col("toxic") == x) if x is not None else F.count_if(F.col("toxic").isNull())
    counted = texts.select(pattern.alias("votes"), "toxic").groupBy("votes").agg(label(0).alias("clean"), label(1).alias("toxic"), label(None).alias("rest")).orderBy("votes").collect()  # at most 2 ** voters rows
    votes = np.array([np.frombuffer(bytes(r["votes"]), np.int8) for r in counted]).reshape(-1, len(VOTERS))
    counts = np.array([(r["clean"], r["toxic"], r["rest"]) for r in counted], dtype=np.float64).reshape(-1, 3)
    post = fit_votes(votes, counts) if len(votes) else np.zeros(0)
    posterior = {v.tobytes(): float(p) for v, p in zip(votes, post)}
    many = counts.sum(1)
    parts = [min(1.0, TRAIN_ROWS / 2 / max(many[side].sum(), 1.0)) for side in (post < 0.5, post >= 0.5)]

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voters, shingler = Voters(lexicon), Shingler()
        features = Features(voters)
        for b in batches:
            out = []
            for h, chance, text in zip(b["h"], b["chance"], b["_text"]):
                t = Text(shingler, text if isinstance(text, str) else "")
                v = voters(t)
                y = posterior[v.tobytes()]
                if chance < parts[int(y >= 0.5)]:
                    ids, value = features(t, v)
                    out.append((h, ids.tobytes(), value.tobytes(), y))
            yield pd.DataFrame(out, columns=["h", "ids", "value", "y"])

    drawn = source.select("_text", F.xxhash64("_id", "_text").alias("h")).withColumn("chance", F.col("h") / 2.0**64 + 0.5).where(F.col("chance") < max(parts))
    kept = stage(drawn.mapInPandas(featured, "h long, ids binary, value binary, y double"), "toxicity-sample")
    sizes = kept.groupBy("h").agg(F.sum(F.octet_length("ids") / 4).alias("n")).orderBy("h").collect()
    room = np.cumsum([r["n"] for r in sizes]) <= TRAIN_VALUES if sizes else np.zeros(0, dtype=bool)
    last = sizes[int(room.sum()) - 1]["h"] if room.any() else None
    sample = kept.where(F.col("h") <= F.lit(last)).collect() if last is not None else []
    release(kept)
    order = sorted(sample, key=lambda r: (_mix(np.array([r["h"]]).view(np.uint64))[0], r["y"]))
    w, b = train_scorer([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["value"], np.float32), r["y"]) for r in order])
    # likely toxic rows were drawn more often than others
    model = docs.sparkSession.sparkContext.broadcast((w, b - np.log(parts[1] / parts[0])))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        voters, shingler, (w, b) = Voters(lexicon), Shingler(), model.value
        features = Features(voters)
        for batch in batches:
            out = []
            for text in batch:
                t = Text(shingler, text if isinstance(text, str) else "")
                v = voters(t)
                ids, value = features(t, v)
                out.append((posterior[v.tobytes()], 1 / (1 + np.exp(-np.clip(w[ids] @ value.astype(np.float64) + b, -30, 30)))))
            yield pd.DataFrame(out, columns=["weak_label", "score"], dtype=np.float64)

    out = source.withColumn("_t", F.pandas_udf(scored, "weak_label double, score double")(F.col("_text")))
    told = F.struct(F.col("_t.weak_label"), F.col("_t.score"), (F.col("_t.score") >= threshold).cast("int").alias("predicted"))
    return out.select("_row.*", told.alias(free_name(docs.columns, "_toxicity")))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 over when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of query ``op11``."""
    out = score_toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), held_out(F.col("doc_id")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_toxicity.score", "_toxicity.predicted", "_toxicity.weak_label")
