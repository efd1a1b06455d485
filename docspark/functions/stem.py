"""English stemming of postings and queries: the second version of Porter's algorithm, and the first one of 1980."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes of steps 2, 3 and 4 of the published algorithm, with what replaces them.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")



def _shape(w: str) -> str:
    """Vowels as v and consonants as c; y is a vowel after a consonant."""
    out = ""
    for ch in w:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall(r"v+c+", _shape(w)))


def _cvc(w: str) -> bool:
    return _shape(w).endswith("cvc") and w[-1] not in "wxy"


def _swap(w: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if w.endswith(suffix):
            root = w[: -len(suffix)]
            return root + table[suffix] if _measure(root) > 0 else w
    return w


def porter(w: str) -> str:
    if len(w) <= 2 or not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP_2), STEP_3)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(suffix):
            root = w[: -len(suffix)]
            if _measure(root) > 1 and (suffix != "ion" or root.endswith(("s", "t"))):
                w = root
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


# Fixed values of the second version: words that are stemmed to themselves or otherwise than the rules say, and beginnings that R1 follows.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURALS = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
BEGINNINGS = ("gener", "commun", "arsen")
# The suffixes of its steps 2, 3 and 4, with what replaces them.
SECOND_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
SECOND_STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
SECOND_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
# The English stop words that go with this stemmer.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now"
).split()
_V = "[aeiouy]"
_REGION = re.compile(f"{_V}[^aeiouy]")
_SHORT_END = re.compile(f"(?:[^aeiouy]{_V}[^aeiouywxY]|^{_V}[^aeiouy])$")


def _region(w: str, start: int) -> int:
    """Where the part behind the first non-vowel that follows a vowel begins."""
    m = _REGION.search(w, start)
    return m.end() if m else len(w)


def _longest(w: str, suffixes) -> str | None:
    return max((x for x in suffixes if w.endswith(x)), key=len, default=None)


def _step_1(w: str, r1: int) -> str:
    """Past and continuous forms, adverbs of them, and y."""
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif end and re.search(_V, w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT_END.search(w):
            w += "e"
    return w[:-1] + "i" if re.search("..[yY]$", w) and w[-2] not in "aeiouy" else w


def _steps_2_to_5(w: str, r1: int, r2: int) -> str:
    end = _longest(w, SECOND_STEP_2)
    if end and len(w) - len(end) >= r1 and (end != "ogi" or w.endswith("logi")) and (end != "li" or w[-3] in "cdeghkmnrt"):
        w = w[: -len(end)] + SECOND_STEP_2[end]
    end = _longest(w, SECOND_STEP_3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + SECOND_STEP_3[end]
    end = _longest(w, SECOND_STEP_4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) > r2 or (len(w) > r1 and not _SHORT_END.search(w[:-1]))):
        return w[:-1]
    return w[:-1] if w.endswith("ll") and len(w) > r2 else w


def english(w: str) -> str:
    """The second version of Porter's algorithm; words of other letters than a-z stay as they are."""
    if len(w) <= 2 or not re.fullmatch("[a-z]+", w):
        return w
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    w = re.sub(f"(?:^|(?<={_V}))y", "Y", w)
    begun = next((x for x in BEGINNINGS if w.startswith(x)), None)
    r1 = len(begun) if begun else _region(w, 0)
    r2 = _region(w, r1)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_V, w[:-2]):
        w = w[:-1]
    if w not in KEPT_AFTER_PLURALS:
        w = _steps_2_to_5(_step_1(w, r1), r1, r2)
    return w.lower()


def _run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield b.map(english, na_action="ignore")


def stem(c: Column) -> Column:
    return F.pandas_udf(_run, "string")(c)
