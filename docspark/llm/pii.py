"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, schemes, plus signs, digits
and identifier cues) in one pass over a text; small deterministic parsers then
grow each anchor to the boundaries of an address, number or account and
validate it. Nothing between anchors is looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import free_name

# The kinds in the order in which equal starts are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url", "iban", "account", "ssn")
KINDS = BASE_KINDS + ADDED_KINDS
# Cues that announce an identifier (lower case), and schemes whose address may hold a user.
CUES = ("account", "acct", "konto", "compte", "cuenta", "iban", "ssn", "social security", "passport", "user id", "userid", "customer id", "kundennummer")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "sftp://", "imap://", "smtp://")
PLACEHOLDER = {k: f"<{k.upper()}>" for k in KINDS}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AUTHORITY = re.compile(r"[^\s/?#@]+@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s<>\"']*")
_ACCOUNT = re.compile(r"(?:[\s:#=-]|no\.?|nr\.?|number|nummer|num[eé]ro|n[uú]mero|id|is){0,6}\s*([A-Za-z]{0,3}[0-9](?:[ -]?[0-9]){5,19})", re.I)
_IBAN = re.compile(r"[\s:#=-]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)")
_SSN = re.compile(r"[\s:#=-]*([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _card_ok(s: str) -> bool:
    d = s.replace(" ", "").replace("-", "")
    return 12 <= len(d) <= 19 and _luhn(d)


def _phone_ok(s: str) -> bool:
    return 9 <= sum("0" <= c <= "9" for c in s) <= 15


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for c in CUES:
        a.add_word(c, (c, len(c)))
    a.make_automaton()
    return a


def find_spans(text: str, anchors) -> list[tuple[str, int, int]]:
    """All validated spans (kind, start, end) by start, then kind as listed.

    Base kinds are leftmost and do not overlap within a kind: a match that
    fails its check is consumed all the same.
    """
    folded = text.lower()
    if len(folded) != len(text):  # a few letters grow when folded; positions must not move
        folded = "".join(low if len(low := c.lower()) == 1 else c for c in text)
    out: list[tuple[str, int, int]] = []
    done = dict.fromkeys(("email", "ip", "card", "phone", *ADDED_KINDS), 0)
    for last, (what, width) in anchors.iter(folded):
        first = last - width + 1
        if what == "digit":
            # an ip or card can only begin at a digit; later digits of the run were consumed or are inside it
            if first >= done["ip"]:
                m = _IP.match(text, first)
                if m:
                    done["ip"] = m.end()
                    if _ip_ok(m[0]):
                        out.append(("ip", m.start(), m.end()))
                else:  # no start inside this digit run can match either: all share its end
                    done["ip"] = _run_end(text, first)
            if first >= done["card"]:
                m = _CARD.match(text, first)
                if m:
                    done["card"] = m.end()
                    if _card_ok(m[0]):
                        out.append(("card", m.start(), m.end()))
        elif what == "at":
            start = first
            floor = done["email"]
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < first and (m := _DOMAIN.match(text, first + 1)):
                out.append(("email", start, m.end()))
                done["email"] = m.end()
        elif what == "plus":
            if first >= done["phone"] and (m := _PHONE.match(text, first)):
                done["phone"] = m.end()
                if _phone_ok(m[0]):
                    out.append(("phone", m.start(), m.end()))
        elif what == "scheme":
            if first >= done["url"] and (m := _AUTHORITY.match(text, last + 1)):
                out.append(("url", first, m.end()))
                done["url"] = m.end()
        else:
            for kind, pattern, ok in (("iban", _IBAN, _iban_ok), ("ssn", _SSN, lambda s: True), ("account", _ACCOUNT, lambda s: True)):
                if (m := pattern.match(text, last + 1)) and m.start(1) >= done[kind] and ok(m[1]):
                    out.append((kind, m.start(1), m.end(1)))
                    done[kind] = m.end(1)
                    break
    out.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return out


def _run_end(text: str, at: int) -> int:
    while at < len(text) and "0" <= text[at] <= "9":
        at += 1
    return at


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each run of overlapping spans becomes one placeholder, named for the span that begins it."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], PLACEHOLDER[kind]]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _per_text(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    anchors = automaton()
    for texts in batches:
        rows = []
        for t in texts:
            spans = find_spans(t, anchors) if isinstance(t, str) else []
            base = [s for s in spans if s[0] in BASE_KINDS]
            rows.append(
                (*[sum(s[0] == k for s in spans) for k in KINDS], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans))
            )
        yield pd.DataFrame(rows, columns=[*[f"n_{k}" for k in KINDS], "base_sha256", "spans"])


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and last the struct ``_pii``: counts by kind, digest of the base spans, and all spans.

    Whole texts are read, in time that grows with their length; null and empty
    texts have no spans; repeated rows give equal results; an empty table gives
    no rows. Columns of ``docs`` stay whatever their names: if one is called
    ``_pii``, the struct is ``_pii_``.
    """
    schema = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    found = F.pandas_udf(_per_text, schema)
    return docs.withColumn(free_name(docs.columns, "_pii"), found(F.col(text_col)))


def _redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    anchors = automaton()
    for texts in batches:
        yield pd.Series([redact(t, s) if isinstance(t, str) and (s := find_spans(t, anchors)) else t for t in texts], dtype=object)


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by a placeholder; the columns and their order stay, whatever their names.

    Null and empty texts stay as they are, very long ones are masked whole,
    repeated rows alike; of spans that overlap the first covers both. An empty
    table gives no rows.
    """
    return docs.withColumn(text_col, F.pandas_udf(_redacted, "string")(F.col(text_col)))


def report(docs: DataFrame) -> DataFrame:
    """Rows of query ``op3``."""
    names = [*[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans", *[f"n_{k}" for k in ADDED_KINDS]]
    return detect(docs.select("doc_id", "text")).select("doc_id", *[F.col(f"_pii.{n}").alias(n) for n in names])
