"""PII by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, URL schemes, identifier cues
(iban, account, ...), plus signs and digits.  A deterministic local parser for the kind
expands each anchor to its boundaries and validates it:

* email   at-sign: local part to the left, domain labels to the right
* ip      first digit of a run: four dotted parts up to 255
* card    first digit of a run: 13 to 19 digits that pass Luhn
* phone   plus sign: 9 to 15 digits
* address scheme: http, https, ftp or mailto up to white space or a quote, trailing punctuation off
* account identifier cue: an IBAN with check digits mod 97 = 1, or 6 to 20 digits after an account cue

The first four are the base kinds: their spans are exactly the leftmost non-overlapping
matches of the contract's patterns, failing ones dropped without a retry.  address and
account only add spans.  Offsets are code points, ends exclusive.

Scoring is one pass without a shuffle; a text is held by one task only.  Defined results: a
null text is an empty one and has no span; a null doc_id stays null and its row is found like
any other; repeated rows and equal texts are found alike, each a row; spans of several kinds that start at one place are all
kept, in the order of kinds; texts of any length are searched whole; an empty table gives an
empty result; only doc_id and text are read, whatever other columns are named.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s\"'<>()\[\]{}]+")
_IBAN = re.compile(r"[\s:#.=-]{0,4}([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?:\s*(?:number|no\.?|nr\.?|id))?[\s:#.=-]{0,4}([0-9](?:[ -]?[0-9]){5,19})", re.I)


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for c in CUES:
        a.add_word(c, ("cue", len(c)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _fold(text: str) -> str:
    """Lower case for cues and schemes, code point for code point."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _iban_end(text: str, start: int, end: int) -> int:
    """The longest valid prefix of an IBAN candidate, or -1."""
    while end - start >= 15:
        if text[end - 1] != " " and iban_valid(text[start:end]):
            return end
        end -= 1
    return -1


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by kind as listed, then start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    ends = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended, kept or not
    last_digit = -2
    for last, (what, width) in automaton().iter(_fold(text)):
        at = last - width + 1
        if what == "digit":
            run = last_digit == at - 1
            last_digit = at
            if at >= ends["ip"] and not (run and at > ends["ip"]) and (m := _IP.match(text, at)):
                ends["ip"] = m.end()
                if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
                    found["ip"].append(m.span())
            if at >= ends["card"] and (m := _CARD.match(text, at)):
                ends["card"] = m.end()
                if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                    found["card"].append(m.span())
        elif what == "plus":
            if at >= ends["phone"] and (m := _PHONE.match(text, at)):
                ends["phone"] = m.end()
                if 9 <= len(_digits(m[0])) <= 15:
                    found["phone"].append(m.span())
        elif what == "at":
            start = at
            while start > ends["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                ends["email"] = m.end()
                found["email"].append((start, m.end()))
        elif what == "scheme":
            if at >= ends["address"] and not (at and text[at - 1].isalnum()) and (m := _URL.match(text, last + 1)):
                end = m.end()
                while end > last + 1 and text[end - 1] in ".,;:!?":
                    end -= 1
                if end > last + 1:
                    ends["address"] = end
                    found["address"].append((at, end))
        elif at >= ends["account"] and not (at and text[at - 1].isalnum()):
            span = None
            if m := _IBAN.match(text, last + 1):
                end = _iban_end(text, m.start(1), m.end(1))
                span = (m.start(1), end) if end > 0 else None
            if span is None and (m := _ACCOUNT.match(text, last + 1)):
                span = m.span(1)
            if span:
                ends["account"] = span[1]
                found["account"].append(span)
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> for every row of `docs`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            every = [spans(t) for t in pdf["text"]]
            joined = [",".join(f"{k}:{a}:{b}" for k, a, b in s) for s in every]
            base = [",".join(f"{k}:{a}:{b}" for k, a, b in s if k in BASE) for s in every]
            out = pd.DataFrame({"doc_id": pdf["doc_id"]})
            for kind in KINDS:
                out[f"n_{kind}"] = [sum(k == kind for k, _, _ in s) for s in every]
            out["base_sha256"] = [hashlib.sha256(b.encode()).hexdigest() for b in base]
            out["spans"] = joined
            yield out

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    # as text, so that a missing id or an id beyond 2^53 passes through pandas unchanged
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.mapInPandas(run, f"doc_id string, {counts}, base_sha256 string, spans string")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def redacted(text: str | None) -> str:
    """The text with every span replaced by <kind>; of overlapping spans the first and longest counts."""
    out, at = [], 0
    for k, a, b in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{k}>"]
            at = b
    return "".join([*out, (text or "")[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with personal data in text replaced; a null text stays null."""
    clean = F.pandas_udf(lambda s: s.map(redacted, na_action="ignore"), "string")
    return docs.withColumn("text", clean(F.col("text")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_address", "n_account"
    )
