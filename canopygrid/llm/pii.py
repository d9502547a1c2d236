"""Personal data by anchor expansion.

One Aho-Corasick pass finds at-signs, plus-signs, schemes, digits and cues of identifiers; a parser for each kind expands the anchor
to its boundaries and validates it. Addresses of hosts and cards have no cue but their digits: a run of digits is parsed at its first.

Nulls: a null text is empty. Empty text: no spans. Very long texts are scanned whole; what an anchor has expanded over isn't expanded
again for later ones of its kind, so time is in proportion to the text. Offsets are code points, end exclusive. Repeated rows are
scanned each for itself. Empty table: empty result.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base kinds in their order, then those that the anchors add.
BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "ssn", "account", "secret")
KINDS = {kind: i for i, kind in enumerate(BASE + ADDED)}

#: Cue words of each kind.
CUES = {
    "url": ("http://", "https://", "ftp://", "HTTP://", "HTTPS://", "www."),
    "iban": ("IBAN", "iban", "Iban"),
    "ssn": ("SSN", "ssn", "social security"),
    "account": ("account", "Account", "acct", "Konto", "cuenta", "compte"),
    "secret": ("token", "secret", "password", "api_key", "apikey", "Token", "Secret", "Password", "API_KEY"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9](?:[\x20.-]?[0-9])*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\x00-\x20<>\"'|\\^`{}]+")
_IBAN = re.compile(r"[\x20:=#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SSN = re.compile(r"[^0-9\n]{0,12}?([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
_ACCOUNT = re.compile(r"(?:\x20?(?:no|nr|number|num)\.?)?[\x20:=#]{0,3}([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])")
_SECRET = re.compile(r"[\x20]{0,2}[:=][\x20]{0,2}[\"']?([A-Za-z0-9_+/=-]{16,})")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    for digit in "0123456789":
        a.add_word(digit, ("digit", 1))
    for kind, cues in CUES.items():
        for cue in cues:
            a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def _url(text: str, start: int, scheme: int, run_end: int) -> tuple[int, int] | None:
    """The address at ``start`` in a run of characters up to ``run_end``, without the marks and open brackets that close the sentence around it."""
    if start and text[start - 1].isalnum():
        return None
    host = start + (0 if text[start] == "w" else scheme)
    slash = text.find("/", host, run_end)
    if slash >= 0 and "." not in text[host:slash].strip("."):
        return None
    end, open_ = run_end, None
    while end > start and (c := text[end - 1]) in ".,;:!?*)]":
        if c in ")]":
            # How many brackets of each kind are open is counted once, and kept while marks are taken off.
            open_ = open_ or {x: text.count(x, start, end) - text.count(y, start, end) for x, y in ((")", "("), ("]", "["))}
            if open_[c] <= 0:
                break
            open_[c] -= 1
        end -= 1
    return (start, end) if "." in text[host : max(host, slash if slash >= 0 else end)].strip(".") else None


def _mod97(code: str) -> bool:
    plain = code.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _numbers(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """Addresses of hosts and cards in a run of digits."""
    out = []
    for m in _DOTTED.finditer(text, start, end):
        # Four parts are an address, and the next four another one, whether they are valid or not.
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            stop = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", at, stop))
            at = stop + 1
    for m in _CARD.finditer(text, start, end):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    return out


def spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All (kind, start, end), by start, then kind."""
    out: list[tuple[str, int, int]] = []
    mail_end = url_end = run_end = number_end = secret_end = 0
    for last, (kind, size) in anchors.iter(text):
        start, after = last + 1 - size, last + 1
        if kind == "digit":
            if start >= number_end:
                number_end = _NUMBERS.match(text, start).end()
                out += _numbers(text, start, number_end)
        elif kind == "@":
            if last >= mail_end and (found := _email(text, last, mail_end)):
                out.append(("email", *found))
                mail_end = found[1]
        elif kind == "+":
            if (m := _PHONE.match(text, start)) and 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append(("phone", start, m.end()))
        elif kind == "url":
            if start >= run_end:
                run_end = _URL.match(text, start).end()
            if start >= url_end and (found := _url(text, start, size, run_end)):
                out.append(("url", *found))
                url_end = found[1]
        elif kind == "iban":
            if (m := _IBAN.match(text, after)) and _mod97(m[1]):
                out.append(("iban", m.start(1), m.end(1)))
        elif kind == "ssn":
            if m := _SSN.match(text, after):
                out.append(("ssn", m.start(1), m.end(1)))
        elif kind == "account":
            if m := _ACCOUNT.match(text, after):
                out.append(("account", m.start(1), m.end(1)))
        elif start >= secret_end and (m := _SECRET.match(text, after)):
            # A cue inside a secret is part of it.
            out.append(("secret", m.start(1), m.end(1)))
            secret_end = m.end(1)
    return sorted(set(out), key=lambda s: (s[1], KINDS[s[0]], s[2]))


def found(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` (array of ``kind``, ``start``, ``end``) of every document."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        anchors = automaton()
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end"), s)) for s in spans(t.as_py() or "", anchors)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, spans array<struct<kind string, start long, end long>>")


def redacted(text: str, anchors: ahocorasick.Automaton) -> str:
    """``text`` with each span, overlapping ones as one, put as its first kind in brackets."""
    out, at = [], 0
    for kind, start, end in spans(text, anchors):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digest(found_spans: DataFrame) -> DataFrame:
    """Counts of all kinds, digest of the base kinds, and all spans as text."""
    said = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found_spans.select("doc_id", *map(of, BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), *map(of, ADDED))


