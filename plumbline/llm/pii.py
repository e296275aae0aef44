"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust a score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import trim

#: Kinds in the order of results; the first four are the base kinds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")

# The proposal patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits matches from its start or not at all, so later starts in it need no trial.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b")

# Characters before the @ of an address, and words that speak for or against a kind.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
FOR = {
    "email": ("mail", "contact", "write", "address", "schreib", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "client", "login"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "appelez", "llame"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
AGAINST = {
    "email": ("example", "noreply"),
    "ip": ("version", "release", "section"),
    "card": ("order", "serial", "isbn", "tracking"),
    "phone": ("serial", "order", "invoice"),
    "iban": ("serial", "licence", "license"),
}
FOR, AGAINST = ({k: frozenset(v) for k, v in x.items()} for x in (FOR, AGAINST))
WORD = re.compile(r"[^\W\d_]+")
#: Of an added kind: with less, by words nearby that speak against it, the span is left out.
LEAST_SCORE = 0.8
START = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.5, "iban": 0.9}
STEP, WINDOW = 0.15, 40


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards; the same spans as a scan from the left, in time linear in the text."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            done = max(done, at + 1)
            at = text.find("@", at + 1)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def spans_of(text: str, least: float = LEAST_SCORE) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start; a match that fails its check is dropped without another trial.

    Base kinds stand by their pattern and check alone; an added kind needs a score of `least` too.
    """
    out = [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    for m in IBAN.finditer(text):
        code = m[0].replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code) and score(text, "iban", m.start(), m.end()) >= least:
            out.append(("iban", m.start(), m.end()))
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    """0 to 1: the kind's own weight, raised or lowered by each of its whole words that lies within the `WINDOW`
    characters on either side. Words that the window's or the span's borders cut don't count."""
    near = _whole_words(text, max(0, start - WINDOW), start) | _whole_words(text, end, min(len(text), end + WINDOW))
    s = START[kind] + STEP * len(near & FOR[kind]) - STEP * len(near & AGAINST[kind])
    return min(1.0, max(0.0, s))


def _whole_words(text: str, a: int, b: int) -> set[str]:
    """Runs of letters in text[a:b] that don't go on beyond it, in lower case."""
    while 0 < a < b and text[a - 1].isalpha() and text[a].isalpha():
        a += 1
    while a < b < len(text) and text[b - 1].isalpha() and text[b].isalpha():
        b -= 1
    return {w.lower() for w in WORD.findall(text[a:b])}


def masked(text: str, least: float = LEAST_SCORE) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    found = sorted(((a, b, k) for k, a, b in spans_of(text, least)), key=lambda x: (x[0], -x[1]))
    if not found:
        return text
    out, done = [], 0
    for a, b, kind in found:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def _joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Spans of every whole text, one row per document and no shuffle.

    (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_iban, scores): positions are code points, ends
    exclusive. A null or empty text has no spans (empty strings, digest of no bytes). Repeated rows give repeated
    results; other columns are ignored. IBANs count from a score of `least` on. `scores` follows the order of `spans`, two decimals each.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            digests, spans, scores = [], [], []
            for value in batch.column("t"):
                text = value.as_py() or ""
                found = spans_of(text, least)
                for k in KINDS:
                    counts[k].append(sum(f[0] == k for f in found) if found else 0)
                digests.append(hashlib.sha256(_joined(f for f in found if f[0] in BASE).encode()).hexdigest())
                spans.append(_joined(found))
                scores.append(",".join(f"{score(text, *f):.2f}" for f in found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests), pa.array(spans), pa.array(counts["iban"], pa.int64()), pa.array(scores)],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_iban", "scores"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_iban long, scores string")


def mask(docs: DataFrame, text_column: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The same rows and columns with personal data in the texts replaced by kind names; null stays null."""
    at = docs.columns.index(text_column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (t := v.as_py()) is None else masked(t, least) for v in batch.column(at)]
            columns = batch.columns
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            del texts, columns
            trim()

    return docs.mapInArrow(run, docs.schema)
