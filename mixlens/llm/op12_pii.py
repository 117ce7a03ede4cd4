"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Base kinds, leftmost and non-overlapping per kind, always reported: ``email``; ``ip`` (four parts of at most 255); ``card`` (16 to
19 digits that pass Luhn); ``phone`` (international, 8 to 15 digits).  A match that fails its check is dropped, and the
search goes on behind it.

Kinds the method adds: ``iban`` (its check digits pass mod 97), ``short_card`` (13 to 15 digits that pass Luhn, with a word of
cards nearby), ``local_phone`` (seven to eleven digits in two groups or more, with a word of phones nearby).  Each has a score of its kind,
raised or lowered by the words in the CONTEXT characters on either side of it (whole words, any case), and is reported from
THRESHOLD on.  Added spans never overlap a base span or one another; the better score stays, then the earlier span.

Offsets are code points, ends exclusive.  All searches are linear in the text.  Null and empty texts have no spans.  A null key
keeps its row; repeated rows are repeated; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from mixlens.llm import common

BASE, ADDED = ("email", "ip", "card", "phone"), ("iban", "short_card", "local_phone")
#: Score of a proposed span by kind; what a word of its kind adds, and what a word of another kind of number takes away.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "short_card": 0.35, "local_phone": 0.25}
CONTEXT, RAISE, LOWER, THRESHOLD = 60, 0.3, 0.3, 0.5
WORDS = {
    "email": {"email", "mail", "contact", "write", "correo", "courriel"},
    "ip": {"ip", "address", "host", "server", "client", "adresse"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "handy", "portable", "teléfono", "móvil", "téléphone"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
}
WORDS |= {"short_card": WORDS["card"], "local_phone": WORDS["phone"]}
#: Words that make a number something else than personal data.
OTHER = {"version", "invoice", "order", "isbn", "issn", "sku", "serial", "bestellung", "rechnung", "commande", "facture", "pedido", "factura"}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,4})?)(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![A-Za-z0-9+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20/.-]{1,2}[0-9]{2,5}){1,4}(?![A-Za-z0-9])")
_WORD = re.compile(r"[^\W\d_]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether a number's last digit checks it (ISO/IEC 7812)."""
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number's check digits fit (ISO 13616): the first four characters last, letters from 10 on, mod 97 is 1."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str):
    """The local part is the run before an @, so only such runs are looked at: words without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield m.span()


def _numbers(text: str, least: int, most: int):
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() < 2 * most and least <= len(d := _only_digits(m[0])) <= most and luhn(d):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.span()


def _ibans(text: str):
    for m in _IBAN.finditer(text):
        if 15 <= len(own := m[0].replace(" ", "")) <= 34 and mod97(own):
            yield m.span()


def _local_phones(text: str):
    for m in _LOCAL_PHONE.finditer(text):
        if 7 <= len(_only_digits(m[0])) <= 11:
            yield m.span()


def scored(text: str, kind: str, start: int, end: int) -> Span:
    """A span with its score: the words near it, the span itself and words cut by the window's edge left out, decide."""
    near = f"{text[max(0, start - CONTEXT) : start]} {text[end : end + CONTEXT]}"
    words = {w.lower() for w in _WORD.findall(near)}
    score = SCORES[kind] + RAISE * bool(words & WORDS[kind]) - LOWER * bool(words & OTHER)
    return Span(kind, start, end, round(min(max(score, 0.0), 1.0), 6))


def find(text: str | None) -> list[Span]:
    """All spans of a text, by kind as listed, then start."""
    if not text:
        return []
    has_digit = any(d in text for d in "0123456789")
    base = [scored(text, "email", *s) for s in emails(text)] if "@" in text else []
    if has_digit:
        for kind, spans in (("ip", _ips(text)), ("card", _numbers(text, 16, 19)), ("phone", _phones(text))):
            base += [scored(text, kind, *s) for s in spans]
        more = [scored(text, kind, *s) for kind, spans in (("iban", _ibans(text)), ("short_card", _numbers(text, 13, 15)), ("local_phone", _local_phones(text))) for s in spans]
        kept = _apart(base, [s for s in more if s.score >= THRESHOLD])
        order = {k: n for n, k in enumerate(ADDED)}
        base += sorted(kept, key=lambda s: (order[s.kind], s.start))
    return base


def _apart(base: list[Span], more: list[Span]) -> list[Span]:
    """The added spans that overlap neither base spans nor better ones of their own."""
    taken = sorted((s.start, s.end) for s in base)
    merged: list[list[int]] = []
    for a, b in taken:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    free, k = [], 0
    for s in sorted(more, key=lambda s: (s.start, s.end)):
        while k < len(merged) and merged[k][1] <= s.start:
            k += 1
        if k == len(merged) or merged[k][0] >= s.end:
            free.append(s)
    kept: list[Span] = []
    for s in free:  # by start: what overlaps overlaps its neighbour
        if kept and s.start < kept[-1].end:
            if s.score > kept[-1].score:
                kept[-1] = s
        else:
            kept.append(s)
    return kept


SPAN = T.StructType([*common.schema(kind=common.STR, start=common.LONG, end=common.LONG, score=common.DBL, value=common.STR)])


def spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans``: every row with its spans (kind, start, end, score, value)."""

    def run(batches):
        for keys, texts in common.text_batches(batches):
            found = [[{**s._asdict(), "value": t[s.start : s.end]} for s in find(t)] for t in texts]
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(found, arrow)], ["doc_id", "spans"])

    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("value", pa.string())]))
    return common.text_rows(df, key, text).mapInArrow(run, common.schema(doc_id=common.LONG, spans=T.ArrayType(SPAN)))


def masked(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text``: every row's text with each span replaced by ``[KIND]``; of spans that overlap the first to begin, then the longer."""

    def mask(t):
        out, at = [], 0
        for s in sorted(find(t), key=lambda s: (s.start, -s.end)):
            if s.start >= at:
                out += [t[at : s.start], f"[{s.kind.upper()}]"]
                at = s.end
        return None if t is None else "".join([*out, t[at:]])

    def run(batches):
        for keys, texts in common.text_batches(batches):
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array([mask(t) for t in texts], pa.string())], ["doc_id", "text"])

    return common.text_rows(df, key, text).mapInArrow(run, common.schema(doc_id=common.LONG, text=common.STR))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and digest of the base kinds, and all spans."""

    def run(batches):
        for keys, texts in common.text_batches(batches):
            rows = []
            for t in texts:
                found = find(t)
                told = [f"{s.kind}:{s.start}:{s.end}" for s in found]
                base = [x for s, x in zip(found, told, strict=True) if s.kind in BASE]
                rows.append((*(sum(s.kind == k for s in found) for k in BASE), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(told), max((s.score for s in found), default=0.0)))
            yield pa.record_batch([pa.array(keys, pa.int64()), *(pa.array(c, f) for c, f in zip(zip(*rows, strict=True), kinds, strict=True))], fields.names)

    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    fields = common.schema(doc_id=common.LONG, **dict.fromkeys([f"n_{k}" for k in BASE], common.LONG), base_sha256=common.STR, spans=common.STR, top_score=common.DBL)
    return common.text_rows(common.table(spark, sf_dir, "documents"), "doc_id", "text").mapInArrow(run, fields)
