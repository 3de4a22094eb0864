"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes and the words that
introduce an identifier. At each anchor a small parser expands to the boundaries of what may stand there and
validates it. Parsers keep a cursor per kind, so the spans of a kind never overlap and are the leftmost ones.

Base kinds: ``email``, ``ip`` (parts up to 255), ``card`` (12 to 19 digits, Luhn), ``phone`` (9 to 15 digits).
Added kinds: ``login`` (a URL with user information), ``account`` (an identifier with six or more digits after a
word such as "account" or "IBAN"; two letters and two digits in front mean an IBAN and must pass its checksum),
``secret`` (a value of eight or more characters assigned to a word such as "token").

Positions count code points, ends are exclusive. Defined results: a null or empty text has no spans; rows with
null or repeated ids get a result each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import table, text_batches
from .textblocks import column_bytes

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "account", "secret")

SCHEMES = ("http://", "https://", "ftp://", "ssh://")
ACCOUNT_CUES = ("account", "acct", "iban", "konto", "compte", "cuenta", "passport")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_USER = re.compile(r"[^\s/@?#\"'<>]+@[A-Za-z0-9.-]+(?::[0-9]+)?")
_ACCOUNT = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?|id))?[\x20:#=]{1,3}([A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]{1,4}){2,8}|[0-9](?:[\x20-]?[0-9]){5,33})(?![A-Za-z0-9])", re.IGNORECASE | re.ASCII)
_SECRET = re.compile(r"\x20?[:=]\x20?[\"']?([A-Za-z0-9_./+=-]{8,})")
_NOT_DIGIT = re.compile(r"[^0-9]+")


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in (("@", "at"), ("+", "plus"), *((str(d), "digit") for d in range(10))):
        found.add_word(word, (kind, 1))
    for words, kind in ((SCHEMES, "scheme"), (ACCOUNT_CUES, "account"), (SECRET_CUES, "secret")):
        for word in words:
            for form in {word, word.upper(), word.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban(text: str) -> bool:
    plain = text.replace(" ", "").upper()
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans ``(kind, start, end)`` by start, then by the order of ``KINDS``."""
    spans: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)
    last_at, last_digit = -1, -2
    for end, (kind, width) in _anchors().iter(text):
        at = end + 1 - width
        if kind == "digit":
            run, last_digit = last_digit == at - 1, at
            if run:
                continue
            # Each pattern starts at the first digit of a run, or at the first one after the span before.
            if at >= done["ip"] and (m := _IP.match(text, at)):
                done["ip"] = m.end()
                if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.groups()):
                    spans.append(("ip", at, m.end()))
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                digits = _NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", at, m.end()))
        elif kind == "at":
            low = max(done["email"], last_at + 1)
            start = low + len(text[low:at].rstrip(_LOCAL))
            last_at = at
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                spans.append(("email", start, m.end()))
                done["email"] = m.end()
        elif kind == "plus":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    spans.append(("phone", at, m.end()))
        elif kind == "scheme":
            if at >= done["login"] and (m := _USER.match(text, end + 1)):
                done["login"] = m.end()
                spans.append(("login", at, m.end()))
        elif kind == "account":
            if (m := _ACCOUNT.match(text, end + 1)) and m.start(1) >= done["account"]:
                value = m[1]
                if iban(value) if value[0].isalpha() else True:
                    done["account"] = m.end(1)
                    spans.append(("account", m.start(1), m.end(1)))
        elif (m := _SECRET.match(text, end + 1)) and m.start(1) >= done["secret"]:
            done["secret"] = m.end(1)
            spans.append(("secret", m.start(1), m.end(1)))
    order = {k: n for n, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[1], order[s[0]]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first one names all."""
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, start, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _texts(column: pa.Array) -> Iterator[str]:
    data, offsets = column_bytes(column)
    at = offsets.tolist()
    for a, b in zip(at, at[1:]):
        yield data[a:b].tobytes().decode("utf-8", "replace")


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[dict(zip(("kind", "start", "end"), s)) for s in find_spans(t)] for t in _texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], names=["doc_id", "spans"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (array of kind, start, end) of every row."""
    text_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(_find, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of ``text_col`` replaced; null texts stay null and other columns are untouched."""
    text_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            new = [redact(t, spans) if (spans := find_spans(t)) else t for t in _texts(column)]
            arrays = list(batch.columns)
            arrays[place] = pa.array(new, column.type, mask=column.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
