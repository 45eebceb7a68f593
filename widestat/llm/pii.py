"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors in one pass over the text: at-signs,
plus signs, digits, URL schemes and the cue words of identifiers.  Each anchor
is expanded by a small parser that fixes the boundaries and validates the find.

Kinds ``email``, ``ip``, ``card`` and ``phone`` give exactly the leftmost
non-overlapping matches of these patterns, less those that fail the check
behind them (a failed match is dropped and not tried again):

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts at most 255
* card ``[0-9]([\\x20-]?[0-9])+``, 13 to 19 digits, Luhn sum
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits

Kinds of the method's own: ``url`` (an address with user information, or one
that names a person's page), ``account`` (an identifier behind a cue such as
``account`` or ``iban``, or a bare ``@handle``) and ``secret`` (a value behind
``password``, ``token`` and the like).

Offsets are code points, the end exclusive.  A null text counts as empty; an
empty text has no spans.  Repeated rows are each scanned; a null id stays null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widestat.llm.common import text_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")

# Cue words; each is also an anchor in its capitalized and upper-case form.
ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "passport", "customer id", "member id", "user id")
SECRET_CUES = ("password", "passwd", "pwd", "secret", "token", "api key", "api_key", "apikey", "access_key")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
DIGIT_RUN = re.compile(r"[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
URL_REST = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+")
PERSONAL_PATH = re.compile(r"^[^/?#]+/(?:~|@|(?:u|user|users|profile|people|in)/)[^/?#]+")
HANDLE = re.compile(r"[A-Za-z0-9_]{3,}")
ACCOUNT_VALUE = re.compile(r"(?:\s*(?:number|no\.?|nr\.?|id|#))?\s*[:=#]?\s*([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){4,33})")
SECRET_VALUE = re.compile(r"\s*[:=]\s*[\"']?([^\s\"',;]{6,})")


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn checksum."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = ord(ch) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def anchors():
    """The automaton; its values are anchor classes and lengths."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    for ch in DIGITS:
        auto.add_word(ch, ("digit", 1))
    auto.add_word("@", ("at", 1))
    auto.add_word("+", ("plus", 1))
    auto.add_word("://", ("scheme", 3))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.title(), cue.upper()}:
                auto.add_word(form, (kind, len(form)))
    auto.make_automaton()
    return auto


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The e-mail address whose at-sign stands at ``at``; ``floor`` is the end
    of the one before, which its local part may not reach into."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    domain = DOMAIN.match(text, at + 1)
    return (start, domain.end()) if domain else None


def address_at(text: str, sep: int) -> tuple[int, int] | None:
    """The URL whose ``://`` starts at ``sep``, if it points at a person."""
    start = sep
    while start > 0 and sep - start < 12 and text[start - 1] in SCHEME:
        start -= 1
    while start < sep and not text[start].isalpha():
        start += 1
    rest = URL_REST.match(text, sep + 3)
    if start == sep or not rest:
        return None
    end = rest.end()
    while end > sep + 3 and text[end - 1] in ".,;:!?)":
        end -= 1
    body = text[sep + 3:end]
    authority = re.split(r"[/?#]", body, maxsplit=1)[0]
    if "@" in authority or PERSONAL_PATH.match(body):
        return start, end
    return None


def scan(text: str, auto) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by kind as listed in KINDS, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = ip_skip = card_skip = phone_end = url_end = account_end = secret_end = 0
    handles = []
    for last, (kind, length) in auto.iter(text):
        pos = last - length + 1
        if kind == "digit":
            if pos >= card_skip:
                m = CARD.match(text, pos)
                if m:
                    digits = NOT_DIGIT.sub("", m.group())
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
                card_skip = m.end() if m else pos + 1
            if pos >= ip_skip:
                m = DOTTED.match(text, pos)
                if m and all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                    found["ip"].append(m.span())
                ip_skip = m.end() if m else DIGIT_RUN.match(text, pos).end()
        elif kind == "at":
            span = email_at(text, pos, email_end)
            if span:
                found["email"].append(span)
                email_end = span[1]
            elif pos >= email_end and (pos == 0 or text[pos - 1] not in LOCAL):
                handles.append(pos)
        elif kind == "plus":
            if pos >= phone_end:
                m = PHONE.match(text, pos)
                if m:
                    phone_end = m.end()
                    if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                        found["phone"].append(m.span())
        elif kind == "scheme":
            span = address_at(text, pos) if pos >= url_end else None
            if span:
                found["url"].append(span)
                url_end = span[1]
        elif pos == 0 or text[pos - 1] not in ALNUM:  # a cue at a word start
            m = (ACCOUNT_VALUE if kind == "account" else SECRET_VALUE).match(text, last + 1)
            if kind == "account" and m and pos >= account_end and last + 1 < m.start(1):
                value = m.group(1)
                head = re.match(r"[A-Za-z0-9-]*[0-9][A-Za-z0-9-]*(?: [A-Za-z]*[0-9][A-Za-z0-9]*)*", value)
                if head and sum(c in DIGITS for c in head.group()) >= 4:
                    account_end = m.start(1) + head.end()
                    found["account"].append((m.start(1), account_end))
            elif kind == "secret" and m and pos >= secret_end:
                secret_end = m.end(1)
                found["secret"].append(m.span(1))
    for pos in handles:
        m = HANDLE.match(text, pos + 1)
        if m and not any(s <= pos < e for s, e in found["url"]):
            found["account"].append((pos, m.end()))
    found["account"].sort()
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>), one row for each input row."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = anchors()
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t, auto)] if t else []
                     for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], ["id", "spans"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
            .mapInArrow(run, f"id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")
            .withColumnRenamed("id", id_col))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, their SHA-256 and all spans as text."""
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(id_col, *(count(k) for k in BASE_KINDS),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets;
    overlapping spans go under the one that starts first."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join(out) + text[at:]
