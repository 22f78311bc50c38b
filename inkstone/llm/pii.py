"""Personal data by anchor expansion.

One Aho-Corasick pass over a text reports anchors: at-signs, plus-signs, digits, address schemes and identifier cues.
From each anchor a deterministic local parser expands to both sides and validates the boundaries. Every parser moves
forward over its own matches, so a text of any length is read a bounded number of times.

Kinds: email, ip, card, phone (the base kinds: leftmost, not overlapping within a kind, a failing candidate dropped and not
retried), then account (after a cue: a valid IBAN or 6 to 17 digits), secret (a cue and a key of 16 characters or more) and
url (an address with user information, or mailto: and tel: targets).

Defined cases: a very long text is searched whole; null text counts as empty (no spans); rows are independent, so repeated rows repeat their result; spans of
different kinds may overlap, and redaction then replaces their union once; a null doc_id is kept; further columns of the
input are ignored; an empty table gives an empty result. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from inkstone.llm.common import map_batches, texts_of

KINDS = ("email", "ip", "card", "phone", "account", "secret", "url")
BASE_KINDS = KINDS[:4]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ACCOUNT = re.compile(r"(?:[ ]?(?:no|nr|number)\b\.?)?[ ]?[:#=]?[ ]{0,2}([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}|[0-9](?:[ -]?[0-9]){5,16})(?![A-Za-z0-9])")
SECRET = re.compile(r"[ ]{0,2}[:=][ ]{0,2}[\"']?([A-Za-z0-9_/+-]{16,})")
TARGET = re.compile(r"[^\s\"'<>]+")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
ACCOUNT_CUES = ("iban", "account", "acct", "passport", "ssn")
SECRET_CUES = ("token", "api_key", "apikey", "password", "secret")
NOT_DIGIT = str.maketrans("", "", " -")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_valid(code: str) -> bool:
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for scheme in ("://", "mailto:", "tel:"):
        a.add_word(scheme, ("scheme", len(scheme)))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), sorted."""
    out: list[tuple[int, int, int]] = []
    done = [0] * len(KINDS)
    n = len(text)
    for last, (what, size) in anchors().iter(text):
        at = last + 1 - size
        if what == "digit":
            if at and "0" <= text[at - 1] <= "9":
                continue
            if at >= done[1] and (m := IP.match(text, at)):
                done[1] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                    out.append((1, at, m.end()))
            if at >= done[2]:
                m = CARD.match(text, at)
                done[2] = m.end()
                if m.end() - at >= 13:
                    digits = m[0].translate(NOT_DIGIT)
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        out.append((2, at, m.end()))
        elif what == "at":
            start = at
            while start > done[0] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                out.append((0, start, m.end()))
                done[0] = m.end()
        elif what == "plus":
            if at >= done[3] and (m := PHONE.match(text, at)):
                done[3] = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((3, at, m.end()))
        elif what == "scheme":
            start, end = at, last + 1
            if text[at] == ":":
                while start > max(done[6], at - 12) and text[start - 1] in SCHEME:
                    start -= 1
            if (start < at or text[at] != ":") and start >= done[6] and (m := TARGET.match(text, end)):
                to = m.end()
                while to > end and text[to - 1] in ".,;:!?)]}":
                    to -= 1
                done[6] = to
                authority = re.split(r"[/?#]", text[end:to], maxsplit=1)[0]
                if to > end and (text[at] != ":" or "@" in authority):
                    out.append((6, start, to))
        elif at == 0 or not text[at - 1].isalnum():
            kind, pattern = (4, ACCOUNT) if what == "account" else (5, SECRET)
            if last + 1 < n and at >= done[kind] and (m := pattern.match(text, last + 1)):
                value = m[1]
                code = value.translate(NOT_DIGIT)
                if kind == 5 or "0" <= value[0] <= "9" or iban_valid(code):
                    out.append((kind, m.start(1), m.end(1)))
                    done[kind] = m.end(1)
    out.sort()
    return out


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each run of overlapping spans becomes the name of its first kind in brackets."""
    out, at, end = [], 0, 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= end:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        end = at = max(end, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each document."""

    def run(batches):
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            sha, rendered = [], []
            for text in batch.column("text").to_pylist():
                spans = find_spans(text or "")
                base = [s for s in spans if s[0] < 4]
                for k in range(4):
                    counts[k].append(sum(s[0] == k for s in base))
                sha.append(hashlib.sha256(render(base).encode()).hexdigest())
                rendered.append(render(spans))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id")} | {f"n_{KINDS[k]}": pa.array(counts[k], pa.int64()) for k in range(4)} | {"base_sha256": pa.array(sha, pa.string()), "spans": pa.array(rendered, pa.string())}
            )

    return map_batches(texts_of(docs), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_documents(docs: DataFrame) -> DataFrame:
    """documents with every span replaced and n_chars counted anew; the other columns stay. Null text stays null."""

    def run(batches):
        for batch in batches:
            texts = [t and redact(t, find_spans(t)) for t in batch.column("text").to_pylist()]
            names = batch.schema.names
            cols = {k: batch.column(i) for i, k in enumerate(names)}
            cols["text"] = pa.array(texts, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_pydict(cols)

    return map_batches(docs, run, docs.schema)
