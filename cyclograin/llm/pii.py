"""Personal data by anchor expansion.

One Aho-Corasick automaton runs over a text and stops at anchors: at-signs, a plus before a digit, a dot
between digits, digits, ``://`` of a scheme, and cues of identifiers. From each anchor a small
deterministic parser walks left and right to the boundaries of what may be there and validates it. Every
character is walked a bounded number of times, so very long texts cost time in proportion.

Kinds (the first four are the base, leftmost and non-overlapping each by itself; a candidate that
fails its check is consumed, not retried):

* ``email``: local part, at-sign, domain of two labels at least;
* ``ip``: four numbers joined by dots, each at most 255;
* ``card``: digits with at most one space or hyphen between two, 14 to 19 of them, Luhn sum right;
* ``phone``: plus, digits and ``space ( ) . -``, 10 to 15 digits;
* ``url``: an address that carries a user before its host (``scheme://user@host``); plain addresses are no
  personal data;
* ``account``: what follows a cue of :data:`CUES` (not inside a word) and one to four of ``space tab : = # .``:
  letters and digits with single hyphens, at most 34 characters of them and at least five digits. The span is
  the identifier without its cue. Each cue word is judged by itself.

Positions count code points, ends are exclusive. Spans of different kinds may overlap.

Edge cases: a null or empty text has no spans; repeated rows are judged each; only the named columns are
read, so other columns may have any name but ``spans``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclograin.llm import textkit

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
#: words that announce an identifier of a person, lower-case
CUES = ("account", "acct", "bsn", "iban", "konto", "nif", "passport", "ssn", "taxid")
SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("stop", "integer"))

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | {"-"}
_PHONE = _DIGITS | frozenset(" ().-")
_SCHEME = _ALNUM | frozenset("+.-")
_HOST = _ALNUM | frozenset(".-")
_USER_ENDS = frozenset("/@?#\"<>") | frozenset(map(chr, range(0x21)))
_URL_ENDS = frozenset("\"<>") | frozenset(map(chr, range(0x21)))
_CUE_GAP = frozenset(" \t:=#.")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("://", ("url", 3))
    for d in "0123456789":
        found.add_word(d, ("card", 1))
        found.add_word("+" + d, ("phone", 2))
        for e in "0123456789":
            found.add_word(f"{d}.{e}", ("ip", 3))
    for cue in CUES:
        found.add_word(cue, ("account", len(cue)))
    found.make_automaton()
    return found


def _run(text: str, at: int, chars: frozenset) -> int:
    """End of the run of ``chars`` that starts at ``at``."""
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def _back(text: str, at: int, chars: frozenset, least: int) -> int:
    """Start of the run of ``chars`` that ends before ``at``, not before ``least``."""
    while at > least and text[at - 1] in chars:
        at -= 1
    return at


def _email(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    start = _back(text, at, _LOCAL, free)
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    last = end
    while last < len(text) and text[last] == ".":
        label = _run(text, last + 1, _LABEL)
        if label == last + 1:
            break
        last = label
    return (start, last, True) if last > end else None


def _ip(text: str, dot: int, free: int) -> tuple[int, int, bool] | None:
    start = _back(text, dot, _DIGITS, free)
    if start == dot:
        return None
    cuts, end = [start], dot
    for _ in range(3):
        if end >= len(text) or text[end] != ".":
            return None
        cuts.append(end + 1)
        stop = _run(text, end + 1, _DIGITS)
        if stop == end + 1:
            return None
        end = stop
    cuts.append(end + 1)
    parts = [text[a : b - 1].lstrip("0") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return start, end, all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _card(text: str, start: int, free: int) -> tuple[int, int, bool]:
    """The chain of digits that begins here; a chain is consumed whatever it is."""
    at, n = start + 1, len(text)
    while at < n:
        if text[at] in _DIGITS:
            at += 1
        elif (text[at] == " " or text[at] == "-") and at + 1 < n and text[at + 1] in _DIGITS:
            at += 2
        else:
            break
    if not 14 <= at - start <= 37:
        return start, at, False
    digits = text[start:at].replace(" ", "").replace("-", "")
    return start, at, 14 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, plus: int, free: int) -> tuple[int, int, bool] | None:
    end = _run(text, plus + 2, _PHONE)
    while end > plus + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    if end < plus + 4 or text[end - 1] not in _DIGITS:
        return None
    return plus, end, 10 <= sum(c in _DIGITS for c in text[plus:end]) <= 15


def _url(text: str, colon: int, free: int) -> tuple[int, int, bool] | None:
    start = _back(text, colon, _SCHEME, free)
    while start < colon and not text[start].isalpha():
        start += 1
    at = user = colon + 3
    while at < len(text) and text[at] not in _USER_ENDS:
        at += 1
    if start == colon or at == user or at >= len(text) or text[at] != "@":
        return None
    host = _run(text, at + 1, _HOST)
    if host == at + 1:
        return None
    end = host
    while end < len(text) and text[end] not in _URL_ENDS:
        end += 1
    return start, end, True


def _account(text: str, cue: int, gap: int) -> tuple[int, int, bool] | None:
    """Identifier after the cue that begins at ``cue`` and ends before ``gap``."""
    if cue and text[cue - 1] in _ALNUM:
        return None
    start = gap
    while start < len(text) and start < gap + 4 and text[start] in _CUE_GAP:
        start += 1
    end = _run(text, start, _ALNUM)
    if start == gap or end == start:
        return None
    while end + 1 < len(text) and text[end] == "-" and text[end + 1] in _ALNUM:
        end = _run(text, end + 1, _ALNUM)
    if end - start > 67:
        return start, end, False
    body = text[start:end].replace("-", "")
    return start, end, len(body) <= 34 and sum(c in _DIGITS for c in body) >= 5


_PARSERS = {"email": (_email, 0), "ip": (_ip, 1), "card": (_card, 0), "phone": (_phone, 0), "url": (_url, 0)}


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind."""
    found: list[tuple[int, int, int]] = []
    free: dict[str, int] = {}
    for last, (kind, size) in automaton().iter(text.translate(_LOWER)):
        at = last - size + 1
        if kind == "account":
            slot = text[at : at + size].translate(_LOWER)
            if at < free.get(slot, 0):
                continue
            got = _account(text, at, last + 1)
        else:
            slot = kind
            parser, shift = _PARSERS[kind]
            least = free.get(kind, 0)
            if at + shift < least:
                continue
            got = parser(text, at + shift, least)
        if got is not None:
            free[slot] = got[1]
            if got[2]:
                found.append((got[0], KINDS.index(kind), got[1]))
    return [(KINDS[k], a, b) for a, k, b in sorted(set(found))]


def find(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """``carry`` and ``spans``: kind, start and stop of all personal data of each whole text."""
    rows = docs.select(*carry, F.col(text_col).alias("_text"))
    schema = rows.drop("_text").schema.add("spans", SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        for piece, texts in textkit.chunks(batches, "_text"):
            got = [[{"kind": k, "start": a, "stop": b} for k, a, b in spans(textkit.decoded(t))] for t in texts]
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(got, kind)], names=schema.names)

    return rows.mapInArrow(run, schema)


def listed(found: Column) -> Column:
    """Spans as ``kind:start:stop``, comma-joined."""
    parts = F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(parts, ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; overlapping spans become one."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in textkit.chunks(batches, text_col):
            clean = [None if t is None else masked(textkit.decoded(t)) for t in texts]
            yield piece.set_column(at, piece.schema.field(at), pa.array(clean, piece.schema.field(at).type))

    return docs.mapInArrow(run, schema)


def masked(text: str) -> str:
    out, done = [], 0
    for kind, start, stop in spans(text):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, stop)
    return "".join([*out, text[done:]])
