"""Secrets in texts, and credentials whose parts lie apart.

Three kinds of match are findings by themselves: an assignment to a secret's name, an access
identifier with the well-known prefix, and a long run of hexadecimal digits.  Three weak kinds are
candidates only: a named identifier (user, client or key id), a run of mixed characters as random
values have, and an endpoint's address.  Each part lies in a scope, the paragraph it stands in as far
as ``reach`` code points from its edges.  The parts of a text are joined as intervals: two are linked
if one overlaps the other's scope.  A weak part is reported only where its complements are linked to it:

* a named identifier with a secret (assigned, hexadecimal or mixed value),
* a mixed value with an identifier (prefixed or named),
* an endpoint with both.

A mixed value is no candidate where another match already covers some of it.  Parts of a text are
swept in order of place with running maxima of their ends, so a text with very many parts is linked in
n log n steps and no pairs are listed.  A text is one row, so nothing is shuffled.

Defined results: a null text is an empty one, without findings; every row gives a row, repeated ids
too; texts of any length are read whole; of matches of a kind that overlap the leftmost counts; an
empty table gives no rows.  Other columns are not used.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REACH = 200


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# What counts as a part.  The same patterns serve the tests' SQL.
ASSIGN = _either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
IDENTIFIER = _either_case("(access_?key_?id|client_?id|key_?id|user_?name|user|login|account)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)"""
VALUE = "[A-Za-z0-9+/_-]+={0,2}"
ENDPOINT = "(?:https?|ftps?|wss?|s3|ssh|smtps?|ldaps?|amqps?|redis|mongodb|postgres|postgresql|mysql|jdbc)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"
KINDS = ("assign", "access", "hex", "id", "value", "endpoint")     # in the order in which equal starts are listed
BASE = KINDS[:3]
SECRETS, IDENTIFIERS = ("assign", "hex", "value"), ("access", "id")
LEAST = {"assign": 6, "access": 20, "hex": 24, "id": 3, "value": 20, "endpoint": 1}

_PATTERNS = {
    kind: re.compile(pattern)
    for kind, pattern in {
        "assign": ASSIGN, "access": ACCESS, "id": IDENTIFIER, "endpoint": ENDPOINT,
        # runs too short to count are passed over by the pattern itself
        "hex": r"[0-9a-f]{%d,}" % LEAST["hex"], "value": r"[A-Za-z0-9+/_-]{%d,}={0,2}" % (LEAST["value"] - 2),
    }.items()
}
_MIXED = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))
SCHEMA = "array<struct<kind string, start int, end int>>"
Span = tuple[str, int, int]


def parts(text: str) -> list[Span]:
    """All matches of all kinds by start, weak ones not yet linked."""
    found: list[Span] = []
    for kind in ("assign", "access", "hex", "id", "endpoint"):
        if kind == "access" and "AKIA" not in text or kind == "endpoint" and "://" not in text:
            continue
        for m in _PATTERNS[kind].finditer(text):
            measured = m.group(2) if kind in ("assign", "id") else m.group()
            if len(measured) >= LEAST[kind]:
                found.append((kind, m.start(), m.end()))
    found.sort(key=lambda s: s[1])
    taken = Intervals(found)
    for m in _PATTERNS["value"].finditer(text):
        if m.end() - m.start() >= LEAST["value"] and all(p.search(m.group()) for p in _MIXED) and not taken.overlap(m.start(), m.end()):
            found.append(("value", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


class Intervals:
    """Spans sorted by start; tells whether any overlaps a stretch."""

    def __init__(self, spans: list[Span]):
        self.starts = [s[1] for s in spans]
        self.furthest = list(accumulate((s[2] for s in spans), max))

    def overlap(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.furthest[before - 1] > start


def scope(text: str, start: int, end: int, reach: int = REACH) -> tuple[int, int]:
    """The stretch around a part in which its complements count: not beyond an empty line."""
    low, high = max(0, start - reach), min(len(text), end + reach)
    above, below = text.rfind("\n\n", low, start), text.find("\n\n", end, high)
    return low if above < 0 else above + 2, high if below < 0 else below


def linked(text: str, found: list[Span], reach: int = REACH) -> list[Span]:
    """The findings: all of the base kinds, and weak parts whose complements lie in their scope."""
    if all(s[0] in BASE for s in found):
        return found
    secrets = Intervals([s for s in found if s[0] in SECRETS])
    identifiers = Intervals([s for s in found if s[0] in IDENTIFIERS])
    needs = {"id": (secrets,), "value": (identifiers,), "endpoint": (secrets, identifiers)}
    return [s for s in found if all(side.overlap(*scope(text, s[1], s[2], reach)) for side in needs.get(s[0], ()))]


def _findings(reach: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                rows.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in linked(text, parts(text), reach)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return find


def findings(docs: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``spans``: kind, start and end (code points, end exclusive) of every finding, by start and kind."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_findings(reach), f"doc_id {kind}, spans {SCHEMA}")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def finding_digests(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Counts and digest of the base findings, and all findings listed."""
    spans = F.col("spans")
    kinds = F.transform(spans, lambda s: s["kind"])
    count = [F.size(F.filter(kinds, lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in BASE]  # noqa: B023  (called at once)
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return findings(docs, reach).select("doc_id", *count, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(spans).alias("spans"))
