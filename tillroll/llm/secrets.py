"""Secret scans with multipart credential linking.

Strong patterns (assignments of secrets, access keys, long hex strings) are always reported.  Weak
candidates (other access identifiers, key-like strings, endpoints) mean little alone: an interval join
within the scope of a paragraph reports them only where a part of another role occurs too, also inside
or around them.  `find_secrets` and `redact` join over whole paragraphs; `reach` limits the distance in
code points, as `spans` does unless told otherwise.

Every pattern starts at the edge of a run of its characters or is consumed by its match, so the time
of a text grows with its length, also where it is one unbroken run.

Positions are code points.  Null and empty texts have no spans.  Parts never leave their text, so the
join needs no shuffle, and its memory is bounded by one text.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.text import map_texts

REACH = 300

# The strong patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LENGTH, ACCESS_LENGTH = 8, 16

# Weak candidates and the role each part plays in a credential.
WEAK = {
    "id": re.compile(r"(?<![A-Za-z0-9])(?:(?:ASIA|AROA|AIDA|ANPA)[A-Z0-9]{12,}|(?:client|account|access|user|tenant)_?(?:id|name)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{4,})", re.I | re.A),
    "key": re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/=_-])"),
    "endpoint": re.compile(r"(?<![a-z0-9+.-])[0-9+.-]*(?P<url>[a-z][a-z0-9+.-]*://[^\s\"'<>]+)|(?<![a-z0-9.-])(?:[a-z0-9-]+\.)+(?:amazonaws|googleapis|azure|windows)\.(?:com|net)(?![a-z0-9])", re.I | re.A),
}
ROLES = {"assign": "secret", "hex": "secret", "key": "secret", "access": "id", "id": "id", "endpoint": "endpoint"}
# Words without which the weak identifiers and endpoints cannot occur.
HINTS = ("://", "amazonaws", "googleapis", "azure", "windows", "asia", "aroa", "aida", "anpa", "client", "account", "access", "user", "tenant")
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
PARAGRAPH = re.compile(r"\n\s*\n")

Span = tuple[str, int, int]


def strong(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping matches of each strong pattern; short ones are dropped after matching."""
    low = text.lower()
    if any(word in low for word in ASSIGNED):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LENGTH:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LENGTH:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def weak_spans(text: str) -> Iterator[Span]:
    """Matches of the weak patterns; an address begins with the first letter of its scheme."""
    for kind, pattern in WEAK.items():
        for m in pattern.finditer(text):
            yield kind, m.start("url") if kind == "endpoint" and m["url"] else m.start(), m.end()


def linked(text: str, found: list[Span], reach: int | None = None) -> list[Span]:
    """Weak candidates that have a part of another role in their paragraph, at most `reach` away if given.

    One overlapping a strong span of its own role is that part once more, and is left out.
    """
    roles = {ROLES[kind] for kind, _, _ in found}
    low = text.lower()
    # Keys alone have no partner, so the patterns are tried where another part may be.
    weak = list(weak_spans(text)) if roles or any(word in low for word in HINTS) else []
    if not weak:
        return []
    covered = {role: Covered([(a, b) for kind, a, b in found if ROLES[kind] == role]) for role in roles}
    weak = [s for s in weak if ROLES[s[0]] not in covered or not covered[ROLES[s[0]]].touches(s[1], s[2])]
    if not weak:
        return []
    breaks = [m.span() for m in PARAGRAPH.finditer(text)]
    begin_of, end_of = [0, *(b for _, b in breaks)], [*(a for a, _ in breaks), len(text)]
    parts = found + weak
    role = np.array([ROLES[kind] for kind, _, _ in parts])
    first, last = np.array([a for _, a, _ in parts]), np.array([b for _, _, b in parts])
    scope = np.searchsorted(end_of[:-1], first, side="right")
    result = []
    for mine in sorted(set(role.tolist())):
        other = np.flatnonzero(role != mine)
        # Intervals of other roles by start; the running largest end tells if one reaches back far enough.
        other = other[np.argsort(first[other], kind="stable")]
        begins, ends = first[other], np.maximum.accumulate(last[other]) if len(other) else last[other]
        for k in range(len(found), len(parts)):
            if role[k] != mine or not len(other):
                continue
            low, high = begin_of[scope[k]], end_of[scope[k]]
            if reach is not None:
                low, high = max(first[k] - reach, low), min(last[k] + reach, high)
            at = np.searchsorted(begins, high, side="right") - 1
            if at >= 0 and ends[at] >= low:
                result.append(parts[k])
    return result


class Covered:
    """Intervals by start with the running largest end: one search tells if a stretch meets any of them."""

    def __init__(self, edges: list[tuple[int, int]]):
        edges = sorted(edges)
        self.starts = [a for a, _ in edges]
        self.ends = list(accumulate((b for _, b in edges), max))

    def touches(self, a: int, b: int) -> bool:
        at = bisect_left(self.starts, b) - 1
        return at >= 0 and self.ends[at] > a


def spans(text: str, reach: int | None = REACH) -> list[Span]:
    """All spans by start, then kind in the order of `KINDS`, then end; without `reach` over whole paragraphs."""
    found = list(strong(text))
    return sorted(found + linked(text, found, reach), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, mark: str = "[secret]", reach: int | None = None) -> str:
    """The text with every stretch covered by spans replaced."""
    out, at = [], 0
    for _, a, b in spans(text, reach):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


SPANS = "array<struct<kind:string,start:bigint,stop:bigint>>"


def find_secrets(docs: DataFrame, keep: list[Column | str], reach: int | None = None) -> DataFrame:
    """Adds `spans` to the columns `keep`; one pass, no shuffle."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def work(texts):
        found = (spans(t.decode("utf-8", "replace"), reach) for t in texts)
        return [pa.array([[dict(kind=k, start=a, stop=b) for k, a, b in s] for s in found], kind)]

    return map_texts(docs, keep, [("spans", SPANS)], work)


def redact_documents(docs: DataFrame) -> DataFrame:
    """All columns, with secrets in `text` replaced; null texts stay null, `n_chars` follows if there is one."""

    def run(batches):
        for batch in batches:
            texts = [None if t is None else redact(t) for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
