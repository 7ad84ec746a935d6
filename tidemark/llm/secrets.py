"""Secrets in whole texts: base patterns, and multipart credentials linked across intervals.

Base findings are assignments, access identifiers and long hexadecimal strings.
Weak candidates are parts that say little alone: an opaque string that could be
a secret key, a user name, a host or a connection address. A part is reported
only when a complementary part lies in the same scope: scopes are intervals of
``REACH`` code points around the parts, cut at blank lines, and parts are
joined where their intervals overlap. Each text is read whole; scopes never
leave a text, so the interval join is a sweep over the text's sorted parts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, sliced

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
_WORDS = ("password", "passwd", "secret", "token", "api")
#: Bytes of long hexadecimal strings; everything else is a blank.
_HEX_MAP = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))

# Weak parts. Opaque strings mix cases or digits; hosts and addresses are endpoints; users identify.
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s\"'<>]+|\b(?:host(?:name)?|server|endpoint|url)\x20*[:=]\x20*[\"']?([A-Za-z0-9.-]+(?::\d+)?)", re.IGNORECASE | re.ASCII)
USER = re.compile(r"\b(?:user(?:name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?)\x20*[:=]\x20*[\"']?([A-Za-z0-9._@+-]{3,})", re.IGNORECASE | re.ASCII)
_WEAK_HINT = re.compile(r"://|user|login|client|account|host|server|endpoint|url|access_?key", re.IGNORECASE)
REACH = 200

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "linked_secret", "linked_user", "linked_endpoint")
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping findings of each kind, by start and then kind as listed."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"x" * LEAST_HEX in text.encode("utf-8", "replace").translate(_HEX_MAP):
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(out, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


def _opaque(value: str) -> bool:
    """Looks random: of several kinds of characters, and varied."""
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[+/_=-]"))
    return kinds >= 2 and any(c.isdigit() for c in value) and len(set(value)) >= 8


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak parts with a complement in scope. Roles: identifier, secret, endpoint; two different roles complement each other."""
    anchors = [("identifier", s, e, None) if k == "access" else ("secret", s, e, None) for k, s, e in base]
    if not anchors and not _WEAK_HINT.search(text):
        return []
    taken = [(s, e) for _, s, e in base]
    free = lambda s, e: all(e <= a or s >= b for a, b in taken)
    parts = list(anchors)
    parts += [("secret", m.start(), m.end(), "linked_secret") for m in OPAQUE.finditer(text) if _opaque(m[0]) and free(m.start(), m.end())]
    parts += [("identifier", m.start(), m.end(), "linked_user") for m in USER.finditer(text) if free(m.start(), m.end())]
    parts += [("endpoint", m.start(), m.end(), "linked_endpoint") for m in ENDPOINT.finditer(text) if free(m.start(), m.end())]
    parts.sort(key=lambda p: (p[1], p[2], p[0]))
    breaks = [m.start() for m in re.finditer(r"\n[\x20\t]*\n", text)]
    found: set[Span] = set()
    # the nearest part of each role before a part, and after it, decides whether a complement is in scope
    for order in (parts, [(r, -e, -s, k) for r, s, e, k in sorted(parts, key=lambda p: (-p[2], -p[1], p[0]))]):
        flip = order is not parts
        cuts = [-b for b in reversed(breaks)] if flip else breaks
        last: dict[str, int] = {}
        at = 0
        for role, s, e, kind in order:
            while at < len(cuts) and cuts[at] <= s:
                last.clear()
                at += 1
            near = {r for r, end in last.items() if r != role and s - end <= reach}
            if kind and near:
                found.add((kind, -e, -s) if flip else (kind, s, e))
            last[role] = max(last.get(role, e), e)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _found(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1024):
        rows = []
        for text in batch.column(1).to_pylist():
            base = base_spans(text or "")
            every = sorted(base + linked_spans(text or "", base, reach), key=lambda x: (x[1], KINDS.index(x[0])))
            counts = [sum(k == kind for k, *_ in base) for kind in BASE_KINDS]
            rows.append((*counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(every), [{"kind": k, "start": s, "end": e, "value": text[s:e]} for k, s, e in every]))
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "findings"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """A row for each row of ``docs``: counts of base findings, a digest of their spans, all spans, and findings with their values.

    Null texts count as empty, very long ones are read whole; ids may be null
    or repeat. Spans that start together go by kind as listed. Nothing
    shuffles. Other columns play no part, whatever their names. An empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, lambda it: _found(it, reach), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, findings array<struct<kind: string, start: bigint, end: bigint, value: string>>")


def covered(spans: list[Span]) -> list[tuple[int, int]]:
    """(start, end) of what the spans cover together: overlapping ones are one."""
    out: list[tuple[int, int]] = []
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with the found spans replaced in the text.

    Spans that overlap are replaced as one; those that touch, one by one. Null
    and empty texts stay as they are, very long ones are read whole. Ids play
    no part; other columns stay, whatever their names. An empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            texts = []
            for text in batch.column(0).to_pylist():
                if text:
                    base = base_spans(text)
                    for s, e in reversed(covered(base + linked_spans(text, base))):
                        text = text[:s] + mask + text[e:]
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], batch.schema.names)

    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    schema = "_text string, " + ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(docs.columns, names))
    out = map_arrow(rows, run, schema)
    return out.select(*[(F.col("_text") if c == text_col else F.col(n)).alias(c) for c, n in zip(docs.columns, names)])
