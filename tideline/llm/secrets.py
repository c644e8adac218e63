"""Secret scans: keyword automaton, anchored expressions near its hits, checksums.

* One Aho-Corasick pass over the lower-cased bytes of a slice of texts finds
  the keywords; text without a hit is never looked at again.
* At each hit an anchored expression decides. Hexadecimal strings have no
  keyword: their prefilter is a byte table that yields runs of 24 or more.
* Tokens that carry a checksum (a CRC-32 in base 62 as the last six of 36
  characters) count only if the checksum holds; this kind is `checked`.

Spans of one kind don't overlap and are taken leftmost first; a match that is
too short is dropped but still uses up its characters. Null and empty texts
have no spans, and an empty table gives an empty one. Very long texts are
scanned whole. Offsets are code points, end exclusive; spans of different kinds
that start together are in the order of KINDS. Every row of the input gives one
row; columns that aren't named are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.words import LOWER, buffers, column, slices

KINDS = ("assign", "access", "hex", "checked")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
#: Keywords of each kind, lower-cased.
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "checked": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")}
HEX_LEAST, ACCESS_LEAST, VALUE_LEAST = 24, 20, 6
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = np.zeros(256, bool)
_HEX[0x30:0x3A] = _HEX[0x61:0x67] = True


def checksum(body: bytes) -> bytes:
    """CRC-32 in base 62, six characters."""
    x, out = zlib.crc32(body), ""
    for _ in range(6):
        x, r = divmod(x, 62)
        out = _DIGITS[r] + out
    return out.encode()


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def scan(data: np.ndarray, offsets: np.ndarray, auto) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind's number, end) of each text, in code points, sorted."""
    n = len(offsets) - 1
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    if not len(data):
        return found
    raw = data.tobytes()
    bounds = offsets.tolist()
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    used: dict[tuple[str, int], int] = {}

    def add(doc: int, kind: int, start: int, end: int) -> None:
        zero = points[bounds[doc]]
        found[doc].append((int(points[start] - zero), kind, int(points[end] - zero)))

    hits = sorted((last + 1 - size, kind) for last, (kind, size) in auto.iter(LOWER[data].tobytes().decode("latin-1")))
    for start, kind in hits:
        doc = bisect_right(bounds, start) - 1
        stop = bounds[doc + 1]
        if start < used.get((kind, doc), 0):
            continue
        expression = {"assign": ASSIGN, "access": ACCESS, "checked": CHECKED}[kind]
        m = expression.match(raw, start, stop)
        if not m:
            continue
        used[kind, doc] = m.end()
        if kind == "assign" and len(m[1]) >= VALUE_LEAST:
            add(doc, 0, start, m.end())
        elif kind == "access" and m.end() - start >= ACCESS_LEAST:
            add(doc, 1, start, m.end())
        elif kind == "checked" and checksum(m[1]) == m[2]:
            add(doc, 3, start, m.end())
    mask = np.zeros(len(data) + 2, bool)
    mask[1:-1] = _HEX[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(mask[1:] & (~mask[:-1] | edge))
    end = np.flatnonzero(mask[:-1] & (~mask[1:] | edge))
    for i in np.flatnonzero(end - start >= HEX_LEAST):
        add(bisect_right(bounds, int(start[i])) - 1, 2, int(start[i]), int(end[i]))
    for spans in found:
        spans.sort()
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each run of overlapping spans replaced by mark."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Spans of secrets in each text.

    Returns keep, the text's `found` array<struct<kind,start,end>>, n_assign,
    n_access, n_hex, base_sha256 (of the first three kinds) and spans (all, as
    text). Map-only.
    """
    src = docs.select(*keep, F.col(text).alias("__text"))
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([src.schema[c] for c in keep])
    for c in ("n_assign", "n_access", "n_hex"):
        schema = schema.add(c, T.LongType())
    schema = schema.add("base_sha256", T.StringType()).add("spans", T.StringType()).add("found", T.ArrayType(item))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for b in slices(batches, "__text"):
            found = scan(*buffers(column(b, "__text")), auto)
            base = [[s for s in spans if s[1] < 3] for spans in found]
            cols = [column(b, c) for c in keep]
            cols += [pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64()) for k in range(3)]
            cols.append(pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string()))
            cols.append(pa.array([joined(s) for s in found], pa.string()))
            cols.append(pa.array([[{"kind": KINDS[k], "start": a, "end": e} for a, k, e in s] for s in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    return src.mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, each secret in the text replaced by mark; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for b in slices(batches, text):
            at = b.schema.get_field_index(text)
            found = scan(*buffers(b.column(at)), auto)
            if any(found):
                values = b.column(at).to_pylist()
                new = pa.array([masked(v, s, mark) if s else v for v, s in zip(values, found, strict=True)], b.column(at).type)
                b = pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)
            yield b

    return docs.mapInArrow(run, docs.schema)
