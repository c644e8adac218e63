"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of the normalised benchmark items.
Training words are streamed through it and the longest match that ends at
each word is tracked. Where that length reaches `window` words (or where a
whole shorter item ends), the matched words are hit, and the items that
contain them are known from the automaton's state.

Only stretches of a text can matter in which every pair of neighbouring words
is a pair of some item; those are found with array operations first, and the
automaton then decides on them. This is exact, since a window has only such
pairs.

Words: A-Z lower-cased, [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. Null and empty
texts have no words; items without words are never found, and without items
nothing is hit. Items with equal text are all reported, an item without an id
as an empty string. Every row of the input gives one row, repeated rows too;
an empty table gives an empty one. Very long texts are streamed whole. Other
columns are carried on by `clean` and not looked at, whatever their names. Items are collected only up to SHARD_CHARS characters at a time: a larger
benchmark is dealt to several automata, and the documents pass them in turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.words import ALNUM, buffers, column, cut, slices, unused
from tideline.session import written

WINDOW = 10
#: Characters of benchmark text in one automaton.
SHARD_CHARS = 8_000_000


class Automaton:
    """Generalised suffix automaton of items given as (id, word hashes)."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        spans = []
        for name, words in items:
            last, path = 0, []
            for w in words:
                last = self._extend(last, w)
                path.append(last)
            if words:
                spans.append((name, words))
        self.shortest = min([window, *(len(w) for _, w in spans)])
        self.items: dict[int, list[str]] = {}
        self.ends: dict[int, list[tuple[int, str]]] = {}
        held: dict[int, set[str]] = {}
        for name, words in spans:
            state = 0
            for n, w in enumerate(words, 1):
                state = self.next[state][w]
                if n >= window:
                    held.setdefault(self._of_length(state, window), set()).add(name)
            if len(words) < window:
                self.ends.setdefault(self._of_length(state, len(words)), []).append((len(words), name))
        self.items = {s: sorted(v) for s, v in held.items()}
        pairs = {(a, b) for _, w in spans for a, b in zip(w, w[1:], strict=False)}
        single = {w[0] for _, w in spans if len(w) == 1}
        self.single = np.array(sorted(single), np.uint64)
        first = np.array([a for a, _ in pairs], np.uint64)
        second = np.array([b for _, b in pairs], np.uint64)
        self.pairs = np.sort(pair_hash(first, second))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.pairs >> np.uint64(44)).astype(np.int64)] = True

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def _of_length(self, state: int, n: int) -> int:
        """The state of the last n words of what state holds."""
        while self.len[self.link[state]] >= n:
            state = self.link[state]
        return state

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit intervals [from, to), items, and the longest match of a run of words."""
        nxt, link, length, window = self.next, self.link, self.len, self.window
        state = matched = longest = 0
        hits: list[tuple[int, int]] = []
        names: set[str] = set()
        seen: set[int] = set()
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                matched += 1
            longest = max(longest, matched)
            size = 0
            if matched >= window:
                at = self._of_length(state, window)
                size = window
                if at not in seen:
                    seen.add(at)
                    names.update(self.items.get(at, ()))
            if self.ends:
                at = state
                while at > 0:
                    for n, name in self.ends.get(at, ()):
                        if n <= matched:
                            names.add(name)
                            size = max(size, n)
                    at = link[at]
            if size:
                if hits and hits[-1][1] >= i + 1 - size:
                    hits[-1] = (min(hits[-1][0], i + 1 - size), i + 1)
                else:
                    hits.append((i + 1 - size, i + 1))
        return hits, names, longest

    def stretches(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges [from, to) that may hold a window, each within one text."""
        n = len(h)
        if not n:
            return []
        least = self.shortest
        if least <= 1:
            runs = np.zeros(n, bool)
            runs[np.isin(h, self.single)] = True
        else:
            runs = np.zeros(n, bool)
        if len(self.pairs) and n > 1:
            p = pair_hash(h[:-1], h[1:])
            at = np.flatnonzero(self.bits[(p >> np.uint64(44)).astype(np.int64)])
            spot = np.minimum(np.searchsorted(self.pairs, p[at]), len(self.pairs) - 1)
            at = at[self.pairs[spot] == p[at]]
            inner = np.zeros(n + 1, bool)
            inner[first[1:-1]] = True  # the first word of a text follows no other
            at = at[~inner[at + 1]]
            joined = np.zeros(n + 1, bool)  # word i goes on from word i - 1
            joined[at + 1] = True
            edge = np.flatnonzero(np.diff(np.concatenate(([False], joined[1:n], [False])).astype(np.int8)))
            start, stop = edge[::2], edge[1::2] + 1
            good = stop - start >= max(least, 2)
            out = list(zip(start[good].tolist(), stop[good].tolist(), strict=True))
        else:
            out = []
        if runs.any():
            lone = np.flatnonzero(runs).tolist()
            covered = np.zeros(n, bool)
            for a, b in out:
                covered[a:b] = True
            out += [(i, i + 1) for i in lone if not covered[i]]
            out.sort()
        return out


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _shards(items: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, str]]]:
    """The items, at most SHARD_CHARS characters at once where no single item is longer."""
    rows = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).where(F.length("t") > 0)
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = 1 if total <= SHARD_CHARS else int(2 * total // SHARD_CHARS) + 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield sorted(map(tuple, part.collect()))


_built: dict[tuple, Automaton] = {}


def automaton(items: list[tuple[str, str]], window: int) -> Automaton:
    key = (window, hash(tuple(items)))
    if key not in _built:
        _built.clear()
        w = cut(*buffers(pa.array([t for _, t in items], pa.string())), inside=ALNUM, lower=True)
        h, first = w.hash.tolist(), w.first.tolist()
        _built[key] = Automaton([(i, h[first[k] : first[k + 1]]) for k, (i, _) in enumerate(items)], window)
    return _built[key]


_HITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_HITS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _step(docs: DataFrame, shared: Broadcast, text: str, window: int, names_: dict[str, str]) -> DataFrame:
    """Adds the hits of one automaton to those that the rows have."""
    schema = docs.schema
    n_, hits_, items_, longest_ = (names_[k] for k in ("n", "hits", "items", "longest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(shared.value, window)
        for b in slices(batches, text):
            w = cut(*buffers(column(b, text)), inside=ALNUM, lower=True)
            hits = [[(x["start"], x["end"]) for x in v or ()] for v in column(b, hits_).to_pylist()]
            names = [set(v or ()) for v in column(b, items_).to_pylist()]
            most = column(b, longest_).to_pylist()
            runs = auto.stretches(w.hash, w.first)
            owner = np.searchsorted(w.first, [a for a, _ in runs], side="right") - 1
            for (start, stop), doc in zip(runs, owner.tolist(), strict=True):
                found, items, longest = auto.stream(w.hash[start:stop].tolist())
                base = start - int(w.first[doc])
                hits[doc] += [(a + base, e + base) for a, e in found]
                names[doc] |= items
                most[doc] = max(most[doc], longest)
            put = {
                n_: pa.array(w.n),
                hits_: pa.array([[{"start": a, "end": e} for a, e in _merged(h)] for h in hits], _HITS_ARROW),
                items_: pa.array([sorted(x) for x in names], pa.list_(pa.string())),
                longest_: pa.array(most, pa.int32()),
            }
            yield pa.RecordBatch.from_arrays([put.get(f.name, c) for f, c in zip(b.schema, b.columns, strict=True)], names=b.schema.names)

    return docs.mapInArrow(run, schema)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, e in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((a, e))
    return out


def matches(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> tuple[DataFrame, dict[str, str]]:
    """docs with four columns added, and these columns' names.

    n (words), hits (word intervals), items (sorted strings) and longest: the
    longest match in the stretches that may hold a window; shorter matches
    elsewhere aren't looked at.
    """
    spark = docs.sparkSession
    names = {k: unused(docs.columns, f"__{k}") for k in ("n", "hits", "items", "longest")}
    empty = {"n": F.lit(0).cast("long"), "hits": F.lit(None).cast(_HITS), "items": F.lit(None).cast("array<string>"), "longest": F.lit(0)}
    out = docs.withColumns({names[k]: v for k, v in empty.items()})
    for k, shard in enumerate(_shards(items, item, item_text)):
        if k:
            out = written(out, "decontaminate")
        out = _step(out, spark.sparkContext.broadcast(shard), text, window, names)
    return out, names


def hit_words(hits: str) -> Column:
    return F.coalesce(F.aggregate(hits, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]), F.lit(0).cast("long"))


def report(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW) -> DataFrame:
    """One row a document: n_words, n_hit, n_items, items_sha256, contaminated, longest_match (see `matches`)."""
    m, at = matches(docs.select(*keep, F.col("text").alias("__text")), items, text="__text", window=window)
    return m.select(
        *keep,
        F.col(at["n"]).alias("n_words"),
        hit_words(at["hits"]).alias("n_hit"),
        F.size(at["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", at["items"]), 256).alias("items_sha256"),
        (hit_words(at["hits"]) > 0).alias("contaminated"),
        F.col(at["longest"]).alias("longest_match"),
    )


def clean(docs: DataFrame, items: DataFrame, coverage: float = 0.5, window: int = WINDOW) -> DataFrame:
    """Rows and columns of docs; hit spans are cut from the text, and a text hit for over `coverage` of its words goes.

    Texts without a hit, null texts too, stay as they are.
    """
    m, own = matches(docs, items, window=window)
    m = m.where(hit_words(own["hits"]) <= F.col(own["n"]) * coverage)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            hits = column(b, own["hits"]).to_pylist()
            if any(hits):
                data, offsets = buffers(column(b, "text"))
                w = cut(data, offsets, inside=ALNUM, lower=True)
                new = column(b, "text").to_pylist()
                for i, h in enumerate(hits):
                    if h:
                        new[i] = _without(data[offsets[i] : offsets[i + 1]].tobytes(), w, i, int(offsets[i]), h)
                at = b.schema.get_field_index("text")
                b = pa.RecordBatch.from_arrays([pa.array(new, c.type) if k == at else c for k, c in enumerate(b.columns)], schema=b.schema)
            yield b.select(names)

    return m.mapInArrow(run, docs.schema)


def _without(raw: bytes, w, doc: int, base: int, hits: list[dict]) -> str:
    out, at = [], 0
    for x in hits:
        a = int(w.start[w.first[doc] + x["start"]]) - base
        e = int(w.end[w.first[doc] + x["end"] - 1]) - base
        out.append(raw[at:a])
        at = e
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "replace")
