"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton is built over a bounded sample of its
labelled text: whole documents in the order of a hash of their id until SHARE
symbols are full. Those longer than a quarter of the share come last, so that
no document makes up a sample where there are others; a language that has no
document within its share gives its shortest one, in evenly spaced pieces. A
text is then cut greedily into the longest phrases that occur in a language's
sample: an automaton with "start afresh" as the failing move is a plain table,
so thousands of text blocks step through it side by side. The language with
the fewest phrases per symbol wins.

Any number of languages is learned: GROUP of them have their tables in memory
at once, and texts pass one group after another.

Texts are read whole, in blocks of BLOCK symbols; a phrase ends with its block,
in every language alike, which leaves their order as it is. Symbols are the
bytes of the text with ASCII letters lower-cased, all other ASCII characters as
one, and runs of that one cut to length one.

Null or empty texts, and texts without any letter, give `und` and score 0.
Without a labelled text every text gives `und`, and an empty table gives an
empty one. Languages with equal counts are decided for the name that sorts
first. Repeated rows get equal results; columns that aren't named are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.words import LOWER, buffers, column, slices
from tideline.session import written

#: Symbols of training text of a language, and languages whose tables are held at once: bounds these at 2 * SHARE * GROUP * alphabet * 4 bytes.
SHARE, GROUP = 30_000, 4
#: Labelled documents read for the sample of a language, about.
SAMPLE_DOCS = 200
BLOCK = 512
#: How sharply the score falls with a language's rate.
SHARP = 40.0
NONE = "und"


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[0x80:] = np.arange(27, 27 + 128)
    return table[LOWER]


_CLASS = _class_table()


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts and their new offsets."""
    s = _CLASS[data]
    edge = np.zeros(len(s) + 1, bool)
    edge[offsets] = True
    drop = np.zeros(len(s), bool)
    drop[1:] = (s[1:] == 0) & (s[:-1] == 0) & ~edge[1:-1]
    kept = np.concatenate(([0], np.cumsum(~drop)))
    return s[~drop], kept[offsets]


def suffix_table(text: np.ndarray, width: int) -> np.ndarray:
    """Transitions of the suffix automaton of text, as states x width; -1 where there is none."""
    size = 2 * len(text) + 2
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((min(size, len(nxt)), width), -1, np.int32)
    for i, moves in enumerate(nxt):
        if moves:
            table[i, list(moves)] = list(moves.values())
    return table


class Parser:
    """Greedy cross-parsing tables of several languages in one array."""

    def __init__(self, samples: dict[str, np.ndarray]):
        self.names = sorted(samples)
        seen = np.unique(np.concatenate([samples[n] for n in self.names] or [np.zeros(0, np.uint8)]))
        self.rank = np.full(256, len(seen), np.int64)  # a symbol that no sample has
        self.rank[seen] = np.arange(len(seen))
        self.width = len(seen) + 1
        parts, roots, base = [], [], 0
        for n in self.names:
            t = suffix_table(self.rank[samples[n]], self.width)
            # one more state, after a symbol that the sample lacks: whatever follows it starts a phrase
            root = np.where(t[0] < 0, len(t), t[0])
            fails = np.concatenate((t < 0, np.ones((1, self.width), bool)))
            t = np.where(fails, root[None, :], np.concatenate((t, t[:1]))) + base
            parts.append(np.where(fails, -1 - t, t))  # negative: a phrase ended before this symbol
            roots.append(base)
            base += len(t)
        self.table = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int64)
        self.table = self.table.astype(np.int32)
        self.roots = np.array(roots, np.int64)

    def phrases(self, s: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text in each language: texts x languages."""
        k, n = len(self.names), len(offsets) - 1
        size = np.diff(offsets)
        blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(n), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = offsets[owner] + nth * BLOCK
        length = np.minimum(BLOCK, offsets[owner + 1] - start)
        order = np.argsort(-length, kind="stable")
        start, length, owner = start[order], length[order], owner[order]
        count = np.ones((len(owner), k), np.int64)
        state = np.repeat(self.roots[None, :], len(owner), 0)
        code = self.rank[s]
        live = len(owner)
        for j in range(int(length[0]) if live else 0):
            while live and length[live - 1] <= j:
                live -= 1
            step = self.table[state[:live] * self.width + code[start[:live] + j][:, None]]
            ended = step < 0
            count[:live] += ended
            state[:live] = np.where(ended, -1 - step, step)
        out = np.zeros((n, k), np.int64)
        np.add.at(out, owner, count)
        return out


def chosen(texts: list[str], share: int) -> np.ndarray:
    """The sample of a language from its texts in their order: whole ones that fit, or the shortest one in pieces."""
    parts = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        s = symbols(data, np.array([0, len(data)], np.int64))[0]
        if len(s):
            parts.append(s)
    out, size = [], 0
    for s in sorted(parts, key=lambda s: len(s) > share // 4):  # stable
        if size + len(s) + 1 <= share:
            out += [s, np.zeros(1, np.uint8)]  # a blank between texts
            size += len(s) + 1
    if out:
        return np.concatenate(out)
    shortest = min(parts, key=len, default=np.zeros(0, np.uint8))
    n = share // 16
    return np.concatenate([shortest[a : a + n] for a in np.linspace(0, len(shortest) - n, 16).astype(int)]) if len(shortest) else shortest


def sampled(labelled: DataFrame, text: str, lang: str, key: str) -> Iterator[dict[str, np.ndarray]]:
    """The samples of each group of languages, from the texts whose id hashes below a cutoff that gives about SAMPLE_DOCS.

    Rows without an id teach nothing: they would be drawn all or none.
    """
    named = labelled.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & (F.length(text) > 0))
    sizes = sorted((r[0], r[1]) for r in named.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect())
    h = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 32))
    for at in range(0, len(sizes), GROUP):
        cutoff = F.create_map(*[F.lit(x) for n, k in sizes[at : at + GROUP] for x in (n, min(1 << 32, max(1, (SAMPLE_DOCS << 32) // k)))])
        rows = named.where(h < cutoff[F.col(lang)]).select(F.col(lang), h, F.col(text)).collect()
        by: dict[str, list[str]] = {}
        for name, _, t in sorted(map(tuple, rows)):
            by.setdefault(name, []).append(t)
        got = {name: chosen(parts, SHARE) for name, parts in by.items()}
        yield {name: s for name, s in got.items() if len(s)}


_parsers: dict[tuple, Parser] = {}


def parser(samples: dict[str, np.ndarray]) -> Parser:
    """One parser a worker; only the samples travel, the tables are built where they serve."""
    key = tuple((n, samples[n].tobytes()) for n in sorted(samples))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(samples)
    return _parsers[key]


def identify(docs: DataFrame, labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Predict each text's language from labelled texts (columns key, text, lang).

    Returns keep, lang_pred, score (the winner's share of the evidence) and
    phrases per symbol of the winner as `rate`. Map-only but for the sample.
    """
    spark = docs.sparkSession
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    src = docs.select(*keep, F.col(text).alias("__text"), letters.alias("__letters"), F.lit(None).cast("string").alias("__lang"), F.lit(None).cast("double").alias("__rate"), F.lit(0.0).alias("__odds"))
    for nth, samples in enumerate(sampled(labelled, text, lang, key)):
        if samples:
            src = _step(written(src, "languages") if nth else src, spark.sparkContext.broadcast(samples))
    known = F.col("__letters") & F.col("__lang").isNotNull()
    return src.select(
        *keep,
        F.when(known, F.col("__lang")).otherwise(NONE).alias("lang_pred"),
        F.when(known, F.exp(-SHARP * F.col("__rate")) / F.col("__odds")).otherwise(0.0).alias("score"),
        F.when(known, F.col("__rate")).otherwise(0.0).alias("rate"),
    )


def _step(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """Take the languages of one group into each row's best language, its rate, and the sum of all odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(shared.value)
        for b in slices(batches, "__text"):
            s, offsets = symbols(*buffers(column(b, "__text")))
            rate = p.phrases(s, offsets) / np.maximum(np.diff(offsets), 1)[:, None]
            best = rate.argmin(1)
            least = rate[np.arange(b.num_rows), best]
            before = column(b, "__rate").fill_null(np.inf).to_numpy(zero_copy_only=False)
            better = least < before
            names = np.where(better, np.array(p.names, object)[best], np.array(column(b, "__lang").to_pylist(), object))
            odds = column(b, "__odds").to_numpy(zero_copy_only=False) + np.exp(-SHARP * rate).sum(1)
            put = {"__lang": pa.array(names.tolist(), pa.string()), "__rate": pa.array(np.minimum(least, before)), "__odds": pa.array(odds)}
            yield pa.RecordBatch.from_arrays([put.get(f.name, c) for f, c in zip(b.schema, b.columns, strict=True)], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
