"""N-gram Jaccard join: prefixes of rare shingles, size-banded tiles, bitmap bounds, exact intersection.

1. A text's set is its distinct k-word shingles as 64-bit hashes (a shorter
   text is one shingle). Texts with equal sets form one node.
2. Candidates by an exact prefix filter. Shingles have one order over the whole
   corpus, by the number of nodes that hold them, rarest first. Sets with a
   similarity of t share a shingle among the first n - ceil(t * n) + 1 of each.
   A shingle that only one node holds can't be shared, so a set with that many
   of its own has no candidates at all: boilerplate, which comes last in the
   order, brings no sets together. Counting goes by buckets of the hash; a
   bucket's counts return to the nodes, which post the rest of their prefix.
   Shingles that are very frequent (at most FREQUENT of them by construction)
   are told to all tasks beforehand and never meet in a bucket.
3. Nodes that share a posted shingle form loose groups. Where shingles are
   shared by chance (few words, logs, tables) such groups run together, so the
   nodes of a group of more than LOOSE are grouped anew by equal parts: hashes
   deal a set's shingles to one part more than the shingles in which it may
   differ from a similar set, so similar sets have an equal part that isn't
   empty. A part is some nine shingles at 90 %, some four at 80 %, which
   hardly agree by chance.
4. A group's nodes go to tiles: by size band (neighbours in the ratio of the
   threshold) and, in large bands, by hash. Only tiles of the same or
   neighbouring bands meet, since sets whose sizes differ by more than the
   threshold can't be similar. Texts without a group don't move: a bitmap of
   fixed size of the grouped rows' hashed keys holds them back.
5. In a tile, bitmaps of the hashed shingles bound the overlap from above by
   bit counts; every pair that passes is decided by exact intersection. Each
   pair of nodes meets in one tile. A tile sends the number of links of each
   node, weighted by the rows of the other node, and a spanning forest: a
   group's pairs, which grow with the square of its size, are counted there.
6. Connected components of those links, by distributed star contraction.

Nothing is missed but for what 64-bit hashes of shingles and sets risk. In the
order, a shingle goes by its bucket and 32 bits: where two shingles share
these, they count as one, which only adds candidates.

Null and empty texts have the empty set and are linked with nothing, and an
empty table gives an empty one. Rows with equal texts are one node; equal ids
are allowed. Similarities that equal the threshold link. A very long text is
one large set, held by one task at a time; a tile has one such set at least. A
row's links go to all other rows with a similar or an equal set; rows of a set
that has no row with a key are linked with nothing. Columns that aren't named
are carried on by `representatives` and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.components import components
from tideline.llm.substrings import buffers_binary
from tideline.llm.words import MASK, Words, buffers, column, cut, mix, release, slices
from tideline.session import discard, written

#: Shingles in a tile at most, where one set isn't longer.
TILE = 1_500_000
#: Shingles or postings that a task holds before it passes them on.
HELD = 400_000
#: Shingles in a bucket, which is one task's memory (some 60 bytes each), and in a partition of buckets, on average at most.
#: A shingle travels in four bytes, and a text's shingles of a bucket share nine more: fewer buckets move less.
BUCKET, PARTITION = 3_000_000, 3_000_000
#: Frequent shingles at most; nodes that have one at least; and how often a task must see it among HELD shingles.
FREQUENT, FREQUENT_LEAST, SEEN_LEAST = 1 << 20, 256, 6
#: Nodes of a loose group at most that isn't grouped anew by equal parts.
LOOSE = 256
#: Bits of the bitmap of hashed keys (8 MB).
KEY_BITS = 1 << 26


@dataclass(frozen=True)
class Setting:
    """Shingles of k words, similarity of at least percent/100."""

    k: int = 5
    percent: int = 80


STRICT = Setting(k=3, percent=90)
NEAR = Setting()


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: flat sorted hashes, and offsets."""
    g, fits = w.grams(k)
    parts = []
    short = w.hash
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            parts.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            h = b - a
            for x in short[a:b].tolist():
                h = int(mix(np.array([(h * 0x9E3779B97F4A7C15 + x) & MASK], np.uint64))[0])
            parts.append(np.array([h], np.uint64))
        else:
            parts.append(np.zeros(0, np.uint64))
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def nodes(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        out[full] = mix(np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), offsets[:-1][full]) + n[full].astype(np.uint64)) | np.uint64(1)
    return out


def _sets(b: pa.RecordBatch, s: Setting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat, offsets = shingles(cut(*buffers(column(b, "__text")), lower=True), s.k)
    return flat, offsets, nodes(flat, offsets)


def _once(flats: list[np.ndarray], sizes: list[np.ndarray], nodes_: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets of several slices, each node once and without the empty one: flat shingles, sizes, nodes."""
    flat, size, node = np.concatenate(flats), np.concatenate(sizes), np.concatenate(nodes_)
    first = np.unique(node, return_index=True)[1]
    take = np.zeros(len(node), bool)
    take[first[node[first] != 0]] = True
    return flat[np.repeat(take, size)], size[take], node[take]


def _windows(batches: Iterator[pa.RecordBatch], s: Setting) -> Iterator[tuple[pa.RecordBatch | None, tuple | None]]:
    """(slice, (sizes, nodes)) for each slice of texts, and (None, sets of a window of slices) now and then."""
    held: list[tuple] = []
    size = 0
    for b in slices(batches, "__text"):
        flat, offsets, node = _sets(b, s)
        n = np.diff(offsets)
        yield b, (n, node)
        held.append((flat, n, node))
        size += len(flat)
        if size > HELD:
            yield None, _once(*zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield None, _once(*zip(*held, strict=True))


def sized(docs: DataFrame, s: Setting, key: str, text: str) -> DataFrame:
    """key, n_shingles and node of each row; and rows (shingle, seen) for those that a task sees often."""
    src = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    own = src.schema["__key"].dataType
    schema = T.StructType([T.StructField("__key", own), *(T.StructField(c, T.LongType()) for c in ("n_shingles", "node", "shingle", "seen"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for b, got in _windows(batches, s):
            if b is not None:
                kind, n, zero = column(b, "__key").type, b.num_rows, pa.nulls(b.num_rows, pa.int64())
                cols = [column(b, "__key"), pa.array(got[0]), pa.array(got[1].view(np.int64)), zero, zero]
            else:
                shingle, seen = np.unique(got[0], return_counts=True)
                shingle, seen = shingle[seen >= SEEN_LEAST], seen[seen >= SEEN_LEAST]
                n, zero = len(seen), pa.nulls(len(seen), pa.int64())
                cols = [pa.nulls(n, kind), zero, zero, pa.array(shingle.view(np.int64)), pa.array(seen)]
            if n:
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(run, schema)


def frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted frequent shingles, how often they were seen, and the shingles of all rows."""
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    least = max(FREQUENT_LEAST, -(-total // FREQUENT))  # at most FREQUENT shingles can be seen as often
    often = rows.where(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= least)
    got = often.toPandas()
    shingle = got["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(shingle)
    return shingle[order], got["seen"].to_numpy(np.int64)[order], total


def _packed(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    """A binary column: values[edge[i]:edge[i + 1]] for each i."""
    offsets = (edge * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _share(h: np.ndarray, parts: int) -> np.ndarray:
    """One of parts numbers, rising with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts <= 65536 else np.int64)


_SPREAD = "place int, kind int, part int, nodes binary, sizes binary, counts binary, body binary, ranks binary"
_NONE = np.zeros(0, np.uint32)
_NAMES = [c.split()[0] for c in _SPREAD.split(", ")]


def _sent(place: np.ndarray, node: np.ndarray, size: np.ndarray, count: np.ndarray, body: np.ndarray, rank: np.ndarray, kind: int, part: int) -> Iterator[pa.RecordBatch]:
    """Rows, one a place, of runs of entries (body and rank, count of them a run) sorted by place."""
    n = len(place)
    if not n:
        return
    lead = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    run = np.append(lead, n)
    edge = np.concatenate(([0], np.cumsum(count)))[run]
    none = np.zeros(len(run), np.int64)
    fixed = [pa.array(np.full(len(lead), x, np.int32)) for x in (kind, part)]
    cols = [pa.array(place[lead].astype(np.int32)), *fixed, _packed(node, run), _packed(size, run if len(size) else none)]
    cols += [_packed(count.astype(np.uint8 if int(count.max()) < 256 else np.uint32), run), _packed(body, edge), _packed(rank, edge if len(rank) else none)]
    yield pa.RecordBatch.from_arrays(cols, names=_NAMES)


def _of_runs(place: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First entry and length of each run of entries that are sorted by place and owner."""
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(place)))


def _groups(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[int, pa.Table]]:
    """Runs of rows with equal values of an integer column."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        v = column(b, name).to_numpy()
        edge = (np.flatnonzero(v[1:] != v[:-1]) + 1).tolist()
        for x, y in zip([0, *edge], [*edge, len(v)], strict=True):
            if held and v[x] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(v[x])
            held.append(b.slice(x, y - x))
    if held:
        yield now, pa.Table.from_batches(held)
    del held
    release()


def _joined(t: pa.Table, name: str, kind: type) -> np.ndarray:
    """The values of a binary column, row after row."""
    return np.concatenate([buffers_binary(c)[0] for c in t[name].chunks if len(c)] or [np.zeros(0, np.uint8)]).view(kind)


def _counts(t: pa.Table) -> np.ndarray:
    """Entries of each run: a byte each, or four in rows of slices with a longer run."""
    raw = _joined(t, "counts", np.uint8)
    each, wide = (np.concatenate([np.diff(buffers_binary(c)[1]) for c in t[x].chunks if len(c)] or [np.zeros(0, np.int64)]) for x in ("nodes", "counts"))
    each = each // 8
    if (wide == each).all():
        return raw.astype(np.int64)
    end = np.cumsum(wide)
    return np.concatenate([raw[e - w : e].view(np.uint8 if w == n else np.uint32).astype(np.int64) for e, w, n in zip(end.tolist(), wide.tolist(), each.tolist(), strict=True)])


def postings(docs: DataFrame, s: Setting, text: str, often: np.ndarray, seen: np.ndarray, total: int) -> DataFrame:
    """Rows (a, b): the nodes b that have the shingle a, shared by other nodes, in their prefix; stars in a task as links.

    Texts go to buckets by shingle, counts back to the nodes.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = max(n, -(-total // PARTITION))
    buckets = max(n, -(-total // BUCKET))
    shared = spark.sparkContext.broadcast((often, np.minimum(seen, (1 << 31) - 1)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = shared.value
        for b, got in _windows(batches, s):
            if b is not None:
                continue
            flat, size, node = got
            owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
            # each node's size goes to its place, with those of its shingles that are frequent
            place = _share(node, buckets)
            order = np.argsort(place, kind="stable")
            if len(often):
                at = np.minimum(np.searchsorted(often, flat), len(often) - 1)
                hot = often[at] == flat
                by = np.argsort(place[owner[hot]], kind="stable")
                count, body = np.bincount(owner[hot], minlength=len(node)), flat[hot][by]
                rank = (seen[at[hot][by]] + (1 << 31)).astype(np.uint32)
                flat, owner = flat[~hot], owner[~hot]
            else:
                count, body, rank = np.zeros(len(node), np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
            yield from _sent(place[order], node[order], size[order].astype(np.uint32), count[order], body, rank, 1, 0)
            place = _share(flat, buckets)
            order = np.argsort(place, kind="stable")
            place, owner = place[order], owner[order]
            first, count = _of_runs(place, owner)
            yield from _sent(place[first], node[owner[first]], _NONE, count, flat.astype(np.uint32)[order], _NONE, 0, 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of a bucket that several nodes have, with how many."""
        for bucket, t in _groups(batches, "place"):
            kind = t["kind"].to_numpy()
            if kind.any():
                yield from t.filter(pa.array(kind == 1)).to_batches()
                t = t.filter(pa.array(kind == 0))
            node, counts, tail = _joined(t, "nodes", np.uint64), _counts(t), _joined(t, "body", np.uint32)
            if not len(node):
                continue
            node, run = np.unique(node, return_index=True)  # a node's copies sent the same run
            start = (np.cumsum(counts) - counts)[run]
            counts = counts[run]
            tail = tail[np.arange(int(counts.sum())) + np.repeat(start - (np.cumsum(counts) - counts), counts)]
            order = np.argsort(tail, kind="stable")
            ordered = tail[order]
            first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            times = np.empty(len(tail), np.uint32)
            times[order] = np.repeat(np.diff(np.append(first, len(tail))), np.diff(np.append(first, len(tail))))
            owner = np.repeat(np.arange(len(node), dtype=np.int32), counts)
            many = times > 1
            owner = owner[many]
            first, counts = _of_runs(owner, owner)
            node = node[owner[first]]
            yield from _sent(_share(node, buckets), node, _NONE, counts, tail[many], times[many], 0, bucket)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        most = 0
        for _, t in _groups(batches, "place"):
            kind, part = t["kind"].to_numpy(), t["part"].to_numpy()
            order = np.argsort(kind, kind="stable")
            t, kind, part = t.take(pa.array(order)), kind[order], part[order].astype(np.uint64)
            plain = t.slice(0, int((kind == 0).sum()))
            node, counts = _joined(t, "nodes", np.uint64), _counts(t)
            width = np.concatenate([np.diff(buffers_binary(c)[1]) for c in t["ranks"].chunks if len(c)]) // 4  # entries of each row
            key = np.concatenate((_joined(plain, "body", np.uint32).astype(np.uint64), mix(_joined(t.slice(len(plain)), "body", np.uint64))))
            key[: int(width[: len(plain)].sum())] |= np.repeat(part[: len(plain)], width[: len(plain)]) << np.uint64(32)
            rank = _joined(t, "ranks", np.uint32)
            node, owner = np.unique(node, return_inverse=True)
            told = _joined(t, "sizes", np.uint32).astype(np.int64)  # those of kind 1, which come last
            size = np.zeros(len(node), np.int64)
            size[owner[len(owner) - len(told) :]] = told
            owner = np.repeat(owner, counts)
            if (rank >= 1 << 31).any():  # copies of a node sent the same frequent shingles
                keep = np.ones(len(key), bool)
                hot = np.flatnonzero(rank >= 1 << 31)
                keep[hot] = False
                keep[hot[np.unique(mix(key[hot] ^ mix(node[owner[hot]])), return_index=True)[1]]] = True
                owner, key, rank = owner[keep], key[keep], rank[keep]
            shared_ = np.bincount(owner, minlength=len(node))
            quota = size - (s.percent * size + 99) // 100 + 1 - (size - shared_)
            order = np.lexsort((key, rank, owner))
            owner, key = owner[order], key[order]
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(shared_) - shared_, shared_)
            take = nth < quota[owner]
            if take.any():
                held.append((key[take], node[owner[take]]))
                most += int(take.sum())
            if most > HELD:
                yield from _stars(held)
                held, most = [], 0
        if held:
            yield from _stars(held)

    src = docs.select(F.col(text).alias("__text"))
    counted = src.mapInArrow(spread, _SPREAD).repartition(n, "place").sortWithinPartitions("place").mapInArrow(count, _SPREAD)
    return counted.repartition(n, "place").sortWithinPartitions("place").mapInArrow(post, "link boolean, a long, b long")


def _stars(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Each key with its first node (link false), and links from that node to the key's others."""
    k, v, a, b = _linked(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
    for link, x, y in ((False, k, v), (True, a, b)):
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), link)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["link", "a", "b"])


def _linked(keys_: np.ndarray, nodes_: np.ndarray) -> tuple[np.ndarray, ...]:
    """First node of each key, and pairs of a key's first node with its others."""
    order = np.lexsort((nodes_, keys_))
    k, v = keys_[order], nodes_[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    lead = v[np.flatnonzero(new)][np.cumsum(new) - 1]
    other = lead != v
    pair = np.unique(np.column_stack((lead[other], v[other])), axis=0)
    return k[new], v[new], pair[:, 0], pair[:, 1]


def star_links(posted: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that share a key, as stars, from the rows that `_stars` sends."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_node = None
        for t in batches:
            if not t.num_rows:
                continue
            link = t.column(0).to_numpy(zero_copy_only=False)
            a, b = t.column(1).to_numpy(), t.column(2).to_numpy()
            if link.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[link]), pa.array(b[link])], names=["a", "b"])
            k, v = a[~link], b[~link]
            if not len(k):
                continue
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            lead = v[np.flatnonzero(new)]
            if last_key is not None and k[0] == last_key:
                lead = lead.copy()
                lead[0] = last_node  # the key went on from the batch before
            lead = lead[np.cumsum(new) - 1]
            last_key, last_node = k[-1], lead[-1]
            other = lead != v
            if other.any():
                pair = np.unique(np.column_stack((lead[other], v[other])), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    n = max(1, int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    posted = posted.repartition(n, "a").sortWithinPartitions("link", "a")
    return posted.mapInArrow(join, "a long, b long").distinct()


def loose_links(docs: DataFrame, s: Setting, text: str, often: np.ndarray, seen: np.ndarray, total: int) -> DataFrame:
    """Pairs (a, b) of nodes that share a posted shingle, as stars."""
    return star_links(postings(docs, s, text, often, seen, total))


def levels(percent: int) -> np.ndarray:
    """First sizes of bands: a set and a larger similar one are of the same or of neighbouring bands."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, np.int64)


def part_keys(flat: np.ndarray, size: np.ndarray, salt: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the parts of each set, and the sets' positions: similar sets of equal salt share a key.

    Sets a and b differ in (100 - percent) / (100 + percent) * (a + b)
    shingles at most. They meet at the level of the larger one, where hashes
    deal shingles to more parts than that. A set that leaves too many parts
    empty, so that its filled ones could all differ, names its empty ones too.
    """
    start = levels(percent)
    band = np.searchsorted(start, size, side="right") - 1
    owner = np.repeat(np.arange(len(size)), size)
    h = mix(flat ^ np.uint64(0x2545F4914F6CDD1D))
    body = mix(flat ^ np.uint64(0x9FB21C651E98DF25))
    keys, at = [], []
    for up in (0, 1):  # as the larger set, and as the smaller one of a set in the next band
        level = band + up
        top = start[level + 1] - 1
        most = (100 - percent) * 2 * top // (100 + percent)
        parts = most + most // 32 + 3
        other = size if not up else np.minimum(top, size * 100 // percent)
        differ = (100 - percent) * (size + other) // (100 + percent)
        base = np.cumsum(parts) - parts
        place = base[owner] + ((h >> np.uint64(32)) * parts[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        n = int(parts.sum())
        filled = np.bincount(place, minlength=n) > 0
        total = np.zeros(n, np.uint64)
        np.add.at(total, place, body)
        whose = np.repeat(np.arange(len(size)), parts)
        short = np.bincount(whose[filled], minlength=len(size)) <= differ
        take = np.flatnonzero(filled | short[whose])
        who = whose[take]
        where = (level[who].astype(np.uint64) << np.uint64(40)) + (take - base[who]).astype(np.uint64)
        keys.append(mix(mix(total[take] + mix(where)) ^ salt[who]))
        at.append(who)
    return np.concatenate(keys), np.concatenate(at)


def wanted_only(src: DataFrame, wanted: DataFrame) -> DataFrame:
    """src (id, __text) without most rows whose id isn't in wanted: those with another bit in a bitmap of fixed size."""
    h = (F.pmod(F.xxhash64("id"), F.lit(KEY_BITS)) + 1).alias("h")
    rows = wanted.select(h).groupBy(F.bitmap_bucket_number("h").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("v")).collect()
    bits = np.zeros(KEY_BITS // 8, np.uint8)
    for k, v in rows:  # KEY_BITS / 32,768 rows at most
        bits[(k - 1) * 4096 : k * 4096] = np.frombuffer(bytes(v), np.uint8)
    shared = src.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            at = column(b, "h").to_numpy() - 1
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            if hit.any():
                yield b.select(["id", "__text"]).filter(pa.array(hit.astype(bool)))

    return src.where(F.col("id").isNotNull()).select("id", "__text", h).mapInArrow(run, src.schema)


def part_links(src: DataFrame, wanted: DataFrame, s: Setting) -> DataFrame:
    """Pairs (a, b) of nodes of one component that have an equal part, as stars. wanted: id, node, component."""
    picked = wanted_only(src, wanted).join(wanted.hint("merge"), "id")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        most = 0
        for b in slices(batches, "__text"):
            flat, offsets, node = _sets(b, s)
            ok = node.view(np.int64) == column(b, "node").to_numpy()  # another row may have the id
            size = np.diff(offsets)
            salt = mix(column(b, "component").to_numpy().view(np.uint64))
            key, at = part_keys(flat[np.repeat(ok, size)], size[ok], salt[ok], s.percent)
            held.append((key, node[ok][at]))
            most += len(key)
            if most > HELD:
                yield from _stars(held)
                held, most = [], 0
        if held:
            yield from _stars(held)
        release()

    return star_links(picked.select("__text", "node", "component").mapInArrow(post, "link boolean, a long, b long"))


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while True:
            n = self.up[r]
            if (n == r).all():
                return r
            r = n


def tile_links(sets: list[np.ndarray], side: np.ndarray, percent: int, weight: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the pairs of sets with similarity >= percent/100, and each set's links by the other sets' weight.

    side: 0 or 1 for the two tiles that meet, 2 where all pairs are asked for.
    """
    order = np.argsort([len(x) for x in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order], np.int64)
    side = side[order]
    w = np.ones(len(order), np.int64) if weight is None else weight[order]
    width = int(min(256, max(4, 1 << int(np.ceil(np.log2(max(1, 2 * size[-1]) / 64 + 1))))))
    bits = np.zeros((len(order), width), np.uint64)
    for r, i in enumerate(order):
        h = sets[i] >> np.uint64(20)
        np.bitwise_or.at(bits[r], ((h >> np.uint64(6)) % np.uint64(width)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    excess = size - np.bitwise_count(bits).sum(1)
    first = np.concatenate(([0], np.cumsum(size)))
    flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    mine = np.zeros(int(flat.max()) + 1, np.uint8)  # whether a shingle is in the set at hand
    forest, out, count = _Forest(len(order)), [], np.zeros(len(order), np.int64)
    for r in range(len(order)):
        mine[flat[first[r] : first[r + 1]]] = 1
        # sets are in order of size: those from r + 1 up to size / t can be similar
        stop = int(np.searchsorted(size, size[r] * 100 // percent, side="right"))
        for begin in range(r + 1, stop, 4096):
            j = np.arange(begin, min(stop, begin + 4096))
            if side[r] != 2:
                j = j[side[j] != side[r]]
            need = -((-percent * (size[r] + size[j])) // (100 + percent))
            j = j[np.bitwise_count(bits[j] & bits[r]).sum(1) + np.minimum(excess[r], excess[j]) >= need]
            if not len(j):
                continue
            low, n = first[j], size[j]
            base = np.cumsum(n) - n
            if 2 * int(n.sum()) > first[j[-1] + 1] - low[0]:  # most of the sets between: read them in one piece
                same = np.add.reduceat(mine[flat[low[0] : first[j[-1] + 1]]], first[j[0] : j[-1] + 1] - low[0], dtype=np.int64)[j - j[0]]
            else:
                same = np.add.reduceat(mine[flat[np.arange(int(n.sum())) + np.repeat(low - base, n)]], base, dtype=np.int64)
            j = j[100 * same >= percent * (size[r] + n - same)]
            count[r] += w[j].sum()
            count[j] += w[r]
            for q in j[forest.roots(j) != forest.root(r)].tolist():
                if forest.root(q) != forest.root(r):
                    forest.up[forest.root(q)] = forest.root(r)
                    out.append((int(order[r]), int(order[q])))
        mine[flat[first[r] : first[r + 1]]] = 0
    found = np.zeros(len(order), np.int64)
    found[order] = count
    return out, found


def links(docs: DataFrame, s: Setting, key: str, text: str, classes: DataFrame, often: np.ndarray, seen: np.ndarray, total: int) -> DataFrame:
    """Exact links between nodes: a spanning forest of each tile, as rows with a < b or a > b, and rows (a, a, links of a in a tile).

    classes: node, n, id, rows (one row a node).
    """
    src = docs.select(F.col(key).alias("id"), F.col(text).alias("__text"))
    groups = components(loose_links(docs, s, text, often, seen, total), "loose")
    ratio = float(np.log(100 / s.percent)) * (1 + 1e-9)  # sizes in that very ratio stay neighbours
    member = classes.join(groups.hint("merge"), "node").withColumn("band", F.floor(F.log("n") / ratio).cast("int"))
    member = written(member, "members")
    large = member.groupBy("component").count().where(F.col("count") > LOOSE).select("component")
    if large.limit(1).count():
        flagged = written(member.join(large.withColumn("large", F.lit(True)).hint("merge"), "component", "left"), "members")
        again = flagged.where("large")
        tight = components(part_links(src, again.select("id", "node", "component"), s), "tight")
        anew = again.drop("component").join(tight.hint("merge"), "node")
        discard(member)
        member = written(flagged.where("large is null").unionByName(anew).drop("large"), "members")
        discard(flagged)
    total = member.groupBy("component", "band").agg(F.sum("n").alias("m"))
    whole = total.groupBy("component").agg(F.sum("m").alias("all"))
    parts = total.join(whole.hint("merge"), "component").select("component", "band", "all", F.ceil(2 * F.col("m") / TILE).cast("int").alias("parts"))
    one = F.col("all") <= TILE
    around = parts.alias("p").join(parts.select(F.col("component").alias("c2"), F.col("band").alias("b2"), F.col("parts").alias("parts2")).hint("merge"), (F.col("component") == F.col("c2")) & (F.abs(F.col("band") - F.col("b2")) <= 1), "inner")
    near = around.groupBy("component", "band", "all").agg(F.max("parts").alias("parts"), F.collect_list(F.struct("b2", "parts2")).alias("near"))  # three at most
    at = F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")
    dealt = member.join(near.hint("merge"), ["component", "band"]).withColumn("part", at)
    mine = F.struct(F.col("band").alias("b"), F.col("part").alias("p"))
    meets = F.flatten(F.transform("near", lambda x: F.transform(F.sequence(F.lit(0), x["parts2"] - 1), lambda p: F.struct(x["b2"].alias("b"), p.alias("p")))))
    tiles = F.when(one, F.array(F.struct(F.lit("").alias("tile"), F.lit(2).alias("side")))).otherwise(
        F.transform(
            meets,
            lambda o: F.struct(
                F.concat_ws(":", F.least(mine, o)["b"], F.least(mine, o)["p"], F.greatest(mine, o)["b"], F.greatest(mine, o)["p"]).alias("tile"),
                F.when(mine == o, 2).when(mine < o, 0).otherwise(1).alias("side"),
            ),
        )
    )
    wanted = dealt.select("id", "node", "component", "rows", tiles.alias("tiles"))
    picked = wanted_only(src, member.select("id")).join(wanted.hint("merge"), "id")

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            flat, offsets, node = _sets(b, s)
            ok = pa.array(node.view(np.int64) == column(b, "node").to_numpy())  # another row may have the id
            raw = [flat[offsets[i] : offsets[i + 1]].tobytes() for i in range(b.num_rows)]
            out = pa.RecordBatch.from_arrays([column(b, "node"), column(b, "component"), column(b, "rows"), column(b, "tiles"), pa.array(raw, pa.binary())], names=["node", "component", "rows", "tiles", "body"])
            yield out.filter(ok)

    sent = picked.mapInArrow(bodies, picked.select("node", "component", "rows", "tiles").schema.add("body", "binary"))
    sent = sent.select("node", "component", "rows", "body", F.explode("tiles").alias("t")).select("node", "component", "rows", "body", "t.tile", "t.side")
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = sent.repartition(n, "component", "tile").sortWithinPartitions("component", "tile", "node")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now: tuple | None = None

        def judged() -> Iterator[pa.RecordBatch]:
            node, sets, side, rows = [], [], [], []
            for h in held:
                raw, offsets = buffers_binary(column(h, "body"))
                v = raw.view(np.uint64)
                for i, (x, y, k) in enumerate(zip(column(h, "node").to_pylist(), column(h, "side").to_pylist(), column(h, "rows").to_pylist(), strict=True)):
                    if not node or x != node[-1]:  # rows that share an id may send a node twice
                        node.append(x)
                        side.append(y)
                        rows.append(k)
                        sets.append(v[offsets[i] // 8 : offsets[i + 1] // 8])
            held.clear()
            if len(node) > 1:
                found, count = tile_links(sets, np.array(side), s.percent, np.array(rows, np.int64))
                at = np.flatnonzero(count)
                if len(at):
                    own = np.array(node, np.int64)
                    pair = np.array(found, np.int64).reshape(-1, 2)
                    a, b = np.concatenate((pair[:, 0], at)), np.concatenate((pair[:, 1], at))
                    n = np.concatenate((np.zeros(len(pair), np.int64), count[at]))
                    yield pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(own[b]), pa.array(n)], names=["a", "b", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            c, t = column(b, "component").to_numpy(), column(b, "tile").to_pylist()
            edge = [i for i in range(1, b.num_rows) if c[i] != c[i - 1] or t[i] != t[i - 1]]
            for x, y in zip([0, *edge], [*edge, b.num_rows], strict=True):
                if now is not None and now != (c[x], t[x]):
                    yield from judged()
                now = (c[x], t[x])
                held.append(b.slice(x, y - x))
        if held:
            yield from judged()
        release()

    return sent.mapInArrow(meet, "a long, b long, n long")


def classified(docs: DataFrame, s: Setting = NEAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_shingles, component_id (least key reachable by links, itself included), n_links (other rows linked with it)."""
    every = written(sized(docs, s, key, text), "sized")
    often, seen, total = frequent(every)
    rows = every.where(F.col("shingle").isNull()).select(F.col("__key").alias(key), "n_shingles", "node")
    classes = rows.where("n_shingles > 0").groupBy("node").agg(F.min(key).alias("id"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows")).where(F.col("id").isNotNull())
    exact = written(links(docs, s, key, text, classes, often, seen, total), "links")
    groups = components(exact, "groups")
    least = groups.join(classes.select("node", "id").hint("merge"), "node").groupBy("component").agg(F.min("id").alias("__least"))
    grouped = groups.join(least.hint("merge"), "component").select("node", "__least")
    counted = exact.where(F.col("a") == F.col("b")).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("__links"))
    # every node: its group's least id, or its own class's, and the links of its rows
    named = classes.select("node", "id", "rows").join(grouped.hint("merge"), "node", "left").join(counted.hint("merge"), "node", "left")
    named = named.select("node", F.coalesce("__least", "id").alias("component_id"), (F.coalesce("__links", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    out = rows.join(named.hint("merge"), "node", "left")
    component = F.when(F.col("n_shingles") == 0, F.col(key)).otherwise(F.coalesce("component_id", F.col(key)))
    return out.select(key, "n_shingles", component.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def representatives(docs: DataFrame, s: Setting = NEAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay when one document of each group does: that with the least key.

    Rows with a null key, and repeated rows of the document that stays, stay.
    """
    told = classified(docs, s, key, text).where(F.col(key) != F.col("component_id")).select(key).distinct()
    return docs.join(told.hint("merge"), key, "left_anti").select(docs.columns)
