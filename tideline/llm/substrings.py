"""Substring dedup: repeated windows of words, found with a compressed FM-index per shard.

A window is WINDOW consecutive words of one document. A word goes if a window
over it has a word sequence that also starts earlier (in a smaller doc_id, or
in the same document at an earlier word).

1. Every window has an anchor: the first of its GRAM-word runs in one order of
   all such runs, the leftmost of equals. Equal windows have equal anchors at
   equal places, so only windows at anchors that the corpus holds twice can
   repeat. Consecutive windows with the same anchor form one snippet of at most
   2 * WINDOW words. The order is by hash, but runs that are very frequent in a
   sample of the documents come last: a common phrase is no anchor where a
   window has anything else. Any order gives the same results, so the sample
   moves work only.
2. Anchors are counted with map-side sums, and snippets at repeated anchors are
   reduced to one first occurrence for each distinct snippet (an anchor and a
   class, 127 bits of hash). A later occurrence of the same snippet has an
   earlier start for each of its windows. Frequent anchors are known by a bit;
   their snippets are summed where they are and never dealt by anchor.
3. First occurrences go to shards by anchor. Each shard is indexed: suffix
   order, Burrows-Wheeler transform, wavelet matrix with ranked bit vectors.
   All windows of the shard are streamed through it by backward search, which
   tells how many words match (up to the window's length); a whole window's
   interval tells its occurrences, of which the earliest counts.
4. The verdicts return to their documents, which drop the covered words.

A shard's index takes blocks of at most BLOCK words; an anchor with more is
indexed block by block and its windows pass all of them. The distinct snippets
at one anchor, some 250 bytes each however often they occur, meet in one task.

Null and empty texts have no words, and an empty table gives an empty one. Very
long texts are read whole. Rows with a null id come after all others. Rows with
the same id count as one document at the same places: none of them is earlier
than the other. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.words import Words, buffers, column, cut, mix, release, slices
from tideline.session import discard, written

WINDOW, GRAM = 20, 6
BLOCK = 400_000
LAST_ID = (1 << 63) - 1
#: Of one document in SAMPLED, runs seen as often as this are frequent, at most FREQUENT of them; a task counts HELD at once.
SAMPLED, FREQUENT_LEAST, FREQUENT, HELD = 64, 32, 1 << 20, 1_000_000


class Snippets:
    """The snippets of the texts of w: word ranges [start, stop + window - 1), by anchor and class.

    frequent: sorted hashes of runs that come last in the order of anchors.
    """

    def __init__(self, w: Words, frequent: np.ndarray, window: int = WINDOW, gram: int = GRAM):
        self.window = window
        g, _ = w.grams(gram)
        full, fits = w.grams(window)
        s = np.flatnonzero(fits)
        span = window - gram + 1
        if not len(s):
            self.text = self.pos = self.begin = self.end = np.zeros(0, np.int64)
            self.anchor = self.cls = np.zeros(0, np.uint64)
            self.fresh = np.zeros(0, bool)
            return
        g = g >> np.uint64(1)
        if len(frequent):
            bits = np.zeros(1 << 20, bool)
            bits[(frequent >> np.uint64(43)).astype(np.int64)] = True
            maybe = np.flatnonzero(bits[(g >> np.uint64(43)).astype(np.int64)])
            spot = np.minimum(np.searchsorted(frequent, g[maybe]), len(frequent) - 1)
            g[maybe[frequent[spot] == g[maybe]]] |= np.uint64(1 << 63)
        at = s + np.lib.stride_tricks.sliding_window_view(g, span)[s].argmin(1)
        text = w.text[s]
        edge = np.ones(len(s), bool)
        edge[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(s)) - 1
        self.begin, self.end = s[first], s[last] + window  # words
        self.text = text[first]
        self.pos = self.begin - w.first[self.text]
        self.anchor = g[at[first]]
        shape = ((at[first] - self.begin) * 64 + (self.end - self.begin)).astype(np.uint64)
        self.cls = mix(full[s[first]] * np.uint64(0x9E3779B97F4A7C15) + full[s[last]] * np.uint64(0xC2B2AE3D27D4EB4F) + shape)
        key = mix(self.cls + self.text.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        order = np.argsort(key, kind="stable")
        self.fresh = np.ones(len(key), bool)  # the first of its class in its text
        self.fresh[order[1:]] = key[order[1:]] != key[order[:-1]]


class BitVector:
    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.zeros = n - int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before i."""
        block = i >> 6
        low = self.words[block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(low)


class FMIndex:
    """FM-index of sequences of word hashes, for patterns of up to 32 words."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.symbols, ids = np.unique(flat, return_inverse=True)
        n = len(flat) + len(sizes)
        self.offset = np.cumsum(sizes + 1) - sizes - 1
        text = np.zeros(n, np.int64)  # 0 ends each sequence
        place = np.ones(n, bool)
        place[self.offset + sizes] = False
        text[place] = ids + 1
        rank, width = text, 1
        while width < 32:
            key = rank * (n + 2)
            key[:-width] += rank[width:] + 1
            order = np.argsort(key)
            k = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
            width *= 2
        self.suffix = np.argsort(rank)
        bwt = text[self.suffix - 1]
        count = np.bincount(bwt, minlength=len(self.symbols) + 1)
        self.before = np.concatenate(([0], np.cumsum(count)))
        self.levels: list[tuple[int, BitVector]] = []
        node = np.zeros(len(self.symbols) + 1, np.int64)  # where each symbol's run starts at the lowest level
        every = np.arange(len(node))
        for bit in range(max(1, len(self.symbols).bit_length()) - 1, -1, -1):
            bits = (bwt >> bit) & 1
            v = BitVector(bits.astype(np.uint8))
            self.levels.append((bit, v))
            ones = v.rank(node)
            node = np.where((every >> bit) & 1, v.zeros + ones, node - ones)
            bwt = np.concatenate((bwt[bits == 0], bwt[bits == 1]))
        self.node = node

    def occurrences(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol c occurs in the transform before i."""
        for bit, v in self.levels:
            ones = v.rank(i)
            i = np.where((c >> bit) & 1, v.zeros + ones, i - ones)
        return i - self.node[c]

    def numbers(self, flat: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 for a word that the index lacks."""
        at = np.minimum(np.searchsorted(self.symbols, flat), len(self.symbols) - 1)
        return np.where(self.symbols[at] == flat, at + 1, 0)

    def search(self, codes: np.ndarray, start: np.ndarray, length: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of codes[start:start+length].

        Returns intervals [low, high), and how many words from the end were
        matched with `least` occurrences; less than length where it broke off.
        """
        n = len(start)
        all_low, all_high, reached = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, length)
        live = np.arange(n)
        low = high = np.zeros(0, np.int64)
        for j in range(length - 1, -1, -1):
            c = codes[start[live] + j]
            if j == length - 1:
                low, high = self.before[c], self.before[c + 1]
            else:
                both = self.occurrences(np.concatenate((c, c)), np.concatenate((low, high)))
                low, high = self.before[c] + both[: len(c)], self.before[c] + both[len(c) :]
            ok = (high - low >= least) & (c > 0)
            if not ok.all():
                reached[live[~ok]] = length - 1 - j
                live, low, high = live[ok], low[ok], high[ok]
        all_low[live], all_high[live] = low, high
        return all_low, all_high, reached


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low:high] for each interval, by a sparse table."""
    out = np.full(len(low), np.iinfo(np.int64).max)
    if not len(low):
        return out
    level = np.frexp((high - low).astype(np.float64))[1] - 1  # floor(log2)
    table = values
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
    return out


def repeated_windows(flat: np.ndarray, sizes: np.ndarray, doc: np.ndarray, pos: np.ndarray, window: int = WINDOW, block: int = BLOCK) -> np.ndarray:
    """For each snippet a bit mask of its windows that start earlier elsewhere.

    Snippets are word runs (flat, sizes) at word pos of document doc.
    """
    offset = np.cumsum(sizes) - sizes
    n_win = sizes - window + 1
    owner = np.repeat(np.arange(len(sizes)), n_win)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    first_win = np.cumsum(n_win) - n_win
    own_doc, own_pos = doc[owner], pos[owner] + nth
    # one order of all window starts by (document, word); equal places get equal numbers
    order = np.lexsort((own_pos, own_doc))
    new = np.ones(len(order), bool)
    new[1:] = (own_doc[order[1:]] != own_doc[order[:-1]]) | (own_pos[order[1:]] != own_pos[order[:-1]])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new)
    earliest = place.copy()
    begin = 0
    while begin < len(sizes):
        stop = max(begin + 1, int(np.searchsorted(np.cumsum(sizes[begin:]), block, side="right")) + begin)
        part = slice(offset[begin], offset[stop - 1] + sizes[stop - 1])
        index = FMIndex(flat[part], sizes[begin:stop])
        whole = begin == 0 and stop == len(sizes)
        codes = index.numbers(flat)
        # the place of the window that starts at each text position of the index
        spot = np.full(len(index.suffix), np.iinfo(np.int64).max)
        inside = (owner >= begin) & (owner < stop)
        spot[index.offset[owner[inside] - begin] + nth[inside]] = place[inside]
        spot = spot[index.suffix]
        # Each snippet's windows from left to right. Where a search breaks off at a word, no window that
        # ends later and holds that word is found either: the next to ask for starts after it.
        ask = np.arange(len(sizes))
        at = np.zeros(len(sizes), np.int64)
        while len(ask):
            low, high, reached = index.search(codes, offset[ask] + at, window, least=2 if whole else 1)
            hit = reached == window
            win = first_win[ask[hit]] + at[hit]
            earliest[win] = np.minimum(earliest[win], _range_min(spot, low[hit], high[hit]))
            at = at + np.where(hit, 1, window - reached)
            more = at < n_win[ask]
            ask, at = ask[more], at[more]
        begin = stop
    mask = np.zeros(len(sizes), np.int64)
    np.add.at(mask, owner, np.where(earliest < place, np.int64(1) << nth, 0))
    return mask


def _ids(b: pa.RecordBatch) -> np.ndarray:
    return column(b, "__id").to_numpy(zero_copy_only=False).astype(np.int64)


def _frequent(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the runs that are frequent in a sample of the documents; FREQUENT at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            run_, seen = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(run_[seen > 1].view(np.int64)), pa.array(seen[seen > 1])], names=["run", "seen"])

        for b in slices(batches, "__text"):
            g, fits = cut(*buffers(column(b, "__text"))).grams(GRAM)
            held.append(g[fits] >> np.uint64(1))
            if sum(map(len, held)) > HELD:
                yield flush()
        if held:
            yield flush()

    part = docs.where(F.pmod(F.xxhash64("__id", "__text"), F.lit(SAMPLED)) == 0).select("__text")
    seen = written(part.mapInArrow(run, "run long, seen long").groupBy("run").agg(F.sum("seen").alias("seen")), "frequent")
    total = seen.agg(F.sum("seen")).first()[0] or 0
    got = seen.where(F.col("seen") >= max(FREQUENT_LEAST, -(-total // FREQUENT))).select("run").toPandas()
    discard(seen)
    return np.sort(got["run"].to_numpy(np.int64).view(np.uint64))


def _anchors(docs: DataFrame, frequent: Broadcast) -> DataFrame:
    """One row for each snippet that is the first of its class in its text; frequent anchors are below zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            s = Snippets(cut(*buffers(column(b, "__text"))), frequent.value)
            k = s.fresh
            yield pa.RecordBatch.from_arrays([pa.array(s.anchor[k].view(np.int64)), pa.array(s.cls[k].view(np.int64)), pa.array(_ids(b)[s.text[k]]), pa.array(s.pos[k].astype(np.int32))], names=["anchor", "cls", "doc", "pos"])

    return docs.mapInArrow(run, "anchor long, cls long, doc long, pos int")


def _contents(docs: DataFrame, frequent: Broadcast) -> DataFrame:
    """The words of the snippets named in column firsts, as 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            w = cut(*buffers(column(b, "__text")))
            s = Snippets(w, frequent.value)
            wanted = column(b, "firsts").to_pylist()
            want = {(i, x["pos"], x["cls"]) for i, f in enumerate(wanted) for x in f or ()}
            cls = s.cls.view(np.int64)
            pick = [i for i, k in enumerate(zip(s.text.tolist(), s.pos.tolist(), cls.tolist(), strict=True)) if k in want]
            h = w.hash
            yield pa.RecordBatch.from_arrays([pa.array(s.anchor[pick].view(np.int64)), pa.array(cls[pick]), pa.array(_ids(b)[s.text[pick]]), pa.array(s.pos[pick].astype(np.int32)), pa.array([h[s.begin[i] : s.end[i]].tobytes() for i in pick], pa.binary())], names=["anchor", "cls", "doc", "pos", "body"])

    return docs.mapInArrow(run, "anchor long, cls long, doc long, pos int, body binary")


def _verdicts(snippets: DataFrame) -> DataFrame:
    """Index each shard (rows sorted by anchor) and search its windows: a mask for each snippet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            if size > BLOCK * 8:
                # keep back the last anchor, which may go on in the next batch
                t = pa.Table.from_batches(held).combine_chunks()
                anchor = t["anchor"].to_numpy()
                cut_at = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if (anchor != anchor[-1]).any() else 0
                if cut_at:
                    yield from judged(t.slice(0, cut_at))
                    held = t.slice(cut_at).combine_chunks().to_batches()
                    size = sum(x.nbytes for x in held)
        if held:
            yield from judged(pa.Table.from_batches(held).combine_chunks())
        release()

    def judged(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        body = t["body"].combine_chunks()
        body = body if isinstance(body, pa.Array) else pa.concat_arrays(body.chunks)
        raw, offsets = buffers_binary(body)
        sizes = np.diff(offsets) // 8
        doc, pos = t["doc"].to_numpy(), t["pos"].to_numpy().astype(np.int64)
        flat, offset = raw.view(np.uint64), np.concatenate(([0], np.cumsum(sizes)))
        anchor = t["anchor"].to_numpy()
        group = np.append(np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))), len(anchor))
        parts, begin = [], 0
        while begin < len(anchor):  # whole anchors, as many as an index takes, one at least
            last = int(np.searchsorted(offset[group], offset[begin] + BLOCK, side="right")) - 1
            stop = int(group[max(last, int(np.searchsorted(group, begin, side="right")))])
            parts.append(repeated_windows(flat[offset[begin] : offset[stop]], sizes[begin:stop], doc[begin:stop], pos[begin:stop]))
            begin = stop
        mask = np.concatenate(parts)
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(pos.astype(np.int32)), pa.array(t["cls"].to_numpy()), pa.array(mask)], names=["doc", "pos", "cls", "mask"])

    return snippets.mapInArrow(run, "doc long, pos int, cls long, mask long")


def buffers_binary(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy(), offsets - offsets[0]


def covered(s: Snippets, masks: list[dict[tuple[int, int], int]], n: int) -> np.ndarray:
    """Which of n words lie in a window that starts earlier elsewhere.

    masks: for each text, (pos, class) of its snippets at repeated anchors ->
    mask; -1: all windows.
    """
    bits = np.zeros(len(s.text), np.int64)
    cls = s.cls.view(np.int64)
    full = (np.int64(1) << (s.end - s.begin - s.window + 1)) - 1
    for i, (t, p, c) in enumerate(zip(s.text.tolist(), s.pos.tolist(), cls.tolist(), strict=True)):
        if masks[t]:
            bits[i] = masks[t].get((p, c), 0)
    bits = np.where(s.fresh, np.where(bits < 0, full, bits), full)
    step = np.zeros(n + 1, np.int64)
    for k in range(s.window):
        hit = np.flatnonzero(bits >> k & 1)
        if not len(hit) and k > s.window - GRAM + 1:
            break
        np.add.at(step, s.begin[hit] + k, 1)
        np.add.at(step, s.begin[hit] + k + s.window, -1)
    return np.cumsum(step)[:n] > 0


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", real: bool = False) -> DataFrame:
    """One row a document: key, n_words, n_removed, kept_sha256; with real=True also kept_text."""
    src = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID)).alias("__id"), F.col(key).alias("__key"), F.col(text).alias("__text"))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(src))
    found = written(_anchors(src.select("__id", "__text"), frequent), "anchors")
    often, seldom = found.where("anchor < 0"), found.where("anchor >= 0")
    twice = seldom.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    occurs = seldom.join(twice.hint("merge"), "anchor", "left_semi")
    every = occurs.unionByName(often).select("doc", "pos", "cls", F.lit(False).alias("first"))
    for part in (occurs, often):
        least = part.groupBy("anchor", "cls").agg(F.min(F.struct("doc", "pos")).alias("at"))
        every = every.unionByName(least.select("at.doc", "at.pos", "cls", F.lit(True).alias("first")))
    lists = every.groupBy("doc").agg(
        F.collect_list(F.when(~F.col("first"), F.struct("pos", "cls"))).alias("occurs"),
        F.collect_list(F.when(F.col("first"), F.struct("pos", "cls"))).alias("firsts"),
    )
    lists = written(lists, "substrings")
    discard(found)
    bodies = _contents(src.select("__id", "__text").join(lists.where(F.size("firsts") > 0).select(F.col("doc").alias("__id"), "firsts").hint("merge"), "__id"), frequent)
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # dealt by anchor, equal snippets lie together too: rows with the same id are told apart without another exchange
    masks = _verdicts(bodies.repartition(n, "anchor").dropDuplicates(["anchor", "cls"]).sortWithinPartitions("anchor", "doc", "pos"))
    masks = written(masks.groupBy("doc").agg(F.collect_list(F.struct("pos", "cls", "mask")).alias("masks")), "substrings")
    told = lists.select("doc", "occurs").join(masks, "doc", "left").withColumnRenamed("doc", "__id")
    rows = src.join(told.hint("merge"), "__id", "left")
    schema = docs.select(F.col(key)).schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    schema = schema.add("kept_text", "string") if real else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            data, offsets = buffers(column(b, "__text"))
            w = cut(data, offsets)
            table = []
            for o, m in zip(column(b, "occurs").to_pylist(), column(b, "masks").to_pylist(), strict=True):
                at = {(x["pos"], x["cls"]): -1 for x in o or ()}
                at.update({(x["pos"], x["cls"]): x["mask"] for x in m or ()})
                table.append(at)
            gone = covered(Snippets(w, frequent.value), table, len(w.start))
            raw = data.tobytes()
            kept = []
            for i in range(b.num_rows):
                words = raw[offsets[i] : offsets[i + 1]].split()
                kept.append(b" ".join(compress(words, ~gone[w.first[i] : w.first[i + 1]])))
            n_gone = np.add.reduceat(np.append(gone, 0), w.first[:-1]) * (w.n > 0) if b.num_rows else []
            cols = [column(b, "__key"), pa.array(w.n), pa.array(np.asarray(n_gone, np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            if real:
                cols.append(pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.mapInArrow(run, schema)
