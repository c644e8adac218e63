"""Alignment of two tokenizers over the same texts, byte by byte.

A is a byte-level BPE tokenizer (a tokenizers JSON file), B a SentencePiece
BPE model with byte fallback. A reads a space and the text, B the text, to
which it adds that space itself; special tokens' strings are plain text. The
bytes of both token sequences are then the same bytes cut at other places:

* running sums of token sizes are the tokens' ends;
* `intersect1d` of both tokenizers' ends gives the common cuts, which part a
  text into groups, and `searchsorted` in them each token's group;
* the tokens of B from the one that holds a token of A's first byte to the one
  that holds its last byte overlap it: a range, which `repeat` expands to
  links;
* the documents that hold a pair of ids linked are counted by a shuffle in two
  stages, first by pair and salt, then by pair.

Documents look their pairs' counts up without moving: the commonest pairs (2^20
at most) are broadcast, sorted, and only pairs below a cut in frequency are
joined by a shuffle. No such pair is held by more documents than the cut says,
so no key of that join is hot.

A text has no tokens, and zeros in every count, where it is null or empty or
where the bytes that A or B give differ from a space and the text (U+2581 in a
text, bytes that are no UTF-8). Repeated rows each count as a document; ids
may repeat or be null, since rows have a number of their own. An empty table
gives an empty one. A text is aligned whole, however long. Of pairs with the
same count all are best. Columns other than the text and those kept are not
looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.words import buffers, column, slices, unused
from tideline.session import written

#: Pairs whose counts are broadcast, at most: 13 bytes each.
COMMON = 1 << 20
#: Salts of the first counting stage.
SALTS = 16
#: Blank runs from this size on are beyond the faster encoder's regular expressions.
BLANKS = re.compile(r"\s{100000}")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class Tokens:
    """What each id stands for: size bytes of pool from start on."""

    pool: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(entries: list[bytes]) -> Tokens:
        size = np.array([len(e) for e in entries], np.int64)
        return Tokens(np.frombuffer(b"".join(entries), np.uint8), np.cumsum(size) - size, size)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - (ends - size), size)]


class ByteBpe:
    """Tokenizer A. Where its merges are in the order of its ids a faster encoder takes the same steps."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its core
        self.slow = Tokenizer.from_str(spec)
        self.slow.encode_special_tokens = True
        parsed = json.loads(spec)
        model, special = parsed["model"], {t["content"] for t in parsed.get("added_tokens", [])}
        vocabulary, alphabet = self.slow.get_vocab(), byte_alphabet()
        entries = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            entries[i] = t.encode() if t in special else bytes(alphabet[c] for c in t)
        self.tokens = Tokens.of(entries)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranked = [vocabulary.get("".join(p), -1) for p in pairs]
        self.fast = None
        pre = parsed.get("pre_tokenizer") or {}
        if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and ranked == list(range(256, 256 + len(pairs))) and not parsed.get("normalizer"):
            import public_tokenizers
            import tiktoken

            ranks = {entries[i]: i for i in range(256 + len(pairs))}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            if self.fast is None or (len(t) >= 100_000 and BLANKS.search(t)):
                out.append(np.array(self.slow.encode(t, add_special_tokens=False).ids, np.int64))
            else:
                out.append(np.asarray(self.fast.encode_ordinary(t), np.int64))
        return out


class PieceBpe:
    """Tokenizer B."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        entries = []
        for i in range(self.model.vocab_size()):
            p = self.model.id_to_piece(i)
            entries.append(bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode())
        self.tokens = Tokens.of(entries)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(i, np.int64) for i in self.model.encode(texts, num_threads=1)]


_loaded: dict[int, tuple[ByteBpe, PieceBpe]] = {}


def tokenizers(files: tuple[str, bytes]) -> tuple[ByteBpe, PieceBpe]:
    """Both tokenizers, built once a worker."""
    key = hash(files)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = (ByteBpe(files[0]), PieceBpe(files[1]))
    return _loaded[key]


@dataclass
class Aligned:
    """One slice of texts. Arrays a_* and b_* have an element a token, link_* one a link; doc_* number the slice's texts."""

    n: int
    a: np.ndarray
    b: np.ndarray
    doc_a: np.ndarray
    doc_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray

    def per_text(self, docs: np.ndarray) -> np.ndarray:
        return np.bincount(docs, minlength=self.n).astype(np.int64)

    @property
    def groups(self) -> np.ndarray:
        """Groups of each text: tokens of A that end a group."""
        return self.per_text(self.doc_a[_last(self.group_a)])

    def first_group(self) -> np.ndarray:
        return np.cumsum(self.groups) - self.groups


def _last(group: np.ndarray) -> np.ndarray:
    """Where a run of equal numbers ends."""
    return np.append(group[1:] != group[:-1], True)[: len(group)]


def _checked(t: Tokens, encoded: list[np.ndarray], sizes: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and their texts, and which texts they spell."""
    docs = np.repeat(np.arange(len(encoded)), [len(e) for e in encoded])
    ids = np.concatenate(encoded) if encoded else np.zeros(0, np.int64)
    good = np.bincount(docs, t.size[ids], len(encoded)).astype(np.int64) == sizes
    have = t.spelled(ids[good[docs]])
    wanted = want if good.all() else want[np.repeat(good, sizes)]
    wrong = np.flatnonzero(have != wanted)
    if len(wrong):
        at = np.flatnonzero(good)
        good[at[np.searchsorted(np.cumsum(sizes[at]), wrong, "right")]] = False
    return ids, docs, good


def aligned(col: pa.Array, a: ByteBpe, b: PieceBpe) -> Aligned:
    """Tokens, groups and links of the texts of a column."""
    data, offsets = buffers(col)
    full = np.flatnonzero(np.diff(offsets))
    raw = data.tobytes()
    texts = [raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace") for i in full.tolist()]
    sizes = np.diff(offsets)[full] + 1
    want = np.full(int(sizes.sum()), 0x20, np.uint8)
    inner = np.ones(len(want), bool)
    inner[np.cumsum(sizes) - sizes] = False
    want[inner] = data
    ids_a, doc_a, good_a = _checked(a.tokens, a.encode([" " + t for t in texts]), sizes, want)
    ids_b, doc_b, good_b = _checked(b.tokens, b.encode(texts), sizes, want)
    good = good_a & good_b
    keep_a, keep_b = good[doc_a], good[doc_b]
    ids_a, ids_b, doc_a, doc_b = ids_a[keep_a], ids_b[keep_b], full[doc_a[keep_a]], full[doc_b[keep_b]]
    size_a = a.tokens.size[ids_a]
    end_a, end_b = np.cumsum(size_a), np.cumsum(b.tokens.size[ids_b])
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    first, last = np.searchsorted(end_b, end_a - size_a, "right"), np.searchsorted(end_b, end_a, "left")
    n = last - first + 1
    link_a = np.repeat(np.arange(len(ids_a)), n)
    link_b = np.arange(len(link_a)) + np.repeat(first - (np.cumsum(n) - n), n)
    return Aligned(len(col), ids_a, ids_b, doc_a, doc_b, np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b), link_a, link_b)


def _numbers(most: int) -> Tokens:
    """Decimal numbers, each with room for one separator."""
    return Tokens.of([b"%d," % i for i in range(most)])


def described(x: Aligned, decimal_a: Tokens, decimal_b: Tokens) -> list[bytes]:
    """Each text's groups as `a1,a2|b1;a3|b2,b3`."""
    na, nb = len(x.a), len(x.b)
    where_a = np.arange(na) + np.searchsorted(x.group_b, x.group_a, "left")
    where_b = np.arange(nb) + np.searchsorted(x.group_a, x.group_b, "right")
    both = Tokens(np.concatenate((decimal_a.pool, decimal_b.pool)), np.concatenate((decimal_a.start, decimal_b.start + len(decimal_a.pool))), np.concatenate((decimal_a.size, decimal_b.size)))
    ids = np.empty(na + nb, np.int64)
    ids[where_a], ids[where_b] = x.a, x.b + len(decimal_a.size)
    ends = np.cumsum(both.size[ids])
    out = both.spelled(ids)
    out[ends[where_a[_last(x.group_a)]] - 1] = ord("|")
    out[ends[where_b[_last(x.group_b)]] - 1] = ord(";")
    stop = np.concatenate(([0], ends))[np.cumsum(x.per_text(x.doc_a) + x.per_text(x.doc_b))]
    raw, start = out.tobytes(), np.concatenate(([0], stop[:-1]))
    return [raw[s : e - 1] if e > s else b"" for s, e in zip(start.tolist(), stop.tolist(), strict=True)]


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values, kind))


def groups(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), real: bool = True) -> DataFrame:
    """Each text's tokens, groups and pairs of linked ids. Map-only.

    Returns keep, n_a, n_b, n_groups, n_links, groups_sha256, pairs (a times
    the size of B's vocabulary plus b, distinct, in order) and times (links of
    each pair in the text); with real=True also a_ids, b_ids, and a_group and
    b_group with the number of each token's group in its text.
    """
    with open(path_a, encoding="utf-8") as f, open(path_b, "rb") as g:
        files = (f.read(), g.read())
    spark = docs.sparkSession
    a, b = tokenizers(files)
    na, nb = len(a.tokens.size), len(b.tokens.size)
    wide = na * nb >= 1 << 31
    shared = spark.sparkContext.broadcast(files)
    text_name = unused(list(keep), "__text")
    src = docs.select(*keep, F.col(text).alias(text_name))
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", *(["a_ids", "b_ids", "a_group", "b_group"] if real else [])]
    ints, pair = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType() if wide else T.IntegerType())
    kinds = [T.LongType()] * 4 + [T.StringType(), pair, ints, ints, ints, ints, ints]
    schema = T.StructType([*(src.schema[c] for c in keep), *(T.StructField(n, k) for n, k in zip(names, kinds, strict=False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers(shared.value)
        decimal_a, decimal_b = _numbers(na), _numbers(nb)
        for batch in slices(batches, text_name):
            x = aligned(column(batch, text_name), a, b)
            key = x.doc_a[x.link_a].astype(np.int64) * (na * nb) + x.a[x.link_a] * nb + x.b[x.link_b]
            key, times = np.unique(key, return_counts=True)
            count_a, count_b = x.per_text(x.doc_a), x.per_text(x.doc_b)
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in described(x, decimal_a, decimal_b)]
            per_pair = x.per_text(key // (na * nb))
            cols = [column(batch, c) for c in keep]
            cols += [pa.array(v, pa.int64()) for v in (count_a, count_b, x.groups, x.per_text(x.doc_a[x.link_a]))]
            cols += [pa.array(digests, pa.string()), _lists(key % (na * nb), per_pair, pa.int64() if wide else pa.int32()), _lists(times, per_pair, pa.int32())]
            if real:
                base = x.first_group()
                cols += [_lists(x.a, count_a, pa.int32()), _lists(x.b, count_b, pa.int32()), _lists(x.group_a - base[x.doc_a], count_a, pa.int32()), _lists(x.group_b - base[x.doc_b], count_b, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *names])

    out = src.mapInArrow(run, schema)
    out._tideline_sizes = (na, nb)
    return out


def pair_counts(rows: DataFrame, nb: int) -> DataFrame:
    """(a, b, pair, n_docs, best): the rows that hold each pair of ids linked, and whether no other b has more with a.

    Counted in two shuffles, by pair and salt and then by pair. A salt is a
    class of input partitions, so that a partition sends one row a pair.
    """
    seen = rows.select(F.explode("pairs").alias("pair"), (F.spark_partition_id() % SALTS).alias("salt"))
    some = seen.groupBy("pair", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = written(some.groupBy("pair").agg(F.sum("n").alias("n_docs")).withColumn("a", F.expr(f"CAST(pair DIV {nb} AS INT)")), "pair-counts")
    top = counts.groupBy("a").agg(F.max("n_docs").alias("most"))  # a row an id of A at most
    return counts.join(F.broadcast(top), "a").select("a", F.expr(f"CAST(pair % {nb} AS INT)").alias("b"), "pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def cut_of(counts: DataFrame, most: int = COMMON) -> int:
    """The least power of two such that at most `most` pairs have that many documents or more."""
    sizes = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("n_docs")).cast("int").alias("e")).count().collect()}
    at, total = max(sizes, default=0) + 1, 0
    while at > 0 and total + sizes.get(at - 1, 0) <= most:
        at -= 1
        total += sizes.get(at, 0)
    return 1 << at


def linked(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), most: int = COMMON) -> DataFrame:
    """Each row's counts, groups_sha256, n_best and count_sum.

    n_best: links whose pair no other pair with the same id of A beats;
    count_sum: the sum of the pair's documents over all links. The encoded
    rows are written once, since encoding is most of the work.
    """
    spark = docs.sparkSession
    encoded = groups(docs, path_a, path_b, text, keep, real=False)
    nb = encoded._tideline_sizes[1]
    rows = written(encoded.withColumn("__row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(rows, nb)
    cut = cut_of(counts, most)
    known = counts.where(F.col("n_docs") >= cut).select("pair", "n_docs", "best").toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(known[c].to_numpy().astype(k) for c, k in (("pair", np.int64), ("n_docs", np.int64), ("best", bool))))
    plain = [f for f in rows.schema.fields if f.name not in ("pairs", "times")]
    pair_type = rows.schema["pairs"].dataType
    schema = T.StructType([*plain, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("rare", pair_type), T.StructField("rare_times", T.ArrayType(T.IntegerType()))])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n_docs, best = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            lists, times = column(b, "pairs"), column(b, "times").flatten().to_numpy().astype(np.int64)
            pair = lists.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            at = np.searchsorted(pairs, pair)
            found = np.append(pairs, -1)[at] == pair
            hit = at[found]
            total, good = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(total, row[found], n_docs[hit] * times[found])
            np.add.at(good, row[found], best[hit] * times[found])
            left = ~found
            size = np.bincount(row[left], minlength=b.num_rows)
            cols = [column(b, f.name) for f in plain] + [pa.array(good), pa.array(total), _lists(pair[left], size, lists.type.value_type), _lists(times[left], size, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    looked = rows.mapInArrow(look_up, schema)
    own = [f.name for f in plain if f.name != "__row"]
    if cut == 1:  # the broadcast has every pair
        return looked.select(*own, "n_best", "count_sum")
    rare = looked.select("__row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("__row", F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("times"))
    less = counts.where(F.col("n_docs") < cut).select("pair", "n_docs", "best")
    sums = rare.join(less.hint("merge"), "pair").groupBy("__row").agg(F.sum(F.col("n_docs") * F.col("times")).alias("__sum"), F.sum(F.col("best").cast("long") * F.col("times")).alias("__best"))
    both = looked.drop("rare", "rare_times").join(sums.hint("merge"), "__row", "left")
    more = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return both.select(*own, more("n_best", F.col("__best")), more("count_sum", F.col("__sum")))
