"""SentencePiece merge-type encoding and decoding by backtracking.

encode(text) gives exactly what the sentencepiece library gives for a BPE
model with an identity normaliser, a dummy prefix, escaped white space and
byte fallback (anything else in the model, user-defined pieces too, is
refused). The route:

* an Aho-Corasick automaton over the vocabulary lists, for every position,
  the pieces that start there, longest first;
* the encoder takes the longest piece whose neighbour to the left is
  compatible: merging the two pieces' text afresh gives those two pieces;
* where no piece fits, it steps back and marks the position in a bitfield,
  so that no position is tried twice.

A chain of pairwise compatible pieces from the start of a text is the only
merge-order encoding of that prefix, hence the result is exact and each
position fails once at most.

Null texts count as empty; an empty text has no ids and decodes to an empty
text, and an empty table gives an empty one. Bytes that are no UTF-8 count as
U+FFFD. A very long text is encoded whole, in chunks that no merge crosses; the
bitfield takes one bit a character of a chunk. Of pairs with equal scores the
leftmost merges first, as in the library. Repeated rows give repeated rows.
Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.words import column, slices

SPACE = "▁"
#: Entries of a worker's memo of encoded chunks before it starts afresh.
MEMO = 200_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces that merge (with score), the ids of bytes, and text by id."""

    score: dict[str, float]
    ids: dict[str, int]
    byte_ids: tuple[int, ...]
    text: tuple[str, ...]
    silent: frozenset[int] = frozenset()  # control pieces, which have no text


def load(path: str) -> Vocabulary:
    """Read a model file on the driver."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    norm, train = spec.normalizer_spec, spec.trainer_spec
    plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
    if train.model_type != train.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix or not plain:
        raise ValueError("the model must be BPE with byte fallback, an identity normaliser and a dummy prefix")
    if any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in spec.pieces):
        raise ValueError("user-defined pieces are not supported")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    score, ids, byte_ids, text = {}, {}, [0] * 256, []
    for i in range(lib.vocab_size()):
        p = lib.id_to_piece(i)
        text.append(p)
        if lib.is_byte(i):
            byte_ids[int(p[1:-1], 16)] = i
        elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
            score[p], ids[p] = lib.get_score(i), i
    if any(SPACE in p.lstrip(SPACE) for p in ids):
        raise ValueError("pieces that cross white space are not supported")
    silent = frozenset(i for i in range(lib.vocab_size()) if lib.is_control(i))
    return Vocabulary(score, ids, tuple(byte_ids), tuple(text), silent)


class Encoder(dict):
    """A memo from chunk to (ids joined by commas, decoded text); misses are encoded.

    Inside, a token is a number: a piece's id, or a number past the vocabulary
    for a character that has no piece and falls back to bytes.
    """

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        super().__init__()
        self.v = v = vocabulary
        self.byte_of = {i: b for b, i in enumerate(v.byte_ids)}
        self.pairs: dict[int, bool] = {}
        self.chars: dict[str, int] = {}
        size = len(v.text)
        self.piece = list(v.text)
        self.length = [len(t) for t in v.text]
        self.shorter = [-1] * size  # the longest piece that a piece starts with
        self.joined = [str(i) for i in range(size)]
        self.shown = [self.unescaped([i]) for i in range(size)]
        self.auto = ahocorasick.Automaton()
        whole: dict[str, int] = {p: i for p, i in v.ids.items() if len(p) == 1}
        for p in sorted(v.ids, key=len):
            i = v.ids[p]
            if len(p) == 1:
                self.chars[p] = i
            elif self.merged(p) == [p]:  # other pieces never come about by merging
                whole[p] = i
                self.auto.add_word(p, (i, len(p)))
                self.shorter[i] = next((whole[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in whole), -1)
                if self.shorter[i] < 0:
                    self.shorter[i] = self.char(p[0])
        self.auto.make_automaton()
        inner = {c for p in v.ids if len(p) > 1 for c in p}
        bars = "".join(c for c in "\n\t\r" if c not in inner)
        self.cutter = re.compile(f"{SPACE}*[^{SPACE}{bars}]+|{SPACE}+" + (f"|[{bars}]+" if bars else ""))

    def char(self, c: str) -> int:
        """The token of a single character."""
        got = self.chars.get(c)
        if got is None:
            ids = [self.v.byte_ids[b] for b in c.encode()]
            got = self.chars[c] = len(self.piece)
            self.piece.append(c)
            self.length.append(1)
            self.shorter.append(-1)
            self.joined.append(",".join(map(str, ids)))
            self.shown.append(self.unescaped(ids))
        return got

    def merged(self, text: str) -> list[str]:
        """Merge from single characters: the best-scored pair first, the leftmost of equals."""
        parts, score = list(text), self.v.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether the texts of two tokens, merged afresh, give the two tokens."""
        if len(self.pairs) > MEMO:
            self.pairs.clear()
        a, b = self.piece[left], self.piece[right]
        got = self.pairs[left << 24 | right] = self.merged(a + b) == [a, b]
        return got

    def split(self, s: str) -> list[int]:
        """The merge-order tokens of s, by backtracking."""
        n, chars = len(s), self.chars
        best = [chars.get(c) for c in s]
        if None in best:
            best = [self.char(c) for c in s]
        for last, (token, size) in self.auto.iter(s):
            best[last - size + 1] = token  # longer ones come later
        length, shorter, pairs = self.length, self.shorter, self.pairs
        out: list[int] = []
        failed, pos = b"", 0  # a bitfield of positions, once there is one
        token, left = best[0], -1
        while True:
            end = pos + length[token]
            if failed and failed[end >> 3] >> (end & 7) & 1:
                fit = False
            elif left < 0:
                fit = True
            else:
                fit = pairs.get(left << 24 | token)
                if fit is None:
                    fit = self.fits(left, token)
            if fit:
                out.append(token)
                if end == n:
                    return out
                pos, left, token = end, token, best[end]
                continue
            token = shorter[token]
            while token < 0:
                if not out:
                    raise ValueError(f"no encoding of {s[:50]!r}")
                failed = failed or bytearray(n // 8 + 1)
                failed[pos >> 3] |= 1 << (pos & 7)
                last = out.pop()
                pos -= length[last]
                token = shorter[last]
            left = out[-1] if out else -1

    def chunks(self, text: str) -> list[str]:
        """Parts of the escaped text that no merge crosses."""
        return self.cutter.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        size = len(self.v.text)
        out: list[int] = []
        for c in self.chunks(text):
            for t in self.split(c):
                if t < size:
                    out.append(t)
                else:
                    out.extend(self.v.byte_ids[b] for b in self.piece[t].encode())
        return out

    def unescaped(self, ids: list[int]) -> str:
        """Decoded text, with the dummy prefix still there."""
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i in self.v.silent:
                continue
            out.append(self.v.text[i].replace(SPACE, " "))
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.unescaped(ids)
        return text[1:] if text.startswith(" ") else text

    def __missing__(self, chunk: str) -> tuple[str, str]:
        tokens = self.split(chunk)
        joined, shown = self.joined, self.shown
        got = (",".join([joined[t] for t in tokens]), "".join([shown[t] for t in tokens]))
        if len(chunk) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[chunk] = got
        return got

    def read(self, text: str) -> tuple[str, str]:
        """Ids joined by commas, and the decoded text."""
        got = [self[c] for c in self.chunks(text)]
        decoded = "".join([g[1] for g in got])
        return ",".join([g[0] for g in got]), decoded[1:] if decoded.startswith(" ") else decoded


def _utf8(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that belongs to no character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + size].decode())
                    i += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def texts(col: pa.Array) -> list[str]:
    """A string column as Python text; null is empty, stray bytes are U+FFFD."""
    try:
        return [t or "" for t in col.to_pylist()]
    except UnicodeDecodeError:
        return [(t or b"").decode("utf-8", "replace") for t in col.cast(pa.binary()).to_pylist()]


_encoders: dict[int, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder a worker and vocabulary, so that its memo lasts over tasks."""
    key = hash((vocabulary.text, vocabulary.byte_ids))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), real: bool = False) -> DataFrame:
    """Encode each text and decode it again.

    Returns the columns keep, n_tokens, ids_sha256 and decoded_sha256; with
    real=True also ids (array) and decoded. Map-only: no shuffle, and a
    worker's memory holds one slice of rows and two bounded memos.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(path))
    src = docs.select(*keep, F.col(text).alias("__text"))
    out = [src.schema[c] for c in keep]
    schema = T.StructType([*out, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if real:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in slices(batches, "__text"):
            values = texts(column(b, "__text"))
            rows = [enc.read(t) for t in values]
            sizes = [ids.count(",") + 1 if ids else 0 for ids, _ in rows]
            cols = [column(b, c) for c in keep]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            cols += [pa.array(sizes, pa.int64()), *(pa.array([hashlib.sha256(r[k].encode()).hexdigest() for r in rows], pa.string()) for k in (0, 1))]
            if real:
                flat = np.fromstring(",".join([ids for ids, _ in rows if ids]), np.int32, sep=",")
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                cols += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([d for _, d in rows], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, schema)
