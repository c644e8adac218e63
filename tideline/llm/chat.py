"""Chat conversations as token sequences with a loss mask.

A turn becomes `<|im_start|>role`, a line feed, the text, `<|im_end|>` and a
line feed. It is put together from tokens, never from one formatted string:

* role and text are encoded on their own with a byte-level BPE vocabulary of
  ranks, whose ids can't spell a control string as one token;
* the reserved ids, the first after the vocabulary, are spliced in between;
* the loss mask is a running sum of +1 where an assistant text starts and -1
  where it ends.

A control string inside a role or text is escaped by one backslash after its
first character, and one that already has backslashes there gets one more; so
the formatted text, decoded from all ids, holds control strings only as marks,
and taking one backslash away gives each text back. Backslashes and line feeds
of a role are escaped as well, since a line feed ends it.

Turns are encoded where they lie, before anything moves. Then the turns of a
conversation meet in order (one shuffle by conversation and a sort) and pass by
as a stream: a sequence is cut into pieces of at most `most` tokens, so that
neither a row nor a task's memory grows with a conversation. What is counted
and hashed over a whole conversation goes on from piece to piece.

Null texts and roles are empty. Null conversation ids are one conversation;
null turns come first; rows of one conversation with the same turn are ordered
by role and text, and repeated rows are repeated turns. An empty text is a turn
without loss. Bytes that are no UTF-8 count as U+FFFD. An empty table gives an
empty one. Columns other than the four named are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tideline.llm.pieces import texts
from tideline.llm.words import column, slices

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")
#: Tokens of a piece, at most.
PIECE = 1 << 16
#: Blank runs from this size on are encoded in parts, since the encoder's regular expressions can't take them whole.
BLANKS = re.compile(r"(\s{100000})")


def escape(text: str) -> str:
    return CONTROL.sub(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|\2|>", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


@dataclass(frozen=True)
class Vocabulary:
    """A file of ranks, each line a token in base64 and its id."""

    ranks: bytes

    @cached_property
    def entries(self) -> dict[bytes, int]:
        return {base64.b64decode(t): int(i) for t, i in map(bytes.split, self.ranks.splitlines())}

    @cached_property
    def encoding(self):
        import public_tokenizers
        import tiktoken

        return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.entries, special_tokens={})

    @cached_property
    def spelled(self) -> list[bytes]:
        out = [b""] * (self.end + 1)
        for t, i in self.entries.items():
            out[i] = t
        out[self.start], out[self.end] = START.encode(), END.encode()
        return out

    @cached_property
    def start(self) -> int:
        return max(self.entries.values()) + 1

    @property
    def end(self) -> int:
        return self.start + 1

    @cached_property
    def feed(self) -> int:
        return self.entries[b"\n"]

    def encode(self, text: str) -> list[int]:
        if len(text) < 100_000 or not BLANKS.search(text):
            return self.encoding.encode_ordinary(text)
        return [i for part in BLANKS.split(text) for i in self.encoding.encode_ordinary(part)]

    def decode(self, ids: list[int]) -> bytes:
        spelled = self.spelled
        return b"".join([spelled[i] for i in ids])


def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary(f.read())


_known: dict[int, Vocabulary] = {}


def _held(ranks: bytes) -> Vocabulary:
    """One a worker."""
    key = hash(ranks)
    if key not in _known:
        _known.clear()
        _known[key] = Vocabulary(ranks)
    return _known[key]


def encoded(turns: DataFrame, path: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each turn's escaped role and text as ids: (conv_id, turn, role_ids, text_ids, loss). Map-only."""
    shared = turns.sparkSession.sparkContext.broadcast(vocabulary(path).ranks)
    src = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    ids = T.ArrayType(T.IntegerType())
    schema = T.StructType([src.schema["conv_id"], src.schema["turn"], T.StructField("role_ids", ids), T.StructField("text_ids", ids), T.StructField("loss", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _held(shared.value)
        for b in slices(batches):
            roles = texts(column(b, "role"))
            known = {r: v.encode(escape_role(r)) for r in set(roles)}
            own = [v.encode(escape(t)) for t in texts(column(b, "text"))]
            cols = [column(b, "conv_id"), column(b, "turn"), pa.array([known[r] for r in roles], pa.list_(pa.int32())), pa.array(own, pa.list_(pa.int32())), pa.array([r == "assistant" for r in roles])]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(run, schema)


def spliced(v: Vocabulary, role_ids: list[int], text_ids: np.ndarray, loss: bool) -> tuple[np.ndarray, np.ndarray]:
    """A turn's ids and mask, which is the running sum of a step up and a step down."""
    head = np.array([v.start, *role_ids, v.feed], np.int32)
    ids = np.concatenate((head, text_ids, np.array([v.end, v.feed], np.int32)))
    steps = np.zeros(len(ids), np.int8)
    if loss and len(text_ids):
        steps[len(head)], steps[len(head) + len(text_ids)] = 1, -1
    return ids, np.cumsum(steps, dtype=np.int8)


class Conversation:
    """An open conversation, handed out in pieces of at most `most` tokens."""

    def __init__(self, key, most: int):
        self.key, self.most, self.piece, self.held = key, most, 0, 0
        self.ids: list[np.ndarray] = []
        self.mask: list[np.ndarray] = []

    def add(self, ids: np.ndarray, mask: np.ndarray) -> list[tuple]:
        self.ids.append(ids)
        self.mask.append(mask)
        self.held += len(ids)
        return self.pieces(False) if self.held > self.most else []

    def pieces(self, ended: bool) -> list[tuple]:
        """(key, piece, last, ids, mask) of full pieces, and of the rest where the conversation has ended."""
        ids, mask = np.concatenate(self.ids), np.concatenate(self.mask)
        out, at = [], 0
        while len(ids) - at > self.most or (ended and at < len(ids)):
            stop = min(at + self.most, len(ids))
            out.append((self.key, self.piece, ended and stop == len(ids), ids[at:stop], mask[at:stop]))
            self.piece, at = self.piece + 1, stop
        self.ids, self.mask, self.held = [ids[at:]], [mask[at:]], len(ids) - at
        return out


def assemble(turns: DataFrame, path: str, most: int = PIECE, **columns: str) -> DataFrame:
    """Conversations as (conv_id, piece, last, ids, mask): pieces of at most `most` tokens, in order within a partition.

    A conversation of no more than that is one row; last tells its final piece.
    """
    rows = encoded(turns, path, **columns)
    shared = turns.sparkSession.sparkContext.broadcast(vocabulary(path).ranks)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role_ids", "text_ids")
    schema = T.StructType([rows.schema["conv_id"], T.StructField("piece", T.LongType()), T.StructField("last", T.BooleanType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("mask", T.ArrayType(T.ByteType()))])
    key_type = to_arrow_type(rows.schema["conv_id"].dataType)

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(d[3]) for d in done]))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([d[k] for d in done]), kind)) for k, kind in ((3, pa.int32()), (4, pa.int8()))]
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], key_type), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done]), *lists], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _held(shared.value)
        open_one: Conversation | None = None
        done: list[tuple] = []
        size = 0
        for b in batches:
            keys, loss = column(b, "conv_id").to_pylist(), column(b, "loss").to_pylist()
            roles, bodies = column(b, "role_ids"), column(b, "text_ids")
            for i, key in enumerate(keys):
                if open_one and open_one.key != key:
                    done += open_one.pieces(True)
                    open_one = None
                open_one = open_one or Conversation(key, most)
                size += len(bodies[i])
                done += open_one.add(*spliced(v, roles[i].as_py(), bodies[i].values.to_numpy(), loss[i]))
                if size >= most and done:
                    yield batch_of(done)
                    done, size = [], 0
        if open_one:
            done += open_one.pieces(True)
        if done:
            yield batch_of(done)

    return rows.mapInArrow(run, schema)


class Reader:
    """Reads a conversation back from its pieces: turns, and what the mask covers.

    Only the part of a turn that isn't complete yet is held, at most one text.
    """

    def __init__(self, v: Vocabulary):
        self.v, self.n_turns, self.chars, self.loss_chars = v, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.ids: list[np.ndarray] = []
        self.mask: list[np.ndarray] = []

    def take(self, ids: np.ndarray, mask: np.ndarray) -> None:
        """One more piece; turns that it completes, up to the line feed after their mark, are read."""
        waits = bool(self.ids) and self.ids[-1][-1] == self.v.end
        self.ids.append(ids)
        self.mask.append(mask)
        if not waits and not (ids == self.v.end).any():
            return
        ids, mask, at = np.concatenate(self.ids), np.concatenate(self.mask), 0
        for stop in (np.flatnonzero(ids == self.v.end) + 2).tolist():
            if stop <= len(ids):
                self.turn(ids[at:stop], mask[at:stop])
                at = stop
        self.ids, self.mask = ([ids[at:]], [mask[at:]]) if at < len(ids) else ([], [])

    def turn(self, ids: np.ndarray, mask: np.ndarray) -> None:
        v = self.v
        self.n_turns += 1
        self.chars += len(v.decode(ids.tolist()).decode())
        role, text = v.decode(ids[1:-2].tolist()).decode().split("\n", 1)
        self.turns.update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
        if mask.any():
            said = unescape(v.decode(ids[mask.astype(bool)].tolist()).decode())
            self.loss_chars += len(said)
            self.loss.update(said.encode())

    def result(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(pieces: DataFrame, path: str) -> DataFrame:
    """What assemble() wrote, read from its ids and masks alone: one row a conversation. Takes the rows in assemble's order."""
    shared = pieces.sparkSession.sparkContext.broadcast(vocabulary(path).ranks)
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.StringType(), T.LongType()]
    schema = T.StructType([pieces.schema["conv_id"], *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _held(shared.value)
        reader = None
        for b in batches:
            convs, rows = [], []
            last = column(b, "last").to_pylist()
            ids, mask = column(b, "ids"), column(b, "mask")
            for i in range(b.num_rows):
                reader = reader or Reader(v)
                reader.take(ids[i].values.to_numpy(), mask[i].values.to_numpy())
                if last[i]:
                    convs.append(i)
                    rows.append(reader.result())
                    reader = None
            if rows:
                cols = [pa.array([r[k] for r in rows], pa.string() if isinstance(rows[0][k], str) else pa.int64()) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([column(b, "conv_id").take(pa.array(convs, pa.int64())), *cols], names=schema.names)

    return pieces.mapInArrow(run, schema)
