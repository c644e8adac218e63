"""Language-model scores by logistic context mixing over bits.

The text is a sequence of lower-cased words and one end. A word is coded byte
by byte, bit by bit, with a blank after it. ORDERS bit predictors each look up
a hashed context (the last 1, 2, 3, 4 or 6 bytes of the word, or all of it so
far, with the bits of the byte so far) in a table of counts. Every occurrence
of every training word is counted in every order; the tables of the orders in
WIDE grow with the number of distinct training words (`widths`), so that their
contexts don't crowd each other.
Their logits are combined with a weight set that is gated by the place in the
word and by how much the longest known context has seen; an adaptive map then
refines the mixed probability by the gate. Weights and map are learned from all
training words, each predicted from the counts of all with one occurrence left
out: groups of about GROUP distinct words, dealt by a hash, learn online, batch
after batch, with the root of a word's count as its weight, and the model has
the groups' means. Beside the bits stands a predictor of known words by their
counts, with a share that is refined on all training words, too. What depends
on a word only is the same wherever it stands, so it is computed once for each
distinct word of the corpus.

Words also depend on the words before them (`Sequence`). A word's class is
CLASS_BITS bits of its hash. In a text's order, bit predictors with hashed
contexts (the word before, the two words before, each with the class's bits so
far) and the class's own frequency are mixed by logistic weights, gated by how
much the contexts have seen, into P(class | words before). The word then has
P(class | words before) * P(word) / P(class): a distribution again, as P(class)
is the sum of P(word) over the class. Every token of the training texts is
counted in these tables; a second pass, with each token left out of its own
counts, counts how often which inputs (in CODES and PRIORS bins) meet which
bit, and the gated weights are fitted to these counts. They go on adapting
while a text is scored: after its first FIRST tokens, and after blocks of twice
the length from then on, a text's own corrections of the weights follow the
errors of the block just scored. Every text starts from the learned weights, so
a score doesn't depend on the other texts of a task, and documents are stepped
side by side. A word's score is thus a part that depends on the word only, and
a part that depends on its place.

Words (64-bit hashes) are joined with the documents' own word counts; the most
frequent ones, at most HOT of them, travel as a broadcast, which also takes the
skew out of that join.

Null and empty texts have only the end, and an empty table gives an empty one.
Equal ids are separate rows; repeated rows get equal scores. Without training
documents every bit has probability one half. A very long text is read whole,
in one task. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.words import _splitmix, buffers, column, cut, mix, slices
from tideline.session import discard, written

ORDERS = (1, 2, 3, 4, 6, 0)  # 0: the whole word so far
#: Slots of a table (a power of two) at least, and of the orders in WIDE at most: what the driver's memory holds.
SLOT_BITS, MOST_BITS = 19, 20
WIDE = (3, 4, 6, 0)
#: Entries of a table that are summed by one task.
BLOCK = 1 << 17
#: Parts in which the tasks' tables are summed first.
SUMS = 32
#: Bits of a word's class, and of a slot's number in the tables of words before.
CLASS_BITS, CONTEXT_BITS = 8, 20
#: Bins of a predictor's logit, and of the class's own frequency, in the counts from which weights are fitted.
CODES, PRIORS = 64, 32
GATES = 8 * 4
#: Distinct training words, about, of a group that learns on its own.
GROUP = 50_000
#: Bytes of words taken at once, so that a step's arrays stay in the processor's cache.
BATCH = 8_000
#: Bytes of a beginning, at most, that neighbouring words are computed once for.
SHARED = 32
#: Words that are sorted together for that.
SORTED = 30_000
#: Steps of one in a logit for which a frozen model keeps a bit's cost.
FINE = 64
HOT = 1 << 17
#: Tokens after which a text's weights adapt for the first time, and how fast they do.
FIRST, ADAPT = 64, 2.0
RATE, ROUNDS, FIT = 0.02, 3, 40
_SEED = _splitmix(71, 16)
_BUCKETS = 33


class Bytes:
    """The bytes of words, each with a blank after it, as one array with in-word places."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        size = end - start + 1
        base = np.cumsum(size) - size
        n = int(size.sum())
        self.base, self.size = base, size
        self.place = np.arange(n) - np.repeat(base, size)
        at = np.minimum(self.place + np.repeat(start, size), max(len(data) - 1, 0))
        self.byte = data[at].astype(np.uint64) if len(data) else np.zeros(n, np.uint64)
        self.byte[base + size - 1] = 0x20
        self.owner = np.repeat(np.arange(len(size)), size)

    def contexts(self, order: int) -> np.ndarray:
        """Hash of each byte's context of an order."""
        n = len(self.byte)
        if order == 0:
            power = np.full(int(self.place.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64)
            power[0] = 1
            total = np.cumsum((self.byte + np.uint64(1)) * np.multiply.accumulate(power)[self.place])
            before = np.concatenate((np.zeros(1, np.uint64), total[:-1]))
            h = before - np.repeat(before[self.base], self.size)
            return mix(h + np.uint64(0xABCDEF))
        h = np.full(n, order, np.uint64)
        for k in range(1, order + 1):
            h *= np.uint64(0x100000001B3)
            h += self.earlier(k)
        return mix(h)

    def earlier(self, k: int) -> np.ndarray:
        """The byte k places before each, plus 1, or 0 where the word starts later; kept for other orders."""
        have = self.__dict__.setdefault("_earlier", {})
        if k not in have:
            have[k] = np.zeros(len(self.byte), np.uint64)
            have[k][k:] = self.byte[:-k] + np.uint64(1)
            have[k][self.place < k] = 0
        return have[k]

    def bits(self, at: np.ndarray | slice = slice(None)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of the eight bits, of the bytes at places: the bits so far (with a leading 1), and the bit."""
        byte = self.byte[at]
        node = np.ones(len(byte), np.uint64)
        for b in range(7, -1, -1):
            bit = (byte >> np.uint64(b)) & np.uint64(1)
            yield node, bit
            node = node * np.uint64(2) + bit

    def beginnings(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the bytes that don't end a beginning of the word before, too, and for each byte the one of these that stands for it.

        All contexts lie in the word, so bytes that end the same beginning have the same counts. Sorted words share most;
        beyond SHARED bytes nothing is shared.
        """
        same, word = np.arange(len(self.byte)), np.arange(1, len(self.size))
        for k in range(SHARED):
            word = word[np.minimum(self.size[word], self.size[word - 1]) > k]
            word = word[self.byte[self.base[word] + k] == self.byte[self.base[word - 1] + k]]
            if not len(word):
                break
            lead = np.flatnonzero(np.concatenate(([True], np.diff(word) != 1)))  # runs of words with the same beginning
            same[self.base[word] + k] = np.repeat(self.base[word[lead] - 1] + k, np.diff(np.append(lead, len(word))))
        own = same == np.arange(len(same))
        return np.flatnonzero(own), (np.cumsum(own) - 1)[same]


class Slots:
    """Where contexts have their counts: a hash for four bits, whose counts lie together."""

    def __init__(self, contexts: list[np.ndarray], widths: list[int]):
        self.contexts, self.widths = contexts, widths
        self.base: list[np.ndarray] = [np.zeros(0, np.int64)] * len(contexts)
        self.depth = 0

    def step(self, node: np.ndarray) -> list[np.ndarray]:
        """The slots of each context for the next bit; node: the bits so far, with a leading 1."""
        if self.depth % 4 == 0:
            for i, c in enumerate(self.contexts):
                self.base[i] = (mix(c + node * _SEED[i]) >> np.uint64(64 - self.widths[i])).astype(np.int64) & ~15
        top = 1 << (self.depth % 4)
        sub = (node & np.uint64(top - 1)).astype(np.int64) | top
        self.depth += 1
        return [x | sub for x in self.base]

    def leaves(self, byte: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """For both runs of four bits (0, 1) of each byte, and each context: the place of that run among all runs of its hash."""
        for half, node, last in ((0, np.uint64(1), byte >> np.uint64(4)), (1, byte >> np.uint64(4) | np.uint64(16), byte & np.uint64(15))):
            last = last.astype(np.int64)
            for i, c in enumerate(self.contexts):
                yield half, i, (mix(c + node * _SEED[i]) >> np.uint64(64 - self.widths[i])).astype(np.int64) & ~15 | last


def _grown(leaves: np.ndarray) -> np.ndarray:
    """Counts by slot and bit from counts of runs of four bits: those of a node are the sum of what follows it."""
    tree = np.zeros((len(leaves) // 16, 32), leaves.dtype)
    tree[:, 16:] = leaves.reshape(-1, 16)
    for i in range(15, 1, -1):
        tree[:, i] = tree[:, 2 * i] + tree[:, 2 * i + 1]
    return tree.reshape(-1, 2)  # of slot s and bit b at 2 * s + b


def widths(distinct: int) -> list[int]:
    """Bits of a slot's number for each order, by the number of distinct training words."""
    wide = min(MOST_BITS, max(SLOT_BITS, int(distinct).bit_length() + 2))
    return [wide if order in WIDE else SLOT_BITS for order in ORDERS]


def _tally_leaves(words: Bytes, weight: np.ndarray, table: list[np.ndarray]) -> None:
    """Add words with their counts to table[order][leaf]."""
    for begin, stop in words.runs(2 * BATCH):
        part = words.part(begin, stop)
        w = weight[begin:stop][part.owner].astype(np.float64)
        own, same = part.beginnings()
        w = np.bincount(same, w, len(own))
        for _, i, at in Slots([part.contexts(o)[own] for o in ORDERS], [len(t).bit_length() - 1 for t in table]).leaves(part.byte[own]):
            np.add.at(table[i], at, w)


def tally(words: Bytes, weight: np.ndarray, table: np.ndarray | list[np.ndarray], sign: int = 1) -> None:
    """Add words with their counts to table[order][bit, slot] (sign 1), or take them out (-1)."""
    leaves = [np.zeros(t.shape[-1]) for t in table]
    _tally_leaves(words, weight, leaves)
    for t, x in zip(table, leaves, strict=True):
        t += (sign * _grown(x).T).astype(t.dtype)


def _packed(n0: np.ndarray, n1: np.ndarray, floor: float, levels: list[float], scale: int) -> np.ndarray:
    """A predictor's logit (in 1/scale) and how much it has seen (a level, the lowest three bits), as 16 bits."""
    logit = np.clip(np.log((n1 + np.float32(floor)) / (n0 + np.float32(floor))), -12, 12)
    return (np.rint(logit * scale).astype(np.int16) << 3) | np.searchsorted(levels, n0 + n1).astype(np.int16)


def _left(n0: np.ndarray, n1: np.ndarray, floor: float, levels: list[float], scale: int) -> np.ndarray:
    """The same for each bit, 0 or 1, with one occurrence of that bit left out."""
    return np.stack([_packed(np.maximum(n0 - 1, 0), n1, floor, levels, scale), _packed(n0, np.maximum(n1 - 1, 0), floor, levels, scale)])


class Sequence:
    """Probability of each word's class given the words before it in its text."""

    LEVELS = [0.5, 1.5, 3.5, 8.5]
    SCALE = 256
    #: Codes of each level: what has been seen seldom has few logits, which get a code each.
    SPREAD = [1, 2, 7, 21, 33]

    def __init__(self, share: np.ndarray, counts: np.ndarray):
        self.share, self.counts = share, counts  # P(class), and for each context slots x 2
        n = len(share)
        tree = np.zeros(2 * n)
        tree[n:] = share
        for i in range(n - 1, 0, -1):
            tree[i] = tree[2 * i] + tree[2 * i + 1]
        self.prior = np.log(np.maximum(tree[1::2], 1e-12) / np.maximum(tree[::2], 1e-12)).astype(np.float32)  # of a 1 after the bits so far
        self.table = [_packed(c[:, 0], c[:, 1], 0.1, self.LEVELS, self.SCALE) for c in counts]
        k = len(self.LEVELS) + 1
        self.weights = np.full((3, k * k), 0.3, np.float32)
        self.weights[0, 0] = 1.0  # where nothing is known, the class's own frequency

    def frozen(self) -> Sequence:
        """The model without the counts that only learning needs."""
        out = object.__new__(Sequence)
        out.__dict__ |= self.__dict__ | {"counts": None}
        return out

    @staticmethod
    def contexts(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Hashes of the word before, and of the two before; a text starts with blanks."""
        out, ctx = [], np.zeros(len(h), np.uint64)
        place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        for k in (1, 2):
            prev = np.zeros(len(h), np.uint64)
            prev[k:] = h[:-k]
            prev[place < k] = 0
            ctx = mix(ctx * np.uint64(0x100000001B3) + prev + np.uint64(k))
            out.append(ctx)
        return out

    @staticmethod
    def bits(h: np.ndarray, ctx: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For each bit of the class: the bits so far, the bit, and its slot in each table."""
        c = (h >> np.uint64(64 - CLASS_BITS)).astype(np.int64)
        node, at = np.ones(len(h), np.int64), Slots(ctx, [CONTEXT_BITS] * len(ctx))
        for b in range(CLASS_BITS):
            bit = (c >> (CLASS_BITS - 1 - b)) & 1
            yield node, bit, at.step(node.astype(np.uint64))
            node = 2 * node + bit

    @classmethod
    def leaves(cls, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Slots.leaves of the classes of words."""
        return Slots(cls.contexts(h, first), [CONTEXT_BITS] * 2).leaves(h >> np.uint64(64 - CLASS_BITS))

    @classmethod
    def tally_leaves(cls, h: np.ndarray, first: np.ndarray, table: np.ndarray) -> None:
        """Add the tokens of texts to table[context][leaf]."""
        for _, i, at in cls.leaves(h, first):
            np.add.at(table[i], at, table.dtype.type(1))

    @classmethod
    def tally(cls, h: np.ndarray, first: np.ndarray, table: np.ndarray) -> None:
        """Add the tokens of texts to table[context][slot, bit]."""
        leaves = np.zeros(table.shape[:2], np.int32)
        cls.tally_leaves(h, first, leaves)
        for t, x in zip(table, leaves, strict=True):
            t += _grown(x).astype(t.dtype)

    def inputs(self, node: np.ndarray, at: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """The predictors' logits and the gate."""
        x, gate = [self.prior[node]], np.zeros(len(node), np.int64)
        for i in range(2):
            v = self.table[i].take(at[i])
            gate = gate * (len(self.LEVELS) + 1) + (v & 7)
            x.append((v >> 3).astype(np.float32) * np.float32(1 / self.SCALE))
        return x, gate

    def left(self) -> Sequence:
        """What counting needs: codes of each slot's predictor, for each bit with one occurrence of it left out."""
        out = object.__new__(Sequence)
        codes = []
        for c in self.counts:
            v = _left(c[:, 0], c[:, 1], 0.1, self.LEVELS, self.SCALE)
            code = np.zeros(v.shape, np.uint8)
            for level, (bins, values) in enumerate(zip(self._bins(), self._values(), strict=True)):
                here = (v & 7) == level
                near = np.searchsorted((values[1:] + values[:-1]) / 2, (v[here] >> 3) / self.SCALE)
                code[here] = bins + near
            codes.append(self._by_leaf(code))
        out.codes = codes
        near = np.clip(np.rint(self.prior * 4 + PRIORS // 2), 0, PRIORS - 1).astype(np.int32)
        of = np.arange(1 << CLASS_BITS, dtype=np.int32)
        out.near = [near[(1 << d) | of >> (CLASS_BITS - d)] * (2 * CODES**2) + (of >> (CLASS_BITS - 1 - d) & 1) for d in range(CLASS_BITS)]
        return out

    @staticmethod
    def _by_leaf(code: np.ndarray) -> np.ndarray:
        """The four codes, from the lowest six bits on, that a run of four bits meets: of code[bit, slot]."""
        leaf = np.arange(code.shape[1], dtype=np.int32)
        out = np.zeros(len(leaf), np.uint32)
        for d in range(4):
            slot = leaf & ~15 | 1 << d | (leaf & 15) >> (4 - d)
            out |= code[leaf >> (3 - d) & 1, slot].astype(np.uint32) << np.uint32(6 * d)
        return out

    @classmethod
    def _bins(cls) -> list[int]:
        return np.concatenate(([0], np.cumsum(cls.SPREAD)[:-1])).tolist()

    @classmethod
    def _values(cls) -> list[np.ndarray]:
        """The logits that stand for the codes of each level: all that its counts can have, or even steps."""
        exact = [sorted({float(np.log((k + 0.1) / (m - k + 0.1))) for m in seen for k in range(m + 1)}) for seen in ([0], [1], [2, 3])]
        edges = [float(np.log(8.1 / 0.1)), 12.0]
        return [np.array(x) for x in exact] + [np.linspace(-e, e, n) for e, n in zip(edges, cls.SPREAD[3:], strict=True)]

    def seen(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How often each frequency bin, pair of codes and bit occur together in texts; of left()."""
        cells, ctx = [np.zeros(0, np.int32)], self.contexts(h, first)
        for a in range(0, len(h), BATCH):
            of = h[a : a + BATCH] >> np.uint64(64 - CLASS_BITS)
            codes = {(half, i): self.codes[i][at] for half, i, at in Slots([c[a : a + BATCH] for c in ctx], [CONTEXT_BITS] * 2).leaves(of)}
            of = of.astype(np.int64)
            for b in range(CLASS_BITS):
                one, two = (codes[b // 4, i] >> np.uint32(6 * (b % 4)) & np.uint32(CODES - 1) for i in range(2))
                cells.append(self.near[b][of] + ((one << np.uint32(6) | two) << np.uint32(1)).view(np.int32))
        return np.bincount(np.concatenate(cells), minlength=PRIORS * CODES * CODES * 2)

    def fit(self, seen: np.ndarray) -> None:
        """The gated weights from 0 to 1.5 of least cost over counted cells, by Newton steps of one weight after another."""
        k = len(self.LEVELS) + 1
        level = np.repeat(np.arange(k), self.SPREAD)
        value = np.concatenate(self._values())
        n0, n1 = seen.reshape(-1, 2).T
        cell = np.flatnonzero(n0 + n1)
        n0, n1 = n0[cell].astype(np.float64), n1[cell].astype(np.float64)
        one, two = cell // CODES % CODES, cell % CODES
        x = [(cell // CODES**2 - PRIORS // 2) / 4, value[one], value[two]]
        gate = level[one] * k + level[two]
        w = self.weights.astype(np.float64)
        start = w.copy()
        for _ in range(FIT):
            for i in range(3):
                z = np.clip(sum(w[j][gate] * x[j] for j in range(3)), -12, 12)
                p = 1 / (1 + np.exp(-z))
                # what a gate never saw stays as it was
                slope = np.bincount(gate, (n1 - (n0 + n1) * p) * x[i], k * k) - (w[i] - start[i])
                bend = np.bincount(gate, (n0 + n1) * p * (1 - p) * x[i] ** 2, k * k) + 1
                w[i] = np.clip(w[i] + np.clip(slope / bend, -0.2, 0.2), 0.0, 1.5)
        self.weights = w.astype(np.float32)

    @staticmethod
    def _steps(doc: np.ndarray, at: int) -> Iterator[tuple[int, int]]:
        """Runs of whole texts with about BATCH tokens, from at on; doc: the text of each token."""
        a = 0
        while a < len(doc):
            b = min(a + BATCH, len(doc))
            b = int(np.searchsorted(doc, doc[b - 1], side="right"))
            yield at + a, at + b
            a = b

    def rate(self, h: np.ndarray, first: np.ndarray, learn: bool = False) -> np.ndarray:
        """log10 of P(class | words before) / P(class) of each word of texts.

        learn: fit the gated weights to these texts before, each token left out of the counts.
        """
        if learn:
            self.fit(self.left().seen(h, first))
        size = np.diff(first)
        text = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(h)) - np.repeat(first[:-1], size)
        block = np.frexp(place // FIRST + 1)[1] - 1  # FIRST, 2 * FIRST, 4 * FIRST, ... tokens
        order = np.argsort(block, kind="stable")
        edge = np.searchsorted(block[order], np.arange(int(block.max(initial=-1)) + 2))
        ctx = self.contexts(h, first)
        own = np.zeros((3, len(size)), np.float32)  # each text's corrections of the weights
        total = np.zeros(len(h), np.float32)
        for a, b in ((a, b) for low, high in zip(edge[:-1], edge[1:], strict=True) for a, b in self._steps(text[order[low:high]], int(low))):
            at = order[a:b]
            doc = text[at]
            lead = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            mine = own[:, doc]
            pull = np.zeros((3, len(lead)), np.float32)
            rarity = np.ones(len(at))  # 1 / P(class), at most e ** 96
            for node, bit, slot in self.bits(h[at], [c[at] for c in ctx]):
                x, gate = self.inputs(node, slot)
                z = (self.weights[0][gate] + mine[0]) * x[0]
                for i in (1, 2):
                    z += (self.weights[i][gate] + mine[i]) * x[i]
                sign = (1 - 2 * bit).astype(np.float32)
                odds = np.exp(np.clip(z, -12, 12, out=z) * sign)
                all_odds = 1 + odds
                rarity *= all_odds
                miss = -sign * odds / all_odds
                for i in range(3):
                    pull[i] += np.add.reduceat(miss * x[i], lead)
            total[at] = -np.log(rarity)
            own[:, doc[lead]] = np.clip(own[:, doc[lead]] + ADAPT * pull / (CLASS_BITS * np.diff(np.append(lead, len(at)))), -0.5, 0.5)
        share = self.share[(h >> np.uint64(64 - CLASS_BITS)).astype(np.int64)]
        return total / np.log(10) - np.log10(np.maximum(share, 1e-12))


class Mixer:
    """Tables of counts, gated weights and the refining map."""

    def __init__(self, table: np.ndarray | list[np.ndarray]):
        self.table = table  # for each order 2 x slots, float32
        self.weights = np.full((GATES, len(ORDERS)), 0.3)
        centre = np.linspace(-12, 12, _BUCKETS)
        self.map = np.tile(1 / (1 + np.exp(-centre)), (GATES, 1))
        self.total = 1  # all occurrences
        self.widths = [t.shape[-1].bit_length() - 1 for t in table]
        self.packed: list[np.ndarray] | None = None
        self.less: list[np.ndarray] | None = None
        self.cost: np.ndarray | None = None

    LEVELS = [0.5, 4.5, 100.5]
    SCALE = 256

    def frozen(self, less: bool = False) -> Mixer:
        """The model with its counts as logits, which is all that scoring needs; less: those with a bit left out too."""
        out = self.learner() if less else object.__new__(Mixer)
        packed = [_packed(t[0], t[1], 0.02, self.LEVELS, self.SCALE) for t in self.table]
        z = np.arange(24 * FINE + 1) / FINE - 12
        z, gate = np.tile(z, GATES), np.repeat(np.arange(GATES), len(z))
        p = self.refined(z, 1 / (1 + np.exp(-z)), gate)
        cost = np.log10(np.concatenate((1 - p, p))).astype(np.float32)
        out.__dict__ |= self.__dict__ | {"table": None, "packed": packed, "less": out.__dict__.get("less"), "cost": cost}
        return out

    def learner(self) -> Mixer:
        """The model with the logits of its counts without one occurrence of a bit, which is all that learning needs."""
        out = object.__new__(Mixer)
        less = [_left(t[0], t[1], 0.02, self.LEVELS, self.SCALE) for t in self.table]
        out.__dict__ |= self.__dict__ | {"table": None, "less": less}
        return out

    def copied(self) -> Mixer:
        """The model with weights and map of its own."""
        out = object.__new__(Mixer)
        out.__dict__ |= self.__dict__ | {"weights": self.weights.copy(), "map": self.map.copy()}
        return out

    def at(self, words: Bytes, own: np.ndarray | slice = slice(None)) -> Slots:
        return Slots([words.contexts(o)[own] for o in ORDERS], self.widths)

    def inputs(self, slot: list[np.ndarray], bit: np.ndarray, place: np.ndarray, out: int) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the predictors and the gate; out: 1 leaves an occurrence of the bit itself out."""
        logits = np.empty((len(ORDERS), len(bit)), np.float32)
        half = {w: bit.astype(np.int64) << w for w in {*self.widths}} if out else {}
        for i, s in enumerate(slot):
            if out:
                v = self.less[i].reshape(-1).take(s | half[self.widths[i]])
            elif self.packed is not None:
                v = self.packed[i].take(s)
            else:
                v = _packed(self.table[i][0][s], self.table[i][1][s], 0.02, self.LEVELS, self.SCALE)
            np.multiply(v >> 3, np.float32(1 / self.SCALE), out=logits[i])
        return logits, np.minimum(place, 7) * 4 + (v & 7)

    def mixed(self, logits: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = self.logit(logits, gate, np.ascontiguousarray(self.weights.T, np.float32)).astype(np.float64)
        return z, 1 / (1 + np.exp(-z))

    @staticmethod
    def logit(logits: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
        z = weights[0][gate] * logits[0]
        for i in range(1, len(ORDERS)):
            z += weights[i][gate] * logits[i]
        return np.clip(z, -12, 12, out=z)

    def refined(self, z: np.ndarray, p: np.ndarray, gate: np.ndarray) -> np.ndarray:
        at = (z + 12) * ((_BUCKETS - 1) / 24)
        low = np.minimum(at.astype(np.int64), _BUCKETS - 2)
        part = at - low
        q = self.map[gate, low] * (1 - part) + self.map[gate, low + 1] * part
        return np.clip((p + 3 * q) / 4, 1e-6, 1 - 1e-6)

    def learn(self, words: Bytes, weight: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """Online: bits of one batch of words after another, each with a step of weights and map.

        Returns how much each gate and each cell of the map has seen.
        """
        if self.less is None:
            self.less = self.learner().less
        gates, cells = np.zeros(GATES), np.zeros((GATES, _BUCKETS))
        for _ in range(rounds):
            for begin, stop in words.runs():
                part = words.part(begin, stop)
                w = weight[begin:stop][part.owner]
                at = self.at(part)
                for node, bit in part.bits():
                    logits, gate = self.inputs(at.step(node), bit, part.place, 1)
                    z, p = self.mixed(logits, gate)
                    miss = (bit - p) * w
                    n = np.bincount(gate, w, GATES)
                    gates += n
                    for i in range(len(ORDERS)):
                        self.weights[:, i] += RATE * np.bincount(gate, miss * logits[i], GATES) / (n + 1e-9)
                    np.clip(self.weights, -0.5, 2.0, out=self.weights)
                    near = np.rint((z + 12) * ((_BUCKETS - 1) / 24)).astype(np.int64)
                    cell = gate * _BUCKETS + near
                    n = np.bincount(cell, w, GATES * _BUCKETS).reshape(GATES, -1)
                    cells += n
                    ones = np.bincount(cell, w * bit, GATES * _BUCKETS).reshape(GATES, -1)
                    pull = 1 - np.exp(-0.02 * n)
                    self.map += pull * (ones / np.maximum(n, 1e-9) - self.map) * (n > 0)
        return gates, cells

    def bits(self, words: Bytes, out: int) -> np.ndarray:
        """log10 probability of each word by its bits, of a frozen model; out: 1 leaves an occurrence of the word out."""
        weights = np.ascontiguousarray(self.weights.T, np.float32)
        total = [np.zeros(0)]
        for begin, stop in words.runs(2 * BATCH):  # about half of a sorted run is shared
            part = words.part(begin, stop)
            own, same = part.beginnings()
            at, place, sums = self.at(part, own), part.place[own], np.zeros(len(own), np.float32)
            for node, bit in part.bits(own):
                logits, gate = self.inputs(at.step(node), bit, place, out)
                z = self.logit(logits, gate, weights)
                near = np.rint((z + np.float32(12)) * np.float32(FINE)).astype(np.int64)
                sums += self.cost[(bit.astype(np.int64) * GATES + gate) * (24 * FINE + 1) + near]
            total.append(np.bincount(part.owner, sums[same], len(part.size)))
        return np.concatenate(total)


def _part(self: Bytes, begin: int, stop: int) -> Bytes:
    a, b = int(self.base[begin]), int(self.base[stop - 1] + self.size[stop - 1])
    out = object.__new__(Bytes)
    out.base, out.size = self.base[begin:stop] - a, self.size[begin:stop]
    out.place, out.byte, out.owner = self.place[a:b], self.byte[a:b], self.owner[a:b] - begin
    return out


def _runs(self: Bytes, most: int = BATCH) -> Iterator[tuple[int, int]]:
    """Runs of words with about most bytes, one word at least."""
    begin, ends = 0, self.base + self.size
    while begin < len(self.size):
        stop = max(begin + 1, int(np.searchsorted(ends, self.base[begin] + most, side="right")))
        yield begin, stop
        begin = stop


Bytes.part, Bytes.runs = _part, _runs


def of_strings(col: pa.Array) -> Bytes:
    data, offsets = buffers(col)
    return Bytes(data, offsets[:-1], offsets[1:])


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """A binary column of byte spans."""
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    at = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], size) + np.repeat(start, size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[at].tobytes())])


def word_counts(docs: DataFrame, text: str, train: Column) -> DataFrame:
    """word (binary), h, c (occurrences in training texts) of every distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text", 4_000_000):
            w = cut(*buffers(column(b, "__text")), lower=True)
            if not len(w.start):
                continue
            use = column(b, "__train").to_numpy(zero_copy_only=False)[w.text]
            h, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
            c = np.bincount(inverse, use, len(h)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([_gather(w.data, w.start[first], w.end[first]), pa.array(h.view(np.int64)), pa.array(c)], names=["word", "h", "c"])

    src = docs.select(F.col(text).alias("__text"), F.coalesce(train, F.lit(False)).alias("__train"))
    return src.mapInArrow(run, "word binary, h long, c long").groupBy("word", "h").agg(F.sum("c").alias("c"))


def _blocks(tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The tables in numbered blocks of one size, without empty ones: float64 if the table is, else float32."""
    block = 0
    for t in tables:
        for at in range(0, t.size, BLOCK):
            body = t.reshape(-1)[at : at + BLOCK]
            if body.any():
                body = body.astype(np.float64 if t.dtype == np.float64 else np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([body.tobytes()], pa.binary())], names=["block", "body"])
            block += 1


def _summed(blocks: DataFrame, out: list[np.ndarray]) -> list[np.ndarray]:
    """The sums of all tasks' blocks, put into out; blocks have out's kind of numbers."""
    kind = out[0].dtype

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.float64)
        for x in t["body"]:
            total += np.frombuffer(x.as_py(), kind)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "body": pa.array([total.astype(kind).tobytes()], pa.binary())})

    places = [t.reshape(-1)[at : at + BLOCK] for t in out for at in range(0, t.size, BLOCK)]
    # in two steps, so that no task reads a block of more than some dozens of tasks at once
    some = blocks.withColumn("part", F.spark_partition_id() % SUMS).groupBy("block", "part").applyInArrow(add, "block int, body binary")
    summed = written(some.groupBy("block").applyInArrow(add, "block int, body binary"), "tables")
    for r in summed.toLocalIterator():  # one part after another: the driver never holds the tables twice
        places[r.block][:] = np.frombuffer(r.body, kind)
    discard(summed)
    return out


def _pieces(batches: Iterator[pa.RecordBatch], ordered: bool = False) -> Iterator[tuple[Bytes, pa.RecordBatch]]:
    """Runs of rows with a bounded number of bytes of words; ordered: sorted by the word, SORTED rows or a batch at once."""
    for b in _sorted(batches) if ordered else batches:
        text = column(b, "word").cast(pa.string(), safe=False)
        b = b.set_column(b.schema.get_field_index("word"), "word", text)
        for part in slices(iter([b]), "word", 500_000):
            yield of_strings(column(part, "word")), part


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    some: list[pa.RecordBatch] = []
    for b in batches:
        some.append(b)
        if sum(x.num_rows for x in some) >= SORTED:
            yield from pa.Table.from_batches(some).sort_by("word").combine_chunks().to_batches()
            some = []
    if some:
        yield from pa.Table.from_batches(some).sort_by("word").combine_chunks().to_batches()


def _tables(words: DataFrame, bits: list[int]) -> list[np.ndarray]:
    """Counts of all training words in the predictors' tables, summed over a bounded number of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [np.zeros(1 << n) for n in bits]
        for words, part in _pieces(batches, True):
            _tally_leaves(words, column(part, "c").to_numpy(), table)
        yield from _blocks([t.astype(np.float32) for t in table])

    # each task sends its tables on, so they are an eighth as many as elsewhere
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = words.where("c > 0").select("word", "c").coalesce(min(2000, max(12, parts // 8)))
    leaves = _summed(few.mapInArrow(run, "block int, body binary"), [np.zeros(1 << n, np.float32) for n in bits])
    return [np.ascontiguousarray(_grown(x).T) for x in leaves]


def _sequence_tables(texts: DataFrame) -> np.ndarray:
    """Counts of all tokens of the texts in the tables of words before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, 1 << CONTEXT_BITS), np.int32)
        for b in slices(batches, "__text"):
            w = cut(*buffers(column(b, "__text")), lower=True)
            if len(w.start):
                Sequence.tally_leaves(w.hash, w.first, table)
        yield from _blocks([table])

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = texts.coalesce(min(2000, max(12, parts // 8)))
    leaves = _summed(few.mapInArrow(run, "block int, body binary"), [np.zeros((2, 1 << CONTEXT_BITS), np.float32)])[0]
    return np.stack([_grown(x) for x in leaves])


def _sequence(texts: DataFrame, rated: DataFrame, total: int) -> Sequence:
    """The model of the words before: counts, and the weights fitted to them, of all tokens of the training texts."""
    of = F.shiftrightunsigned("h", 64 - CLASS_BITS)
    share = np.zeros(1 << CLASS_BITS)
    for r in rated.groupBy(of.alias("k")).agg(F.sum(F.pow(F.lit(10.0), F.col("lp"))).alias("p")).collect():
        share[r.k] = r.p
    share += max(1e-9, 1 - share.sum()) / len(share)  # words not in the corpus: evenly
    model = Sequence(share / share.sum(), _sequence_tables(texts))
    model.fit(_seen(texts, model))
    return model.frozen()


def _seen(texts: DataFrame, model: Sequence) -> np.ndarray:
    """Sequence.seen of all texts."""
    shared = texts.sparkSession.sparkContext.broadcast(model.left())
    cells = PRIORS * CODES * CODES * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, total = shared.value, np.zeros(cells)
        for b in slices(batches, "__text"):
            w = cut(*buffers(column(b, "__text")), lower=True)
            if len(w.start):
                total += left.seen(w.hash, w.first)
        yield from _blocks([total])

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = texts.coalesce(min(2000, max(12, parts // 8)))
    out = _summed(few.mapInArrow(run, "block int, body binary"), [np.zeros(cells)])[0].astype(np.int64)
    shared.destroy()
    return out


def train(words: DataFrame) -> Mixer:
    """The model of a table of word counts.

    Groups of about GROUP distinct words, dealt and ordered by hashes, learn weights and map each on its own, from the
    counts of all words; the model has their means, weighted by what each has seen.
    """
    known = words.where("c > 0")
    total, n = known.agg(F.sum("c"), F.count(F.lit(1))).first()
    mixer = Mixer(_tables(words, widths(n)))
    if not n:
        return mixer
    mixer.total = total
    shared = words.sparkSession.sparkContext.broadcast(mixer.learner())

    def learn(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), ("word", "ascending")]).select(["word", "c"]).combine_chunks()
        model = shared.value.copied()
        gates, cells = np.zeros((GATES, 1)), np.zeros((GATES, _BUCKETS))
        for _ in range(min(ROUNDS, -(-GROUP // (2 * t.num_rows)))):  # the few groups of a small table learn more than once
            for x, part in _pieces(iter(t.to_batches())):
                g, c = model.learn(x, np.sqrt(column(part, "c").to_numpy()), 1)
                gates, cells = gates + g[:, None], cells + c
        v = np.concatenate([a.ravel() for a in (gates, cells, gates * model.weights, cells * model.map)])
        return pa.table({"k": pa.array(np.arange(len(v), dtype=np.int32)), "v": pa.array(v)})

    group = F.pmod(F.xxhash64("h", F.lit(3)), F.lit(n // GROUP + 1))
    sums = known.select(group.alias("group"), "word", "h", "c").groupBy("group").applyInArrow(learn, "k int, v double")
    got = sums.groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")["v"].to_numpy()
    shared.destroy()
    at = np.cumsum([GATES, GATES * _BUCKETS, GATES * len(ORDERS)])
    gates, cells, weights, chances = (a.reshape(GATES, -1) for a in np.split(got, at))
    mixer.weights = np.where(gates > 0, weights / np.maximum(gates, 1e-9), mixer.weights)
    mixer.map = np.where(cells > 0, chances / np.maximum(cells, 1e-9), mixer.map)
    return mixer


def _share(rated: DataFrame, total: int) -> float:
    """The share of the word predictor (its count left out) beside the bits', refined by repeated posterior means of all words."""
    ratio = F.log10((F.col("c") - 1) / F.lit(float(max(total - 1, 1)))) - F.col("less")
    bins = F.floor(F.least(F.greatest(ratio, F.lit(-300.0)), F.lit(300.0)) * 32).cast("int")
    rows = rated.where("c > 1").groupBy(bins.alias("k")).agg(F.sum("c").alias("n")).orderBy("k").collect()
    odds, n = 10.0 ** ((np.array([r.k for r in rows]) + 0.5) / 32), np.array([r.n for r in rows], np.float64)
    share = 0.5
    for _ in range(40):
        share = float((n * share * odds / (share * odds + 1 - share)).sum() / total)
    return min(max(share, 0.0), 0.999)


def _often(counted: DataFrame, total: int) -> int:
    """The least number of occurrences that at most HOT words have (total // HOT + 1 is one such)."""
    last = total // HOT + 1
    tries = [*range(1, 33)]
    while tries[-1] < last:
        tries.append(tries[-1] * 5 // 4)
    have = counted.agg(*[F.coalesce(F.sum((F.col("c") >= t).cast("long")), F.lit(0)) for t in tries]).first()
    return next((t for t, n in zip(tries, have, strict=True) if n <= HOT), last)


def score(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: key, keep, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    counted = written(word_counts(docs, text, training), "words")
    n_docs = docs.where(F.coalesce(training, F.lit(False))).count()
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n, v = total + n_docs, distinct + (1 if n_docs else 0)
    model = spark.sparkContext.broadcast(train(counted).frozen(less=True))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for words, part in _pieces(batches, True):
            c = column(part, "c").to_numpy()
            less, again = np.zeros(len(c), np.float32), np.flatnonzero(c > 1)
            less[again] = m.bits(of_strings(column(part, "word").take(pa.array(again))), 1)
            yield pa.RecordBatch.from_arrays([column(part, "h"), column(part, "c"), pa.array(m.bits(words, 0)), pa.array(less)], names=["h", "c", "bits", "less"])

    by_bits = written(counted.mapInArrow(rate, "h long, c long, bits double, less float"), "rated")
    known = _share(by_bits, total) if total else 0.0
    chance = F.lit(known / max(total, 1)) * F.col("c") + F.lit(1 - known) * F.pow(F.lit(10.0), F.greatest("bits", F.lit(-290.0)))
    rated = by_bits.select("h", "c", F.log10(F.greatest(chance, F.lit(1e-290))).alias("lp"))
    texts = docs.where(F.coalesce(training, F.lit(False))).select(F.coalesce(F.col(text), F.lit("")).alias("__text"))
    sequence = spark.sparkContext.broadcast(_sequence(texts, rated, total) if total else None)
    often = _often(counted, total)
    hot = rated.where(F.col("c") >= often).toPandas().sort_values("h")  # HOT rows at most
    shared = spark.sparkContext.broadcast((hot["h"].to_numpy(np.int64), hot["c"].to_numpy(np.int64), hot["lp"].to_numpy(np.float64)))
    names = [f"__{i}" for i in range(1 + len(keep))]
    sums = ["tokens", "size", "known", "base", "lp"]
    own_cols = [F.col(c).alias(a) for c, a in zip((key, *keep), names, strict=True)]
    # rows that are equal in all that counts are summed as one, so a row needs no number of its own
    row = [F.xxhash64(F.lit(i), *[F.col(c) for c in (key, *keep, text)]).alias(f"__row{i}") for i in (1, 2)]
    src = docs.select(*row, *own_cols, F.col(text).alias("__text"))
    schema = T.StructType([src.schema["__row1"], src.schema["__row2"], *(T.StructField(c, src.schema[c].dataType) for c in names)])
    schema = schema.add("h", "long").add("head", "boolean").add("tokens", "long").add("size", "long").add("known", "long").add("base", "double").add("lp", "double")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_h, hot_c, hot_lp = shared.value
        hot_log = np.log10(hot_c + 1.0)
        before = sequence.value
        for b in slices(batches, "__text"):
            w = cut(*buffers(column(b, "__text")), lower=True)
            h = w.hash.view(np.int64)
            one, two = column(b, "__row1").to_numpy(), column(b, "__row2").to_numpy()
            rows = b.num_rows
            at = np.minimum(np.searchsorted(hot_h, h), max(len(hot_h) - 1, 0))
            is_hot = hot_h[at] == h if len(hot_h) else np.zeros(len(h), bool)
            doc = w.text
            hd, ha = doc[is_hot], at[is_hot]
            base = np.bincount(hd, hot_log[ha], rows) if len(hot_h) else np.zeros(rows)
            lp = np.bincount(hd, hot_lp[ha], rows) if len(hot_h) else np.zeros(rows)
            if before is not None and len(doc):
                lp = lp + np.bincount(doc, before.rate(w.hash, w.first), rows)
            size = np.bincount(doc, w.end - w.start + 1, rows).astype(np.int64)
            # a document's own row, under a key that no word has, and one for each of its other words
            rest = np.flatnonzero(~is_hot)
            rest = rest[np.lexsort((h[rest], doc[rest]))]
            new = np.flatnonzero(np.concatenate(([True], (np.diff(doc[rest]) != 0) | (np.diff(h[rest]) != 0)))) if len(rest) else rest
            times, rest = np.diff(np.append(new, len(rest))), rest[new]
            k, whose = len(rest), doc[rest]
            zero, none = np.zeros(k), np.zeros(k, np.int64)
            cols = [np.concatenate((one, one[whose])), np.concatenate((two, two[whose]))]
            cols += [pa.concat_arrays([column(b, c), pa.nulls(k, column(b, c).type)]) for c in names]
            cols += [
                np.concatenate((mix(one.view(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)).view(np.int64), h[rest])),
                np.concatenate((np.ones(rows, bool), np.zeros(k, bool))),
                np.concatenate((w.n, times)),
                np.concatenate((size, none)),
                np.concatenate((np.bincount(hd, minlength=rows), none)),
                np.concatenate((base, zero)),
                np.concatenate((lp, zero)),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=schema.names)

    parts = src.mapInArrow(own, schema)
    rare = rated.where(F.col("c") < often).withColumnRenamed("lp", "word_lp")
    tf = F.when(F.col("head"), F.lit(0)).otherwise(F.col("tokens"))
    summed = (
        parts.join(rare.hint("merge"), "h", "left")
        .groupBy("__row1", "__row2")
        .agg(
            F.sum(F.col("head").cast("long")).alias("rows"),
            *[F.max(c).alias(c) for c in names],
            F.sum(F.when(F.col("head"), F.col("tokens")).otherwise(0)).alias("tokens"),
            F.sum("size").alias("size"),
            F.sum(F.col("known") + F.when(F.col("c") > 0, tf).otherwise(0)).alias("known"),
            F.sum(F.col("base") + F.coalesce(tf * F.log10(F.col("c") + 1.0), F.lit(0.0))).alias("base"),
            F.sum(F.col("lp") + F.coalesce(tf * F.col("word_lp"), F.lit(0.0))).alias("lp"),
        )
    )
    one = [F.expr(f"{c} div rows").alias(c) for c in sums[:3]] + [(F.col(c) / F.col("rows")).alias(c) for c in sums[3:]]
    each = summed.select(*names, *one, F.explode(F.expr("sequence(1L, rows)")).alias("__nth"))
    ends = (n_docs + 1.0) / (n + 2.0)  # of a token being the end
    tokens = F.col("tokens") + 1
    lp = F.col("lp") + F.col("tokens") * float(np.log10(1 - ends)) + float(np.log10(ends))
    return each.select(
        *[F.col(a).alias(c) for c, a in zip((key, *keep), names, strict=True)],
        tokens.alias("n_tokens"),
        (F.col("known") + (1 if n_docs else 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + float(np.log10(n_docs + 1.0)) - tokens * float(np.log10(n + v + 1.0))).alias("base_score"),
        lp.alias("score"),
        (-lp * float(np.log2(10)) / (F.col("size") + 1)).alias("bits_per_byte"),
    )
