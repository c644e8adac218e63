"""Toxicity by a weighted finite-state grammar over clauses.

Words of a clause become symbols (insult, threat, target, negation, report,
other, break). Four small transducers read that string one after the other
and are composed into one machine beforehand:

* threat: a target up to three words after a threat is what it aims at, and
  the two are an aimed threat;
* insult: an insult or threat up to four words after a target is directed;
* negation: one up to three words after a negation is negated;
* reported speech: one after a reporting verb, in the same clause, is reported.

What the machine puts out for a whole clause, however long, is counted by kind
(insult, threat or aimed threat, with each combination of marks). A document's
score is a logistic function of log(1 + count) of each kind, with weights
fitted on labelled texts around a stated prior, so that a kind the labels don't
show keeps its prior weight. In the prior a threat that aims at nothing is
almost nothing ("kill the lights"). An insult without any target or mark is a
clause of its own kind and has a weight too, since labels mark such clauses:
in that, single words do count.

The lexicon is a fixed list, extended by words and word stems that occur in
labelled toxic texts far more often than chance allows (a likelihood ratio
above a threshold that grows with the number of candidates). Learning takes
at most about SAMPLE_TOXIC and SAMPLE_CLEAN labelled texts, whole, chosen and
ordered by a hash of their ids, so that it doesn't depend on the rows' order.

An Aho-Corasick automaton over the insult and threat words finds the clauses
to read; a clause is read from its first word to its last. Null, empty and
clause-free texts get the score of no evidence; an empty table gives an empty
one, and without labels the prior decides. Very long texts are read whole.
Rows are independent of each other; repeated rows repeat, and equal texts get
equal scores. Other columns are carried on; a column named as the score is replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.pieces import texts
from tideline.llm.words import column, slices

SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 4000
THRESHOLD = 0.7

#: Starting lexicon of each class.
INSULT = """idiot idiots moron morons imbecile loser losers scum trash garbage worthless pathetic stupid dumb disgusting
vermin coward clown fool filthy dummkopf trottel abschaum widerlich wertlos crétin connard débile minable
estúpido estúpida imbécil basura idiota asqueroso""".split()
THREAT = """kill destroy hurt murder shoot stab strangle umbringen töten vernichten tuer frapper massacrer matar golpear
destruir""".split()
TARGET = """you your you're u he she they him her them these those all every du ihr dich dein sie er tu vous ton ta il
elle ils tú usted vosotros él ella ellos""".split()
NEGATION = """not no never isn't aren't don't wasn't neither nor without nicht kein keine nie niemals pas jamais aucun sans
nunca jamás ni sin""".split()
REPORT = """said says say claimed called wrote reported quoted according alleged sagte schrieb behauptet laut dit écrit
selon dijo escribió según""".split()

CLASSES = ("other", "insult", "threat", "target", "negation", "report", "break")
OTHER, INS, THR, TGT, NEG, REP, BRK = range(7)
#: Marks that transducers add to an insult or threat, and to the target of a threat.
DIRECTED, NEGATED, REPORTED, AIMED = 8, 16, 32, 64
KINDS = [c | m for c in (INS, THR) for m in range(0, 64, 8)] + [TGT | AIMED | m for m in (0, NEGATED, REPORTED, NEGATED | REPORTED)]

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_BREAKS = ".!?;\n"
_CLAUSE = re.compile(f"[{_BREAKS}]")


@dataclass
class Transducer:
    """Deterministic letter transducer: arcs[state][symbol] = (next state, output)."""

    arcs: list[dict[int, tuple[int, int]]] = field(default_factory=list)

    def run(self, symbols: list[int]) -> list[int]:
        state, out = 0, []
        for s in symbols:
            state, o = self.arcs[state][s]
            out.append(o)
        return out


def marker(trigger: int, mark: int, reach: int | None, alphabet: list[int]) -> Transducer:
    """Adds mark to insults, threats and their targets within reach symbols after trigger (None: until the clause ends)."""
    n = 1 if reach is None else reach
    arcs: list[dict[int, tuple[int, int]]] = []
    for left in range(n + 1):  # left: how many symbols the mark still reaches
        row = {}
        for s in alphabet:
            kind = s & 7
            marked = kind in (INS, THR) or s & AIMED and mark != DIRECTED
            out = s | mark if left and marked else s
            if kind == BRK:
                to = 0
            elif kind == trigger:
                to = n
            else:
                to = left if reach is None else max(0, left - 1)
            row[s] = (to, out)
        arcs.append(row)
    return Transducer(arcs)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that gives b's output for a's output."""
    number, todo, arcs = {(0, 0): 0}, [(0, 0)], []
    while todo:
        p, q = todo.pop(0)
        row = {}
        for s, (p2, mid) in a.arcs[p].items():
            q2, out = b.arcs[q][mid]
            if (p2, q2) not in number:
                number[p2, q2] = len(number)
                todo.append((p2, q2))
            row[s] = (number[p2, q2], out)
        arcs.append(row)
    return Transducer(arcs)


def aim(reach: int, alphabet: list[int]) -> Transducer:
    """Marks a target up to reach symbols after a threat as aimed at."""
    arcs = []
    for left in range(reach + 1):
        row = {}
        for s in alphabet:
            if s == THR:
                row[s] = (reach, s)
            elif s == TGT and left:
                row[s] = (0, s | AIMED)
            else:
                row[s] = (0 if s == BRK else max(0, left - 1), s)
        arcs.append(row)
    return Transducer(arcs)


def grammar() -> Transducer:
    base = list(range(7))
    marked = lambda *m: base + sorted({c | x for c in (INS, THR) for x in m} | {TGT | AIMED | x & ~DIRECTED for x in (0, *m)})
    threat = aim(3, base)
    insult = marker(TGT, DIRECTED, 4, marked())
    negation = marker(NEG, NEGATED, 3, marked(DIRECTED))
    report = marker(REP, REPORTED, None, marked(DIRECTED, NEGATED, DIRECTED | NEGATED))
    return compose(compose(compose(threat, insult), negation), report)


#: Prior weights: of no evidence, and of each kind.
BIAS = -3.0


def prior() -> np.ndarray:
    def weight(kind: int) -> float:
        base = {INS: 4.5, THR: 0.5, TGT: 5.5}[kind & 7]
        return max(0.0, base + (1.0 if kind & DIRECTED else 0.0) - (2.5 if kind & NEGATED else 0.0) - (2.0 if kind & REPORTED else 0.0))

    return np.array([BIAS, *map(weight, KINDS)])


@dataclass
class Lexicon:
    words: dict[str, int]
    stems: tuple[str, ...] = ()


class Reader:
    """Counts the kinds of clause elements of a text."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.words, self.machine = lexicon.words, grammar()
        self.stems = frozenset(lexicon.stems)
        self.sizes = sorted({len(s) for s in self.stems})
        self.auto = ahocorasick.Automaton()
        for w in [*(w for w, c in self.words.items() if c in (INS, THR)), *self.stems]:
            self.auto.add_word(w, len(w))
        self.auto.make_automaton()
        self.at = {k: i for i, k in enumerate(KINDS)}

    def symbol(self, word: str) -> int:
        got = self.words.get(word)
        if got is None:
            got = INS if any(word[:n] in self.stems for n in self.sizes) else OTHER
        return got

    def counts(self, text: str) -> list[int]:
        out = [0] * len(KINDS)
        low = text.lower()
        done = 0
        for last, size in self.auto.iter(low):
            begin = last + 1 - size
            if begin < done or begin and (low[begin - 1].isalpha() or low[begin - 1] == "_"):
                continue
            start = max(done, *(low.rfind(c, done, begin) + 1 for c in _BREAKS))
            stop = _CLAUSE.search(low, last + 1)
            done = stop.start() if stop else len(low)
            for o in self.machine.run([self.symbol(w) for w in _WORD.findall(low, start, done)]):
                if o in self.at:
                    out[self.at[o]] += 1
        return out


def families(texts_: Iterator[str]) -> list[int]:
    """A number for each text; texts that are copies of each other, exact or near, share theirs.

    Min-hashes over the longer words, in eight bands of three.
    """
    mult = np.array([(2 * k + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1) for k in range(1, 25)], np.uint64)
    up: list[int] = []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    seen: dict[tuple, int] = {}
    for i, text in enumerate(texts_):
        up.append(i)
        bag = set(_WORD.findall(text.lower()))
        rare = [w for w in bag if len(w) >= 8] or sorted(bag)
        if not rare:
            continue
        h = np.array([zlib.crc32(w.encode()) for w in rare], np.uint64)
        low = ((h[:, None] + np.uint64(1)) * mult[None, :] >> np.uint64(16)).min(0)
        for band in range(8):
            key = hash((band, *low[3 * band : 3 * band + 3].tolist()))
            up[root(i)] = root(seen.setdefault(key, i))
    return [root(i) for i in range(len(up))]


def learned(rows: list[tuple[str, int]]) -> tuple[str, ...]:
    """Words (ending in a blank) and stems that toxic texts have far more often than chance allows.

    Copies of one text count once: words that only copies share prove nothing.
    """
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (f, (_, label)) in enumerate(zip(families(t for t, _ in rows), rows, strict=True)):
        groups.setdefault((f, label), []).append(i)
    size = [sum(1 for g in groups if g[1] == c) for c in (0, 1)]
    if not size[0] or not size[1]:
        return ()

    def counted(label: int, only: set[str] | None) -> Counter:
        out: Counter = Counter()
        for (_, c), members in groups.items():
            if c == label:
                found = _features({w for i in members for w in _WORD.findall(rows[i][0].lower())})
                out.update(found if only is None else found & only)
        return out

    toxic = counted(1, None)
    least = math.log(len(toxic) + 1) + 8
    toxic = {f: a for f, a in toxic.items() if a >= 4}
    clean = counted(0, set(toxic))
    share = size[1] / sum(size)
    good: dict[str, int] = {}
    for f, a in toxic.items():
        b = clean.get(f, 0)
        if (a / size[1]) < 19 * (b / size[0]):
            continue
        ratio = a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0.0)
        if ratio >= least:
            good[f] = a
    good = _spread(good, [[rows[i][0] for i in m] for (_, c), m in groups.items() if c == 1])
    out: set[str] = set()
    for f in sorted(good, key=lambda x: (len(x), x)):
        if not f.endswith(" "):
            longer = [g for g in good if len(g) == len(f) + 1 and g.startswith(f) and not g.endswith(" ")]
            if any(good[g] >= 0.95 * good[f] for g in longer):
                continue  # the longer stem says as much
        if not any(f.startswith(x) for x in out):
            out.add(f)
    return tuple(sorted(out))


def _features(words: set[str]) -> set[str]:
    """Whole words (ending in a blank) and stems."""
    out = {w + " " for w in words if len(w) > 2}
    for n in range(4, 8):
        out |= {w[:n] for w in words if len(w) >= n}
    return out


def _spread(good: dict[str, int], groups: list[list[str]]) -> dict[str, int]:
    """Those of good whose texts have little else in common: what distant copies share goes."""
    where: dict[str, list[set[str]]] = {f: [] for f in good}
    for texts_ in groups:
        words = {w for t in texts_ for w in _WORD.findall(t.lower())}
        rare = {w for w in words if len(w) >= 8}
        for f in _features(words) & good.keys():
            where[f].append(rare)
    out = {}
    for f, sets in where.items():
        near = [len(a & b) / max(1, min(len(a), len(b))) for a, b in zip(sets, sets[1:], strict=False)]
        if not near or sum(near) / len(near) < 0.25:
            out[f] = good[f]
    return out


def lexicon(found: tuple[str, ...]) -> Lexicon:
    words = {w: c for c, ws in ((TGT, TARGET), (NEG, NEGATION), (REP, REPORT), (THR, THREAT), (INS, INSULT)) for w in ws}
    words |= {f.rstrip(): INS for f in found if f.endswith(" ")}
    return Lexicon(words, tuple(f for f in found if not f.endswith(" ")))


def fit(x: np.ndarray, y: np.ndarray, pull: float = 0.02) -> np.ndarray:
    """Logistic weights by Newton steps, drawn to the prior; the weights of clause kinds stay at zero or above."""
    start = prior()
    w = start.copy()
    if not len(y):
        return w
    x = np.column_stack([np.ones(len(x)), np.log1p(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * (w - start) * len(y) / 100
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * (pull * len(y) / 100 + 1e-6)
        step = np.linalg.solve(curve, grad)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        w[1:] = np.maximum(w[1:], 0.0)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", text: str = "text") -> Model:
    """Learn from a bounded sample of the labelled documents."""
    told = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(label).cast("int").alias("__label"))
    size = {r[0]: r[1] for r in told.groupBy("__label").count().collect()}
    h = F.pmod(F.xxhash64(F.col("__key").cast("string")), F.lit(1 << 32))
    cut = {c: min(1 << 32, (most << 32) // max(1, size.get(c, 0))) for c, most in ((0, SAMPLE_CLEAN), (1, SAMPLE_TOXIC))}
    picked = told.where(h < F.when(F.col("__label") == 1, F.lit(cut[1])).otherwise(F.lit(cut[0])))
    # picked has about SAMPLE_TOXIC + SAMPLE_CLEAN rows of two numbers whatever the input
    own = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    got = own.join(F.broadcast(picked), F.col("__id") == F.col("__key")).select(F.xxhash64(F.col("__id").cast("string")), "__text", "__label").collect()
    rows = [(r[1], r[2]) for r in sorted(map(tuple, got))]
    lex = lexicon(learned(rows))
    reader = Reader(lex)
    x = np.array([reader.counts(t) for t, _ in rows], float).reshape(-1, len(KINDS))
    y = np.array([c for _, c in rows], float)
    return Model(lex, fit(x, y))


_readers: dict[tuple, Reader] = {}


def reader_of(lex: Lexicon) -> Reader:
    key = (lex.stems, tuple(sorted(lex.words.items())))
    if key not in _readers:
        _readers.clear()
        _readers[key] = Reader(lex)
    return _readers[key]


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score between 0 and 1 added, in place of a column of that name; map-only."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = reader_of(m.lexicon)
        for b in slices(batches, text):
            x = np.array([reader.counts(t) for t in texts(column(b, text))], float).reshape(-1, len(KINDS))
            z = np.column_stack([np.ones(len(x)), np.log1p(x)]) @ m.weights
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, out])

    return docs.mapInArrow(run, schema)
