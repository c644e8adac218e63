"""Quality rules whose cutoffs are selected with risk control.

Each rule compares one measure of a text with a cutoff. Cutoffs are chosen on
labelled holdouts, apart for each stratum: a cutoff may be used only if the
exact (Clopper-Pearson) upper confidence bound of its false-rejection rate,
that is the share of good documents which it rejects, is at most its rule's
part of `risk`. The error level `delta` is split over strata and rules
(Bonferroni); a rule's cutoffs, a grid fixed in advance, are tested in their
order from the one that rejects least on, each at the rule's whole level, and
testing stops at the first that fails (fixed-sequence testing). The rules of a
stratum share its risk, so that with probability 1 - delta the rules together
reject at most `risk` of the good documents of every stratum. Among cutoffs
that pass, each rule takes the one that rejects most bad documents beside good
ones, the first of equals; a rule that has none that passes, or that rejects
no more bad than good documents, is off in that stratum.

Strata without a labelled document use no learned rule, nor does any stratum
without labels at all. Null texts have no words and fail the base rule (fewer
than ten words). Very long texts are measured whole. Each input row gives one
row, and an empty table none; repeated rows and ties give equal results. Other
columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.words import SPACED, buffers, column, cut, mix, per_text, slices, span_hash
from tideline.session import written

#: Largest share of good documents that the learned rules of a stratum may reject together, and the error level.
RISK, DELTA = 0.05, 0.05
#: Cutoffs tried for each rule, the one that rejects most first.
GRID: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbol_share": (">", (0.01, 0.02, 0.05, 0.1, 0.2, 0.5)),
    "dup_line_share": (">", (0.05, 0.1, 0.2, 0.3, 0.5, 0.7)),
    "repeat_share": (">", (0.02, 0.05, 0.1, 0.15)),
    "upper_share": (">", (0.1, 0.2, 0.3, 0.5, 0.7)),
    "punct_share": (">", (0.05, 0.1, 0.15, 0.2, 0.3)),
    "mean_word": (">", (8.0, 10.0, 12.0, 15.0)),
    "short_word": ("<", (3.5, 3.0, 2.5, 2.0)),
}
#: Which measure a rule reads, where its name isn't the measure's.
MEASURE = {"short_word": "mean_word"}
BASE_WORDS, BASE_REPEAT = 10, 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!?.,;:\"'()[]{}|*#$%&<>~^_=+-/\\")] = True


def _bytes_per_text(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which (owner, hash) pairs occur more than once."""
    key = mix(h + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    out = np.zeros(len(key), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _later(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which (owner, hash) pairs occurred before in the arrays' order."""
    key = mix(h + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    k = key[order]
    out = np.zeros(len(key), bool)
    out[order[1:]] = k[1:] == k[:-1]
    return out


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text."""
    w = cut(data, offsets, SPACED)
    n_text = len(offsets) - 1
    n_words = w.n
    points = (data & 0xC0) != 0x80
    inside = SPACED[data]
    out = {"n_words": n_words, "word_chars": _bytes_per_text(points & inside, offsets), "n_symbols": _bytes_per_text(_SYMBOL[data], offsets)}
    # lines: text between two \n or ends, with a word in it
    breaks = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    if len(data):
        start = start[start < len(data)]
    owner = np.searchsorted(offsets, start, side="right") - 1
    stop = np.searchsorted(breaks, start)
    stop = np.where(stop < len(breaks), breaks[np.minimum(stop, max(len(breaks) - 1, 0))] if len(breaks) else len(data), len(data))
    stop = np.minimum(stop, offsets[np.minimum(owner + 1, n_text)])
    has = np.searchsorted(w.start, stop) > np.searchsorted(w.start, start)
    start, stop, owner = start[has], stop[has], owner[has]
    later = _later(owner, span_hash(data, start, stop)) if len(start) else np.zeros(0, bool)
    out["n_dup_lines"] = np.bincount(owner[later], minlength=n_text).astype(np.int64)
    out["n_lines"] = np.bincount(owner, minlength=n_text).astype(np.int64)
    gram, fits = w.grams(5)
    at = np.flatnonzero(fits)
    again = at[_repeated(w.text[at], gram[at])] if len(at) else at
    step = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, np.minimum(again + 5, len(step) - 1), -1)
    out["n_repeat_words"] = per_text(np.cumsum(step)[:-1] > 0, w.first)
    out["n_upper"] = _bytes_per_text(_UPPER[data], offsets)
    out["n_letters"] = _bytes_per_text(_LETTER[data] & points, offsets)
    out["n_punct"] = _bytes_per_text(_PUNCT[data], offsets)
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_punct")


def counts(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """keep and the counts of each text; map-only."""
    src = docs.select(*keep, F.col(text).alias("__text"))
    schema = docs.select(*keep).schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            m = measure(*buffers(column(b, "__text")))
            yield pa.RecordBatch.from_arrays([column(b, c) for c in keep] + [pa.array(m[c].astype(np.int64)) for c in COUNTS], names=[*keep, *COUNTS])

    return src.mapInArrow(run, schema)


def _measures() -> dict:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "n_letters"),
        "punct_share": share("n_punct", "word_chars"),
        "mean_word": share("word_chars", "n_words"),
    }


def base_failed():
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT * F.col("n_words"))


def _rejects(rule: str, cutoff: float, m: dict):
    value = m[MEASURE.get(rule, rule)]
    return value > cutoff if GRID[rule][0] == ">" else value < cutoff


def incomplete_beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    tiny, m = 1e-300, 0
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    while True:
        m += 1
        before = out
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            out *= c * d
        if abs(out - before) <= 1e-15 * abs(out) or m > 1_000_000:
            break
    return out * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest rate p with P(X <= k | n, p) >= level, by bisection."""
    if n <= 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if incomplete_beta(1 - mid, n - k, k + 1) < level:
            high = mid
        else:
            low = mid
    return high


def select(tallies: dict[tuple, dict], risk: float = RISK, delta: float = DELTA) -> dict[tuple, dict[str, float]]:
    """Cutoffs by stratum. tallies: stratum -> {"good": n, "bad": n, (rule, cutoff): (good rejected, bad rejected)}."""
    level, share = delta / (len(GRID) * max(1, len(tallies))), risk / len(GRID)
    out: dict[tuple, dict[str, float]] = {}
    for stratum, t in tallies.items():
        chosen: dict[str, float] = {}
        for rule, (side, cutoffs) in GRID.items():
            best = 0.0
            for c in sorted(cutoffs, reverse=side == ">"):  # the one that rejects least first
                good, bad = t[rule, c]
                if upper_bound(good, t["good"], level) > share:
                    break
                lift = bad / max(t["bad"], 1) - good / max(t["good"], 1)
                if bad and lift > best:
                    best, chosen[rule] = lift, c
        out[stratum] = chosen
    return out


def calibrate(measured: DataFrame, stratum: str, label: str, risk: float = RISK, delta: float = DELTA) -> dict:
    """Select cutoffs from labelled rows (label 1 is good) that pass the base rule: one aggregate, one row a stratum."""
    m = _measures()
    good = F.col(label) == 1
    aggs = [F.sum(F.when(good, 1).otherwise(0)).alias("good"), F.sum(F.when(good, 0).otherwise(1)).alias("bad")]
    names = []
    for rule, (_, cutoffs) in GRID.items():
        for i, c in enumerate(cutoffs):
            hit = _rejects(rule, c, m)
            aggs.append(F.sum(F.when(hit & good, 1).otherwise(0)).alias(f"{rule}{i}g"))
            aggs.append(F.sum(F.when(hit & ~good, 1).otherwise(0)).alias(f"{rule}{i}b"))
            names.append((rule, c, f"{rule}{i}"))
    rows = measured.where(F.col(label).isNotNull() & ~base_failed()).groupBy(stratum).agg(*aggs)
    tallies = {}
    for r in rows.collect():
        tallies[r[stratum]] = {"good": r["good"], "bad": r["bad"]} | {(n, c): (r[f"{a}g"], r[f"{a}b"]) for n, c, a in names}
    return select(tallies, risk, delta)


def verdict(cutoffs: dict, stratum: str):
    """Whether a learned rule of the row's stratum rejects it."""
    m = _measures()
    out = F.lit(False)
    for s, rules in sorted(cutoffs.items(), key=lambda x: str(x[0])):
        for rule, c in rules.items():
            out = out | (F.col(stratum).eqNullSafe(F.lit(s)) & _rejects(rule, c, m))
    return out


def apply_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", label: str = "quality", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row a document: the counts, base_failed and kept.

    The counts are taken once and written to the shared folder; the labels are
    joined to those narrow rows, and no text is shuffled.
    """
    told = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(label).alias("__label"))
    measured = written(counts(docs, (key, stratum)), "quality")
    known = measured.join(told, F.col(key) == F.col("__key")).drop("__key")
    cutoffs = calibrate(known, stratum, "__label", risk, delta)
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~verdict(cutoffs, stratum))
