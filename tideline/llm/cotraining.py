"""Quality classifier by co-training on two views of a document.

One logistic classifier reads the text (word and line measures, shares of
each ASCII mark), the other the page's metadata (source, language, stated
length). Both start from labelled documents. In each round each classifier
gives labels to the pool documents that it is sure of, and the other learns
from them. A classifier may only teach while its sure labels were right on
CHECKED labelled documents set apart: at least TRUST of them. At the end both
views are calibrated on those (Platt's scaling) and their logits are added,
each weighted as its calibration found it informative.

Learning takes about LABELLED and POOL documents at most, whole texts, chosen
by a hash of their ids; scores are given to all documents in one map-only
pass. Null and empty texts are scored by their zero measures, null metadata
count as a value of their own. Very long texts are measured whole. Without
labels of both kinds every score is one half, and an empty table gives an empty
one. A document with several labels counts with the largest. Repeated rows and
documents with equal measures get equal scores; columns that aren't named are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.quality_rules import measure
from tideline.llm.words import buffers, column, slices

LABELLED, POOL = 6000, 12000
ROUNDS, SURE, TRUST = 4, 0.95, 0.9
_MARKS = [i for i in range(0x21, 0x7F) if not chr(i).isalnum()]
TEXT_WIDTH = 10 + len(_MARKS)
META_WIDTH = 64 + 16 + 16


def text_view(col: pa.Array) -> np.ndarray:
    data, offsets = buffers(col)
    m = {k: v.astype(float) for k, v in measure(data, offsets).items()}
    share = lambda a, b: m[a] / np.maximum(m[b], 1)
    n = len(offsets) - 1
    marks = np.zeros(128, np.int64) - 1
    marks[_MARKS] = np.arange(len(_MARKS))
    kind = np.where(data < 128, marks[np.minimum(data, 127)], -1)
    at = np.flatnonzero(kind >= 0)
    owner = np.searchsorted(offsets, at, side="right") - 1
    table = np.bincount(owner * len(_MARKS) + kind[at], minlength=n * len(_MARKS)).reshape(n, -1)
    head = [np.ones(n), np.log1p(m["n_words"]), np.log1p(m["n_lines"]), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_upper", "n_letters"), share("n_punct", "word_chars"), share("word_chars", "n_words") / 10, np.log1p(share("n_words", "n_lines"))]
    return np.column_stack([*head, np.log1p(100 * table / np.maximum(m["n_words"], 1)[:, None])])


def meta_view(source: list, lang: list, size: list) -> np.ndarray:
    import zlib

    out = np.zeros((len(source), META_WIDTH))
    for i, (s, g, n) in enumerate(zip(source, lang, size, strict=True)):
        out[i, zlib.crc32(str(s).encode()) % 64] = 1
        out[i, 64 + zlib.crc32(str(g).encode()) % 16] = 1
        out[i, 80 + min(15, int(np.log2(1 + max(0, n or 0))))] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return w


def _p(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


@dataclass
class Model:
    """Weights of the two views, their calibrations (slope, offset) and the prior logit."""

    text: np.ndarray
    meta: np.ndarray
    scale: np.ndarray
    taught: tuple[int, int] = (0, 0)

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(text)), np.clip(text @ self.text, -15, 15), np.clip(meta @ self.meta, -15, 15)])
        return _p(z, self.scale)


def cotrain(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray]) -> Model:
    """views: text and metadata of labelled documents; pool: of unlabelled ones."""
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(TEXT_WIDTH), np.zeros(META_WIDTH), np.zeros(3))
    apart = np.arange(len(y)) % 3 == 2  # rows come in the order of a hash
    learn = [(v[~apart], y[~apart]) for v in views]
    own = list(learn)
    weights = [logistic(*x) for x in own]
    taught = [0, 0]
    free = [np.ones(len(pool[0]), bool), np.ones(len(pool[0]), bool)]
    for _ in range(ROUNDS):
        given = []
        for k in (0, 1):
            check = _p(views[k][apart], weights[k])
            sure = (check >= SURE) | (check <= 1 - SURE)
            right = ((check >= 0.5) == (y[apart] == 1))[sure]
            p = _p(pool[k], weights[k])
            ok = ((p >= SURE) | (p <= 1 - SURE)) & free[1 - k]
            given.append((ok if sure.any() and right.mean() >= TRUST else np.zeros(len(p), bool), p >= 0.5))
        for k in (0, 1):
            ok, label = given[1 - k]
            x, t = own[k]
            own[k] = (np.concatenate((x, pool[k][ok])), np.concatenate((t, label[ok].astype(float))))
            free[k] &= ~ok
            taught[k] += int(ok.sum())
            weights[k] = logistic(*own[k])
    z = np.column_stack([np.ones(apart.sum()), *(np.clip(v[apart] @ w, -15, 15) for v, w in zip(views, weights, strict=True))])
    return Model(weights[0], weights[1], logistic(z, y[apart], 0.1), tuple(taught))


def _sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    n = rows.count()
    h = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(9)), F.lit(1 << 32))
    return rows.where(h < min(1 << 32, (most << 32) // max(1, n)))


def _read(rows: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], list]:
    got = sorted(rows.collect(), key=lambda r: (r.h, str(r.label)))
    text = [text_view(pa.array([r.text for r in got[i : i + 500]], pa.string())) for i in range(0, len(got), 500)]
    return ((np.concatenate(text) if text else np.zeros((0, TEXT_WIDTH))), meta_view([r.source for r in got], [r.lang for r in got], [r.n_chars for r in got])), [r.label for r in got]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Model:
    """Learn from a bounded sample of labels' documents and of the others."""
    told = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("__key")).agg(F.max(label).alias("label"))
    docs = docs.select(F.col(key).alias("__id"), "text", "source", "lang", "n_chars")
    cols = (F.xxhash64(F.col("__id").cast("string"), F.lit(5)).alias("h"), "text", "source", "lang", "n_chars", "label")
    picked = _sample(told, "__key", LABELLED)  # about LABELLED rows of two numbers
    views, y = _read(docs.join(F.broadcast(picked), F.col("__id") == F.col("__key")).select(*cols))
    ids = _sample(docs.select("__id").where(F.col("__id").isNotNull()), "__id", POOL + LABELLED).join(told, F.col("__id") == F.col("__key"), "left_anti").distinct()
    pool, _ = _read(docs.join(F.broadcast(ids.withColumnRenamed("__id", "__key")), F.col("__id") == F.col("__key")).withColumn("label", F.lit(0)).select(*cols))
    return cotrain(views, np.array(y, float), pool)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and a score between 0 and 1 (good) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*keep, F.col("text").alias("__text"), F.col("source").alias("__source"), F.col("lang").alias("__lang"), F.col("n_chars").alias("__n"))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            meta = meta_view(column(b, "__source").to_pylist(), column(b, "__lang").to_pylist(), column(b, "__n").to_pylist())
            p = shared.value.score(text_view(column(b, "__text")), meta)
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in keep), pa.array(p)], names=[*keep, "score"])

    return src.mapInArrow(run, schema)
