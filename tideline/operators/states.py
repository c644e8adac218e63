"""Microstates as DataFrame operations: peaks, polarity-invariant k-means over all maps, and features from runs.

No group holds a subject's maps. Maps are written once; a round of k-means
compares each map, where it lies, with its subject's few centres, one row a
subject, and sums the signed maps by (subject, state, channel), mostly before
they move. Only centres are joined with maps; Spark broadcasts them while they
are small. Whether a map has changed its state is seen from a hash of all
states, so a map is compared once a round. A subject
whose states no longer change keeps its centres. Rounds end when no subject
changes, or after `rounds`; each writes its centres, so lost executors cost a
round at most.

Seeds are the rows that one seeded generator draws from a subject's maps in
their order (Pascual-Marqui et al. 1995 leave the start open); a row's place in
that order comes from one ordering over all maps dealt by range.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tideline.functions import series
from tideline.operators.segments import indexed
from tideline.operators.spectrum import dot, matrix
from tideline.session import discard, written

EPS = 1e-10
STATES = 4
MEASURES = ("meandurs", "occurrence", "timecov", "mean_corr", "gev")


def field_power(m: Column) -> Column:
    """The deviation over channels at each time, from an array of channels."""
    n = F.size(m)
    zero = F.array_repeat(F.lit(0.0), F.size(m[0]))
    add = lambda f: F.aggregate(m, zero, lambda a, x: F.zip_with(a, f(x), lambda u, v: u + v))
    mean = F.transform(add(lambda x: x), lambda s: s / n)
    off = F.transform(m, lambda x: F.zip_with(x, mean, lambda v, u: (v - u) * (v - u)))
    return F.transform(F.aggregate(off, zero, lambda a, x: F.zip_with(a, x, lambda u, v: u + v)), lambda s: F.sqrt(s / n))


def peaks(g: Column) -> Column:
    """Places of local maxima, the middle of a plateau; the highest places where there are fewer than four."""
    n = F.size(g)
    edge = F.filter(F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>")), lambda i: g[i] != g[i + 1])
    runs = F.zip_with(F.concat(F.array(F.lit(0)), F.transform(edge, lambda e: e + 1)), F.concat(edge, F.array(n - 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    top = F.filter(runs, lambda r: (r["a"] > 0) & (r["b"] < n - 1) & (F.get(g, r["a"] - 1) < g[r["a"]]) & (F.get(g, r["b"] + 1) < g[r["b"]]))
    found = F.transform(top, lambda r: F.floor((r["a"] + r["b"]) / 2).cast("int"))
    ranked = F.array_sort(F.transform(g, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    most = F.least(F.greatest(F.lit(8), F.floor(n / 10).cast("int")), n)
    return F.when(F.size(found) >= 4, found).otherwise(F.transform(F.slice(ranked, n - most + 1, most), lambda s: s["i"]))


def peak_maps(segments: DataFrame, keys: tuple[str, ...] = ("seg",), subject: str | None = None, eeg: str = "eeg", by_time: bool = False) -> DataFrame:
    """(subject, keys, t, map): the values of all channels at each peak of field power. Nothing moves."""
    who = F.col(subject) if subject else F.lit(0).cast("long")
    rows = segments.select(who.alias("subject"), *keys, matrix(eeg, by_time).alias("__m"))
    rows = rows.withColumn("__g", F.when(F.col("__m").isNotNull(), field_power(F.col("__m")))).withColumn("__p", F.when(F.col("__g").isNotNull(), peaks(F.col("__g"))))
    return rows.select("subject", *keys, "__m", F.explode_outer("__p").alias("t")).where(F.col("t").isNotNull()).select("subject", *keys, "t", F.transform("__m", lambda x: x[F.col("t")]).alias("map"))


def unit(x: Column) -> Column:
    """A map without its mean and of length one; a flat one stays zero."""
    centred = lambda m: F.transform(m["x"], lambda v: v - m["mean"])
    one = F.array(F.struct(x.alias("x"), series.mean(x).alias("mean")))
    with_norm = F.transform(F.transform(one, centred), lambda c: F.struct(c.alias("c"), F.sqrt(dot(c, c)).alias("n")))
    return F.transform(with_norm, lambda c: F.transform(c["c"], lambda v: v / F.when(c["n"] < EPS, 1.0).otherwise(c["n"])))[0]


def nearest(u: Column, centres: Column) -> Column:
    """(r, k): the correlation with the centre that fits best whatever the sign, the first of equals, and its number."""
    each = F.transform(centres, lambda c, k: F.struct(dot(u, c).alias("r"), k.alias("k")))
    return F.aggregate(each, F.struct(F.lit(0.0).alias("r"), F.lit(-1).alias("k")), lambda a, v: F.when((a["k"] < 0) | (F.abs(v["r"]) > F.abs(a["r"])), v).otherwise(a))


def _drawn(counts: DataFrame, k: int, seed: int) -> DataFrame:
    """(subject, state, place): the places that a seeded generator draws from a subject's n maps; all, in order, where there are fewer."""
    schema = counts.select("subject").withColumn("state", F.lit(0)).withColumn("place", F.lit(0).cast("long")).schema

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, states, places = [], [], []
            for i, n in enumerate(b.column(1).to_pylist()):
                got = np.random.RandomState(seed).choice(n, k, replace=False).tolist() if n >= k else list(range(n))
                at += [i] * len(got)
                states += range(len(got))
                places += got
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(states, pa.int32()), pa.array(places, pa.int64())], names=schema.names)

    return counts.select("subject", "n").mapInArrow(draw, schema)


def _lists(centres: DataFrame) -> DataFrame:
    """(subject, centres): a subject's centres in order, as they are."""
    return centres.groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("state", "map"))), lambda s: s["map"]).alias("centres"))


def fit_template(segments: DataFrame, keys: tuple[str, ...] = ("seg",), subject: str | None = None, eeg: str = "eeg", by_time: bool = False, k: int = STATES, rounds: int = 100, seed: int = 42) -> DataFrame:
    """(subject, state, map): microstate maps of each subject, of length one. Without a subject column all segments are one subject's.

    A subject with fewer than k maps has these, as they are, and zeros. Null
    subjects are one subject. A subject without any map has no rows.
    """
    all_maps = peak_maps(segments, keys, subject, eeg, by_time).withColumn("subject", F.struct("subject"))  # a struct is never null, so subjects join
    placed = indexed(all_maps, ("subject", *keys, "t", "map"), "__at")
    first = placed.groupBy("subject").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("n"))
    numbered = placed.join(first, "subject").select("subject", (F.col("__at") - F.col("__first")).alias("place"), "map", unit(F.col("map")).alias("unit"))
    maps = written(numbered, "maps")
    counts = written(first, "subjects")
    width = maps.agg(F.max(F.size("map"))).first()[0]
    drawn = _drawn(counts, k, seed).join(maps, ["subject", "place"]).join(counts.select("subject", "n"), "subject")
    # round 0 takes every map for state 0
    start = maps.groupBy("subject").agg(F.bit_xor(F.xxhash64("place", F.lit(0))).alias("print"))
    firsts = drawn.groupBy("subject", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("state", "map"))), lambda s: s["map"]).alias("fresh"))
    centres = written(firsts.join(start, "subject").select("subject", F.col("fresh").alias("map"), "fresh", "print", (F.col("n") >= k).alias("moved")), "centres")
    means = F.array(*[F.avg(F.col("sign") * F.get("map", F.lit(i))) for i in range(width or 0)])  # null past the end of a subject's maps
    going = not centres.where("moved").isEmpty()
    for _ in range(rounds if going else 0):
        seen = Observation()
        old, centres = centres, written(_round(maps, centres, means).observe(seen, F.count(F.when(F.col("moved"), 1)).alias("moved")), "centres")
        discard(old)
        if not seen.get["moved"]:
            break
    ended = centres.select("subject", F.posexplode(F.when(F.col("moved"), F.col("fresh")).otherwise(F.col("map"))).alias("state", "map"))
    scaled = written(_final(ended, counts, k), "templates")
    for t in (maps, counts, centres):
        discard(t)
    return scaled


def _round(maps: DataFrame, centres: DataFrame, means: Column) -> DataFrame:
    """The next round of (subject, map, fresh, print, moved), one row a subject.

    map: the centres that the maps were compared with; fresh: the means of the
    maps that took each, or the centre where none did; print: the states that
    the maps took, as one number that doesn't depend on their order (an xor of
    64-bit hashes); moved: whether it is another one than the round before.
    """
    known = centres.where("moved").select("subject", F.transform("fresh", unit).alias("now"))
    rows = maps.join(known, "subject").withColumn("new", nearest(F.col("unit"), F.col("now")))
    each = rows.select("subject", F.col("new.k").alias("state"), F.xxhash64("place", F.col("new.k")).alias("h"), F.when(F.col("new.r") < 0, -1.0).otherwise(1.0).alias("sign"), "map")
    sums = each.groupBy("subject", "state").agg(F.array_compact(means).alias("mean"), F.bit_xor("h").alias("h"))
    sums = sums.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("state", "mean"))).alias("means"), F.bit_xor("h").alias("h"))
    now = F.transform("fresh", lambda c, i: F.coalesce(F.col("means")[i], c))
    taken = F.col("h").isNotNull()
    return centres.join(sums, "subject", "left").select(
        "subject", F.when(taken, F.col("fresh")).otherwise(F.col("map")).alias("map"), F.when(taken, now).otherwise(F.col("fresh")).alias("fresh"),
        F.coalesce("h", "print").alias("print"), (taken & (F.col("h") != F.col("print"))).alias("moved"),
    )


def _final(centres: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """Centres of length one; subjects with fewer maps than states get zeros for the rest, and keep their maps as they are."""
    norm = F.sqrt(dot(F.col("map"), F.col("map")))
    both = centres.join(counts.select("subject", "n"), "subject").withColumn("__n", norm)
    own = both.select(F.col("subject.subject").alias("subject"), "state", F.when(F.col("n") < k, F.col("map")).otherwise(F.transform("map", lambda v: v / F.when(F.col("__n") < EPS, 1.0).otherwise(F.col("__n")))).alias("map"))
    few = both.where(F.col("n") < k).groupBy("subject", "n").agg(F.max(F.size("map")).alias("c"))
    rest = few.select(F.col("subject.subject").alias("subject"), F.explode(F.sequence(F.col("n").cast("int"), F.lit(k - 1))).alias("state"), F.array_repeat(F.lit(0.0), F.col("c")).alias("map"))
    return own.unionByName(rest)


def fitted_features(segments: DataFrame, fs: float, by: tuple[str, ...] = ("subject",), keys: tuple[str, ...] = ("seg",), eeg: str = "eeg", by_time: bool = False) -> DataFrame:
    """Microstate features with maps fitted on the segments themselves, one template for all that agree in the columns `by`.

    By subject is the way to stable results. By trial, or by the segment's own
    keys, templates rest on few maps; a warning says so. All templates are
    fitted at once.
    """
    if tuple(by) != ("subject",):
        warnings.warn(f"microstate templates by {', '.join(by)} rest on few maps and may be unstable; fit them by subject", stacklevel=2)
    rows = segments.withColumn("__by", F.struct(*by))
    return features(rows, fit_template(rows, keys, "__by", eeg, by_time), fs, keys, "__by", eeg, by_time)


def features(segments: DataFrame, templates: DataFrame, fs: float, keys: tuple[str, ...] = ("seg",), subject: str | None = None, eeg: str = "eeg", by_time: bool = False, k: int = STATES) -> DataFrame:
    """Each state's mean duration, occurrence, time, mean correlation and explained variance, one row a segment.

    templates: (subject, state, map). Each time takes the map that it correlates
    with best; a run is a stretch of times with one map. A state that is never
    taken has zeros; segments without a full signal or a template have nulls.
    """
    who = F.col(subject) if subject else F.lit(0).cast("long")
    maps = _lists(templates).select(F.struct("subject").alias("__who"), F.transform("centres", unit).alias("__c"))
    rows = segments.withColumns({"__who": F.struct(who.alias("subject")), "__m": matrix(eeg, by_time)}).select(*keys, "__who", "__m").join(maps, "__who", "left")
    m, g = F.col("__m"), F.col("__g")
    rows = rows.withColumn("__g", F.when(m.isNotNull() & F.col("__c").isNotNull(), field_power(m)))
    width = F.sqrt(F.size(m).cast("double"))
    zero = F.array_repeat(F.lit(0.0), F.size(m[0]))
    # a centre has mean 0, so a time's mean needn't be taken off; its length is its field power times the root of the channels
    project = lambda c: F.aggregate(F.zip_with(m, c, lambda x, w: F.struct(x.alias("x"), w.alias("w"))), zero, lambda a, p: F.zip_with(a, p["x"], lambda u, v: u + v * p["w"]))
    rows = rows.withColumn("__s", F.when(g.isNotNull(), F.transform("__c", project)))
    length = lambda i: F.when(g[i] * width < EPS, 1.0).otherwise(g[i] * width)
    best = lambda i: F.aggregate(F.transform("__s", lambda s, j: F.struct((F.abs(s[i]) / length(i)).alias("r"), j.alias("k"))), F.struct(F.lit(-1.0).alias("r"), F.lit(-1).alias("k")), lambda a, v: F.when(v["r"] > a["r"], v).otherwise(a))
    rows = rows.withColumn("__b", F.when(g.isNotNull(), F.transform(g, lambda _, i: best(i))))
    b = F.col("__b")
    rows = rows.withColumn("__t", F.transform(b, lambda v, i: F.struct(v["r"].alias("r"), v["k"].alias("k"), g[i].alias("g"), ((i == 0) | (F.get(b, i - 1)["k"] != v["k"])).cast("double").alias("new"))))
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "runs", "r", "ev")])

    def gathered(state: int) -> Column:
        mine = F.filter("__t", lambda v: v["k"] == state)
        return F.aggregate(mine, start, lambda a, v: F.struct((a["n"] + 1).alias("n"), (a["runs"] + v["new"]).alias("runs"), (a["r"] + v["r"]).alias("r"), (a["ev"] + v["g"] * v["r"] * v["g"] * v["r"]).alias("ev")))

    rows = rows.withColumns({f"__k{s}": gathered(s) for s in range(k)} | {"__ev": F.aggregate("__t", F.lit(0.0), lambda a, v: a + v["g"] * v["g"]), "__n": F.size("__t").cast("double")})
    out = []
    for s in range(k):
        a = F.col(f"__k{s}")
        values = (a["n"] / fs / a["runs"], a["runs"] / (F.col("__n") / fs), a["n"] / fs, a["r"] / a["n"], F.when(F.col("__ev") > 0, a["ev"] / F.col("__ev")).otherwise(0.0))
        out += [F.when(g.isNotNull(), F.when(a["runs"] > 0, v).otherwise(0.0)).alias(f"Microstate_{s}_{name}") for name, v in zip(MEASURES, values, strict=True)]
    return rows.select(*keys, *out)
