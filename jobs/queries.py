"""The jobs as queries: each runs twice into a new folder, and what the second run left is the result. And their SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import segment_features, text_rhythm
from tideline.plans import oracle
from tideline.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_text_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, config = _folder(spark, "text-rhythm"), json.loads(text_rhythm.CONFIG.read_text())
    for _ in range(2):
        out = text_rhythm.run(spark, f"{sf_dir.rstrip('/')}/documents.parquet", f"{at}/rows", f"{at}/checkpoint", config)
    return out


def job2_segment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, config = _folder(spark, "segment-features"), json.loads(segment_features.CONFIG.read_text())
    for _ in range(2):
        out = segment_features.run(spark, f"{sf_dir.rstrip('/')}/embeddings.parquet", f"{at}/rows", f"{at}/mark", config)
    return out


QUERIES: dict[str, Query] = {"job1_text_rhythm": job1_text_rhythm, "job2_segment_features": job2_segment_features}


def _r(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0"


_RHYTHM = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT rid, t, CAST(length(w[t + 1]) AS DOUBLE) AS v, CAST(len(w) AS DOUBLE) AS n, CAST(length(w[1]) AS DOUBLE) AS v0
      FROM (SELECT rid, w, unnest(range(0, len(w))) AS t FROM docs)),
d1 AS (SELECT *, v - lag(v) OVER o AS d, v - avg(v) OVER (PARTITION BY rid) AS c FROM s WINDOW o AS (PARTITION BY rid ORDER BY t)),
d2 AS (SELECT *, lag(d) OVER o AS pd, d - lag(d) OVER o AS dd, coalesce(last_value(nullif(sign(c), 0) IGNORE NULLS) OVER o,
       first_value(nullif(sign(c), 0) IGNORE NULLS) OVER (PARTITION BY rid ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS g FROM d1 WINDOW o AS (PARTITION BY rid ORDER BY t)),
d3 AS (SELECT *, lag(g) OVER (PARTITION BY rid ORDER BY t) AS h FROM d2),
q AS (SELECT rid, any_value(n) AS n, avg(v) AS m, stddev_pop(v) AS s0, coalesce(stddev_pop(d), 0) AS s1, coalesce(stddev_pop(dd), 0) AS s2, max(v) - min(v) AS pp, sqrt(avg(v * v)) AS rms,
      count(*) FILTER (g * h < 0) AS flips, count(*) FILTER (d * pd < 0) AS turns, sum(sqrt(1 + d * d)) AS len, max(sqrt(t * t + (v - v0) * (v - v0))) AS far FROM d3 GROUP BY rid),
k AS (SELECT *, CASE WHEN s0 > 1e-10 THEN s1 / s0 ELSE 0 END AS mob, CASE WHEN s1 > 1e-10 THEN s2 / s1 ELSE 0 END AS mob2,
      CASE WHEN n >= 3 AND len >= 1e-10 AND far >= 1e-10 THEN log10(n - 1) / (log10(n - 1) + log10(far / len)) END AS katz FROM q)
SELECT doc_id, source, lang, CAST(len(w) AS BIGINT) AS n_words, {_r('m')} AS mean_length, {_r('s0')} AS length_std, {_r('pp')} AS length_range, {_r('rms')} AS length_rms,
  {_r('flips / n')} AS crossing_rate, {_r('mob')} AS hjorth_mobility, {_r('CASE WHEN mob > 1e-10 THEN mob2 / mob ELSE 0 END')} AS hjorth_complexity,
  {_r('CASE WHEN katz BETWEEN 0.5 AND 2 THEN katz END')} AS katz_fd, {_r('CASE WHEN turns > 0 THEN log10(n) / (log10(n) + log10(n / (n + 0.4 * turns))) END')} AS petrosian_fd
FROM docs LEFT JOIN k USING (rid)
"""

_PARTS = ("td_amplitude", "td_zero_crossing", "td_hjorth", "fd_absolute")
_SEGMENTS = """
WITH l AS (SELECT CAST(vec_id // 100 AS BIGINT) AS seg, CAST(arg_min(label, vec_id) AS BIGINT) AS label FROM embeddings GROUP BY 1 HAVING count(*) = 100)
SELECT CAST(seg // 4 AS BIGINT) AS trial, * FROM l JOIN """ + " JOIN ".join(f"({oracle.ORACLE_SQL[q]}) AS q{i} USING (seg)" for i, q in enumerate(_PARTS))

ORACLE_SQL: dict[str, str] = {"job1_text_rhythm": _RHYTHM, "job2_segment_features": _SEGMENTS}
