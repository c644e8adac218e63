"""The same queries as DuckDB SQL, written in relational form from the definitions."""

from __future__ import annotations

import numpy as np

from tideline.functions.kernels import DB4
from tideline.model import BANDS, CAUDAL_PAIRS, FAA_PAIRS, FEATURES, MONTAGE_62, MONTAGE_90, PAIR_BANDS, PRESETS, SYMMETRIC_PAIRS


def _samples(length: int = 100) -> str:
    return f"""s AS (SELECT CAST(vec_id // {length} AS BIGINT) AS seg, vec_id % {length} AS t, c AS ch, CAST(embedding[c + 1] AS DOUBLE) AS v
      FROM embeddings, (SELECT unnest(range(0, 62)) AS c))"""


def _values(rows: list[tuple], cols: str) -> str:
    cell = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return f"(VALUES {', '.join('(' + ', '.join(cell(v) for v in r) + ')' for r in rows)}) AS x({cols})"


def _r(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"


def _wavelet(length: int = 100, level: int = 5) -> str:
    """Daubechies-4 details and last approximation, level by level: a join of samples with taps, edges mirrored."""
    high = DB4[::-1] * (-1.0) ** np.arange(1, 9)
    out = [f"taps AS (SELECT * FROM {_values([(k, float(DB4[k]), float(high[k])) for k in range(8)], 'k, lo, hi')})"]
    n, before = length, "s"
    for i in range(1, level + 1):
        m = (n + 7) // 2
        at = "2 * j + 1 - k"
        out.append(f"""m{i} AS (SELECT j, lo, hi, CASE WHEN {at} < 0 THEN -1 - ({at}) WHEN {at} >= {n} THEN {2 * n - 1} - ({at}) ELSE {at} END AS t FROM (SELECT unnest(range(0, {m})) AS j), taps),
  a{i} AS (SELECT seg, ch, j AS t, sum(lo * v) AS v, sum(hi * v) AS d FROM {before} JOIN m{i} USING (t) GROUP BY seg, ch, j)""")
        n, before = m, f"a{i}"
    parts = [f"SELECT seg, ch, sum(d * d) AS e FROM a{i} GROUP BY seg, ch" for i in range(1, level + 1)] + [f"SELECT seg, ch, sum(v * v) FROM {before} GROUP BY seg, ch"]
    out.append(f"e AS ({' UNION ALL '.join(parts)}), q AS (SELECT seg, ch, e, sum(e) OVER (PARTITION BY seg, ch) AS total FROM e)")
    out.append("h AS (SELECT seg, ch, -sum(e / total * ln(e / total)) AS h FROM q WHERE e > 0 AND total > 1e-10 GROUP BY seg, ch)")
    return f"WITH {_samples(length)}, {', '.join(out)} SELECT seg, {_r('avg(h)')} AS wavelet_energy_entropy FROM h GROUP BY seg"


#: Names of the 62 channels; side and area by name rules.
_SIDE = """CASE WHEN regexp_matches(name, 'Z$') OR NOT regexp_matches(name, '[0-9]$') THEN 'midline'
      WHEN CAST(regexp_extract(name, '([0-9]+)$', 1) AS INTEGER) % 2 = 1 THEN 'left' ELSE 'right' END"""
_AREA = """CASE WHEN name IN ('A1', 'A2') THEN 'reference' WHEN name LIKE 'CB%' THEN 'occipital'
      WHEN name LIKE 'FP%' OR name LIKE 'AF%' THEN 'frontal' WHEN name LIKE 'FT%' THEN 'temporal' WHEN name LIKE 'FC%' THEN 'central'
      WHEN name LIKE 'F%' THEN 'frontal' WHEN name LIKE 'TP%' THEN 'parietal' WHEN name LIKE 'T%' THEN 'temporal'
      WHEN name LIKE 'CP%' THEN 'parietal' WHEN name LIKE 'C%' THEN 'central' WHEN name LIKE 'P%' THEN CASE WHEN name LIKE 'PO%' THEN 'occipital' ELSE 'parietal' END
      WHEN name LIKE 'O%' OR name LIKE 'I%' THEN 'occipital' ELSE 'central' END"""
_ELECTRODES = f"el AS (SELECT ch, name, {_SIDE} AS side, {_AREA} AS area FROM {_values([(i, n) for i, n in enumerate(MONTAGE_62)], 'ch, name')})"


def _spectrum(nperseg: int = 64, step: int = 32, nfft: int = 512, length: int = 100, fs: float = 200.0) -> str:
    """p(seg, ch, k, hz, p): Welch's density by a join with a Fourier basis."""
    n_frames = (length - nperseg) // step + 1
    even = f"k IN (0, {nfft // 2})" if nfft % 2 == 0 else "k = 0"
    return f"""{_samples(length)},
    fr AS (SELECT seg, ch, f, t - {step} * f AS n, v FROM s, (SELECT unnest(range(0, {n_frames})) AS f) WHERE t >= {step} * f AND t < {step} * f + {nperseg}),
    fd AS (SELECT seg, ch, f, n, (v - avg(v) OVER (PARTITION BY seg, ch, f)) * (0.5 - 0.5 * cos(2 * pi() * n / {nperseg})) AS v FROM fr),
    basis AS (SELECT k, n, cos(2 * pi() * k * n / {nfft}) AS c, sin(2 * pi() * k * n / {nfft}) AS d
              FROM (SELECT unnest(range(0, {nfft // 2 + 1})) AS k), (SELECT unnest(range(0, {nperseg})) AS n)),
    ft AS (SELECT seg, ch, f, k, sum(v * c) AS re, sum(v * d) AS im FROM fd JOIN basis USING (n) GROUP BY seg, ch, f, k),
    p AS (SELECT seg, ch, k, k * {fs} / {nfft} AS hz, avg(re * re + im * im) * CASE WHEN {even} THEN 1 ELSE 2 END / ({fs} * {nperseg * 3 / 8}) AS p
          FROM ft GROUP BY seg, ch, k)"""


_BANDS = "bands AS (SELECT * FROM " + _values([*BANDS, ("total", 0.5, 100.0), ("low", 1.0, 8.0), ("high", 13.0, 40.0)], "band, lo, hi") + ")"


def _powers(closed: bool = False, nfft: int = 512, fs: float = 200.0) -> str:
    """bp(seg, ch, band, bp): trapezoid over the bins of each band."""
    upper = "<=" if closed else "<"
    return f"""{_BANDS},
    bp AS (SELECT seg, ch, band, CASE WHEN count(*) > 1 THEN (sum(p) - (arg_min(p, k) + arg_max(p, k)) / 2) * {fs / nfft} ELSE 0 END AS bp
           FROM p JOIN bands ON hz >= lo AND hz {upper} hi GROUP BY seg, ch, band)"""


def _pick(band: str) -> str:
    return f"max(CASE WHEN band = '{band}' THEN bp END)"


#: One row a channel, a column a band.
_WIDE = "w AS (SELECT seg, ch, " + ", ".join(f"{_pick(b)} AS {b}" for b in [*(x[0] for x in BANDS), "total", "low", "high"]) + " FROM bp GROUP BY seg, ch)"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN least(greatest(({a}) / ({b}), 0.01), 100.0) END"


_MAIN = f"{_spectrum()}, {_powers()}, {_WIDE}, {_ELECTRODES}"
_DIFF = f"""{_samples()},
  d1 AS (SELECT *, v - lag(v) OVER o AS d FROM s WINDOW o AS (PARTITION BY seg, ch ORDER BY t)),
  d2 AS (SELECT *, d - lag(d) OVER o AS dd FROM d1 WINDOW o AS (PARTITION BY seg, ch ORDER BY t))"""


def _hjorth(head: str, extra: str = "") -> str:
    return f"""WITH {head}, c AS (SELECT seg, ch, stddev_pop(v) AS s0, stddev_pop(d) AS s1, stddev_pop(dd) AS s2 {extra} FROM d2 GROUP BY seg, ch),
  m AS (SELECT *, CASE WHEN s0 > 1e-10 THEN s1 / s0 ELSE 0 END AS mob, CASE WHEN s1 > 1e-10 THEN s2 / s1 ELSE 0 END AS mob2 FROM c)"""


_CX_MOB = "avg(CASE WHEN mob > 1e-10 THEN mob2 / mob ELSE 0 END)"

_USER = """s AS (SELECT user_id AS seg, 0 AS ch, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t, value AS v FROM events)"""
_USER_DIFF = _DIFF.replace(_samples(), _USER)

#: Sign changes of a channel: zeros take the sign before them, leading ones the first.
_FLIPS = """z AS (SELECT seg, ch, t, coalesce(last_value(nullif(sign(v), 0) IGNORE NULLS) OVER (PARTITION BY seg, ch ORDER BY t),
                 first_value(nullif(sign(v), 0) IGNORE NULLS) OVER (PARTITION BY seg, ch ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS g FROM s),
  zc AS (SELECT seg, ch, count(*) FILTER (g * h < 0) / (count(*) / 200.0) AS rate
         FROM (SELECT *, lag(g) OVER (PARTITION BY seg, ch ORDER BY t) AS h FROM z) GROUP BY seg, ch)"""

_LABELLED = """l AS (SELECT CAST(seg // 2 AS BIGINT) AS trial, seg AS segment, label, seg * 2.0 AS a, seg * 2.0 + 2.0 AS b
  FROM (SELECT CAST(vec_id // 100 AS BIGINT) AS seg, CAST(arg_min(label, vec_id) AS BIGINT) AS label FROM embeddings GROUP BY 1))"""


def _merged(part: str) -> str:
    return f"""WITH {_LABELLED},
  n AS (SELECT *, (row_number() OVER ({part} ORDER BY trial, segment) - 1) // 2 AS g FROM l)
SELECT string_agg(CAST(trial AS VARCHAR), ',' ORDER BY trial, segment) AS trial_ids, string_agg(CAST(segment AS VARCHAR), ',' ORDER BY trial, segment) AS segment_ids,
  arg_min(label, segment) AS primary_label, string_agg(CAST(label AS VARCHAR), ',' ORDER BY trial, segment) AS labels,
  CAST(min(a) AS DOUBLE) AS start_time, CAST(max(b) AS DOUBLE) AS end_time, CAST(2.0 * count(*) AS DOUBLE) AS total_time_length, count(*) AS merge_count,
  string_agg('trial' || trial || '/segment' || segment, ',' ORDER BY trial, segment) AS source_segments
FROM n GROUP BY {'trial, ' if part else ''}g HAVING count(*) = 2"""


_SUBJECTS = """l AS (SELECT seg % 3 AS subject, CAST(seg // 24 AS BIGINT) AS trial, CAST(seg // 3 AS BIGINT) AS segment, CAST((seg // 3) % 2 + 1 AS BIGINT) AS session_id, label
  FROM (SELECT CAST(vec_id // 20 AS BIGINT) AS seg, CAST(arg_min(label, vec_id) AS BIGINT) AS label FROM embeddings GROUP BY 1))"""


def _merged_subjects(part: str) -> str:
    listed = lambda c: f"string_agg({c}, ',' ORDER BY trial, segment)"
    return f"""WITH {_SUBJECTS},
  n AS (SELECT *, (row_number() OVER (PARTITION BY {part} ORDER BY trial, segment) - 1) // 2 AS g FROM l)
SELECT {listed('CAST(trial AS VARCHAR)')} AS trial_ids, {listed('CAST(segment AS VARCHAR)')} AS segment_ids, arg_min(label, segment) AS primary_label,
  {listed('CAST(label AS VARCHAR)')} AS labels, CAST(min(segment) * 2.0 AS DOUBLE) AS start_time, CAST(max(segment) * 2.0 + 2.0 AS DOUBLE) AS end_time,
  CAST(2.0 * count(*) AS DOUBLE) AS total_time_length, count(*) AS merge_count, 'subject' || subject || ',' || {listed("'trial' || trial || '/segment' || segment")} AS sources
FROM n GROUP BY {part}, g HAVING count(*) = 2"""


def _statistics_subjects(by: str) -> str:
    return f"""WITH {_SUBJECTS}, tr AS (SELECT subject, trial, arg_min({by}, segment) AS {by}, count(*) AS n FROM l GROUP BY ALL)
SELECT subject, {by}, count(*) AS n_trials, CAST(sum(n) AS BIGINT) AS n_segments FROM tr GROUP BY ALL"""


def _entropies(length: int = 100) -> str:
    n2, n3 = length - 1, length - 2
    return f"""WITH {_samples(length)},
  e AS (SELECT seg, ch, t, v, lead(v) OVER o AS v1, lead(v, 2) OVER o AS v2, 0.2 * stddev_pop(v) OVER (PARTITION BY seg, ch) AS r FROM s
        WINDOW o AS (PARTITION BY seg, ch ORDER BY t)),
  j AS (SELECT a.seg, a.ch, a.t, b.t AS u, a.v2 IS NOT NULL AND b.v2 IS NOT NULL AND abs(a.v2 - b.v2) < a.r AS more
        FROM e a JOIN e b ON a.seg = b.seg AND a.ch = b.ch AND abs(a.v - b.v) < a.r AND abs(a.v1 - b.v1) < a.r),
  c AS (SELECT seg, ch, t, count(*) AS b, count(*) FILTER (more) AS a, count(*) FILTER (u > t) AS b1, count(*) FILTER (u > t AND more) AS a1 FROM j GROUP BY seg, ch, t),
  q AS (SELECT seg, ch, CASE WHEN sum(a1) > 0 AND sum(b1) > 0 THEN -ln(sum(a1) / sum(b1)) ELSE 0 END AS sampen,
        avg(ln(b / {n2}.0)) - avg(CASE WHEN a > 0 THEN ln(a / {n3}.0) END) AS apen FROM c GROUP BY seg, ch)
SELECT seg, {_r('avg(sampen)')} AS sample_entropy, {_r('avg(apen)')} AS approx_entropy FROM q GROUP BY seg"""


_DE = f"""{_spectrum(100, 50, 100)}, {_powers(closed=True, nfft=100)}, {_ELECTRODES},
  de AS (SELECT seg, bp.ch, name, band, 0.5 * ln(2 * pi() * exp(1) * greatest(bp, 1e-15)) AS de FROM bp JOIN el USING (ch))"""


def _pairs(kind: str, pairs, expr: str, where: str = "") -> str:
    cols = ", ".join(f"{_r(f'''avg(CASE WHEN band = '{b}' THEN v END)''')} AS {kind}_{b}" for b in PAIR_BANDS)
    return f"""WITH {_DE}, pr AS (SELECT * FROM {_values([tuple(p) for p in pairs], 'a, b')}),
  v AS (SELECT x.seg, x.band, {expr} AS v FROM pr JOIN de x ON x.name = pr.a JOIN de y ON y.name = pr.b AND y.seg = x.seg AND y.band = x.band {where})
SELECT seg, {cols} FROM v GROUP BY seg"""


_COHERENCE = f"""{_spectrum(64, 32, 64)}, {_ELECTRODES},
  fa AS (SELECT seg, ch, f, k, re, -im AS im FROM ft WHERE k * 200.0 / 64 BETWEEN 8 AND 13),
  cc AS (SELECT a.seg, a.ch AS i, b.ch AS j, a.k, avg(a.re * b.re + a.im * b.im) AS x, avg(a.im * b.re - a.re * b.im) AS y,
         avg(a.re * a.re + a.im * a.im) AS pa, avg(b.re * b.re + b.im * b.im) AS pb
         FROM fa a JOIN fa b ON a.seg = b.seg AND a.f = b.f AND a.k = b.k AND a.ch < b.ch GROUP BY 1, 2, 3, 4),
  edges AS (SELECT seg, i, j, avg((x * x + y * y) / (pa * pb)) AS w FROM cc GROUP BY seg, i, j)"""

_GRAPH = f"""{_COHERENCE},
  cut AS (SELECT seg, quantile_cont(w, 0.7) AS cut FROM edges GROUP BY seg),
  g AS (SELECT seg, i, j FROM edges JOIN cut USING (seg) WHERE w >= cut UNION ALL SELECT seg, j, i FROM edges JOIN cut USING (seg) WHERE w >= cut)"""

_NETWORK = f"""WITH RECURSIVE {_GRAPH},
  deg AS (SELECT seg, i, count(*) AS k FROM g GROUP BY seg, i),
  tri AS (SELECT a.seg, a.i, count(*) / 2.0 AS t FROM g a JOIN g b ON a.seg = b.seg AND a.j = b.i JOIN g c ON c.seg = b.seg AND c.i = b.j AND c.j = a.i GROUP BY 1, 2),
  clu AS (SELECT n.seg, avg(CASE WHEN k >= 2 THEN coalesce(t, 0) / (k * (k - 1) / 2.0) ELSE 0 END) AS c
          FROM (SELECT DISTINCT seg, ch AS i FROM s) n LEFT JOIN deg USING (seg, i) LEFT JOIN tri USING (seg, i) GROUP BY n.seg),
  walk(seg, i, j, d) AS (SELECT DISTINCT seg, i, i, 0 FROM g
     UNION SELECT w.seg, w.i, g.j, w.d + 1 FROM walk w JOIN g ON w.seg = g.seg AND w.j = g.i WHERE w.d < 8),
  dist AS (SELECT seg, i, j, min(d) AS d FROM walk GROUP BY seg, i, j HAVING min(d) > 0),
  pl AS (SELECT seg, avg(d) AS l, sum(1.0 / d) / (62 * 61) AS e FROM dist GROUP BY seg)
SELECT seg, {_r('c')} AS network_clustering_coefficient, {_r('l')} AS network_characteristic_path_length, {_r('e')} AS network_global_efficiency,
  {_r('(c / (18.6 / 62)) / (l / (ln(62) / ln(18.6)))')} AS network_small_world_index
FROM clu JOIN pl USING (seg)"""

_MICRO = f"""WITH {_samples()},
  gf AS (SELECT seg, t, stddev_pop(v) AS gfp FROM s GROUP BY seg, t),
  x AS (SELECT seg, t, ch, v - avg(v) OVER (PARTITION BY seg, t) AS v FROM s),
  m AS (SELECT vec_id AS k, c AS ch, CAST(embedding[c + 1] AS DOUBLE) AS m FROM embeddings, (SELECT unnest(range(0, 62)) AS c) WHERE vec_id < 4),
  mc AS (SELECT k, ch, m - avg(m) OVER (PARTITION BY k) AS m FROM m),
  r AS (SELECT seg, t, k, abs(sum(v * m) / sqrt(sum(v * v) * sum(m * m))) AS r FROM x JOIN mc USING (ch) GROUP BY seg, t, k),
  b AS (SELECT seg, t, arg_min(k, row(-r, k)) AS k, max(r) AS r FROM r GROUP BY seg, t),
  runs AS (SELECT b.*, gfp, lag(k) OVER (PARTITION BY seg ORDER BY t) IS DISTINCT FROM k AS new FROM b JOIN gf USING (seg, t)),
  a AS (SELECT seg, k, count(*) AS n, count(*) FILTER (new) AS runs, avg(r) AS r, sum(gfp * r * gfp * r) AS ev FROM runs GROUP BY seg, k),
  tot AS (SELECT seg, count(*) AS n, sum(gfp * gfp) AS ev FROM gf GROUP BY seg)
SELECT tot.seg, """ + ", ".join(
    f"{_r(f'coalesce(max(CASE WHEN k = {k} THEN {e} END), 0)', 5)} AS Microstate_{k}_{n}"
    for k in range(4)
    for n, e in (("meandurs", "a.n / 200.0 / runs"), ("occurrence", "runs / (tot.n / 200.0)"), ("timecov", "a.n / 200.0"), ("mean_corr", "r"), ("gev", "a.ev / tot.ev"))
) + " FROM tot LEFT JOIN a USING (seg) GROUP BY tot.seg, tot.n, tot.ev"

_TD = f"""SELECT seg, {_r('sum(a) / sum(n)')} AS mean_abs_amplitude, {_r('avg(sd)')} AS mean_channel_std, {_r('avg(pp)')} AS mean_peak_to_peak, {_r('avg(rms)')} AS mean_rms
FROM (SELECT seg, ch, sum(abs(v)) AS a, count(v) AS n, stddev_pop(v) AS sd, max(v) - min(v) AS pp, sqrt(avg(v * v)) AS rms FROM s GROUP BY seg, ch) GROUP BY seg"""
_TD_BASE = f"td AS (WITH {_samples()} {_TD})"


def _selected(name: str) -> tuple[str, str, int, int, str]:
    groups, include, exclude = PRESETS[name]
    every = {f: g for g, fs in FEATURES.items() for f in fs}
    raw = {f for g in groups for f in FEATURES[g]} | set(include)
    tidy = {f.strip() for f in raw} - set(exclude)
    raw -= set(exclude)
    return name, len(raw), sum(f in every for f in raw), ",".join(g for g in FEATURES if any(every.get(f) == g for f in tidy))


_montages = _values([("62", n) for n in MONTAGE_62] + [("90", n) for n in MONTAGE_90], "montage, name")

ORACLE_SQL: dict[str, str] = {
    "td_amplitude": f"WITH {_samples()} {_TD}",
    "td_zero_crossing": f"WITH {_samples()}, {_FLIPS} SELECT seg, {_r('avg(rate)')} AS mean_zero_crossing_rate FROM zc GROUP BY seg",
    "td_hjorth": f"{_hjorth(_DIFF)} SELECT seg, {_r('avg(s0 * s0)')} AS hjorth_activity, {_r('avg(mob)')} AS hjorth_mobility, {_r(_CX_MOB)} AS hjorth_complexity FROM m GROUP BY seg",
    "td_user_series": f"""{_hjorth(_USER_DIFF, ', avg(abs(v)) AS a, max(v) - min(v) AS pp, sqrt(avg(v * v)) AS rms')}, {_FLIPS}
SELECT seg, {_r('avg(a)', 8)} AS mean_abs_amplitude, {_r('avg(s0)', 8)} AS mean_channel_std, {_r('avg(pp)', 8)} AS mean_peak_to_peak, {_r('avg(rms)', 8)} AS mean_rms,
  {_r('avg(rate)', 8)} AS mean_zero_crossing_rate, {_r('avg(s0 * s0)', 8)} AS hjorth_activity, {_r('avg(mob)', 8)} AS hjorth_mobility, {_r(_CX_MOB, 8)} AS hjorth_complexity
FROM m JOIN zc USING (seg, ch) GROUP BY seg""",
    "seg_statistics": f"WITH {_LABELLED}, tr AS (SELECT trial, arg_min(label, segment) AS label, count(*) AS n FROM l GROUP BY trial) SELECT label, count(*) AS n_trials, CAST(sum(n) AS BIGINT) AS n_segments FROM tr GROUP BY label",
    "seg_merge_within_subjects": _merged_subjects("subject, trial"),
    "seg_merge_cross_subjects": _merged_subjects("subject"),
    "seg_lineage_subjects": f"""WITH {_SUBJECTS}, n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY trial, segment) - 1 AS r FROM l)
SELECT subject, CAST(r // 2 AS BIGINT) AS merged_id, CAST(r % 2 AS BIGINT) AS nth, trial, segment, label FROM n QUALIFY count(*) OVER (PARTITION BY subject, r // 2) = 2""",
    "seg_sample_subjects": f"WITH {_SUBJECTS} SELECT subject, trial, segment FROM l QUALIFY row_number() OVER (PARTITION BY subject, trial ORDER BY md5('42:' || subject || ':' || trial || ':' || segment), segment) <= 1",
    "seg_statistics_subjects": _statistics_subjects("label"),
    "seg_statistics_sessions": _statistics_subjects("session_id"),
    "seg_merge_within": _merged("PARTITION BY trial"),
    "seg_merge_cross": _merged(""),
    "seg_lineage": f"""WITH {_LABELLED}, n AS (SELECT *, row_number() OVER (ORDER BY trial, segment) - 1 AS r FROM l)
SELECT CAST(r // 2 AS BIGINT) AS merged_id, CAST(r % 2 AS BIGINT) AS nth, trial, segment, label FROM n QUALIFY count(*) OVER (PARTITION BY r // 2) = 2""",
    "seg_sample_per_trial": f"WITH {_LABELLED} SELECT trial, segment FROM l QUALIFY row_number() OVER (PARTITION BY trial ORDER BY md5('42:' || trial || ':' || segment), segment) <= 1",
    "seg_tumbling_grid": f"""WITH e AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, event_type, value FROM events),
  seen AS (SELECT hour, event_type, avg(value) AS v FROM e GROUP BY 1, 2),
  ty AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS ch FROM (SELECT DISTINCT event_type FROM e)),
  hs AS (SELECT unnest(range(a, b + 1)) AS hour, a FROM (SELECT min(hour) AS a, max(hour) AS b FROM e)),
  grid AS (SELECT hour, hour - a AS t, ch, event_type FROM hs, ty)
SELECT CAST(t // 24 AS BIGINT) AS seg, ch, count(*) AS n, {_r('avg(coalesce(v, 0))', 8)} AS mean_v, {_r('max(coalesce(v, 0))', 8)} AS max_v
FROM grid LEFT JOIN seen USING (hour, event_type) GROUP BY 1, 2""",
    "electrode_groups": f"""SELECT montage, side AS hemisphere, area AS region, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
FROM (SELECT montage, name, CASE WHEN name IN ('A1', 'T1', 'T9') THEN 'left' WHEN name IN ('A2', 'T2', 'T10') THEN 'right' ELSE {_SIDE} END AS side, {_AREA} AS area FROM {_montages}) GROUP BY 1, 2, 3""",
    "feature_catalog": f"SELECT grp, count(*) AS n, min(f) AS first_feature, max(f) AS last_feature FROM {_values([(g, f) for g, fs in FEATURES.items() for f in fs], 'grp, f')} GROUP BY grp",
    "preset_sizes": f"SELECT preset, CAST(selected AS BIGINT) AS selected, CAST(computable AS BIGINT) AS computable, required_groups FROM {_values([_selected(p) for p in PRESETS], 'preset, selected, computable, required_groups')}",
    "psd_welch": f"WITH {_spectrum()} SELECT seg, k, {_r('hz')} AS hz, {_r('avg(p) * 1e6')} AS power FROM p GROUP BY seg, k, hz",
    "band_coverage": f"""WITH {_spectrum()}, {_powers()}, nb AS (SELECT band, count(DISTINCT k) AS bins FROM p JOIN bands ON hz >= lo AND hz < hi GROUP BY band)
SELECT band, any_value(bins) AS bins, {_r('min(bp) * 1e6', 4)} AS min_v, {_r('max(bp) * 1e6', 4)} AS max_v, {_r('median(bp * 1e6)', 4)} AS median_v
FROM bp JOIN nb USING (band) WHERE band NOT IN ('total', 'low', 'high') GROUP BY band""",
    "fd_absolute": f"WITH {_MAIN} SELECT seg, " + ", ".join(f"{_r(f'avg({b[0]})')} AS {b[0]}_power" for b in BANDS) + f", {_r('avg(total)')} AS mean_total_power FROM w GROUP BY seg",
    "fd_relative": f"WITH {_MAIN} SELECT seg, " + ", ".join(f"{_r(f'avg({_ratio(b[0], "total")})')} AS {b[0]}_relative_power" for b in BANDS) + " FROM w GROUP BY seg",
    "fd_peaks": f"""WITH {_spectrum()}, q AS (SELECT seg, ch, arg_min(CASE WHEN hz BETWEEN 0.5 AND 100 THEN hz END, row(-p, k)) FILTER (hz BETWEEN 0.5 AND 100) AS a,
  arg_min(hz, row(-p, k)) FILTER (hz BETWEEN 8 AND 13) AS b FROM p GROUP BY seg, ch)
SELECT seg, {_r('avg(a)')} AS peak_frequency, {_r('avg(b)')} AS individual_alpha_frequency FROM q GROUP BY seg""",
    "fd_entropy_centroid": f"""WITH {_spectrum()}, t AS (SELECT seg, ch, k, hz, p, sum(p) OVER (PARTITION BY seg, ch) AS m FROM p),
  q AS (SELECT seg, ch, -sum(CASE WHEN p > 0 THEN p / m * ln(p / m) ELSE 0 END) AS h, sum(hz * p) / sum(p) AS c FROM t GROUP BY seg, ch)
SELECT seg, {_r('avg(h)')} AS spectral_entropy, {_r('avg(c)')} AS spectral_centroid FROM q GROUP BY seg""",
    "fd_ratios": f"WITH {_MAIN} SELECT seg, {_r(_ratio('avg(theta)', 'avg(beta)'))} AS theta_beta_ratio, {_r(_ratio('avg(delta)', 'avg(theta)'))} AS delta_theta_ratio, {_r(f'''avg({_ratio('low', 'high')})''')} AS low_high_power_ratio FROM w GROUP BY seg",
    "fd_aperiodic": f"WITH {_spectrum()}, q AS (SELECT seg, ch, -regr_slope(log10(p), log10(hz)) AS a FROM p WHERE hz BETWEEN 2 AND 40 AND p > 1e-10 GROUP BY seg, ch) SELECT seg, {_r('avg(a)')} AS aperiodic_exponent FROM q GROUP BY seg",
    "composite_scores": f"""WITH {_MAIN},
  q AS (SELECT seg, {_ratio('sum(theta)', 'sum(alpha)')} AS ta, {_ratio("avg(beta) FILTER (area = 'frontal')", 'avg(beta)')} AS fb, {_ratio('sum(alpha)', 'sum(delta)')} AS ad,
        sum(alpha) / (sum(alpha) + sum(beta)) AS rel FROM w JOIN el USING (ch) GROUP BY seg)
SELECT seg, {_r('ta')} AS theta_alpha_ratio, {_r('fb')} AS frontal_beta_ratio, {_r('1 / (1 + exp(-2 * (0.6 * ta + 0.4 * fb - 1)))')} AS cognitive_load_estimate,
  {_r('1 / (1 + exp(-2 * (ad - 0.5)))')} AS alertness_estimate, {_r('rel')} AS relaxation_index FROM q""",
    "de_bands": f"WITH {_DE} SELECT seg, " + ", ".join(f"{_r(f'''avg(CASE WHEN band = '{b[0]}' THEN de END)''')} AS de_{b[0]}" for b in BANDS) + " FROM de GROUP BY seg",
    "de_dasm": _pairs("dasm", SYMMETRIC_PAIRS, "x.de - y.de"),
    "de_rasm": f"""WITH {_DE.replace('greatest(bp, 1e-15)', 'greatest(bp * 1e4, 1e-15)')}, pr AS (SELECT * FROM {_values([tuple(p) for p in SYMMETRIC_PAIRS], 'a, b')}),
  v AS (SELECT x.seg, x.band, CASE WHEN x.de > 0 AND y.de > 0 THEN least(greatest(x.de / y.de, 0.01), 100.0) END AS v FROM pr JOIN de x ON x.name = pr.a JOIN de y ON y.name = pr.b AND y.seg = x.seg AND y.band = x.band)
SELECT seg, """ + ", ".join(f"{_r(f'''avg(CASE WHEN band = '{b}' THEN v END)''')} AS rasm_{b}" for b in PAIR_BANDS) + " FROM v GROUP BY seg",
    "de_dcau": _pairs("dcau", CAUDAL_PAIRS, "x.de - y.de"),
    "de_faa": f"""WITH {_MAIN}, a AS (SELECT seg, name, ln(greatest(alpha, 1e-15)) AS a FROM w JOIN el USING (ch)),
  pr AS (SELECT * FROM {_values([tuple(p) for p in FAA_PAIRS], 'l, r')}),
  v AS (SELECT x.seg, pr.l, y.a - x.a AS v FROM pr JOIN a x ON x.name = pr.l JOIN a y ON y.name = pr.r AND y.seg = x.seg)
SELECT seg, {_r("max(CASE WHEN l = 'F3' THEN v END)")} AS faa_f3f4, {_r("max(CASE WHEN l = 'F7' THEN v END)")} AS faa_f7f8, {_r("max(CASE WHEN l = 'FP1' THEN v END)")} AS faa_fp1fp2, {_r('avg(v)')} AS faa_mean FROM v GROUP BY seg""",
    "cx_fractal": f"""WITH {_DIFF},
  kz AS (SELECT seg, ch, sum(sqrt(1 + d * d)) AS len, max(sqrt(t * t + (v - v0) * (v - v0))) AS far, count(*) AS n, count(*) FILTER (d * pd < 0) AS turns
         FROM (SELECT *, first_value(v) OVER o AS v0, lag(d) OVER o AS pd FROM d1 WINDOW o AS (PARTITION BY seg, ch ORDER BY t)) GROUP BY seg, ch),
  hk AS (SELECT seg, ch, k, t % k AS m, abs(v - lag(v) OVER (PARTITION BY seg, ch, k, t % k ORDER BY t)) AS d FROM s, (SELECT unnest(range(1, 9)) AS k)),
  hl AS (SELECT seg, ch, k, m, sum(d) * 99.0 / (count(d) * k) / k AS l FROM hk GROUP BY seg, ch, k, m HAVING count(d) > 0),
  hf AS (SELECT seg, ch, -regr_slope(ln(l + 1e-15), ln(k)) AS h FROM (SELECT seg, ch, k, avg(l) AS l FROM hl GROUP BY seg, ch, k) GROUP BY seg, ch)
SELECT seg, {_r('avg(CASE WHEN h BETWEEN 1 AND 2 THEN h END)')} AS higuchi_fd,
  {_r('avg(CASE WHEN log10(n - 1) / (log10(n - 1) + log10(far / len)) BETWEEN 0.5 AND 2 THEN log10(n - 1) / (log10(n - 1) + log10(far / len)) END)')} AS katz_fd,
  {_r('avg(CASE WHEN turns > 0 THEN log10(n) / (log10(n) + log10(n / (n + 0.4 * turns))) END)')} AS petrosian_fd
FROM kz JOIN hf USING (seg, ch) GROUP BY seg""",
    "cx_hurst": f"""WITH {_samples()}, z AS (SELECT seg, ch, n, t // n AS part, t, v - avg(v) OVER (PARTITION BY seg, ch, n, t // n) AS c, v FROM s, (SELECT unnest([16, 32]) AS n) WHERE t < 100 // n * n),
  y AS (SELECT *, sum(c) OVER (PARTITION BY seg, ch, n, part ORDER BY t) AS y FROM z),
  rs AS (SELECT seg, ch, n, part, (max(y) - min(y)) / stddev_samp(v) AS rs FROM y GROUP BY seg, ch, n, part HAVING stddev_samp(v) > 1e-10),
  h AS (SELECT seg, ch, regr_slope(ln(r), ln(n)) AS h FROM (SELECT seg, ch, n, avg(rs) AS r FROM rs GROUP BY seg, ch, n) GROUP BY seg, ch)
SELECT seg, {_r('avg(CASE WHEN h > 0 THEN h END)')} AS hurst_exponent FROM h GROUP BY seg""",
    "cx_entropies": _entropies(),
    "cx_wavelet": _wavelet(),
    "cn_correlation": f"""WITH {_samples()}, z AS (SELECT seg, t, ch, (v - avg(v) OVER o) / stddev_pop(v) OVER o AS z FROM s WINDOW o AS (PARTITION BY seg, ch)),
  q AS (SELECT a.seg, a.ch AS i, b.ch AS j, avg(a.z * b.z) AS r FROM z a JOIN z b ON a.seg = b.seg AND a.t = b.t AND a.ch < b.ch GROUP BY 1, 2, 3)
SELECT seg, {_r('avg(r)')} AS mean_interchannel_correlation FROM q GROUP BY seg""",
    "cn_coherence": f"""WITH {_COHERENCE}
SELECT seg, {_r('avg(w)')} AS mean_alpha_coherence, {_r("avg(w) FILTER (a.side <> b.side AND a.side <> 'midline' AND b.side <> 'midline')")} AS interhemispheric_alpha_coherence
FROM edges JOIN el a ON a.ch = i JOIN el b ON b.ch = j GROUP BY seg""",
    "cn_power_topography": f"""WITH {_MAIN}, q AS (SELECT seg, corr(alpha, beta) AS r, avg(alpha) FILTER (side = 'left') AS l, avg(alpha) FILTER (side = 'right') AS g,
  avg(alpha) FILTER (area = 'frontal') AS f, avg(alpha) FILTER (area = 'occipital') AS o FROM w JOIN el USING (ch) GROUP BY seg)
SELECT seg, {_r('r')} AS alpha_beta_band_power_correlation, {_r('CASE WHEN l + g > 1e-10 THEN (g - l) / (g + l) ELSE 0 END')} AS hemispheric_alpha_asymmetry, {_r(_ratio('f', 'o'))} AS frontal_occipital_alpha_ratio FROM q""",
    "nw_threshold_graph": f"""WITH {_COHERENCE}, e AS (SELECT seg, round(w, 6) AS w FROM edges), cut AS (SELECT seg, quantile_cont(w, 0.7) AS cut FROM e GROUP BY seg)
SELECT seg, count(*) AS n_edges, {_r('avg(w)', 4)} AS mean_w FROM e JOIN cut USING (seg) WHERE w >= cut GROUP BY seg""",
    "nw_all": _NETWORK,
    "ms_gfp": f"WITH {_samples()}, g AS (SELECT seg, t, stddev_pop(v) AS gfp FROM s GROUP BY seg, t) SELECT seg, {_r('avg(gfp)')} AS mean_gfp, {_r('max(gfp)')} AS max_gfp, {_r('min(gfp)')} AS min_gfp FROM g GROUP BY seg",
    "ms_peaks": f"""WITH {_samples()}, g AS (SELECT seg, t, stddev_pop(v) AS gfp FROM s GROUP BY seg, t),
  p AS (SELECT *, lag(gfp) OVER o AS a, lead(gfp) OVER o AS b FROM g WINDOW o AS (PARTITION BY seg ORDER BY t))
SELECT seg, count(*) AS n_peaks, min(t) AS first_t, max(t) AS last_t, {_r('avg(gfp)')} AS mean_peak FROM p WHERE gfp > a AND gfp > b GROUP BY seg""",
    "ms_features_fixed": _MICRO,
    "custom_groups": f"""WITH {_samples()}, a AS (SELECT *, stddev_pop(v) OVER (PARTITION BY seg) AS all_sd, (v - avg(v) OVER o) / stddev_pop(v) OVER o AS z FROM s WINDOW o AS (PARTITION BY seg, ch))
SELECT seg, {_r('avg(CASE WHEN abs(v) > 2 * all_sd THEN 1.0 ELSE 0.0 END)')} AS share_above_2sd, {_r('avg(z * z * z)')} AS mean_skewness, {_r('avg(z * z * z * z) - 3')} AS mean_kurtosis FROM a GROUP BY seg""",
    "custom_gamma_share": f"WITH {_MAIN} SELECT seg, {_r('avg(gamma) / (avg(total) + 1e-10)')} AS gamma_over_total FROM w GROUP BY seg",
    "channel_health": f"""WITH {_samples()}, c AS (SELECT seg, ch, stddev_pop(v) AS sd, max(CAST(isnan(v) AS INT)) AS n, max(CAST(isinf(v) AS INT)) AS i FROM s GROUP BY seg, ch)
SELECT seg, CAST(count(*) FILTER (sd < 1e-8) AS BIGINT) AS n_flat, CAST(sum(n) AS BIGINT) AS n_nan, CAST(sum(i) AS BIGINT) AS n_inf, {_r('min(sd)')} AS min_sd, {_r('max(sd)')} AS max_sd FROM c GROUP BY seg""",
    "repair_missing": f"WITH {_samples()} {_TD}",
    "missing_report": f"""WITH {_TD_BASE} SELECT seg, concat_ws(',', CASE WHEN seg % 2 <> 0 THEN 'mean_rms' END, CASE WHEN seg % 3 = 0 THEN 'mean_channel_std' END) AS missing FROM td""",
    "compare_runs": f"WITH {_TD_BASE} SELECT 'mean_rms' AS feature, CAST(0.5 AS DOUBLE) AS max_diff, {_r('0.5 / count(*)')} AS mean_diff, false AS close FROM td UNION ALL SELECT 'mean_channel_std', 0.0, 0.0, true",
    "stream_windows": f"""SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS window_start, event_type AS channel, count(value) AS n, {_r('avg(abs(value))', 4)} AS mean_abs,
  {_r('stddev_pop(value)', 4)} AS std, {_r('max(value) - min(value)', 4)} AS peak_to_peak, {_r('sqrt(avg(value * value))', 4)} AS rms FROM events GROUP BY 1, 2""",
}

_WIDE_PARTS = (
    "td_amplitude td_zero_crossing td_hjorth fd_absolute fd_relative fd_peaks fd_entropy_centroid fd_ratios fd_aperiodic composite_scores de_bands de_dasm "
    "de_dcau de_faa cx_fractal cx_hurst cx_entropies cx_wavelet cn_correlation cn_coherence cn_power_topography nw_all"
).split()
ORACLE_SQL["wide_sql_row"] = "SELECT * FROM " + " JOIN ".join(f"({ORACLE_SQL[q]}) AS q{i}" + (" USING (seg)" if i else "") for i, q in enumerate(_WIDE_PARTS))


def _side_by_side(*queries: str) -> str:
    return "SELECT * FROM " + " JOIN ".join(f"({ORACLE_SQL[q]}) AS q{i}" + (" USING (seg)" if i else "") for i, q in enumerate(queries))


ORACLE_SQL |= {
    "td_native": _side_by_side("td_amplitude", "td_zero_crossing", "td_hjorth"),
    "cx_fractal_native": ORACLE_SQL["cx_fractal"],
    "spectrum_psd": ORACLE_SQL["psd_welch"],
    "spectrum_coverage": ORACLE_SQL["band_coverage"],
    "spectrum_features": _side_by_side("fd_absolute", "fd_relative", "fd_peaks", "fd_entropy_centroid", "fd_ratios", "fd_aperiodic", "composite_scores", "cn_power_topography"),
    "spectrum_entropy": _side_by_side("de_bands", "de_dasm", "de_dcau", "de_faa"),
    "spectrum_rasm": ORACLE_SQL["de_rasm"],
    "pairs_correlation": ORACLE_SQL["cn_correlation"],
    "pairs_coherence": ORACLE_SQL["cn_coherence"],
    "pairs_strongest": ORACLE_SQL["nw_threshold_graph"],
    "graph_measures": ORACLE_SQL["nw_all"],
    "entropy_range_join": ORACLE_SQL["cx_entropies"],
    "complexity_native": _side_by_side("cx_wavelet", "cx_hurst"),
    "spectrum_peaks": f"WITH {_spectrum()}, {_BANDS} SELECT seg, CAST(ch AS BIGINT) AS ch, band, {_r('arg_min(hz, row(-p, k))')} AS hz FROM p JOIN bands ON hz BETWEEN lo AND hi WHERE band NOT IN ('total', 'low', 'high') GROUP BY seg, ch, band",
    "states_features": _MICRO.replace("vec_id AS k,", "vec_id // 4 AS subject, vec_id % 4 AS k,").replace("vec_id < 4", "vec_id < 12").replace("SELECT k, ch, m - avg(m) OVER (PARTITION BY k)", "SELECT subject, k, ch, m - avg(m) OVER (PARTITION BY subject, k)").replace("FROM x JOIN mc USING (ch)", "FROM x JOIN mc ON mc.ch = x.ch AND subject = seg % 3"),
}
