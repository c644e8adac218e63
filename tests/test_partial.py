"""Tables whose segments end early: every spectral and complexity query equals its SQL there too."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from test_contract import tidy
from tideline.plans import catalogue, oracle

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: Samples of segments 0 to 4: a second frame has some, as coherences of a single frame are all 1 but for rounding.
SIZES = (100, 82, 56, 40, 36)
NAMES = """band_coverage complexity_native cx_hurst cx_wavelet fd_aperiodic fd_entropy_centroid fd_peaks psd_welch spectrum_coverage spectrum_peaks spectrum_psd
fd_absolute fd_relative fd_ratios composite_scores de_bands de_dasm de_faa cx_fractal cx_fractal_native cx_entropies entropy_range_join cn_coherence
cn_power_topography nw_all nw_threshold_graph pairs_coherence pairs_strongest graph_measures spectrum_features spectrum_entropy wide_sql_row""".split()


@pytest.fixture(scope="module")
def partial(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("partial"))
    size = F.element_at(F.array(*[F.lit(n) for n in SIZES]), F.expr("CAST(vec_id div 100 AS INT) + 1"))
    spark.read.parquet(f"{SF}/embeddings.parquet").where(f"vec_id < {100 * len(SIZES)}").where(F.col("vec_id") % 100 < size).write.parquet(f"{at}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet/*.parquet'")
    return at, con


@pytest.mark.parametrize("name", NAMES)
def test_segments_that_end_early_equal_sql(spark, partial, name):
    at, con = partial
    got, want = catalogue.QUERIES[name](spark, at).toPandas(), con.execute(oracle.ORACLE_SQL[name]).df()
    assert len(got) and tidy(got.to_dict("records")) == tidy(want[list(got.columns)].to_dict("records"))


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """Segments of one and of three samples, one of zeros, one of four, a whole one."""
    at = str(tmp_path_factory.mktemp("tiny"))
    size = F.element_at(F.array(*[F.lit(n) for n in (1, 3, 100, 4, 100)]), F.expr("CAST(vec_id div 100 AS INT) + 1"))
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").where(F.col("vec_id") % 100 < size)
    rows.withColumn("embedding", F.when(F.expr("vec_id div 100 = 2"), F.transform("embedding", lambda v: v * 0)).otherwise(F.col("embedding"))).write.parquet(f"{at}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet/*.parquet'")
    return at, con


@pytest.mark.parametrize("name", "complexity_native cx_hurst cx_wavelet fd_aperiodic fd_entropy_centroid psd_welch spectrum_coverage".split())
def test_segments_of_a_few_samples_or_of_zeros_equal_sql(spark, tiny, name):
    at, con = tiny
    got, want = catalogue.QUERIES[name](spark, at).toPandas(), con.execute(oracle.ORACLE_SQL[name]).df()
    assert len(got) and tidy(got.to_dict("records")) == tidy(want[list(got.columns)].to_dict("records"))


def test_segments_that_are_no_full_matrix_keep_their_rows(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 200")
    rows.withColumn("embedding", F.when(F.col("vec_id") == 7, F.transform("embedding", lambda v: v * float("nan"))).otherwise(F.col("embedding"))).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("complexity_native", "cx_hurst", "cx_wavelet", "fd_aperiodic"):
        assert sorted(r["seg"] for r in catalogue.QUERIES[name](spark, str(tmp_path)).select("seg").collect()) == [0, 1], name


def test_short_parts_and_short_series(spark):
    """Hurst's exponent of a series within one part is missing, not a rounding error above 0; powers that don't vary have correlation 0."""
    from tideline.model import Config
    from tideline.operators import complexity, spectrum

    config = Config(channels=("F3", "F4"), nperseg=64, noverlap=32, whole=100)
    rows = spark.createDataFrame([(0, [[float(v * v % 7) for v in range(11)]] * 2), (1, [[1.0] * 100] * 2)], "seg long, eeg array<array<double>>")
    assert all(r["hurst_exponent"] is None for r in complexity.features(rows, config, ("hurst_exponent",)).collect())
    flat = {r["seg"]: r for r in spectrum.frequency_features(rows, config).collect()}[1]
    assert flat["alpha_beta_band_power_correlation"] == 0.0 and flat["mean_total_power"] == pytest.approx(0.0)


def test_a_round_of_means_compares_each_map_once(spark, monkeypatch):
    """One comparison of maps with centres and one written table a round."""
    from tideline.operators import states

    compared, tables = [], []
    nearest, written = states.nearest, states.written
    monkeypatch.setattr(states, "nearest", lambda *a: compared.append(1) or nearest(*a))
    monkeypatch.setattr(states, "written", lambda df, label: tables.append(label) or written(df, label))
    rows = spark.createDataFrame([(s, [[float((s + 3 * c + t * (c + 2)) % 11) for t in range(30)] for c in range(5)]) for s in range(3)], "seg long, eeg array<array<double>>")
    assert states.fit_template(rows, rounds=6).count() == states.STATES
    assert 1 <= len(compared) == tables.count("centres") - 1


def test_locking_joins_a_sample_with_one_row_for_all_bands(spark):
    from tideline.model import Config
    from tideline.operators import pairs

    table, names = pairs.analytic_table(spark, 40, Config().fs, pairs.LOCKING)
    assert names == [b for b, _, _ in pairs.LOCKING] and table.count() == 40 * 40
