"""Fixed values and small rules of the signal model: bands, electrodes, pairs, features, presets."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Frequency bands in Hz as (name, low, high).
BANDS = (
    ("delta", 0.5, 4.0),
    ("theta", 4.0, 8.0),
    ("alpha", 8.0, 12.0),
    ("beta", 12.0, 30.0),
    ("gamma", 30.0, 80.0),
    ("low_gamma", 30.0, 50.0),
    ("high_gamma", 50.0, 80.0),
)
TOTAL_BAND = (0.5, 100.0)

# The 62 and 90 electrode montages, in order.
MONTAGE_62 = (
    "FP1 FPZ FP2 AF3 AF4 F7 F5 F3 F1 FZ F2 F4 F6 F8 FT7 FC5 FC3 FC1 FCZ FC2 FC4 FC6 FT8 T7 C5 C3 C1 CZ C2 C4 C6 T8 "
    "TP7 CP5 CP3 CP1 CPZ CP2 CP4 CP6 TP8 P7 P5 P3 P1 PZ P2 P4 P6 P8 PO7 PO5 PO3 POZ PO4 PO6 PO8 CB1 O1 OZ O2 CB2"
).split()
MONTAGE_90 = (
    "FP1 FPZ FP2 AF9 AF7 AF5 AF3 AF1 AFZ AF2 AF4 AF6 AF8 AF10 T1 F9 F7 F5 F3 F1 FZ F2 F4 F6 F8 F10 T2 FT9 FT7 FC5 FC3 "
    "FC1 FCZ FC2 FC4 FC6 FT8 FT10 A1 T9 T7 C5 C3 C1 CZ C2 C4 C6 T8 T10 A2 TP9 TP7 CP5 CP3 CP1 CPZ CP2 CP4 CP6 TP8 TP10 "
    "P9 P7 P5 P3 P1 PZ P2 P4 P6 P8 P10 PO9 PO7 PO5 PO3 PO1 POZ PO2 PO4 PO6 PO8 PO10 O1 OZ O2 I1 IZ I2"
).split()

# Electrode pairs.
SYMMETRIC_PAIRS = (("FP1", "FP2"), ("F7", "F8"), ("F3", "F4"), ("T7", "T8"), ("P7", "P8"), ("C3", "C4"), ("P3", "P4"), ("O1", "O2"), ("AF3", "AF4"), ("FC5", "FC6"), ("FC1", "FC2"), ("CP5", "CP6"), ("CP1", "CP2"), ("PO3", "PO4"))
CAUDAL_PAIRS = (("FC5", "CP5"), ("FC1", "CP1"), ("FC2", "CP2"), ("FC6", "CP6"), ("F7", "P7"), ("F3", "P3"), ("FZ", "PZ"), ("F4", "P4"), ("F8", "P8"), ("FP1", "O1"), ("FP2", "O2"))
FAA_PAIRS = (("F3", "F4"), ("F7", "F8"), ("FP1", "FP2"), ("AF3", "AF4"))
PAIR_BANDS = ("delta", "theta", "alpha", "beta", "gamma")

# How name prefixes map to scalp regions; the first that fits counts.
REGIONS = (("CB", "occipital"), ("FP", "frontal"), ("AF", "frontal"), ("FT", "temporal"), ("FC", "central"), ("F", "frontal"), ("TP", "parietal"), ("T", "temporal"), ("CP", "parietal"), ("C", "central"), ("PO", "occipital"), ("P", "parietal"), ("O", "occipital"), ("I", "occipital"))
SIDED = {"A1": "left", "T1": "left", "T9": "left", "A2": "right", "T2": "right", "T10": "right"}

_BAND_NAMES = [b[0] for b in BANDS]
# Feature names by group, in order.
FEATURES: dict[str, tuple[str, ...]] = {
    "time_domain": ("mean_abs_amplitude", "mean_channel_std", "mean_peak_to_peak", "mean_rms", "mean_zero_crossing_rate", "hjorth_activity", "hjorth_mobility", "hjorth_complexity"),
    "frequency_domain": (
        *(f"{b}_power" for b in _BAND_NAMES),
        *(f"{b}_relative_power" for b in _BAND_NAMES),
        "peak_frequency", "spectral_entropy", "spectral_centroid", "individual_alpha_frequency", "theta_beta_ratio", "delta_theta_ratio", "low_high_power_ratio", "aperiodic_exponent", "mean_total_power",
    ),
    "complexity": ("wavelet_energy_entropy", "sample_entropy", "approx_entropy", "hurst_exponent", "higuchi_fd", "katz_fd", "petrosian_fd"),
    "connectivity": (
        "mean_interchannel_correlation", "mean_alpha_coherence", "interhemispheric_alpha_coherence", "alpha_beta_band_power_correlation", "hemispheric_alpha_asymmetry", "frontal_occipital_alpha_ratio",
        *(f"plv_{b}_mean" for b in ("theta", "alpha", "beta", "gamma")),
        *(f"plv_{b}_interhemispheric" for b in ("theta", "alpha")),
    ),
    "network": ("network_clustering_coefficient", "network_characteristic_path_length", "network_global_efficiency", "network_small_world_index"),
    "composite": ("theta_alpha_ratio", "frontal_beta_ratio", "cognitive_load_estimate", "alertness_estimate", "relaxation_index"),
    "de_features": (*(f"de_{b}" for b in _BAND_NAMES), *(f"{k}_{b}" for k in ("dasm", "rasm", "dcau") for b in PAIR_BANDS), "faa_f3f4", "faa_f7f8", "faa_fp1fp2", "faa_mean"),
    "microstate": tuple(f"Microstate_{k}_{m}" for k in range(4) for m in ("meandurs", "occurrence", "timecov", "mean_corr", "gev")),
}
GROUP_OF = {f: g for g, fs in FEATURES.items() for f in fs}

# Presets as (groups, included features, excluded features).
_SLOW = ("sample_entropy", "approx_entropy")
_NETWORK3 = ("network_clustering_coefficient", "network_characteristic_path_length", "network_global_efficiency")
_FRACTAL = ("wavelet_energy_entropy", " hurst_exponent", "higuchi_fd", "katz_fd", "petrosian_fd")
_PLV = ("plv_theta_mean", "plv_alpha_mean", "plv_beta_mean", "plv_gamma_mean")
PRESETS: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "fast": (("microstate",), (), ()),
    "s": (("time_domain", "frequency_domain", "composite", "de_features", "microstate"), (*_FRACTAL, *_NETWORK3, *_PLV), _SLOW),
    "full": (tuple(FEATURES), (), _SLOW),
    "basic": (("time_domain", "frequency_domain", "composite", "de_features", "connectivity", "microstate"), (*_FRACTAL, *_NETWORK3), _SLOW),
    "standard": (("time_domain", "frequency_domain", "composite", "de_features", "connectivity", "microstate"), (" hurst_exponent", *_NETWORK3), _SLOW),
    "emotion": (
        (),
        tuple(
            """mean_abs_amplitude mean_channel_std hjorth_activity hjorth_mobility hjorth_complexity delta_power theta_power
            alpha_power beta_power gamma_power alpha_relative_power beta_relative_power individual_alpha_frequency
            theta_beta_ratio hemispheric_alpha_asymmetry frontal_occipital_alpha_ratio alertness_estimate relaxation_index
            de_alpha de_beta de_gamma dasm_alpha dasm_beta faa_f3f4 faa_f7f8 faa_mean""".split()
        ),
        (),
    ),
    "sleep": (
        ("time_domain", "frequency_domain", "composite", "microstate"),
        ("alpha_beta_band_power_correlation", *_PLV, "de_delta", "de_theta", "de_alpha", "de_beta", "de_gamma", "de_low_gamma", "de_high_gamma"),
        (),
    ),
    "de_only": (("de_features",), (), ()),
}

META = ("trial_ids", "segment_ids", "session_id", "primary_label", "labels", "start_time", "end_time", "total_time_length", "merge_count", "source_segments")
#: Features that a stored row may lack without needing repair.
OPTIONAL = ("sample_entropy", "approx_entropy", "hurst_exponent", "network_small_world_index")


@dataclass(frozen=True)
class Config:
    """Parameters of a run."""

    fs: float = 200.0
    channels: tuple[str, ...] = tuple(MONTAGE_62)
    nperseg: int = 256
    noverlap: int | None = None
    nfft: int = 512
    m: int = 2
    r: float = 0.2
    wavelet_level: int = 5
    keep: float = 0.3
    normalize_entropy: bool = False
    #: Samples of a whole segment, where segments are cut from a recording by a fixed grid. One that ends early then keeps
    #: the frames, parts and counts of a whole one: what a frame lacks counts as the frame's mean, a wavelet reads zeros.
    whole: int | None = None


def hemisphere(name: str) -> str:
    n = name.upper()
    if n in SIDED:
        return SIDED[n]
    digits = re.search(r"(\d+)$", n)
    if n.endswith("Z") or not digits:
        return "midline"
    return "left" if int(digits[1]) % 2 else "right"


def region(name: str) -> str:
    n = name.upper()
    if n in ("A1", "A2"):
        return "reference"
    return next((r for p, r in REGIONS if n.startswith(p)), "central")
