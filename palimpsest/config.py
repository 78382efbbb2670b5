"""Parameters of the engine. The defaults are the public ones a user of such a checker expects."""

from __future__ import annotations

from dataclasses import dataclass, field

PRIME = (1 << 61) - 1
SHINGLE_BASE = 257
TOKEN_BASE = 31


@dataclass(frozen=True)
class FingerprintConfig:
    k: int = 5
    w: int = 4
    n_perm: int = 128
    seed: int = 20240101
    threshold: float = 0.10
    min_shared: int = 2
    limit: int = 50
    normalize: bool = True  # False: tokens of the stored text, as the positions in a matches table count them

    @property
    def guaranteed_match_length(self) -> int:
        return self.k + self.w - 1


@dataclass(frozen=True)
class AlignConfig:
    min_words: int = 8
    max_gap: int = 12
    pad: int = 24
    match: float = 2.0
    mismatch: float = -1.0
    gap: float = -1.5


@dataclass(frozen=True)
class ScoringConfig:
    exclude_quotes: bool = True
    exclude_citations: bool = True
    exclude_bibliography: bool = True
    min_match_words: int = 8
    exclusion_ratio: float = 0.8
    allowlist: frozenset[str] = field(default_factory=frozenset)

    @property
    def kinds(self) -> list[str]:
        return [k for k, on in (("quote", self.exclude_quotes), ("citation", self.exclude_citations), ("bibliography", self.exclude_bibliography)) if on]


@dataclass(frozen=True)
class DetectorProfile:
    """A linear model over features, standardised, and a step calibration (none: the raw score counts)."""

    name: str | None
    bias: float
    weights: dict[str, tuple[float, float, float]]  # feature -> weight, mean, standard deviation
    breakpoints: tuple[float, ...] = ()
    values: tuple[float, ...] = ()

    @property
    def calibrated(self) -> bool:
        return bool(self.breakpoints)


LIKELIHOOD = ("mean_log_prob", "log_prob_std", "burstiness", "mean_log_rank", "curvature")
STYLE = ("sent_len_mean", "sent_len_cv", "type_token_ratio", "hapax_ratio", "function_word_ratio", "punct_entropy", "discourse_marker_rate")
FEATURES = LIKELIHOOD + STYLE

# The two published weight sets.
UNCALIBRATED = DetectorProfile(
    None, -0.35,
    {
        "mean_log_prob": (1.10, -3.10, 0.80), "log_prob_std": (-0.55, 2.40, 0.60), "burstiness": (-1.40, 0.55, 0.22),
        "mean_log_rank": (-0.90, 2.90, 0.70), "curvature": (1.25, 0.30, 0.45), "sent_len_cv": (-0.80, 0.52, 0.18),
        "type_token_ratio": (-0.45, 0.46, 0.09), "hapax_ratio": (-0.50, 0.33, 0.08), "function_word_ratio": (0.20, 0.42, 0.06),
        "punct_entropy": (-0.35, 2.10, 0.40), "discourse_marker_rate": (0.60, 0.012, 0.010),
    })
CALIBRATED = DetectorProfile(
    "hc3-style-v1", -0.20956,
    {
        "sent_len_mean": (0.53231, 22.833767, 11.252466), "sent_len_cv": (-0.476628, 0.459068, 0.202412),
        "type_token_ratio": (-0.552988, 0.627374, 0.098899), "hapax_ratio": (-0.342835, 0.452414, 0.121797),
        "function_word_ratio": (-0.042403, 0.472133, 0.055512), "punct_entropy": (-1.414988, 1.888929, 0.596965),
        "discourse_marker_rate": (0.299503, 0.002449, 0.005001),
    },
    (0.016951, 0.083116, 0.092362, 0.111049, 0.1152, 0.144535, 0.214769, 0.256052, 0.279542, 0.385707, 0.408655, 0.422646, 0.465908, 0.468712,
     0.601939, 0.630176, 0.706211, 0.712777, 0.76816, 0.772931, 0.800222, 0.815829, 0.872429, 0.944432, 0.949359, 0.998739, 0.999279),
    (0.0, 0.043478, 0.066667, 0.092105, 0.111111, 0.142857, 0.149701, 0.164557, 0.245902, 0.272727, 0.357143, 0.4, 0.482353, 0.5,
     0.550661, 0.657895, 0.675214, 0.714286, 0.792453, 0.833333, 0.836066, 0.866667, 0.904762, 0.921296, 0.923077, 0.932432, 1.0))
PROFILES = {"uncalibrated": UNCALIBRATED, "hc3-style-v1": CALIBRATED}

# Word lists of the style features.
FUNCTION_WORDS = frozenset(
    "a about all also although an and any are as at be because been being both but by can could did do does each few for from furthermore had has have he "
    "hence her here his how however i if in into is it its just may me might more moreover most must my no nor not of on only or other our own same she "
    "should since so some such than that the their them then there therefore these they this those though thus to unless us very was we were what when "
    "where whereas which while who whom whose why will with would you your".split())
DISCOURSE_MARKERS = frozenset(
    "additionally comprehensive consequently delve furthermore hence however importantly intricate leverage moreover multifaceted nevertheless "
    "nonetheless notably overall pivotal realm significantly specifically therefore thus ultimately underscore".split())
QUERY_STOPWORDS = frozenset(
    "a an and are as at be been but by can did do does for from had has have he her his how in into is it its may might must not of on or our she so such "
    "than that the their them then there these they this those to was we were what when where which who will with would you your".split())
ABBREVIATIONS = frozenset("al cf dr e.g ed eds eq etc fig i.e jr mr mrs ms no pp prof sr st vol vs".split())
SEGMENT_WORDS, MIN_SEGMENT_WORDS = 150, 40
EMBEDDING_DIM = 512
BANDS = ((0.20, "human"), (0.75, "unclear"), (0.90, "likely-ai"))
TOP_BAND = "very-likely-ai"
