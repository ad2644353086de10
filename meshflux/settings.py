"""Default parameters. Results depend on them."""

from __future__ import annotations

SCORE_THRESHOLD = 500
DAMPING = 0.85
SEED = 42

NOISE_MAX_DEGREE = 4
NOISE_MAX_SCORE = 700
NOISE_RANK_PERCENTILE = 5

TIER_TOP = 99
TIER_STRATEGIC = 90
TIER_BRIDGE = 50

SWEEP_THRESHOLDS = (400, 500, 600, 700, 800, 900)
RESCUE_THRESHOLDS = (450, 400, 350, 300, 250, 200)

FORCED_DISTANCE_SCALE = 1.5
BLOCK_FRACTION = 0.001
EXTERNAL_RATIO_MIN = 0.30
BETWEENNESS_PERCENTILE = 60.0

DOSES = (0.90, 0.75, 0.50, 0.25, 0.10, 0.01)
DOSE_DAMPING = 0.50
HILL_EXPONENT = 2
NEIGHBOUR_BOOST = 0.10
NEIGHBOUR_SCORE_MIN = 200
NULL_ITERATIONS = 200
NULL_Z = 2.0

BONUS = 0.20
PENALTY = 0.30

PRESET_ITERATIONS = {"fast": 19, "standard": 99, "rigorous": 499}
SELECTION_TOP_N = 250
SELECTION_PERCENTILE = 99.0
FDR_ALPHA = 0.05
# Sources of global efficiency, nodes of local efficiency, for callers that sample.
GLOBAL_EFFICIENCY_SOURCES = 256
LOCAL_EFFICIENCY_NODES = 128

CHANNEL_PRIOR = 0.041
GATE = "G1"
GATE_EXPONENTS = (2.0, 2.0)
GATE_K = (0.6, 0.6)
GATE_LAMBDA = 0.05

COMPARE_TOP_N = 50
MEANINGFUL_PCT = 0.05
SENSITIVITY = 0.25
