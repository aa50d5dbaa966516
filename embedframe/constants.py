"""Values that must equal the reference's for results to agree.

Fixed values (kept together, in natural order; everything else in the package is derived
from these or is our own choice):
"""

# The similarity used when none is named.
DEFAULT_SIMILARITY = "cosine"

# Floor of the continuous Tanimoto denominator.
TANIMOTO_EPS = 1e-9

# CoSENT / Tanimoto-SENT scale (inverse temperature).
COSENT_SCALE = 20.0

# Self-adjusting dice loss defaults.
DICE_ALPHA = 1.0
DICE_GAMMA = 1.0
DICE_REDUCTION = "mean"

# Composite candidate score cut-offs (score, similarity).
SCORE_CUTOFF = 0.9
SIMILARITY_CUTOFF = 0.7

# Count simulation thresholds of hashed fingerprints (one bit each per bucket).
COUNT_THRESHOLDS = (1, 2, 4, 8)

# The mask written over a segment, from its length to its longest length.
MASK_TEMPLATE = "[*{%d-%d}]"

# Largest finite IEEE half-precision value.
HALF_MAX = 65504.0

# Learning-rate scaling of the trainer: lr·√B and decay 0.05·√(B / (S·B·E)).
WEIGHT_DECAY_FACTOR = 0.05

# File extension → reader format (anything else is read as Parquet).
EXTENSION_FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json"}
