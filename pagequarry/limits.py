"""Fixed values of the data model, stated as plain values because results depend on them."""

# Catalogue limits.
MAX_SHOTS_PER_PAGE = 25
MAX_PAGES_PER_ALBUM = 500

# Page states. A page is pending while it has shots and is in one of PENDING_STATES.
PENDING_STATES = ("changed", "ready", "processing")

# Stream timing.
IDLE_SECONDS = 10
#: Streams: how far out of order operations may come, and how much later they are still reported.
WAIT_SECONDS = 600
LATE_SECONDS = 86_400
TOKEN_TOUCH_SECONDS = 60

# Grids: the long side never exceeds this many cells.
GRID_MAX_SIDE = 1000

# Warning codes that mark a page, and those that ask for another shot.
AREA_CODES = ("glare", "incomplete_coverage", "single_coverage")
ANOTHER_SHOT_CODES = ("single_coverage", "glare")

# Region finding.
RESIDUAL_THRESHOLD = 0.5
MIN_REGION_AREA = 0.0005
MIN_SINGLE_AREA = 0.01
GLARE_SEEN = 0.02

# Fusion.
GLARE_TAU = 0.03
GLARE_FLAG = 0.08
GLARE_FLOOR = 0.02
FEATHER_FRAC = 0.04
SHARPNESS = 2.0
HALO_PX = 5
SMOOTH_FRAC = 0.008

# Single-photo glare score: logistic weights and hysteresis thresholds.
GLARE_BIAS = -4.13
GLARE_WEIGHTS = {"veil": 7.5, "desat": 1.0, "flat": 0.0, "clip": 2.32}
GLARE_SEED = 0.7
GLARE_WEAK = 0.3
BACKGROUND_FRAC = 0.06

# Comparison shadow.
SHADOW_MIN_DEPTH = 0.12
SHADOW_DEPTH_RAMP = 0.10
SHADOW_B_TOL = 0.12
SHADOW_CHROMA_TOL = 0.15
SHADOW_MIN_CORRELATION = 0.6
SHADOW_DARK_LEVEL = 0.08
SHADOW_SEED = 0.7
SHADOW_WEAK = 0.3
SHADOW_MIN_AREA = 0.002

# Replays.
PROMPTS = 2
MIN_COVER = 0.5
NO_GLARE = 0.001
SAME_PAGE_MIN_OVERLAP = 0.3
SAME_PAGE_MAX_SCALE = 1.5
GATE_REMOVED = 0.8
GATE_UNWARNED = 0.1
