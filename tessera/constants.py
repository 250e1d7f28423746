"""Fixed values of the engine's rules."""

# Scores
BASE_SCORE = 50.0
LOWEST, HIGHEST = 0.0, 100.0
SWIPE_STEPS = {"right": 10.0, "left": -10.0, "up": 5.0, "down": 0.0}
ARENA_K = 8.0
ARENA_DIVISOR = 40.0
CLOSE_MATCH = 5.0

# Grouping
JACCARD_THRESHOLD = 0.3
VISUAL_THRESHOLD = 0.75
SEMANTIC_THRESHOLD = 0.7
UNKNOWN = "(unknown)"
LEVEL_COLUMNS = {0: "group_key_l0", 1: "group_key_l1", 2: "group_key_l2", 3: "group_key_l3"}
DIMENSIONS = ("base_model", "diffusion_model", "text_encoder", "controlnet", "lora", "embedding")

# Recommendation
CONFIDENCE_PRIOR = 5.0
EXAMPLES = 4
PAGE_CAP = 100

# Ingest
STABILITY_SECONDS = 10
TEMPLATE_SECONDS = 60
TEMPLATE_DEPTH = 5
POLL_SECONDS = 8
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp")
PAYLOAD_BYTES = 16 * 1024

# Models whose vectors may be compared: (slot, model) by mode
SLOTS = {"visual": ("vision", "clip-vit-b32-q"), "semantic": ("text", "bge-small-zh-q")}
TOKEN_CAP = 512
BATCH = 8
CROP = 224


def level_column(level: int) -> str:
    """Key column of a level; every level but 0, 1 and 2 is the individual prompt."""
    return LEVEL_COLUMNS.get(level, "group_key_l3")
