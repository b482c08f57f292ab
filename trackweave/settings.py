"""Fixed values and size limits used across the package."""

# They define the results and must not be tuned.
# Probability mass of the cell itself, of rings 1 to 3, and the unused tail.
RING_WEIGHTS = (0.37, 0.37, 0.15, 0.06, 0.05)
# An origin-destination trip ends at the last position within two hours.
OD_HORIZON_SECONDS = 2 * 60 * 60

# Size limits: they change the physical plan only, never the result.
# Lookup tables above this many rows are joined by a salted shuffle.
BROADCAST_ROWS = 1_000_000
# Links of a block, where pairs are spread over links that are too many to broadcast.
LINKS_PER_BLOCK = 20_000
# How many ways a salted join spreads one key.
SALTS = 16
# User-days with more rows than this are split by second before windowing.
HOT_USER_DAY_ROWS = 1_000_000
# Rows of a bucket of a stored trajectory, and the most buckets a table gets.
ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 50_000
# Steps of a sequence that one window handles; longer sequences are split.
STEPS_PER_BLOCK = 100_000
# Iterative jobs store a table after this many steps.
WALK_STEPS_PER_CHECKPOINT = 20
PROPAGATE_STEPS_PER_CHECKPOINT = 5
# Rows of the matrix that one task of an iterative job handles.
ROWS_PER_LOOP_TASK = 100_000
# Cells of a packed vector at most, 8 bytes each.
PACKED_CELLS = 8_000_000
# Entries of a packed matrix that one task and one of its rows have, and the values of
# vectors that the driver holds before they are stored.
ENTRIES_PER_PACKED_TASK = 4_000_000
ENTRIES_PER_PACKED_ROW = 50_000
PACKED_VALUES = 8_000_000
