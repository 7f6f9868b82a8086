"""Thresholds of the operators; each is a default of a function's argument."""

EPSILON = 1e-9
# Seconds and decibels that define the semantics.
LEVEL_STEP = 0.01
FLOOR_DB = -120.0
SILENCE_DB = -50.0
MIN_SILENCE = 0.30
PAUSE_MARGIN = 0.08
MIN_ISLAND = 0.12
MIN_EDGE_ISLAND = 0.20
EDGE_LOOK = 0.08
EDGE_WINDOW = 0.60
EDGE_SILENCE = 0.10
WORD_MARGIN = 0.02
WORD_PAD = 0.15
WORD_SHIFT = 1.0
WORD_ONSET = 0.5
TOLERANCE_RATIO, TOLERANCE_FLOOR = 0.05, 10.0
SHORT_CUT, SHORT_VISUAL = 3.0, 4.0
PAUSE_SHARE, QUIET_MARGIN = 0.45, 3.0
FAST_SPEED, LOW_TARGET = 1.5, 0.05
MAX_SPANS = 40
SWEEP_BLOCK, SWEEP_BUDGET, SHEET_VIEWS = 600.0, 600, 25
IMAGE_OK, IMAGE_FAIL = 0.08, 0.15
ENVELOPE_OK, ENVELOPE_FAIL, ENVELOPE_LAG, ENVELOPE_SPREAD, ENVELOPE_CORRELATION = 4.0, 8.0, 4, 6.0, 0.9
COVERAGE_SLACK, LOW_MEAN, LOW_CUT = 0.02, 0.9, 0.85
BLOCKING = ("esenciales_superan_objetivo", "dependencia_excluida", "tema_sin_cubrir", "corte_vacio")
