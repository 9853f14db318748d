"""Fixed values the results depend on.

These must stay equal to the behaviour being reproduced; they are listed
here together, in natural order, so they are easy to check.
"""

# --- fixed values -----------------------------------------------------------

# Fuel model
FUEL_BURN_RATE_KG_PER_LAP = 1.88
FUEL_TIME_EFFECT_S_PER_KG = 0.035

# Lap cleaning
SLOW_LAP_S = 150.0
TRACK_STATUS_SAFETY_CAR = "4"
TRACK_STATUS_VIRTUAL_SAFETY_CAR = "6"
TRACK_STATUS_YELLOW = "2"

# Telemetry aggregation
MIN_SAMPLES_PER_LAP = 5
FULL_THROTTLE_PCT = 98
DRS_OPEN_MIN = 8          # per-lap telemetry: DRS >= 8 is open
API_DRS_OPEN_ABOVE = 0    # timing-API telemetry: DRS > 0 counts
LAST_LAP_SECONDS = 180    # last lap of a driver ends 3 minutes after it starts

# Compound codes used when scoring (a given code wins; unknown -> 2)
COMPOUND_MAP = {"HARD": 0, "INTERMEDIATE": 1, "MEDIUM": 2, "SOFT": 3, "WET": 4, "UNKNOWN": 2}
COMPOUND_DEFAULT_CODE = 2
UNKNOWN_COMPOUND = "UNKNOWN"
KEPT_EVENT_FORMATS = ["conventional", "sprint", "sprint_qualifying"]

# Temporal split
TRAIN_LAST_YEAR = 2024
EVAL_YEAR = 2025
VAL_CUTOFF_ROUND = 10

# Target encoding (smoothing 10, library default min_samples_leaf 20)
TE_SMOOTHING = 10.0
TE_MIN_SAMPLES_LEAF = 20

# Metrics
TIGHT_TOL = 0.3
LOOSE_TOL = 0.5
MIN_GAIN_PCT = 15.0
HUBER_DELTA = 1.0
HUBER_EPSILON = 1.35
HUBER_MAX_ITER = 300
HUBER_ALPHA = 0.9
RESIDUAL_BINS = 80

# Risk bands of a predicted delta (seconds)
RISK_NOMINAL_BELOW = 0.1
RISK_DEGRADING_BELOW = 0.3

# Scoring / exploring
CURVE_DEFAULT_LAPS = 30
CURVE_MAX_LAPS = 60
EXPLORE_DEFAULT_LIMIT = 2000
EXPLORE_MAX_LIMIT = 5000
IMPORTANCE_SAMPLE = 2000
IMPORTANCE_SEED = 42
SEQ_BATCH_SIZE = 32

TARGET = "lap_time_delta_fuel_corrected"

TELEMETRY_COLS = [
    "avg_throttle_pct",
    "full_throttle_pct",
    "avg_brake",
    "braking_pct",
    "max_speed_kph",
    "avg_speed_kph",
    "drs_active_pct",
    "avg_rpm",
]

LAP_COLS = [
    "Driver", "DriverNumber", "Team", "LapNumber", "LapTime", "Sector1Time", "Sector2Time",
    "Sector3Time", "Compound", "TyreLife", "Stint", "TrackStatus", "LapStartTime", "PitInTime",
    "PitOutTime", "SpeedI1", "SpeedI2", "SpeedFL", "SpeedST", "IsAccurate",
]

EXPLORER_COLS = [
    "stint_lap_number", "lap_time_delta_fuel_corrected", "Compound", "Driver", "Team", "EventName",
    "Year", "RoundNumber", "TrackTemp", "AirTemp", "TyreLife", "Stint",
]

MODEL_FEATURES = [
    "stint_lap_number", "Stint", "compound_encoded", "fuel_load_kg", "TrackTemp", "AirTemp",
    "avg_throttle_pct", "full_throttle_pct", "avg_brake", "braking_pct", "max_speed_kph",
    "drs_active_pct", "avg_rpm", "track_evolution", "deg_rate_last_3", "deg_acceleration",
    "sector_1_pct", "sector_2_pct", "sector_3_pct",
]

SEQUENCE_FEATURES = [
    "stint_lap_number", "compound_encoded", "fuel_load_kg", "TrackTemp", "AirTemp", "track_evolution",
    "avg_throttle_pct", "full_throttle_pct", "avg_brake", "braking_pct", "max_speed_kph",
    "drs_active_pct", "avg_rpm", "sector_1_pct", "sector_2_pct", "sector_3_pct",
]

BASELINE_FEATURES = ["stint_lap_number", "compound_encoded", "TrackTemp"]

# --- end of fixed values ----------------------------------------------------

RACE_KEYS = ["Year", "RoundNumber"]
STINT_KEYS = ["Year", "RoundNumber", "Driver", "Stint"]
LAP_JOIN_KEYS = ["Year", "RoundNumber", "DriverNumber", "LapNumber"]
