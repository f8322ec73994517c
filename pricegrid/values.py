"""Fixed values that results depend on. Every operator takes them as parameters."""

# Study window, coverage share and year count of the panel build.
START_DATE = "2017-01-01"
END_DATE = "2026-08-12"
MIN_REAL_COVERAGE = 0.70
MIN_BALANCED_YEARS = 8

# Valid price window per crop, Rs per quintal; rows outside are dropped.
PRICE_CLIP = {
    "tomato": (10.0, 20000.0),
    "onion": (50.0, 12000.0),
    "potato": (40.0, 3500.0),
}

# Feature windows, in weeks.
HORIZONS = [1, 4, 13, 26]
PRICE_LAGS = [1, 2, 3, 4, 8, 13, 26, 52]
PRICE_WINDOWS = [4, 8, 13]
ARRIVAL_LAGS = [1, 2, 4]
ARRIVAL_WINDOWS = [4, 8]
BASE_YEAR = 2017

# Months of each crop's named seasons, in the order a label is chosen.
SEASON_MONTHS = {
    "tomato": {"peak_arrival": [11, 12, 1, 2], "lean": [5, 6, 7], "kharif": [8, 9, 10]},
    "onion": {"rabi_arrival": [2, 3, 4, 5], "lean": [9, 10, 11], "kharif": [8, 9]},
    "potato": {"harvest": [2, 3, 4], "storage": [5, 6, 7, 8, 9], "lean": [10, 11]},
}

# Coverage bands: label and inclusive lower bound of the share of weeks.
COVERAGE_BANDS = [
    ("Full (7yr+)", 0.871),
    ("Good (4.5-7yr)", 0.558),
    ("Moderate (2-4.5yr)", 0.248),
    ("Short (1-2yr)", 0.124),
    ("Thin (<1yr)", 0.0),
]
COVERAGE_BINS = [0, 10, 25, 50, 75, 90, 100]

# Rolling-origin folds: train end, validation start and end, test start and end.
FOLDS = [
    (1, "2021-06-30", "2021-07-01", "2021-12-31", "2022-01-01", "2022-12-31"),
    (2, "2022-06-30", "2022-07-01", "2022-12-31", "2023-01-01", "2023-12-31"),
    (3, "2023-06-30", "2023-07-01", "2023-12-31", "2024-01-01", "2024-12-31"),
    (4, "2024-06-30", "2024-07-01", "2024-12-31", "2025-01-01", "2025-12-31"),
    (5, "2025-06-30", "2025-07-01", "2025-12-31", "2026-01-01", "2026-12-31"),
]

# Production zones: crop, zone id, latitude, longitude, market, state.
ZONES = [
    ("tomato", "T1_Kolar", 13.1390, 78.1320, "Kolar APMC", "Karnataka"),
    ("tomato", "T2_Madanapalle", 13.5504, 78.5025, "Madanapalle APMC", "Andhra Pradesh"),
    ("tomato", "T3_Nashik_Tomato", 19.9975, 73.7898, "Nashik APMC", "Maharashtra"),
    ("tomato", "T4_Solan", 30.9045, 77.1167, "Solan APMC", "Himachal Pradesh"),
    ("tomato", "T5_Navsari", 20.9476, 72.9031, "Navsari APMC", "Gujarat"),
    ("onion", "O1_Lasalgaon", 20.4061, 74.0088, "Lasalgaon APMC", "Maharashtra"),
    ("onion", "O2_Pimpalgaon", 20.0833, 74.0167, "Pimpalgaon APMC", "Maharashtra"),
    ("onion", "O3_Mahuva", 21.0888, 71.7744, "Mahuva APMC", "Gujarat"),
    ("onion", "O6_Hubli", 15.3647, 75.1239, "Hubli APMC", "Karnataka"),
    ("onion", "O7_Solapur", 17.6854, 75.9064, "Solapur APMC", "Maharashtra"),
    ("onion", "O8_Manmad", 20.2500, 74.4367, "Manmad APMC", "Maharashtra"),
    ("onion", "O9_Kurnool", 15.8281, 78.0373, "Kurnool APMC", "Andhra Pradesh"),
    ("onion", "O10_Gondal", 21.9608, 70.7980, "Gondal APMC", "Gujarat"),
    ("potato", "P1_Darjeeling", 27.037755, 88.263176, "Darjeeling APMC", "West Bengal"),
    ("potato", "P2_DiamondHarbour", 22.192689, 88.189488, "Diamond Harbour(South 24-pgs) APMC", "West Bengal"),
    ("potato", "P3_Dehradun", 30.325565, 78.043681, "Dehradoon APMC", "Uttarakhand"),
    ("potato", "P4_Bardhaman", 23.2330, 87.8550, "Bardhaman APMC", "West Bengal"),
]
EARTH_RADIUS_KM = 6371.0

# States whose wage series is borrowed: state, source state, reason.
WAGE_PROXIES = [
    ("Telangana", "Andhra Pradesh", "parent-state proxy (split Jun-2014)"),
    ("Chattisgarh", "Madhya Pradesh", "parent-state proxy (split Nov-2000)"),
    ("Jharkhand", "Bihar", "parent-state proxy (split Nov-2000)"),
    ("Uttarakhand", "Uttar Pradesh", "parent-state proxy (split Nov-2000)"),
    ("Goa", "India", "no regional proxy - All-India fallback"),
    ("NCT of Delhi", "India", "no regional proxy - All-India fallback"),
    ("Chandigarh", "India", "no regional proxy - All-India fallback"),
    ("Andaman and Nicobar", "India", "no regional proxy - All-India fallback"),
    ("Arunachal Pradesh", "India", "no regional proxy - All-India fallback"),
    ("Mizoram", "India", "no regional proxy - All-India fallback"),
    ("Nagaland", "India", "no regional proxy - All-India fallback"),
    ("Keralam", "Kerala", "alternate spelling in panel"),
]
UNMAPPED_WAGE_NOTE = "UNMAPPED - add explicit proxy if this state has real market coverage"

# Spellings of states in the storage, road and wage sources -> panel spelling.
STATE_SPELLINGS = {
    "Andaman and Nicobar Islands": "Andaman and Nicobar",
    "Andaman & Nicobar Islands": "Andaman and Nicobar",
    "Chhattisgarh": "Chattisgarh",
    "Delhi": "NCT of Delhi",
    "Jammu & Kashmir": "Jammu and Kashmir",
    "Uttrakhand": "Uttarakhand",
}

# Export duty steps from 40 to 20 percent on this date; scheme start date.
DUTY_INITIAL_PCT = 40.0
DUTY_REDUCED_PCT = 20.0
DUTY_REDUCTION_DATE = "2024-09-14"
OPERATION_GREENS_START = "2018-11-05"
POLICY_PANEL_END = "2026-12-31"
MONOTONE_DOWN_LEVERS = ["export_banned", "export_duty_pct", "mep_usd_per_tonne"]

# Early-warning episodes: name, crop, first action date.
EPISODES = [
    ("onion_2019", "onion", "2019-09-29"),
    ("onion_2020", "onion", "2020-09-14"),
    ("onion_2023", "onion", "2023-08-19"),
    ("tomato_2023", "tomato", "2023-07-20"),
    ("tomato_2024", "tomato", "2024-07-29"),
    ("tomato_2025", "tomato", "2025-08-04"),
    ("potato_2014", "potato", "2014-06-26"),
    ("potato_2016", "potato", "2016-07-26"),
]
EPISODE_LOOKBACK_WEEKS = 20
EPISODE_DEVIATION = 0.15

# Quality-check limits.
TAIL_IMPUTED_FAIL_PCT = 95.0
TAIL_IMPUTED_WARN_PCT = 50.0
FRESHNESS_WARN_DAYS = 60
REFERENCE_GAP_FAIL_DAYS = 7
STALE_REFERENCE_WEEKS = 3

# Satellite scene classes that count as clear ground.
CLEAR_SCENE_CLASSES = [4, 5, 6, 7, 11]

# MacKinnon (1994) response surface, constant-only Dickey-Fuller, one series.
ADF_TAU_MAX = 2.74
ADF_TAU_MIN = -18.83
ADF_TAU_STAR = -1.61
ADF_SMALL_P = [2.1659, 1.4412, 0.038269]
ADF_LARGE_P = [1.7339, 0.93202, -0.12745, -0.010368]
