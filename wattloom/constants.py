"""Fixed values.

Everything in this module is a value that results depend on: column names and their order,
lookup tables, rule bounds, published thresholds. No logic lives here.
"""

TARGET = "HouseConsumption_kWh"

# Ordered feature lists; a model's input vector follows one of them.
FEATURE_SPECS = {
    "v12": [
        "total_appliance_power",
        "appliance_count",
        "avg_power_per_appliance",
        "MonthlyHours",
        "TariffRate",
        "consumption_per_hour",
        "SolarGeneration_kWh",
        "GridConsumption_kWh",
        "EnergySold_kWh",
        "Month_num",
        "City_code",
        "Company_code",
    ],
    "v16": [
        "Fan",
        "Refrigerator",
        "AirConditioner",
        "Television",
        "Monitor",
        "MotorPump",
        "MonthlyHours",
        "SolarGeneration_kWh",
        "GridConsumption_kWh",
        "EnergySold_kWh",
        "TariffRate",
        "NetBill",
        "City_City_A",
        "City_City_B",
        "City_City_C",
        "City_City_D",
    ],
}

# Watts of one appliance of each kind.
DEFAULT_WATTS = {
    "Fan": 70.0,
    "Refrigerator": 150.0,
    "AirConditioner": 1200.0,
    "Television": 100.0,
    "Monitor": 30.0,
    "MotorPump": 500.0,
}

CITY_LETTERS = {1: "A", 2: "B", 3: "C", 4: "D"}
DEFAULT_CITY_LETTER = "A"

# field: (required, smallest value, largest plausible value)
FIELD_RULES = {
    "MonthlyHours": (True, 0.0, 744.0),
    "TariffRate": (True, 0.0, 200.0),
    "SolarGeneration_kWh": (False, 0.0, 10000.0),
    "GridConsumption_kWh": (False, 0.0, 20000.0),
    "EnergySold_kWh": (False, 0.0, 20000.0),
    "NetBill": (False, 0.0, 1e7),
    "Fan": (False, 0.0, 100.0),
    "Refrigerator": (False, 0.0, 50.0),
    "AirConditioner": (False, 0.0, 20.0),
    "Television": (False, 0.0, 20.0),
    "Monitor": (False, 0.0, 20.0),
    "MotorPump": (False, 0.0, 10.0),
}

# A feature that may also arrive under another name.
FEATURE_ALIASES = {"total_appliance_power": "TotalAppliancePower"}

# Names under which a record may carry its appliance -> usage map, in order of preference.
USAGE_MAP_NAMES = ["appliance_usage", "appliances", "breakdown", "appliance_breakdown"]

# Names under which a record may carry its kWh value, in order of preference.
KWH_NAMES = [
    "predicted_value_kwh",
    "predicted_kwh",
    "total_consumption_kwh",
    "estimated_kwh",
]

# Published thresholds of the original training data.
PUBLISHED_THRESHOLDS = {
    "grid_p95": 228.94788187403282,
    "grid_p99": 336.0150755333202,
    "monthly_min": 240.44,
    "monthly_max": 789.0,
    "total_power_p99": 76.0,
}

# model key: (directory of the stored model, label)
MODEL_REGISTRY = {
    "linear": ("linear_regression", "Linear Regression"),
    "rf": ("random_forest", "Random Forest"),
    "gbt": ("gradient_boosted_trees", "Gradient-Boosted Trees"),
}

UNIT_TO_KWH = {"Wh": 0.001, "kWh": 1.0, "MWh": 1000.0}
STANDBY_APPLIANCES = ["Television", "TV", "Router", "Chargers"]

DAYS_PER_MONTH = 30
HOURS_WITH_AC = 300.0
HOURS_WITHOUT_AC = 240.0
SOLAR_EFFICIENCY = 0.75
SOLAR_PANEL_WATT = 400.0
BAND_GREEN_UP_TO = 100.0
BAND_RED_ABOVE = 500.0
NOISE_SIGMA = 5.0
SEED = 42
TEST_FRACTION = 0.30
FOREST_TREES = 200
BOOST_ROUNDS = 300
BOOST_RATE = 0.05
HISTORY_DEFAULT = 50
HISTORY_MAX = 1000
RECENT_PER_HOUSE = 30
TOP_FEATURES = 20
