"""These must equal the published definitions, so they are stated as they are."""

# ISO3 -> two-letter codes of the European countries.
ISO3_TO_ISO2 = {
    "ALB": "AL", "AUT": "AT", "BEL": "BE", "BGR": "BG", "BIH": "BA",
    "BLR": "BY", "CHE": "CH", "CYP": "CY", "CZE": "CZ", "DEU": "DE",
    "DNK": "DK", "ESP": "ES", "EST": "EE", "FIN": "FI", "FRA": "FR",
    "GBR": "GB", "GRC": "GR", "HRV": "HR", "HUN": "HU", "IRL": "IE",
    "ISL": "IS", "ITA": "IT", "LIE": "LI", "LTU": "LT", "LUX": "LU",
    "LVA": "LV", "MDA": "MD", "MKD": "MK", "MLT": "MT", "MNE": "ME",
    "NLD": "NL", "NOR": "NO", "POL": "PL", "PRT": "PT", "ROU": "RO",
    "SRB": "RS", "SVK": "SK", "SVN": "SI", "SWE": "SE", "TUR": "TR",
    "UKR": "UA", "XKX": "XK",
}

# English country names -> two-letter codes of the statistical office.
COUNTRY_NAME_TO_CODE = {
    "SPAIN": "ES", "FRANCE": "FR", "GERMANY": "DE", "ITALY": "IT", "PORTUGAL": "PT", "BELGIUM": "BE", "NETHERLANDS": "NL",
    "SWEDEN": "SE", "DENMARK": "DK", "FINLAND": "FI", "IRELAND": "IE", "POLAND": "PL", "AUSTRIA": "AT", "CZECH REPUBLIC": "CZ",
    "GREECE": "EL", "ROMANIA": "RO", "BULGARIA": "BG", "HUNGARY": "HU", "SLOVAKIA": "SK", "SLOVENIA": "SI", "LUXEMBOURG": "LU",
    "CYPRUS": "CY", "ESTONIA": "EE", "LATVIA": "LV", "LITHUANIA": "LT",
}

# Month -> multiplier that spreads an annual carbon price over the year.
CARBON_MONTH_INDEX = {
    1: 1.04, 2: 1.03, 3: 1.02, 4: 1.00, 5: 0.99, 6: 0.97,
    7: 0.96, 8: 0.96, 9: 0.98, 10: 1.00, 11: 1.02, 12: 1.03,
}
CARBON_MARKET_START = 2005

# Period codes of the national accounts feed -> quarter labels.
QUARTER_CODES = {"19": "T1", "20": "T2", "21": "T3", "22": "T4"}

# Countries whose market figures stand in for another country.
MARKET_PROXIES = {"BE": ["FR", "NL"]}

# Industries kept for the market panel.
TARGET_INDUSTRIES = ["Energy", "Utilities", "Utilities - Renewable", "Utilities - Diversified"]

# Phase names, score cuts and the reward of a phase.
DEGRADING, TURNING, RECOVERING = "DEGRADANDO", "TURNING", "RECUPERANDO"
SCORE_CUTS = [(75.0, "STRONG_BUY"), (55.0, "BUY"), (35.0, "HOLD")]
SCORE_FLOOR = "AVOID"
PHASE_REWARD = {TURNING: 20.0, RECOVERING: 15.0}

# Weights of the green index and of the composite score.
GREEN_WEIGHTS = (0.5, 0.3, 0.2)
SCORE_WEIGHTS = {"green": 60.0, "renewables": 20.0, "air": 10.0, "carbon": 10.0}
AIR_DEFAULT, AIR_WORST, CARBON_FULL = 15.0, 35.0, 100.0

# Ratio used between two light sensors when an entity has no overlap years.
SENSOR_FALLBACK_RATIO = 3.5

# Column candidates by which wide and long statistical files are recognised.
GEO_COLUMNS = ["geo_std", "geo", "location", "country", "loc", "ref_area", "cou"]
TIME_COLUMNS = ["time", "year", "time_period"]
VALUE_COLUMNS = ["value", "obs_value", "indicator_value", "val", "data"]

# Value rules of the statistical datasets, as allowed ranges, ends included, and those that must be above zero.
DATASET_RANGES = {
    "poverty_rate": (0.0, 100.0),
    "renewable_energy": (0.0, 100.0),
    "population_density": (0.0, None),
}
DATASETS_ABOVE_ZERO = ["household_size"]

# Surface reflectance scale and offset, and cloud bits of the quality band.
REFLECTANCE_SCALE, REFLECTANCE_OFFSET = 0.0000275, -0.2
CLOUD_BITS = [1, 3, 4]

# Open end of a validity range and start of a first load.
OPEN_END = "9999-12-31"
FIRST_LOAD = "2006-01-01"
