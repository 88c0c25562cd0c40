"""Lists, factors and labels that results depend on literally."""

# --- crops whose marketable output is the grain yield ---------------------
GRAIN_CROPS = [
    "Corn_grain", "Spring_wheat", "Sweet_Corn", "Winter_wheat", "Alfalfa_Seed",
    "Barley_Spring", "Canola", "Oats", "Onion", "Triticale", "Yellow_Mustard",
]
# --- crops whose marketable output is the harvested biomass ---------------
HAY_CROPS = [
    "Alfalfa_Hay", "Barley_Hay", "Grass_Hay", "Sudangrass", "Triticale_Hay",
    "Oats_hay", "Rye", "Timothy",
]
# --- crops shown as their own display group -------------------------------
CORN_AND_ONION = ["Onion", "Corn_grain"]
CROP_GROUP_ORDER = ["Corn and onion", "Grain crops", "Hay crops"]
# --- crops left out of the valuation --------------------------------------
UNPRICED_CROPS = ["Alfalfa_Seed", "Rye"]

# --- selling units: crops per unit, and units per kilogram ----------------
BUSHEL_CROPS = ["Barley_Spring", "Corn_grain", "Oats", "Spring_wheat",
                "Winter_wheat", "Alfalfa_Seed", "Triticale"]
TON_CROPS = ["Alfalfa_Hay", "Grass_Hay", "Oats_hay", "Timothy", "Barley_Hay",
             "Sudangrass", "Triticale_Hay", "Rye"]
CWT_CROPS = ["Canola", "Yellow_Mustard", "Sweet_Corn", "Onion"]
KG_PER_BUSHEL = 25.40
TON_PER_KG = 0.001
CWT_PER_KG = 0.019

# --- unit conversions ------------------------------------------------------
HECTARE_PER_ACRE = 0.405
FT2_PER_ACRE = 43560
FT_PER_MM = 0.00328084
SECONDS_PER_DAY = 3600 * 24
WINDOW_DAYS = 15

# --- pause windows: scenario, first and last day of year, labels ----------
SCENARIO_WINDOWS = [
    ("Scenario01", 121, 135, "S1", "May H1"),
    ("Scenario02", 136, 150, "S2", "May H2"),
    ("Scenario03", 151, 164, "S3", "Jun H1"),
    ("Scenario04", 165, 179, "S4", "Jun H2"),
    ("Scenario05", 180, 194, "S5", "Jul H1"),
    ("Scenario06", 195, 209, "S6", "Jul H2"),
    ("Scenario07", 210, 224, "S7", "Aug H1"),
    ("Scenario08", 225, 239, "S8", "Aug H2"),
]
BASELINE = "optimal"
HARVEST_GRACE_DAYS = 5
BASIN_HARVEST_CUTOFF = 180
IRRIGATION_DAYS = (55, 241)
RULE_DAYS = (120, 240)
FLOW_DAYS = (121, 240)

# --- regions ---------------------------------------------------------------
STUDY_REGIONS = ["WallaWalla", "Okanogan", "Methow"]
OTHER_REGIONS = ["Yakima", "Naches", "Wenatchee"]
MERGED_REGIONS = {"Naches": "Yakima"}
BASIN_REGION = "Fifteenmile"

# --- gauging stations: long name, short name, code, number ----------------
STATIONS = [
    ("WENATCHEE RIVER AT MONITOR, WA", "Monitor", None, None),
    ("WENATCHEE RIVER AT PESHASTIN, WA", "Peshastin", None, None),
    ("METHOW RIVER AT TWISP, WA", "MR_Twisp", "METTW", "12449500"),
    ("METHOW RIVER NEAR PATEROS, WA", "Pateros", "METPA", "12449950"),
    ("TWISP RIVER NEAR TWISP, WA", "TRN_Twisp", "TWITW", "12448998"),
    ("OKANOGAN RIVER AT MALOTT, WA", "Malott", "OKAMA", "12447200"),
    ("OKANOGAN RIVER AT OROVILLE, WA", "Oroville", None, None),
    ("OKANOGAN RIVER NEAR TONASKET, WA", "Tonasket", "OKATO", "12445000"),
    ("SIMILKAMEEN RIVER NEAR NIGHTHAWK, WA", "Similkameen", "SIMNI", "12442500"),
    ("N.F. Touchet R. abv Dayton", "TR_Dayton", "NFTDA", "32E050"),
    ("Touchet R. at Bolles", "TR_Bolles", "TOUBO", "32B100"),
    ("Walla Walla R.  E. Detour Rd.", "WR_Detour_Rd", "WALDE", "32A100"),
]
STATION_CODE_ORDER = ["Monitor", "Peshastin", "Oroville", "WALDE", "TOUBO", "NFTDA",
                      "OKAMA", "OKATO", "SIMNI", "METPA", "METTW", "TWITW"]
# further orders that stations are shown in: by short name, and by code in the panels of ratios
STATION_NAME_ORDER = ["Monitor", "Peshastin", "MR_Twisp", "Pateros", "TRN_Twisp", "Malott", "Oroville",
                      "Tonasket", "Similkameen", "TR_Dayton", "TR_Bolles", "WR_Detour_Rd"]
STATION_RATIO_ORDER = ["Monitor", "Peshastin", "Oroville", "METPA", "OKAMA", "WALDE", "METTW", "OKATO",
                       "TOUBO", "TWITW", "SIMNI", "NFTDA"]
# stations whose contributing cells come from the first / second cell file
FIRST_CELL_FILE_STATIONS = ["WR_Detour_Rd", "TR_Dayton"]
SECOND_CELL_FILE_STATIONS = ["Malott", "Oroville", "Similkameen", "Tonasket",
                             "TRN_Twisp", "MR_Twisp", "Pateros", "TR_Bolles"]
# station number as spoiled by a spreadsheet, and the number it stands for
SPOILED_STATION_ID = ("3.20E+51", "32E050")

# --- crop display names, display order and the crops shown in the panels --
CROP_DISPLAY_NAMES = {
    "Oats_hay": "Oats_Hay",
    "Barley_Spring": "Barley_Grain",
    "Spring_wheat": "Spring Wheat",
    "Winter_wheat": "Winter Wheat",
    "Corn_grain": "Corn Grain",
    "Alfalfa_Hay": "Alfalfa Hay",
}
CROP_DISPLAY_ORDER = [
    "Grass_Hay", "Oats_Hay", "Timothy", "Barley_Hay", "Sudangrass", "Alfalfa Hay",
    "Triticale_Hay", "Rye", "Oats", "Canola", "Yellow_Mustard", "Spring Wheat",
    "Winter Wheat", "Triticale", "Sweet_Corn", "Barley_Grain", "Corn Grain",
    "Alfalfa_Seed", "Onion",
]
HIDDEN_CROPS = ["Timothy", "Rye", "Alfalfa_Seed"]
PANEL_CROPS = ["Alfalfa Hay", "Corn Grain", "Spring Wheat", "Onion"]
REDUCTION_RANGE = (0, 40)
MAX_COST_PER_ACRE = 1000

# --- minimum-flow rules -----------------------------------------------------
CLOSURE_WORD = "Closure"
REMARK_PATTERN = r" \s*\([^\)]+\)"
RULE_LEVELS = (0.75, 0.50)

# --- percent bins, in order: lower bound, upper bound, label ---------------
CLOSED_PERCENT_BINS = [(0, 25, "[0, 25]"), (25, 50, "(25, 50]"),
                       (50, 75, "(50, 75]"), (75, 100, "(75, 100)")]
OPEN_PERCENT_BINS = [(0, 25, "0 – 25"), (25, 50, "25 – 50"),
                     (50, 75, "50 – 75"), (75, 100, "75 – 100")]
FULL_PERCENT_LABEL = "100"
NO_PERCENT_LABEL = "0"

# --- example slices and the two-part barter of the single basin -------------
EXAMPLE_YEAR = 2015
EXAMPLE_SCENARIOS = ["Scenario02", "Scenario05", "Scenario08"]
EXAMPLE_STATIONS = ["Malott", "Pateros", "TR_Bolles"]
BARTER_PRICE_PER_ACFT = 17.87
BARTER_TARGET_ACFT = 115.74
BARTER_CUTOFF_ACFT = 131
# axis completeness rows of the cost matrix
COST_MATRIX_PLACEHOLDERS = [("OKATO", "May H2"), ("TWITW", "May H2")]
