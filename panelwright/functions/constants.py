"""Fixed values of the housing-panel domain.

Everything in this module is data, not logic: codes, names and ordered text
rules which must equal the published ones for results to match.
"""

from __future__ import annotations

import datetime as dt

# --- fixed values: heat, hot-water and gas order codes -------------------------
ORDER_CODES = ["577", "664", "666", "670", "742", "877", "964", "966", "970"]

# --- fixed values: borough codes -----------------------------------------------
BOROUGH_BY_ABBREVIATION = {"MN": 1, "BX": 2, "BK": 3, "QN": 4, "SI": 5}
BOROUGH_BY_NAME = {
    "MANHATTAN": 1,
    "BRONX": 2,
    "BROOKLYN": 3,
    "QUEENS": 4,
    "STATEN ISLAND": 5,
}

# --- fixed values: the five city counties and the state prefix -----------------
STATE_CODE = "36"
COUNTY_CODES = ["005", "047", "061", "081", "085"]

# --- fixed values: roll-out cohorts --------------------------------------------
COHORT_DATES = {
    1: dt.date(2017, 8, 11),
    2: dt.date(2017, 10, 1),
    3: dt.date(2018, 11, 1),
    4: dt.date(2019, 12, 1),
    5: dt.date(2021, 5, 11),
}
LAST_COHORT = 5
COHORT_LABELS = {
    1: "RTC Wave 1 [n = 10 ZIPs]",
    2: "RTC Wave 2 [n = 5 ZIPs]",
    3: "RTC Wave 3 [n = 5 ZIPs]",
    4: "RTC Wave 4 [n = 5 ZIPs]",
    5: "RTC Control [n = 155 ZIPs]",
}
COHORT_MONTH_LABELS = {
    1: "Aug. 2017",
    2: "Oct. 2017",
    3: "Nov. 2018",
    4: "Dec. 2019",
    5: "May 2021",
}

# --- fixed values: mistyped ZIP codes and their corrections --------------------
ZIP_RECODES = {"10129": "10128", "10435": "11435", "11452": "10452"}
ZIP_RECODES_WALKTHROUGH = {**ZIP_RECODES, "11249": "11211"}
FAULTY_ZIPS = ["2015", "2016", "112226", "111010"]
DROPPED_ZIPS = ["2016"]

# --- fixed values: building classes that are not rental stock ------------------
DROPPED_CLASSES = [
    "A0", "A3", "A6", "A7", "A8", "C6", "C8", "CM", "D0", "DC", "D4", "D5", "D9",
    "O1", "O2", "O3", "O4", "O5", "O6", "O7", "O9",
    "K1", "K2", "K3", "K5", "K6", "K7", "K8", "K9",
]
DROPPED_CLASS_PREFIXES = [
    "Z", "Y", "W", "V", "U", "T", "R", "Q", "N", "M", "L", "J", "I", "H", "G", "F", "E",
]
FLAGGED_CLASS_PREFIXES = ["A", "B"]
BUILT_BEFORE = 2013

# --- fixed values: census estimate codes and the names they get ----------------
ESTIMATE_NAMES = {
    "B25001_001": "tot_units",
    "B25002_003": "tot_vac_units",
    "B25032_001": "tot_occ_units",
    "B25032_013": "renter_occ_units",
    "B25008_003": "tot_pop_rou",
    "B25119_003": "med_hh_inc_rou",
    "B25037_003": "med_yr_blt_rou",
    "B25039_003": "med_yr_moved_in_rou",
    "B25064_001": "med_gross_rent",
    "B25071_001": "med_rent_burden",
    "B25013_011": "tot_college_degree_rou",
    "B25003H_003": "tot_wh_rou",
    "B25003B_003": "tot_bl_rou",
    "B25003D_003": "tot_asn_rou",
    "B25003I_003": "tot_ltx_rou",
    "B17017_001": "tot_hh",
    "B17017_002": "tot_hh_pov",
}
ESTIMATE_SHARES = {
    "pct_college_deg_rou": ("tot_college_degree_rou", "renter_occ_units"),
    "pct_wh_rou": ("tot_wh_rou", "renter_occ_units"),
    "pct_bl_rou": ("tot_bl_rou", "renter_occ_units"),
    "pct_asn_rou": ("tot_asn_rou", "renter_occ_units"),
    "pct_ltx_rou": ("tot_ltx_rou", "renter_occ_units"),
    "pct_rent": ("renter_occ_units", "tot_occ_units"),
    "pct_vac": ("tot_vac_units", "tot_occ_units"),
    "pct_pov": ("tot_hh_pov", "tot_hh"),
}
INFLATED_ESTIMATES = {
    "med_gross_rent_2020_adj": "med_gross_rent",
    "med_hh_inc_rou_2020_adj": "med_hh_inc_rou",
}
FILLED_ESTIMATES = ["med_hh_inc_rou", "med_hh_inc_rou_2020_adj", "med_yr_moved_in_rou"]
PRICE_YEAR = 2020
BASELINE_YEAR = 2017

# --- fixed values: address spelling rules, applied in this order ---------------
# (?=\s) and (?<=\s) are look-arounds on white space.
ADDRESS_RULES = [
    (r"HOR HARDING EXPRESSWAY SR NORTH", "HORACE HARDING EXPY"),
    (r"HOR HARDING EXPRESSWAY SR SOUTH", "HORACE HARDING EXPY"),
    (r"ST NICHOLAS PLACE", "SAINT NICHOLAS PL"),
    (r"(?<=\s)9 AVENUE", "9TH AVENUE"),
    (r"WEST 181 STREET", "W 181ST ST"),
    (r"FREDERICK DOUGAL", "FREDERICK DOUGLASS"),
    (r"MANH(?=\s)", "MANHATTAN"),
    (r"EAST 6(?=\s)", "EAST 6TH"),
    (r"EAST 12(?=\s)", "EAST 12TH"),
    (r"EAST 13(?=\s)", "EAST 13TH"),
    (r"EAST 14(?=\s)", "EAST 14TH"),
    (r"EAST 15(?=\s)", "EAST 15TH"),
    (r"EAST 31(?=\s)", "EAST 31ST"),
    (r"EAST 39(?=\s)", "EAST 39TH"),
    (r"EAST 57(?=\s)", "EAST 57TH"),
    (r"EAST 132(?=\s)", "EAST 132ND"),
    (r"EAST 174(?=\s)", "EAST 174TH"),
    (r"EAST 176(?=\s)", "EAST 176TH"),
    (r"EAST 187(?=\s)", "EAST 187TH"),
    (r"EAST 238(?=\s)", "EAST 238TH"),
    (r"MC BRIDE", "MCBRIDE"),
    (r"ADAM C POWELL BOULEVARD", "ADAM CLAYTON POWELL JR BLVD"),
    (r"ADAM C POWELL JR BOULEVARD", "ADAM CLAYTON POWELL JR BLVD"),
    (r"HUTCH RIVER", "HUTCHINSON RIVER"),
    (r"AVENUE", "AVE"),
    (r"STREET", "ST"),
    (r"PARKWAY", "PKWY"),
    (r"BOULEVARD", "BLVD"),
]

# --- fixed values: split-word repairs for eviction addresses -------------------
# The trailing blank of "AV " and "AVE " is kept; SPLIT_WORD_RULES_LEGACY swallows it.
SPLIT_WORD_RULES = [
    (r"STREE T|S TREET|STRE ET|ST REET|STR EET|STREE(?=\p{Punct})", "ST"),
    (r"A VENUE|AV ENUE|AVE NUE|AVEN UE|AVENU E|AV(?= )|AVE(?= )", "AVE"),
    (r"P ARKWAY|PA RKWAY|PAR KWAY|PARKW AY|PKWY", "PKWY"),
    (r"CONC OURSE", "CONCOURSE"),
]
SPLIT_WORD_RULES_LEGACY = [
    (r"STREE T|S TREET|STRE ET|ST REET|STR EET|STREE(?=\p{Punct})", "ST"),
    (r"A VENUE|AV ENUE|AVE NUE|AVEN UE|AVENU E|AV |AVE ", "AVE"),
    (r"P ARKWAY|PA RKWAY|PAR KWAY|PARKW AY|PKWY", "PKWY"),
    (r"CONC OURSE", "CONCOURSE"),
]
