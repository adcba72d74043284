"""Concept tables, word lists, thresholds and experiment settings.

Everything here is data that results depend on; no logic.  Operators take these
as defaults and accept replacements.
"""

# --- cohort rules -----------------------------------------------------------
MIN_AGE = 18
MIN_LOS_HOURS = 12.0

# --- site quality rules -----------------------------------------------------
MIN_STAYS_PER_SITE = 100
MIN_CREATININE_COVERAGE = 0.5
MIN_CULTURE_RATE = 0.2
SITE_HORIZON_MINUTES = 48 * 60
RATE_THRESHOLDS = [0.05, 0.1, 0.2, 0.3, 0.4]

# --- time rules -------------------------------------------------------------
MAX_HOURS = 96.0
PREDICTION_HOUR = 6.0
HORIZON_HOURS = 48.0
SUMMARY_HORIZONS = [24.0, 48.0, 72.0]
LAB_LOOKBACK_DAYS = 7
ACTION_LOOKBACK_HOURS = 24.0
ABX_THEN_CULTURE_HOURS = 24.0
CULTURE_THEN_ABX_HOURS = 72.0
DYSFUNCTION_BEFORE_HOURS = 48.0
DYSFUNCTION_AFTER_HOURS = 24.0
FIO2_TOLERANCE_HOURS = 4.0
ROOM_AIR_FIO2 = 0.21

# --- fixed values: concepts of the timestamp source --------------------------
LAB_CONCEPTS = {
    "creatinine": {"itemids": [50912, 52546], "valid": [0.1, 50]},
    "bilirubin_total": {"itemids": [50885, 53089], "valid": [0.1, 100]},
    "platelets": {"itemids": [51265, 53189], "valid": [1, 2000]},
    "pao2": {"itemids": [50821], "valid": [10, 800]},
    "lactate": {"itemids": [50813], "valid": [0.1, 40]},
    "wbc": {"itemids": [51301, 51755], "valid": [0.1, 200]},
    "bun": {"itemids": [51006], "valid": [1, 300]},
    "sodium": {"itemids": [50983, 52623], "valid": [90, 200]},
    "potassium": {"itemids": [50971, 52610], "valid": [1, 12]},
    "bicarbonate": {"itemids": [50882, 50803], "valid": [5, 60]},
    "hemoglobin": {"itemids": [51222, 50811], "valid": [2, 25]},
    "glucose": {"itemids": [50931, 50809], "valid": [10, 2000]},
}
CHART_CONCEPTS = {
    "heart_rate": {"itemids": [220045], "valid": [10, 300]},
    "sbp": {"itemids": [220050, 220179], "valid": [20, 300]},
    "dbp": {"itemids": [220051, 220180], "valid": [5, 200]},
    "map": {"itemids": [220052, 220181, 225312], "valid": [10, 250]},
    "resp_rate": {"itemids": [220210, 224690], "valid": [2, 80]},
    "temperature_c": {"itemids": [223762], "valid": [25, 45]},
    "temperature_f": {"itemids": [223761], "valid": [77, 113]},
    "spo2": {"itemids": [220277], "valid": [20, 100]},
    "fio2": {"itemids": [223835], "valid": [0.2, 100]},
    "weight_kg": {"itemids": [226512, 224639], "valid": [20, 400]},
    "weight_lbs": {"itemids": [226531], "valid": [44, 880]},
    "height_cm": {"itemids": [226730], "valid": [100, 250]},
}
GCS_PART_ITEMS = {"eye": 220739, "verbal": 223900, "motor": 223901}
VENTILATION_ITEMS = [220339, 224685, 224684, 224687, 224738, 223848, 224688, 223849, 229314]
URINE_ITEMS = [226559, 226560, 226561, 226584, 226563, 226564, 226565, 226567, 226557, 226558, 227489]
URINE_SUBTRACT_ITEMS = [227488]
URINE_VALID = [0, 5000]
INPUT_CONCEPTS = {
    "norepinephrine": [221906],
    "epinephrine": [221289, 229617],
    "dopamine": [221662],
    "dobutamine": [221653],
    "vasopressin": [222315],
    "phenylephrine": [221749, 229630, 229632],
}
SCORED_PRESSORS = ["norepinephrine", "epinephrine", "dopamine", "dobutamine"]
LB_TO_KG = 0.45359237
WEIGHT_VALID = [20, 400]
WEIGHT_WINDOW_HOURS = 48

SIGNALS = [
    ("proc_invasive_vent", "procedureevents", 225792),
    ("proc_noninvasive_vent", "procedureevents", 225794),
    ("proc_extubation", "procedureevents", 227194),
    ("chart_vent_mode", "chartevents", 223849),
    ("chart_vent_type", "chartevents", 223848),
    ("chart_o2_device", "chartevents", 226732),
    ("chart_peep_set", "chartevents", 220339),
    ("chart_tidal_vol_obs", "chartevents", 224685),
    ("chart_tidal_vol_set", "chartevents", 224684),
    ("chart_minute_vol", "chartevents", 224687),
    ("chart_insp_time", "chartevents", 224738),
    ("chart_fio2", "chartevents", 223835),
    ("chart_resp_rate_set", "chartevents", 224688),
]

# --- fixed values: cultures ---------------------------------------------------
SURVEILLANCE_PATTERNS = ["%SCREEN%", "%MRSA%", "%VRE%", "%SURVEILLANCE%"]
SURVEILLANCE_EXACT = ["STAPH AUREUS SWAB"]
STERILE_SITES = [
    "BLOOD CULTURE", "BLOOD CULTURE - NEONATE", "BLOOD CULTURE (POST-MORTEM)",
    "FLUID RECEIVED IN BLOOD CULTURE BOTTLES", "CSF;SPINAL FLUID", "PERITONEAL FLUID", "PLEURAL FLUID",
    "PERICARDIAL FLUID", "JOINT FLUID", "DIALYSIS FLUID", "BILE", "ABSCESS", "TISSUE", "BONE MARROW",
]
NEGATIVE_MARKERS = ["no growth", "negative", "not isolated", "none", "no organism"]

# --- fixed values: antibiotics -------------------------------------------------
SYSTEMIC_ROUTES = ["IV", "IV DRIP", "IVPCA", "IM", "IV BOLUS"]
EXCLUDED_ROUTES = [
    "OU", "OS", "OD", "AU", "AS", "AD", "IRR", "TP", "BOTH EYES", "LEFT EYE", "RIGHT EYE",
    "DESENSITIZATION", "EAR", "EYE",
]
ANTIBIOTIC_STEMS = [
    "adoxa", "ala-tet", "alodox", "amikacin", "amikin", "amoxicillin", "amphotericin", "ampicillin", "augmentin",
    "avelox", "avidoxy", "azactam", "azithromycin", "aztreonam", "bactocill", "bactrim", "bethkis", "biaxin",
    "bicillin", "cayston", "cefazolin", "cefepime", "cefotan", "cefotetan", "cefotaxime", "cefpodoxime", "cefoxitin",
    "ceftazidime", "ceftin", "ceftriaxone", "cefuroxime", "cephalexin", "chloramphenicol", "cipro", "ciprofloxacin",
    "claforan", "clarithromycin", "cleocin", "clindamycin", "cubicin", "dalvance", "daptomycin", "declomycin",
    "dicloxacillin", "dirithromycin", "doryx", "doxycycline", "duricef", "dynacin", "ery-tab", "eryped", "eryc",
    "erythrocin", "erythromycin", "factive", "flagyl", "fortaz", "furadantin", "garamycin", "gentamicin", "kanamycin",
    "keflex", "ketek", "levaquin", "levofloxacin", "lincocin", "linezolid", "macrobid", "macrodantin", "maxipime",
    "mefoxin", "meropenem", "methicillin", "metronidazole", "minocin", "minocycline", "monodox", "monurol",
    "morgidox", "moxatag", "moxifloxacin", "myrac", "nafcillin", "neomycin", "nicazel", "nitrofurantoin",
    "norfloxacin", "ocudox", "ofloxacin", "omnicef", "oracea", "oraxyl", "oxacillin", "pc pen vk", "penicillin",
    "periostat", "pfizerpen", "piperacillin", "primsol", "proquin", "raniclor", "rifadin", "rifampin", "rocephin",
    "smz-tmp", "septra", "solodyn", "spectracef", "streptomycin", "sulfadiazine", "sulfamethoxazole", "sulfatrim",
    "sulfisoxazole", "suprax", "synercid", "tazicef", "tetracycline", "timentin", "tinidazole", "tobi", "tobramycin",
    "trimethoprim", "unasyn", "vancocin", "vancomycin", "vantin", "vibativ", "vibra-tabs", "vibramycin", "zithromax",
    "zosyn", "zyvox",
]

# --- fixed values: order and diagnosis text -------------------------------------
CULTURE_ORDER_PATTERNS = ["%culture%", "%micro%", "%blood cx%"]
EXCLUSION_CODES = ["U071", "U07.1"]

# --- fixed values: concepts of the offset source ---------------------------------
OFFSET_LABS = {
    "creatinine": {"names": ["creatinine"], "valid": [0.1, 50]},
    "bilirubin_total": {"names": ["total bilirubin"], "valid": [0.1, 100]},
    "platelets": {"names": ["platelets x 1000"], "valid": [1, 2000]},
    "pao2": {"names": ["pao2"], "valid": [10, 800]},
    "lactate": {"names": ["lactate"], "valid": [0.1, 40]},
    "wbc": {"names": ["wbc x 1000"], "valid": [0.1, 200]},
    "bun": {"names": ["bun"], "valid": [1, 300]},
    "sodium": {"names": ["sodium"], "valid": [90, 200]},
    "potassium": {"names": ["potassium"], "valid": [1, 12]},
    "bicarbonate": {"names": ["bicarbonate", "hco3"], "valid": [5, 60]},
    "hemoglobin": {"names": ["hgb"], "valid": [2, 25]},
    "glucose": {"names": ["glucose"], "valid": [10, 2000]},
}
OFFSET_PERIODIC = {
    "heart_rate": {"column": "heartrate", "valid": [10, 300]},
    "sbp": {"column": "systemicsystolic", "valid": [20, 300]},
    "dbp": {"column": "systemicdiastolic", "valid": [5, 200]},
    "map": {"column": "systemicmean", "valid": [10, 250]},
    "resp_rate": {"column": "respiration", "valid": [2, 80]},
    "spo2": {"column": "sao2", "valid": [20, 100]},
    "temperature": {"column": "temperature", "valid": [25, 45]},
}
OFFSET_APERIODIC = {
    "sbp": {"column": "noninvasivesystolic", "valid": [20, 300]},
    "dbp": {"column": "noninvasivediastolic", "valid": [5, 200]},
    "map": {"column": "noninvasivemean", "valid": [10, 250]},
}
OFFSET_GCS = {"total": "GCS Total", "parts": ["Eyes", "Motor", "Verbal"], "valid": [3, 15]}
OFFSET_URINE = {"like": ["%urine%", "%foley%", "%void%"], "exclude": ["%irrigant%"], "valid": [0, 5000]}
OFFSET_INFUSIONS = [  # order matters: the first matching drug wins
    ("norepinephrine", ["%norepinephrine%", "%levophed%"]),
    ("epinephrine", ["%epinephrine%"]),
    ("dopamine", ["%dopamine%"]),
    ("dobutamine", ["%dobutamine%"]),
]
OFFSET_CULTURE = ["%cultures%"]
OFFSET_ANTIBIOTIC = ["%antibacterial%", "%antibiotic%"]
AGE_CEILING = "> 89"
AGE_CEILING_VALUE = 90
REGIONS = ["Midwest", "South", "West", "Northeast", "Unknown"]

# --- features ------------------------------------------------------------------
VITALS = ["heart_rate", "sbp", "dbp", "map", "resp_rate", "spo2", "temperature", "gcs_total"]
LABS = ["creatinine", "platelets", "bilirubin_total", "lactate", "wbc", "bun", "sodium", "potassium",
        "bicarbonate", "hemoglobin", "glucose", "pao2"]
DERIVED = ["urine_rate"]
AGGREGATIONS = ["min", "max", "mean", "first", "last"]
WINDOW_HOURS = 6
TEMPERATURE_VALID = [25, 45]

# --- models and inference --------------------------------------------------------
LABELS = ["aki_creatinine", "sofa_dysfunction", "aki_urine", "sepsis3"]
TUNED_LOGREG = {"C": 10.0, "max_iter": 2000, "class_weight": "balanced"}
TUNED_TREES = {"max_depth": 4, "learning_rate": 0.03, "n_estimators": 600, "subsample": 0.8}
#: (C, class weight) of the settings that are compared.
LOGREG_CONFIGS = [(0.01, None), (0.01, "balanced"), (0.1, None), (0.1, "balanced"), (1.0, None), (1.0, "balanced"), (10.0, None), (10.0, "balanced"),
                  (0.003, None), (30.0, None), (0.03, None), (3.0, None)]
N_SEEDS = 15
N_FOLDS = 5
N_BOOT = 2000
SESOI = 0.010
ALPHA = 0.05
MAX_UNDEFINED_SHARE = 0.05
DELTA_MIN_FACTOR = 2.443
PLAUSIBLE_AUROC = (0.6, 0.9)
LEARNING_FRACTIONS = [0.25, 0.5, 0.75, 1.0]
MIN_LEARNING_ROWS = 50
MIN_REGION_STAYS = 500
SEED_GRID = [5, 10, 15, 20]
