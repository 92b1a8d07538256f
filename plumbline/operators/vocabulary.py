"""Clinical names, ranges, weights and texts.

Everything in this file must equal the published behaviour for results to
agree; it is data, not logic. All tables can be replaced by arguments of the
operators that use them.
"""

# Concept → header aliases used when profiling a table.
HEADER_ALIASES = {
    "hemoglobin": ["hgb", "hb", "haemoglobin", "hemoglobin_value", "hem"],
    "wbc": ["white_blood_cell", "leukocytes", "wbc_count"],
    "platelets": ["plt", "platelet_count", "thrombocytes"],
    "sodium": ["na", "na+", "serum_sodium"],
    "potassium": ["k", "k+", "serum_potassium"],
    "creatinine": ["cr", "crea", "serum_creatinine", "creat"],
    "glucose": ["gluc", "blood_glucose", "fasting_glucose"],
    "alt": ["sgpt", "alanine_aminotransferase"],
    "ast": ["sgot", "aspartate_aminotransferase"],
    "bilirubin": ["bili", "total_bilirubin", "tbili"],
    "systolic_bp": ["sbp", "systolic", "sys_bp", "bp_systolic"],
    "diastolic_bp": ["dbp", "diastolic", "dia_bp", "bp_diastolic"],
    "heart_rate": ["hr", "pulse", "pulse_rate"],
    "temperature": ["temp", "temp_c", "temp_f", "body_temp"],
    "weight": ["wt", "body_weight", "weight_kg"],
    "subject_id": ["subject", "subj_id", "patient_id", "patientid", "subject_no", "pt_id", "participant_id"],
    "timepoint": ["visit", "visit_no", "timepoint", "week", "day", "study_day"],
}

# Concept → header aliases used by the rule checks.
RULE_ALIASES = {
    "hemoglobin": ["hemoglobin", "hgb", "hb", "haemoglobin"],
    "wbc": ["wbc", "white blood cells", "leukocytes", "wbc_count"],
    "platelets": ["platelets", "plt", "platelet count", "thrombocytes"],
    "sodium": ["sodium", "na", "na+"],
    "potassium": ["potassium", "k", "k+"],
    "creatinine": ["creatinine", "cr", "crea"],
    "glucose": ["glucose", "gluc", "blood sugar"],
    "alt": ["alt", "sgpt", "alanine aminotransferase"],
    "ast": ["ast", "sgot", "aspartate aminotransferase"],
    "bilirubin": ["bilirubin", "bili", "total bilirubin"],
    "systolic_bp": ["systolic", "sbp", "systolic bp", "systolic blood pressure"],
    "diastolic_bp": ["diastolic", "dbp", "diastolic bp", "diastolic blood pressure"],
    "heart_rate": ["heart rate", "hr", "pulse", "pulse rate"],
    "temperature": ["temperature", "temp", "body temperature"],
    "weight": ["weight", "wt", "weight kg"],
    "bmi": ["bmi", "body mass index"],
    "dose": ["dose", "dosage", "amount"],
}

# Concept → (min, max, unit, critical low, critical high).
CLINICAL_RANGES = {
    "hemoglobin": (7.0, 20.0, "g/dL", 5.0, 22.0),
    "wbc": (1.0, 100.0, "10^3/uL", 0.5, 150.0),
    "platelets": (10.0, 1500.0, "10^3/uL", 5.0, 2000.0),
    "sodium": (110.0, 170.0, "mEq/L", 100.0, 180.0),
    "potassium": (2.0, 8.0, "mEq/L", 1.5, 9.0),
    "creatinine": (0.1, 20.0, "mg/dL", 0.0, 30.0),
    "glucose": (20.0, 800.0, "mg/dL", 10.0, 1000.0),
    "alt": (0.0, 5000.0, "U/L", None, None),
    "ast": (0.0, 5000.0, "U/L", None, None),
    "bilirubin": (0.0, 50.0, "mg/dL", None, None),
    "systolic_bp": (50.0, 250.0, "mmHg", 40.0, 300.0),
    "diastolic_bp": (20.0, 150.0, "mmHg", None, None),
    "heart_rate": (20.0, 250.0, "bpm", 10.0, 300.0),
    "temperature": (32.0, 43.0, "C", None, None),
    "weight": (1.0, 300.0, "kg", None, None),
    "bmi": (10.0, 80.0, "kg/m2", None, None),
    "dose": (0.0, 10000.0, "mg", None, None),
}

# Concepts whose repetition over visits is suspicious.
REPEAT_CONCEPTS = ["temperature", "heart_rate", "systolic_bp", "diastolic_bp", "weight"]

# Header substrings of quantities that cannot be negative.
POSITIVE_PATTERNS = {
    "age": ["age", "years_old"],
    "weight": ["weight", "wt", "weight_kg", "body_weight"],
    "height": ["height", "ht", "height_cm"],
    "heart_rate": ["heart_rate", "hr", "pulse", "pulse_rate", "bpm"],
    "bp": ["bp", "blood_pressure", "systolic", "diastolic", "sbp", "dbp"],
    "temp": ["temp", "temperature", "temp_c", "temp_f", "body_temp"],
    "dose": ["dose", "dosage", "amount_mg"],
}

# Weight of each detector in the combined score, and of any other.
ENSEMBLE_WEIGHTS = {
    "clinical_rules": 0.40,
    "isolation_forest": 0.25,
    "statistical": 0.20,
    "lof": 0.15,
    "autoencoder": 0.10,
}
OTHER_WEIGHT = 0.05

# Severity labels and the lowest combined score of each.
SEVERITY_LEVELS = [("CRITICAL", 0.8), ("HIGH", 0.6), ("MEDIUM", 0.3), ("LOW", 0.0)]

# Suggested actions.
MISSING_ACTION = "Verify with site coordinator and request form completion. Check database entry log."
DUPLICATE_ACTION = ("Investigate database ingestion pipeline. Confirm subject identity and merge records "
                    "if duplicate.")
SEVERITY_ACTIONS = {
    "CRITICAL": "Immediate escalation required: Contact medical monitor within 24 hours. Initiate source data "
                "verification (SDV) and check safety/eligibility criteria.",
    "HIGH": "Flag for investigator/medical review during the next study call. Issue a formal data query to the "
            "clinical site.",
    "MEDIUM": "Verify value against source clinical documents (medical records/lab reports) and correct entry if "
              "typographical.",
    "LOW": "Monitor parameter trend. No immediate action required if subject is clinically stable.",
}

# Recommendation texts; {0} is a count or a column name, {1} a count.
RECOMMENDATIONS = {
    "clean": "Data quality is excellent. Continue routine data management and monitoring.",
    "critical": "Immediate Medical Monitor review required: {0} CRITICAL safety/physiological range violations "
                "detected.",
    "missing": "Check case report forms (CRFs) for incomplete entries. Consider implementing mandatory fields in "
               "the electronic data capture (EDC) system to resolve missing values.",
    "duplicates": "Duplicate patient rows or near-duplicate values detected. Verify database ingestion pipelines "
                  "and ensure subject identifiers are unique.",
    "column": "Inspect the collection protocol for parameter '{0}'. It exhibits the highest frequency of outliers "
              "({1} anomalies). Check instrument calibration or site entry procedures.",
    "statistical": "Univariate statistical outliers detected. Review protocol eligibility criteria to ensure "
                   "subjects' baseline characteristics are within standard clinical populations.",
    "other": "Review flagged clinical records and verify values against source clinical documents (SDV).",
}

# What a low or high value of a concept can mean.
UNKNOWN_CONTEXT = "Value is outside statistical or rule-based bounds for this trial parameter."
CONTEXT = {
    "hemoglobin": {
        "low": "Low hemoglobin (anemia) is a common protocol safety concern. It may indicate drug-induced bone "
               "marrow suppression, occult gastrointestinal bleeding, or nutritional deficiency.",
        "high": "Elevated hemoglobin (polycythemia) can indicate severe dehydration, hemoconcentration, chronic "
                "hypoxia, or pulmonary conditions.",
    },
    "wbc": {
        "low": "Leukopenia (low WBC) is a critical concern for immunosuppression. It puts the subject at high risk "
               "for opportunistic infections and may indicate drug-induced myelosuppression.",
        "high": "Leukocytosis (high WBC) is typically indicative of an active infection, inflammatory response, "
                "physical stress, or hematologic malignancy.",
    },
    "platelets": {
        "low": "Thrombocytopenia (low platelets) represents a severe safety risk for spontaneous bleeding or "
               "hemorrhage. Often a dose-limiting toxicity in oncology and antiviral trials.",
        "high": "Thrombocytosis (high platelets) can increase the risk of thrombotic events, stroke, or indicate "
                "underlying inflammatory disease/marrow disorders.",
    },
    "sodium": {
        "low": "Hyponatremia (low sodium) can lead to cerebral edema, altered mental status, and seizures. Often "
               "caused by drug-induced SIADH or fluid overload.",
        "high": "Hypernatremia (high sodium) indicates dehydration, excessive sodium intake, or impaired renal "
                "concentrating ability.",
    },
    "potassium": {
        "low": "Hypokalemia (low potassium) is a major cardiac risk, predisposing the subject to QT prolongation, "
               "muscle weakness, and lethal cardiac arrhythmias.",
        "high": "Hyperkalemia (high potassium) is a critical medical emergency that can cause ECG changes (peaked "
                "T-waves), muscle paralysis, or cardiac arrest.",
    },
    "creatinine": {
        "high": "Elevated creatinine indicates acute kidney injury (AKI) or progressive renal impairment. Requires "
                "close monitoring for drug nephrotoxicity and potential dose adjustment.",
    },
    "glucose": {
        "low": "Hypoglycemia (low blood sugar) is a dangerous acute event causing neuroglycopenic symptoms, "
               "confusion, or loss of consciousness.",
        "high": "Hyperglycemia (high blood sugar) indicates uncontrolled diabetes, insulin resistance, or "
                "steroid-induced glucose intolerance.",
    },
    "alt": {
        "high": "Elevated alanine aminotransferase (ALT) is a sensitive indicator of hepatocellular damage. Values "
                ">3x upper limit of normal (ULN) are standard protocol thresholds for drug-induced liver injury "
                "(DILI).",
    },
    "ast": {
        "high": "Elevated aspartate aminotransferase (AST) indicates cellular injury in the liver, heart, or "
                "skeletal muscle. When combined with elevated ALT, indicates active hepatotoxicity.",
    },
    "bilirubin": {
        "high": "Hyperbilirubinemia (high bilirubin) indicates biliary obstruction, hemolysis, or impaired hepatic "
                "clearance. Concurrent ALT >3x ULN and Bilirubin >2x ULN meets 'Hy's Law' criteria for severe DILI.",
    },
    "systolic_bp": {
        "low": "Hypotension (low systolic BP) can cause tissue hypoperfusion, dizziness, and syncope. May indicate "
               "anaphylaxis, dehydration, or drug toxicity.",
        "high": "Hypertension (high systolic BP) poses cardiovascular risks. Values >180 mmHg are considered "
                "hypertensive crises, requiring immediate clinical intervention.",
    },
    "diastolic_bp": {
        "low": "Low diastolic blood pressure can compromise coronary artery perfusion.",
        "high": "Elevated diastolic BP indicates increased systemic vascular resistance and long-term "
                "cardiovascular strain.",
    },
    "heart_rate": {
        "low": "Bradycardia (low heart rate) can indicate drug-induced sinus node suppression (e.g. "
               "beta-blockers), conduction blocks, or autonomic dysfunction.",
        "high": "Tachycardia (high heart rate) can indicate infection/fever, cardiovascular stress, dehydration, "
                "or drug-induced sympathetic activation.",
    },
    "temperature": {
        "low": "Hypothermia (low body temp) can indicate exposure, shock, or metabolic disorders.",
        "high": "Pyrexia (fever) suggests an active infectious process, drug fever, or acute infusion reaction.",
    },
    "weight": {
        "low": "Sudden weight loss may indicate cachexia, severe gastrointestinal toxicity, or metabolic disease.",
        "high": "Sudden weight gain (e.g. >2 kg in 48h) is highly suspicious for acute fluid retention, "
                "potentially indicative of renal failure, congestive heart failure, or drug-induced edema.",
    },
}
