"""Codes of the public datasets and the phrases they are written as."""

from __future__ import annotations

# --- credit -----------------------------------------------------------------------
CHECKING_STATUS = {
    "<0": "< 0 DM",
    "0<=X<200": "0 <= ... < 200 DM",
    ">=200": ">= 200 DM",
    "no checking": "no checking account",
}
CREDIT_HISTORY = {
    "no credits/all paid": "no credits taken/ all credits paid back duly",
    "all paid": "all credits at this bank paid back duly",
    "existing paid": "existing credits paid back duly till now",
    "delayed previously": "delay in paying off in the past",
    "critical/other existing credit":
        "critical account/ other credits existing (not at this bank)",
}
PURPOSE = {
    "new car": "car (new)",
    "used car": "car (used)",
    "furniture/equipment": "furniture/equipment",
    "radio/tv": "radio/television",
    "domestic appliance": "domestic appliances",
    "repairs": "repairs",
    "education": "education",
    "retraining": "retraining",
    "business": "business",
    "other": "others",
}
SAVINGS_STATUS = {
    "<100": "... < 100 DM",
    "100<=X<500": "100 <= ... < 500 DM",
    "500<=X<1000": "500 <= ... < 1000 DM",
    ">=1000": "... >= 1000 DM",
    "no known savings": "unknown/ no savings account",
}
EMPLOYMENT = {
    "unemployed": "unemployed",
    "<1": "... < 1 year",
    "1<=X<4": "1 <= ... < 4 years",
    "4<=X<7": "4 <= ... < 7 years",
    ">=7": "... >= 7 years",
}
PERSONAL_STATUS = {
    "female div/dep/mar": "female : divorced/separated/married",
    "male div/sep": "male : divorced/separated",
    "male mar/wid": "male : married/widowed",
    "male single": "male : single",
}
OTHER_PARTIES = {
    "none": "none",
    "co applicant": "co-applicant",
    "guarantor": "guarantor",
}
PROPERTY_MAGNITUDE = {
    "car": "car or other, not in attribute 6",
    "life insurance": "building society savings agreement/ life insurance",
    "no known property": "unknown / no property",
    "real estate": "real estate",
}
JOB = {
    "high qualif/self emp/mgmt":
        "management/ self-employed/ highly qualified employee/ officer",
    "skilled": "skilled employee / official",
    "unemp/unskilled non res": "unemployed/ unskilled - non-resident",
    "unskilled resident": "unskilled - resident",
}
OWN_TELEPHONE = {
    "none": "none",
    "yes": "yes, registered under the customers name",
}

# --- car --------------------------------------------------------------------------
PRICES = {"vhigh": "very high", "high": "high", "med": "medium", "low": "low"}
DOORS = {"2": "two", "3": "three", "4": "four", "5more": "five or more"}
PERSONS = {"2": "two", "4": "four", "more": "more than four"}
LUG_BOOT = {"big": "big", "med": "medium", "small": "small"}
SAFETY = {"high": "high", "med": "medium", "low": "low"}
CAR_LABELS = {"unacc": 0, "acc": 1, "good": 2, "vgood": 3}

# --- income -----------------------------------------------------------------------
OCCUPATION = {
    "Tech-support": "technology and support sector",
    "Craft-repair": "craft and repair sector",
    "Other-service": "service sector",
    "Sales": "sales sector",
    "Exec-managerial": "execution and management",
    "Prof-specialty": "professional specialty",
    "Handlers-cleaners": "cleaning and maintenance sector",
    "Machine-op-inspct": "machine operator and inspector",
    "Adm-clerical": "office and administrative support",
    "Farming-fishing": "agriculture, forestry, and fisheries sector",
    "Transport-moving": "transportation, communication, and other public utilities sector",
    "Priv-house-serv": "private household",
    "Protective-serv": "protective services sector",
    "Armed-Forces": "armed forces",
}
WORKCLASS = {
    "Private": "private sector employee",
    "Local-gov": "local government",
    "State-gov": "state government",
    "Federal-gov": "federal government",
    "Self-emp-not-inc":
        "owner of a non-incorporated business, professional practice, or farm",
    "Self-emp-inc": "owner of a incorporated business, professional practice, or farm",
    "Without-pay": "without pay in a for-profit family business or farm",
    "Never-worked": "never worked",
}
EDUCATION = {
    "Doctorate": "doctoral degree",
    "Prof-school": "professional degree",
    "Masters": "master's degree",
    "Bachelors": "bachelor's degree",
    "Assoc-acdm": "associate's degree",
    "Assoc-voc": "college for one or more years without a degree",
    "Some-college": "college for less than one year",
    "HS-grad": "high school graduate",
    "12th": "finished 12th class without diploma",
    "11th": "finished 11th class",
    "10th": "finished 10th class",
    "9th": "finished 9th class",
    "7th-8th": "finished 8th class",
    "5th-6th": "finished 6th class",
    "1st-4th": "finished 4th class",
    "Preschool": "no schooling",
}
MARITAL_STATUS = (
    "Married-civ-spouse", "Divorced", "Never-married", "Separated", "Widowed",
    "Married-spouse-absent", "Married-AF-spouse",
)
RELATIONSHIP = (
    "Wife", "Own-child", "Husband", "Not-in-family", "Other-relative", "Unmarried",
)
RACE = ("White", "Asian-Pac-Islander", "Amer-Indian-Eskimo", "Other", "Black")
NATIVE_COUNTRY = (
    "United-States", "Cambodia", "England", "Puerto-Rico", "Canada", "Germany",
    "Outlying-US(Guam-USVI-etc)", "India", "Japan", "Greece", "South", "China", "Cuba", "Iran",
    "Honduras", "Philippines", "Italy", "Poland", "Jamaica", "Vietnam", "Mexico", "Portugal",
    "Ireland", "France", "Dominican-Republic", "Laos", "Ecuador", "Taiwan", "Haiti", "Columbia",
    "Hungary", "Guatemala", "Nicaragua", "Scotland", "Thailand", "Yugoslavia", "El-Salvador",
    "Trinadad&Tobago", "Peru", "Hong", "Holand-Netherlands",
)
# Largest value, or list of values, a perturbed income row may take per feature.
INCOME_DOMAINS = {
    "age": 99,
    "workclass": tuple(WORKCLASS),
    "education": tuple(EDUCATION),
    "marital_status": MARITAL_STATUS,
    "occupation": tuple(OCCUPATION),
    "relationship": RELATIONSHIP,
    "race": RACE,
    "sex": ("Male", "Female"),
    "capital_gain": 9999,
    "capital_loss": 4356,
    "hours_per_week": 99,
    "native_country": NATIVE_COUNTRY,
}

# --- heart ------------------------------------------------------------------------
CHEST_PAIN = {
    "TA": "typical angina",
    "ATA": "atypical angina",
    "NAP": "non-anginal pain",
    "ASY": "asymptomatic",
}
RESTING_ECG = {
    "Normal": "normal",
    "ST": "ST-T wave abnormality",
    "LVH": "probable or definite left ventricular hypertrophy",
}
ST_SLOPE = {"Up": "upsloping", "Flat": "flat", "Down": "downsloping"}

# --- scaling constants (mean, standard deviation) ------------------------------------
SCALINGS = {
    "income": {
        "age": (38.66194047, 13.70079038),
        "capital_gain": (1092.03493461, 7514.89341966),
        "capital_loss": (87.05228675, 401.7001878),
        "hours_per_week": (40.45123231, 12.43397048),
    },
    "car": {},
    "heart": {
        "Age": (53.63760218, 9.38893213),
        "RestingBP": (132.09264305, 18.09209337),
        "Cholesterol": (201.70844687, 107.50566557),
        "FastingBS": (0.23160763, 0.42185962),
        "MaxHR": (136.59945504, 25.12828773),
        "Oldpeak": (0.92711172, 1.06128969),
    },
    "diabetes": {
        "Pregnancies": (3.68403909, 3.28025968),
        "Glucose": (120.41042345, 32.63939221),
        "BloodPressure": (68.75081433, 19.83518715),
        "SkinThickness": (20.22638436, 15.68020872),
        "Insulin": (79.43485342, 114.8289827),
        "BMI": (31.77654723, 8.02507088),
        "DiabetesPedigreeFunction": (0.47113192, 0.33090205),
        "Age": (32.90879479, 11.66936554),
    },
}

# --- patient notes ----------------------------------------------------------------
GENDERS = ("female", "male")
RACES = (
    "race not recorded", "hispanic or latino", "asian", "black or african american",
    "american indian or alaska native", "white", "native hawaiian or other pacific islander",
)
NO_RACE = "race not recorded"
PRONOUNS = {"female": "she", "male": "he"}
VISIT_PHRASES = {
    "inpatient visit": "stayed in the hospital",
    "outpatient visit": "visited the hospital",
    "hospice": "stayed in the hospice",
    "office visit": "saw a doctor",
    "pharmacy visit": "visited a pharmacy",
}
VISIT_CONCEPTS = {
    581458: "Pharmacy visit",
    581477: "Office Visit",
    8546: "Hospice",
    9201: "Inpatient Visit",
    9202: "Outpatient Visit",
}
NO_SPECIALTY = "no matching concept"

# --- prompts: task -> (template name, question, answer choices) -----------------------
PROMPT_SHAPE = "${note}\n\n${question} Answer:"
YES_NO = " Yes or no?"
NO_YES_CHOICES = "No ||| Yes"
CAR_CHOICES = "Unacceptable ||| Acceptable ||| Good ||| Very good"
PROMPTS = {
    "bank": ("bank", "Does this client subscribe to a term deposit?" + YES_NO, NO_YES_CHOICES),
    "blood": ("blood", "Did the person donate blood?" + YES_NO, NO_YES_CHOICES),
    "calhousing": ("calhousing", "Is this house block valuable?" + YES_NO, NO_YES_CHOICES),
    "car": (
        "rate_decision",
        "How would you rate the decision to buy this car? Unacceptable, acceptable, good or very good?",
        CAR_CHOICES,
    ),
    "creditg": ("creditg", "Does this person receive a credit?" + YES_NO, NO_YES_CHOICES),
    "diabetes": ("diabetes", "Does this patient have diabetes?" + YES_NO, NO_YES_CHOICES),
    "eol": (
        "nine_months", "Does this patient die in the next nine months?" + YES_NO, NO_YES_CHOICES,
    ),
    "heart": (
        "heart_disease",
        "Does the coronary angiography of this patient show a heart disease?" + YES_NO,
        NO_YES_CHOICES,
    ),
    "income": (
        "50000_dollars",
        "Does this person earn more than 50000 dollars per year?" + YES_NO,
        NO_YES_CHOICES,
    ),
    "jungle": (
        "jungle",
        "Does the white player win this two pieces endgame of Jungle Chess?" + YES_NO,
        NO_YES_CHOICES,
    ),
    "loh": (
        "nine_months",
        "Is this patient admitted to the hospital in the next nine months?" + YES_NO,
        NO_YES_CHOICES,
    ),
    "surgery": (
        "nine_months",
        "Does this patient need a surgery in the next nine months?" + YES_NO,
        NO_YES_CHOICES,
    ),
}
WINE_QUESTION = "Is this wine of good quality?" + YES_NO
# Rows one task may give to a mixture, over all its templates.
MIXTURE_ROWS = 500_000
DENIED_TASKS = (
    "hotpot_qa_distractor_Generate_Explanations",
    "hotpot_qa_fullwiki_Generate_Explanations",
    "hotpot_qa_distractor_Generate_Answer_and_Explanations",
    "hotpot_qa_fullwiki_Generate_Answer_and_Explanations",
    "hotpot_qa_fullwiki_Generate_Answer",
    "hotpot_qa_distractor_Generate_Answer",
    "hotpot_qa_distractor_Generate_Title_2",
    "hotpot_qa_fullwiki_Generate_Title_2",
    "hotpot_qa_fullwiki_Generate_Title_1",
    "hotpot_qa_distractor_Generate_Title_1",
    "hotpot_qa_distractor_Generate_Question",
    "hotpot_qa_fullwiki_Generate_Question",
    "tab_fact_tab_fact_tab_fact_3",
    "tab_fact_tab_fact_tab_fact_2",
    "tab_fact_tab_fact_tab_fact_1",
    "tab_fact_tab_fact_tab_fact_7",
    "tab_fact_tab_fact_tab_fact_4",
    "tab_fact_tab_fact_tab_fact_5",
    "tab_fact_tab_fact_tab_fact_6",
    "wiki_hop_masked_Choose_Best_Object_Candidate",
    "wiki_hop_masked_Indirect_Question_about_Birthplace_Citizenship_Place_of_Death",
    "narrativeqa_Template_05",
    "ecthr_cases_alleged_violation_prediction_silver_rationales",
    "gigaword_summarize_",
)
