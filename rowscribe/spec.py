"""What the library knows about each dataset: schema, label rule, features, formats."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowscribe import phrasebook as P
from rowscribe.functions import text as X
from rowscribe.operators import labels as L
from rowscribe.operators.serialize import feature_template
from rowscribe.operators.template import ColumnFn, NoteTemplate

Features = tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class DatasetSpec:
    """One dataset. ``schema`` lists the columns as they stand in the file.

    ``exchanged_by_value`` names numeric columns that the shuffled variant treats like
    categories.
    """

    name: str
    file_format: str  # csv, csv_header or arff
    schema: T.StructType
    label_source: str
    label: Callable[[DataFrame], Column]
    features: Features
    renames: Mapping[str, str] = field(default_factory=dict)
    drops: Sequence[str] = ()
    null_token: str | None = None
    categorical: Sequence[str] = ()
    exchanged_by_value: Sequence[str] = ()
    permutation: Sequence[int] = ()
    formats: Mapping[str, ColumnFn] = field(default_factory=dict)
    n_labels: int = 2

    @property
    def width(self) -> int:
        """Number of columns, the label included, once renames and drops are done."""
        return len(self.schema.fields) - len(self.drops)

    @property
    def numeric(self) -> list[str]:
        return [c for c, _ in self.features if c not in self.categorical]

    def template(self, style: str = "text") -> NoteTemplate:
        """The note template: 'text', 'list', 'values', 'permuted', 'shuffled' (the list
        form over shuffled columns) or 'importance' (the list form over all rows)."""
        if style in ("shuffled", "importance"):
            style = "list"
        return feature_template(self.features, style, self.formats, self.permutation or None)

    @property
    def prompt(self) -> tuple[str, str, str]:
        """(template name, question, answer choices)."""
        if self.name not in P.PROMPTS and self.name != "wine":
            raise KeyError(f"dataset {self.name!r} has no prompt")
        return P.PROMPTS.get(self.name, ("wine", P.WINE_QUESTION, P.NO_YES_CHOICES))


def _schema(**columns: str) -> T.StructType:
    kinds = {
        "string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(),
        "int": T.IntegerType(),
    }
    return T.StructType([T.StructField(n, kinds[t]) for n, t in columns.items()])


def _same_type(names: str, kind: str) -> dict[str, str]:
    return {n: kind for n in names.split()}


_int = X.integer_text

# The columns, label codes and display names of the datasets.
_SPECS = [
    DatasetSpec(
        name="creditg",
        file_format="arff",
        schema=_schema(
            checking_status="string", duration="double", credit_history="string",
            purpose="string", credit_amount="double", savings_status="string",
            employment="string", installment_commitment="double", personal_status="string",
            other_parties="string", residence_since="double", property_magnitude="string",
            age="double", other_payment_plans="string", housing="string",
            existing_credits="double", job="string", num_dependents="double",
            own_telephone="string", foreign_worker="string", **{"class": "string"},
        ),
        renames={"class": "label"},
        label_source="label",
        label=L.equals("label", "good"),
        categorical=(
            "checking_status", "credit_history", "purpose", "savings_status", "employment",
            "personal_status", "other_parties", "property_magnitude", "other_payment_plans",
            "housing", "job", "own_telephone", "foreign_worker",
        ),
        exchanged_by_value=("credit_amount",),
        features=(
            ("checking_status", "Status of existing checking account"),
            ("duration", "Duration in month"),
            ("credit_history", "Credit history "),
            ("purpose", "Purpose"),
            ("credit_amount", "Credit amount"),
            ("savings_status", "Savings account/bonds"),
            ("employment", "Present employment since"),
            ("installment_commitment", "Installment rate in percentage of disposable income"),
            ("personal_status", "Personal status and sex"),
            ("other_parties", "Other debtors / guarantors"),
            ("residence_since", "Present residence since"),
            ("property_magnitude", "Property"),
            ("age", "Age in years"),
            ("other_payment_plans", "Other installment plans"),
            ("housing", "Housing"),
            ("existing_credits", "Number of existing credits at this bank"),
            ("job", "Job"),
            ("num_dependents", "Number of people being liable to provide maintenance for"),
            ("own_telephone", "Telephone"),
            ("foreign_worker", "foreign worker"),
        ),
        permutation=(17, 19, 20, 15, 11, 7, 3, 10, 6, 13, 12, 2, 8, 4, 14, 1, 16, 9, 18, 5),
        formats={
            "checking_status": X.phrases(P.CHECKING_STATUS),
            "duration": _int,
            "credit_history": X.phrases(P.CREDIT_HISTORY),
            "purpose": X.phrases(P.PURPOSE),
            "credit_amount": _int,
            "savings_status": X.phrases(P.SAVINGS_STATUS),
            "employment": X.phrases(P.EMPLOYMENT),
            "installment_commitment": _int,
            "personal_status": X.phrases(P.PERSONAL_STATUS),
            "other_parties": X.phrases(P.OTHER_PARTIES),
            "residence_since": _int,
            "property_magnitude": X.phrases(P.PROPERTY_MAGNITUDE),
            "age": _int,
            "existing_credits": _int,
            "job": X.phrases(P.JOB),
            "num_dependents": _int,
            "own_telephone": X.phrases(P.OWN_TELEPHONE),
        },
    ),
    DatasetSpec(
        name="blood",
        file_format="arff",
        schema=_schema(**_same_type("V1 V2 V3 V4", "double"), Class="string"),
        renames={
            "V1": "recency", "V2": "frequency", "V3": "monetary", "V4": "time", "Class": "label",
        },
        label_source="label",
        label=L.equals("label", "2"),
        features=(
            ("recency", "Recency - months since last donation"),
            ("frequency", "Frequency - total number of donation"),
            ("monetary", "Monetary - total blood donated in c.c."),
            ("time", "Time - months since first donation"),
        ),
        permutation=(4, 3, 1, 2),
        formats={"recency": _int, "frequency": _int, "monetary": _int, "time": _int},
    ),
    DatasetSpec(
        name="bank",
        file_format="arff",
        schema=_schema(
            V1="double", **_same_type("V2 V3 V4 V5", "string"), V6="double",
            **_same_type("V7 V8 V9", "string"), V10="double", V11="string",
            **_same_type("V12 V13 V14 V15", "double"), V16="string", Class="string",
        ),
        renames={
            "V1": "age", "V2": "job", "V3": "marital", "V4": "education", "V5": "default",
            "V6": "balance", "V7": "housing", "V8": "loan", "V9": "contact", "V10": "day",
            "V11": "month", "V12": "duration", "V13": "campaign", "V14": "pdays",
            "V15": "previous", "V16": "poutcome", "Class": "label",
        },
        label_source="label",
        label=L.equals("label", "2"),
        categorical=(
            "job", "marital", "education", "default", "housing", "loan", "contact", "month",
            "poutcome",
        ),
        features=(
            ("age", "age"),
            ("job", "type of job"),
            ("marital", "marital status"),
            ("education", "education"),
            ("default", "has credit in default?"),
            ("balance", "average yearly balance, in euros"),
            ("housing", "has housing loan?"),
            ("loan", "has personal loan?"),
            ("contact", "contact communication type"),
            ("day", "last contact day of the month"),
            ("month", "last contact month of year"),
            ("duration", "last contact duration, in seconds"),
            (
                "campaign",
                "number of contacts performed during this campaign and for this client",
            ),
            (
                "pdays",
                "number of days that passed by after the client was last contacted "
                "from a previous campaign",
            ),
            (
                "previous",
                "number of contacts performed before this campaign and for this client",
            ),
            ("poutcome", "outcome of the previous marketing campaign"),
        ),
        permutation=(14, 11, 4, 15, 8, 16, 12, 1, 6, 5, 13, 7, 9, 3, 10, 2),
        formats={
            "age": _int, "balance": _int, "day": _int, "duration": _int, "campaign": _int,
            "pdays": X.sentinel(-1, "client was not previously contacted", _int),
            "previous": _int,
        },
    ),
    DatasetSpec(
        name="jungle",
        file_format="arff",
        schema=_schema(
            **_same_type(
                "white_piece0_strength white_piece0_file white_piece0_rank "
                "black_piece0_strength black_piece0_file black_piece0_rank",
                "double",
            ),
            **{"class": "string"},
        ),
        renames={"class": "label"},
        label_source="label",
        label=L.equals("label", "w"),
        features=(
            ("white_piece0_strength", "white piece strength"),
            ("white_piece0_file", "white piece file"),
            ("white_piece0_rank", "white piece rank"),
            ("black_piece0_strength", "black piece strength"),
            ("black_piece0_file", "black piece file"),
            ("black_piece0_rank", "black piece rank"),
        ),
        permutation=(4, 5, 2, 1, 6, 3),
        formats={
            "white_piece0_strength": _int, "white_piece0_file": _int, "white_piece0_rank": _int,
            "black_piece0_strength": _int, "black_piece0_file": _int, "black_piece0_rank": _int,
        },
    ),
    DatasetSpec(
        name="calhousing",
        file_format="arff",
        schema=_schema(
            median_house_value="double",
            **_same_type(
                "median_income housing_median_age total_rooms total_bedrooms population "
                "households latitude longitude",
                "double",
            ),
        ),
        renames={"median_house_value": "label"},
        label_source="label",
        label=L.above_median("label"),
        features=(
            ("median_income", "median income"),
            ("housing_median_age", "median age"),
            ("total_rooms", "total rooms"),
            ("total_bedrooms", "total bedrooms"),
            ("population", "population"),
            ("households", "households"),
            ("latitude", "latitude"),
            ("longitude", "longitude"),
        ),
        permutation=(4, 5, 8, 3, 2, 7, 1, 6),
        formats={
            "median_income": X.fixed_text(4), "housing_median_age": _int, "total_rooms": _int,
            "total_bedrooms": _int, "population": _int, "households": _int,
            "latitude": X.fixed_text(2), "longitude": X.fixed_text(2),
        },
    ),
    DatasetSpec(
        name="income",
        file_format="csv",
        schema=_schema(
            age="bigint", workclass="string", fnlwgt="bigint", education="string",
            education_num="bigint", marital_status="string", occupation="string",
            relationship="string", race="string", sex="string", capital_gain="bigint",
            capital_loss="bigint", hours_per_week="bigint", native_country="string",
            label="string",
        ),
        drops=("fnlwgt", "education_num"),
        null_token="?",
        label_source="label",
        label=L.one_of("label", (">50K", ">50K.")),
        categorical=(
            "workclass", "education", "marital_status", "occupation", "relationship", "race",
            "sex", "native_country",
        ),
        features=(
            ("age", "Age"),
            ("race", "Race"),
            ("sex", "Sex"),
            ("marital_status", "Marital status"),
            ("relationship", "Relation to head of the household"),
            ("native_country", "Native country"),
            ("occupation", "Occupation"),
            ("workclass", "Work class"),
            ("capital_gain", "Capital gain last year"),
            ("capital_loss", "Capital loss last year"),
            ("education", "Education"),
            ("hours_per_week", "Work hours per week"),
        ),
        permutation=(8, 7, 12, 1, 9, 2, 5, 11, 4, 6, 3, 10),
        formats={
            "race": X.absent_if("other"),
            "marital_status": lambda c: F.when(
                F.lower(c).startswith("married-"), F.lit("married")
            ).when(F.lower(c) == "never-married", F.lit("never married")).otherwise(F.lower(c)),
            "native_country": X.phrases(
                {
                    "United-States": "United States",
                    "Outlying-US(Guam-USVI-etc)": "United States",
                    "South": "South Korea",
                },
                on_missing="keep",
            ),
            "occupation": X.phrases(P.OCCUPATION, on_missing="null"),
            "workclass": X.phrases(P.WORKCLASS, on_missing="null"),
            "education": X.phrases(P.EDUCATION, on_missing="null"),
        },
    ),
    DatasetSpec(
        name="car",
        file_format="csv",
        schema=_schema(
            **_same_type("buying maint doors persons lug_boot safety_dict label", "string")
        ),
        label_source="label",
        label=L.coded("label", P.CAR_LABELS),
        n_labels=4,
        categorical=("buying", "maint", "doors", "persons", "lug_boot", "safety_dict"),
        features=(
            ("buying", "Buying price"),
            ("doors", "Doors"),
            ("maint", "Maintenance costs"),
            ("persons", "Persons"),
            ("safety_dict", "Safety score"),
            ("lug_boot", "Trunk size"),
        ),
        permutation=(5, 1, 6, 2, 3, 4),
        formats={
            "doors": X.phrases(P.DOORS), "persons": X.phrases(P.PERSONS),
            "lug_boot": X.phrases(P.LUG_BOOT), "safety_dict": X.phrases(P.SAFETY),
            "buying": X.phrases(P.PRICES), "maint": X.phrases(P.PRICES),
        },
    ),
    DatasetSpec(
        name="heart",
        file_format="csv_header",
        schema=_schema(
            Age="bigint", Sex="string", ChestPainType="string", RestingBP="bigint",
            Cholesterol="bigint", FastingBS="bigint", RestingECG="string", MaxHR="bigint",
            ExerciseAngina="string", Oldpeak="double", ST_Slope="string", HeartDisease="int",
        ),
        renames={"HeartDisease": "label"},
        label_source="label",
        label=L.as_int("label"),
        categorical=("Sex", "ChestPainType", "RestingECG", "ExerciseAngina", "ST_Slope"),
        features=(
            ("Age", "Age of the patient"),
            ("Sex", "Sex of the patient"),
            ("ChestPainType", "Chest pain type"),
            ("RestingBP", "Resting blood pressure"),
            ("Cholesterol", "Serum cholesterol"),
            ("FastingBS", "Fasting blood sugar > 120 mg/dl"),
            ("RestingECG", "Resting electrocardiogram results"),
            ("MaxHR", "Maximum heart rate achieved"),
            ("ExerciseAngina", "Exercise-induced angina"),
            ("Oldpeak", "ST depression induced by exercise relative to rest"),
            ("ST_Slope", "Slope of the peak exercise ST segment"),
        ),
        permutation=(7, 1, 5, 11, 4, 3, 9, 2, 10, 8, 6),
        formats={
            "Sex": X.two_way("M", "male", "female"),
            "ChestPainType": X.phrases(P.CHEST_PAIN),
            "FastingBS": X.two_way(1, "yes", "no"),
            "ExerciseAngina": X.two_way("Y", "yes", "no"),
            "ST_Slope": X.phrases(P.ST_SLOPE),
            "RestingECG": X.phrases(P.RESTING_ECG),
            "Oldpeak": X.fixed_text(1),
        },
    ),
    DatasetSpec(
        name="diabetes",
        file_format="csv_header",
        schema=_schema(
            **_same_type("Pregnancies Glucose BloodPressure SkinThickness Insulin", "bigint"),
            BMI="double", DiabetesPedigreeFunction="double", Age="bigint", Outcome="int",
        ),
        renames={"Outcome": "label"},
        label_source="label",
        label=L.as_int("label"),
        features=(
            ("Age", "Age"),
            ("Pregnancies", "Number of times pregnant"),
            ("BloodPressure", "Diastolic blood pressure"),
            ("SkinThickness", "Triceps skin fold thickness"),
            (
                "Glucose",
                "Plasma glucose concentration at 2 hours in an oral glucose tolerance test (GTT)",
            ),
            ("Insulin", "2-hour serum insulin"),
            ("BMI", "Body mass index"),
            ("DiabetesPedigreeFunction", "Diabetes pedigree function"),
        ),
        permutation=(5, 8, 7, 3, 1, 4, 2, 6),
        formats={
            "Age": _int, "Pregnancies": _int, "BloodPressure": _int, "SkinThickness": _int,
            "Glucose": _int, "Insulin": _int, "BMI": X.fixed_text(1),
            "DiabetesPedigreeFunction": X.fixed_text(3),
        },
    ),
    DatasetSpec(
        name="wine",
        file_format="csv_header",
        schema=_schema(
            **_same_type(
                "fixed_acidity volatile_acidity citric_acid residual_sugar chlorides "
                "free_sulfur_dioxide total_sulfur_dioxide density pH sulphates alcohol",
                "double",
            ),
            quality="int",
        ),
        renames={"quality": "label"},
        label_source="label",
        label=L.binned("label", (2, 6.5, 8)),
        features=tuple(
            (c, c.replace("_", " "))
            for c in (
                "fixed_acidity", "volatile_acidity", "citric_acid", "residual_sugar",
                "chlorides", "free_sulfur_dioxide", "total_sulfur_dioxide", "density", "pH",
                "sulphates", "alcohol",
            )
        ),
        permutation=(9, 6, 7, 3, 10, 2, 5, 4, 1, 11, 8),
        formats={
            "fixed_acidity": X.fixed_text(1), "volatile_acidity": X.fixed_text(3),
            "citric_acid": X.fixed_text(2), "residual_sugar": X.fixed_text(1),
            "chlorides": X.fixed_text(3), "free_sulfur_dioxide": _int,
            "total_sulfur_dioxide": _int, "density": X.fixed_text(5), "pH": X.fixed_text(2),
            "sulphates": X.fixed_text(2), "alcohol": X.fixed_text(1),
        },
    ),
    DatasetSpec(
        name="voting",
        file_format="csv",
        schema=_schema(
            **_same_type(
                "label handicapped_infants water_project_cost_sharing "
                "adoption_of_the_budget_resolution physician_fee_freeze el_salvador_aid "
                "religious_groups_in_schools anti_satellite_test_ban "
                "aid_to_nicaraguan_contras mx_missile immigration "
                "synfuels_corporation_cutback education_spending superfund_right_to_sue "
                "crime duty_free_exports export_administration_act_south_africa",
                "string",
            )
        ),
        null_token="?",
        label_source="label",
        label=L.equals("label", "democrat"),
        categorical=(
            "handicapped_infants", "water_project_cost_sharing",
            "adoption_of_the_budget_resolution", "physician_fee_freeze", "el_salvador_aid",
            "religious_groups_in_schools", "anti_satellite_test_ban",
            "aid_to_nicaraguan_contras", "mx_missile", "immigration",
            "synfuels_corporation_cutback", "education_spending", "superfund_right_to_sue",
            "crime", "duty_free_exports", "export_administration_act_south_africa",
        ),
        features=tuple(
            (c, c.replace("_", " "))
            for c in (
                "handicapped_infants", "water_project_cost_sharing",
                "adoption_of_the_budget_resolution", "physician_fee_freeze", "el_salvador_aid",
                "religious_groups_in_schools", "anti_satellite_test_ban",
                "aid_to_nicaraguan_contras", "mx_missile", "immigration",
                "synfuels_corporation_cutback", "education_spending", "superfund_right_to_sue",
                "crime", "duty_free_exports", "export_administration_act_south_africa",
            )
        ),
    ),
    DatasetSpec(
        name="titanic",
        file_format="csv_header",
        schema=_schema(
            PassengerId="bigint", Survived="int", Pclass="bigint", Name="string", Sex="string",
            Age="double", SibSp="bigint", Parch="bigint", Ticket="string", Fare="double",
            Cabin="string", Embarked="string",
        ),
        renames={"Survived": "label"},
        label_source="label",
        label=L.as_int("label"),
        categorical=("Name", "Sex", "Ticket", "Cabin", "Embarked"),
        features=(
            ("Pclass", "Pclass"), ("Sex", "Sex"), ("Age", "Age"), ("SibSp", "SibSp"),
            ("Parch", "Parch"), ("Fare", "Fare"), ("Cabin", "Cabin"), ("Embarked", "Embarked"),
        ),
        formats={"Age": X.fixed_text(1), "Fare": X.fixed_text(4)},
    ),
]

REGISTRY: dict[str, DatasetSpec] = {spec.name: spec for spec in _SPECS}


def dataset_spec(name: str) -> DatasetSpec:
    """The dataset of that name; a task name with a suffix falls back to its first part."""
    if name in REGISTRY:
        return REGISTRY[name]
    head = name.split("_")[0].lower()
    if head in REGISTRY:
        return REGISTRY[head]
    raise KeyError(f"unknown dataset {name!r}; known: {', '.join(REGISTRY)}")


def style_of(
    *, as_list: bool = False, permuted: bool = False, values: bool = False, shuffled: bool = False
) -> str:
    """The style for a set of options. All variants but the plain text need the list form."""
    chosen = [n for n, on in (("permuted", permuted), ("values", values), ("shuffled", shuffled)) if on]
    if len(chosen) > 1:
        raise ValueError(f"options exclude each other: {', '.join(chosen)}")
    if chosen and not as_list:
        raise ValueError(f"{chosen[0]} notes exist in list form only")
    return chosen[0] if chosen else ("list" if as_list else "text")
