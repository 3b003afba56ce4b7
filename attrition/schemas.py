"""The three table shapes of the subscriber data: raw, features, model."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and order of the raw subscriber table.
RAW_COLUMNS = [
    ("customerid", T.StringType()),
    ("gender", T.StringType()),
    ("seniorcitizen", T.IntegerType()),
    ("partner", T.StringType()),
    ("dependents", T.StringType()),
    ("tenure", T.IntegerType()),
    ("phoneservice", T.StringType()),
    ("multiplelines", T.StringType()),
    ("internetservice", T.StringType()),
    ("onlinesecurity", T.StringType()),
    ("onlinebackup", T.StringType()),
    ("deviceprotection", T.StringType()),
    ("techsupport", T.StringType()),
    ("streamingtv", T.StringType()),
    ("streamingmovies", T.StringType()),
    ("contract", T.StringType()),
    ("paperlessbilling", T.StringType()),
    ("paymentmethod", T.StringType()),
    ("monthlycharges", T.DoubleType()),
    ("totalcharges", T.StringType()),
    ("churn", T.StringType()),
]

RAW = T.StructType([T.StructField(n, t, True) for n, t in RAW_COLUMNS])

DERIVED_COLUMNS = [
    ("total_services", T.IntegerType()),
    ("automatic_payment", T.IntegerType()),
    ("avg_charge_per_service", T.DoubleType()),
    ("streaming_user", T.IntegerType()),
    ("internet_and_phone", T.IntegerType()),
    ("customer_lifecycle_stage", T.StringType()),
]

FEATURES = T.StructType(
    [T.StructField(n, T.DoubleType() if n == "totalcharges" else t, True) for n, t in RAW_COLUMNS]
    + [T.StructField(n, t, True) for n, t in DERIVED_COLUMNS]
)

# Column order of the model table.
MODEL_COLUMNS = [
    "customerid", "tenure", "monthlycharges", "totalcharges", "total_services",
    "avg_charge_per_service", "seniorcitizen", "automatic_payment", "streaming_user",
    "internet_and_phone", "customer_lifecycle_stage", "gender", "partner", "dependents",
    "phoneservice", "multiplelines", "internetservice", "contract", "paperlessbilling",
    "paymentmethod", "onlinesecurity", "onlinebackup", "deviceprotection", "techsupport",
    "streamingtv", "streamingmovies", "target",
]

_FEATURE_TYPES = {f.name: f.dataType for f in FEATURES.fields}
MODEL = T.StructType(
    [T.StructField(n, _FEATURE_TYPES.get(n, T.IntegerType()), True) for n in MODEL_COLUMNS]
)

ID_COLS = ["customerid"]
TARGET = "target"

# Numeric columns of the model table (correlation matrix, describe).
NUMERIC_COLUMNS = [
    "tenure", "monthlycharges", "totalcharges", "total_services", "avg_charge_per_service",
    "seniorcitizen", "automatic_payment", "streaming_user", "internet_and_phone", "target",
]

CATEGORICAL_COLUMNS = [
    "customer_lifecycle_stage", "gender", "partner", "dependents", "phoneservice",
    "multiplelines", "internetservice", "contract", "paperlessbilling", "paymentmethod",
    "onlinesecurity", "onlinebackup", "deviceprotection", "techsupport", "streamingtv",
    "streamingmovies",
]

# The six add-on services counted by total_services, and the
# seventh (phone) counted by the form variant.
SERVICE_COLUMNS = [
    "onlinesecurity", "onlinebackup", "deviceprotection", "techsupport",
    "streamingtv", "streamingmovies",
]
SERVICE_COLUMNS_FORM = SERVICE_COLUMNS + ["phoneservice"]

# Display orders used by the reports.
CONTRACT_ORDER = ["Month-to-month", "One year", "Two year"]
PAYMENT_ORDER = [
    "Electronic check", "Mailed check", "Bank transfer (automatic)", "Credit card (automatic)",
]
STAGE_ORDER = ["Newbie", "Stable", "Loyal"]

# Parameters for serving (model/churn_params.json shape).
PARAMS = T.StructType([
    T.StructField("threshold", T.DoubleType(), True),
    T.StructField("min_recall_target_val", T.DoubleType(), True),
    T.StructField("id_cols_dropped", T.ArrayType(T.StringType()), True),
    T.StructField("drop_cols_global", T.ArrayType(T.StringType()), True),
    T.StructField("drop_cols_model", T.ArrayType(T.StringType()), True),
    T.StructField("cat_cols", T.ArrayType(T.StringType()), True),
])
