"""Cleaning, filtering and projection: the view stack raw -> typed -> clean
-> features -> model, plus the form helpers. All narrow (no shuffle)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fx
from ..schemas import MODEL_COLUMNS, SERVICE_COLUMNS


def typed_view(df: DataFrame, amount_col: str = "totalcharges", strict: bool = True) -> DataFrame:
    """Text amount -> double (trim, blank -> NULL, cast); other columns pass."""
    return df.withColumn(amount_col, fx.numeric_text_to_double(amount_col, strict=strict))


def clean_view(df: DataFrame, amount_col: str = "totalcharges") -> DataFrame:
    """Keep rows whose amount is not NULL."""
    return df.where(F.col(amount_col).isNotNull())


def labelled_only(df: DataFrame, label_col: str = "churn",
                  values: Sequence[str] = ("Yes", "No")) -> DataFrame:
    """Keep rows whose label is one of ``values`` (NULL and others dropped)."""
    return df.where(F.col(label_col).isin(*values))


def encode_target(df: DataFrame, label_col: str = "churn", out: str = "target",
                  positive: str = "Yes", negative: str = "No") -> DataFrame:
    code = (F.when(F.col(label_col) == positive, 1)
            .when(F.col(label_col) == negative, 0)
            .otherwise(F.lit(None)).cast("int"))
    return df.withColumn(out, code)


def feature_view(df: DataFrame, service_cols: Sequence[str] = SERVICE_COLUMNS,
                 null_internet_counts: bool = False) -> DataFrame:
    """Append the six derived features (one projection)."""
    n = fx.total_services(service_cols)
    return df.withColumns({
        "total_services": n,
    }).withColumns({
        "automatic_payment": fx.automatic_payment(),
        "avg_charge_per_service": fx.avg_charge_per_service(services="total_services"),
        "streaming_user": fx.streaming_user(),
        "internet_and_phone": fx.internet_and_phone(null_internet_counts=null_internet_counts),
        "customer_lifecycle_stage": fx.lifecycle_stage(),
    })


def model_view(df: DataFrame) -> DataFrame:
    """Labelled rows, target encoded, projected to the model column order."""
    return encode_target(labelled_only(df)).select(*MODEL_COLUMNS)


def model_table(raw: DataFrame, strict: bool = True) -> DataFrame:
    """raw -> typed -> clean -> features -> model, in one lazy plan."""
    return model_view(feature_view(clean_view(typed_view(raw, strict=strict))))


def drop_columns(df: DataFrame, *groups: Iterable[str]) -> DataFrame:
    """Drop listed columns that exist; missing names are ignored."""
    names = [c for g in groups for c in g]
    return df.drop(*names)


def align_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Reorder to ``schema``; missing columns become typed NULLs, extras go."""
    have = set(df.columns)
    return df.select([
        (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType))
        .alias(f.name)
        for f in schema.fields
    ])


# Form labels (Portuguese) -> data vocabulary.
FORM_CODE_MAPS: dict[str, dict[str, str]] = {
    "gender": {"Masculino": "Male", "Feminino": "Female"},
    "contract": {"Mês a mês": "Month-to-month", "Um ano": "One year", "Dois anos": "Two year"},
    "paymentmethod": {
        "Boleto": "Mailed check",
        "Carteira Digital": "Electronic check",
        "Transferência Eletrônica": "Bank transfer (automatic)",
        "Cartão de Crédito": "Credit card (automatic)",
    },
    "internetservice": {"DSL": "DSL", "Fibra Óptica": "Fiber optic", "Sem Internet": "No"},
    "multiplelines": {"Sim": "Yes", "Não": "No", "Sem serviço de telefone": "No phone service"},
}


def _literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def map_codes(df: DataFrame, mappings: Mapping[str, Mapping[str, str]] = FORM_CODE_MAPS,
              suffix: str = "") -> DataFrame:
    """Translate labels through literal maps; an unknown label gives NULL.

    The maps are tiny literals folded into the projection (no join).
    """
    return df.withColumns({
        f"{c}{suffix}": F.try_element_at(_literal_map(m), F.col(c))
        for c, m in mappings.items() if c in df.columns
    })


def checkbox_codes(df: DataFrame, cols: Sequence[str], as_int: bool = False) -> DataFrame:
    """Boolean -> 'Yes'/'No' (or 1/0)."""
    yes, no = (F.lit(1), F.lit(0)) if as_int else (F.lit("Yes"), F.lit("No"))
    return df.withColumns({c: F.when(F.col(c), yes).otherwise(no) for c in cols})


# The form's input domains and the charge-consistency rule.
DEFAULT_RULES: dict[str, str] = {
    "total_below_monthly": "totalcharges < monthlycharges",
    "tenure_out_of_range": "tenure < 0 OR tenure > 72",
    "monthly_out_of_range": "monthlycharges < 0 OR monthlycharges > 120",
    "total_out_of_range": "totalcharges < 0 OR totalcharges > 8700",
}


def quality_rules(df: DataFrame, rules: Mapping[str, str] | None = None) -> DataFrame:
    """(rule, violations, checked) — one aggregate pass for all rules.

    A rule expression is a SQL predicate that is true for a violating row;
    rows where it is NULL are not counted.
    """
    rules = dict(rules or DEFAULT_RULES)
    aggs = [F.count_if(F.coalesce(F.expr(e), F.lit(False))).alias(f"r{i}")
            for i, e in enumerate(rules.values())]
    wide = df.agg(F.count(F.lit(1)).alias("checked"), *aggs)
    stack = ", ".join(f"'{name}', r{i}" for i, name in enumerate(rules))
    return wide.selectExpr(f"stack({len(rules)}, {stack}) AS (rule, violations)", "checked")
