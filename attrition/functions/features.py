"""Column expressions for the per-row features.

Each returns a ``Column`` so it composes inside one projection (one
whole-stage-codegen span, no shuffle).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SERVICE_COLUMNS


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total_services(cols: Sequence[str] = SERVICE_COLUMNS) -> Column:
    """Number of listed add-ons equal to 'Yes' (NULL counts as 0)."""
    terms = [F.when(_c(c) == "Yes", 1).otherwise(0) for c in cols]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out.cast("int")


def automatic_payment(col: str = "paymentmethod", pattern: str = "%automatic%") -> Column:
    """1 when the payment method matches the LIKE pattern (case-sensitive)."""
    return F.when(_c(col).like(pattern), 1).otherwise(0).cast("int")


# The two automatic payment methods offered by the form.
AUTOMATIC_METHODS = ["Bank transfer (automatic)", "Credit card (automatic)"]


def automatic_payment_form(col: str = "paymentmethod") -> Column:
    """Form variant: membership in the two automatic methods."""
    return F.when(_c(col).isin(*AUTOMATIC_METHODS), 1).otherwise(0).cast("int")


def avg_charge_per_service(monthly: str = "monthlycharges",
                           services: str | Column = "total_services") -> Column:
    """Monthly charge per service; the whole charge when there is none.

    ``when`` short-circuits, so the division never sees a zero under ANSI.
    """
    n = _c(services)
    return F.when(n > 0, _c(monthly) / n.cast("double")).otherwise(_c(monthly)).cast("double")


def streaming_user(tv: str = "streamingtv", movies: str = "streamingmovies") -> Column:
    return F.when((_c(tv) == "Yes") | (_c(movies) == "Yes"), 1).otherwise(0).cast("int")


def internet_and_phone(internet: str = "internetservice", phone: str = "phoneservice",
                       null_internet_counts: bool = False) -> Column:
    """1 when there is internet (not 'No') and phone. NULL internet gives 0
    under SQL three-valued logic; the form variant treats NULL as present."""
    has_internet = _c(internet) != "No"
    if null_internet_counts:
        has_internet = has_internet | _c(internet).isNull()
    return F.when(has_internet & (_c(phone) == "Yes"), 1).otherwise(0).cast("int")


def lifecycle_stage(tenure: str = "tenure", newbie_max: int = 6, stable_max: int = 24) -> Column:
    """Newbie (<= 6), Stable (7..24), else Loyal — NULL tenure falls to Loyal."""
    t = _c(tenure)
    return (F.when(t <= newbie_max, "Newbie")
            .when((t >= newbie_max + 1) & (t <= stable_max), "Stable")
            .otherwise("Loyal"))


# A decimal number, with or without exponent, or a special value.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:nan|inf|infinity)$"


def numeric_text_to_double(col: str | Column, strict: bool = True) -> Column:
    """Trim, blank -> NULL, then cast text to double.

    strict: a malformed value raises, as the SQL view does; lenient: it becomes
    NULL. The pattern keeps out what Spark's cast takes besides plain numbers,
    such as a type suffix ('1.0d').
    """
    trimmed = F.nullif(F.trim(_c(col)), F.lit(""))
    number = trimmed.rlike(NUMBER)
    if strict:
        return F.when(trimmed.isNull() | number, trimmed).otherwise(F.raise_error(F.concat(
            F.lit("not a number: "), trimmed)).cast("string")).cast("double")
    return F.when(number, trimmed).try_cast("double")
