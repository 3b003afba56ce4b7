from .features import (  # noqa: F401
    automatic_payment,
    automatic_payment_form,
    avg_charge_per_service,
    internet_and_phone,
    lifecycle_stage,
    numeric_text_to_double,
    streaming_user,
    total_services,
)
