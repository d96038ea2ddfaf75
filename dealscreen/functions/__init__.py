"""Column expressions: deal math, text helpers and JSON navigation."""

from dealscreen.functions.deal_math import (  # noqa: F401
    array_median,
    confidence_band,
    dscr,
    dscr_passes,
    equity_after_close,
    est_monthly_rent,
    instant_equity,
    investment_grade,
    ltv,
    monthly_payment,
    pitia,
    price_per_sqft,
    screen_property,
    spread,
    tax_rate,
)
from dealscreen.functions.text import (  # noqa: F401
    apn_key,
    batch_label,
    normalize_apn,
    nullif_zero,
    number_from_text,
)
