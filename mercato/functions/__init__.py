"""Column expressions: money arithmetic with exact rounding, calendar helpers."""

from mercato.functions.calendar import (  # noqa: F401
    calendar_month,
    calendar_year,
    day_gap,
    weekday_name,
    year_month,
)
from mercato.functions.money import (  # noqa: F401
    as_money,
    cents,
    half_up_div,
    line_revenue,
    mean_money,
    percent_2dp,
    percent_basis_points,
    percent_raw,
)
