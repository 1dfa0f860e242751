"""Column expressions (built-in Spark functions only, so they stay inside whole-stage codegen)."""

from carelens.functions.dates import (  # noqa: F401
    add_whole_days, day_after, display_date, end_of_day, outcome_status, quarter_end, whole_months, whole_years,
)
from carelens.functions.text import non_empty, number_text, text_is  # noqa: F401
