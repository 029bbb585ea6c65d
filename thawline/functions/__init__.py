from thawline.functions.nullsafe import (
    coef_var, finite, if_known, one_decimal_share, round_cols, round_even,
    safe_corr, strict, strict_corr, strict_mean,
)
from thawline.functions.clock import clock_seconds, local_from_utc, minutes_between, month_index
from thawline.functions.scalar import (
    calibrate_moisture, conform_site, design_label, logger_key, mask_frozen,
    parse_decimal, parse_stamp, with_calendar, with_hydro_calendar,
)

__all__ = [n for n in dir() if not n.startswith("_")]
