"""Column expressions: parsing, calendars, calibration, naming."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from thawline.functions.clock import local_from_utc
from thawline.functions.nullsafe import if_known, round_even

# Moisture count calibration for unknown soils, x^2, x, constant.
MOISTURE_CURVE = (-1.34e-8, 2.50e-4, -1.58e-1)
# Site-name prefix to sampling design, a later entry wins.
DESIGN_PREFIXES = (("MAL", 1), ("AIL", 1), ("MI", 2), ("RA", 3), ("Haap", 4), ("K", 5))
# Spelling corrections of site names.
SITE_ALIASES = {"SAA19": "SAA019"}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_decimal(c) -> Column:
    """Text with a decimal comma to double; unreadable text is null."""
    return F.regexp_replace(_c(c), ",", ".").try_cast("double")


def parse_stamp(c) -> Column:
    """'2020.06.01 00:15' read as UTC, returned as local wall-clock time."""
    text = F.regexp_replace(F.trim(_c(c)), "[.\\-/T]", " ")
    utc = F.try_to_timestamp(text, F.lit("yyyy M d H:mm")).cast("timestamp_ntz")
    return local_from_utc(utc)


def calibrate_moisture(raw) -> Column:
    a, b, c = MOISTURE_CURVE
    x = _c(raw)
    return round_even((a * x * x + b * x + c) * 100, 1)


def mask_frozen(moist, t1, probl) -> Column:
    """Moisture is unknown in frozen soil, under code 1, or when either is unknown."""
    return if_known((_c(t1) < 1) | (_c(probl) == 1), F.lit(None).cast("double"), _c(moist))


def with_calendar(df: DataFrame, stamp: str = "datetime") -> DataFrame:
    c = F.col(stamp)
    return df.withColumns({
        "date": F.to_date(c), "year": F.year(c), "month": F.month(c),
        "hour": F.hour(c), "minute": F.minute(c), "doy": F.dayofyear(c),
        "year_month": F.concat_ws("_", F.year(c), F.month(c)),
    })


def with_hydro_calendar(df: DataFrame, date: str = "date", shift_days: int = 122) -> DataFrame:
    """Calendar columns of the hydrological year: 1 September counts as 1 January."""
    shifted = F.date_add(F.col(date), shift_days)
    return df.withColumns({
        "hyddate": shifted, "year": F.year(shifted), "month": F.month(date),
        "doy": F.dayofyear(date), "hyddoy": F.dayofyear(shifted),
    })


def logger_key(site="site", tomst_id="tomst_id") -> Column:
    s, t = _c(site), _c(tomst_id)
    return F.when(t.isNotNull() & s.isNotNull(), F.concat_ws("_", s, t.cast("string")))


def conform_site(c, aliases: dict[str, str] = SITE_ALIASES) -> Column:
    name = F.regexp_replace(F.upper(_c(c)), "_", "")
    out = name
    for wrong, right in aliases.items():
        out = F.when(name == wrong, right).otherwise(out)
    return out


def design_label(site) -> Column:
    out = F.lit(None).cast("int")
    for prefix, label in DESIGN_PREFIXES:
        out = F.when(_c(site).startswith(prefix), F.lit(label)).otherwise(out)
    return out
