"""Date expressions on timestamps without time zone."""

from pyspark.sql import functions as F


def as_timestamp(value):
    """A literal timestamp without time zone from text such as ``2024-02-01 00:00:00``."""
    return F.expr(f"timestamp_ntz'{value}'")


def days_before(value, days):
    return F.expr(f"timestamp_ntz'{value}' - interval {int(days)} days")


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


def month(c):
    return F.date_format(c, "yyyy-MM")


def sunday_week(c):
    """``YYYY-Wnn`` with weeks that begin on Sunday; days before the first one are week 00."""
    d = F.to_date(c)
    number = F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7)
    return F.concat(F.date_format(c, "yyyy"), F.lit("-W"), F.lpad(number.cast("string"), 2, "0"))


# Shapes of written dates and the Spark pattern that reads them.  The shape test keeps
# a pattern from accepting text it was not meant for.
DATE_FORMATS = {
    "day": (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    "day_time": (r"^\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$", "y-M-d H:m:s"),
    "day_minute": (r"^\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}$", "y-M-d H:m"),
    "slashes": (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    "chinese": (r"^\d{4}年\d{1,2}月\d{1,2}日$", "y年M月d日"),
}


def parse_date(c, formats):
    """First of several formats that reads the text, else null (never an error)."""
    tries = []
    for name in formats:
        shape, pattern = DATE_FORMATS[name]
        parsed = F.try_to_timestamp(F.regexp_replace(c, r"\s+", " "), F.lit(pattern)).cast("timestamp_ntz")
        tries.append(F.when(c.rlike(shape), parsed))
    return F.coalesce(*tries)


IMPORT_FORMATS = ["day", "day_time", "slashes", "chinese"]
PAGE_FORMATS = ["day", "chinese", "day_minute", "day_time"]
