"""Text, number, date and rounding helpers shared by the operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions.values import TOPICS, WHITESPACE

_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def blank(text: Column) -> Column:
    """True for a missing text and for one that is only whitespace."""
    return F.coalesce(trimmed(text) == "", F.lit(True))


def blank_to_null(text: Column) -> Column:
    return F.nullif(trimmed(text), F.lit(""))


def number(text: Column) -> Column:
    """Number in `text`, else null; too large a number is null as well. A blank text counts as zero."""
    shown = F.regexp_replace(trimmed(text), "^$", "0")
    return F.nullif(F.regexp_extract(shown, _NUMBER, 0).try_cast("double"), F.lit(float("inf")))


def exact_number(text: Column, kind: T.DecimalType) -> Column:
    """Number in `text` as a decimal of type `kind`, null when it can't be held with all its digits. Blank counts as zero."""
    shown = F.regexp_replace(trimmed(text), "^$", "0")
    found = F.regexp_extract(shown, _NUMBER, 0)
    before, after = F.regexp_extract(found, r"^[+-]?(\d*)", 1), F.regexp_extract(found, r"\.(\d*)", 1)
    power = F.coalesce(F.regexp_extract(found, r"[eE]([+-]?\d+)$", 1).try_cast("int"), F.lit(0))
    digits = F.concat(before, after)
    # places after the point that are not zeros at the end
    places = F.length(after) - power - (F.length(digits) - F.length(F.rtrim(digits, F.lit("0"))))
    zero = F.rtrim(digits, F.lit("0")) == ""
    held = F.when(zero & (found != ""), F.lit(0)).when((places <= kind.scale) & (power.between(-1000, 1000)), found.try_cast(kind))
    return held.cast(kind)


def whole_number(text: Column) -> Column:
    """`number(text)` as an int, null when it has a fraction or does not fit."""
    parsed = number(text)
    return F.when(parsed % 1 == 0, parsed.try_cast("int"))


def calendar_date(text: Column) -> Column:
    """Date of a `yyyy-MM-dd` text, null for any other text."""
    return F.when(text.rlike(_DATE), text.try_cast("date"))


def date_before_time(text: Column) -> Column:
    """Date of a text such as `2024-01-07T10:00:00Z`: the part before the `T`."""
    return calendar_date(F.split_part(text, F.lit("T"), F.lit(1)))


def day_name(date: Column) -> Column:
    return F.date_format(date, "EEEE")


def percentage(part: Column, whole: Column) -> Column:
    """`100 * part / whole` rounded half up to two places, in integer arithmetic."""
    hundredths = F.call_function(
        "div", F.lit(20000) * part + whole, F.lit(2) * F.nullif(whole, F.lit(0))
    )
    return F.coalesce(hundredths / F.lit(100.0), F.lit(0.0))


def rotation_topic(date: Column, calendar) -> Column:
    """Name of the topic the rotation gives for `date`, null off the weekday."""
    days = F.date_diff(date, F.lit(calendar.anchor).cast("date"))
    steps = F.call_function("div", days, F.lit(calendar.cadence_days))
    name = F.element_at(
        F.array(*[F.lit(topic) for topic in TOPICS]),
        (F.pmod(steps + calendar.start_index, F.lit(len(TOPICS))) + 1).cast("int"),
    )
    held = F.pmod(days, F.lit(calendar.cadence_days)) == 0
    return F.when(held & on_weekday(date, calendar), name)


def on_weekday(date: Column, calendar) -> Column:
    if calendar.weekday is None:
        return date.isNotNull()
    return F.dayofweek(date) == calendar.weekday


def first_reason(*checks: tuple[Column, str]) -> Column:
    """Message of the first failing check, null when none fails."""
    return F.coalesce(*[F.when(failed, F.lit(message)) for failed, message in checks])
