"""Dates and times as people write them.

A text is classed by the form of its date: which of year, month and day stands where, and whether the month is a word.
Forms exclude each other, so a text is parsed once, by its own form. One form is ambiguous, two short numbers before
the year; there a number above twelve tells day from month, and texts that leave it open follow the vote of those of
their column that do not. Zoned times become UTC, all others are taken as they are; no form depends on the time zone of
the session.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .schema import quoted

#: Longer texts are no dates.
LONGEST = 64

# Names of months and weekdays, and marks of time zones.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_WEEKDAYS = "mon|tue|wed|thu|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday|tues|thur|thurs"
_ZONES = "z|utc|gmt"

_MONTH = "(?<mon>" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS) + r"|sept)\.?"
_YEAR, _SHORT_YEAR, _DAY, _ORDINAL = r"(?<y>\d{4})", r"(?<y>\d{4}|\d{2})", r"(?<d>\d{1,2})", r"(?:st|nd|rd|th)?"
_BETWEEN = r"[-/. ,]{1,2}"
#: Dates by form. ``mixed`` names its short numbers by place, not by meaning.
_DATES = {
    "year_first": rf"{_YEAR}(?<s1>[-/.])(?<m>\d{{1,2}})\k<s1>{_DAY}",
    "mixed": rf"(?<a>\d{{1,2}})(?<s1>[-/.])(?<b>\d{{1,2}})\k<s1>{_SHORT_YEAR}",
    "day_word": rf"{_DAY}{_ORDINAL}(?: of)?{_BETWEEN}{_MONTH}{_BETWEEN}{_SHORT_YEAR}",
    "word_day": rf"{_MONTH}{_BETWEEN}{_DAY}{_ORDINAL}{_BETWEEN}{_YEAR}",
    "year_word": rf"{_YEAR}{_BETWEEN}{_MONTH}{_BETWEEN}{_DAY}",
    "compact": r"(?<y>(?:1[6-9]|20|21)\d{2})(?<m>\d{2})(?<d>\d{2})",
    "month": rf"{_MONTH}{_BETWEEN}{_YEAR}",
}
_CLOCK = r"(?<h>\d{1,2}):(?<n>\d{2})(?::(?<s>\d{2})(?:[.,](?<f>\d{1,9}))?)?(?:\s?(?<p>[ap])\.?m\.?)?"
_HOUR = r"(?<h>\d{1,2})\s?(?<p>[ap])\.?m\.?"
_PACKED = r"(?<h>\d{2})(?<n>\d{2})(?<s>\d{2})?"
_ZONE = rf"(?:\s?(?:{_ZONES})?(?<z>[+-]\d{{2}}(?::?\d{{2}})?)|\s?(?:{_ZONES}))?"
_FIELDS = ("y", "m", "mon", "d", "a", "b", "h", "n", "s", "f", "p", "z")


def _group(name: str, k: int) -> str:
    return f"{name}x{k}" if k else name


def _pattern(form: str) -> str:
    """The whole text of one form: weekday, date, time, zone."""
    gap = r"(?:\s*[tT,]\s*|\s+|\s+at\s+)"
    clock = _CLOCK if form != "compact" else f"(?:{_CLOCK})"
    hour = _HOUR.replace("<h>", "<hx>").replace("<p>", "<px>")
    packed = rf"|[t ]?{_PACKED.replace('<h>', '<hy>').replace('<n>', '<ny>').replace('<s>', '<sy>')}" if form == "compact" else ""
    time = rf"(?:(?:{gap}(?:{clock}|{hour}){packed}){_ZONE})?"
    return rf"(?i)^(?:(?:{_WEEKDAYS})\.?,?\s+)?{_DATES[form]}{time}$"


FORMS = tuple(_DATES)


def _used(form: str) -> dict[str, list[str]]:
    pattern = _pattern(form)
    return {f: [g for g in (f, f + "x", f + "y") if f"(?<{g}>" in pattern] for f in _FIELDS}


def _parsed(c: Column, form: str, day_first: bool) -> Column:
    """Time of a trimmed text that has the form: one regular expression cuts it into fields."""
    used = _used(form)
    cut = "|".join("".join(f"${{{g}}}" for g in used[f]) for f in _FIELDS)
    parts = F.split(F.regexp_replace(c, _pattern(form), cut), "[|]")
    field = {f: f"nullif(element_at(p, {i + 1}), '')" for i, f in enumerate(_FIELDS)}
    number = lambda f: f"try_cast({field[f]} AS int)"
    year = f"CASE WHEN length({field['y']}) = 4 THEN {number('y')} WHEN {number('y')} < 69 THEN 2000 + {number('y')} ELSE 1900 + {number('y')} END"
    if form == "mixed":
        a, b = number("a"), number("b")
        swapped = f"({a} > 12 OR ({day_first!s} AND {b} <= 12))"
        month, day = f"if({swapped}, {b}, {a})", f"if({swapped}, {a}, {b})"
    else:
        names = "".join(m[:3] for m in MONTHS)
        word = f"(locate(lower(left({field['mon']}, 3)), '{names}') + 2) div 3"
        month, day = (word if used["mon"] else number("m")), ("1" if form == "month" else number("d"))
    hour = f"coalesce({number('h')}, 0)"
    half = f"lower({field['p']})"
    hour = f"CASE WHEN {half} IS NULL THEN {hour} WHEN {hour} NOT BETWEEN 1 AND 12 THEN 99 ELSE {hour} % 12 + if({half} = 'p', 12, 0) END"
    second = f"CAST(concat(coalesce({field['s']}, '0'), '.', rpad(coalesce(left({field['f']}, 6), '0'), 6, '0')) AS decimal(16, 6))"
    sign = f"if(left({field['z']}, 1) = '-', -1, 1)"
    digits = f"replace(substr({field['z']}, 2), ':', '')"
    shift = f"coalesce({sign} * (try_cast(left({digits}, 2) AS int) * 60 + coalesce(try_cast(nullif(substr({digits}, 3), '') AS int), 0)), 0)"
    # 60 is a second of the next minute to Spark; here it is no time.
    wall = f"if({second} >= 60, NULL, try_make_timestamp_ntz({year}, {month}, {day}, {hour}, coalesce({number('n')}, 0), {second}))"
    whole = F.expr(f"p -> {wall} - make_dt_interval(0, 0, {shift})")  # a lambda names the fields once
    return F.element_at(F.call_function("transform", F.array(parts), whole), 1)


def form_of(c: Column) -> Column:
    """The form of a text's date; null for texts that are no dates."""
    text = F.trim(c)
    cases = [F.when(text.rlike(_pattern(f)), F.lit(f)) for f in FORMS]
    return F.when((F.length(c) <= LONGEST) & c.rlike(r"\d"), F.coalesce(*cases))


def shape_of(c: Column) -> Column:
    """A text with its digits and words classed: ``31-Jan-2024`` is ``99-A-9999``."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"\d", "9"), r"\p{L}+", "A")


def epoch_micros(c: Column, dt: T.DataType) -> Column:
    """Microseconds since 1970; wall-clock times and dates count as UTC, whatever the session's zone."""
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c)
    # Differences of such times by name go through the session's zone; their fields do not.
    wall = c.cast("timestamp_ntz")
    minutes = (F.unix_date(wall.cast("date")).cast("long") * 24 + F.hour(wall)) * 60 + F.minute(wall)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), wall) * 1_000_000).cast("long")


def epoch_seconds(c: Column, dt: T.DataType) -> Column:
    """Whole seconds since 1970, rounded down."""
    micros = epoch_micros(c, dt)
    return ((micros - F.pmod(micros, F.lit(1_000_000))) / 1_000_000).cast("long")


@dataclass(frozen=True)
class Reading:
    """How the dates of a column are read: the forms that occur, and whether the day stands first where that is open."""

    forms: tuple[str, ...] = FORMS
    day_first: bool = False


def parse_timestamp(c: Column, reading: Reading = Reading()) -> Column:
    """Text to timestamp without time zone; anything that is no date of the forms becomes null."""
    text = F.trim(c)
    cases = [F.when(text.rlike(_pattern(f)), _parsed(text, f, reading.day_first)) for f in reading.forms]
    none = F.lit(None).cast("timestamp_ntz")
    return F.when((F.length(c) <= LONGEST) & c.rlike(r"\d"), F.coalesce(*cases, none)) if cases else none


def date_shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column of text and shape of its dates: column_name, form, shape, rows, day_proofs, month_proofs.

    One scan for all columns; texts that are no dates have one row a column, without form and shape. Shapes are few,
    since only texts of a known form have one.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), quoted(c).cast("string").alias("v")) for c in columns]))
    rows = df.select(cells.alias("r")).select("r.*").where("v IS NOT NULL").withColumn("form", form_of(F.col("v")))
    numbers = F.when(F.col("form") == "mixed", F.regexp_extract_all(F.col("v"), F.lit(r"(?:^|[-/. ,])(\d{1,2})(?=[-/.])"), 1))
    above = lambda k: F.coalesce(F.try_element_at(numbers, F.lit(k)).try_cast("int") > 12, F.lit(False))
    return (
        rows.select("column_name", "form", F.when(F.col("form").isNotNull(), shape_of(F.col("v"))).alias("shape"),
                    above(1).alias("day"), above(2).alias("month"))
        .groupBy("column_name", "form", "shape")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if("day").alias("day_proofs"), F.count_if("month").alias("month_proofs"))
    )


def read_shapes(df: DataFrame, columns: list[str]) -> Mapping[str, Reading]:
    """How each column of text is read, from the shapes of all its values.

    Numbers above twelve vote on what stands first; without a proof, points mean the day and other marks the month.
    """
    if not columns:
        return {}
    found: dict[str, list] = {c: [] for c in columns}
    for r in date_shapes(df, columns).where("form IS NOT NULL").collect():  # a row a shape
        found[r.column_name].append(r)
    out = {}
    for c, rows in found.items():
        day, month = sum(r.day_proofs for r in rows), sum(r.month_proofs for r in rows)
        points = sum(r.rows for r in rows if r.form == "mixed" and "9.9" in r.shape)
        marks = sum(r.rows for r in rows if r.form == "mixed") - points
        forms = tuple(f for f in FORMS if any(r.form == f for r in rows))
        out[c] = Reading(forms, day > month or (day == month and points > marks))
    return out
