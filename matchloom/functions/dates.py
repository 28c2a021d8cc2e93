"""Dates are kept as text ('', 'Present', 'YYYY', 'YYYY-MM' or the raw text) with a derived month number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.functions.text import first_match, let, literal_map, squash


def parse_date(c: Column | str) -> Column:
    """Fixed list of formats; anything else stays as written."""
    return let(squash(c), _parse)


def _parse(text: Column) -> Column:
    name = r"([A-Za-z]{3,9})\.?"
    year = "([0-9]{4})"
    month_no = literal_map({m: "%02d" % (i + 1) for i, m in enumerate(fv.MONTHS)})

    def named(pattern: str, month_group: int, year_group: int) -> Column:
        month = F.element_at(month_no, F.substring(F.lower(first_match(text, pattern, month_group)), 1, 3))
        # concat (unlike concat_ws) is null when the month is not one
        return F.when(text.rlike(pattern), F.concat(first_match(text, pattern, year_group), F.lit("-"), month))

    def numeric(pattern: str, month_group: int, year_group: int) -> Column:
        month = F.lpad(first_match(text, pattern, month_group), 2, "0")
        return F.when(
            text.rlike(pattern) & month.between("01", "12"),
            F.concat(first_match(text, pattern, year_group), F.lit("-"), month),
        )

    def day_first(pattern: str) -> Column:
        """Day, month, year in figures: the month comes first unless it is above 12."""
        return F.when(
            text.rlike(pattern) & first_match(text, pattern, 1).between("13", "31") & F.lpad(first_match(text, pattern, 2), 2, "0").between("01", "12"),
            F.concat(first_match(text, pattern, 3), F.lit("-"), F.lpad(first_match(text, pattern, 2), 2, "0")))

    def short_year(pattern: str, month_group: int, year_group: int) -> Column:
        month = F.element_at(month_no, F.substring(F.lower(first_match(text, pattern, month_group)), 1, 3))
        digits = first_match(text, pattern, year_group)
        century = F.when(digits < fv.LATEST_SHORT_YEAR, "20").otherwise("19")
        return F.when(text.rlike(pattern), F.concat(century, digits, F.lit("-"), month))

    ordinal = "[0-9]{1,2}(?:st|nd|rd|th)"
    month_name = r"(?i)\b((?:" + "|".join(fv.MONTHS) + r")[a-z]{0,6})\.?"
    return F.coalesce(
        F.when(text == "", F.lit("")),
        F.when(F.lower(text).isin("present", "current", "now", "ongoing"), F.lit("Present")),
        F.when(text.rlike("^[0-9]{4}$"), text),
        numeric(rf"^{year}[-/.]([0-9]{{1,2}})(?:[-/.][0-9]{{1,2}})?$", 2, 1),
        numeric(rf"^([0-9]{{1,2}})[-/.]{year}$", 1, 2),
        numeric(rf"^([0-9]{{1,2}})[-/.][0-9]{{1,2}}[-/.]{year}$", 1, 2),
        named(rf"^{name},? ?{year}$", 1, 2),
        named(rf"^{name} [0-9]{{1,2}},? {year}$", 1, 2),
        named(rf"^[0-9]{{1,2}} {name},? {year}$", 1, 2),
        day_first(rf"^([0-9]{{2}})[-/.]([0-9]{{1,2}})[-/.]{year}$"),
        named(rf"^{year},? {name}$", 2, 1),
        named(rf"^{name} {ordinal},? {year}$", 1, 2),
        named(rf"^{ordinal} (?:of )?{name},? {year}$", 1, 2),
        short_year(rf"^{name},? ?['’]([0-9]{{2}})$", 1, 2),
        named(rf"{month_name},? +(?:{ordinal}|[0-9]{{1,2}})?,? *{year}\b", 1, 2),
        named(rf"\b{year},? +{month_name}", 2, 1),
        text,
    )


def month_index(c: Column | str, as_of: int) -> Column:
    """year * 12 + month; a bare year counts as January; 'Present' is the given month; else null."""

    def index(text: Column) -> Column:
        year = F.substring(text, 1, 4).try_cast("int")
        return (
            F.when(text == "Present", F.lit(as_of))
            .when(text.rlike("^[0-9]{4}$"), year * 12 + 1)
            .when(text.rlike("^[0-9]{4}-[0-9]{2}$"), year * 12 + F.substring(text, 6, 2).try_cast("int"))
        )

    return let(F.col(c) if isinstance(c, str) else c, index)


def split_range(start: Column, end: Column, mode: str = "safe") -> tuple[Column, Column]:
    """Packed ranges such as '2018 - Present' in one field.

    ``reference`` splits at every hyphen, also inside '2018-03'; ``safe`` leaves year-month values alone.
    """
    start, end = F.coalesce(start, F.lit("")), F.coalesce(end, F.lit(""))
    packed = start.contains("-")
    if mode == "safe":
        packed = packed & ~F.trim(start).rlike(r"^[0-9]{4}-[0-9]{2}$")
    only_start = packed & (end == "")
    both = packed & end.contains("-")
    if mode == "safe":
        both = both & ~F.trim(end).rlike(r"^[0-9]{4}-[0-9]{2}$")
    head = F.trim(F.substring_index(start, "-", 1))
    rest = F.trim(F.regexp_extract(start, r"(?s)^[^-]*-(.*)$", 1))
    new_start = F.when(only_start | both, head).otherwise(start)
    new_end = F.when(only_start, rest).when(both, F.trim(F.substring_index(end, "-", -1))).otherwise(end)
    return new_start, new_end


def tidy_range(start: Column, end: Column, months: Column, as_of: int) -> Column:
    """struct(end_date, duration_months): an inverted range ends at 'Present'; given months win; else the distance."""

    def close(r: Column) -> Column:
        inverted = F.coalesce(r["e"] < r["s"], F.lit(False))
        final = F.when(inverted, F.lit(as_of)).otherwise(r["e"])
        span = F.when(final >= r["s"], final - r["s"]).otherwise(F.lit(0))
        return F.struct(
            F.when(inverted, F.lit("Present")).otherwise(r["end"]).alias("end_date"),
            F.when(r["given"] != 0, r["given"]).otherwise(F.coalesce(span, F.lit(0))).cast("int").alias("duration_months"),
        )

    return let(
        F.struct(
            month_index(start, as_of).alias("s"), month_index(end, as_of).alias("e"), end.alias("end"),
            F.coalesce(months, F.lit(0)).alias("given"),
        ),
        close,
    )


def tidy_entry(start: Column, end: Column, months: Column, as_of: int, mode: str = "safe") -> Column:
    """struct(start_date, end_date, duration_months) of one experience entry, every step evaluated once per row."""

    def dated(raw: Column) -> Column:
        s, e = split_range(raw["s"], raw["e"], mode)
        return F.struct(parse_date(s).alias("s"), parse_date(e).alias("e"))

    def whole(r: Column) -> Column:
        return let(
            tidy_range(r["s"], r["e"], months, as_of),
            lambda t: F.struct(
                r["s"].alias("start_date"), t["end_date"].alias("end_date"), t["duration_months"].alias("duration_months")
            ),
        )

    return let(let(F.struct(start.alias("s"), end.alias("e")), dated), whole)


def role_weight(title: Column) -> Column:
    t = F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(t.contains("intern"), 0.5)
        .when(t.contains("freelance") | t.contains("self-employed"), 0.7)
        .when(t.contains("contract"), 0.8)
        .otherwise(1.0)
    )
