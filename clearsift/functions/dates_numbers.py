"""Dates, numbers, boxes and percentiles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names.
MONTHS = "januari februari maret april mei juni juli agustus september oktober november desember".split()


def month_number(name: Column) -> Column:
    """1 to 12, or null for an unknown name."""
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name)), F.lit(0))


def _date(y: Column, m: Column, d: Column) -> Column:
    """A date, or null if there is none such."""
    text = F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int"))
    return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def parse_date(x: Column) -> Column:
    """A date from an ISO beginning, 'Month d, yyyy' or 'd/m/yyyy'; anything else and impossible days give null."""
    s = F.trim(x)
    part = lambda p, i: F.nullif(F.regexp_extract(s, p, i), F.lit(""))
    iso, named, slashed = r"^(\d{4})-(\d{2})-(\d{2})", r"^([A-Za-z]+)\s+(\d{1,2}),\s*(\d{4})", r"^(\d{1,2})/(\d{1,2})/(\d{4})"
    return (
        F.when(s.rlike(iso), _date(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(s.rlike(named), _date(part(named, 3), month_number(part(named, 1)), part(named, 2)))
        .when(s.rlike(slashed), _date(part(slashed, 3), part(slashed, 2), part(slashed, 1)))
    )


def dates_near(a: Column, b: Column, days: int = 7) -> Column:
    """Whether two dates are at most so many days apart; a missing one is near any."""
    return a.isNull() | b.isNull() | (F.abs(F.datediff(a, b)) <= days)


def year_bucket(d: Column, missing: str = "tanpa tanggal") -> Column:
    return F.coalesce(F.year(d).cast("string"), F.lit(missing))


def long_date(d: Column) -> Column:
    names = F.array(*[F.lit(m.capitalize()) for m in MONTHS])
    return F.concat_ws(" ", F.day(d).cast("string"), F.element_at(names, F.month(d)), F.year(d).cast("string"))


def number_value(literal: Column, scale: int = 12) -> Column:
    """The value of a number literal, with up to `scale` decimal places. Several separators, or three digits after the last one,
    mean thousands; any other separator is a decimal one."""
    thousands = literal.rlike(r"[.,]\d{3}$|[.,].*[.,]")
    return F.when(thousands, F.regexp_replace(literal, "[.,]", "")).otherwise(F.regexp_replace(literal, ",", ".")).try_cast(f"decimal(38,{scale})")


#: Multipliers that follow a number.
MULTIPLIERS = {"ribu": 1_000, "rb": 1_000, "juta": 1_000_000, "jt": 1_000_000, "miliar": 1_000_000_000, "milyar": 1_000_000_000, "triliun": 1_000_000_000_000}
_NUMBER = r"\d+(?:[.,]\d+)*(?:\s*(?:ribu|rb|juta|jt|miliar|milyar|triliun)\b)?"


def numbers_in(x: Column) -> Column:
    """Distinct values of the numbers in a text, multiplier words applied."""
    found = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(_NUMBER), F.lit(0))

    def value(m: Column) -> Column:
        word = F.regexp_extract(m, "[a-z]+$", 0)
        times = F.lit(1)
        for name, factor in MULTIPLIERS.items():
            times = F.when(word == name, F.lit(factor)).otherwise(times)
        return (number_value(F.regexp_extract(m, r"^[\d.,]*\d", 0), 6) * times).cast("decimal(38,6)")

    return F.array_compact(F.array_distinct(F.transform(found, value)))


def duration_seconds(x: Column) -> Column:
    """'2m59.56s', '50ms', '1h', '6' in seconds; null for anything else."""
    whole = F.trim(x).rlike(r"^(?:\d+(?:\.\d+)?(?:ms|h|m|s))+$")
    parts = F.regexp_extract_all(x, F.lit(r"\d+(?:\.\d+)?(?:ms|h|m|s)"), F.lit(0))

    def seconds(p: Column) -> Column:
        unit, n = F.regexp_extract(p, "[a-z]+$", 0), F.regexp_extract(p, r"^[\d.]+", 0).cast("double")
        return n * F.when(unit == "ms", F.lit(0.001)).when(unit == "h", F.lit(3600.0)).when(unit == "m", F.lit(60.0)).otherwise(F.lit(1.0))

    return F.when(F.trim(x).rlike(r"^\d+(?:\.\d+)?$"), F.trim(x).cast("double")).when(whole, F.aggregate(F.transform(parts, seconds), F.lit(0.0), lambda a, b: a + b))


def unit_score(x: Column) -> Column:
    """Clamped to [0, 1], four digits, half to even."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 4)


def fit_within(width: Column, height: Column, most: int) -> Column:
    """(width, height) scaled down so that the longer side is at most `most`."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    side = lambda x: F.greatest(F.lit(1), F.bround(x * scale).cast("int"))
    return F.struct(side(width).alias("w"), side(height).alias("h"))


def view_to_pixels(box: Column, view: Column, image: Column) -> Column:
    """A box (l, t, r, b) drawn on a view of an image fitted inside it, in whole pixels of the image, at least one."""
    scale = F.least(view["w"] / image["w"], view["h"] / image["h"])
    dx, dy = (view["w"] - image["w"] * scale) / 2, (view["h"] - image["h"] * scale) / 2
    low = lambda v, d, n: F.greatest(F.lit(0), F.least(n - 1, F.floor((v - d) / scale + 1e-3))).cast("int")
    high = lambda v, d, n, a: F.greatest(a + 1, F.least(n, F.ceil((v - d) / scale - 1e-3))).cast("int")
    x, y = low(box["l"], dx, image["w"]), low(box["t"], dy, image["h"])
    return F.struct(x.alias("x"), y.alias("y"), (high(box["r"], dx, image["w"], x) - x).alias("w"), (high(box["b"], dy, image["h"], y) - y).alias("h"))


def centre_y(box: Column) -> Column:
    """The mean height of a box's corners; 0 without corners."""
    total = F.aggregate(box, F.lit(0.0), lambda a, p: a + p["y"])
    return F.when(F.size(box) > 0, total / F.size(box)).otherwise(F.lit(0.0))


def nearest_rank(values: Column, share: float) -> Column:
    """The element at index round(share * (n - 1)), half to even, of the sorted values."""
    n = F.size(values)
    return F.get(F.sort_array(values), F.bround(F.lit(share) * (n - 1), 0).cast("int"))
