"""Column expressions: every function takes and returns Columns, so the plan stays inside codegen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- null rules

def holds(condition: Column) -> Column:
    """A comparison that treats an unknown operand as false."""
    return F.coalesce(condition, F.lit(False))


def flag(condition: Column) -> Column:
    """0/1 integer flag with unknown counted as 0."""
    return holds(condition).cast("int")


def finite_or_null(x: ColumnLike) -> Column:
    x = _c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def number(x: ColumnLike) -> Column:
    """Numeric coercion: text that is no number becomes NULL instead of an ANSI error, NaN and inf too."""
    return finite_or_null(_c(x).try_cast("double"))


def day_of(x: ColumnLike) -> Column:
    """Calendar day of a timestamp or text (year first, parts by - or /, a time may follow), NULL when it cannot be read."""
    text = F.regexp_replace(F.trim(_c(x).cast("string")), r"^(\d{4})/(\d{1,2})/(\d{1,2})(?=$|[ T])", "$1-$2-$3")
    return F.to_date(F.try_to_timestamp(text))


def text_or_empty(x: ColumnLike) -> Column:
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def safe_divide(num: ColumnLike, den: ColumnLike) -> Column:
    """NULL instead of a division error on a zero denominator."""
    den = _c(den)
    return _c(num) / F.when(den != 0, den)


# ---------------------------------------------------------------- aggregates

def sum_or_zero(x: ColumnLike) -> Column:
    return F.coalesce(F.sum(_c(x)), F.lit(0.0))


def pearson(a: ColumnLike, b: ColumnLike) -> Column:
    """Pearson r over pair-complete rows, NULL (not an error) for a constant side."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    complete = a.isNotNull() & b.isNotNull()
    x, y = F.when(complete, a), F.when(complete, b)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.when(spread > 0, spread)


def pair_count(a: ColumnLike, b: ColumnLike) -> Column:
    return F.count_if(_c(a).isNotNull() & _c(b).isNotNull())


def percent_of(part: Column, whole: Column) -> Column:
    return F.coalesce(part * 100.0 / F.when(whole > 0, whole), F.lit(0.0))


# ---------------------------------------------------------------- weather and comfort

def weather_severity(precip: ColumnLike, wind: ColumnLike, light: float = 0.0, heavy: float = 10.0,
                     strong: float = 8.0) -> Column:
    """Additive score 0..3: rain at all, heavy rain, strong wind."""
    precip, wind = _c(precip), _c(wind)
    return F.least(F.lit(3), flag(precip > light) + flag(precip > heavy) + flag(wind > strong))


def discomfort_index(temp: ColumnLike, humidity: ColumnLike, terms: Sequence[float] | None = None) -> Column:
    """Temperature-humidity index of degrees and percent, as published (its coefficients are fixed values), or with the ``terms`` of
    the temperature, of the product, of the humidity, and the constant."""
    t, h = _c(temp), _c(humidity)
    if terms is None:
        return 0.81 * t + 0.01 * h * (0.99 * t - 14.3) + 46.3
    by_temp, by_both, by_humidity, base = terms
    return by_temp * t + by_both * t * h + by_humidity * h + base


def wind_chill(temp: ColumnLike, wind_ms: ColumnLike) -> Column:
    """Wind chill of the 2001 North American standard; outside its range (or wind unknown) the temperature itself."""
    temp, kmh = _c(temp), _c(wind_ms) * 3.6
    power = F.pow(F.greatest(kmh, F.lit(0.1)), F.lit(0.16))
    chill = 13.12 + 0.6215 * temp - 11.37 * power + 0.3965 * temp * power
    return F.when(holds((temp <= 10) & (kmh > 4.8)), chill).otherwise(temp)


# ---------------------------------------------------------------- binning

def cut(x: ColumnLike, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed fixed bins; values outside every bin become NULL."""
    x = _c(x)
    pairs = zip(edges[:-1], edges[1:], labels, strict=True)
    return F.coalesce(*[F.when((x > lo) & (x <= hi), F.lit(label)) for lo, hi, label in pairs])


def bin_by_edges(x: ColumnLike, edges: Column) -> Column:
    """Struct(left, right, mid) of the right-closed bin holding x, lowest edge included; edges is an array column."""
    x = _c(x)
    inner = F.filter(F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0))), lambda e: e < x)
    at = F.size(inner) + 1
    left, right = F.get(edges, at - 1), F.get(edges, at)
    inside = (x >= F.get(edges, F.lit(0))) & (x <= F.get(edges, F.size(edges) - 1))
    return F.when(inside & right.isNotNull(),
                  F.struct(left.alias("left"), right.alias("right"), ((left + right) / 2).alias("mid")))


# ---------------------------------------------------------------- text

def contains_any(text: ColumnLike, words: Iterable[str]) -> Column:
    """True where any word occurs in the whole text; NULL text is no hit."""
    text = text_or_empty(text)
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def first_word(text: ColumnLike, words: Sequence[str]) -> Column:
    """First word of the list (list order, not text order) that occurs in the text."""
    text = text_or_empty(text)
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words], F.lit(None).cast("string"))


def joined_text(columns: Sequence[ColumnLike]) -> Column:
    """Columns joined by one blank each, NULL as empty text (the blanks stay)."""
    return F.concat_ws(" ", *[text_or_empty(c) for c in columns])


def matches_any(columns: Sequence[ColumnLike], pattern: str) -> Column:
    """Pattern found in any of the columns."""
    return reduce(lambda a, b: a | b, [holds(_c(c).cast("string").rlike(pattern)) for c in columns], F.lit(False))


def has_text(x: ColumnLike, part: str) -> Column:
    return holds(F.contains(_c(x).cast("string"), F.lit(part)))


def first_number(x: ColumnLike) -> Column:
    """First run of digits in a text as a number."""
    return F.regexp_extract(text_or_empty(x), r"(\d+)", 1).try_cast("double")


def canonical_label(x: ColumnLike, labels: Sequence[str], other: str = "Other") -> Column:
    """First label contained in the value, else ``other``."""
    x = text_or_empty(x)
    return F.coalesce(*[F.when(F.contains(x, F.lit(v)), F.lit(v)) for v in labels], F.lit(other))


def mapped(x: ColumnLike, mapping: Mapping[str, float]) -> Column:
    """Category to number by a small literal map; unmatched becomes NULL."""
    pairs = [F.lit(v) for item in mapping.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), _c(x))


def file_stem(path: ColumnLike) -> Column:
    return F.regexp_extract(_c(path), r"([^/]+?)(?:\.[^./]*)?$", 1)


# Markers a scraped table uses for a missing cell.
MISSING_MARKERS = ("--", "///", "×", "nan", "NaN", "#", "")


def clean_cell(x: ColumnLike) -> Column:
    """Scraped cell: missing markers to empty, trailing quality brackets off."""
    x = F.trim(text_or_empty(x))
    return F.when(x.isin(*MISSING_MARKERS), F.lit("")).otherwise(F.trim(F.regexp_replace(x, r"[)\]]+$", "")))


def hour_ending(day: ColumnLike, hour: ColumnLike) -> Column:
    """Timestamp of a day and an hour 0..24, where 24 is midnight of the next day."""
    return F.to_timestamp_ntz(_c(day).cast("string")) + F.make_interval(hours=_c(hour).cast("int"))


# ---------------------------------------------------------------- bands

def stars(p: ColumnLike) -> Column:
    p = _c(p)
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def signal_band(r: ColumnLike, strong: float = 0.4, moderate: float = 0.2) -> Column:
    r = F.abs(_c(r))
    return F.when(r > strong, "strong").when(r > moderate, "moderate").otherwise("weak")


def effect_size(r2: ColumnLike) -> Column:
    """Cohen's f squared, infinite for a perfect fit."""
    r2 = _c(r2)
    return F.when(r2 < 1, r2 / (1 - r2)).otherwise(F.when(r2.isNotNull(), F.lit(float("inf"))))


def effect_band(f2: ColumnLike) -> Column:
    f2 = _c(f2)
    return F.when(f2 >= 0.35, "large").when(f2 >= 0.15, "medium").when(f2 >= 0.02, "small").otherwise("negligible")


def autocorrelation_free(dw: ColumnLike) -> Column:
    return _c(dw).between(1.5, 2.5)
