"""Expressions shared by the operators: parsing, dates, identifiers, robust scores, market impact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal-form words and share-class phrases that an issuer's name loses.
NAME_PHRASES = ["CL A", "CL B", "CL C", "CLASS A", "CLASS B", "CLASS C", "N V", "S A", "L P", "SER A", "SER B", "NEW COM", "COM NEW", "SPONSORED ADR"]
NAME_WORDS = [
    "INC", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LIMITED", "PLC", "LLC", "LP", "HOLDINGS", "HLDGS", "HLDG", "GROUP", "GRP", "TRUST", "TR", "THE",
    "COM", "NEW", "ADR", "ADS", "ORD", "SHS", "DEL", "NV", "SA", "AG", "SE", "COMMON", "STOCK", "SPONSORED", "INTL", "INTERNATIONAL",
]
#: Split ratios that a jump in a share count is matched with, and how closely.
SPLIT_RATIOS = [1.5, 2, 3, 4, 5, 6, 7, 8, 10, 15, 20, 25, 30, 50]
SPLIT_TOLERANCE = 0.04


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def number(c: Column) -> Column:
    """Money as printed: currency signs, commas, per cents and spaces go; brackets or a minus are negative; a dash is 0."""
    raw = F.trim(c)
    bare = F.regexp_replace(raw, r"[$,%\s()]", "")
    plain = bare.try_cast("double")
    return F.when(bare.isin("-", "—"), F.lit(0.0)).when(F.startswith(raw, F.lit("(")) & F.endswith(raw, F.lit(")")), -F.abs(plain)).otherwise(plain)


#: Forms of a printed date, in the order they are tried.
DATE_FORMS = ["yyyy-MM-dd", "M/d/yyyy", "M/d/yy", "MMMM d, yyyy", "MMM d, yyyy", "d MMM yyyy", "d MMMM yyyy"]


def date(c: Column, forms: list[str] | None = None) -> Column:
    """A printed date by the first form that fits; Sept is Sep; anything else is null."""
    clean = F.regexp_replace(F.trim(c), r"\bSept\b\.?", "Sep")
    return F.coalesce(*[F.try_to_date(clean, f) for f in forms or DATE_FORMS])


def days_inclusive(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def quarter_end(d: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))


def previous_quarter(period: Column) -> Column:
    return F.last_day(F.add_months(period, -3))


def next_quarter(day: Column) -> Column:
    return F.last_day(F.add_months(day, 3))


def previous_month(month: Column) -> Column:
    return F.date_sub(F.trunc(month, "month"), 1)


def formation_date(period: Column) -> Column:
    """When a quarter's holdings are taken as public: the end of the second month after it."""
    return F.last_day(F.add_months(period, 2))


def issuer_name(c: Column) -> Column:
    """Upper case, letters and digits only, without share-class phrases and legal-form words."""
    s = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), r"[^A-Z0-9 ]+", " "), r"\s+", " ")), F.lit(" "))
    for phrase in NAME_PHRASES:
        s = F.replace(s, F.lit(f" {phrase} "), F.lit(" "))
    return F.array_join(F.filter(F.split(F.trim(s), r"\s+"), lambda t: ~t.isin(*NAME_WORDS) & (t != "")), " ")


def last4(c: Column) -> Column:
    return F.right(F.regexp_replace(c, r"[^0-9]", ""), F.lit(4))


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), F.lit("-"))


def clip(c: Column, lo: float, hi: float) -> Column:
    """Within lo and hi; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def matches(a: Column, b: Column, floor: float = 1.0, share: float = 1e-4) -> Column:
    """Equal up to one unit or a basis point of the larger; false where either is null."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(floor), F.lit(share) * F.greatest(F.abs(a), F.abs(b))), F.lit(False))


def robust_z(x: Column, over, least: int = 10, limit: float = 3.0) -> Column:
    """z-score within a window, clipped; null with fewer than ten values or no spread."""
    sd = F.stddev_samp(x).over(over)
    z = (x - F.avg(x).over(over)) / F.nullif(sd, F.lit(0.0))
    return F.when(F.count(x).over(over) >= least, clip(z, -limit, limit))


def split_ratio(jump: Column) -> Column:
    """The known ratio that a jump of share counts matches, its inverse for a reverse split, else 1."""
    ups = F.array(*[F.lit(float(k)) for k in SPLIT_RATIOS])
    hit = F.filter(ups, lambda k: (F.abs(jump / k - 1) <= SPLIT_TOLERANCE) | (F.abs(jump * k - 1) <= SPLIT_TOLERANCE))
    first = F.get(hit, F.lit(0))
    return F.when(first.isNull() | jump.isNull(), F.lit(1.0)).when(F.abs(jump / first - 1) <= SPLIT_TOLERANCE, first).otherwise(1 / first)


def market_impact(share_of_day: Column, daily_sd: Column, spread: float = 0.0010) -> Column:
    """Cost of a trade: ten basis points and the daily deviation times the root of its share of a day's volume."""
    return F.lit(spread) + daily_sd * F.sqrt(share_of_day)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution, by a rational approximation good to 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def mean_of(values: list[Column]) -> Column:
    """Mean of those that aren't null."""
    kept = F.filter(F.array(*values), lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda s, v: s + v), F.size(kept).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
