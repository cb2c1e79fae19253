"""Exact decimal numbers in text, of any scale, without rounding before they are compared."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sign, whole digits, fraction digits (with or without whole ones), exponent of up to three digits.
FORM = r"^([+-]?)(?:([0-9]+)\.?([0-9]*)|\.([0-9]+))(?:[eE]([+-]?[0-9]{1,3}))?$"
PLACES = 36  # fraction digits that sums carry; two decimals hold 38 whole and these


def with_plain(df: DataFrame, out: str, text: Column) -> DataFrame:
    """``out``: the number in ``text`` written without exponent, plus sign or leading zeros; null if it is none.

    Worked out in steps, each a column of its own, so that no step is evaluated twice.
    """
    part = lambda k: F.col("__form")[k]
    start = F.greatest("__point", F.lit(0))
    whole = F.ltrim(F.rpad(F.substring("__digits", F.lit(1), start), start, F.lit("0")), F.lit("0"))
    rest = F.concat(F.repeat(F.lit("0"), F.greatest(-F.col("__point"), F.lit(0))), F.substring("__digits", start + 1, F.length("__digits")))
    df = df.withColumn("__form", F.when(text.rlike(FORM), F.split(F.regexp_replace(text, FORM, "$1 $2 $3$4 $5"), " ")))
    df = df.withColumns({"__digits": F.concat(part(1), part(2)), "__point": F.length(part(1)) + F.coalesce(part(3).try_cast("int"), F.lit(0))})
    df = df.withColumns({"__whole": whole, "__rest": rest})
    sign, dot = F.when(part(0) == "-", "-").otherwise(""), F.when(F.col("__rest") == "", "").otherwise(".")
    number = F.concat(sign, F.when(F.col("__whole") == "", "0").otherwise(F.col("__whole")), dot, "__rest")
    return df.withColumn(out, number).drop("__form", "__digits", "__point", "__whole", "__rest")


def whole_digits(number: Column) -> Column:
    """Digits before the point of a plain number, without its sign."""
    return F.regexp_extract(number, r"^-?([0-9]+)", 1)


def fraction_digits(number: Column) -> Column:
    return F.regexp_extract(number, r"\.([0-9]+)$", 1)


def is_whole(number: Column) -> Column:
    """No digit but zeros after the point."""
    return number.rlike(r"^-?[0-9]+(?:\.0*)?$")


def within_percent(number: Column) -> Column:
    """From 0 to 100, both included, by the digits."""
    zero = number.rlike(r"^-?0(?:\.0*)?$")
    below = ~number.startswith("-") & (F.length(whole_digits(number)) < 3)
    return zero | below | number.rlike(r"^100(?:\.0*)?$")


def parts(number: Column) -> tuple[Column, Column]:
    """Whole and fraction as signed decimals; null whole beyond 38 digits."""
    sign = F.when(number.startswith("-"), F.lit("-")).otherwise("")
    fraction = F.concat(sign, F.lit("0."), F.rpad(fraction_digits(number), PLACES, "0"))
    return F.concat(sign, whole_digits(number)).try_cast("decimal(38,0)"), fraction.try_cast(f"decimal(38,{PLACES})")


def total(pairs: Sequence[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Sum of (whole, fraction) pairs, each part for itself; the fraction may exceed one."""
    whole, fraction = pairs[0]
    for more_whole, more_fraction in pairs[1:]:
        whole, fraction = (whole + more_whole).cast("decimal(38,0)"), (fraction + more_fraction).cast(f"decimal(38,{PLACES})")
    return whole, fraction


def difference(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return (a[0] - b[0]).cast("decimal(38,0)"), (a[1] - b[1]).cast(f"decimal(38,{PLACES})")


def with_settled(df: DataFrame, name: str, pair: tuple[Column, Column]) -> DataFrame:
    """``name``_negative, ``name``_whole and ``name``_fraction (below one): sign and absolute value of a pair."""
    w, f, negative = (F.col(f"{name}_{x}") for x in ("whole", "fraction", "negative"))
    carry = F.floor(pair[1]).cast("decimal(2,0)")  # narrow, so that the difference below keeps its places
    df = df.withColumns({f"{name}_whole": (pair[0] + carry).cast("decimal(38,0)"), f"{name}_fraction": (pair[1] - carry).cast(f"decimal(38,{PLACES})")})
    df = df.withColumn(f"{name}_negative", w < 0)
    zero, one = F.lit(Decimal(0)).cast("decimal(38,0)"), F.lit(Decimal(1)).cast(f"decimal(38,{PLACES})")
    size = F.when(negative & (f > 0), zero - w - 1).when(negative, zero - w).otherwise(w)
    rest = F.when(negative & (f > 0), one - f).otherwise(f)
    return df.withColumns({f"{name}_whole": size.cast("decimal(38,0)"), f"{name}_fraction": rest.cast(f"decimal(38,{PLACES})")})


def exceeds(name: str, tolerance: str) -> Column:
    """Whether a settled absolute value is larger than the tolerance."""
    limit, whole = Decimal(tolerance), F.col(f"{name}_whole")
    integer = F.lit(Decimal(int(limit))).cast("decimal(38,0)")
    fraction = F.lit(limit - int(limit)).cast(f"decimal(38,{PLACES})")
    return (whole > integer) | ((whole == integer) & (F.col(f"{name}_fraction") > fraction))


def shown(name: str, places: Column) -> Column:
    """A settled value as text with this many places."""
    digits = F.substring(F.split(F.col(f"{name}_fraction").cast("string"), r"\.")[1], F.lit(1), places)
    text = F.concat(F.col(f"{name}_whole").cast("string"), F.when(places > 0, F.concat(F.lit("."), digits)).otherwise(""))
    return F.concat(F.when(F.col(f"{name}_negative"), "-").otherwise(""), text)
