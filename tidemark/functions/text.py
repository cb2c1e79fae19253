"""Text expressions: tokens, shingles, narrative signals, locale numbers, normalised quotes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: patterns of the three narrative signals, on lower-cased text. (?U) gives word
# boundaries and digits their Unicode meaning.
QUANTITY = r"(?U)\b\d+(?:\.\d+)?\s*(?:%|percent\b|mt\b|gj\b|kl\b|tco2e\b)"
TARGET_WORD = r"(?U)\b(?:target|commit|reduce|achieve)\w*\b"
DATED = r"(?U)\b(?:by|before|until)\s+(?:fy\s*)?20\d{2}\b"
METHOD = r"(?U)\b(?:ghg protocol|iso\s*\d+|gri|sasb|science based targets|methodology)\b"
SIGNALS = ("quantified_target", "dated_commitment", "methodology")

# fixed values: words of a nil answer, number pattern, scale words and range words
NIL_WORDS = ("nil", "none", "zero", "-", "—")
NUMBER = r"[-+]?[0-9][0-9,]*(?:\.[0-9]+)?"
SCALES = (("lakh", 100_000), ("lac", 100_000), ("crore", 10_000_000))
RANGE_WORD = r"\b(?:to|through)\b|[–—]"
FIRST_NUMBER = r"(?<![A-Za-z])([0-9][0-9,]*(?:\.[0-9]+)?)"
TRUE_WORDS = ("yes", "approved", "available")


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(word_list: Column, n: int) -> Column:
    """Every run of ``n`` words, joined by blanks; empty for shorter lists.

    ``word_list`` must be a plain column: an expression would be worked out again for every run.
    """
    # The guard matters: sequence(1, -3) would count downwards.
    starts = F.when(F.size(word_list) >= n, F.sequence(F.lit(1), F.size(word_list) - n + 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.array_join(F.slice(word_list, i, n), " "))


def digest(text: Column) -> Column:
    """SHA-256 of a text as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def short_digest(text: Column) -> Column:
    """First 16 bytes of the digest: the part of a phrase that is shuffled and joined on."""
    return F.substring(digest(text), 1, 16)


def tokens(text: Column) -> Column:
    """Parts between white space of the lower-cased text."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != "")


def token_set(text: Column) -> Column:
    """Distinct words of three or more characters."""
    return F.array_distinct(F.filter(words(text), lambda t: F.length(t) > 2))


def narrative_signals(text: Column) -> dict[str, Column]:
    """Quantity together with a target word, dated commitment, named method."""
    lowered = F.lower(text)
    found = (
        lowered.rlike(QUANTITY) & lowered.rlike(TARGET_WORD),
        lowered.rlike(DATED),
        lowered.rlike(METHOD),
    )
    return {name: F.coalesce(hit, F.lit(False)) for name, hit in zip(SIGNALS, found, strict=True)}


def count_of(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def classify(text: Column, kinds: Sequence[tuple[str, Sequence[str]]], other: str = "other") -> Column:
    """Kind with most term occurrences; the earlier kind wins a tie, no occurrence gives ``other``."""
    lowered = F.lower(text)
    counts = [sum((count_of(lowered, t) for t in terms[1:]), count_of(lowered, terms[0])) for _, terms in kinds]
    best = F.greatest(*counts) if len(counts) > 1 else counts[0]
    out = F.lit(other)
    for (kind, _), count in reversed(list(zip(kinds, counts, strict=True))):
        out = F.when((count == best) & (best > 0), F.lit(kind)).otherwise(out)
    return out


def normalised(text: Column) -> Column:
    """White space collapsed, case folded."""
    lowered = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(lowered, r"(?U)\s+", " "))


def is_verbatim(quote: Column, source: Column) -> Column:
    """Whether the normalised quote is not empty and occurs in the normalised source."""
    q = normalised(quote)
    return F.coalesce((q != "") & normalised(source).contains(q), F.lit(False))


def parse_numbers(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Add a struct (value, lower, upper, is_percent, is_nil) of a locale-formatted amount.

    Nil words are 0, lakh and crore scale the number, a range gives its middle and bounds,
    otherwise the first number counts. The value is null when there is no number. The steps are
    columns of their own, so that the patterns run once per row.
    """
    text = F.lower(F.trim(raw))
    text = F.replace(F.replace(text, F.lit("₹"), F.lit("")), F.lit("inr"), F.lit(""))
    rows = df.withColumn("__text", text)
    scale = F.lit(1)
    for word, factor in reversed(SCALES):
        scale = F.when(F.col("__text").rlike(rf"(?U)\b{word}s?\b"), factor).otherwise(scale)
    # The first two numbers are all that is ever used; the split leaves the rest of a text alone.
    rows = rows.withColumns(
        {
            "__found": F.slice(F.regexp_extract_all("__text", F.lit(NUMBER), F.lit(0)), 1, 2),
            "__scale": scale,
            "__nil": F.col("__text").isin(list(NIL_WORDS)),
        }
    )

    def number(place: int) -> Column:
        digits = F.replace(F.try_element_at("__found", F.lit(place)), F.lit(","), F.lit(""))
        return (digits.try_cast("decimal(28,6)") * F.col("__scale")).cast("decimal(38,6)")

    is_range = ~F.col("__nil") & (F.size("__found") >= 2) & F.col("__text").rlike(f"(?U){RANGE_WORD}")
    rows = rows.withColumns({"__first": number(1), "__second": number(2), "__range": is_range})
    first, second = F.col("__first"), F.col("__second")
    middle = ((first + second) / F.lit(2)).cast("decimal(38,6)")
    value = F.when(F.col("__nil"), F.lit(0)).when(F.col("__range"), middle).otherwise(first)
    percent = F.col("__text").contains("%") | F.col("__text").contains("percent")
    parsed = F.struct(
        value.cast("decimal(38,6)").alias("value"),
        F.when(F.col("__range"), F.least(first, second)).alias("lower"),
        F.when(F.col("__range"), F.greatest(first, second)).alias("upper"),
        (~F.col("__nil") & first.isNotNull() & percent).alias("is_percent"),
        F.col("__nil").alias("is_nil"),
    )
    return rows.withColumn(out, parsed).drop("__text", "__found", "__scale", "__nil", "__first", "__second", "__range")


def candidate_value(dtype: Column, text: Column) -> Column:
    """Value that a text offers for a field: first number, yes/no words, or the text itself."""
    number = F.replace(F.nullif(F.regexp_extract(text, FIRST_NUMBER, 1), F.lit("")), F.lit(","), F.lit(""))
    lowered = F.lower(text)
    yes = F.lit(False)
    for word in TRUE_WORDS:
        yes = yes | lowered.contains(word)
    return (
        F.when(dtype == "number", number)
        .when(dtype == "integer", F.floor(number.try_cast("double")).cast("string"))
        .when(dtype == "boolean", yes.cast("string"))
        .otherwise(F.nullif(F.substring(F.trim(text), 1, 500), F.lit("")))
    )
