"""Rule validation of many filings at once.

``answers``: filing_id, field_key, value, unit, author, review_status, evidence - one row per
filing and field. The form (:class:`FieldDef`, :class:`Relation`) is configuration; it is compiled
into the plan, so a filing's answers are shuffled once, by filing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import numbers as num
from tidemark.functions.exprs import rule_table
from tidemark.operators.ranking import first_per_key

FIELD_KEY_PATTERN = r"^(a|b|p[1-9])\.[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)+$"  # fixed value: format of field keys
DTYPES = ("text", "number", "integer", "boolean", "date")  # fixed values
FINDING = ("filing_id", "severity", "field_key", "message", "tier")

# What findings say.
EMPTY, WHOLE, NUMERIC = "Value cannot be empty", "Expected a whole number", "Expected a number"
BOOLEAN, ISO_DATE, JSON_ROWS = "Expected true/false or yes/no", "Expected an ISO date", "Repeating groups must be a JSON array"
UNIT, PERCENT, UNKNOWN = "Expected unit ", "Percentage must be between 0 and 100", "Unknown field"
MACHINE_MESSAGE, MISSING_MESSAGE = "AI-proposed answer has not been reviewed", "Required answer is missing"
SHORT_NAME_PREFIX = "a.basics."  # fixed value: where the short names of conditions live


@dataclass(frozen=True)
class FieldDef:
    field_key: str
    principle: str
    dtype: str = "text"
    unit: str | None = None
    required: bool = True
    leadership: bool = False
    condition: tuple[str, str] | None = None  # (field key or its short name, value it must have)
    core: bool = False
    repeating: bool = False


@dataclass(frozen=True)
class Relation:
    target: str
    operands: Sequence[str]
    tolerance: str = "0"


def form_table(spark, form: Sequence[FieldDef]) -> DataFrame:  # noqa: ANN001 - a session
    """The form's fields as a table; its size is that of the form."""
    rows = [(f.field_key, f.principle, f.dtype, f.unit, f.repeating, f.core) for f in form]
    columns = ["field_key", "principle", "dtype", "expected_unit", "repeating", "core"]
    table = rule_table(spark, columns, rows)
    return table.withColumn("expected_unit", F.col("expected_unit").cast("string"))


def finding(severity: str, message: Column | str, tier: str) -> list[Column]:
    text = F.lit(message) if isinstance(message, str) else message
    return ["filing_id", F.lit(severity).alias("severity"), "field_key", text.alias("message"), F.lit(tier).alias("tier")]


def _with_form(answers: DataFrame, form: Sequence[FieldDef], how: str) -> DataFrame:
    return answers.join(F.broadcast(form_table(answers.sparkSession, form)), "field_key", how)  # configuration


def _numbered(answers: DataFrame) -> DataFrame:
    """With ``__number``: the value as a plain number, thousands separators taken out; null if it is none or no rule asks."""
    asked = F.col("dtype").isin("integer", "number") | (F.col("expected_unit") == "percent")
    return num.with_plain(answers, "__number", F.when(asked, F.replace(F.trim("value"), F.lit(","), F.lit(""))))


def _value_error() -> Column:
    """First rule that a value breaks, or null; needs the form's columns and ``__number``."""
    text, number = F.trim("value"), F.col("__number")
    lowered, dtype = F.lower(text), F.col("dtype")
    json_array = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("ARRAY"), F.lit(False))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", EMPTY)
        .when((dtype == "integer") & ~F.coalesce(num.is_whole(number), F.lit(False)), WHOLE)
        .when((dtype == "number") & number.isNull(), NUMERIC)
        .when((dtype == "boolean") & ~lowered.isin("true", "false", "yes", "no"), BOOLEAN)
        .when((dtype == "date") & iso.isNull(), ISO_DATE)
        .when(F.col("repeating") & ~json_array, JSON_ROWS)
        .when(
            F.col("expected_unit").isNotNull() & ~F.col("unit").eqNullSafe(F.col("expected_unit")),
            F.concat(F.lit(UNIT), F.col("expected_unit")),
        )
        .when((F.col("expected_unit") == "percent") & ~F.coalesce(num.within_percent(number), F.lit(False)), PERCENT)
    )


def check_values(answers: DataFrame, form: Sequence[FieldDef]) -> DataFrame:
    """Known answers with ``normalised`` and ``error``: the first rule that the value breaks, or null.

    Whole numbers, numbers with thousands separators, yes/no words, ISO dates, JSON arrays for
    repeating groups, the expected unit, and percentages from 0 to 100.
    """
    text, number, dtype = F.trim("value"), F.col("__number"), F.col("dtype")
    integer = F.regexp_replace(F.regexp_replace(number, r"\..*$", ""), "^-0$", "0")
    normal = (
        F.when(dtype == "integer", integer)
        .when(dtype == "number", number)
        .when(dtype == "boolean", F.when(F.lower(text).isin("true", "yes"), "true").otherwise("false"))
        .otherwise(text)
    )
    checked = _numbered(_with_form(answers, form, "inner")).withColumn("error", _value_error())
    return checked.withColumn("normalised", F.when(F.col("error").isNull(), normal)).drop("__number")


def value_findings(answers: DataFrame, form: Sequence[FieldDef]) -> DataFrame:
    wrong = check_values(answers, form).where(F.col("error").isNotNull())
    return wrong.select(*finding("error", F.col("error"), "L1"))


def unknown_fields(answers: DataFrame, form: Sequence[FieldDef]) -> DataFrame:
    """Answers to fields that the form does not have."""
    known = F.broadcast(form_table(answers.sparkSession, form).select("field_key"))  # configuration
    return answers.join(known, "field_key", "left_anti").select(*finding("error", UNKNOWN, "L1"))


def _machine() -> Column:
    """Proposed by a machine and reviewed by nobody."""
    return F.coalesce((F.col("author") == "ai") & (F.col("review_status") == "unreviewed"), F.lit(False))


def _finding_struct(severity: str, key: Column, message: Column | str, tier: str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(
        F.lit(severity).alias("severity"), key.alias("field_key"), text.alias("message"), F.lit(tier).alias("tier")
    )




def answer_findings(answers: DataFrame, form: Sequence[FieldDef]) -> DataFrame:
    """Findings that one answer shows by itself, in one pass without a shuffle: unknown field,
    broken value rule, unreviewed machine answer."""
    key = F.col("field_key")
    rows = _numbered(_with_form(answers, form, "left")).withColumn("__error", F.when(F.col("dtype").isNotNull(), _value_error()))
    found = F.array(
        F.when(F.col("dtype").isNull(), _finding_struct("error", key, UNKNOWN, "L1")),
        F.when(F.col("__error").isNotNull(), _finding_struct("error", key, F.col("__error"), "L1")),
        F.when(_machine(), _finding_struct("error", key, MACHINE_MESSAGE, "L3")),
    )
    return rows.select("filing_id", F.inline(F.array_compact(found))).select(*FINDING)


def _relation_numbers(relations: Sequence[Relation]) -> tuple[list[Column], dict[str, str]]:
    """Aggregates that pick each needed number of a filing (from ``__plain``), and their names by field."""
    keys = sorted({k for r in relations for k in (r.target, *r.operands)})
    name = {key: f"n{i}" for i, key in enumerate(keys)}
    return [F.max(F.when(F.col("field_key") == key, F.col("__plain"))).alias(alias) for key, alias in name.items()], name


def _with_broken_relations(filings: DataFrame, relations: Sequence[Relation], name: dict[str, str]) -> DataFrame:
    """``broken``: a finding per relation whose numbers are all there and do not add up."""
    columns = {}
    for alias in name.values():
        columns[f"{alias}_w"], columns[f"{alias}_f"] = num.parts(F.col(alias))
    filings = filings.withColumns(columns)
    pair = lambda key: (F.col(f"{name[key]}_w"), F.col(f"{name[key]}_f"))
    checks = []
    for i, relation in enumerate(relations):
        expected = num.total([pair(key) for key in relation.operands])
        filings = num.with_settled(filings, f"e{i}", expected)
        filings = num.with_settled(filings, f"d{i}", num.difference(pair(relation.target), expected))
        places = [F.length(num.fraction_digits(F.col(name[key]))) for key in relation.operands]
        filings = filings.withColumn(f"p{i}", F.greatest(*places) if len(places) > 1 else places[0])
        message = F.concat(
            F.lit("Total "), F.col(name[relation.target]), F.lit(" does not equal component sum "), num.shown(f"e{i}", F.col(f"p{i}"))
        )
        finding_ = _finding_struct("error", F.lit(relation.target), message, "L2")
        checks.append(F.when(num.exceeds(f"d{i}", relation.tolerance), finding_))
    return filings.withColumn("broken", F.array_compact(F.array(*checks)))


def _plain_values(answers: DataFrame) -> DataFrame:
    """With ``__plain``: the value as a plain number; null if it is none."""
    return num.with_plain(answers, "__plain", F.trim("value"))


def relation_findings(answers: DataFrame, relations: Sequence[Relation]) -> DataFrame:
    """Totals that differ from their operands; checked only where all of them are numbers."""
    numbers, name = _relation_numbers(relations)
    wide = _plain_values(answers.where(F.col("field_key").isin(list(name)))).groupBy("filing_id").agg(*numbers)
    # An expression, not the column: that one Spark would ask for its size first, with all steps above worked out again.
    found = F.inline(F.array_compact("broken"))
    return _with_broken_relations(wide, relations, name).select("filing_id", found).select(*FINDING)


def filing_findings(
    filings: DataFrame, answers: DataFrame, form: Sequence[FieldDef], relations: Sequence[Relation]
) -> DataFrame:
    """Findings that need a filing's answers together: missing fields, and totals from the few answers that relations name."""
    missing = missing_required(filings, answers, form)
    return relation_findings(answers, relations).unionByName(missing) if relations else missing


def movement_findings(
    answers: DataFrame, prior: DataFrame, form: Sequence[FieldDef], threshold: str = "50"
) -> DataFrame:
    """Numeric answers that moved by more than ``threshold`` percent against the year before.

    Values that are not numbers, and a prior value of zero, are skipped.
    """
    numeric = [f.field_key for f in form if f.dtype in {"number", "integer"}]
    now = _plain_values(answers.where(F.col("field_key").isin(numeric))).select(
        "filing_id", "field_key", F.col("__plain").try_cast("double").alias("now")
    )
    before = _plain_values(prior.where(F.col("field_key").isin(numeric))).select(
        "filing_id", "field_key", F.col("__plain").try_cast("double").alias("before")
    )
    pairs = now.join(before.hint("merge"), ["filing_id", "field_key"])  # as for the candidates, no broadcast by guess
    # Not a filter of its own: pushed below the join, it would parse every number anew for each digit it looks at.
    change = F.when(F.col("before") != 0, F.abs((F.col("now") - F.col("before")) / F.col("before") * 100))
    moved = pairs.where(change > float(threshold))
    return moved.select(*finding("warning", f"Year-on-year movement exceeds {threshold}%", "L2"))


def _conditions(form: Sequence[FieldDef]) -> dict[tuple[str, str], int]:
    """(field that a condition looks at, value it must have), numbered: the name as it is, and below the basics."""
    asked = {f.condition for f in form if f.condition}
    pairs = sorted({(key, value) for name, value in asked for key in (name, SHORT_NAME_PREFIX + name)})
    return {pair: i for i, pair in enumerate(pairs)}


WORD = 62  # fields whose bits share a column


def _per_filing(filings: DataFrame, answers: DataFrame, form: Sequence[FieldDef]) -> DataFrame:
    """Present and reviewed field sets of every filing, also of those without any answer.

    Both sets are bounded by the size of the form. They are gathered as bits, and conditions as flags: all
    buffers have a fixed width, so the answers are aggregated by hash and never sorted.
    """
    keys = F.array(*[F.lit(f.field_key) for f in form]).cast("array<string>")
    words = range(-(-len(form) // WORD))
    answers = answers.withColumn("__place", F.array_position(keys, F.col("field_key")) - 1)  # -1: not in the form
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("__place", F.lit(WORD)).cast("int"))

    def bits(name: str, counts: Column) -> list[Column]:
        here = lambda w: counts & (F.col("__place") >= w * WORD) & (F.col("__place") < (w + 1) * WORD)
        return [F.bit_or(F.when(here(w), bit)).alias(f"{name}{w}") for w in words]

    def keys_of(name: str) -> Column:
        if not words:
            return keys
        word = F.array(*[F.coalesce(f"{name}{w}", F.lit(0).cast("long")) for w in words])
        return F.filter(keys, lambda key, i: F.getbit(F.get(word, F.floor(i / WORD).cast("int")), F.pmod(i, F.lit(WORD))) == 1)

    flags = []
    for (key, value), i in _conditions(form).items():
        text = F.when(F.col("field_key") == key, F.col("value"))  # the greatest answer counts, should there be several
        for name, holds in (("h", text.isNotNull()), ("q", text == value), ("g", text > value)):
            flags.append(F.bool_or(holds).alias(f"{name}{i}"))
    grouped = answers.groupBy("filing_id").agg(
        *bits("present", F.lit(True)),
        *bits("eligible", ~_machine()),
        F.count_if(F.coalesce(F.col("evidence") != "", F.lit(False))).alias("evidenced"),
        *flags,
    )
    every = filings.select("filing_id").distinct().join(grouped, "filing_id", "full")
    return every.withColumns(
        {
            "present": keys_of("present"),
            "eligible": keys_of("eligible"),
            "evidenced": F.coalesce("evidenced", F.lit(0).cast("long")),
        }
    )


def _required(form: Sequence[FieldDef], fields: Sequence[FieldDef]) -> Column:
    """Array of the required keys among ``fields``, given the filing's condition answers."""
    place = _conditions(form)
    flag = lambda name, pair: F.coalesce(F.col(f"{name}{place[pair]}"), F.lit(False))
    equal = lambda pair: flag("q", pair) & ~flag("g", pair)
    items = []
    for f in fields:
        if not f.required or f.leadership:
            continue
        if f.condition:
            name, value = f.condition
            short = (SHORT_NAME_PREFIX + name, value)
            holds = F.when(flag("h", (name, value)), equal((name, value))).otherwise(equal(short))
            items.append(F.when(holds, F.lit(f.field_key)))
        else:
            items.append(F.lit(f.field_key))
    if not items:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*items))


def missing_required(filings: DataFrame, answers: DataFrame, form: Sequence[FieldDef]) -> DataFrame:
    """Required fields without an answer; conditions are equalities on other answers.

    The difference of two small sets per filing, so answered fields never become rows.
    """
    missing = F.array_except(_required(form, form), F.col("present"))
    rows = _per_filing(filings, answers, form).select("filing_id", F.explode(missing).alias("field_key"))
    return rows.select(*finding("error", MISSING_MESSAGE, "L3"))


def unreviewed_machine_answers(answers: DataFrame) -> DataFrame:
    return answers.where(_machine()).select(*finding("error", MACHINE_MESSAGE, "L3"))


def validate_filings(
    filings: DataFrame,
    answers: DataFrame,
    form: Sequence[FieldDef],
    relations: Sequence[Relation],
    prior: DataFrame | None = None,
    threshold: str = "50",
) -> DataFrame:
    """All findings of all filings: one pass per answer, one shuffle per filing and one of related numbers, one prior join."""
    out = answer_findings(answers, form).unionByName(filing_findings(filings, answers, form, relations))
    if prior is not None:
        out = out.unionByName(movement_findings(answers, prior, form, threshold))
    return out


def progress(filings: DataFrame, answers: DataFrame, form: Sequence[FieldDef]) -> tuple[DataFrame, DataFrame]:
    """(per filing and principle, per filing): share of required and core fields that are done.

    Answers that a machine proposed and nobody reviewed do not count. Percentages are rounded
    half to even; a principle without required fields is complete.
    """
    rows = _per_filing(filings, answers, form)
    names = sorted({f.principle for f in form})
    shares = []
    for name in names:
        required = _required(form, [f for f in form if f.principle == name])
        done = F.size(F.array_intersect(required, F.col("eligible")))
        total = F.size(required)
        pct = F.when(total > 0, F.bround(done * 100.0 / total, 0)).otherwise(F.lit(100.0)).cast("int")
        shares.append(F.struct(F.lit(name).alias("principle"), pct.alias("pct")))
    core = F.array(*[F.lit(f.field_key) for f in form if f.core]).cast("array<string>")
    core_done = F.size(F.array_intersect(core, F.col("eligible")))
    core_pct = F.when(F.size(core) > 0, F.bround(core_done * 100.0 / F.size(core), 0)).otherwise(F.lit(100.0))
    scored = rows.select("filing_id", "evidenced", F.array(*shares).alias("sections"), core_pct.cast("int").alias("core_pct"))
    total = F.aggregate("sections", F.lit(0), lambda acc, s: acc + s["pct"])
    summary = scored.select(
        "filing_id",
        F.bround(total / len(names), 0).cast("int").alias("overall_pct"),
        "core_pct",
        F.forall("sections", lambda s: s["pct"] == 100).alias("complete"),
        "evidenced",
    )
    return scored.select("filing_id", F.inline("sections")), summary


def prefill_candidates(answers: DataFrame, prior: DataFrame, form: Sequence[FieldDef]) -> DataFrame:
    """Last year's answers to known fields that have no answer yet."""
    known = F.broadcast(form_table(answers.sparkSession, form).select("field_key"))  # configuration
    # Sizes are guessed from the filings, which become many answers each, so a broadcast would be chosen far too late.
    present = answers.select("filing_id", "field_key").hint("merge")
    open_rows = prior.join(present, ["filing_id", "field_key"], "left_anti")
    return open_rows.join(known, "field_key", "left_semi").select(
        "filing_id", "field_key", "value", F.lit("candidate").alias("status")
    )


def export_gate(filings: DataFrame, findings: DataFrame) -> DataFrame:
    """Whether a filing may be exported: no finding of severity error."""
    blocked = findings.groupBy("filing_id").agg(F.bool_or(F.col("severity") == "error").alias("blocked"))
    return filings.join(blocked, "filing_id", "left").select(
        "filing_id", (~F.coalesce("blocked", F.lit(False))).alias("allowed")
    )


def gap_scores(summary: DataFrame, findings: DataFrame) -> DataFrame:
    """Gap score from core coverage, evidence and findings: never below 0, half to even."""
    counts = findings.groupBy("filing_id").agg(F.count(F.lit(1)).alias("findings"))
    raw = (
        F.col("core_pct") * 0.6
        + F.least(F.lit(100), F.col("evidenced") * 2) * 0.4
        - F.coalesce("findings", F.lit(0)) * 2
    )
    score = F.greatest(F.lit(0), F.bround(F.round(raw, 6), 0).cast("int"))
    return summary.join(counts, "filing_id", "left").select(
        "filing_id", score.alias("score"), "core_pct", "evidenced", F.coalesce("findings", F.lit(0)).alias("findings")
    )


def priorities(findings: DataFrame, n: int = 12) -> DataFrame:
    """First findings per filing: by tier, field and message."""
    return first_per_key(findings, ["filing_id"], F.asc("tier"), F.asc("field_key"), F.asc("message"), n=n)


def expand_templates(
    rows: DataFrame, key_parts: Sequence[Column], items: Sequence[str], principle: Column, carry: Sequence[str] = ()
) -> DataFrame:
    """Field rows of a template: every row of a dimension with every item of a constant list."""
    return rows.select(*carry, principle.alias("principle"), F.explode(F.array(*[F.lit(i) for i in items])).alias("item"), *key_parts)


def lint_fields(fields: DataFrame, relation_keys: DataFrame, minimum_fields: int = 250) -> DataFrame:
    """Violations of a field catalogue as (rule, subject) rows.

    ``fields``: field_key, dtype, concept, unit, unit_family. ``relation_keys``: relation, reference.
    """
    subject = F.col("field_key").alias("subject")
    rule = lambda name: F.lit(name).alias("rule")
    repeated = lambda key: fields.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n")
    ).where(F.col("n") > 1)
    parts = [
        repeated("field_key").select(rule("duplicate field_key"), subject),
        repeated("concept").select(rule("duplicate concept"), F.col("concept").alias("subject")),
        fields.where(~F.col("field_key").rlike(FIELD_KEY_PATTERN)).select(rule("invalid field_key"), subject),
        fields.where(~F.coalesce(F.col("dtype").isin(list(DTYPES)), F.lit(False))).select(rule("invalid dtype"), subject),
        fields.where(F.coalesce("concept", F.lit("")) == "").select(rule("missing concept"), subject),
        fields.where(F.col("unit").isNotNull() & F.col("unit_family").isNull()).select(rule("unit without family"), subject),
        relation_keys.join(fields.select(F.col("field_key").alias("reference")), "reference", "left_anti").select(
            rule("unknown relation reference"), F.concat_ws(" ", "relation", "reference").alias("subject")
        ),
        fields.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < minimum_fields).select(
            rule("too few fields"), F.col("n").cast("string").alias("subject")
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def previous_in_time(df: DataFrame, keys: Sequence[str], at: str, tie: str, value: str, out: str) -> DataFrame:
    """Value of the row before in time within the keys.

    Two levels, rows within a month and months within a key, so that a long log of one key is
    spread over its months.
    """
    rows = df.withColumn("__month", F.date_trunc("month", at))
    inside = W.partitionBy(*keys, "__month").orderBy(at, tie)
    months = rows.groupBy(*keys, "__month").agg(F.max_by(value, F.struct(at, tie)).alias("__last"))
    before = W.partitionBy(*keys).orderBy("__month")
    months = months.withColumn("__before", F.lag("__last").over(before)).drop("__last")
    first = F.row_number().over(inside) == 1
    return (
        rows.withColumn("__lag", F.lag(value).over(inside))
        .withColumn("__first", first)
        .join(months, [*keys, "__month"])
        .withColumn(out, F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__lag")))
        .drop("__month", "__lag", "__first", "__before")
    )


def status_step_violations(
    log: DataFrame, keys: Sequence[str], at: str, tie: str, status: str, steps: dict[str, str]
) -> DataFrame:
    """Log rows whose status neither stays nor advances exactly one step."""
    rows = previous_in_time(log, keys, at, tie, status, "previous")
    table = rule_table(log.sparkSession, ["previous", "allowed"], steps.items())
    checked = rows.join(F.broadcast(table), "previous", "left")  # configuration
    moved = F.col("previous").isNotNull() & (F.col("previous") != F.col(status))
    return checked.where(moved & ~F.coalesce(F.col("allowed") == F.col(status), F.lit(False)))
