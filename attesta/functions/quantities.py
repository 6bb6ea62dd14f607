"""Reported quantities: how they were printed, and whether they can be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, normalize, number_tokens, numbers_equal, tokens_of

# Numbers as printed, how a P value is announced, and kinds of measure.
PRINTED_NUMBER = (
    "(?<![0-9.·‧⋅∙•])[+\\-‐‑‒–—−－]?(?:[0-9]{1,3}(?:,[0-9]{3})+(?:[.·‧⋅∙•][0-9]+)?|[0-9]+[.·‧⋅∙•][0-9]+|[.·‧⋅∙•][0-9]+|[0-9]+)"
    "(?![0-9])(?![.·‧⋅∙•][0-9])"
)
P_LABEL = "(?i)(?<![A-Za-z0-9_])p(?:\\s*[- ]?value)?\\s*(?:of\\s*)?(<=|>=|[=<>≤≥⩽⩾])?\\s*$"
CI_MARKER = "(?i)(?<![A-Za-z0-9_])(?:ci|confidence\\s+interval)(?![A-Za-z0-9_])"
RATIO_MEASURE = "(?i)(?<![A-Za-z0-9_])(?:(?:hazard|odds|risk|rate|prevalence)\\s+ratio|relative\\s+risk)(?![A-Za-z0-9_])"
DIFFERENCE_MEASURE = "(?i)(?:(?<![A-Za-z0-9_])(?:mean|risk|rate|absolute|between-group|treatment))?\\s*difference(?![A-Za-z0-9_])"
CI_95 = "(?i)(?<![A-Za-z0-9_])95\\s*%\\s*(?:ci|confidence\\s+interval)(?![A-Za-z0-9_])"
PERCENT_UNIT = "(?i)^\\s*(?:%|percent|percentage)\\s*$"
OPERATORS = {"=": "=", "<": "<", ">": ">", "≤": "≤", "≥": "≥", "⩽": "≤", "⩾": "≥", "<=": "≤", ">=": "≥"}
#: How far before a number its label may stand.
LABEL_REACH = 18


def shown(x: Column) -> Column:
    """A double as people write it: no trailing zero fraction."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(F.regexp_replace(x.cast("string"), "E-", "e-"))


def _before(text: Column, start: Column) -> Column:
    at = F.greatest(start - LABEL_REACH, F.lit(0))
    return F.substring(text, at + 1, start - at)


def p_operator(quote: Column, p: Column) -> Column:
    """The comparison that the quote prints before the P value; null if it prints none."""

    def find(q: Column) -> Column:
        labelled = F.filter(number_tokens(q), lambda t: numbers_equal(t["value"], p) & _before(q, t["start"]).rlike(P_LABEL))
        return F.when(F.size(labelled) > 0, F.regexp_extract(_before(q, F.get(labelled, F.lit(0))["start"]), P_LABEL, 1))

    # no P value, no search
    raw = F.when(p.isNotNull(), let(normalize(quote), find))
    table = F.create_map(*(F.lit(x) for pair in OPERATORS.items() for x in pair))
    return F.try_element_at(table, F.coalesce(raw, F.lit("")))


def printed_tokens(quote: Column) -> Column:
    """Numbers of a raw quote as they are printed, with their values."""
    tokens = tokens_of(F.coalesce(quote, F.lit("")), PRINTED_NUMBER)
    valued = F.transform(tokens, lambda t: F.struct(t["raw"].alias("raw"), t["start"].alias("start"), normalize(F.regexp_replace(t["raw"], "^\\+", "")).try_cast("double").alias("value")))
    return F.filter(valued, lambda t: t["value"].isNotNull())


def printed_value(quote: Column, field: str, q: Column) -> Column:
    """A field of the struct q as the quote prints it, else as a plain number.

    A P value is looked for after its label first, an interval's bounds after its marker, the upper
    one after the lower."""
    target = q[field]
    text = F.coalesce(quote, F.lit(""))

    def first(found: Column) -> Column:
        return F.get(F.transform(found, lambda t: t["raw"]), F.lit(0))

    def pick(tokens: Column) -> Column:
        equal = lambda v: F.filter(tokens, lambda t: numbers_equal(t["value"], v))
        if field == "p_value":
            labelled = F.filter(tokens, lambda t: numbers_equal(t["value"], target) & _before(text, t["start"]).rlike(P_LABEL))
            return F.coalesce(first(labelled), first(equal(target)))
        if field in ("ci_low", "ci_high"):
            marker = F.regexp_instr(text, F.lit(CI_MARKER)) - 1
            after = F.filter(tokens, lambda t: (marker < 0) | (t["start"] > marker))
            low = F.filter(after, lambda t: numbers_equal(t["value"], q["ci_low"]))
            if field == "ci_low":
                return first(low)
            low_at = F.coalesce(F.get(F.transform(low, lambda t: t["start"]), F.lit(0)), F.lit(-1))
            return first(F.filter(after, lambda t: (t["start"] > low_at) & numbers_equal(t["value"], target)))
        return first(equal(target))

    return F.when(target.isNull(), F.lit("")).otherwise(F.coalesce(let(printed_tokens(quote), pick), shown(target)))


def format_quantity(q: Column) -> Column:
    """value unit (CI low–high), P<op>p, as printed; empty without a value."""
    quote = q["source_quote"]
    unit = F.when(F.coalesce(q["unit"], F.lit("")) != "", F.concat(F.lit(" "), q["unit"])).otherwise("")
    interval = F.when(
        q["ci_low"].isNotNull() & q["ci_high"].isNotNull(),
        F.concat(F.lit(" (CI "), printed_value(quote, "ci_low", q), F.lit("–"), printed_value(quote, "ci_high", q), F.lit(")")),
    ).otherwise("")
    # without an operator a space stands before the number
    operator = F.coalesce(p_operator(quote, q["p_value"]), F.lit(" "))
    chance = F.when(q["p_value"].isNull(), F.lit("")).otherwise(F.concat(F.lit(", P"), operator, printed_value(quote, "p_value", q)))
    return F.when(q["value"].isNull(), F.lit("")).otherwise(F.concat(printed_value(quote, "value", q), unit, interval, chance))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def p_direction(quote: Column, p: Column) -> Column:
    """significant, not-significant, or null where the printed P value leaves it open."""

    def direction(op: Column) -> Column:
        exact = op.isNull() | (op == "=")
        return (
            F.when(op.isin("<", "≤") & (p <= 0.05), F.lit("significant"))
            .when(op.isin(">", "≥") & (p >= 0.05), F.lit("not-significant"))
            .when(exact & (p < 0.05), F.lit("significant"))
            .when(exact & (p > 0.05), F.lit("not-significant"))
        )

    return let(p_operator(quote, p), direction)


def plausibility_warnings(q: Column, verified: Column) -> Column:
    """array<struct<kind, status, message>>: what is odd about a quantity, whether or not it is printed
    so. Warnings never change a tier."""
    status = F.when(verified, F.lit("verified-as-printed")).otherwise("unverified")
    opening = F.when(verified, F.lit("Verified as printed, but")).otherwise("Unverified extraction; additionally,")

    def warn(when: Column, kind: str, *detail) -> Column:
        message = F.concat_ws(" ", opening, F.concat(*(F.lit(d) if isinstance(d, str) else d for d in detail)))
        return F.when(when, F.struct(F.lit(kind).alias("kind"), status.alias("status"), message.alias("message")))

    p, low, high, value = q["p_value"], q["ci_low"], q["ci_high"], q["value"]
    quote = F.coalesce(q["source_quote"], F.lit(""))
    complete = _finite(low) & _finite(high)
    evidence = F.concat_ws(" ", F.coalesce(q["name"], F.lit("")), quote)
    null_value = F.when(evidence.rlike(RATIO_MEASURE), F.lit(1)).when(evidence.rlike(DIFFERENCE_MEASURE), F.lit(0))
    comparable = complete & (low <= high) & evidence.rlike(CI_95)

    def incoherent(known: Column) -> Column:
        no_effect, direction = known["no_effect"], known["direction"]
        bar = no_effect.cast("string")
        excludes, within = (high < no_effect) | (low > no_effect), (low < no_effect) & (high > no_effect)
        return F.coalesce(
            warn(comparable & excludes & (direction == "not-significant"), "ci-p-incoherence", "the 95% CI excludes the null (", bar, ") while the reported P value is not significant."),
            warn(comparable & within & (direction == "significant"), "ci-p-incoherence", "the 95% CI contains the null (", bar, ") while the reported P value is significant."),
        )

    known = F.struct(null_value.alias("no_effect"), F.when((p >= 0) & (p <= 1), p_direction(quote, p)).alias("direction"))
    return F.array_compact(
        F.array(
            warn(p == 0, "zero-p-value", "the reported P value is zero; an exact P value cannot be zero and this is likely rounded or affected by numerical underflow."),
            warn(p.isNotNull() & (p != 0) & (~_finite(p) | (p < 0) | (p > 1)), "impossible-p-value", "the reported P value (", shown(p), ") is outside 0–1."),
            warn(complete & (low > high), "reversed-confidence-interval", "the reported CI runs from ", shown(low), " to ", shown(high), "."),
            warn(
                complete & (low <= high) & _finite(value) & ((value < low) | (value > high)),
                "estimate-outside-confidence-interval", "the point estimate (", shown(value), ") lies outside its reported CI (", shown(low), "–", shown(high), ").",
            ),
            warn(F.coalesce(q["unit"], F.lit("")).rlike(PERCENT_UNIT) & _finite(value) & (value > 100), "percentage-over-100", "the reported percentage is ", shown(value), "%."),
            F.when(comparable, let(known, incoherent)),
        )
    )


def to_number(c: Column) -> Column:
    """The number that a string begins with; null without one."""
    return F.regexp_extract(F.ltrim(c.cast("string")), "^[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?", 0).try_cast("double")
