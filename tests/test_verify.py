"""The verification gate: it may never verify what isn't printed."""

import pytest
from pyspark.sql import functions as F

from attesta import schemas
from attesta.functions import quantities as Q
from attesta.operators import guard, verify

FIELDS = ("name", "value", "unit", "ci_low", "ci_high", "p_value", "source_quote", "location_hint")


def claim(i, q, text="", tables="", tier="full_text", registry=None):
    return (i, tuple(q.get(f) for f in FIELDS), text, tables, tier, registry)


# (quantity, source text, tables, tier of the source, registry) -> tier, corpus
CASES = {
    "exact": (dict(value=0.84, source_quote="hazard ratio was 0.84"), "The hazard ratio was 0.84 overall.", "", "full_text", None, "verified-full-text", "prose"),
    "interpunct": (dict(value=0.84, source_quote="HR 0.84"), "HR 0·84 (p<0·01)", "", "full_text", None, "verified-full-text", "prose"),
    "leading dot": (dict(value=0.9, source_quote="was .90"), "It was .90 then", "", "full_text", None, "verified-full-text", "prose"),
    "abstract": (dict(value=84.0, source_quote="n=84. The"), "n=84. The next", "", "abstract_only", None, "abstract-only", "prose"),
    "thousands": (dict(value=502157.0, source_quote="502157 adults"), "among 502,157 adults", "", "full_text", None, "verified-full-text", "prose"),
    "negative": (dict(value=-0.4, source_quote="difference, -0.4"), "difference, −0.4 points", "", "full_text", None, "verified-full-text", "prose"),
    "range": (dict(value=1.9, ci_low=1.26, ci_high=2.9, source_quote="1.90; 95% CI, 1.26-2.90"), "HR 1.90; 95% CI, 1.26–2.90.", "", "full_text", None, "verified-full-text", "prose"),
    "fragment": (dict(value=0.02, source_quote="p = 0.028"), "p = 0.028", "", "full_text", None, "flagged", "prose"),
    "degenerate": (dict(value=8.0, source_quote="8"), "since 2008", "", "full_text", None, "flagged", "prose"),
    "truncated fuzzily": (dict(value=0.84, source_quote="hazard ratio (0.84"), "the hazard ratio: 0.842 was", "", "full_text", None, "flagged", "prose"),
    "truncated exactly": (dict(value=0.84, source_quote="ratio 0.84"), "ratio 0.842", "", "full_text", None, "flagged", "prose"),
    "not there": (dict(value=1.0, source_quote="never printed 1"), "something else 1", "", "full_text", None, "flagged", None),
    "no quote": (dict(value=1.0, source_quote=""), "1", "", "full_text", None, "flagged", None),
    "wrong sign": (dict(value=0.4, source_quote="change of -0.4"), "a change of -0.4", "", "full_text", None, "flagged", "prose"),
    "one bad bound": (dict(value=0.8, ci_low=0.7, ci_high=0.95, source_quote="0.8 (0.7 to 0.9)"), "was 0.8 (0.7 to 0.9)", "", "full_text", None, "flagged", "prose"),
    "no numbers": (dict(source_quote="was noninferior"), "It was noninferior.", "", "full_text", None, "verified-full-text", "prose"),
    "p only": (dict(p_value=0.001, source_quote="P<0.001"), "(P<0.001)", "", "full_text", None, "verified-full-text", "prose"),
    "table hinted": (dict(value=12.0, source_quote="deaths | 12", location_hint="Table 2"), "deaths 11 | 12", "Deaths | 12", "full_text", None, "verified-full-text", "tables"),
    "table falls back": (dict(value=11.0, source_quote="eleven: 11", location_hint="tbl 1"), "eleven: 11", "x | y", "full_text", None, "verified-full-text", "prose"),
    "fuzzy": (dict(value=5.1, source_quote="mean blood loss 5.1"), "the mean  (blood) loss: 5.1 l", "", "full_text", None, "verified-full-text", "prose"),
    "registry with bounds": (dict(value=0.68, ci_low=0.59, ci_high=0.79, source_quote="0.68 (0.59-0.79)"), "0.68 (0.59-0.79)", "", "full_text", [("m", 0.68, 0.59, 0.79)], "verified-registry", "prose"),
    "registry needs bounds": (dict(value=0.68, source_quote="was 0.68"), "was 0.68", "", "full_text", [("m", 0.68, 0.59, 0.79)], "verified-full-text", "prose"),
    "registry other bounds": (dict(value=0.68, ci_low=0.5, ci_high=0.79, source_quote="0.68 (0.5-0.79)"), "0.68 (0.5-0.79)", "", "full_text", [("m", 0.68, 0.59, 0.79)], "verified-full-text", "prose"),
    "registry plain value": (dict(value=0.68, source_quote="was 0.68"), "was 0.68", "", "full_text", [("a", 0.7, None, None), ("b", 0.68, None, None)], "verified-registry", "prose"),
    "registry can't save it": (dict(value=0.68, source_quote="was 0.70"), "was 0.70", "", "full_text", [("b", 0.68, None, None)], "flagged", "prose"),
    "nothing": (dict(value=1.0, source_quote="1"), None, None, None, None, "flagged", None),
    "full-width": (dict(value=12.0, source_quote="n = 12"), "ｎ ＝ １２", "", "full_text", None, "verified-full-text", "prose"),
}


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [claim(i, q, text, tables, tier, registry) for i, (q, text, tables, tier, registry, *_) in enumerate(CASES.values())]
    df = verify.verify(spark.createDataFrame(rows, schemas.CLAIM))
    return {name: v for name, v in zip(CASES, [r.verdict for r in sorted(df.collect(), key=lambda r: r.claim_id)])}


@pytest.mark.parametrize("name", CASES)
def test_tiers(verdicts, name):
    v, (*_, tier, corpus) = verdicts[name], CASES[name]
    assert v.tier == tier and v.flagged == (tier == "flagged") and (v.matched.corpus if v.matched else None) == corpus and v.found == (corpus is not None)


def test_reasons(verdicts):
    assert verdicts["not there"].reason == "Quote not found in source text."
    assert verdicts["one bad bound"].badNums == [0.95] and "0.95 is not present" in verdicts["one bad bound"].reason
    assert verdicts["registry with bounds"].reason.startswith('Value and 95% CI match') and '("m")' in verdicts["registry with bounds"].reason
    assert verdicts["fuzzy"].matched.fuzzy and verdicts["degenerate"].quoteNums == [] and verdicts["abstract"].reason.startswith("Verified against the abstract")


def test_every_corruption_is_flagged(spark):
    good = [claim(i, q, text, tables, tier, registry) for i, (q, text, tables, tier, registry, want, _) in enumerate(CASES.values()) if want != "flagged" and q.get("value") is not None]
    again = verify.corrupt_and_reverify(verify.verify(spark.createDataFrame(good, schemas.CLAIM))).collect()
    assert len(again) == len(good) and all(r.verdict.flagged and r.quantity.value != r.original for r in again)


WARN = {
    "zero": (dict(p_value=0.0), ["zero-p-value"]), "over one": (dict(p_value=1.2), ["impossible-p-value"]), "reversed": (dict(value=1.0, ci_low=2.0, ci_high=1.0), ["reversed-confidence-interval"]),
    "outside": (dict(value=3.0, ci_low=1.0, ci_high=2.0), ["estimate-outside-confidence-interval"]), "percent": (dict(value=120.0, unit=" % "), ["percentage-over-100"]),
    "ratio excludes": (dict(name="hazard ratio", value=0.7, ci_low=0.6, ci_high=0.9, p_value=0.2, source_quote="95% CI 0.6-0.9; P=0.2"), ["ci-p-incoherence"]),
    "ratio contains": (dict(name="odds ratio", value=1.0, ci_low=0.6, ci_high=1.9, p_value=0.01, source_quote="95% CI 0.6-1.9; P=0.01"), ["ci-p-incoherence"]),
    "difference contains": (dict(name="mean difference", value=0.5, ci_low=-1.0, ci_high=2.0, p_value=0.04, source_quote="95% confidence interval; p<0.04"), ["ci-p-incoherence"]),
    "boundary": (dict(name="risk ratio", value=0.7, ci_low=0.6, ci_high=0.9, p_value=0.05, source_quote="95% CI; P=0.05"), []), "no level": (dict(name="risk ratio", value=0.7, ci_low=0.6, ci_high=0.9, p_value=0.2, source_quote="P=0.2"), []),
    "at the null": (dict(name="risk ratio", value=0.9, ci_low=0.6, ci_high=1.0, p_value=0.2, source_quote="95% CI; P=0.2"), []), "coherent": (dict(name="risk ratio", value=0.7, ci_low=0.6, ci_high=0.9, p_value=0.01, source_quote="95% CI; P<0.01"), []),
}


def quantity(q):
    kinds = dict(zip(FIELDS, ("string", "double", "string", "double", "double", "double", "string", "string")))
    return F.struct(*(F.lit(q.get(f)).cast(k).alias(f) for f, k in kinds.items()))


@pytest.mark.parametrize("name", WARN)
def test_warnings(values, name):
    q, kinds = WARN[name]
    got = values(w=Q.plausibility_warnings(quantity(q), F.lit(False)))["w"]
    assert [w["kind"] for w in got] == kinds and all(w["status"] == "unverified" for w in got)


SHOWN = [
    (dict(value=1.0, source_quote="HR 1.00 (95% CI, 0.80 to 1.25; P = .9)", ci_low=0.8, ci_high=1.25, p_value=0.9), "1.00 (CI 0.80–1.25), P=.9"),
    (dict(value=0.84, unit="mm", source_quote="0·84"), "0·84 mm"), (dict(value=5.0, source_quote="five"), "5"), (dict(p_value=0.1), ""),
    (dict(value=12.5, p_value=0.001, source_quote="12.5; P value of <0.001"), "12.5, P<0.001"), (dict(value=3.0, p_value=0.03, source_quote="3 (0.03)"), "3, P 0.03"),
    (dict(value=2.0, ci_low=2.0, ci_high=2.0, source_quote="2; CI 2 to 2.0"), "2 (CI 2–2.0)"),
]


@pytest.mark.parametrize(("q", "want"), SHOWN)
def test_shown_as_printed(values, q, want):
    assert values(s=Q.format_quantity(quantity(q)))["s"] == want


@pytest.mark.parametrize(
    ("text", "allowed", "grounded", "stripped"),
    [
        ("the SF-36 and COVID-19", [], True, "the SF-36 and COVID-19"), ("a 30-day risk", [], False, "a day risk"), ("fell by 12.5% (p<0.01), n = 40.", ["12.5%", "P<0.01"], False, "fell by (p), n."),
        ("fell by 12.5%", ["12.50 %"], True, "fell by"), ("none", [], True, "none"), (None, [], True, ""),
    ],
)
def test_number_guard(values, text, allowed, grounded, stripped):
    t = F.lit(text).cast("string")
    got = values(g=guard.numbers_grounded(t, guard.allowed_numbers(F.lit(allowed).cast("array<string>"))), s=guard.strip_numbers(t))
    assert got["g"] == grounded
    if text and "=" not in text:
        assert got["s"] == stripped


def test_rankings_are_sanitized(spark):
    rows = [("a", "cut by 12%", "cut a lot", "matters in 3 ways", ["12 %"]), ("b", "cut by 13%", "cut a lot", "SF-36 too", ["12 %"]), ("c", "cut by 13%", "", None, None), ("d", "cut by 13%", "cut by 14%", "", [])]
    df = spark.createDataFrame(rows, "id string, finding string, finding_plain string, relevance string, verified array<string>")
    got = {r.id: (r.finding, r.relevance) for r in guard.sanitize_rankings(df).collect()}
    assert got == {"a": ("cut by 12%", "matters in ways"), "b": ("cut a lot", "SF-36 too"), "c": ("cut by", ""), "d": ("cut by", "")}


def test_checks_are_attached(spark):
    rankings = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    verdicts = spark.createDataFrame([("a", 1, False, "no"), ("a", 2, True, ""), ("b", 1, False, "why"), ("x", 1, True, "")], "id string, seq int, supported boolean, reason string")
    assert {r.id: tuple(r.check) for r in guard.attach_checks(rankings, verdicts).collect()} == {"a": ("supported", ""), "b": ("refuted", "why"), "c": ("unchecked", "")}


def test_stripping_as_python_does(spark):
    import random
    import re

    pattern = re.compile(r"[<>≤≥=~≈]?(?<![a-z0-9.])(?<![a-z][-‐–—])[-−]?(?:[0-9]+(?:[.,·][0-9]+)*|\.[0-9]+)%?[-‐–—−]?", re.I)

    def plain(text):
        out = re.sub(r"\(\s*\)", " ", pattern.sub(" ", text))
        return re.sub(r"\s+", " ", re.sub(r"\s+([,.;:)\]])", r"\1", out)).strip()

    rng = random.Random(8)
    texts = ["".join(rng.choice(["12", "3.5", "-", " ", "SF", "a", "(", ")", "<", "%", ",", ".", "–", "=", "90"]) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    got = [r.s for r in df.select(guard.strip_numbers(F.col("t")).alias("s")).collect()]
    assert got == list(map(plain, texts))
