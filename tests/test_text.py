"""Text functions on literal cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as X

L = F.lit


@pytest.mark.parametrize(
    ("raw", "want"),
    [("HR 0·84", "hr 0.84"), ("1,234.56", "1234.56"), ("0,84", "0,84"), ("1,234,567", "1234567"), ("12,34,567", "12,34567"), ("a \n\t b c ", "a b c"), ("1–2−3", "1-2-3"), (None, ""), ("1,2345", "1,2345"), ("x1,234", "x1,234"), ("Ⅳ ﬁ ½", "iv fi 1⁄2")],
)
def test_normalize(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert X.normalize_frame(df, n="t").collect()[0].n == want


def test_thousands_as_in_one_pass(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choice("1234,,, a.") for _ in range(rng.randint(0, 24))) for _ in range(3000)]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(X.without_thousands(F.col("t")).alias("x")).collect()]
    want = [re.sub(r"(?<![A-Za-z0-9_])\d{1,3}(?:,\d{3})+(?![A-Za-z0-9_])", lambda m: m[0].replace(",", ""), t) for t in texts]
    assert got == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("1984", [1984.0]), ("0.028", [0.028]), (".90", [0.9]), ("n=84. the next", [84.0]), ("ci, 1.26-2.90", [1.26, 2.9]), ("difference, -0.4", [-0.4]), ("108.51.216.133", []), ("", []), ("84.5.", [84.5])],
)
def test_numbers(values, text, want):
    got = values(n=X.numbers(L(text)), t=X.number_tokens(L(text)))
    assert got["n"] == want and [t["value"] for t in got["t"]] == want
    assert all(text[t["start"] : t["stop"]] == t["raw"] for t in got["t"])


def test_numbers_equal(values):
    pairs = [(0.84, 0.840), (0.1 + 0.2, 0.3), (0.84, 0.847), (1e12, 1e12 + 1), (-1.0, 1.0)]
    got = values(**{f"p{i}": X.numbers_equal(L(a), L(b)) for i, (a, b) in enumerate(pairs)})
    assert list(got.values()) == [True, True, False, True, False]


@pytest.mark.parametrize(
    ("quote", "corpus", "want"),
    [("b c", "a b c", (True, 2, 3, False)), ("", "a", (False, None, None, False)), ("a", "", (False, None, None, False)), ("hr 0.84; ci 1", "the hr (0.84), ci: 1.5", (True, 4, 16, True)), ("short!", "sho-rt", (False, None, None, False)), ("8", "2008", (True, 3, 1, False))],
)
def test_locate(values, quote, corpus, want):
    got = values(m=X.locate(L(quote), L(corpus)))["m"]
    assert tuple(got.values()) == want


@pytest.mark.parametrize(("corpus", "quote", "want"), [("a  (b)\n c", "(b) c", (3, 9)), ("abc", "b", (1, 2)), ("abc", "x", None), ("a", None, None), ("a.b", "a b", None)])
def test_find_quote_span(values, corpus, quote, want):
    got = values(s=X.find_quote_span(L(corpus), L(quote).cast("string")))["s"]
    assert (tuple(got.values()) if got else None) == want


def test_stems(values):
    got = values(a=X.significant_tokens(L("Limb preservation (not this) in limbs, 2024 of the STUDY: preservations")), n=X.significant_tokens(L(None).cast("string")))
    assert [(s["stem"], s["word"]) for s in got["a"]] == [("limb", "limb"), ("preserv", "preservation")] and got["n"] == []


@pytest.mark.parametrize(("label", "want"), [("Limb Salvage Initiative", "limb salvage"), ("project group", "project"), ("The pilot study of plan", "the pilot study of"), (" Lab ", "lab"), (None, "")])
def test_core_phrase(values, label, want):
    assert values(p=X.core_phrase(L(label).cast("string")))["p"] == want


def test_slugs(values):
    got = values(
        c=X.concept_id(L(" Limb  Salvage! ")), d=X.domain_slug(L("AI & Technology in Medicine")), e=X.domain_slug(L("&&")), long=X.domain_slug(L("x" * 60)), n=X.domain_name(L("AI & Tech-nology")),
        k=X.kebab(X.in_form(L("Café  au lait!"), "NFKD")), a=X.anchor_id(L("project"), L(" My Plan ")), b=X.edge_id(L("z"), L("a")), h=X.hash01(L("abc")),
    )

    def fnv(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 % 2**32
        return h % 100000 / 100000

    assert got["c"] == "concept:limb-salvage" and got["d"] == "ai-and-technology-in-medicine" and got["e"] == "and-and" and len(got["long"]) == 40 and got["n"] == "aitechnology"
    assert got["k"] == "cafe-au-lait" and got["a"] == "proj:my plan" and got["b"] == "a~~z" and got["h"] == fnv("abc")


def test_truncate(values):
    words = "word " * 40
    got = values(short=X.truncate(L("x")), cut=X.truncate(L(words)), solid=X.truncate(L("y" * 200)))
    assert got["short"] == "x" and got["cut"] == ("word " * 28).strip() + "…" and got["solid"] == "y" * 140 + "…"


def test_numbers_in_span_as_in_the_whole_text(spark):
    rng = random.Random(1)
    rows = []
    for i in range(2000):
        t = "".join(rng.choice("12..--  a,") for _ in range(rng.randint(0, 16)))
        start = rng.randint(0, len(t))
        rows.append((i, t, start, rng.randint(start, len(t))))
    number = re.compile(r"(?<![0-9.])-?(?:[0-9]+\.[0-9]+|\.[0-9]+|[0-9]+)(?![0-9])(?!\.[0-9])")
    df = spark.createDataFrame(rows, "i int, t string, a int, b int").orderBy("i")
    got = [r.x for r in df.select(X.numbers_in_span(F.col("t"), F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [[float(m[0]) for m in number.finditer(t) if m.start() >= a and m.end() <= b] for _, t, a, b in rows]


def test_every_white_space_is_one_space(spark):
    spaces = [chr(c) for c in range(0x3100) if re.fullmatch(r"\s", chr(c)) and not 0x1C <= c <= 0x1F]
    rng = random.Random(2)
    texts = [f"a{s}b" for s in spaces] + ["".join(rng.choice([*spaces, " ", " ", "x", "y"]) for _ in range(12)) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert [r.x for r in df.select(X.collapse(F.col("t")).alias("x")).collect()] == [" ".join(re.split(f"[{''.join(spaces)}]+", t)).strip(" ") for t in texts]
