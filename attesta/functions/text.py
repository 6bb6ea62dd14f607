"""Text as columns: normalization, numbers and where they stand, spans, stems.

All of it is built-in functions, but for compatibility normalization (NFKC, NFKD), which Spark lacks;
``normalize_frame`` sends only rows beyond ASCII to Python.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dash variants, decimal points in mid-line, and the grammar of a number.
DASHES = "‐‑‒–—−－"
INTERPUNCT_DECIMAL = "([0-9])[·‧⋅∙•]([0-9])"
NUMBER = "(?=[-.0-9])(?<![0-9.])-?(?:[0-9]+\\.[0-9]+|\\.[0-9]+|[0-9]+)(?![0-9])(?!\\.[0-9])"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once even where use needs it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def nz(c: Column) -> Column:
    """Null instead of an empty string."""
    return F.nullif(c, F.lit(""))


def trim(c: Column) -> Column:
    """Without white space of any kind at the ends; Spark's own trim takes off only spaces."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def collapse(c: Column) -> Column:
    """Each run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(c, "(?U)\\s+", " "))


def key_of(c: Column) -> Column:
    """Trimmed and lower-case, null as empty: how labels are compared."""
    return F.lower(trim(F.coalesce(c, F.lit(""))))


def without_thousands(c: Column) -> Column:
    """1,234.56 as 1234.56, with any number of groups; only groups of exactly three digits, so 0,84
    stays. A comma goes if up to three digits that begin a word stand before it and exactly three
    that end one after it; to either of two commas the other is no part of a word."""
    return F.regexp_replace(c, "(?=[0-9])(?<![A-Za-z0-9_])([0-9]{1,3}),(?=[0-9]{3}(?![A-Za-z0-9_]))", "$1")


def normalize(c: Column) -> Column:
    """Dashes unified, mid-line decimals as points, thousands separators gone, white space collapsed,
    lower case; null as empty. For text that is in NFKC; see ``normalize_frame``."""
    c = F.coalesce(c, F.lit(""))
    unified = F.regexp_replace(F.translate(c, DASHES, "-" * len(DASHES)), INTERPUNCT_DECIMAL, "$1.$2")
    # only text beyond ASCII has other dashes and points
    return F.lower(collapse(without_thousands(F.when(_beyond_ascii(c), unified).otherwise(c))))


def _normalize_ascii(c: Column) -> Column:
    white = F.regexp_replace(without_thousands(F.coalesce(c, F.lit(""))), "\\s+", " ")
    return F.lower(F.trim(white))


def _beyond_ascii(c: Column) -> Column:
    return c.rlike("[^\\x00-\\x7F]")


def _form(form: str):
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return apply


def in_form(c: Column, form: str = "NFKC") -> Column:
    return F.pandas_udf(_form(form), "string")(c)


def normalize_frame(df: DataFrame, **columns: str) -> DataFrame:
    """df with each ``out=column``: the column in NFKC and normalized. Python sees only the rows of which
    one of these is not ASCII."""
    beyond = F.lit(False)
    for column in columns.values():
        beyond = beyond | F.coalesce(_beyond_ascii(F.col(column)), F.lit(False))
    plain, other = df.where(~beyond), df.where(beyond)
    return plain.withColumns({out: _normalize_ascii(F.col(c)) for out, c in columns.items()}).unionByName(
        other.withColumns({out: normalize(in_form(F.col(c))) for out, c in columns.items()})
    )


def numbers(c: Column) -> Column:
    """The numbers in a normalized text: array<double>."""
    return F.transform(number_strings(c), lambda t: t.cast("double"))


def number_strings(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))


def tokens_of(c: Column, pattern: str) -> Column:
    """array<struct<raw, start, stop>> of a pattern's matches, in code points from 0: the gaps
    between matches, and the matches, add up to where each one starts."""
    empty = F.array().cast("array<struct<raw:string,start:int,stop:int>>")

    def place(parts: Column) -> Column:
        def add(done: Column, i: Column) -> Column:
            start = F.coalesce(F.try_element_at(done, F.lit(-1))["stop"], F.lit(0)) + F.length(F.get(parts["gaps"], i))
            raw = F.get(parts["found"], i)
            return F.concat(done, F.array(F.struct(raw.alias("raw"), start.alias("start"), (start + F.length(raw)).alias("stop"))))

        order = F.transform(parts["found"], lambda _, i: i)
        return F.aggregate(order, empty, add)

    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return let(F.struct(found.alias("found"), F.split(c, pattern, -1).alias("gaps")), place)


def number_tokens(c: Column) -> Column:
    """array<struct<raw, start, stop, value>> of the numbers in a normalized text."""
    return F.transform(tokens_of(c, NUMBER), lambda t: F.struct(t["raw"].alias("raw"), t["start"].alias("start"), t["stop"].alias("stop"), t["raw"].cast("double").alias("value")))


def numbers_equal(a: Column, b: Column) -> Column:
    """Equal but for how a double is stored, never for rounding."""
    return F.abs(a - b) <= F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def any_equal(values: Column, target: Column) -> Column:
    return F.exists(values, lambda v: numbers_equal(v, target))


def numbers_in_span(c: Column, start: Column, stop: Column) -> Column:
    """The numbers that lie wholly within [start, stop).

    A number's grammar sees two characters to either side, so the span is cut out with these. Then only
    the first two matches can begin before the span, and only the last two end behind it."""
    before = F.least(start, F.lit(2))
    cut = F.substring(c, start - before + 1, stop - start + before + 2)

    def inside(at: Column) -> Column:
        found, gaps, n = at["found"], at["gaps"], F.size(at["found"])
        size = lambda array, i: F.length(F.get(array, i))
        first = size(gaps, F.lit(0))
        second = first + size(found, F.lit(0)) + size(gaps, F.lit(1))
        last = at["size"] - size(gaps, n)
        next_to_last = last - size(found, n - 1) - size(gaps, n - 1)

        def fits(_: Column, i: Column) -> Column:
            begins = F.when(i == 0, first >= at["before"]).when(i == 1, second >= at["before"]).otherwise(True)
            ends = F.when(i == n - 1, last <= at["stop"]).when(i == n - 2, next_to_last <= at["stop"]).otherwise(True)
            return begins & ends

        return F.transform(F.filter(found, fits), lambda t: t.cast("double"))

    parts = let(cut, lambda t: F.struct(
        F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)).alias("found"), F.split(t, NUMBER, -1).alias("gaps"), F.length(t).alias("size"),
        before.alias("before"), (stop - start + before).alias("stop"),
    ))
    return let(parts, inside)


def alnum(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-z0-9]", "")


def locate(quote: Column, corpus: Column) -> Column:
    """struct<found, index, length, fuzzy> of a normalized quote in a normalized corpus.

    First as it is; else, if it has more than six letters and digits, by these alone. For the latter
    the quote becomes a pattern with anything else allowed between its characters, whose match ends
    right after the last of them: the span is never widened."""
    at = F.instr(corpus, quote) - 1

    def fuzzy(plain: Column) -> Column:
        pattern = F.array_join(F.split(plain, ""), "[^a-z0-9]*")
        hit = F.when(F.length(plain) > 6, F.regexp_substr(corpus, pattern))
        return F.when(
            hit.isNotNull(),
            F.struct(F.lit(True).alias("found"), (F.regexp_instr(corpus, pattern) - 1).alias("index"), F.length(hit).alias("length"), F.lit(True).alias("fuzzy")),
        ).otherwise(F.struct(F.lit(False).alias("found"), F.lit(None).cast("int").alias("index"), F.lit(None).cast("int").alias("length"), F.lit(False).alias("fuzzy")))

    none = F.struct(F.lit(False).alias("found"), F.lit(None).cast("int").alias("index"), F.lit(None).cast("int").alias("length"), F.lit(False).alias("fuzzy"))
    exact = F.struct(F.lit(True).alias("found"), at.alias("index"), F.length(quote).alias("length"), F.lit(False).alias("fuzzy"))
    return F.when((quote == "") | (corpus == ""), none).when(at >= 0, exact).otherwise(let(alnum(quote), fuzzy))


def find_quote_span(corpus: Column, quote: Column) -> Column:
    """struct<start, stop> of a quote in raw text: as it is, else with any white space for any; null
    if it isn't there."""
    q = trim(quote)
    at = F.instr(corpus, q) - 1
    escaped = F.regexp_replace(q, "([.*+?^${}()|\\[\\]\\\\])", "\\\\$1")
    pattern = F.regexp_replace(escaped, "(?U)\\s+", "(?U:\\\\s+)")
    hit = F.regexp_substr(corpus, pattern)
    loose = F.regexp_instr(corpus, pattern) - 1
    return (
        F.when((F.coalesce(q, F.lit("")) == "") | (F.coalesce(corpus, F.lit("")) == ""), None)
        .when(at >= 0, F.struct(at.alias("start"), (at + F.length(q)).alias("stop")))
        .when(hit.isNotNull(), F.struct(loose.alias("start"), (loose + F.length(hit)).alias("stop")))
    )


# Suffixes in the order they are tried; words that say nothing about a subject, and
# words that are left off the ends of a label.
STEM_SUFFIXES = "ations ation ities ility ical ives ions ies ive ion ing ics ic als al ers er es s e y".split()
STOPWORDS = (
    "a an the and or nor but of in on for to with without by at from into onto over under about across among between "
    "within during after before versus via per than then when where which who what how why is are was were be being been do "
    "does did has have had can could will would should may might must not non its this that these those their our all any "
    "each both more most less least other same such only also new novel current recent early late first second ongoing long "
    "short term study studies research program programme project projects initiative initiatives effort efforts pilot plan plans "
    "planning committee center centre group groups lab labs team work working draft paper papers manuscript manuscripts abstract "
    "abstracts submission chapter review reviews analysis analyses model models modeling modelling outcome outcomes result results "
    "effect effects impact impacts role roles association associations associated correlation comparison compare compared comparing "
    "evaluation evaluate evaluating assessment assess assessing approach approaches method methods methodology protocol protocols "
    "cohort cohorts registry registries database databases data dataset datasets trial trials series report reports case cases "
    "aim aims objective objectives hypothesis finding findings rate rates ratio trend trends level levels use uses using used based "
    "clinic clinics clinical clinically patient patients medical medicine health healthcare care hospital hospitals disease diseases"
).split()
GENERIC_WORDS = "initiative program programme project study effort center centre group lab plan pilot committee".split()


#: A suffix that leaves at least four letters. Of those that a word has the one that is tried first
#: is the longest, which is the one that begins first.
_SUFFIX = f"(?<=[a-z0-9]{{4}})(?:{'|'.join(STEM_SUFFIXES)})"


def stem(word: Column) -> Column:
    """Without the first suffix of the list that leaves at least four letters."""
    return F.regexp_replace(word, f"(?s)(?<=.{{4}})(?:{'|'.join(STEM_SUFFIXES)})\\z", "")


def _stem(word: str) -> str:
    return next((word[: -len(s)] for s in STEM_SUFFIXES if word.endswith(s) and len(word) - len(s) >= 4), word)


def significant_tokens(c: Column) -> Column:
    """array<struct<stem, word>>: the stems that say something, each with its first word.

    The text is stemmed as a whole, by one pattern; equal pairs of stem and word are one before
    anything is sorted, so the rest of the work is on distinct words."""
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "\\([^)]*\\)", " "), "[^a-z0-9]+", " ")
    # words of one or two characters and numbers say nothing
    cleaned = F.trim(F.regexp_replace(cleaned, "(?<![a-z0-9])(?:[0-9]+|[a-z0-9]{1,2})(?: |$)", ""))
    stems = F.regexp_replace(cleaned, f"{_SUFFIX}(?= |$)", "")
    stops = sorted({_stem(w) for w in STOPWORDS})
    pairs = F.zip_with(F.split(stems, " "), F.split(cleaned, " "), lambda s, w: F.when((s != "") & ~s.isin(stops), F.concat(s, F.lit(" "), w)))
    distinct = F.array_distinct(F.array_compact(pairs))

    def firsts(found: Column) -> Column:
        part = lambda p, n: F.substring_index(p, " ", n)
        placed = F.sort_array(F.transform(found, lambda p, i: F.struct(part(p, 1).alias("stem"), i.alias("at"), part(p, -1).alias("word"))))
        heads = let(placed, lambda p: F.filter(p, lambda x, i: ~F.coalesce(F.get(p, i - 1)["stem"] == x["stem"], F.lit(False))))
        in_order = F.sort_array(F.transform(heads, lambda x: F.struct(x["at"].alias("at"), x["stem"].alias("stem"), x["word"].alias("word"))))
        return F.transform(in_order, lambda x: F.struct(x["stem"].alias("stem"), x["word"].alias("word")))

    return let(distinct, firsts)


def core_phrase(label: Column) -> Column:
    """A label, lower-case, without generic words at its ends; one word stays at least."""
    generic = "|".join(GENERIC_WORDS)
    words = F.lower(collapse(F.coalesce(label, F.lit(""))))
    tail_off = F.regexp_replace(words, f"( (?:{generic}))+$", "")
    return F.regexp_replace(tail_off, f"^((?:{generic}) )+", "")


def kebab(c: Column) -> Column:
    """Lower-case ASCII letters and digits, hyphens between; for text in NFKD, whose accents go."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), "[\\u0300-\\u036f]", "")
    return F.regexp_replace(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def concept_id(name: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit("concept:"), slug)


def domain_slug(label: Column) -> Column:
    with_and = F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "&", " and ")
    slug = F.regexp_replace(F.regexp_replace(with_and, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(nz(F.substring(slug, 1, 40)), F.lit("domain"))


def domain_name(raw: Column) -> Column:
    """A domain's name without punctuation, spaces and "and"."""
    with_and = F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), "&", " and ")
    words = F.split(F.regexp_replace(with_and, "[^a-z0-9]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & (w != "and")), "")


def anchor_id(kind: Column, label: Column) -> Column:
    return F.concat(F.when(kind == "project", F.lit("proj:")).otherwise(F.lit("ns:")), key_of(label))


def edge_id(a: Column, b: Column) -> Column:
    """The same for both directions."""
    return F.concat(F.least(a, b), F.lit("~~"), F.greatest(a, b))


def hash01(c: Column) -> Column:
    """A hash of a string in [0, 1), in steps of 1e-5: 32-bit FNV-1a over its code points."""
    codes = F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    fold = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, x: ((h.bitwiseXOR(x)) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))
    return (fold % 100000) / F.lit(100000.0)


def contains(text: Column, query: Column) -> Column:
    """A case-insensitive search; an empty query finds everything."""
    return (query == "") | F.contains(F.lower(F.coalesce(text, F.lit(""))), query)


def truncate(c: Column, most: int = 140) -> Column:
    """At most ``most`` characters, cut at the last space if that is in the second half."""
    cut = F.substring(c, 1, most)
    space = F.length(cut) - F.locate(" ", F.reverse(cut))
    at_word = F.when((F.locate(" ", F.reverse(cut)) > 0) & (space > most / 2), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(at_word, "(?U)\\s+$", ""), F.lit("…")))
