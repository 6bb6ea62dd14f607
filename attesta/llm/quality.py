"""Document quality by weak supervision, in DataFrame and SQL functions alone.

Eight rules look at counts of a text and vote bad (0), good (1), or abstain (2). Documents with the
same votes are one row with a count, at most 3 ** 8 rows whatever the corpus; on these,
expectation-maximisation estimates how often each rule, when it votes, is right on good and on bad
documents. A document is kept if its posterior probability of being good is at least one half.

The start says what a rule is: one that hardly ever speaks against a good document, while a bad
document fails few of the rules. As a prior of ``STRENGTH`` times the rows it also keeps a rule that
never votes bad, or the names of the two classes, from drifting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_of, materialize

#: Words whose repetition is looked for, together.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: A word of letters as prose has it.
PLAIN = "^[\"'(]?\\p{L}[\\p{L}'-]*[\"')]?[.,;:!?]?[\"')]?$"

BAD, GOOD, ABSTAIN = 0, 1, 2
#: Rounds of expectation-maximisation.
ROUNDS = 40
#: The start: share of good documents, and how often a vote is bad on a good and on a bad document.
PRIOR, BAD_ON_GOOD, BAD_ON_BAD = 0.7, 0.01, 0.3
STRENGTH = 0.02


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once per row even where use needs it in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _long(x: Column) -> Column:
    return x.cast("long")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def _repeated(hashes: Column, window: int) -> Column:
    """How many words lie in windows that are found twice or more, given the words' hashes."""
    n = F.size(hashes)
    positions = F.sequence(F.lit(0), n - window)
    windows = F.transform(positions, lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(window))))

    def covered(found: Column) -> Column:
        pairs = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
            flags = F.transform(p, lambda x, i: F.struct(x["i"].alias("i"), (same(x, F.get(p, i + 1)) | same(x, F.get(p, i - 1))).alias("twice")))
            return F.array_sort(F.transform(F.filter(flags, lambda x: x["twice"]), lambda x: x["i"]))

        # each such window adds the words up to the next one's start, or all of its own
        def count(s: Column) -> Column:
            steps = F.transform(s, lambda at, i: F.least(F.lit(window), F.coalesce(F.get(s, i + 1) - at, F.lit(window))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(let(pairs, lambda p: let(starts(p), count)))

    return F.when(n < window + 1, F.lit(0)).otherwise(let(windows, covered))


def text_counts(documents: DataFrame) -> DataFrame:
    """doc_id, the base counts of each text, and those that only the rules use."""
    rows = documents_of(documents).withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")

    def counted(words: Column) -> Column:
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        return let(
            hashes,
            lambda h: F.struct(
                _long(F.size(words)).alias("n_words"),
                _long(F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))).alias("word_chars"),
                _long(_repeated(h, WINDOW)).alias("n_repeat_words"),
                _long(F.size(F.array_distinct(h))).alias("n_distinct"),
                _long(F.size(F.filter(words, lambda w: w.rlike(PLAIN)))).alias("n_plain"),
            ),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    lined = let(lines, lambda x: F.struct(_long(F.size(x)).alias("n_lines"), _long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    without = lambda pattern: _long(F.length(text) - F.length(F.regexp_replace(text, pattern, "")))
    return rows.select(
        "doc_id",
        let(words_of(text), counted).alias("w"),
        lined.alias("l"),
        without(f"[{SYMBOLS}]+").alias("n_symbols"),
        without("\\p{Lu}+").alias("n_upper"),
        without("[!?.,;:]+").alias("n_marks"),
    ).select("doc_id", "w.*", "l.*", "n_symbols", "n_upper", "n_marks")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(BAD)).when(good, F.lit(GOOD)).otherwise(F.lit(ABSTAIN))


def votes() -> list[Column]:
    """What each rule says of a row of ``text_counts``."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    share = lambda a, b: F.col(a) / b
    symbols, upper, marks, plain = share("n_symbols", words), share("n_upper", chars), share("n_marks", words), share("n_plain", words)
    distinct, repeat, same, length = share("n_distinct", words), share("n_repeat_words", words), share("n_dup_lines", lines), F.col("word_chars") / words
    many = F.col("n_words") >= 40
    return [
        _vote(symbols > 0.1, symbols < 0.02),
        _vote(upper > 0.3, upper < 0.1),
        _vote(marks > 0.8, marks < 0.4),
        _vote(plain < 0.8, plain > 0.95),
        _vote(many & (distinct < 0.4), distinct > 0.55),
        _vote(many & (repeat > 0.1), repeat == 0),
        _vote((F.col("n_lines") >= 4) & (same > 0.3), same == 0),
        _vote((length < 3) | (length > 8), (length >= 4) & (length <= 7)),
    ]


def _odds(vote: Callable[[int], Column], rules: int, prior: Column, good: Callable[[int], Column], bad: Callable[[int], Column]) -> Column:
    """Log odds of a good document. good, bad: how often rule k's vote is bad on each kind."""
    odds = F.log(prior / (1 - prior))
    for k in range(rules):
        spoke = F.when(vote(k) == BAD, F.log(good(k) / bad(k))).when(vote(k) == GOOD, F.log((1 - good(k)) / (1 - bad(k))))
        odds = odds + F.coalesce(spoke, F.lit(0.0))
    return odds


def estimate(votes_by_pattern: DataFrame, rules: int, rounds: int = ROUNDS) -> DataFrame:
    """One row, prior and good and bad (by rule), by expectation-maximisation over rows
    (votes array<int>, n long). The whole estimation is one expression over the sorted patterns."""
    patterns = votes_by_pattern.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    start = lambda p: F.array_repeat(F.lit(p), rules)
    state = F.struct(F.lit(PRIOR).alias("prior"), start(BAD_ON_GOOD).alias("good"), start(BAD_ON_BAD).alias("bad"))
    held = 1 + STRENGTH * F.col("rows")

    def one_round(p: Column, _: Column) -> Column:
        def weigh(x: Column) -> Column:
            odds = _odds(lambda k: F.get(x["votes"], F.lit(k)), rules, p["prior"], lambda k: F.get(p["good"], F.lit(k)), lambda k: F.get(p["bad"], F.lit(k)))
            q = 1 / (1 + F.exp(-odds))
            return F.struct(x["votes"].alias("votes"), (x["n"] * q).alias("good"), (x["n"] * (1 - q)).alias("bad"))

        def update(rows: Column) -> Column:
            total = lambda of: F.aggregate(rows, F.lit(0.0), lambda a, y: a + of(y))
            voted = lambda k, kind, what: total(lambda y: F.when(what(F.get(y["votes"], F.lit(k))), y[kind]).otherwise(0.0))

            def learned(kind: str, at: float) -> Column:
                rate = lambda k: (voted(k, kind, lambda v: v == BAD) + held * at) / (voted(k, kind, lambda v: v != ABSTAIN) + held)
                return F.array(*map(rate, range(rules)))

            good, bad = total(lambda y: y["good"]), total(lambda y: y["bad"])
            return F.struct(((good + held * PRIOR) / (good + bad + held)).alias("prior"), learned("good", BAD_ON_GOOD).alias("good"), learned("bad", BAD_ON_BAD).alias("bad"))

        return let(F.transform(F.col("patterns"), weigh), update)

    return patterns.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, one_round).alias("p")).select("p.*")


def quality(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, the base counts, base_failed, votes, probability, kept: one row per document row.

    Base rule: fewer than 20 words, or over 30 % of the words in 8-word windows that the text has
    twice or more. What passes it is kept if the rules' posterior probability of a good document is
    at least one half; estimates are over all rows that pass the base rule.

    A null text has no words, so it fails. Rows that share a doc_id are judged one by one, null
    doc_ids too. Extra columns are ignored, and an empty table gives an empty one.
    """
    rules = votes()
    counts = text_counts(documents)
    counts = counts.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    counts = materialize(counts.withColumn("votes", F.array(*rules)), "text-counts")
    by_pattern = counts.where(~F.col("base_failed")).groupBy("votes").agg(F.count("*").alias("n"))
    found = estimate(by_pattern, len(rules), rounds).collect()[0]  # a row of 1 + 2 * rules numbers
    at = lambda kind: lambda k: F.lit(found[kind][k])
    odds = _odds(lambda k: F.get("votes", F.lit(k)), len(rules), F.lit(found["prior"]), at("good"), at("bad"))
    probability = 1 / (1 + F.exp(-odds))
    return counts.withColumn("probability", probability).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= 0.5))
