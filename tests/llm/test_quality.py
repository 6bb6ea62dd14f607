import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attesta.llm import quality as Q


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    twice = {p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in Q.SYMBOLS for c in text), len(lines) - len(set(lines)), len(twice)


def test_counts(docs_of, odd):
    rng = random.Random(4)
    odd = odd + [(200 + i, "\n".join(" ".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 6)))) for i in range(80)]
    odd += [(300, "a b c d e f g h " * 3), (301, "w " * 5000), (302, "\x0b#*$%&|<>\x0c\n\n a\r")]
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.text_counts(docs_of(odd)).collect())
    assert got == sorted((str(i), *base(t)) for i, t in odd)


def plain_em(patterns, rules, rounds):
    rows = sum(n for _, n in patterns)
    held = 1 + Q.STRENGTH * rows
    prior, good, bad = Q.PRIOR, [Q.BAD_ON_GOOD] * rules, [Q.BAD_ON_BAD] * rules
    for _ in range(rounds):
        weights = []
        for votes, n in patterns:
            odds = math.log(prior / (1 - prior))
            for k, v in enumerate(votes):
                odds += math.log(good[k] / bad[k]) if v == Q.BAD else math.log((1 - good[k]) / (1 - bad[k])) if v == Q.GOOD else 0
            q = 1 / (1 + math.exp(-odds))
            weights.append((votes, n * q, n * (1 - q)))
        g, b = sum(w[1] for w in weights), sum(w[2] for w in weights)
        rate = lambda k, i, at: (sum(w[i] for w in weights if w[0][k] == Q.BAD) + held * at) / (sum(w[i] for w in weights if w[0][k] != Q.ABSTAIN) + held)
        prior = (g + held * Q.PRIOR) / (g + b + held)
        good, bad = [rate(k, 1, Q.BAD_ON_GOOD) for k in range(rules)], [rate(k, 2, Q.BAD_ON_BAD) for k in range(rules)]
    return prior, good, bad


def test_estimation(spark):
    rng = random.Random(1)
    patterns = {}
    for _ in range(500):
        bad = rng.random() < 0.2
        votes = tuple(Q.ABSTAIN if rng.random() < 0.2 else Q.BAD if rng.random() < (0.5 if bad else 0.02) else Q.GOOD for _ in range(4))
        patterns[votes] = patterns.get(votes, 0) + 1
    patterns = sorted((list(v), n) for v, n in patterns.items())
    row = Q.estimate(spark.createDataFrame(patterns, "votes array<int>, n long"), 4, 15).collect()[0]
    prior, good, bad = plain_em(patterns, 4, 15)
    assert row.prior == pytest.approx(prior) and list(row.good) == pytest.approx(good) and list(row.bad) == pytest.approx(bad)


def test_junk_goes_and_prose_stays(docs_of, odd):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(10)) for _ in range(n)).capitalize() + "."
    rows = odd + [(1000 + i, prose(8)) for i in range(150)]
    rows += [(2000 + i, " ".join(w + "***" for w in prose(8).split())) for i in range(12)] + [(3000 + i, "!! ".join(prose(8).upper().split())) for i in range(12)] + [(4000 + i, " | ".join(prose(8).split())) for i in range(12)]
    got = {r.doc_id: r for r in Q.quality(docs_of(rows)).collect() if r.doc_id is not None}
    assert all(got[1000 + i].kept for i in range(150))
    assert not any(got[k].kept for k in got if k >= 2000)
    assert got[20].base_failed and not got[20].kept and got[301 if 301 in got else 21].base_failed
    assert Q.quality(docs_of([])).count() == 0


def test_nothing_but_built_in_functions(docs_of):
    plan = Q.text_counts(docs_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert isinstance(Q.let(F.lit(1), lambda x: x + 1), type(F.lit(1)))
