import random
import zlib

import numpy as np

from attesta.llm import toxicity as T


def corpus(rng, n):
    words = ["".join(rng.choice("bdfgklmnoprstuaei") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(10, 80))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(["dummkopp", "vexli" + rng.choice(["a", "on", "ter"]), "zorgwit"]))
        rows.append((i, ". ".join(" ".join(text[k : k + 9]) for k in range(0, len(text), 9)), int(toxic)))
    return rows


def marks(text, lexicon=("idiot",)):
    model = T.ToxicityModel(dict.fromkeys(lexicon, 2.0))
    return [(word, pattern) for _, found in model.clauses(text) for word, pattern, _ in found]


def test_grammar():
    assert marks("An idiot.") == [("idiot", "insult")]
    assert marks("You are an idiot") == [("idiot", "insult targeted")]
    assert marks("He is not an idiot at all") == [("idiot", "insult negated")]
    assert marks("She said you are an idiot") == [("idiot", "insult reported")]
    assert marks('The word "idiot" is old, idiot') == [("idiot", "insult reported"), ("idiot", "insult repeated")]
    # a target counts on either side
    assert marks("I will kill you. You I kill") == [("kill", "threat targeted"), ("kill", "threat targeted")]
    assert marks("I will not kill you; kill time") == [("kill", "threat negated"), ("kill", "threat")]
    assert marks("He said: I will kill you") == [("kill", "threat reported")] == marks("I will kill you, he said")
    assert marks('"A liar. An idiot." An idiot') == [("idiot", "insult reported"), ("idiot", "insult")]
    assert marks('He sat 5" apart\nAn idiot') == [("idiot", "insult")]
    assert marks("You. An idiot") == [("idiot", "insult")]
    assert marks("nothing of the kind") == []


def plainly(kinds, inside):
    """The patterns of a clause, looked up around each word without any machine."""
    for i, kind in enumerate(kinds):
        if kind not in (T.INSULT, T.THREAT):
            continue
        before = lambda what, reach: what in kinds[max(0, i - reach) : i]
        quoted = (kinds[:i].count(T.QUOTE) + inside) % 2
        name = "insult" if kind == T.INSULT else "threat"
        if quoted or T.REPORT in kinds[:i] or T.REPORT in kinds[i + 1 : i + 9]:
            yield f"{name} reported"
        elif before(T.NEGATION, 3):
            yield f"{name} negated"
        elif before(T.TARGET, 5) or T.TARGET in kinds[i + 1 : i + 4]:
            yield f"{name} targeted"
        elif kind == T.INSULT and before(T.INSULT, 4):
            yield "insult repeated"
        else:
            yield name


def test_machines_against_plain_search():
    rng, grammar = random.Random(4), T.Grammar()
    for _ in range(3000):
        kinds = rng.choices(range(7), [6, 2, 2, 1, 1, rng.choice([0, 1]), rng.choice([0, 1])], k=rng.randint(1, 14))
        inside = rng.random() < 0.2
        got = [T.pattern_of(s) for s in grammar.read(kinds, inside) if s.kind in (T.INSULT, T.THREAT)]
        assert got == list(plainly(kinds, inside)), kinds


def test_marks_decide(monkeypatch):
    rng = random.Random(8)
    filler = ["".join(rng.choice("bdfgklmnoprstuaei") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    rows = []
    for i in range(1600):
        text, insult = [rng.choice(filler) for _ in range(30)], rng.choice(["dummkopp", "vexlia", "zorgwit"])
        kind = rng.choice(["plain"] * 9 + ["asserted"] * 4 + ["negated", "reported"])
        clause = {"plain": "", "asserted": f"you {insult}", "negated": f"you are not a {insult}", "reported": f"she said you {insult}"}[kind]
        rows.append((" ".join(text[:15]) + ". " + clause + ". " + " ".join(text[15:]), int(kind == "asserted")))
    model = T.fit(rows[:1200])
    right = [(model.score(t) >= 0.5) == bool(y) for t, y in rows[1200:]]
    assert np.mean(right) > 0.98
    weights = dict(zip(T.PATTERNS, model.weights))
    assert weights["insult negated"] < weights["insult targeted"] and weights["insult reported"] < weights["insult targeted"]
    monkeypatch.setattr(T, "pattern_of", lambda symbol: "insult targeted")
    unmarked = [(model.score(t) >= 0.5) == bool(y) for t, y in rows[1200:]]
    assert np.mean(unmarked) < np.mean(right) - 0.08


def test_repeated_doc_ids_do_not_enlarge_the_sample(spark, docs_of):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(1, 1, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of([(i, f"text {i}") for i in range(40)] + [(7, f"more {k}") for k in range(500)] + [(8, None)])
    rows, share = T.training_sample(docs, labels)
    import zlib

    assert len(rows) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(40)) and 0.3 < share < 0.6
    assert len(T.training_sample(docs, labels, toxic=5, clean=3)[0]) == 8
    assert sorted(y for _, y in T.training_sample(docs, labels, most_bytes=1)[0]) == [0, 1]


def test_composition_reads_what_the_first_passes_on():
    a, b = T.Scope(T.TARGET, (T.INSULT,), "targeted", 2), T.Scope(T.NEGATION, (T.INSULT,), "negated", 2)
    both = T.Composed(a, b)
    for kinds in ([T.TARGET, T.NEGATION, T.INSULT], [T.NEGATION, T.OTHER, T.TARGET, T.INSULT], [T.INSULT]):
        one, two, pair = a.start, b.start, both.start
        for kind in kinds:
            one, x = a.step(one, T.Symbol(kind))
            two, x = b.step(two, x)
            pair, y = both.step(pair, T.Symbol(kind))
            assert x == y and pair == (one, two)


def test_copies_teach_no_words():
    rng = random.Random(1)
    rows = [(t, y) for _, t, y in corpus(rng, 600)]
    copy = "quibble frantz morbey lasten and so on and on"
    lexicon = T.learn_lexicon(rows + [(copy, 1)] * 40)
    assert {"dummkopp", "zorgwit", "vexli*"} <= lexicon.keys() and not {"quibble", "frantz"} & lexicon.keys()


def test_held_out_accuracy(spark, odd):
    rows = corpus(random.Random(6), 1500)
    df = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(9000 + i, t, "c") for i, (_, t) in enumerate(odd)] + [(None, "idiot", "c"), (0, rows[0][1], "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(99999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = T.score_toxicity(df, labels).collect()
    assert len(found) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    by = {r.doc_id: r for r in found}
    held = [(by[i].predicted, y) for i, _, y in rows if by[i].held_out]
    assert len(held) > 200 and np.mean([a == b for a, b in held]) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None) and by[None].held_out is False


def test_labels_of_one_kind_or_none(spark, docs_of):
    docs = docs_of([(1, "idiot"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in T.score_toxicity(docs, none).collect()} == {0}
    clean = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in T.score_toxicity(docs, clean).collect()} == {0}
    assert T.score_toxicity(docs.limit(0), clean).count() == 0
