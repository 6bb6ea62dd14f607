import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import langid as G


def corpus(rng, n):
    alphabets = {"aa": ["ka", "to", "mi"], "bb": ["zür", "öd", "wyx"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(alphabets))
        rows.append((i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 40))), lang))
    return rows


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = G.ByteGru.fresh(["x", "y"], 1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    lengths = [5, 2, 3]
    codes, mask = rng.integers(0, 256, (5, 3)).astype(np.uint8), np.array([[t < n for n in lengths] for t in range(5)], np.float64)
    labels = np.array([0, 1, 1])
    _, grads = net.gradients(codes, mask, labels)
    for name, w in net.weights.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in w.shape) if name != "embedding" else (codes[0, 0], rng.integers(0, w.shape[1]))
            old, sides = w[at], []
            for step in (1e-4, -1e-4):
                w[at] = old + step
                sides.append(net.gradients(codes, mask, labels)[0])
            w[at] = old
            assert grads[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-4, rel=2e-2, abs=2e-5), name


def test_padding_and_batches_change_nothing():
    net = G.ByteGru.fresh(["x", "y", "z"], 2)
    runs = [b"abc", b"d", "größer".encode(), b"q" * 70]
    together = net.label_runs(runs)[0]
    for run, row in zip(runs, together):
        assert net.label_runs([run])[0][0] == pytest.approx(row, rel=1e-4)
        assert row.sum() == pytest.approx(len(run), rel=1e-4)


def plainly(net, run):
    """The network's definition, byte by byte and number by number: the positions' probabilities."""
    w = {k: v.astype(float).tolist() for k, v in net.weights.items()}
    h, squash = G.HIDDEN, lambda x: x / (1 + abs(x))
    dot = lambda vector, matrix, column: sum(v * row[column] for v, row in zip(vector, matrix))
    states = {}
    for d in "fb":
        state, out = [0.0] * h, []
        for byte in run if d == "f" else reversed(run):
            x = [dot(w["embedding"][byte], w[f"w{d}"], j) + w[f"b{d}"][j] for j in range(3 * h)]
            update, reset = ([0.5 + 0.5 * squash(x[j] + dot(state, w[f"u{d}"], j)) for j in range(k * h, (k + 1) * h)] for k in (0, 1))
            mixed = [r * s for r, s in zip(reset, state)]
            new = [squash(x[j] + dot(mixed, w[f"u{d}"], j)) for j in range(2 * h, 3 * h)]
            state = [s + u * (n - s) for s, u, n in zip(state, update, new)]
            out.append(state)
        states[d] = out if d == "f" else out[::-1]
    for f, b in zip(states["f"], states["b"]):
        e = np.exp([dot(f + b, w["out"], j) + w["bias"][j] for j in range(len(net.languages))])
        yield e / e.sum()


@pytest.mark.parametrize(("stretch", "context"), [(512, 64), (7, 2), (16, 1)])
def test_no_cut_changes_the_labels(monkeypatch, stretch, context):
    monkeypatch.setattr(G, "STRETCH", stretch)
    monkeypatch.setattr(G, "CONTEXT", context)
    net = G.ByteGru.fresh(["x", "y", "z"], 5)
    runs = [b"", b"one run", "größer als jedes Wort 漢字 \n und so weiter ".encode() * 3, b"q" * 70]
    for run, found in zip(runs, net.label_runs(runs)[0]):
        assert found == pytest.approx(sum(plainly(net, run), np.zeros(3)), abs=2e-3 * (len(run) + 1))


def test_state_is_carried_over_where_it_lasts(monkeypatch):
    monkeypatch.setattr(G, "STRETCH", 8)
    monkeypatch.setattr(G, "CONTEXT", 2)
    net = G.ByteGru.fresh(["x", "y"], 6)
    for d in "fb":
        # gates that hardly open: what is read first is remembered to the end
        net.weights[f"b{d}"][: G.HIDDEN] = -30
        net.weights["embedding"][ord("!")] *= 40
    for run in (b"!" * 9 + b"a" * 90, b"a" * 99):
        assert net.label_runs([run])[0][0] == pytest.approx(sum(plainly(net, run), np.zeros(2)), abs=0.05)


def test_batch_limits_change_nothing(monkeypatch):
    net = G.ByteGru.fresh(["x", "y"], 3)
    texts = [" ".join(str(random.Random(i).randrange(200)) + "w" for _ in range(50)) + f" own{i}" for i in range(60)]
    want = list(G.pooled(net, texts))
    monkeypatch.setattr(G, "BYTES_AT_ONCE", 90)
    monkeypatch.setattr(G, "AT_ONCE", 3)
    got = list(G.pooled(net, texts))
    assert [x[0] for x in got] == [x[0] for x in want] and [x[1] for x in got] == pytest.approx([x[1] for x in want], abs=1e-5)


def test_copies_do_not_enlarge_the_sample(spark):
    rows = [(1, "the same text", "aa")] * 300 + [(i, f"text {i}", "aa") for i in range(2, 60)] + [(100 + i, "x" * 1000, "bb") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = G.training_sample(df, per_language=30, most_bytes=2500)
    assert sum(lang == "aa" for lang, _ in sample) <= 30 and sum(text == b"the same text" for _, text in sample) <= 1
    assert [len(text) for lang, text in sample if lang == "bb"] == [1000, 1000]
    assert sum(lang == "bb" for lang, _ in G.training_sample(df, 30, 10)) == 1


def test_held_out_accuracy(spark, odd):
    rows = corpus(random.Random(9), 400)
    extra = [(1000 + i, t, None) for i, (_, t) in enumerate(odd)] + [(None, "katomi", "aa"), (2000, "12 34 !!", "aa"), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    got = G.identify(df)
    found = got.collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows + extra) and all(0 <= r.score <= 1 for r in found)
    held = [(by[i].lang_pred, lang) for i, _, lang in rows if by[i].held_out]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.97
    assert by[2000].lang_pred == "und" and by[1007].lang_pred == "und" and by[None].held_out is False
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found if r.doc_id is not None)
    assert G.identify(df.limit(0)).count() == 0


def test_filter_keeps_all_columns_and_known_languages(docs_of):
    rows = [(i, "plain words of a language") for i in range(40)] + [(50, None), (51, "123"), (52, "")]
    docs = docs_of(rows)
    kept = G.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(40))


def test_filter_drops_foreign_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.", "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心。",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar.",
        "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。", "xq zzkw vvprt qqlm wxcvb jkhg pqzt mnbvc xxz wrtzp",
    ]
    more = spark.createDataFrame([(10_000 + i, t, "xx", "s", len(t)) for i, t in enumerate(foreign)], docs.schema)
    # the foreign texts are of no learned language: theirs is not given
    rows = docs.unionByName(more.withColumn("lang", F.lit(None).cast("string")))
    kept = {r.doc_id for r in G.keep_identified(rows).collect()}
    known = {r.doc_id for r in docs.collect() if r.text and any(map(str.isalpha, r.text))}
    assert len(known - kept) <= 0.002 * len(known) and not {i for i in kept if i >= 10_000}
    assert G.keep_identified(rows.limit(0)).count() == 0
