import random
import re

import pytest

from attesta.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items):
    windows = {}
    for item_id, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item_id is None else str(item_id))
    sizes = {len(k) for k in windows}
    out = []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= ids
        out.append((doc_id, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=str)


def got(docs, benchmark, **options):
    rows = D.benchmark_hits(docs, benchmark, **options).collect()
    spread = lambda r: sorted({p for a, b in zip(r.hit_starts, r.hit_ends) for p in range(a, b)})
    return sorted(((r.doc_id, r.n_words, spread(r), list(r["items"])) for r in rows), key=str)


@pytest.mark.parametrize("filter_bits", [24, 7])
def test_against_brute_force(spark, docs_of, odd, filter_bits):
    rng = random.Random(filter_bits)
    vocabulary = ["ka", "Lo", "mi", "né", "漢字", "x1"]
    prose = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " -- "]) for _ in range(n))
    items = [(i, prose(rng.choice([0, 1, 3, 9, 10, 11, 25, 60]))) for i in range(30)] + [(5, prose(12)), (None, prose(15)), (99, None), (98, "zulu " * 400)]
    rows = list(odd)
    for i in range(60):
        planted = rng.choice(items)[1] or ""
        rows.append((100 + i, prose(rng.randint(0, 40)) + " " + planted.upper() + " " + prose(5)))
    rows.append((400, "zulu " * 3000))
    rows.append((100, rows[-5][1]))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert got(docs_of(rows), benchmark, filter_bits=filter_bits) == brute(rows, items)


def test_every_shared_run_shares_a_kept_gram():
    rng = random.Random(7)
    for _ in range(200):
        run = [rng.randrange(5) for _ in range(10)]
        texts = [[str(x).encode() for x in [*(rng.randrange(5) for _ in range(rng.randint(0, 9))), *run, *(rng.randrange(5) for _ in range(rng.randint(0, 9)))]] for _ in range(2)]
        kept = []
        for t in texts:
            grams = D._grams(D._word_hashes(t), D.K)
            kept.append(set(grams[D.winnow(grams, 6)].tolist()))
        assert kept[0] & kept[1]


def test_empty_sides(spark, docs_of, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r[2] == [] for r in got(docs_of(odd), none))
    assert got(docs_of([]), none) == []


def test_only_clean_documents_stay(spark, docs_of):
    passage = "one two three four five six seven eight nine ten eleven"
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [(1, "so " + passage.upper()), (2, passage.replace("ten", "twelve")), (3, None), (4, passage[len("one two ") :])]
    for filter_bits in (24, 7):
        kept = D.drop_contaminated(docs_of(rows), benchmark, filter_bits)
        assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4] and kept.columns == docs_of(rows).columns


def test_a_larger_benchmark_sends_no_more(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    sizes = set()
    for items in (5, 300):
        windows = D.benchmark_windows(spark.createDataFrame([(i, prose(30)) for i in range(items)] + [(-1, "two words")], "item_id long, text string"))
        found, table = D._filter_of(windows, 12)
        assert found == [2, 10]
        sizes.add(table.nbytes)
    assert sizes == {512}
