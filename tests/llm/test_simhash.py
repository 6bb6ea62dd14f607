import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from attesta.llm import simhash as S


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [sum(xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def roots(fps, distance=2):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= distance:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(odd):
    for _, text in odd:
        if text is None or len(text) < 20000:
            assert S.fingerprint_of(text) == plain_fingerprint(text)


def test_same_hash_as_the_builtin(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).collect()[0]
    assert row.h % 2**64 == xxh64_intdigest(b"a b c", 42) == S.fingerprint_of("A  b\nC")


@pytest.mark.parametrize("limit", [1024, 8])
def test_components_are_those_of_all_pairs(spark, limit):
    rng = random.Random(limit)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            fps.add(base)
            for _ in range(rng.randint(0, 3)):
                base ^= 1 << rng.randrange(64)
    hub = rng.getrandbits(64)
    fps |= {hub ^ (1 << i) for i in range(64)} | {hub ^ (1 << i) ^ (1 << (i + 1) % 64) for i in range(64)} | {0}
    fps = sorted(fps)
    df = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long")
    edges = S.near_links(df, limit=limit)
    for a, b in edges.collect():
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    found = {r.node: r.root for r in S.components(edges).collect()}
    want = {}
    for f, root in zip(fps, roots(fps)):
        want.setdefault(root, set()).add(S._signed(f))
    got = {}
    for f in map(S._signed, fps):
        got.setdefault(found.get(f, f), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(min(members) == root for root, members in got.items())


def test_long_chains_settle(spark):
    chain = [(i, i + 1) for i in range(500)]
    random.Random(5).shuffle(chain)
    got = S.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert len(got) == 500 and {r.root for r in got} == {0}


def test_documents(docs_of, odd):
    rows = S.near_duplicate_groups(docs_of(odd)).collect()
    assert len(rows) == len(odd)
    fps = [S.fingerprint_of(t) for _, t in odd]
    ids = {}
    for (doc_id, _), root in zip(odd, roots(fps)):
        ids.setdefault(root, []).append(doc_id)
    want = sorted((str(d), S._signed(f), str(min((x for x in ids[r] if x is not None), default=None))) for (d, _), f, r in zip(odd, fps, roots(fps)))
    assert sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in rows) == want
    assert S.near_duplicate_groups(docs_of([])).count() == 0


def test_one_document_of_each_group_stays(docs_of):
    text = "one two three four five six seven"
    rows = [(5, text), (2, text), (2, text), (9, "something else entirely, with words of its own"), (1, None), (8, "")]
    kept = S.drop_near_duplicates(docs_of(rows))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, None), (2, text), (9, rows[3][1])]
    assert kept.columns == docs_of(rows).columns


def test_blocks_cover_every_close_pair():
    masks = S.key_masks()
    for i in range(64):
        for j in range(i):
            x = 1 << i | 1 << j
            assert any(not x & m for m in masks)
            assert all(any(not x & f & ~m for f in S.finer_masks(m)) for m in masks[:2])
    assert np.uint64(S._signed(1 << 63) % 2**64) == np.uint64(1 << 63)


def test_long_text_against_plain_python(odd):
    longest = max((t for _, t in odd if t), key=len)
    assert len(longest.split()) > 3 * 4096 and S.fingerprint_of(longest) == plain_fingerprint(longest)


def test_clashing_columns_stay(docs_of):
    from pyspark.sql import functions as F

    names = ("__fp", "__id", "__row", "__of", "__is", "__once", "doc", "component_id", "chosen", "n")
    docs = docs_of([(1, "one text of some words"), (2, "one text of some words"), (2, "one text of some words"), (3, None)])
    for name in names:
        docs = docs.withColumn(name, F.lit("mine"))
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert all(r[name] == "mine" for r in kept.collect() for name in names)
    assert S.drop_near_duplicates(docs.limit(0)).count() == 0
