import random

import pytest

from attesta.llm import line_dedup as L


def brute(rows, min_chars=40, min_documents=5):
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = L.line_key(line)
            if len(key) >= min_chars:
                holders.setdefault(key, set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            found = holders.get(L.line_key(line), ())
            known = [d for d in found if d is not None]
            if len(found) < min_documents or doc_id == (max(known) if known else None):
                kept.append(line)
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def got(docs):
    rows = L.dedup_lines(docs).collect()
    return sorted(((r.doc.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in rows), key=str)


def test_against_brute_force(docs_of, odd):
    assert got(docs_of(odd)) == brute(odd)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_corpora(docs_of, seed, spark):
    rng = random.Random(seed)
    pool = [f"{'line ' * 8}{i}" for i in range(40)] + ["short", ""]
    rows = [(rng.choice([None, *range(60)]), "\n".join(rng.choice(pool).upper() if rng.random() < 0.2 else f" {rng.choice(pool)}\t" for _ in range(rng.randint(1, 12)))) for _ in range(300)]
    assert got(docs_of(rows).repartition(7)) == brute(rows)


def test_a_line_in_every_document(docs_of):
    line = "The one line that every document of this table has in common, hot."
    rows = [(i, f"{line}\n{i}") for i in range(3000)]
    found = got(docs_of(rows).repartition(9))
    assert sum(r[3] for r in found) == 2999 and (2999, f"{line}\n2999", 2, 0) in found


def test_bitmap_and_key():
    import pandas as pd

    assert L.read_bitmap(L._bitmap(pd.Series([[0, 2, 9]]))[0]).tolist() == [0, 1, 0, 1, 1, 1, 1, 1, 1, 0]
    assert L.line_key("\x0b Ä ABCé\r") == "Ä abcé" and L.kept_text(None, None) == ("", 1, 0)


def test_empty_table(docs_of):
    assert got(docs_of([])) == []
