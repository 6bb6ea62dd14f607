import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from attesta.llm import langid, line_dedup, queries  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    from test_decontaminate import brute as contaminated
    from test_line_dedup import brute as deduped
    from test_simhash import roots

    from attesta.llm import simhash

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_duplicates", "benchmark_decontamination", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    first = stage["language_id"](spark, docs, DATA)
    assert first.schema == docs.schema
    rows = {r.doc_id: r.text for r in first.collect()}
    assert len(rows) >= 0.97 * docs.count() and all(any(map(str.isalpha, t)) for t in rows.values())

    second = stage["line_dedup"](spark, first, DATA)
    want = {i: t for i, t, _, _ in deduped(sorted(rows.items()))}
    assert {r.doc_id: r.text for r in second.collect()} == want and all(r.n_chars == len(r.text) for r in second.collect())
    assert second.columns == docs.columns

    third = stage["near_duplicates"](spark, second, DATA)
    ids = sorted(want)
    groups = roots([simhash.fingerprint_of(want[i]) for i in ids])
    kept = {i for n, i in enumerate(ids) if groups[n] == n}
    assert {r.doc_id for r in third.collect()} == kept and third.columns == docs.columns

    fourth = stage["benchmark_decontamination"](spark, third, DATA)
    clean = {i for i, _, hit, _ in contaminated([(i, want[i]) for i in kept], benchmark) if not hit}
    assert {r.doc_id for r in fourth.collect()} == clean and fourth.columns == docs.columns and len(clean) < len(kept)

    packed = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in packed} == clean
    assert sum(r.length for r in packed) == sum({r.doc_id: r.doc_tokens for r in packed}.values())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, DATA).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_queries_run_and_have_their_columns(spark):
    want = {
        "op1_html_extraction": ["page_id", "url", "text", "n_chars"], "op3_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op6_toxicity": ["doc_id", "held_out", "score", "predicted"], "op7_simhash": ["doc_id", "fingerprint", "component_id"], "op10_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op8_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"],
    }
    for name, columns in want.items():
        df = queries.queries()[name](spark, DATA)
        assert df.columns == columns
    assert all(len(r.fingerprint) == 16 for r in queries.op7_simhash(spark, DATA).limit(5).collect())
    assert langid.UNDETERMINED == "und" and line_dedup.MIN_DOCUMENTS == 5


def test_stages_take_odd_tables(spark, docs_of, odd):
    docs = docs_of(odd)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, DATA)
            rows = out.collect()
            assert name == "packing" or out.columns == docs.columns
            if name == "line_dedup":
                assert len(rows) == table.count() and all(r.text is not None and r.n_chars == len(r.text) for r in rows)
            if name == "benchmark_decontamination":
                assert len(rows) == table.count()
