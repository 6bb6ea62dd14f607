import pytest

from attesta.plans import texts


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_any_number_of_short_passages_is_located(spark, monkeypatch, threshold):
    """Also beyond what is sent to every task, by a broadcast of the planner's or a product."""
    tables = {
        "documents": spark.createDataFrame([(i, f"Text number {i} speaks of alpha{i:03d} and beta{i % 7:03d}.") for i in range(30)], "doc_id long, text string"),
        "benchmark": spark.createDataFrame([(i, f"alpha{i:03d}") for i in range(20)] + [(100, "beta-003"), (101, "nothing of it")], "item_id long, text string"),
    }
    monkeypatch.setattr(texts, "table", lambda spark, sf_dir, name: tables[name])
    monkeypatch.setattr(texts, "MOST_SHORT", 5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        exact = sorted((r.doc_id, r.item_id, r.len) for r in texts.q07_locate_exact(spark, "").collect())
        found = sorted(map(tuple, texts.q08_locate_fuzzy(spark, "").select("doc_id", "item_id", "fuzzy").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert exact == [(i, i, 8) for i in range(20)]
    assert found == sorted([(i, i, False) for i in range(20)] + [(i, 100, True) for i in range(30) if i % 7 == 3])
