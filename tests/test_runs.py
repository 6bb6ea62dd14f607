"""Whole runs with stand-in models."""

import json

import pytest
from pyspark.sql import functions as F

from attesta import schemas
from attesta.operators import models, runs

SOURCES = "id string, text string, tables string, tier string, registry array<struct<measure:string,value:double,ci_low:double,ci_high:double>>"
TEXTS = {
    "1": "Limb salvage improved survival. The hazard ratio was 0.84 (95% CI 0.70 to 0.99; P<0.05). A randomized trial.",
    "2": "Wound care matters for limb salvage. Healing took 12 weeks.",
    "3": "Nothing about it.",
    "4": "Limb salvage survival wound care again, in 30 patients.",
}


@pytest.fixture
def inputs(spark):
    results = spark.createDataFrame([(0, "a", i, id, 9, None) for i, id in enumerate(["1", "2", "9", "5"])] + [(1, "b", i, id, 9, None) for i, id in enumerate(["2", "3", "4"])], "topic_idx int, label string, pos long, id string, asked int, error string")
    heads = spark.createDataFrame([(0, "a", 9, None), (1, "b", 9, None)], "topic_idx int, label string, asked int, error string")
    seen = spark.createDataFrame([("9", "2023")], schemas.LEDGER)
    saved = spark.createDataFrame([], "pmid string, id string")
    cited = spark.createDataFrame([(i, None, "A", "2024", "J", f"Limb {i}", None, [], False, True) for i in ("1", "2", "3", "4", "5", "9")], schemas.CITATION)
    sources = spark.createDataFrame([(i, t, "", "abstract_only", None) for i, t in TEXTS.items()], SOURCES)
    return runs.Inputs(results, heads, seen, saved, cited, sources)


def test_digest(spark, inputs):
    settings = runs.Settings(criteria="limb salvage wound", now="2024-01-05", floor=50, count=3)
    d = runs.run_digest(inputs, settings)
    assert [(r.id, r.topics) for r in d.candidates.orderBy("idx").collect()] == [("1", ["a"]), ("2", ["b", "a"]), ("3", ["b"]), ("5", ["a"]), ("4", ["b"])]
    assert [r.id for r in d.picked.collect()] == ["2", "4", "1"]
    claims = {(r.id, r.quantity.value): r.verdict.tier for r in d.claims.collect()}
    assert claims == {("1", 0.84): "abstract-only", ("2", 12.0): "abstract-only", ("4", 30.0): "abstract-only"}
    rankings = {r.id: r for r in d.rankings.collect()}
    assert rankings["1"].finding == "Limb salvage improved survival." and rankings["1"].check.verdict == "supported" and rankings["2"].relevance == "Mentions limb, salvage, wound."
    assert [r.id for r in d.shown.orderBy("place").collect()] == ["1", "2", "4"]
    after = {r.id: r.first_seen for r in runs.commit(d, inputs, settings).collect()}
    assert after == {"9": "2023", "1": "2024-01-05", "2": "2024-01-05", "3": "2024-01-05", "4": "2024-01-05", "5": "2024-01-05"}
    again = runs.run_digest(inputs, settings, cached=d.rankings.where("id = '1'"))
    assert {r.id for r in again.claims.collect()} == {"2", "4"} and {r.id for r in again.rankings.collect()} == {"1", "2", "4"}
    claims, more = runs.top_up(d.shown, spark.createDataFrame([("3",), ("2",)], "id string"), inputs, settings)
    assert claims.count() == 0 and [r.id for r in more.collect()] == ["3"]


def test_a_made_up_number_never_passes(inputs):
    def lying(prompts):
        return [json.dumps({"id": p.partition("\n")[0], "score": "99", "tier": 1, "finding": "Halved deaths by 51%", "finding_plain": "Halved 51 deaths", "relevance": "In 3 ways"}) for p in prompts]

    d = runs.run_digest(inputs, runs.Settings(criteria="limb", now="n", floor=50, count=2, triage=lying))
    rows = d.rankings.collect()
    assert rows and all("51" not in r.finding and "3" not in r.relevance and r.check.verdict == "refuted" for r in rows)


def test_answers_without_contract_are_dropped(spark):
    calls = []

    def broken(prompts):
        calls.append(len(prompts))
        return ["{" if "bad" in p else json.dumps({"summary": p}) for p in prompts]

    df = spark.createDataFrame([("1", "fine"), ("2", "bad"), ("3", "")], "id string, p string")
    assert {r.id: r.answer.summary if r.answer else None for r in models.ask(df, F.col("p"), "summarize", broken).collect()} == {"1": "fine", "2": None, "3": ""}
    assert set(models.CONTRACTS) >= {"extract", "score", "triage", "check", "analyze", "merge_domains", "summarize", "categorize", "connect", "weekend", "question", "draft", "intake"}


def test_extraction_offline():
    got = json.loads(models.extract_offline(["No number here. HR 0·84 (95% CI 0.7 to 1,000; p = .03), n=9! In 1,234 patients."])[0])["quantities"]
    assert [(q["value"], q["ci_low"], q["ci_high"], q["p_value"]) for q in got] == [(0.84, 0.7, 1000.0, 0.03), (1234.0, None, None, None)]


def test_refile_weekend_and_profile(spark):
    papers = spark.createDataFrame([("a", "1", "Aortic repair aortic", "aortic graft", "2024-01-09T00:00:00"), ("b", "2", "My Plan", "", "2023-01-01T00:00:00")], "id string, pmid string, title string, finding string, savedAt string")
    concepts = spark.createDataFrame([("concept:aortic", "Aortic", True, 0), ("concept:old", "Old", False, 1)], "id string, label string, isHub boolean, pos long")
    edges = spark.createDataFrame([], "source string, target string, origin string, pos long")
    rows = {r.pmid: (r.concept_id, r.hub_id, r.tags) for r in runs.refile(papers, concepts, edges, F.array(F.lit("my plan"))).collect()}
    assert rows["1"] == ("concept:aortic-graft", "concept:aortic", ["aortic", "graft", "repair"]) and rows["2"] == ("concept:uncategorized", "concept:other", [])
    answer = json.dumps({"opener": "x", "threads": [{"anchor": "A", "pmids": ["1", "77", "2"], "narrative": "n"}, {"anchor": "B", "pmids": ["2"], "narrative": "n"}], "gaps": []})
    threads = runs.weekend_read(papers, F.lit("2024-01-10").cast("timestamp"), lambda prompts: [answer for _ in prompts]).collect()
    assert [(r.anchor, r.pmids) for r in threads] == [("A", ["1", "2"])]
    draft = models.ask(papers.limit(1), F.lit("x"), "draft", lambda p: [json.dumps({"name": " ", "northStars": [" s ", ""], "topics": [{"label": "L", "query": "q"}]}) for _ in p])
    row = models.profile_draft(draft).collect()[0]
    assert (row.name, row.northStars, row.projects, row.rubric.selectCount) == ("Doctor", ["s"], [], 5)
