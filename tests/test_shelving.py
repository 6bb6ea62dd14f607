"""Saving, filing and deleting papers on worked examples."""

import json

from pyspark.sql import functions as F

from attesta import schemas
from attesta.operators import library, shelving, topics

CITATION = "struct<title:string,pubtypes:array<string>,retracted:boolean,doi:string>"
PAPER = f"id string, pmid string, title string, finding string, citation {CITATION}, tags array<string>, conceptId string, domain string, pdfUrl string, oaUrl string, retracted boolean, favorite boolean, savedAt string"
QUANTITY = "struct<name:string,value:double>"
RESULT = f"paper struct<id:string,pmid:string,pmcid:string,title:string>, citation {CITATION}, rows array<struct<quantity:{QUANTITY},verdict:struct<flagged:boolean,tier:string>>>, source_text string, tables string, take struct<tier:int,finding:string,relevance:string,check:struct<verdict:string,reason:string>>, retracted boolean"


def no_projects():
    return F.array().cast("array<string>")


def empty(spark):
    return spark.createDataFrame([], PAPER), spark.createDataFrame([], schemas.NODE), spark.createDataFrame([], schemas.EDGE)


def result(id, title, retracted=False, doi=None):
    return ((id, id, None, title), (title, [], retracted, doi), [(("n", 1.0), (False, "t"))], "text", None, (1, "f", "r", None), False)


def analyze(concept, hub):
    return lambda prompts: [json.dumps({"concept": concept, "hub": hub, "domain": "vascular", "tags": ["A", "b", "a"]}) for _ in prompts]


def test_save_files_and_summarizes(spark):
    results = spark.createDataFrame([result("1", "One", doi="d1"), result("2", "Two"), result("3", "Gone", retracted=True)], RESULT)

    def summarizer(prompts):
        return [json.dumps({"summary": f" {p}\n"}) for p in prompts]

    papers, nodes, edges = empty(spark)
    nodes = spark.createDataFrame([("concept:limbs", "concept", "Limbs", "", None, [], "", [], True, None, None, None, "2023", "2023")], schemas.NODE)
    links = spark.createDataFrame([("d1", "", "page")], "doi string, pdf string, landing string")
    saved, concepts, shelved = shelving.save(papers, nodes, edges, results, no_projects(), "2024", analyze("Limb salvage", "limbs "), None, links)
    assert {r.id: (r.conceptId, r.domain, r.tags, r.oaUrl, r.pdfUrl) for r in saved.collect()} == {"1": ("concept:limb-salvage", "vascular", ["a", "b"], "page", None), "2": ("concept:limb-salvage", "vascular", ["a", "b"], None, None)}
    assert [(r.source, r.target, r.status) for r in shelved.collect()] == [("concept:limb-salvage", "concept:limbs", "confirmed")]
    touched = spark.createDataFrame([("concept:limb-salvage",), ("concept:limbs",), ("concept:limb-salvage",)], "id string")
    after = {r.id: (r.summary, r.updatedAt) for r in shelving.summarize(saved, concepts, touched, summarizer, "2025").collect()}
    assert after == {"concept:limb-salvage": ("CONCEPT: Limb salvage\n\nSOURCE PAPERS (2):\n1. One\n   Finding: f\n2. Two\n   Finding: f", "2025"), "concept:limbs": ("", "2023")}


def test_a_hub_that_is_not_there_is_other(spark):
    results = spark.createDataFrame([result("1", "One")], RESULT)
    papers, nodes, edges = empty(spark)
    saved, concepts, shelved = shelving.save(papers, nodes, edges, results, no_projects(), "2024", analyze("X", "Y"))
    assert shelved.count() == 0 and [r.id for r in concepts.collect()] == ["concept:x"] and saved.count() == 1
    hub = spark.createDataFrame([("concept:z", "concept", "Z", "", None, [], "", [], True, None, None, None, "2023", "2023")], schemas.NODE)
    _, concepts, shelved = shelving.save(papers, hub, edges, results, no_projects(), "2024", analyze("X", "Y"))
    assert {(r.id, r.isHub) for r in concepts.collect()} == {("concept:z", True), ("concept:x", False), ("concept:other", True)}
    assert [(r.source, r.target) for r in shelved.collect()] == [("concept:x", "concept:other")]


def test_file_anew(spark):
    papers, nodes, edges = empty(spark)
    assert all(t.count() == 0 for t in shelving.file_anew(papers, nodes, edges, no_projects(), "2024"))
    row = lambda id, hub, cites: (id, "concept", id[8:], "", None, [], "", cites, hub, None, None, None, "2023", "2023")
    nodes = spark.createDataFrame([row("concept:h", True, ["1"]), row("concept:old", False, ["2"])], schemas.NODE)
    edges = spark.createDataFrame([("e", "concept:old", "concept:h", "confirmed", "taxonomy", "", "2023", "2023")], schemas.EDGE)
    papers = spark.createDataFrame([("1", "1", "T", "f", None, [], "concept:old", "d", None, None, None, True, "2023"), ("2", "2", "U", None, None, None, None, None, None, None, None, None, None)], PAPER)
    after, concepts, links = shelving.file_anew(papers, nodes, edges, no_projects(), "2024", analyze("New", "H"), lambda p: ["{}" for _ in p])
    assert {r.id: (r.conceptId, r.domain, r.favorite) for r in after.collect()} == {"1": ("concept:new", "vascular", True), "2": ("concept:new", "vascular", None)}
    assert {r.id: sorted(r.sourcePmids) for r in concepts.collect()} == {"concept:h": [], "concept:new": ["1", "2"]}
    assert [(r.source, r.target) for r in links.collect()] == [("concept:new", "concept:h")]


def test_deleting_nothing_changes_nothing(spark):
    papers, nodes, edges = empty(spark)
    none = spark.createDataFrame([], "id string")
    papers = spark.createDataFrame([("1", None, None, None, None, None, None, None, None, None, None, None, None)], PAPER)
    left, _, _ = shelving.delete_concepts(papers, nodes, edges, none)
    kept, _ = shelving.delete_papers(papers, nodes, none)
    assert left.collect() == kept.collect() == papers.collect()


def test_pasted_topics_and_tags(spark):
    current = spark.createDataFrame([("a", 0, "L", "q"), ("b", 0, "M", "r")], "list_id string, pos int, label string, query string")
    pasted = spark.createDataFrame([("a", "x: y\n- z"), ("b", "  ")], "list_id string, text string")
    assert sorted((r.list_id, r.label, r.query) for r in topics.apply_paste(current, pasted).collect()) == [("a", "x", "y"), ("a", "z", "z"), ("b", "M", "r")]
    papers = spark.createDataFrame([("1", ["a", "b"], "é"), ("2", ["a"], "z"), ("3", None, "E"), ("4", ["a"], None)], "id string, tags array<string>, title string")
    assert [(r.id, r.tags) for r in library.by_title(library.without_tag(papers, "1", "a")).collect()] == [("4", ["a"]), ("3", None), ("1", ["b"]), ("2", ["a"])]
