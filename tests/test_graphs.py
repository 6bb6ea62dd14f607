"""Graph, categories, domains, library."""

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as X
from attesta.operators import categories, domains, graph, library

NODE = "id string, kind string, label string, text string, desc string, tags array<string>, pos long"
EDGE = "id string, source string, target string, origin string, pos long"


def eid(a, b):
    return "~~".join(sorted((a, b)))


def suggested(spark, nodes, edges=()):
    n = spark.createDataFrame([(i, k, label, text, desc, tags, p) for p, (i, k, label, text, desc, tags) in enumerate(nodes)], NODE)
    e = spark.createDataFrame([(eid(s, t), s, t, o, p) for p, (s, t, o) in enumerate(edges)], EDGE)
    rows = graph.structural_suggestions(n, e).orderBy("pass", "seq").collect()
    return [(r["pass"], r.source, r.target, r.origin, r.rationale) for r in rows]


def concept(i, text, tags=()):
    return (i, "concept", i, text, None, list(tags))


ANCHOR = ("a", "project", "Limb Salvage Initiative", None, None, [])


def test_mentions_and_their_ties(spark):
    got = suggested(spark, [ANCHOR, concept("c1", "On limb salvage today"), concept("c2", "LIMB SALVAGE again"), concept("c3", "nothing")])
    assert got[:2] == [(1, "c1", "a", "structural", "mentions “limb salvage”"), (1, "c2", "a", "structural", "mentions “limb salvage”")]
    assert got[2:] == [(3, "c1", "c2", "structural", "both connect to “Limb Salvage Initiative”")]


def test_shared_stems_give_keyword_edges_without_ties(spark):
    nodes = [("a", "project", "Diabetic wound healing", None, "antibiotic dosing", []), concept("c1", "wounds that heal in diabetics"), concept("c2", "wounds and antibiotics"), concept("c3", "wounds only")]
    got = suggested(spark, nodes)
    assert [(g[0], g[1], g[3]) for g in got] == [(2, "c1", "keyword"), (2, "c2", "keyword")]


def test_the_cap_counts_new_edges_only(spark):
    anchor = ("a", "northStar", "aortic aneurysm repair", None, None, [])
    nodes = [anchor] + [concept(f"c{i:02}", "aneurysm of the aortic arch") for i in range(16)]
    got = suggested(spark, nodes, [("c00", "a", "keyword"), ("c01", "a", "claude")])
    assert [g[1] for g in got if g[0] == 2] == [f"c{i:02}" for i in range(2, 14)] and not any(g[0] == 3 for g in got)


def test_satellites_tie_but_are_not_noticed(spark):
    nodes = [ANCHOR, concept("hub", "x"), concept("c1", "limb salvage"), concept("c2", "limb salvage")]
    got = suggested(spark, nodes, [("c1", "hub", "taxonomy"), ("c1", "a", "structural")])
    assert (1, "c2", "a", "structural", "mentions “limb salvage”") in got and (3, "c1", "c2", "structural", "both connect to “Limb Salvage Initiative”") in got
    assert not any(g[0] <= 2 and g[1] == "c1" for g in got)


def test_tags_of_two_to_five(spark):
    nodes = [concept(f"c{i}", "", ["Common", *([" Pair "] if i < 2 else []), *(["pair"] if i == 1 else [])]) for i in range(6)]
    got = suggested(spark, nodes)
    assert got == [(4, "c0", "c1", "structural", "both tagged “pair”")]
    assert suggested(spark, nodes, [("c1", "c0", "structural")]) == []


def test_many_anchors_take_the_other_join(spark, monkeypatch):
    anchors = spark.createDataFrame([("a", "Limb Salvage Initiative"), ("b", "ai"), ("c", "é")], "id string, label string")
    texts = spark.createDataFrame([("1", "limb salvage"), ("2", "said"), ("3", "né"), ("4", None)], "id string, text string")
    few = {tuple(r) for r in graph.mentions(anchors, texts).collect()}
    monkeypatch.setattr(graph, "ANCHOR_BLOCK", 1)
    assert few == {tuple(r) for r in graph.mentions(anchors, texts).collect()}
    assert {x[:2] for x in few} == {("a", "1"), ("b", "2"), ("c", "3")}


def test_edges(spark):
    edges = spark.createDataFrame([("a~~b", "a", "b", "proposed", "structural", "", "t", None), ("a~~c", "c", "a", "confirmed", "taxonomy", "", "t", "t0")], "id string, source string, target string, status string, origin string, rationale string, ts string, confirmedAt string")
    new = spark.createDataFrame([("b", "a", "r", "keyword", 0), ("b", "c", "r1", "keyword", 1), ("c", "b", "r2", "claude", 2), ("d", "d", "r", "x", 3)], "source string, target string, rationale string, origin string, seq int")
    assert [(r.id, r.rationale, r.status) for r in graph.propose_edges(edges, new, "now").collect()] == [("b~~c", "r1", "confirmed")]
    assert {(r.id, r.status, r.confirmedAt) for r in graph.confirm_all(edges, "now").collect()} == {("a~~b", "confirmed", "now"), ("a~~c", "confirmed", "t0")}
    assert graph.dismiss_edge(edges, "a~~b").count() == 1 and graph.confirm_edge(edges, "a~~b", "n", "why").where("rationale = 'why' AND confirmedAt = 'n'").count() == 1
    nodes = spark.createDataFrame([("a", "project"), ("b", "concept"), ("c", "concept")], "id string, kind string")
    left, links = graph.remove_nodes(nodes, edges, spark.createDataFrame([("b",)], "id string"))
    assert {r.id for r in left.collect()} == {"a", "c"} and [r.id for r in links.collect()] == ["a~~c"]
    assert {r.id for r in graph.neighbours(nodes, edges, "a").collect()} == {"b", "c"} and {r.id: r.degree for r in graph.degrees(edges, True).collect()} == {"a": 1, "c": 1}
    assert graph.label_floor(nodes, edges, 2).collect()[0].floor == 1 and graph.label_floor(nodes, edges, 9).collect()[0].floor == 0
    links = spark.createDataFrame([("c", "a", "A"), ("b", "a", "A"), ("a", "a", "A")], "satellite string, hub string, label string")
    assert [(r.id, r.origin, r.rationale) for r in graph.link_to_hub(edges, links, "n").collect()] == [("a~~b", "taxonomy", "part of “A”")]


def test_upsert_and_anchors(spark):
    nodes = spark.createDataFrame([("concept:limb", "concept", "LIMB", "d", ["t1"], "old", ["1"], True, "2020", None), ("proj:pt-9", "project", "Gone", None, [], "", [], False, "2019", "synced"), ("ns:x", "northStar", "X", None, [], "", [], False, "2019", None)], "id string, kind string, label string, domain string, tags array<string>, summary string, sourcePmids array<string>, isHub boolean, addedAt string, source string")
    new = spark.createDataFrame([("Limb!", None, ["t2", "t1"], "", ["2", "1"], False), ("Arm", "e", [str(i) for i in range(20)], "s", [], False)], "name string, domain string, tags array<string>, summary string, sourcePmids array<string>, isHub boolean")
    got = {r.id: r for r in graph.upsert_concepts(nodes, new, "now").collect()}
    limb = got["concept:limb"]
    assert (limb.label, limb.domain, limb.tags, limb.summary, limb.sourcePmids, limb.isHub, limb.addedAt, limb.updatedAt, limb.text) == ("LIMB", "d", ["t1", "t2"], "old", ["1", "2"], True, "2020", "now", "Limb! t1 t2 old")
    assert len(got["concept:arm"].tags) == 12 and got["concept:arm"].addedAt == "now"
    projects = spark.createDataFrame([("7", "New", " d " * 200)], "id string, title string, description string")
    made, stale = graph.external_anchors(nodes, projects, "now")
    assert [(r.id, len(r.desc), r.label) for r in made.collect()] == [("proj:pt-7", 200, "New")] and [r.id for r in stale.collect()] == ["proj:pt-9"]
    profile = spark.createDataFrame([(" My plan ",), ("",)], "label string")
    made, stale = graph.profile_anchors(profile, nodes, False, projects, "now")
    assert [r.id for r in made.collect()] == ["proj:my plan"] and {r.id for r in stale.collect()} == {"ns:x"}
    made, stale = graph.profile_anchors(profile, nodes, True, projects, "now")
    assert {r.id for r in made.collect()} == {"proj:my plan", "proj:pt-7"} and {r.id for r in stale.collect()} == {"ns:x", "proj:pt-9"}
    links = spark.createDataFrame([("concept:limb", "because"), ("nowhere", "x"), ("concept:limb", " ")], "target_id string, rationale string")
    assert graph.proposed_connections(links, nodes).count() == 1


CONCEPT = "id string, label string, isHub boolean, pos long, summary string, sourcePmids array<string>, updatedAt string"


def planned(spark, proposal, concepts, edges=()):
    p = spark.createDataFrame([(i, label, m, j) for i, (label, members) in enumerate(proposal) for j, m in enumerate(members)], "cat_pos int, label string, member string, member_pos int")
    c = spark.createDataFrame([(i, label, hub, n, None, [], None) for n, (i, label, hub) in enumerate(concepts)], CONCEPT)
    e = spark.createDataFrame([(eid(s, t), s, t, "taxonomy", n) for n, (s, t) in enumerate(edges)], EDGE)
    return categories.plan_categorization(p, c, e), c, e


def test_plan(spark):
    concepts = [("h1", "Aorta", True), ("h2", "Old", True)] + [(f"c{i}", f"C{i}", False) for i in range(6)]
    proposal = [(" aorta ", ["c0", "c1", "nope"]), ("Veins", ["c1", "c2"]), ("veins", ["c3"]), ("Other", ["c4"]), ("", ["c5"])]
    plan, c, e = planned(spark, proposal, concepts, [("c0", "h2"), ("c4", "h1"), ("h1", "h2")])
    assert {(r.id, r.label, r.existing) for r in plan.shelves.collect()} == {("h1", "Aorta", True), ("concept:veins", "Veins", False), ("concept:other", "Other", False)}
    filed = {r.member: r.shelf for r in plan.assigned.collect()}
    assert filed == {"c0": "h1", "c1": "h1", "c2": "concept:veins", "c3": "concept:veins", "c4": "h1", "c5": "concept:other", "h2": "concept:other"} and plan.filed() == 7
    assert {(r.member, r.shelf) for r in plan.add.collect()} == {(m, s) for m, s in filed.items() if m != "c4"}
    assert {r.id for r in plan.remove.collect()} == {eid("c0", "h2"), eid("h1", "h2")} and [r.id for r in plan.demote.collect()] == ["h2"]
    steps = categories.apply_plan(plan, c, e, "now")
    assert [name for name, _ in steps] == ["put nodes", "add edges", "remove edges", "put nodes"] and steps[0][1].count() == 3 and steps[1][1].count() == 6


def test_plan_keeps_the_largest_nine(spark):
    concepts = [(f"c{i}", f"C{i}", False) for i in range(21)]
    proposal = [(f"S{i}", [f"c{2 * i}", f"c{2 * i + 1}"]) for i in range(10)] + [("S9", ["c20"])]
    plan, _, _ = planned(spark, proposal, concepts)
    shelves = {r.label for r in plan.shelves.collect()}
    assert shelves == {"Other", *(f"S{i}" for i in range(8)), "S9"} and {r.member for r in plan.assigned.where("shelf = 'concept:other'").collect()} == {"c16", "c17"}


@pytest.mark.parametrize(("hubs", "unfiled", "categorized", "reorganize"), [(10, 0, True, False), (11, 0, False, True), (2, 7, False, False), (2, 8, False, True), (0, 0, True, False)])
def test_gates(spark, hubs, unfiled, categorized, reorganize):
    concepts = [(f"h{i}", "", True, 0, None, [], None) for i in range(hubs)] + [(f"c{i}", "", False, 0, None, [], None) for i in range(unfiled + 1)]
    edges = [(eid(f"c{unfiled}", "h0"), f"c{unfiled}", "h0" if hubs else "gone", "taxonomy", 0)]
    if not hubs:
        concepts = concepts[:-1]
    row = categories.gates(spark.createDataFrame(concepts, CONCEPT), spark.createDataFrame(edges, EDGE)).collect()[0]
    assert (row.hubs, row.unfiled, row.categorized, row.reorganize) == (hubs, unfiled, categorized, reorganize)


def test_filing(spark, values):
    concepts = spark.createDataFrame([("concept:aorta", "Aorta", True, 0, None, [], None), ("concept:arch", "Arch", False, 1, None, [], None), ("concept:veins", "Veins", True, 2, None, [], None)], CONCEPT)
    edges = spark.createDataFrame([(eid("concept:arch", "concept:aorta"), "concept:arch", "concept:aorta", "taxonomy", 0)], EDGE)
    filings = spark.createDataFrame([("1", "Arch", "Veins"), ("2", "AORTA", "Veins"), ("3", "New", " veins "), ("4", "Newer", "Nowhere")], "pmid string, concept string, hub string")
    got = {r.pmid: (r.concept_id, r.hub_id) for r in categories.file_papers(filings, concepts, edges).collect()}
    assert got == {"1": ("concept:arch", "concept:aorta"), "2": ("concept:aorta", None), "3": ("concept:new", "concept:veins"), "4": ("concept:newer", "concept:other")}
    banned = F.array(F.lit("my plan"))
    for concept_, hub, want in [("A", "B", ("A", "B")), ("My Plan", "B", ("B", "B")), ("A", "my plan ", ("A", "A")), ("My Plan", "MY PLAN", ("Uncategorized", "Uncategorized"))]:
        c, h = categories.sanitize_filing(F.lit(concept_), F.lit(hub), banned)
        got = values(c=c, h=h)
        assert (got["c"], got["h"]) == want
    assert "Other" not in values(s=categories.shelf_summary(F.lit("Veins")))["s"] and values(s=categories.shelf_summary(F.lit(" other ")))["s"].startswith("Papers that don’t")


def test_domains(spark, values):
    known = spark.createDataFrame([("ai", "AI & Tech", "#e0605a", None, 0), ("limb-care", "Limb Care", "#5b93d6", "user", 1), ("ai-tech", "Other AI", "#a06cd5", None, 2)], "key string, label string, color string, source string, pos int")
    wanted = spark.createDataFrame([("AI",), ("Limb care",), ("limb & care",), ("ai and tech",), ("LimbCare",), ("New Field",), ("",), ("new  field",)], "raw string")
    got = {r.raw: r.key for r in domains.match_domains(wanted, known).collect()}
    assert got == {"AI": "ai", "Limb care": "limb-care", "limb & care": "limb-care", "ai and tech": "ai", "LimbCare": "limb-care", "New Field": None, "": None, "new  field": None}
    made = domains.ensure_domains(wanted, known).collect()
    assert [(r.key, r.pos, r.color) for r in made] == [("new-field", 3, "#45ac6d")]
    used = lambda n: F.array(*map(F.lit, domains.PALETTE[:n])) if n else F.array().cast("array<string>")
    got = values(a=domains.next_color(used(0)), b=domains.next_color(used(2)), c=domains.next_color(used(12)))
    assert list(got.values()) == [domains.PALETTE[0], domains.PALETTE[2], domains.PALETTE[0]]
    merges = spark.createDataFrame([(0, "ai", "limb-care"), (1, "ai", "ai-tech"), (2, "limb-care", "ai-tech"), (3, "ai-tech", "ai"), (4, "gone", "ai"), (5, "ai", "ai"), (6, "ai-tech", "gone")], "pos int, from string, into string")
    sparse = known.where("key <> 'limb-care'")
    none = spark.createDataFrame([], "key string")
    assert domains.pick_merges(merges.where("pos <> 2"), sparse, known, none).collect() == [(0, "ai", "limb-care")]
    assert domains.pick_merges(merges.where("pos <> 2"), sparse, known, known.where("key = 'ai'")).count() == 0 and domains.pick_merges(merges, sparse, known, none).count() == 0
    rows = spark.createDataFrame([("p", "ai"), ("q", None), ("r", "education")], "id string, domain string")
    assert {r.id: r.domain for r in domains.repoint(rows, merges.limit(1)).collect()} == {"p": "limb-care", "q": None, "r": "education"}
    assert {r.id: r.domain_label for r in domains.with_labels(rows, known).collect()} == {"p": "AI & Tech", "q": "Unclassified", "r": "Surgical Education"}
    assert {r.key for r in domains.owned(domains.rename(known, "ai", "A.I.")).collect()} == {"ai", "limb-care"} and domains.remove(known, "ai").count() == 2
    assert {r.key for r in domains.hydrate(known.limit(0), rows, rows).collect()} == {"education", "ai"}
    assert domains.hydrate(known, rows, rows).count() == 3 and not domains.worth_consolidating(known, sparse)


LIBRARY = "id string, pmid string, title string, finding string, notes string, tags array<string>, domain string, conceptId string"


@pytest.fixture
def shelf(spark):
    concepts = spark.createDataFrame([("c1", "Aorta", "", ["arch"], "d1", ["2"], False, 0), ("c2", "Veins", "about stents", [], "d2", ["2", "3"], False, 1), ("h", "Vessels", "", [], "d1", [], True, 2), ("e", "Empty", "", [], "d1", [], False, 3)], "id string, label string, summary string, tags array<string>, domain string, sourcePmids array<string>, isHub boolean, pos long")
    papers = spark.createDataFrame([("p1", "1", "One stent", "", "", [], "d1", "c1"), ("p2", "2", "Two", "", "", ["arch"], "d1", None), ("p3", "3", "Three", "f", "", [], "d2", "gone"), ("p4", "4", "Four stent", "", "", [], "d2", None)], LIBRARY)
    edges = spark.createDataFrame([("c1", "x", "taxonomy", 0), ("c1", "h", "taxonomy", 1), ("c2", "h", "keyword", 2)], "source string, target string, origin string, pos long")
    return concepts, papers, edges


def groups(shelf, **how):
    return [(r.concept_id, r.papers) for r in library.browse(*shelf, **how).orderBy("place").collect()]


def test_browse(shelf):
    assert groups(shelf) == [("c1", ["p1", "p2"]), ("c2", ["p3"]), (None, ["p4"])]
    assert groups(shelf, query=" STENT ") == [("c1", ["p1"]), ("c2", ["p3"]), (None, ["p4"])]
    assert groups(shelf, query="arch") == [("c1", ["p1", "p2"])] and groups(shelf, domain="d2") == [("c2", ["p3"]), (None, ["p4"])] and groups(shelf, topic="h") == [("c1", ["p1", "p2"])]
    assert tuple(library.browse_counts(library.browse(*shelf)).collect()[0]) == (2, 4)
    assert [(r.id, r.papers) for r in library.topic_counts(*shelf).collect()] == [("h", 2)]
    concepts, papers, edges = shelf
    assert {(r.concept_id, r.paper_id) for r in library.members(papers, concepts).collect()} == {("c1", "p1"), ("c1", "p2"), ("c2", "p2"), ("c2", "p3")}
    got = {r.id: (r.topic, r.topic_label, r.color) for r in library.topic_index(concepts, edges).collect()}
    assert got["c1"] == got["h"] == ("h", "Vessels", "#e0605a") and got["c2"] == (None, None, None)


def test_focus_favorites_and_records(spark, values):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    saved = spark.createDataFrame([("a", "2024-01-03T00:00:00"), ("b", "2024-01-02T23:59:59"), ("c", None)], "id string, savedAt string")
    assert {r.id: r.focus for r in library.focus_and_shelf(saved, now).collect()} == {"a": True, "b": False, "c": False}
    assert all(r.focus for r in library.focus_and_shelf(saved.where("id <> 'a'"), now).collect())
    papers = spark.createDataFrame([("a", None), ("b", True)], "id string, favorite boolean")
    assert {r.id for r in library.favorites(library.set_favorite(papers, "a")).collect()} == {"a", "b"} and library.favorites(library.set_favorite(papers, "b", False)).count() == 0
    tiers = spark.createDataFrame([("flagged",), ("",), (None,), ("verified-full-text",)], "tier string")
    assert tuple(library.rail_counts(tiers).collect()[0]) == (4, 2, 1)
    threads = spark.createDataFrame([(0, "A", ["1", "9", "1", "2"], "n"), (1, "B", ["2"], "n")], "pos int, anchor string, pmids array<string>, narrative string")
    one, two = spark.createDataFrame([("1",)], "pmid string"), spark.createDataFrame([("2",)], "pmid string")
    assert [(r.pos, r.pmids) for r in library.weekend_threads(threads, one, two).collect()] == [(0, ["1", "2"])]
    kinds = lambda a: values(k=library.anchor_kind(F.lit(a), F.array(F.lit("P")), F.array(F.lit("S"))))["k"]
    assert [kinds(" p"), kinds("s"), kinds("Cross-cutting")] == ["project", "northStar", "cross"]
    verdict, q = "struct<flagged:boolean,tier:string>", "struct<name:string,value:double>"
    ddl = f"paper struct<id:string,pmid:string,pmcid:string,title:string>, citation struct<title:string,retracted:boolean>, rows array<struct<quantity:{q},verdict:{verdict}>>, source_text string, tables string, take struct<tier:string,finding:string,relevance:string,check:struct<verdict:string,reason:string>>, retracted boolean"
    rows = [((i, i, None, "T"), ("Cited", r), [(("n", 1.0), (True, "flagged")), (("m", 2.0), (False, "abstract-only"))], None, None, ("1", "f", None, None), None) for i, r in (("a", None), ("b", True))]
    got = library.paper_records(spark.createDataFrame(rows, ddl), "now").collect()
    assert [r.id for r in got] == ["a"] and [(x.name, x.tier) for x in got[0].quantities] == [("m", "abstract-only")] and got[0].title == "Cited" and got[0].fullText == ""


def test_undirected_ids(values):
    assert values(a=X.edge_id(F.lit("b"), F.lit("a")))["a"] == eid("a", "b")
