"""Parsers, notes, the key-value store, projects, retractions, streams and sinks."""

import pytest
from pyspark.sql import functions as F

from attesta.functions import quantities as Q
from attesta.functions import render
from attesta.operators import drain, kv, projects, retractions
from attesta.sources import connector, notes, records
from attesta.streaming import ledger_stream

CITATION = "struct<display:string,author:string,journal:string,year:string,title:string,pubtypes:array<string>,retracted:boolean>"
ABSTRACT = "BACKGROUND: " + "limb salvage matters to many people. " * 5


@pytest.mark.parametrize(
    ("blocks", "want"),
    [
        (["1. J Vasc. 2024 Jan 3. doi: 10.1/x", "A title.", "Smith J(1), Doe AB(2), Roe C.", "Author information:\n(1)Somewhere", ABSTRACT, "© 2024 The Authors.", "PMID: 123"], ["A title.", ABSTRACT.strip()]),
        (["1. J Vasc. 2024.", "Smith J, Doe AB", "x" * 500], ["x" * 500]), (["only a short one"], ["only a short one"]), (["DOI: 10.1/x"], ["DOI: 10.1/x"]), (["2. In adults, ratio 2.5"], ["2. In adults, ratio 2.5"]),
    ],
)
def test_abstracts_are_cleaned(values, blocks, want):
    assert values(t=records.clean_abstract(F.lit("\n\n".join(blocks))))["t"] == "\n\n".join(want)


def test_too_little_left_gives_the_record_back(values):
    raw = "\n\n".join(["1. J Vasc. 2024 doi: " + "y" * 450, "Short."])
    assert values(t=records.clean_abstract(F.lit(raw)))["t"] == raw and values(t=records.clean_abstract(F.lit(" \n")))["t"] == " \n"


@pytest.mark.parametrize(
    ("raw", "want"),
    [(" 123 ", ("pmid", "123")), ("https://pubmed.ncbi.nlm.nih.gov/77/?x", ("pmid", "77")), ("see pmc99 or 10.1000/x", ("pmcid", "PMC99")), ("(doi 10.1000/ab.c).", ("doi", "10.1000/ab.c")), ("", None), (None, None), ("no id", None)],
)
def test_identifiers(values, raw, want):
    got = values(r=records.resolve_identifier(F.lit(raw).cast("string")))["r"]
    assert (tuple(got.values()) if got else None) == want


def test_identifiers_are_looked_up(spark):
    ids = spark.createDataFrame([("1", "PMC9", None), ("2", None, "10.1000/x")], "pmid string, pmcid string, doi string")
    raw = spark.createDataFrame([("5",), ("pmc9",), ("10.1000/x.",), ("pmc8",)], "raw string")
    assert {r.raw: r.pmid for r in records.resolve_pmids(raw, ids).collect()} == {"5": "5", "pmc9": "1", "10.1000/x.": "2", "pmc8": None}


@pytest.mark.parametrize(("raw", "want"), [("1.5 (x)", 1.5), ("<0.001", None), ("", None), (None, None), ("-.5e1z", -5.0), (" 7.", 7.0), ("abc", None)])
def test_leading_numbers(values, raw, want):
    assert values(n=Q.to_number(F.lit(raw).cast("string")))["n"] == want


FULL = """<article><body><sec><title>Results</title><p>The ratio   was <b>0.84</b>.</p><table-wrap><label>Table 1</label><table><tr><th>Arm</th><th>n</th></tr><tr><td>A</td><td></td><td>12</td></tr></table></table-wrap></sec>
<table-wrap><p>no rows</p></table-wrap><p>End.</p></body></article>"""


def test_full_texts(spark):
    rows = spark.createDataFrame([(FULL,), ("<article><front/></article>",), ("<broken",), (None,)], "xml string")
    got = [tuple(r.full) for r in records.full_texts(rows).collect()]
    assert got[0] == (True, "ResultsThe ratio was 0.84. End.", "Table 1\nArm | n\nA | 12\n\nno rows", "full_text")
    assert got[1:] == [(False, "", "", "abstract_only")] * 3


def test_abstract_records(spark):
    xml = "<PubmedArticle><PMID>7</PMID><Abstract><AbstractText Label='AIM'>To  see.</AbstractText><AbstractText>Seen.</AbstractText><AbstractText Label='X'/></Abstract></PubmedArticle>"
    rows = spark.createDataFrame([(xml,), ("<PubmedArticle/>",), ("?",)], "xml string")
    assert [tuple(r) for r in records.abstracts(rows).collect()] == [("7", "AIM: To see.\nSeen.")]


def test_best_source_links_and_search(spark, values):
    papers = spark.createDataFrame([("1", "PMC1"), ("2", "PMC2"), ("3", None)], "pmid string, pmcid string")
    full = records.full_texts(spark.createDataFrame([("PMC1", FULL), ("PMC2", "<a/>")], "pmcid string, xml string"))
    cleaned = spark.createDataFrame([("2", "abs")], "pmid string, abstract string")
    got = {r.pmid: (r.source.tier, r.source.text[:7]) for r in records.best_source(papers, full, cleaned).collect()}
    assert got == {"1": ("full_text", "Results"), "2": ("abstract_only", "abs"), "3": ("abstract_only", "")}
    link = lambda j: values(x=records.oa_link(F.lit(j)))["x"]
    assert link('{"best_oa_location": {"url": "u", "url_for_pdf": "p"}}') == {"url": "p", "isPdf": True} and link('{"best_oa_location": {"url": "u"}}') == {"url": "u", "isPdf": False}
    assert link('{"is_oa": false, "best_oa_location": {"url": "u"}}') is None and link("{}") is None and values(u=records.pmc_url(F.lit("pmc12")))["u"].endswith("/PMC12/")
    index = spark.createDataFrame([("a", "2024-01-09", "limb"), ("b", "2024-01-10", "LIMB"), ("c", "2023-01-01", "limb"), ("d", "2024-01-10", "arm")], "id string, entered string, text string").withColumn("entered", F.to_date("entered"))
    assert [r.id for r in records.search(index, ["limb"], 5, 3, "2024-01-11").collect()] == ["b", "a"] and [r.id for r in records.search(index, ["limb"], 1).collect()] == ["b"]
    known = spark.createDataFrame([("2", True), ("1", True), ("9", False)], "pmid string, verified boolean")
    wanted = spark.createDataFrame([(0, "1"), (1, "9"), (2, "2"), (3, "x")], "pos int, pmid string")
    assert [r.pmid for r in records.citations_in_order(wanted, known).collect()] == ["1", "2"]
    live = spark.createDataFrame([("a", "m", 1.0, None, None)], "id string, measure string, value double, ci_low double, ci_high double")
    static = spark.createDataFrame([("a", "s", 2.0, None, None), ("b", "s", 3.0, None, None)], live.schema)
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert {(r.id, r.value) for r in records.with_static_outcomes(ids, live, static).collect()} == {("a", 1.0), ("b", 3.0)}


@pytest.mark.parametrize(
    ("title", "types", "want"),
    [("RETRACTED: x", [], True), ("[Retracted] - x", [], True), ("x [retracted].", [], True), ("Retracted nerve", [], False), ("x", ["Retraction of Publication"], False), ("x", [" Retracted publication "], True), (None, None, False)],
)
def test_retractions(values, title, types, want):
    c = F.struct(F.lit(title).cast("string").alias("title"), F.lit(types).cast("array<string>").alias("pubtypes"), F.lit(None).cast("boolean").alias("retracted"))
    assert values(r=retractions.citation_retracted(c))["r"] is want


def test_saved_papers_follow_retractions(spark, values):
    papers = spark.createDataFrame([("a", "1", None, (None, "A", "J", "2020", "T", [], None)), ("b", "2", True, (None, "A", "J", "2020", "T", [], None)), ("c", "3", None, ("x", None, None, None, None, None, None))], f"id string, pmid string, retracted boolean, citation {CITATION}")
    current = spark.createDataFrame([("1", "Retracted: T", ["Retracted Publication"], False), ("2", "x", ["Retracted Publication"], False), ("3", "fine", [], False)], "pmid string, title string, pubtypes array<string>, retracted boolean")
    got = retractions.retraction_patches(papers, current, "now").collect()
    assert [(r.id, r.citation.author, r.citation.title, r.citation.retracted, r.retraction.checkedAt) for r in got] == [("a", "A", "Retracted: T", True, "now")]
    concepts = spark.createDataFrame([("x", ["1", "2"]), ("y", ["2"])], "id string, sourcePmids array<string>")
    assert [(r.id, r.sourcePmids) for r in retractions.remove_paper(concepts, "1").collect()] == [("x", ["2"])]
    got = values(t=retractions.text_citation_retracted(F.lit("Smith. Retracted Publication. J")), f=retractions.text_citation_retracted(F.lit("Retraction of publication")), l=retractions.as_list(F.lit("x")), n=retractions.as_list(F.lit(None).cast("string")))
    assert got == {"t": True, "f": False, "l": ["x"], "n": []}


PAPERS = f"id string, pmid string, title string, citation {CITATION}, tier string, finding string, relevance string, check struct<verdict:string,reason:string>, quantities array<struct<name:string,value:double,unit:string,ci_low:double,ci_high:double,p_value:double,source_quote:string,tier:string>>, pdfUrl string, oaUrl string, domain string, tags array<string>, conceptId string, savedAt string, updatedAt string, createdAt string, vaultWrittenAt string"


@pytest.fixture
def library(spark):
    cite = (None, "Smith J", "", "2024", None, None, None)
    papers = spark.createDataFrame(
        [
            ("a", "7", 'The "best" café in town for limbs today', cite, "1", "It works.", "For you", None, [("HR", 0.84, None, 0.7, 0.9, 0.01, "HR 0.84 (95% CI 0.70 to 0.9; P<.01)", "verified-full-text"), ("none", None, None, None, None, None, "", "x")], "http://pdf", "http://oa", "ai", ["t 1", "t2"], "c", "2024-01-02T03:04:05Z", None, None, None),
            ("b", None, None, None, None, "Bad.", None, ("refuted", "no"), None, None, "u", None, None, None, "?", None, None, "~"),
        ],
        PAPERS,
    )
    concepts = spark.createDataFrame([("c", "Café!", "Sum.", "ai", ["x", "y"], ["7"], "2024-01-01"), ("e", None, "", None, [], [], None)], "id string, label string, summary string, domain string, tags array<string>, sourcePmids array<string>, updatedAt string")
    memos = spark.createDataFrame([("m", "Note", "2024-01-02T03:04:05Z", None, None, None)], "id string, text string, createdAt string, updatedAt string, savedAt string, vaultWrittenAt string")
    domains = spark.createDataFrame([("ai", "AI & Tech", "#000000", None, 0)], "key string, label string, color string, source string, pos int")
    return papers, concepts, memos, domains


def test_notes(library, spark, tmp_path):
    papers, concepts, memos, domains = library
    got = {r.path: r.contents for r in notes.all_notes(papers, concepts, memos, domains, "Ann").collect()}
    assert got["sources/2024-01-02_the-best-cafe-in-town-for.md"] == (
        '---\ntitle: "The \\"best\\" café in town for limbs today"\ncitation: "Smith J · 2024"\npmid: 7\ntier: 1\ndomain: "AI & Tech"\ntags: ["t 1", t2]\npdf: "http://pdf"\nsaved: "2024-01-02T03:04:05Z"\n---\n\n'
        '# The "best" café in town for limbs today\n\n_**Relevance** — For you_\n\n## Finding\n\nIt works.\n\n## Verified evidence\n\n_Each value below was re-verified against the source. The tier is what the app proved,\nnot what a model asserted._\n\n'
        "- **HR:** 0.84 (CI 0.70–0.9), P<.01 — tier: `verified-full-text`\n\n## Source\n\n[PMID 7](https://pubmed.ncbi.nlm.nih.gov/7/)\n\n[Open-access full text (PDF)](http://pdf)\n"
    )
    assert got["sources/undated_pmid-unknown.md"].startswith("---\ntitle:\ncitation:\npmid:\n") and "couldn't confirm it (no)" in got["sources/undated_pmid-unknown.md"] and "## Source" not in got["sources/undated_pmid-unknown.md"]
    assert got["concepts/cafe.md"].endswith("## Sources\n\n- The \"best\" café in town for limbs today — Smith J · 2024 — [PMID 7](https://pubmed.ncbi.nlm.nih.gov/7/)\n\n**Tags:** x, y\n")
    assert "_No sources filed under this concept yet._" in got["concepts/concept.md"] and got["memos/2024-01-02-030405_memo.md"].endswith("# Memo — 2024-01-02\n\nNote\n")
    assert got["README.md"].startswith("# Ann's evidence library") and "- **2** sources\n- **2** concepts" in got["README.md"]
    assert {r.path for r in notes.stale_notes(papers, concepts, memos, domains).collect()} == {"sources/2024-01-02_the-best-cafe-in-town-for.md", "concepts/cafe.md", "memos/2024-01-02-030405_memo.md"}
    notes.write_notes(notes.memo_notes(memos), str(tmp_path))
    assert notes.read_note(spark, f"{tmp_path}/memos/2024-01-02-030405_memo.md") == got["memos/2024-01-02-030405_memo.md"] and notes.read_note(spark, f"{tmp_path}/none.md") is None


def test_weekly_ledger(values):
    threads = F.array(F.struct(F.lit("").alias("anchor"), F.lit("why").alias("narrative"), F.array(F.struct(F.lit("7").alias("pmid"), F.lit("T").alias("title"), F.lit(None).cast(CITATION).alias("citation"))).alias("papers")))
    entry = values(e=render.week_entry(F.lit("2024-01-08"), F.lit("Open."), threads, F.array(F.lit("gap"), F.lit(""))))["e"]
    assert entry == "## Week of 2024-01-08\n\nOpen.\n\n### Cross-cutting\n\nwhy\n\n**Converging papers:**\n- T — [PMID 7](https://pubmed.ncbi.nlm.nih.gov/7/)\n\n### Gaps\n- gap\n"
    book = "# Connections\n\n## Week of 2024-01-08\n\nold\n\n## Week of 2024-01-01\n\nolder\n"
    got = values(r=render.remove_week(F.lit(book), "2024-01-08"), last=render.remove_week(F.lit(book), "2024-01-01"), none=render.remove_week(F.lit(book), "2023"), p=render.prepend_week(F.lit(book), "2024-01-08", F.lit(entry)))
    assert got["r"] == "# Connections\n\n## Week of 2024-01-01\n\nolder\n" and got["last"] == "# Connections\n\n## Week of 2024-01-08\n\nold" and got["none"] == book
    assert got["p"].startswith("# Connections\n\n## Week of 2024-01-08\n\nOpen.") and got["p"].endswith("- gap\n\n## Week of 2024-01-01\n\nolder\n") and "old\n\n" not in got["p"]
    entries = F.array(F.struct(F.lit("T").alias("title"), F.lit(None).cast(CITATION).alias("citation"), F.lit("2").alias("tier"), F.lit("f").alias("finding")))
    assert values(d=render.digest_note(F.lit("2024"), entries))["d"] == "# Digest — 2024\n\n_1 paper._\n\n## T\n\n2\n\nf\n"


def test_drain(spark, values):
    rows = [("a", "T3", None, None, "T2"), ("b", "T1", None, None, "T2"), ("c", "", "T5", None, "T4"), ("d", None, None, "T0", None), ("e", None, None, None, "T1")]
    df = spark.createDataFrame(rows, "id string, savedAt string, updatedAt string, createdAt string, vaultWrittenAt string")
    assert [r.id for r in drain.stale(df).collect()] == ["d", "a", "c"]
    done = drain.stamped(df, df.where("id IN ('a', 'd')"), "T2")
    assert {r.id: r.vaultWrittenAt for r in done.collect()} == {"a": "T3", "b": "T2", "c": "T4", "d": "T2", "e": "T1"} and [r.id for r in drain.stale(done).collect()] == ["c"]


def test_kv(spark):
    rows = spark.createDataFrame([("u", "papers", "a", "1", "t1"), ("u", "papers", "b", "1", "t1"), ("v", "papers", "a", "9", "t1"), ("u", "profile", "me", "{}", "t1")], "user_id string, collection string, key string, value string, updated_at string")
    new = spark.createDataFrame([("u", "papers", "a", "2", "t2"), ("u", "papers", "a", "3", "t3"), ("u", "papers", "c", "1", "t2")], rows.schema)
    out = kv.scoped(kv.upsert(rows, new), "u")
    assert {(r.collection, r.key): r.value for r in out.collect()} == {("papers", "a"): "3", ("papers", "b"): "1", ("papers", "c"): "1", ("profile", "me"): "{}"}
    assert kv.get(out, "papers", "a").count() == 1 and kv.scan(out, "papers").count() == 3 and kv.delete(out, "papers", "a").count() == 3 and kv.delete(out, "papers").count() == 1
    assert kv.clear_user(rows, "u").count() == 1 and kv.clear_user(rows, "u", False).count() == 3
    keys = spark.createDataFrame([(f"{i:03}",) for i in range(25)], "key string")
    assert [len(p) for p in kv.pages(keys, 10)] == [10, 10, 5] and [len(p) for p in kv.pages(keys.limit(0), 10)] == [] and [len(p) for p in kv.pages(keys, 25)] == [25]
    entries = spark.createDataFrame([("papers", "a", "{}"), ("profile", "libraryHandle", "{}"), ("x", "a", "{}"), ("memos", "m", "{"), ("memos", "n", None)], "collection string, key string, value string")
    assert [(r.collection, r.key, r.updated_at) for r in kv.migration_rows(entries, "u", "now").collect()] == [("papers", "a", "now")]
    assert kv.should_offer_migration(entries, rows.limit(0)) and not kv.should_offer_migration(entries, rows) and kv.log_event(None, "x", "{}", spark, None) is None


def test_projects(spark, values):
    made = spark.createDataFrame([("1", "A", "x " * 100, "2024-05-06T00:00", "2024-01-02", None, 10), ("2", "B", None, None, "2024-01-01", None, 10), ("3", "C", "", None, None, None, 20), ("4", "D", "", None, "2024-01-09", "gone", 10), ("5", "E", "", None, "2024", None, 30)], "id string, title string, description string, deadline_at string, updated_at string, deleted_at string, current_stage_id int")
    stages = spark.createDataFrame([(10, "Draft", 2), (20, "Plan", 1), (30, "Sent", 7)], "id int, name string, position int")
    rows = projects.with_stages(made, stages)
    assert [r.id for r in projects.pre_submission(rows).collect()] == ["1", "2", "3"]
    excluded = spark.createDataFrame([("2",)], "id string")
    manual = spark.createDataFrame([(0, "own")], "pos int, line string")
    lines = [r.line for r in projects.merged_lines(manual, rows, excluded).orderBy("place").collect()]
    assert lines[0] == "own" and lines[1].startswith("A (Draft), due 2024-05-06 — x x") and lines[1].endswith("…") and lines[2] == "C (Plan)" and len(lines) == 3
    assert {r.id for r in projects.toggle_excluded(excluded, "2").collect()} == set() and {r.id for r in projects.toggle_excluded(excluded, "3").collect()} == {"2", "3"}
    codes = lambda q: [i["code"] for i in values(i=projects.topic_issues(F.lit(q).cast("string")))["i"]]
    assert codes(None) == ["empty"] and codes("a AND b AND c") == ["and-chain"] and codes("one two three four five") == ["juxtaposed"] and codes("one two three four and OR five six") == []
    assert codes("limb[tiab]") == ["field-tag", "bare-word"] and codes("limb") == ["bare-word"] and codes("limb OR foot") == [] and codes("FOR ORAL care") == []
    topics = spark.createDataFrame([(i, "a OR b" if i else "x") for i in range(7)], "pos int, query string")
    assert tuple(projects.check_topics(topics).collect()[0])[:4] == (7, 1, False, None) and projects.check_topics(topics.where("pos > 5")).collect()[0].list_issue == "too-few"
    assert projects.check_topics(topics.limit(0)).collect()[0].list_issue == "none"
    turns = F.array(*(F.struct(F.lit(q).alias("question"), F.lit(a).cast("string").alias("answer")) for q, a in [("Q1", " yes "), ("Q2", None)]))
    got = values(t=projects.transcript_text(turns), n=projects.answered(turns), c=projects.can_draft(turns), o=projects.out_of_turns(turns), f=projects.fallback_question(turns, ["Q1", "Q3"]))
    assert got == {"t": "Q: Q1\nA: yes\n\nQ: Q2\nA: (skipped)", "n": 1, "c": False, "o": False, "f": "Q3"}
    ddl = "user_id string, name string, northStars array<string>, rubric struct<criteria:string,selectCount:int>"
    base = spark.createDataFrame([("u", "A", ["x"], ("c", 5)), ("v", "B", [], ("d", 6))], ddl)
    patch = spark.createDataFrame([("u", None, ["y"], ("new", None))], ddl)
    got = {r.user_id: r for r in projects.merge_profile(base, patch, ("name", "northStars")).collect()}
    assert got["u"].name == "A" and got["u"].northStars == ["y"] and tuple(got["u"].rubric) == ("new", 5) and got["v"].onboarded


def test_connector(spark, tmp_path):
    (tmp_path / "summary-7.json").write_text('{"a": 1}')
    (tmp_path / "summary-8.json").write_text("{}")
    (tmp_path / "full-9.xml").write_text("<a/>")
    connector.register(spark)
    got = spark.read.format("recorded").option("path", str(tmp_path)).option("kind", "summary").load()
    assert sorted(tuple(r) for r in got.collect()) == [("7", '{"a": 1}'), ("8", "{}")]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert connector.with_retry(flaky, wait=0) == "ok" and connector.pace(True) < connector.pace(False)
    with pytest.raises(OSError):
        connector.with_retry(lambda: open("/nonexistent").read(), wait=0)


def test_streams_give_what_batches_give(spark, tmp_path):
    source = str(tmp_path / "in")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("type"))
    for part in range(3):
        events.where(F.col("id").cast("int") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    folder = str(tmp_path / "ledger")
    ledger_stream.keep_ledger(stream(), folder, str(tmp_path / "cp1"), lambda n: f"2024-01-0{n + 1}", capacity=20).awaitTermination()
    kept = ledger_stream.current_ledger(spark, folder)
    assert kept.count() == min(20, events.select("id").distinct().count())
    q = ledger_stream.first_seen(stream()).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == events.select("id").distinct().count()
    q = ledger_stream.counts_by_window(stream()).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < spark.table("windows").agg(F.sum("n")).collect()[0][0] <= events.count()
    records_in = str(tmp_path / "rec")
    df = spark.createDataFrame([("a", "T3", "T2"), ("b", "T1", "T2")], "id string, savedAt string, vaultWrittenAt string").withColumn("updatedAt", F.lit(None).cast("string")).withColumn("createdAt", F.lit(None).cast("string"))
    df.write.parquet(records_in)
    written = []
    ledger_stream.drain_stream(spark.readStream.schema(df.schema).parquet(records_in), str(tmp_path / "cp4"), lambda b, n: written.extend(r.id for r in b.collect())).awaitTermination()
    assert written == ["a"]
