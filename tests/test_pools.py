"""Topic merge, ledger, funnel."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import digests, funnel, ledger, topics

RESULT = "topic_idx int, label string, pos long, id string, asked int, error string"


def pool_of(searches, skip, cap):
    """The contract in plain Python: searches are (label, ids, error)."""
    kept, counts = [], []
    for label, ids, error in searches:
        if error:
            kept.append([])
            counts.append((label, None, None, None))
            continue
        clean = list(dict.fromkeys(str(x).strip() for x in ids if x is not None and str(x).strip()))
        unseen = [x for x in clean if x not in skip]
        kept.append(unseen[:cap])
        counts.append((label, len(unseen[:cap]), len(unseen), len(clean) - len(unseen)))
    order, names = [], {}
    for depth in range(max(map(len, kept), default=0)):
        for (label, *_), ids in zip(searches, kept):
            if depth < len(ids):
                if ids[depth] not in names:
                    order.append(ids[depth])
                names.setdefault(ids[depth], [])
                if label not in names[ids[depth]]:
                    names[ids[depth]].append(label)
    return [(x, i, names[x]) for i, x in enumerate(order)], counts


@pytest.mark.parametrize("seed", range(4))
def test_merge(spark, seed):
    rng = random.Random(seed)
    searches = [(f"t{i}", [rng.choice([None, " ", *range(12)]) for _ in range(rng.randint(0, 15))], "down" if rng.random() < 0.2 else None) for i in range(5)]
    skip = {str(rng.randrange(12)) for _ in range(3)}
    rows = [(i, label, p, None if x is None else str(x), 8, error) for i, (label, ids, error) in enumerate(searches) for p, x in enumerate(ids)]
    results = spark.createDataFrame(rows, RESULT)
    heads = spark.createDataFrame([(i, label, 8, error) for i, (label, _, error) in enumerate(searches)], "topic_idx int, label string, asked int, error string")
    skipped = spark.createDataFrame([(x,) for x in skip], "id string")
    pool, counts = pool_of(searches, skip, 4)
    got = topics.topic_pool(results, heads, skipped, 4).orderBy("place").collect()
    assert [(r.id, r.place, r.topics) for r in got] == pool
    got = topics.topic_counts(results, heads, skipped, 4).orderBy("topic_idx").collect()
    assert [(r.label, r["count"], r.available, r.skipped) for r in got] == counts
    assert [r.label for r in topics.held_back(topics.topic_counts(results, heads, skipped, 4)).collect() if r["count"] < r.available] == [c[0] for c in counts if c[1] is not None and c[1] < c[2]]


def test_skip_before_cap(spark):
    results = spark.createDataFrame([(0, "a", i, str(i), 5, None) for i in range(5)], RESULT)
    heads = spark.createDataFrame([(0, "a", 5, None)], "topic_idx int, label string, asked int, error string")
    seen = spark.createDataFrame([("0",), ("1",)], "id string")
    assert [r.id for r in topics.topic_pool(results, heads, seen, 2).orderBy("place").collect()] == ["2", "3"]


@pytest.mark.parametrize(("raw", "days", "cap"), [(None, 3, 10), ("", 3, 10), ("x", 3, 10), ("0", 1, 1), ("2.5", 3, 3), ("900", 90, 50), ("7", 7, 7), ("-3", 1, 1)])
def test_clamps(values, raw, days, cap):
    c = F.lit(raw).cast("string")
    got = values(d=topics.search_days(c), c=topics.topic_cap(c), o=topics.overfetch(c, c), l=topics.lookback_options(c))
    assert (got["d"], got["c"], got["o"]) == (days, cap, min(cap * (1 + days), 100)) and got["l"] == [x for x in (7, 30, 90) if x > days]


def test_pasted_topics(spark):
    texts = {
        "json": '[{"label": "A", "query": "a b"}, {"topic": "B", "term": "A B"}, {"q": "c d"}, {"label": " "}]', "fragment": '{"label": "A", "query": "a b"},\n{"name": "B", "q": "b c"},',
        "object": '{"topics": [{"label": "A", "query": "x y"}]}', "one": '{"label": "Solo", "query": "s t"}', "strings": '["one two", "three"]', "empty": "  ",
        "lines": "- Limb: limb OR foot\n# no\n// no\n* Tab\tquery: with colon\nplain words\n\nLIMB2: limb or foot",
    }
    rows = topics.parse_topics_text(spark.createDataFrame(list(texts.items()), "list_id string, text string")).orderBy("list_id", "pos").collect()
    got = {}
    for r in rows:
        got.setdefault(r.list_id, []).append((r.label, r.query))
    assert got == {
        "json": [("A", "a b"), ("c d", "c d")], "fragment": [("A", "a b"), ("B", "b c")], "object": [("A", "x y")], "one": [("Solo", "s t")], "strings": [("one two", "one two"), ("three", "three")],
        "lines": [("Limb", "limb OR foot"), ("Tab", "query: with colon"), ("plain words", "plain words")],
    }
    stars = spark.createDataFrame([("s", 0, " Feet "), ("s", 1, "feet"), ("s", 2, None)], "list_id string, pos int, star string")
    assert [(r.label, r.query) for r in topics.topics_from_stars(stars).collect()] == [("Feet", "Feet")]


def test_candidates_drop_retracted(spark):
    results = spark.createDataFrame([(0, "a", i, str(i), 5, None) for i in range(4)], RESULT)
    heads = spark.createDataFrame([(0, "a", 5, None)], "topic_idx int, label string, asked int, error string")
    none = spark.createDataFrame([], "id string")
    cited = spark.createDataFrame([("0", "T", None, False, True), ("1", "Retracted: T", None, False, True), ("2", "T", None, False, False), ("3", "T", ["Retracted Publication"], False, True)], "pmid string, title string, pubtypes array<string>, retracted boolean, verified boolean")
    assert [r.id for r in topics.candidates(results, heads, none, cited).collect()] == ["0"]
    attached = topics.attach_topics(spark.createDataFrame([("0",), ("9",)], "id string"), topics.topic_pool(results, heads, none))
    assert {r.id: r.topics for r in attached.collect()} == {"0": ["a"], "9": []}
    assert topics.preview(results, heads, 2).count() == 2


def test_ledger(spark):
    old = spark.createDataFrame([("1", "2024-05-01"), ("2", ""), ("3", "2024-01-01")], "id string, first_seen string")
    new = spark.createDataFrame([("1",), ("4",), ("4",), ("",)], "id string")
    merged = ledger.merge_seen(old, new, "2020-01-01")
    assert {r.id: r.first_seen for r in merged.collect()} == {"1": "2024-05-01", "2": "", "3": "2024-01-01", "4": "2020-01-01"}
    assert {r.id for r in ledger.cap_ledger(merged, 2.9).collect()} == {"1", "3"}
    assert ledger.ledger_limit(-1) == ledger.ledger_limit(float("nan")) == ledger.ledger_limit(None) == 5000 and ledger.cap_ledger(merged, 0).count() == 0
    tied = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "id string, first_seen string")
    assert {r.id for r in ledger.cap_ledger(tied, 2).collect()} == {"b", "c"}
    raw = spark.createDataFrame([('{"ids": {"7": "2024-01-01", "8": "soon", "": "2024"}}',)], "ledger string")
    assert {(r.id, r.first_seen) for r in ledger.normalize_ledger(raw).collect()} == {("7", "2024-01-01"), ("8", "")}


@pytest.mark.parametrize(("errors", "want"), [([None, "x"], {"1", "3"}), (["x", "x"], set()), ([], {"1", "2", "3"})])
def test_stampable(spark, errors, want):
    pool = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    outcomes = spark.createDataFrame([(str(i + 1), e) for i, e in enumerate(errors)], "id string, error string")
    assert {r.id for r in ledger.stampable(pool, outcomes).collect()} == want


@pytest.mark.parametrize(("raw", "clamped", "floor", "pre"), [("70", 70, 70, 50), ("55", 55, 55, 35), ("10", 10, 10, 0), (None, 0, 70, 50), ("", 0, 70, 50), ("x", 0, 70, 50), ("140", 100, 100, 80), ("-5", 0, 0, 0), ("69.5", 70, 70, 50)])
def test_scores(values, raw, clamped, floor, pre):
    c = F.lit(raw).cast("string")
    assert list(values(a=funnel.clamp_score(c), b=funnel.score_floor(c), c=funnel.pre_read_floor(c)).values()) == [clamped, floor, pre]


def test_post_read_floor(spark):
    results = spark.createDataFrame([("high", 0, None, False), ("failed", 1, "e", False), ("low", 2, None, False), ("gone", 3, None, True), ("none", 4, None, None)], "id string, idx int, error string, retracted boolean")
    rankings = spark.createDataFrame([("high", "92"), ("low", "12"), ("gone", "99")], "id string, score string")
    assert [(r.id, r.place) for r in funnel.post_read_floor(results, rankings, 55).orderBy("place").collect()] == [("high", 1), ("failed", 2)]
    assert tuple(funnel.post_read_counts(results, rankings, 55).collect()[0]) == (3, 1, 2)


def test_scoring_end_to_end(spark):
    pool = spark.createDataFrame([(str(i), i, f"limb study {i}" if i % 2 else "other", "J", "2024", ["Journal Article", "Review"], 5) for i in range(65)], "id string, idx int, title string, journal string, year string, pubtypes array<string>, score int")
    block = funnel.candidate_block(F.lit(None).cast("string"))
    shown = pool.select(block.alias("b")).collect()[1].b
    assert shown == "[1] limb study 1\n  J (2024) · Review\n  Abstract: (not available)"
    sizes = []

    def scorer(blocks):
        assert len(blocks) <= 30
        return funnel.overlap_scorer("limb")(blocks) + [{"id": "unknown", "score": 9}, {"id": None, "score": 1}]

    scores = funnel.score_with(pool.coalesce(1), scorer, block)
    best = funnel.attach_scores(pool, scores)
    rows = best.collect()
    assert [r.id for r in rows[:2]] == ["1", "3"] and rows[0].score == 100 and rows[-1].score == 0 and len(rows) == 65 and not sizes
    assert funnel.apply_floor(best, 70, 3).count() == 3 and funnel.apply_floor(best, 70, None).count() == 32
    assert tuple(funnel.floor_counts(best, 70, 3).collect()[0]) == (65, 32, 3)
    assert {r.batch for r in funnel.batches(pool, ["idx"]).collect()} == {0, 1, 2}


def test_labels(values):
    got = values(
        fit=funnel.read_fit_label(F.lit("71")), none=funnel.read_fit_label(F.lit("")), below=funnel.below_floor_note(F.lit("40"), F.lit("55")), fine=funnel.below_floor_note(F.lit("60"), F.lit("55")),
        shown=funnel.display_score(F.lit(True), F.lit(None), F.lit("3")), after=funnel.display_score(F.lit(True), F.lit("9"), F.lit("3")), s0=funnel.floor_summary(*map(F.lit, (0, 0, 0, 70))),
        s1=funnel.floor_summary(*map(F.lit, (1, 0, 0, 70))), s2=funnel.floor_summary(*map(F.lit, (5, 3, 2, 70))), s3=funnel.floor_summary(*map(F.lit, (5, 5, 2, 70))), s4=funnel.floor_summary(*map(F.lit, (5, 5, 5, 70))),
    )
    assert got["fit"] == "fit 71 after reading" and got["none"] == "" and got["below"].startswith("40 after reading — below your bar of 55") and got["fine"] == ""
    assert got["shown"] == 3 and got["after"] == 9 and got["s0"] == got["s4"] == "" and "1 paper scored, none reached 70" in got["s1"] and got["s2"].endswith("The top 2 made the digest.") and "all 5" in got["s3"]


def test_merge_by_id(spark):
    first = spark.createDataFrame([("a", 0, "old"), ("b", 1, "old")], "id string, idx long, v string")
    later = spark.createDataFrame([("c", 0, "new"), ("a", 1, "new")], "id string, idx long, v string")
    assert [(r.id, r.v) for r in funnel.merge_by_id(first, later).orderBy("idx").collect()] == [("a", "new"), ("b", "old"), ("c", "new")]


def test_digest_slot(spark, values):
    state = spark.createDataFrame([([("1", None), ("2", "e")], ["1"], {"1": "x"}, ["1", "2", "3"], ["1"])], digests.STATE)
    stored = digests.serialize(state, "2024-01-05T10:00:00Z").unionByName(spark.createDataFrame([("x", '{"kind": "weekend"}'), ("y", '{"kind": "daily"}'), ("z", "{")], "key string, value string"))
    rows = sorted(digests.revive(stored).collect(), key=lambda r: len(r.results), reverse=True)
    assert len(rows) == 2 and rows[0].savedAt == "2024-01-05T10:00:00Z" and [r.id for r in rows[0].results] == ["1", "2"] and rows[0].triaged == {"1": "x"} and rows[1].results == [] and rows[1].triaged == {}
    now = F.lit("2024-01-07 08:00:00").cast("timestamp")
    got = values(a=digests.date_line(F.lit("2024-01-06T23:59:00"), now), b=digests.date_line(F.lit("2024-01-02T01:00:00"), now), c=digests.date_line(F.lit("2024-02-01T01:00:00"), now), d=digests.date_line(F.lit("?"), now), n=digests.restore_note(F.lit(1)), z=digests.rank_labels(F.lit(3)))
    assert got["a"] == {"text": "Yesterday's digest · Saturday, January 6", "stale": True, "days": 1} and got["b"]["text"].startswith("5 days old") and not got["c"]["stale"] and got["d"]["text"] == "Sunday, January 7, 2024"
    assert "1 paper has no summary" in got["n"] and got["z"] == "03"


def test_links_selection_and_memos(spark, values):
    results = spark.createDataFrame([("a", False, None), ("b", True, None), ("c", False, None)], "id string, has_oa boolean, oa string")
    links = spark.createDataFrame([("a", None), ("b", "u"), ("x", "u")], "id string, link string")
    assert {r.id: (r.has_oa, r.oa) for r in digests.with_oa_links(results, links).collect()} == {"a": (True, None), "b": (True, None), "c": (False, None)}
    chosen, locked = spark.createDataFrame([("1",), ("2",)], "id string"), spark.createDataFrame([("2",)], "id string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(digests.toggle(chosen, "1", locked)) == ["2"] and ids(digests.toggle(chosen, "3", locked)) == ["1", "2", "3"] and ids(digests.toggle(chosen, "2", locked)) == ["1", "2"]
    got = values(m=digests.memo_label(F.lit("\n  first \nsecond")), a=digests.add_label(F.array(F.lit("Feet")), F.lit(" feet ")), b=digests.add_label(F.array(F.lit("Feet")), F.lit(" Hands ")))
    assert got == {"m": "first", "a": ["Feet"], "b": ["Feet", "Hands"]}
    papers = spark.createDataFrame([("p", "kept", ["m0"]), ("q", None, None)], "id string, notes string, memoIds array<string>")
    memos = spark.createDataFrame([("p", "m0", "again", "2024-01-01"), ("p", "m1", " new ", "2024-01-02T00:00"), ("q", "m2", "only", None), ("q", "m3", " ", "2024")], "paper_id string, id string, text string, createdAt string")
    got = {r.id: (r.notes, r.memoIds) for r in digests.attach_memos(papers, memos).collect()}
    assert got == {"p": ("kept\n\nMemo — 2024-01-02\nnew", ["m0", "m1"]), "q": ("Memo\nonly", ["m2"])}
