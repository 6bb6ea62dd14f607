import html
import random
import re
import time

import duckdb
import pytest

from attesta.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>{title} | Site</title><style>p{{x}}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header class="site-header"><a href="/">Site</a><nav><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies. <button>OK</button></div>
<main><article><h1>{title}</h1>{body}<div class="ad">Buy now {n}</div><div id="share-buttons">Share this</div>
<section id="comments"><h2>Comments</h2><article class="comment"><p>First! {n}</p></article></section></article></main>
<aside><p>Popular: {n}</p></aside><form><label>Mail</label><input name="q"></form><footer><p>&copy; Site {n}</p></footer></body></html>"""

SOUP = """<html><body><div class="wrap"><div class="top"><a>Home</a> <a>Shop</a></div><div class="c2"><h2>{title}</h2>{body}</div><div class="b9">Printed on recycled electrons by the same people as always.</div></div></body></html>"""


def paragraphs(rng, n):
    return [" ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(8, 30))) for _ in range(n)]


@pytest.mark.parametrize("layout", [PAGE, SOUP])
@pytest.mark.parametrize("count", [1, 3, 12])
def test_only_the_article_is_left(layout, count):
    rng = random.Random(count)
    sources, want = [], []
    for n in range(count):
        title, body = f"Title {n} & more", paragraphs(rng, rng.randint(3, 6))
        sources.append(layout.format(title=html.escape(title), body="".join(f"<p>{b}</p>" for b in body), n=n))
        want.append("\n".join([title, *body]))
    got = H.extract_texts(sources)
    if layout is SOUP and count < H.LEAST_PAGES:
        assert all(set(w.split("\n")) <= set(g.split("\n")) for g, w in zip(got, want))
    else:
        assert got == want


def test_copies_are_not_taken_for_a_template():
    page = "<body><article><h1>T</h1>" + "<p>The same words on every page of this host.</p>" * 5 + "<p>{}</p></article></body>"
    got = H.extract_texts([page.format(f"own {i}") for i in range(20)])
    assert all(g.count("The same words") == 5 and g.endswith(f"own {i}") for i, g in enumerate(got))


def test_classes_are_ordered_and_nested():
    pages = [H.parse(f"<div><h1>Head {i}</h1><ul>{''.join(f'<li>x{j}y{i}</li>' for j in range(i + 1))}</ul><p>Foot</p></div>") for i in range(6)]
    template = H.deduce(pages)
    assert ("/div/p", "Foot") in template.tokens and ("/div/h1", "Head") in template.tokens and ("/div/ul/li", "<>") in template.tokens
    assert not any(word.startswith("x") for _, word in template.tokens)
    assert H._longest_rising([3, 1, 2, 5, 4]) == [1, 2, 4]


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), ("no markup &amp; fine &am", "no markup & fine &am"), ("<p>a<p>b<br>c <b>d", "a\nb c d"), ("<p>caf&eacute; &#x41;&#66; &lt;b&gt;\n x</p>", "café AB <b> x"),
        ("<script>no</p>", ""), ("<p>x<!-- gone --> y</p><style>z", "x y"), ("<p title='a>b'>q</p>", "q"), ("<article><p>in</p></article><p>out</p>", "in"), ("<div hidden>no</div><p>yes</p>", "yes"),
        ("<article><header><h1>T</h1><p>by X</p></header><p>b</p></article>", "T\nb"), ("<ul><li>a<li>b</ul>", "a\nb"), ("<table><tr><td>1<td>2</table>", "1\n2"), ("<p>" + "long " * 50000 + "</p>", ("long " * 50000).strip()),
    ],
)
def test_single_pages(source, text):
    assert H.extract_texts([source]) == [text]


def test_table(spark):
    rows = [(i, "http://a.example/x" if i % 3 else None, f"<article><p>text {i}</p></article>", 1) for i in range(200)] + [(5, "HTTP://A.example/y", None, 1), (None, "nonsense", "<p>z</p>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in H.extract_main_text(df, per_template=16).collect()), key=str)
    want = sorted(((i, u, "" if h is None else "z" if i is None else f"text {i}", 0 if h is None else 1 if i is None else len(f"text {i}")) for i, u, h, _ in rows), key=str)
    assert got == want
    assert H.extract_main_text(df.limit(0)).count() == 0


def test_slots_choose_the_article_and_marks_only_hint():
    rng = random.Random(7)
    sources, want = [], []
    for n in range(12):
        body = paragraphs(rng, 5)
        # the marked element is a short box beside the text
        sources.append(f"<body><div class='x1'><p>{'</p><p>'.join(body)}</p></div><div class='content'><p>Box {n}</p></div></body>")
        want.append("\n".join(body))
    assert H.extract_texts(sources) == want


@pytest.mark.parametrize("count", [1, 12])
def test_every_marked_article_is_kept(count):
    rng = random.Random(count)
    bodies = [paragraphs(rng, 3) for _ in range(count)]
    assert H.extract_texts(["<body>" + "".join(f"<article><p>{p}</p></article>" for p in b) + "</body>" for b in bodies]) == ["\n".join(b) for b in bodies]


@pytest.mark.parametrize(("count", "per_template"), [(66, 64), (131, 64), (202, 40)])
def test_no_page_is_left_in_a_short_rest(spark, count, per_template):
    rng = random.Random(count)
    bodies = [paragraphs(rng, 5) for _ in range(count)]
    rows = [(i, f"http://one.example/{i}", "<article><p>" + "</p><p>".join(b) + "</p><p>Printed on recycled electrons.</p></article>") for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in H.extract_main_text(df, per_template).collect()} == {i: "\n".join(b) for i, b in enumerate(bodies)}


def test_large_pages_still_share_a_template(spark, monkeypatch):
    monkeypatch.setattr(H, "BYTES_PER_TEMPLATE", 2_000)
    rng = random.Random(3)
    bodies = [paragraphs(rng, 6) for _ in range(60)]
    rows = [(i, f"http://one.example/{i}", "<article><p>" + "</p><p>".join(b) + "</p><p>Printed on recycled electrons.</p></article>") for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in H.extract_main_text(df).collect()} == {i: "\n".join(b) for i, b in enumerate(bodies)}


def test_only_whole_blocks_are_template():
    rng = random.Random(11)
    common = [f"w{i}" for i in range(8)]
    sources, want = [], []
    for n in range(12):
        # each page has the common words, in an order of its own, and one page a paragraph of nothing else
        body = [" ".join(rng.sample(common, 8) + [f"own{n}x{k}" for k in range(30)]) for k in range(4)] + (["w3 w1 w7"] if n == 4 else [])
        sources.append("<article><p>" + "</p><p>".join(body) + "</p><p>w1 notice of w2</p></article>")
        want.append("\n".join(body))
    assert H.extract_texts(sources) == want


def nameless(source):
    """Without attributes, and with divs for the elements whose names say what they are for."""
    source = re.sub(r"<(/?)(?:nav|header|footer|article|main|aside|section)\b", r"<\1div", source)
    return re.sub(r"<(\w+)\s[^>]*>", r"<\1>", source)


def by_host(limit):
    hosts = {}
    for url, source in duckdb.sql("SELECT url, html FROM '/root/testdata/sf0.1/pages.parquet' ORDER BY page_id").fetchall():
        hosts.setdefault(re.split("[/?#:]", url.split("//")[-1])[0].lower(), []).append(source or "")
    return [sources[:40] for sources in hosts.values() if len(sources) >= 20][:limit]


def test_articles_follow_from_slots_without_any_name(monkeypatch):
    hosts = by_host(12)
    want = [H.extract_texts(sources) for sources in hosts]
    bare = [[nameless(s) for s in sources] for sources in hosts]
    assert [H.extract_texts(sources) for sources in bare] == want
    monkeypatch.setattr(H, "deduce", lambda pages: H.Template(set(), 0, [], set(), [], []))
    changed = [a != b for sources, texts in zip(bare, want) for a, b in zip(H.extract_texts(sources), texts)]
    assert sum(changed) > 0.9 * len(changed)


def test_optional_parts_do_not_move_the_article():
    rng = random.Random(13)
    sources, want = [], []
    for n in range(20):
        body = paragraphs(rng, rng.randint(3, 6))
        notice = f"<div>Notice {n} for {paragraphs(rng, 1)[0]}</div>" if n % 3 else ""
        sources.append(f"<body>{notice}<div><h1>Title {n}</h1><p>{'</p><p>'.join(body)}</p></div><div>Contact {n} {paragraphs(rng, 1)[0]}</div></body>")
        want.append("\n".join([f"Title {n}", *body]))
    assert H.extract_texts(sources) == want


def test_classes_against_brute_force():
    for sources in [*by_host(3), *([nameless(s) for s in sources] for sources in by_host(3))]:
        pages = [H.parse(s) for s in sources[:25]]
        template = H.deduce(pages)
        distinct = list({tuple(p.tokens): p for p in pages}.values())
        vectors = {t: tuple(p.tokens.count(t) for p in distinct) for t in {t for g in template.classes for t in g}}
        for group in template.classes:
            assert len({vectors[t] for t in group}) == 1
            for p in distinct:
                held = [t for t in p.tokens if t in set(group)]
                assert held == group * (len(held) // len(group))
        # the outermost class: each role on most pages, and everywhere in the same order
        found = [H.locate(p, template) for p in distinct]
        order = template.rounds[-1]
        for p, located in zip(distinct, found):
            assert sorted(located, key=located.get) == [r for r in order if r in located]
            assert all(p.tokens[at] == template.roles[role][0] for role, at in located.items())
        assert all(sum(role in located for located in found) >= H.SUPPORT * len(distinct) for role in order)
        if "article" not in sources[0]:
            assert sum(told is not None for _, told in template.roles) > 5


def test_deep_nesting_takes_linear_time():
    deep = "<div>x" * 150_000 + "</div>" * 150_000
    start = time.perf_counter()
    page = H.parse(deep)
    assert len(page.blocks) == 150_000 and len(page.parents) == 150_001
    assert max(len(shape) for shape, _ in page.tokens) <= H.LONGEST_SHAPE
    assert H.extract_texts([deep, "<p>ok</p>" + "</b></section>" * 50_000])[1] == "ok"
    assert time.perf_counter() - start < 60


@pytest.mark.parametrize("partitions", [1, 7, 32])
def test_partitions_change_nothing(spark, partitions):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = {r.page_id: r.text for r in H.extract_main_text(pages).collect()}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        assert {r.page_id: r.text for r in H.extract_main_text(pages.repartition(partitions)).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
