"""Facts about small pages: tables, cards, articles, pagination, embedded data."""

from pyspark.sql import functions as F

from pagemill.operators import article, candidates, links, pagination, repeated, structured, tables
from pagemill.sources import html as H

TABLE = """<!doctype html><html><head><title>Prices</title></head><body><h1>Statistics</h1>
<h2>Inflation by country</h2><table><caption>Annual inflation rate (%)</caption>
<thead><tr><th>Country</th><th>Year</th><th>Inflation</th><th>GDP</th><th>Unemployment</th></tr></thead>
<tbody>{rows}</tbody></table><a href="/files/inflation.csv">Download CSV</a></body></html>""".format(
    rows="".join(
        f"<tr><td>C{i}</td><td>202{i}</td><td>{i}.3%</td><td>2{i}9,900</td><td>11.{i}%</td></tr>"
        for i in range(8)
    )
)


def cards(start, n, nav="top-nav"):
    items = "".join(
        f'<div class="paper"><h3><a href="/p/{i}">Paper {i}</a></h3><span class="author">A{i}</span>'
        f'<time datetime="2024-01-0{i + 1}">x</time><span class="citations">{i}</span></div>'
        for i in range(start, start + n)
    )
    menu = "".join(f"<a href='/m{i}'>{i}</a>" for i in range(5))
    return (
        f'<html><body><nav class="{nav}">{menu}</nav><div id="results">{items}</div>'
        '<a rel="next" href="cards2.html">Next</a></body></html>'
    )


SCRIPT_PAGE = """<html><head><script id="__NEXT_DATA__" type="application/json">{"props":{"rows":[
{"indicator":"cpi","country":"A","value":1.5},{"indicator":"cpi","country":"B","value":2},
{"indicator":"gdp","country":"A","value":3},{"indicator":"gdp","country":"B","value":4}]}}</script></head>
<body><div id="app"></div><script>fetch("/api/indicators?page=1")</script></body></html>"""


def test_table_page(pages_of):
    pages = pages_of(("https://x.org/t.html", TABLE))
    t = tables.table_candidates(pages).collect()
    assert len(t) == 1
    assert (t[0]["n_rows"], t[0]["n_columns"]) == (8, 5)
    assert t[0]["caption"] == "Annual inflation rate (%)"
    assert t[0]["heading"] == "Inflation by country"
    assert t[0]["score"] > 0.7
    rows = tables.table_rows(pages, ["Country", "Inflation"]).collect()
    assert [r["Country"] for r in rows] == [f"C{i}" for i in range(8)]
    files = links.file_links(pages).collect()
    assert [(f["url"], f["kind"]) for f in files] == [("https://x.org/files/inflation.csv", "data")]


def test_cards_and_noise(pages_of):
    pages = pages_of(("https://x.org/l/cards.html", cards(0, 5)), ("https://x.org/l/cards2.html", cards(4, 5)))
    items = repeated.repeated_items(pages).collect()
    assert len(items) == 10
    first = next(i for i in items if i["page_id"] == 0 and i["item_idx"] == 0)
    assert first["selector"] == "div.paper"
    assert first["record"] == {
        "title": "Paper 0", "link": "https://x.org/p/0", "date": "2024-01-01", "author": "A0", "citations": "0"
    }
    # the menu has a noise class and gives nothing
    assert {i["selector"] for i in items} == {"div.paper"}
    plans = pagination.pagination_plans(pages).collect()
    assert plans[0]["type"] == "next_link" and plans[0]["template"].endswith("/cards2.html")


def test_too_few_items(pages_of):
    assert repeated.repeated_items(pages_of(("https://x.org/", cards(0, 3)))).count() == 0


def test_script_page(spark, pages_of):
    pages = pages_of(("https://x.org/app", SCRIPT_PAGE))
    rows = structured.embedded_records(pages).collect()
    assert len(rows) == 4 and rows[0]["path"] == "props.rows"
    profile = candidates.page_profile(pages)
    assert profile.first()["requires_js"] is True
    apis = links.api_urls(pages).collect()
    assert apis[0]["api_url"] == "https://x.org/api/indicators?page=1"
    assert apis[0]["params"] == {"page": "1"}


def test_article(pages_of):
    body = "Central banks watch prices. " * 20
    page = (
        "<html><head><title>t</title><meta name='author' content='R. Writer'>"
        "<meta property='article:published_time' content='2024-05-01'></head><body><nav>menu</nav>"
        f"<article><h1>Central bank holds</h1><p>{body}</p><aside>ad</aside></article></body></html>"
    )
    a = article.articles(pages_of(("https://n.org/a", page))).first()
    assert a["title"] == "Central bank holds" and a["author"] == "R. Writer" and a["date"] == "2024-05-01"
    assert a["text_chars"] > 300 and "menu" not in a["text"] and " ad" not in a["text"][-4:]


def test_page_without_text_has_no_article(pages_of):
    assert article.articles(pages_of(("https://n.org/a", "<html><body><nav>x</nav></body></html>"))).count() == 0


def test_broken_markup(pages_of):
    page = "<ul><li>a<li>b <b>c<li>d</ul><p>one<p>two<br>three<table><tr><td>1<td>2</p><tr><td>3</table>tail <x"
    el = H.elements(pages_of(("https://x.org/", page)))
    li = [r["text"] for r in el.where("tag = 'li'").collect()]
    assert li == ["a", "b c", "d"]
    assert [r["text"] for r in el.where("tag = 'p'").collect()] == ["one", "twothree"]
    rows = el.where("tag = 'td'").groupBy("row_id").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in rows) == [1, 2]


def test_comments_scripts_and_entities(pages_of):
    page = "<!-- <p>no</p> --><script>if (a<b) '</p>'</script><P Class='X y'>a &amp; b&nbsp;&lt;c&gt;</P>"
    el = H.elements(pages_of(("https://x.org/", page))).collect()
    assert [r["tag"] for r in el] == ["script", "p"]
    assert el[1]["text"] == "a & b <c>" and el[1]["class"] == "X y"


def test_empty_and_null_pages(spark):
    pages = spark.createDataFrame([(1, "u", ""), (2, "u", None)], "page_id long, url string, html string")
    assert H.elements(H.shred_html(pages)).count() == 0


def test_first_row_rule(pages_of):
    same = "<table><tr><td>a<td>a<td>a<td>a<td>a<td>a</tr><tr><td>1<td>2</tr></table>"
    cells = tables.html_tables(pages_of(("https://x.org/", same)), "first_row").collect()
    assert cells[0]["header"] == "column_0" and len(cells) == 12
    one = "<table><tr><td>only</tr></table>"
    assert tables.html_tables(pages_of(("https://x.org/", one)), "first_row").count() == 0


def test_selector_and_path(pages_of):
    pages = pages_of(("https://x.org/", cards(0, 5)))
    assert repeated.rows_by_selector(pages, "#results > div", ["title"]).count() == 5
    values = [r["value"] for r in repeated.rows_by_path(pages, "//span[@class='citations']/text()").collect()]
    assert values == ["0", "1", "2", "3", "4"]


def test_default_rows_prefer_tables(pages_of):
    both = TABLE + cards(0, 5)
    rows = candidates.rows_from_html(pages_of(("https://x.org/", both)))
    assert {r["source"] for r in rows.collect()} == {"table"}
    picked = candidates.rows_from_html(pages_of(("https://x.org/", both)), selector="div.paper")
    assert picked.count() == 5
    assert candidates.rows_from_html(pages_of(("https://x.org/", both)), table_index=3).count() == 0


def test_inside_pairs(pages_of):
    pages = pages_of(("https://x.org/", "<div><p><b>x</b></p><b>z</b></div><b>y</b>"))
    pairs = {(r["outer_id"], r["node_id"]) for r in H.inside(pages, "div", "b").collect()}
    assert pairs == {(0, 2), (0, 3)}


def test_quotes_open_strings_only_behind_equal_signs(pages_of):
    pages = pages_of(
        ("https://x.org/", "<p title=it's>one</p><ul><li>a</li><li>b</li></ul><p>don't stop</p>"),
        ("https://x.org/", '<img alt="a"b"><i>x</i>'),
        ("https://x.org/", "<a href=/foo/>text</a><br/><a href='/b'/>gone"),
    )
    rows = H.elements(pages).collect()
    tags = {i: [(r["tag"], r["text"]) for r in rows if r["page_id"] == i] for i in range(3)}
    assert tags[0] == [("p", "one"), ("ul", "ab"), ("li", "a"), ("li", "b"), ("p", "don't stop")]
    assert [t for t, _ in tags[1]] == ["img", "i"]
    assert tags[2] == [("a", "text"), ("br", ""), ("a", "")]
    assert next(r for r in rows if r["tag"] == "p")["attrs"]["title"] == "it's"


def test_broken_markup_is_read_once():
    import time

    import pyarrow as pa

    for piece in ("<b ", "<b x='", '<b x="', "</b ", "<!x ", "<!--", "<b x=\"<", "<b x=y"):
        H._shred_batch(pa.array([piece * 200]))  # warm
        start = time.perf_counter()
        H._shred_batch(pa.array([piece * 40_000]))
        assert time.perf_counter() - start < 3, piece


def test_rows_of_every_kind_of_candidate(spark):
    from pagemill.operators.candidates import candidate_rows

    ld = '<script type="application/ld+json">{"@type":"Product","name":"lamp"}</script>'
    state = '<script type="application/json">{"rows":[{"a":1},{"a":2}]}</script>'
    cards = "".join(f'<div class="card"><h3>c{i}</h3><a href="/c/{i}">more</a></div>' for i in range(4))
    pages = [
        (1, "<table><tr><th>k</th></tr><tr><td>1</td></tr><tr><td>2</td></tr></table>", "table", "table_0"),
        (2, f'<div id="x">{cards}</div>', "repeated", "repeated_0"),
        (3, "<article><h1>t</h1><p>long enough text</p></article>", "article", "article"),
        (4, '<a href="/d.csv">d</a>', "links", "links_files"),
        (5, '<a href="/p">p</a>', "links", "links_internal"),
        (6, "<rss><channel><item><title>x</title></item></channel></rss>", "feed", "feed"),
        (7, ld, "structured", "json_ld"),
        (8, ld + state, "api", "embedded_2_0"),
        (9, '[{"a":{"b":3}},{"a":{"b":4}}]', "api", "api_body"),
        (10, "<p>x</p>", "file", "file"),
    ]
    made = [(i, f"https://h.example.org/{i}", html, kind, name) for i, html, kind, name in pages]
    chosen = spark.createDataFrame(made, "page_id long, url string, html string, kind string, id string")
    found = {}
    for r in sorted(candidate_rows(chosen).collect(), key=lambda r: (r["page_id"], r["row_idx"])):
        found.setdefault(r["page_id"], []).append(r["record"])
    assert found[1] == [{"k": "1"}, {"k": "2"}]
    assert [r["title"] for r in found[2]] == ["c0", "c1", "c2", "c3"]
    assert found[3][0]["text"].endswith("long enough text")
    assert found[4][0]["url"] == "https://h.example.org/d.csv" and found[5] == [{"url": "https://h.example.org/p"}]
    assert found[6][0]["title"] == "x" and found[7][0]["name"] == "lamp"
    assert found[8] == [{"a": "1"}, {"a": "2"}] and found[9] == [{"a.b": "3"}, {"a.b": "4"}]
    assert set(found) == set(range(1, 10))


def test_few_pages_are_nodes_in_python_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    bodies = ["<p>a</p>" * 50, None, "", "<b>x</b>" * 200, "<i>", "<p>c</p>"] * 3
    monkeypatch.setattr(H, "_PART", 500)
    parts = list(H._parts(pa.array(bodies)))
    assert [b for p in parts for b in p.to_pylist()] == bodies
    assert len(parts) > 3 and all(len(p) == 1 or sum(len(b or "") for b in p.to_pylist()) <= 500 for p in parts)
    assert [p.to_pylist() for p in H._parts(pa.array([], pa.string()))] == [[]]
    made = [(i, b) for i, b in enumerate(bodies)]
    pages = H.shred_html(spark.createDataFrame(made, "page_id long, html string").coalesce(1))
    got = {r["page_id"]: r["n"] for r in pages.select("page_id", F.size("dom.nodes").alias("n")).collect()}
    assert [got[i] for i in range(len(bodies))] == [50, 0, 0, 200, 1, 1] * 3
