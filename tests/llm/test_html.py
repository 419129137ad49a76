import math

import pytest
from pyspark.sql import functions as F

from glossa.llm import html_extract as H

SCHEMA = "page_id long, url string, html string"


def page(main, extra="", host="a.example"):
    return f"https://{host}/x", f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{extra}{main}</body></html>"


def extract(spark, rows, **cols):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], SCHEMA).withColumns({k: F.lit(v) for k, v in cols.items()})
    out = H.extract_text(df)
    assert out.columns == ["page_id", "url", "text"]
    return {r.page_id: r.text for r in out.collect()}


MARKUP = [
    ("<article><h1>Head &amp; line</h1><p>one  two\n three<br>four</p></article>", "Head & line\none two three four"),
    ("<article><p><b>bold<br><p>next</b> word</article>", "bold\nnext word"),
    ("<article><p>a<script>var t='</p>';</script>b</p><style>x{}</style></article>", "ab"),
    ("<article><p>keep</p><aside>side</aside><form><p>field</p></form><footer>foot</footer></article>", "keep"),
    ("<article><p>keep</p><div class='comments'><p>reader says</p></div><p class=notice-2>cookies</p></article>", "keep"),
    ("<article><!-- <p>hidden</p> --><ul><li>1<li>2</ul><table><tr><td>c1<td>c2</table></article>", "1\n2\nc1\nc2"),
    ("<article><p>x &lt;b&gt; &#233; &#x4e2d; &nbsp;y</p><p title='a > b'>z</p></article>", "x <b> é 中 y\nz"),
    ("<article><p>un<i>clo<b>sed", "unclosed"),
    ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ("<main><header><h1>Title</h1></header><p>text</p></main>", "Title\ntext"),
    ("<article>bare <em>text</em><p>para</p>tail</article>", "bare text\npara\ntail"),
    ("<article><p>end</p></article></div></p><p hidden>no</p>", "end"),
    ("<article><p>a</p><nav><ul><li>menu</nav><p>b</p></article>", "a\nb"),
    ("<article><p>a<textarea>typed <p>here</textarea>b</p></article>", "ab"),
    ("<article><p title=\"never closed>x</p></article>", ""),
    ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
]


def test_markup(spark):
    """Each on a host of its own, with site furniture around it."""
    extra = "<header><p>Site</p></header><nav><a href='/'>Home</a></nav><div class='ad'>Buy</div><div id='sidebar'>Side</div>"
    got = extract(spark, [page(m, extra, f"h{i}.example") for i, (m, _) in enumerate(MARKUP)], text="t", node=1, removed="x", z=3)
    assert [got[i] for i in range(len(MARKUP))] == [w for _, w in MARKUP]


def test_odd_rows(spark):
    assert extract(spark, [(None, None), ("u", ""), ("u", "no markup at  all"), (None, "<"), (None, "<p>x</p>"), ("u", "&amp;" * 50_000)]) == {
        0: "", 1: "", 2: "no markup at all", 3: "<", 4: "x", 5: "&" * 50_000}
    assert H.extract_text(spark.createDataFrame([], SCHEMA)).collect() == []
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    same = spark.createDataFrame([(1, "u", deep), (1, "u", deep), (None, "u", "<p>n</p>")], SCHEMA)
    assert sorted(r.text for r in H.extract_text(same).collect()) == ["deep", "deep", "n"]


def test_repeated_branches_without_a_role_are_removed(spark):
    """Undeclared furniture: the same on every page of a site, so it says nothing; the text differs."""
    rows = [page(f"<div class='x'><p>story {i} tells {i * 7}</p><p>and more {i}</p></div>", "<div class='q'>Our slogan</div><div class='w'>Menu A</div>")
            for i in range(30)]
    got = extract(spark, rows)
    assert all(got[i] == f"story {i} tells {i * 7}\nand more {i}" for i in range(30))


def test_copies_of_an_article_stay(spark):
    rows = [page("<article><p>the same story</p></article>", f"<div class='ad'>{i}</div>") for i in range(40)]
    assert set(extract(spark, rows).values()) == {"the same story"}


WRAPPERS = [
    ("<div class='content has-sidebar'><article><p>own {i}</p></article></div>", "own {i}"),
    ("<div class='no-sidebar'><p>story {i}</p></div>", "story {i}"),
    ("<div id=sidebar><div><article><p>odd {i}</p></article></div></div>", "odd {i}"),
    ("<x-page class=ads><article><p>inline {i}</p></article></x-page>", "inline {i}"),
    ("<article><header class='entry-header'><h1 class='entry-header'>H {i}</h1></header><p class=legal>law {i}</p><p>p</p></article>", "H {i}\nlaw {i}\np"),
    ("<main><div class='comment'><article>said {i}</article></div></main>", "said {i}"),
]


@pytest.mark.parametrize("pages", [1, 8])
def test_listed_words_in_names_of_wrappers_and_texts_cost_no_main_text(spark, pages):
    rows = [page(m.format(i=i), "<nav>n</nav>", f"w{k}.example") for k, (m, _) in enumerate(WRAPPERS) for i in range(pages)]
    got = extract(spark, rows)
    assert [got[i] for i in range(len(rows))] == [w.format(i=i) for _, w in WRAPPERS for i in range(pages)]


def test_importance_decides_on_hinted_branches(spark):
    """The same on every page of a site: removed. Its own text on every page, or too few pages to tell: kept."""
    for pages, want in ((30, "story {i}\nnote {i}"), (2, "Site name\nstory {i}\nnote {i}")):
        rows = [page(f"<div class=x><p>story {i}</p></div><div class='legal'><p>note {i}</p></div>", "<div class='site-header'><p>Site name</p></div>") for i in range(pages)]
        assert extract(spark, rows) == {i: want.format(i=i) for i in range(pages)}


OUTSIDE = ("comment reply respond user-comment comment-body related recommended share header search legal privacy aside menu hidden "
           "has-sidebar social skip-link").split()


@pytest.mark.parametrize("pages", [1, 12])
def test_hinted_branches_outside_an_article_go(spark, pages):
    """Whatever they say, also what no other page of the site says."""
    rows = [page("<article><p>story {i}</p></article><div class='{w}'><p>unique {i}</p>text {i}</div>".format(i=i, w=w), "", f"{w}.example")
            for w in OUTSIDE for i in range(pages)]
    got = extract(spark, rows)
    assert [got[k] for k in range(len(rows))] == [f"story {i}" for _ in OUTSIDE for i in range(pages)]


def brute_pages(rows):
    """Whole pages by the stated formula, over a parse of its own: the style tree of well-formed pages of div, p and article."""
    import re
    from collections import Counter, defaultdict
    parsed = []
    for _, html in rows:
        nodes, blocks, kids = defaultdict(list), [], defaultdict(list)
        at = [("body", "")]
        for m in re.finditer(r"<(/?)(\w+)(?: class='([^']*)')?>|([^<]+)", html[html.index("<body>") + 6:html.index("</body>")]):
            end, tag, cls, text = m.groups()
            if text:
                blocks.append((tuple(at), text))
                nodes[tuple(at)].append(text)
            elif end:
                at.pop()
            else:
                kids[tuple(at)].append(tag)
                at.append((tag, cls or ""))
                kids[tuple(at)] = kids[tuple(at)]
                nodes[tuple(at)] = nodes[tuple(at)]
        parsed.append((nodes, blocks, kids))
    pages, styles, said = Counter(), defaultdict(Counter), defaultdict(Counter)
    for nodes, _, kids in parsed:
        for node in set(nodes) | {(("body", ""),)}:
            pages[node] += 1
            styles[node][tuple(kids[node])] += 1
            for text in set(nodes.get(node, ())):
                said[node][text] += 1

    def score(node):
        m = pages[node]
        if m < H.MIN_PAGES:
            return 1.0
        below = [math.log(n) / math.log(pages[x]) if pages[x] >= H.MIN_PAGES else 0.0 for x in said if x[:len(node)] == node for n in said[x].values()]
        shown = sum(n / m * math.log(m / n) for n in styles[node].values()) / math.log(m)
        return shown if not below else H.PRESENTATION * shown + (1 - H.PRESENTATION) * (1 - sum(below) / len(below))

    out = []
    for _, blocks, _ in parsed:
        out.append("\n".join(text for node, text in blocks
                             if all(H.UNDECIDED * (1 + score(node[:k])) / 2 >= H.THRESHOLD for k in range(2, len(node) + 1))))
    return out


def test_whole_pages_match_brute_force(spark):
    import random
    rng = random.Random(9)
    rows = []
    for i in range(40):
        parts = [f"<div class='{c}'>{t}</div>" for c, t in (("top", "<p>Slogan</p>"), ("mid", f"<p>own {i}</p><p>{rng.choice(['a', 'b', 'c'])}</p>"),
                                                         ("low", f"<div class='x'><p>{rng.choice(['often', 'often', f'rare {i}'])}</p></div><p>line</p>"), ("odd", f"t{i % 7}"))
                 if rng.random() < 0.85]
        rows.append(page("".join(parts)))
    got = extract(spark, rows)
    assert [got[i] for i in range(40)] == brute_pages(rows)


def test_an_article_keeps_its_wrapper_on_its_own_page_only(spark):
    rows = [page(f"<div class=sidebar><p>links {i}</p></div><article><p>a {i}</p></article>") for i in range(8)]
    rows.append(page("<div class=sidebar><article><p>odd</p></article></div>"))
    assert extract(spark, rows) == {i: f"a {i}" for i in range(8)} | {8: "odd"}


def test_importance_matches_the_formula(spark):
    rows = [page(f"<section><p>same</p><p>own {i}</p></section>" if i < 6 else f"<section id={i}><p>same</p></section>") for i in range(8)]
    rows += rows[:3]  # copies of pages count once
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], SCHEMA)
    nodes = H.page_nodes(pages)
    got = {r.node: r for r in H.importance(nodes).collect()}
    keys, labels = {}, H.Labels()
    for _, n, _ in H.parse(rows[0][1], "a.example", labels):
        keys[n.tag] = n.key
    said = 1 - (math.log(8) / math.log(8) + 6 * 0) / 7
    assert got[keys["p"]].importance == pytest.approx(0.1 * 0 + 0.9 * said)
    spread = -(6 / 8 * math.log(6 / 8) + 2 / 8 * math.log(2 / 8)) / math.log(8)
    assert got[keys["section"]].importance == pytest.approx(0.1 * spread + 0.9 * said)
    assert got[keys["section"]].weight == 0.5 and got[keys["head"]].weight == 0


def test_parser_is_linear_on_broken_markup():
    for bad in ('<a "' * 20_000, "<" * 50_000, "<!--" * 20_000, "<p><b>" * 2_000, "</p>" * 20_000, "<script>" * 5_000):
        list(H.parse(bad, "h", H.Labels()))
