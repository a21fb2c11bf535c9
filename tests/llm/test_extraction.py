import time

import pytest

from driftlens.llm.extraction import Tree, article, clean, main_text, page_votes, parse, region, simple_tree_matching


def page(i, body, host="a.example"):
    return (
        i, f"http://{host}/p{i}",
        f'<!DOCTYPE html><html><head><title>t{i}</title><style>p{{x:y}}</style></head><body><nav><ul><li><a href="/">Home</a><li>About</ul></nav>'
        f'<div class="cookie-bar">We use cookies</div>{body}<footer>&copy; host</footer></body></html>',
    )


def texts(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, path int").repartition(2)
    found = main_text(frame).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    return {r["page_id"]: r["text"] for r in found}


def test_articles(spark):
    rows = [page(i, f"<script>var a='</p>';</script><article><h1>Title {i}</h1><p><b>One &amp; {i}<br>two<p>Three\n  four &#233;</p><form>q</form><div class='comments'><p>me too</p></div></article>") for i in range(8)]
    rows += [(20, None, None), (21, "not a url", ""), (22, None, "plain text only"), (23, "http://b.example/", "<article><p>alone"), (3, *rows[3][1:])]
    found = texts(spark, rows[:-1])
    for i in range(8):
        assert found[i] == f"Title {i}\n\nOne & {i} two\n\nThree four é"
    assert found[20] == found[21] == "" and found[22] == "plain text only" and found[23] == "alone"


def test_template_is_learnt_where_nothing_is_marked(spark):
    body = "<div id='wrap'><div class='c1'><p>Written by our staff</p><p>{0}</p><p>{1}</p></div><div class='c2'><p>Buy now</p></div></div>"
    rows = [page(i, body.format(f"First long paragraph number {i} " * 5, f"and a second one {i * i} " * 6)) for i in range(12)]
    found = texts(spark, rows)
    for i in range(12):
        assert found[i] == f"{clean(f'First long paragraph number {i} ' * 5)}\n\n{clean(f'and a second one {i * i} ' * 6)}"


def test_copies_of_a_page_are_not_a_template(spark):
    rows = [page(i, "<article><h1>Same</h1><p>The same article again.</p></article>") for i in range(9)]
    assert set(texts(spark, rows).values()) == {"Same\n\nThe same article again."}


def test_template_is_learnt_within_a_marked_article(spark):
    shared = "A sentence that real articles share."
    body = "<article><p>Sponsored by nobody</p><h1>Title {0}</h1><p>{1}</p><div class='x7'>Tell your friends</div>{2}<div class='x8'><p>All rights kept</p><p>by us</p></div></article>"
    rows = [page(i, body.format(i, f"Long paragraph {i} " * 5, "".join(f"<p>{shared if k == i % 4 else f'words {i} {k} ' * 4}</p>" for k in range(5)))) for i in range(12)]
    found = texts(spark, rows)
    for i in range(12):
        rest = "\n\n".join(shared if k == i % 4 else clean(f"words {i} {k} " * 4) for k in range(5))
        assert found[i] == f"Title {i}\n\n{clean(f'Long paragraph {i} ' * 5)}\n\n{rest}"


def test_near_copies_of_an_article_stay_whole(spark):
    rows = [page(i, "<article><h1>Same</h1>" + "".join(f"<p>The same paragraph {k}.</p>" for k in range(6)) + f"<p>Edition {i}</p></article>") for i in range(9)]
    assert all(v.count("The same paragraph") == 6 for v in texts(spark, rows).values())


def test_votes_choose_the_page_where_the_text_varies_outside_marked_elements(spark):
    rows = [page(i, f"<article>Teaser {i}</article><div class='c1'><p>{f'The real text {i} ' * 9}</p><p>Imprint</p></div>") for i in range(9)]
    found = texts(spark, rows)
    assert all(found[i] == f"Teaser {i}\n\n{clean(f'The real text {i} ' * 9)}" for i in range(9))


def test_every_layout_of_a_host_has_a_template_of_its_own(spark):
    one = "<div class='wrap'><div class='c1'><p>Front matter</p></div><div class='c2'>{0}</div></div>"
    two = "<div class='page'><section class='s1'>{0}</section><section class='s2'><p>Back matter</p></section></div>"
    rows = [page(i, (one if i % 2 else two).format(f"<p>{f'Text number {i} ' * 5}</p>")) for i in range(24)] + [page(99, "<p>Not found</p>")]
    found = texts(spark, rows)
    assert all(found[i] == clean(f"Text number {i} " * 5) for i in range(24)) and found[99] == "Not found"


@pytest.mark.parametrize("inner, text", [
    ("<header class='entry-header'><h1>Title</h1></header><p>a", "Title\n\na"),
    ("<div class='post-header'><h1>Title</h1><p>by me</div><p class='notice'>Note<section id='search'><p>On search</section>", "Title\n\nby me\n\nNote\n\nOn search"),
    ("<div class='share-layout'><h1>Title</h1></div><div class='share'>Tell all</div><ul class='comments'><li>c</ul>", "Title"),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='t'>x=2</annotation></math> be<noscript><p>shown</noscript>", "Let x=2 be\n\nshown"),
])
def test_content_within_an_article_is_kept(inner, text):
    assert article(parse(f"<body><div class='masthead'>m</div><article>{inner}</article></body>"), None, set()) == text


def test_all_sibling_articles_and_a_main_in_any_holder_are_kept():
    assert article(parse("<body><article><p>one</article><p>x<div><article><p>the longer two</article></div>"), None, set()) == "one\n\nthe longer two"
    assert article(parse("<body><div class='with-sidebar'><main><p>one</main></div>"), None, set()) == "one"


def slow_matching(one, two):
    if one.name != two.name:
        return 0
    best = [[0] * (len(two.children) + 1) for _ in range(len(one.children) + 1)]
    for i, a in enumerate(one.children):
        for j, b in enumerate(two.children):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + slow_matching(a, b))
    return best[-1][-1] + 1


@pytest.mark.parametrize("other", ["<div><p>a<p>b</div><ul><li>x</ul>", "<ul><li>x</ul><div><p>a</div>", "<div><div><p>q</div><p>b</div>", ""])
def test_matching_equals_the_plain_recursion(other):
    one, two = (Tree(parse(f"<body>{h}</body>"), "") for h in ("<h1>t</h1><div><p>a<p>c</div><ul><li>x<li>y</ul><div><p>z</div>", other))
    size, pairs = simple_tree_matching(one, two)
    assert size == slow_matching(one, two) == len(pairs)
    assert all(isinstance(v[2], bool) for v in page_votes(one, two, "r"))


def test_broken_and_extreme_pages():
    assert article(parse("<p>a<div>b</p>c<table><tr><td>d<td>e</table>" + "<div>" * 300 + "deep"), None, set()) == "a\n\nb\n\nc\n\nd\n\ne\n\ndeep"
    assert article(parse("<body>a < b and <3 <unclosed"), None, set()).startswith("a < b and <3")
    long = "<article>" + "".join(f"<p>{i}</p>" for i in range(20_000)) + "</article>"
    assert article(parse(long), None, set()).count("\n\n") == 19_999
    assert simple_tree_matching(Tree(parse(long), ""), Tree(parse(long), ""))[0] >= 2
    assert region(parse(""))[0] == ""


def test_names_are_taken_whole():
    body = "<article><p>One</p><div class='ad-hoc'><p>Two</p></div><section id='comment-on-law'><p>Three</p></section><div class='ad'>x</div><div class='comment-list'>y</div><div id='shareButtons'>z</div></article>"
    assert article(parse(body), None, set()) == "One\n\nTwo\n\nThree"
    page = "<body><div class='related-work'>A</div><div id='promotion-of-health'>B</div><p class='skip-lists'>C</p><div class='site-footer'>D</div><div class='cookie_notice'>E</div></body>"
    assert article(parse(page), None, set()) == "A\n\nB\n\nC"


@pytest.mark.parametrize("text", ['<a "' * 60_000, "<p class='x" * 60_000, "<script>" * 60_000, "<annotation>" * 60_000, "<!--" * 60_000, "<" * 300_000, "<a b" * 60_000, "<div x='>" * 60_000, "<![" * 100_000])
def test_broken_markup_is_read_in_linear_time(text):
    start = time.process_time()
    parse(text)
    assert time.process_time() - start < 6


def test_unclosed_quotes():
    assert article(parse("<p>one</p><p title='two>three</p><p>four"), None, set()) == "one\n\n<p title='two>three\n\nfour"
    assert article(parse("<p title='a>b' id=\"c>d\">text</p>"), None, set()) == "text"
