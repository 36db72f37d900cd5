"""Main text where names mislead or say nothing, and against a plain reading of the page table."""

import html
import re

import pytest

from calorine.llm import html_text


def used(node):
    return set() if isinstance(node, int) else {html_text.FEATURES[node[0]], *used(node[2]), *used(node[3])}


def test_tree_uses_words_links_and_neighbours():
    assert {"words", "link density"} <= used(html_text.tree())
    assert used(html_text.tree()) & {"words before", "words after"}
    assert used(html_text.tree()) & {"link density before", "link density after"}


WORDS = " ".join(["word"] * 40)


@pytest.mark.parametrize("end", ["<div>Short closing remark here.</div>", "<table><tr><td>One cell<td>and two</table>", "<figure><img><figcaption>A caption.</figcaption></figure>", "<p><a href=/>Read on</a></p>", "<dl><dt>Term<dd>meaning</dl>"])
def test_an_article_keeps_all_its_blocks(end):
    plain = [t for t in (" ".join(x.split()) for x in re.split(r"<[^>]*>", end)) if t]
    for after in ("", "<p><a href=/>Home</a></p>", "<footer>f</footer>"):
        assert html_text.main_text(f"<article><p>{WORDS}</p>{end}</article>{after}") == "\n\n".join([WORDS, *plain])


@pytest.mark.parametrize("page", ["<p><a href=/>Home</a></p><p><a href=/>Login</a></p>", "<ul><li><a href=/>One</a><li><a href=/>Two</a><li><a href=/>Three</a></ul>", "<div>Acme</div><div><a href=/>a</a> | <a href=/>b</a></div>"])
def test_links_alone_are_no_main_text(page):
    assert html_text.main_text(page) == ""
    assert html_text.main_text(page + f"<p>{WORDS}</p><p>{WORDS}</p>" + page) == f"{WORDS}\n\n{WORDS}"


@pytest.mark.parametrize("name", ["class=legal-analysis", "class='wrapper sidebar-layout'", "id=menu-page", "class=has-comments", "class=socialHistory", "class=search-engines", "class=no-sidebar", "role=document"])
def test_a_list_word_in_a_compound_name_is_no_verdict(name):
    assert html_text.main_text(f"<section {name}><h1>One two three</h1><p>{WORDS}</p><p>{WORDS}</p></section>") == f"One two three\n\n{WORDS}\n\n{WORDS}"


@pytest.mark.parametrize("name", ["class=menu", "class='x sidebar'", "id=cookie-notice", "class=adSlot", "class=ad-container", "role=navigation", "class=site-footer", "class=comment-list", "id=related_posts", "hidden"])
def test_furniture_by_whole_names(name):
    assert html_text.main_text(f"<div {name}><p>{WORDS}</p><p>{WORDS}</p></div><article><p>kept</p><div {name}><p>{WORDS}</p></div></article>") == "kept"


def test_implied_ends():
    assert html_text.main_text(f"<article><ul><li class=ad>buy<li>real item {WORDS}</ul><p>end</p></article>") == f"real item {WORDS}\n\nend"
    assert html_text.main_text("<article><table><tr><td class=ad>buy<td>cell<tr class=promo><td>no<tr><td>last</table></article>") == "cell\n\nlast"
    assert html_text.main_text("<article><ul><li class=ad>x<ul><li>y</ul><li>z</ul></article>") == "z"


# Pages whose names say nothing, labelled by hand: (class, text, 1 for main text).
UNNAMED = [
    [("a1", "<a href=/>Start</a>", 0), ("a1", "<a href=/>World</a>", 0), ("a1", "<a href=/>Sport</a>", 0), ("b7", "Bridge closes for the whole of the winter", 1),
     ("c2", "The old bridge over the river will be closed from Monday on, the council said in a statement after its meeting on Thursday evening.", 1),
     ("c2", "Drivers must take the road through the valley until the repair work ends in spring, which adds some twenty minutes to the way.", 1),
     ("c2", "Buses still run every hour and stop at the market on both sides.", 1), ("d9", "<a href=/>Storm takes roofs off in the north</a>", 0), ("d9", "<a href=/>Team wins at last</a>", 0), ("e0", "All rights reserved", 0)],
    [("k", "Acme", 0), ("k", "<a href=/>shop</a> <a href=/>help</a> <a href=/>cart</a>", 0),
     ("m", "We boil the beans for an hour and leave them in the pot until they are cold, then drain them and keep a cup of the water.", 1),
     ("m", "Chop two onions and fry them slowly in oil until they are brown at the edges, add garlic and a spoon of paprika and stir.", 1),
     ("n", "<a href=/>more soups</a>", 0), ("n", "<a href=/>more stews</a> <a href=/>salads</a>", 0)],
]


@pytest.mark.parametrize("page", UNNAMED)
def test_unnamed_pages(page):
    made = "".join(f"<div class={c}>{t}</div>" for c, t, _ in page)
    assert html_text.main_text(made) == "\n\n".join(t for _, t, y in page if y)


def plain_article(page):
    """The article of a page of the table's one layout, by splitting at its paragraphs."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [re.sub(r"<[^>]*>", "", x.replace("<br>", " ")) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(t for t in (" ".join(html.unescape(x).split()) for x in parts) if t)


def test_query_against_a_plain_reading(spark, tmp_path):
    from calorine.llm import queries

    words = "the quick brown fox jumps over lazy dogs while birds sing".split()
    rows = []
    for i in range(200):
        run = lambda n: " ".join(words[(i + j * j) % len(words)] for j in range(n))  # noqa: B023, E731
        paragraphs = "".join(f"<p>{'<b>' if j % 3 else ''}{run(1 + (i * j) % 30)}<br>&amp; {run(2)}{'</p>' if j % 2 else ''}" for j in range(i % 9))
        rows.append((i, f"http://h/{i}", f"<html><head><title>{run(4)}</title></head><body><nav><ul><li><a href=/>{run(1)}</a></li></ul></nav><div class=\"ad\">{run(9)}</div><article><h1>{run(5)}</h1>{paragraphs}</article><footer>{run(20)}</footer></body></html>"))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op10_html_text(spark, str(tmp_path)).collect()}
    assert got == {i: (plain_article(h), len(plain_article(h))) for i, _, h in rows}


def test_long_and_deep_pages():
    assert html_text.main_text("<article>" + f"<p>{WORDS}</p>" * 20_000 + "</article>").count("\n\n") == 19_999
    assert "word" in html_text.main_text("<div>" * 3000 + f"<p>{WORDS}</p>" + "</section>" * 30_000)


def test_short_pages_without_names_keep_their_text():
    assert html_text.main_text("<body><h1>Lost cat</h1><p>Please call me today.</p><p>She is grey.</p></body>") == "Lost cat\n\nPlease call me today.\n\nShe is grey."
    lines = ["- Who is it?", "- Me.", "- Come in then.", "- No.", "- Why not?"]
    assert html_text.main_text("".join(f"<p>{x}</p>" for x in lines)) == "\n\n".join(lines)
    menu, foot = "<ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul>", "<footer>All rights reserved by their owners</footer>"
    assert html_text.main_text(menu + "<h1>Lost cat</h1><p>Please call me today.</p><p>She is grey.</p>" + foot) == "Lost cat\n\nPlease call me today.\n\nShe is grey."
    assert html_text.main_text(menu) == html_text.main_text(menu + foot) == html_text.main_text(menu + "<div>Log in</div>") == ""


def test_tables_and_linked_paragraphs_between_text_stay():
    table = "<table><tr><th>Year</th><th>Sold</th></tr><tr><td>1998</td><td>Two apples</td></tr></table>"
    assert html_text.main_text(f"<p>{WORDS}</p>{table}<p>{WORDS}</p>") == "\n\n".join([WORDS, "Year", "Sold", "1998", "Two apples", WORDS])
    assert html_text.main_text(f"<main><p>{WORDS}</p><p><a href=/>A paragraph that is one link</a></p><p>{WORDS}</p></main>") == "\n\n".join([WORDS, "A paragraph that is one link", WORDS])
    for between in ("<div class=ad>Buy some</div>", "<div><a href=/>See also this one</a></div><div><a href=/>And that</a></div>", "<nav>Up and down</nav>"):
        assert html_text.main_text(f"<p>{WORDS}</p>{between}<p>{WORDS}</p>") == f"{WORDS}\n\n{WORDS}"


@pytest.mark.parametrize("tag", ["title", "textarea", "iframe", "noscript", "button", "div", "p", "b"])
def test_unclosed_tags_take_time_in_proportion(tag):
    import time

    def seconds(n):
        best = 9e9
        for _ in range(3):
            start = time.process_time()
            html_text.main_text(f"<{tag}>" * n + f"<p>{WORDS}</p>")
            best = min(best, time.process_time() - start)
        return best

    assert seconds(40_000) < 3.2 * seconds(20_000) + 0.05
    assert seconds(40_000) < 4
