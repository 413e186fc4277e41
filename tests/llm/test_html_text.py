import html as entities
import random
import re

from emberlog.llm import html_text as H
from emberlog.llm.queries import QUERIES

LONG = "The house is on the hill and it was of the kind that the people of the town had. " * 3


def brute(page):
    """The article of the given pages, which are all of one make."""
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = [
        " ".join(entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split())
        for b in re.split(r"</?(?:p|h1)>", body)
    ]
    return "\n".join(b for b in blocks if b)


def test_query_against_brute_force(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op10_html_text"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == brute(pages[r.page_id].html)
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)


def blocks(body):
    return H.main_blocks(f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>")


def test_parts_outside_the_article_go():
    page = f"""
    <header><h1>Site</h1></header><nav><ul><li><a href=1>One</a></ul></nav>
    <div class="cookie-notice"><p>{LONG}</p></div><div id=sidebar><p>{LONG}</p></div>
    <div class="ad"><p>{LONG}</p></div><form><p>{LONG}</p></form>
    <h2>Title &amp; more</h2><p>{LONG}&nbsp;<b>bold</b><br>next</p><p>Short.</p><p>{LONG}</p>
    <style>p {{}}</style><script>var a = "<p>no</p>";</script><!-- <p>no</p> -->
    <section class="comments"><p>{LONG}</p></section><footer><p>{LONG}</p></footer>"""
    text = LONG.strip()
    assert blocks(page) == ["Title & more", f"{text} bold next", "Short.", text]


def test_an_article_is_kept_whole_whatever_its_words():
    page = f"""<div><p>{LONG}</p></div><article><header><h1>H</h1></header><p>XX!! YY!!<p>Zz
    <ul><li>item one</li><li><a href=1>menu</a></li></ul><blockquote>quoted</blockquote>
    <aside>aside</aside><p hidden>gone</p><table><tr><td>a<td>b</table></article><p>{LONG}</p>"""
    assert blocks(page) == ["H", "XX!! YY!!", "Zz", "item one", "quoted", "a", "b"]


def test_short_blocks_follow_their_neighbours():
    links = "<p>" + "<a href=1>link and link</a> " * 9 + "</p>"
    page = f"{links}<p>near links</p><div>x</div>{links}<p>{LONG}</p><p>near text</p><p>{LONG}</p>"
    assert blocks(page) == [LONG.strip(), "near text", LONG.strip()]
    assert blocks("<p>short alone</p>") == []


def test_a_teaser_beside_the_story():
    story = f"<div><h2><a href=1>Linked title</a></h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>"
    text = LONG.strip()
    for page in (f"{story}<article>Teaser card</article>", f"<article><h3>Card</h3><p>More</p></article>{story}"):
        assert blocks(page) == ["Linked title", text, "Short.", text]
    assert blocks(f"<article><p>{LONG}</p></article><article>Teaser</article>") == [text]


def test_class_words_inside_an_article():
    page = """<article><div class="elementor-widget"><p>one</p></div><p class="share-price">two</p>
    <div class="ad-slot">x</div><div class="newsletter">x</div><div id="related-links">x</div><p>three</p></article>"""
    assert blocks(page) == ["one", "two", "three"]


def test_menus_never_closed():
    assert blocks(f"<nav><a href=1>Home</a><article><p>{LONG}</p></article>") == [LONG.strip()]
    assert blocks(f"<aside><p>x</p><main><p>{LONG}</p></main>") == [LONG.strip()]


def test_linked_items_go_whatever_their_number_of_words():
    page = f"<article><p>{LONG}</p><ul><li><a href=1>one</a></li><li><a href=1>one two three four five</a></li></ul></article>"
    assert blocks(page) == [LONG.strip()]


def brute_labels(found):
    """Both passes as said: decided blocks, then doubtful and short ones by nearest neighbour."""
    labels = [H.first_pass(b) for b in found]
    for which, alone in ((H.MAYBE, H.GOOD), (H.OPEN, H.BAD)):
        sure = [(k, x) for k, x in enumerate(labels) if x in (H.GOOD, H.BAD)]
        out = list(labels)
        for k, x in enumerate(labels):
            if x == which:
                least = min((abs(k - j) for j, _ in sure), default=0)
                near = {y for j, y in sure if abs(k - j) == least}
                out[k] = near.pop() if len(near) == 1 else alone
        labels = out
    return labels


def test_passes_against_brute_force():
    rng = random.Random(5)
    kinds = [LONG, LONG[:80], "short one", "word salad " * 9, "<a href=1>link and link</a> " * 9]
    for _ in range(300):
        page = "".join(f"<{t}>{rng.choice(kinds)}</{t}>" for t in rng.choices(["p", "div", "h2", "li"], k=rng.randint(1, 14)))
        found = H.Page(page).blocks
        want = [b.text for b, x in zip(found, brute_labels(found)) if x == H.GOOD]
        assert H.main_blocks(page) == want


def test_broken_markup():
    assert blocks("<article><p>a < b && c <3 <p>x<") == ["a < b && c <3", "x<"]
    assert blocks("<article><p>open <b>bold <i>both</article>") == ["open bold both"]
    assert blocks('<article><p title="a > b">quoted</p><script>never closed') == ["quoted"]
    assert blocks("<article><p>&#x41;&eacute;&unknown; &amp;lt;</p></article>") == ["Aé&unknown; &lt;"]
    assert H.main_text(b"") == ("", 0)


def test_long_page_is_read_whole():
    page = "<article>" + "".join(f"<p>block {k}</p>" for k in range(20_000)) + "</article>"
    text, n = H.main_text(page.encode())
    assert n == len(text) and text.count("\n") == 19_999


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (None, "u", "<article>t</article>", "x")]
    rows += [(2, "u", "<article>t</article>", "x")] * 2 + [(3, "u", "", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, H.extract(frame).collect()), key=str)
    want = [(1, None, "", 0), (2, "u", "t", 1), (2, "u", "t", 1), (3, "u", "", 0), (None, "u", "t", 1)]
    assert got == sorted(want, key=str)
    assert H.extract(frame.limit(0)).count() == 0
