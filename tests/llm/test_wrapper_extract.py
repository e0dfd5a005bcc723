import html
import random
import re

from tests.llm.helpers import Tables
from tillscope.llm import wrapper_extract as M


def page(title, paragraphs, extra="", tail="</body></html>"):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{x:1}}</style><script>var t="</p>";f(1)</script></head><body>'
            f'<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad">Buy now</div>'
            f'<article><h1>{title}</h1>{body}{extra}</article><footer>&copy; someone</footer>{tail}')


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "t", 5) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, text string, n_chars int")


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(n))


def test_blocks_references_and_boilerplate():
    odd = ('<html><body><div class="top menu">Menu</div><div id="c1"><div class="content"><h2>Title &eacute;</h2>a < b &amp; c<b>d</b>e'
           '<ul><li>one<li>two</ul><form><input> send</form><div class="comments">c1</div><p>end&nbsp;\n &#x41;<table><tr><td>x<td>y</table></div></div>'
           '<aside>side</aside><footer>f</footer><a hre')
    assert M.extract_page(odd, None) == "Title é a < b & cde one two end A x y"
    assert M.article_part(M.wrapper_of(M.parse(odd))) == ("html", "body", "div.c", "div.content")
    assert M.extract_page("just text", None) == "just text" and M.extract_page("<p>a<p>b<br>c", None) == "a b c"


def test_words_that_only_name_neighbours():
    page = ('<body class="no-sidebar"><div class="with-sidebar"><article class="post has-comments"><p>text</p><div class="share-box">share</div>'
            '<article class="comment">reader</article></article></div><div class="cookie-box">cookies</div></body>')
    assert M.extract_page(page, None) == "text"


def test_wrapper_of_a_host():
    pages = [page("T1", ["a", "b"]), page("T2", ["c"], "<ul><li>x</li></ul>"), page("T3", ["d", "e", "f"])]
    w = M.wrapper_of(M.parse(pages[0]))
    for p in pages[1:]:
        w = M._merge(w, M.wrapper_of(M.parse(p)))
    assert M.expression(w) == "<> <html> <head></> <body> <nav></> <div.ad></> <article> <h1>#</> <p>#</>+ <ul> <li>'x'</></>?</> <footer></></></></>"


def test_groups_and_optional_parts():
    one = lambda s: M.wrapper_of(M.parse(s))
    assert M.expression(one("<div><h2>a</h2><p>b</p><h2>c</h2><p>d</p><h2>e</h2><p>f</p></div>")) == "<> <div> (<h2>#</> <p>#</>)+</></>"
    merged = M._merge(one("<div><h2>a</h2><p>b</p></div>"), one("<div><p>b</p><pre>z</pre></div>"))
    assert M.expression(merged) == "<> <div> <h2>'a'</>? <p>'b'</> <pre>'z'</>?</></>"


def test_template_texts_inside_the_article_are_left_out(spark):
    rng = random.Random(1)
    rows = [("http://x.com/%d" % i, page(words(rng, 3), [words(rng, 30)], "<div class='box'>Read more on our site</div>")) for i in range(12)]
    rows += [("http://y.com/%d" % i, page(words(rng, 3), [words(rng, 30)], "<div class='box'>Read more on our site</div>")) for i in range(3)]
    got = {r.page_id: r.text for r in M.extract_text(frame(spark, rows)).collect()}
    assert not any("Read more" in got[i] for i in range(12)) and all("Read more" in got[i] for i in range(12, 15))


def test_generated_pages(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in M.op4_wrapper_extract(Tables(spark, pages=d), "t").collect()}
    for r in d.collect():
        a = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        a = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)>", "\0", a))
        want = " ".join(x for x in (" ".join(html.unescape(b).split()) for b in a.split("\0")) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_merging_by_parts_gives_the_same_text(spark):
    rng = random.Random(2)
    rows = [("http://h%d.com/" % (i % 3), page(words(rng, 2), [words(rng, 9) for _ in range(rng.randint(1, 4))])) for i in range(60)]
    one = {r.page_id: r.text for r in M.extract_text(frame(spark, rows).coalesce(1)).collect()}
    assert one == {r.page_id: r.text for r in M.extract_text(frame(spark, rows).repartition(40)).collect()}


def test_odd_rows(spark):
    long = page("T", ["x" * 200_000, "y"])
    rows = [(None, None), (None, ""), ("http://a.com", "   "), ("http://a.com", "<"), ("http://a.com", long), ("http://a.com", long), (None, page("N", ["b"])),
            ("http://a.com", "<div>" * 3000 + "deep"), ("http://a.com", '"<a b="' * 3000 + ">"), ("http://a.com", "<script>" * 500)]
    got = {r.page_id: r for r in M.extract_text(frame(spark, rows)).collect()}
    assert len(got) == len(rows) and [got[i].text for i in range(3)] == ["", "", ""]
    assert got[4].text == got[5].text == "T " + "x" * 200_000 + " y" and got[6].text == "N b" and got[7].text == "deep"
    assert M.extract_text(frame(spark, rows).limit(0)).count() == 0


def host_texts(spark, bodies):
    rows = [("http://h.com/%d" % i, f"<html><body><nav>MENU</nav><article>{b}</article></body></html>") for i, b in enumerate(bodies)]
    return [r.text for r in M.extract_text(frame(spark, rows)).orderBy("page_id").collect()]


def test_children_of_constant_elements_stay(spark):
    rng = random.Random(9)
    some = [words(rng, 40) for _ in range(10)]
    got = host_texts(spark, [f"<h2>By <b>Author{i}</b></h2><p>{t}</p>" for i, t in enumerate(some)])
    assert got == [f"Author{i} {t}" for i, t in enumerate(some)]   # "By" is the template's, the author is not
    got = host_texts(spark, [f"<div>Summary: <p>{t}</p></div><p>{t[::-1]}</p>" for t in some])
    assert got == [f"{t} {t[::-1]}" for t in some]


def test_text_on_one_page_is_no_constant(spark):
    rng = random.Random(8)
    some = [words(rng, 40) for _ in range(10)]
    heads = [f"<h1><a>T{i}</a></h1>" for i in range(9)] + ["<h1>Plain unique</h1>"]
    got = host_texts(spark, [h + f"<p>{t}</p>" for h, t in zip(heads, some)])
    assert got == [f"T{i} {t}" for i, t in enumerate(some[:9])] + [f"Plain unique {some[9]}"]


def test_copies_of_one_article_keep_their_text(spark):
    rng = random.Random(7)
    body = f"<h1>Title</h1><p>{words(rng, 50)}</p><p>{words(rng, 60)}</p>"
    plain = re.sub("<[^>]+>", " ", body).split()
    for bodies in ([body] * 9, [body + f"<p>Seen on day {i}</p>" for i in range(9)]):
        for got in host_texts(spark, bodies):
            assert got.split()[: len(plain)] == plain


def test_no_limit_changes_the_text(spark):
    deep = "<div>" * 105 + "<nav>MENU</nav><p>one</p>two" + "</div>" * 105 + "<p>three</p>"
    assert M.extract_page(deep, None) == "one two three"
    assert M.extract_page("<b>" * 5000 + "x" + "</b>" * 5000 + "<p>y" + "<i>" * 300 + "<nav>M</nav>z", None) == "x y z"
    many = "<p " + " ".join(f'a{i}="{i}"' for i in range(3000)) + " title='" + "v" * 9000 + "'>text</p>"
    assert M.extract_page(many, None) == "text"
    assert M.extract_page('<p title="a > b" class=x>c</p> <a href="open>d</a>', None) == "c d"
    long = "x" * 300
    some = [f"<p>{long}{'a' if i % 2 else 'b'}</p><p>{'word ' * 300}{i}</p>" for i in range(10)]
    assert all(t.startswith(long) for t in host_texts(spark, some))   # told apart behind the 200th character


def test_hostile_pages_are_read_in_time():
    import time

    for p in ('"<a b="' * 60_000, "<a b='" * 60_000, "<div>" * 60_000 + "</x>" * 60_000, "<b>" * 40_000 + "<p>" * 40_000, '<a "' * 60_000):
        t = time.time()
        M.extract_page(p + ">end", None)
        assert time.time() - t < 20
