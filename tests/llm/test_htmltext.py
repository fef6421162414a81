from quarrylens.llm import htmltext
from quarrylens.llm.htmltext import main_text


def wrap(body, extra=""):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{x:y}}</style><script>var a="</p><p>no";</script></head><body>{extra}{body}</body></html>'


LONG = " ".join(f"word{i}" for i in range(60))


def test_article_without_its_surroundings():
    page = wrap(
        f'<article><h1>Title &amp; more</h1><p><b>Bold.<br><p>{LONG}</p><div class="share-buttons">Share this</div><p>Short&nbsp;&copy; a&lt;b</p><aside>side</aside>'
        f'<section id="comments"><h2>Comments</h2><p>{LONG} {LONG} reader</p></section></article>',
        '<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div><form><p>Search</p></form>',
    ).replace("</body>", '<div role="complementary">Also</div><footer>foot</footer></body>')
    assert main_text(page) == f"Title & more Bold. {LONG} Short © a<b"


def test_by_density_alone():
    links = "".join(f'<li><a href="/{i}">Some link text here {i}</a></li>' for i in range(30))
    page = wrap(f"<div><ul>{links}</ul></div><div><div><p>{LONG}</p><p>{LONG} two</p><p>tiny</p></div></div><div><a href=x>About</a> <a href=y>Terms</a></div>")
    assert main_text(page) == f"{LONG} {LONG} two tiny"


def test_breaks_cut_offs_and_odd_markup():
    assert main_text(None) == main_text("") == main_text("  \n ") == main_text("<p></p>") == main_text("<script>x</script>") == ""
    assert main_text("plain  words\n here") == "plain words here"
    assert main_text("<p>one<b>two</b> three<br>four") == "onetwo three four"
    assert main_text("<div>foo<nav>n</nav>bar</div>") == "foo bar"
    assert main_text("<p>a < b & c &am") == "a < b & c &am"
    assert main_text(f"<article><p>{LONG}</p><p>end of it <a hre") == f"{LONG} end of it"
    assert main_text("<div>" * 5000 + LONG) == LONG
    assert main_text(f"<article><header><h1>Head</h1></header><p>{LONG}</p></article>") == f"Head {LONG}"
    assert len(main_text("<article>" + f"<p>{LONG}</p>" * 4000)) == 4000 * (len(LONG) + 1) - 1


def test_query(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>"), (2, None, None), (None, "v", ""), (1, "u", f"<article><p>{LONG}</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = sorted([tuple(r) for r in htmltext.op4(df).collect()], key=str)
    assert got == sorted([(i, u, main_text(h), len(main_text(h))) for i, u, h in rows], key=str)
    assert htmltext.op4(df.limit(0)).count() == 0


def test_density_decides_without_an_article(monkeypatch):
    menu = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(20))
    for name in ("story-header", "related-work", "reply-body", "comment-body", "post-tags-content", "recommended-reading"):
        page = wrap(f'<div><ul>{menu}</ul></div><div class="{name}"><p>{LONG}</p><p>{LONG} more</p></div><div class="cookie-note">We use cookies</div><p><a href=t>Terms</a></p>')
        assert main_text(page) == f"{LONG} {LONG} more"
    # where there is text without such words, they tell it from the rest
    both = wrap(f'<div><p>{LONG}</p></div><div class="comments"><div class="comment"><p>{LONG} one</p></div><div class="comment"><p>{LONG} two</p></div></div>')
    assert main_text(both) == LONG
    two = wrap(f"<article><p>{LONG}</p><p>{LONG} more</p></article><article><a href=x>Teaser</a></article>")
    assert main_text(two) == f"{LONG} {LONG} more"
    monkeypatch.setattr(htmltext, "densities", lambda dom, text: ([1.0] * len(dom.tag), [1.0] * len(dom.tag)))
    assert main_text(page) != f"{LONG} {LONG} more" and main_text(two) != f"{LONG} {LONG} more"


def brute_densities(page):
    """Density and sum of each unskipped element from its own subtree, by the published formula, one element at a time."""
    import math

    dom = htmltext.parse(page)
    n = len(dom.tag)

    def below(i, j):
        while j >= 0 and j != i:
            j = dom.parent[j]
        return j == i

    def linked(i):
        while i >= 0 and dom.tag[i] != "a":
            i = dom.parent[i]
        return i >= 0

    def counts(i):
        text = [(j, "".join(t.split())) for j, t in dom.text if j >= 0 and below(i, j) and not dom.skip[j]]
        kids = [j for j in range(n) if j != i and below(i, j) and not dom.skip[j]]
        return sum(len(t) for _, t in text), sum(len(t) for j, t in text if linked(j)), len(kids), sum(dom.tag[j] == "a" for j in kids)

    c0, l0, _, _ = counts(0)
    out = []
    for i in range(n):
        c, links, t, lt = counts(i)
        lc = links or 1
        if dom.skip[i] or lc >= c:
            out.append(0.0)
            continue
        base = math.log(lc * c / (c - links) + l0 / c0 * c + math.e)
        out.append(c / (t or 1) * math.log(max(1, c / lc * (t or 1) / (lt or 1)), base))
    return out, [sum(out[j] for j in range(1, n) if dom.parent[j] == i) for i in range(n)]


def test_densities_against_the_formula():
    page = wrap(f'<div>own <a href=x>link text</a><p>{LONG}</p><ul><li><a>{LONG}</a></li><li>z</li></ul></div><nav>no</nav><section><p>{LONG} <b>bold</b></p>tail</section>')
    dom = htmltext.parse(page)
    got = htmltext.densities(dom, [(i, " ".join(t.split())) for i, t in dom.text if i >= 0 and not dom.skip[i]])
    for a, b in zip(got, brute_densities(page)):
        assert all(abs(x - y) < 1e-9 * max(1, y) for x, y in zip(a, b))


def test_offsets_and_depth():
    import time

    assert main_text("<article><p>" + "İ" * 20 + f"</p><script>x</script><p>{LONG}</p></article>") == "İ" * 20 + " " + LONG
    start = time.perf_counter()
    assert main_text("<div>" * 100_000 + LONG) == LONG
    assert main_text("<article>" + "</em>" * 100_000 + LONG + "</article>") == LONG
    assert main_text("<ul>" * 50_000 + "<li>" + LONG) == LONG
    assert main_text("<article>" * 50_000 + LONG) == LONG
    assert time.perf_counter() - start < 20
