import re

from samples import SF01

from almacen.llm import html_text, queries
from almacen.llm.common import table

PARA = "A long paragraph of prose, with commas, stops and more words; it goes on and on. " * 3


def test_article_without_boilerplate():
    page = f"""<!doctype html><html><head><title>T, t.</title><style>p{{}}</style></head><body>
    <header><a href=/>Home</a> Site, name.</header><nav><ul><li>One<li>Two</ul></nav>
    <div class="cookie-notice">We use cookies, ok? {PARA}</div>
    <div id=main-wrap><article><h1>Head &amp; line</h1><p>First&nbsp;one,
      <b>bo</b>ld. {PARA}</p><p>Short.<script>x('</p>')</script><aside>Side. {PARA}</aside><ul><li>x<li>y</ul>
    <form><label>Name</label><input></form></article>
    <section class="comments"><p>Great read! {PARA}</p></section></div>
    <div class="ad">Buy, now! {PARA}</div><footer>&copy; 2020, all. {PARA}</footer></body></html>"""
    squeezed = " ".join(PARA.split())
    assert html_text.main_text(page) == f"Head & line First one, bold. {squeezed} Short. x y"


def test_without_article_element():
    page = f"<body><ul><li><a>m1</a></li><li><a>m2</a></li></ul><div class=body><p>{PARA}</p><p>Two, {PARA}</p><p>Tiny.</p></div>" \
           "<div><a>x</a><a>y</a></div>"
    squeezed = " ".join(PARA.split())
    assert html_text.main_text(page) == f"{squeezed} Two, {squeezed} Tiny."


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain text, only."), (4, "u", "<p>unclosed <b>bold<p>next"),
            (5, "u", "<<>>< <!-- never closed"), (6, "u", "<script>only"), (None, "u", "<p>a &lt;b&gt; &#233;&#x1F600;</p>"),
            (7, "u", "<div>" * 300 + "deep, text." + "</div>" * 300), (7, "u", "<p>" + "long text. " * 30000),
            (8, "u", "</p></div>stray<br>end")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_chars int")
    got = {(r["page_id"], len(r["text"]) > 1000): r["text"] for r in html_text.extract_pages(df).collect()}
    assert got[1, False] == got[2, False] == got[6, False] == ""
    assert got[3, False] == "plain text, only." and got[4, False] == "unclosed bold next"
    assert got[None, False] == "a <b> é😀" and got[7, False] == "deep, text." and got[8, False] == "stray end"
    assert got[7, True] == " ".join(["long text."] * 30000)
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_table_equals_the_article_element(spark):
    import html as entities
    pages = {r["page_id"]: r["html"] for r in table(spark, SF01, "pages").collect()}
    for r in queries.op9_html_text(spark, SF01).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        text = " ".join(entities.unescape(re.sub(r"<[^>]*>", "\n", inner)).split())
        assert r["text"] == text and r["n_chars"] == len(text)


def test_sibling_sections_are_all_read():
    squeezed = " ".join(PARA.split())
    menu = "<ul><li><a>m1</a></li><li><a>m2</a></li></ul>"
    for tag in ("div", "section"):
        page = f"<body>{menu}<div><{tag} class=intro><p>First, {PARA}</p></{tag}><h2>Part</h2>" \
               f"<{tag} class=text>{f'<p>{PARA}</p>' * 3}</{tag}></div>"
        assert html_text.main_text(page) == f"First, {squeezed} Part " + " ".join([squeezed] * 3)
    page = f"<body>{menu}<article><p>First, {PARA}</p></article><article>{f'<p>{PARA}</p>' * 3}</article>"
    assert html_text.main_text(page) == f"First, {squeezed} " + " ".join([squeezed] * 3)


def test_layout_names_and_wrappers_do_not_remove_the_article():
    squeezed = " ".join(PARA.split())
    for attrs in ('class="container has-sidebar"', "class=no-comments", "class=side-by-side", "id='page-header-wrap'"):
        for inner in ("article", "div"):
            page = f"<body><div {attrs}><{inner}><p>{PARA}</p><p>Two, {PARA}</p></{inner}>" \
                   f"<ol class=commentlist><li><article><p>Great read! {PARA}</p></article></li></ol></div></body>"
            if inner == "div":
                page = page.replace("<article>", "").replace("</article>", "")
            assert html_text.main_text(page) == f"{squeezed} Two, {squeezed}", (attrs, inner)


def _neutral(page):
    """The page without a tag, class or id that tells what is what."""
    page = re.sub(r"<(/?)(?:article|nav|footer|main|aside|header|form)\b", r"<\1div", page)
    return re.sub(r'(<div[^>]*?) (?:class|id)="[^"]*"', r"\1", page)


def _article(page):
    import html as entities
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(entities.unescape(re.sub(r"<[^>]*>", "\n", inner)).split())


def test_ratios_decide_without_tags_or_names(spark, monkeypatch):
    pages = [r["html"] for r in table(spark, SF01, "pages").collect()]
    renamed = [re.sub(r"<(/?)article\b", r"<\1div", p) for p in pages]
    assert all(html_text.main_text(p) == _article(q) for p, q in zip(renamed, pages))
    # All alike divs: pages whose article is one short run of text cannot be told from their advert.
    right = sum(html_text.main_text(_neutral(p)) == _article(p) for p in pages)
    assert right >= 0.85 * len(pages)
    monkeypatch.setattr(html_text, "content_paths", lambda paths, *a: (set(paths), set(paths)))
    assert not any(html_text.main_text(_neutral(p)) == _article(p) for p in pages)
    assert not any(html_text.main_text(p) == _article(p) for p in pages)


def test_path_scores_equal_a_plain_version():
    import math
    import random
    rnd = random.Random(4)
    for n in (1, 2, 5, 60):
        paths = [rnd.randrange(6) for _ in range(n)]
        lengths, marks = [rnd.randrange(1, 400) for _ in paths], [rnd.randrange(9) for _ in paths]
        weight = {p: rnd.choice([0.1, 0.3, 1.0, 2.0]) for p in paths}

        def ratio(values):
            mean = {p: sum(v for q, v in zip(paths, values) if q == p) / paths.count(p) for p in paths}
            out = []
            for i in range(n):
                near = [(math.exp(-0.5 * k * k), mean[paths[i + k]]) for k in range(-2, 3) if 0 <= i + k < n]
                out.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
            return out
        t, p = ratio(lengths), ratio(marks)
        fused = [a / max(t) * (0.5 + b / max(max(p), 1e-9)) * weight[q] for a, b, q in zip(t, p, paths)]
        want = {q: sum(f for f, r in zip(fused, paths) if r == q) / paths.count(q) for q in paths}
        mean = sum(fused) / n
        limit = 0.25 * math.sqrt(sum((f - mean) ** 2 for f in fused) / n) + 0.1 * max(want.values())
        score, least = html_text.path_scores(paths, lengths, marks, [weight[q] for q in paths])
        assert all(abs(score[q] - want[q]) < 1e-9 for q in want) and abs(least - limit) < 1e-9


def test_names_inside_the_article_remove_nothing():
    squeezed = " ".join(PARA.split())
    for mark in ("class='side-effects'", "class='social-history'", "id='legal'", "id='menus'", "title=it's", "class=comments"):
        for tag in ("p", "section"):
            page = f"<body><nav><a>m</a></nav><article><h1>H</h1><p>{PARA}</p><{tag} {mark}>First {PARA} isn't lost.</{tag}>" \
                   f"<p>Last, {PARA}</p></article><footer>f</footer>"
            assert html_text.main_text(page) == f"H {squeezed} First {squeezed} isn't lost. Last, {squeezed}", (mark, tag)


def test_references_and_attributes():
    page = f"<article><p>{PARA} &<b>lt;</b> a &lt; b &amp;lt; <img alt='a > b'> x<a href=a'b>y</a> <i title=\"it's > it\">z</i></p></article>"
    assert html_text.main_text(page) == " ".join(f"{PARA} &lt; a < b &lt; xy z".split())
    page = f"<body><div hidden>no, {PARA}</div><div style='display: none'>no, {PARA}</div><p>yes, {PARA}</p></body>"
    assert html_text.main_text(page) == " ".join(f"yes, {PARA}".split())


def test_long_and_deep_pages_take_time_in_proportion():
    import time
    pages = ["<div class=ad>" * 60_000 + f"<p>{PARA}</p>", "<b>" * 60_000 + "<p>x</i>" * 60_000, "<p a='" * 60_000,
             "<ul><li>" + "<b>" * 30_000 + "t, " + "<li>" * 30_000, "<div><p>word, word.</div>" * 30_000, "<a =\"" * 60_000]
    for page in pages:
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 10, page[:20]
