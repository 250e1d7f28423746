"""Quality rules, URL vocabulary and page text on small fixtures."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import html_text, quality_rules, url_filter


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
        seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_base_counts_match_brute_force(documents):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab é日#*\n\t\x0b|  ") for _ in range(rng.randint(0, 200))) for _ in range(150)] + [None, "", "a a a a", "x\nx\n\n\nx"]
    rows = [(i, t) for i, t in enumerate(texts)]
    for r in quality_rules.judge_quality(documents(rows)).collect():
        want = brute_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_divergence_keeps_prose_and_drops_noise(documents):
    rng = random.Random(1)
    # a language of many words of which a few are common
    words = [("the", 6), ("of", 5), ("and", 4), *((f"word{k}x".replace("0", "a").replace("1", "b"), 1) for k in range(40))]
    prose = lambda n: " ".join(rng.choices([w for w, _ in words], [c for _, c in words], k=n)).capitalize() + "."
    rows = [(i, prose(120)) for i in range(60)] + [(100, " ".join(f"{chr(97 + k % 26)}{k}***" for k in range(120)))]
    rows += [(101, prose(120), None, "s", 1), (102, prose(120), "xx", "s", 1)]
    got = {r.doc_id: r.kept for r in quality_rules.judge_quality(documents(rows)).collect()}
    assert all(got[i] for i in range(60) if not brute_base(dict((r[0], r[1]) for r in rows)[i])[4] * 2 > 120)
    assert not got[100] and got[101] is not None
    assert quality_rules.judge_quality(documents([])).count() == 0


def test_distance():
    d = quality_rules.distance
    assert d(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1) and d(np.array([1.0, 1]), np.array([2.0, 2])) == 0
    assert d(np.zeros(2), np.array([1.0, 1])) == 1


PAGES = "page_id bigint, url string, html string, verdict string"


def test_urls_match_their_sql(spark):
    urls = [
        None, "", "no scheme", "http://", "http://A.EXAMPLE.net/en/x?y", "https://example.net/en", "http://net/", "http://xnet/", "http://a.net", "http://a.org/fr/b#c",
        "http://example.com/de/", "http://sub.example.com/de/x", "http://myexample.com/de/x", "http://a.com/casino", "http://a.com/casinos", "http://free-bets.com/",
        "http://a.com/free", "http://a.com/free/free", "http://a.com/éfree,win", "http://xxx://b", "http://a.com/FREE_Track", "ftp://example.net/en/porn", "http://freewin.com/free-win",
    ]
    df = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(urls)] + [(None, "http://a.com", None, "x")] * 2, PAGES)
    got = df.transform(url_filter.judge_urls).toPandas()
    con = duckdb.connect()
    pages = df.select("page_id", "url").toPandas()
    con.register("pages", pages)
    want = con.execute(url_filter.oracle()).df()
    text = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(str).replace({"None": "-", "nan": "-", "<NA>": "-"}).to_numpy()))
    assert [t[:5] for t in text(got.drop(columns="page_id"))] == [t[:5] for t in text(want.drop(columns="page_id"))]
    by = dict(zip(got.page_id, got.verdict))
    assert by[13] == "block" and by[14] == "allow" and by[15] == "block" and by[16] == by[17] == "allow" and by[4] == "allow" and by[21] == "allow"
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_vocabulary_at_boundaries_of_any_script(spark):
    v = url_filter.Vocabulary()
    assert len(set(v.strict) | set(v.soft)) == len(v.strict) + len(v.soft) > 100
    rows = []
    for term in v.strict + v.soft:
        rows += [f"http://a.io/{term}", f"http://a.io/x{term}", f"http://a.io/é{term}", f"http://a.io/{term}٣", f"http://{term}.io/漢{term}_{term.upper()}/"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: (r.strict_terms, r.soft_terms, r.verdict) for r in url_filter.judge_urls(df).collect()}
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    want = con.execute(url_filter.oracle()).df()
    assert got == {r.page_id: (r.strict_terms, r.soft_terms, r.verdict) for r in want.itertuples()}
    for k, term in enumerate(v.strict + v.soft):
        strict, soft, verdict = got[5 * k]
        assert (strict if term in v.strict else soft) >= 1 and (term in v.soft or verdict == "block")
        assert sum(got[5 * k + 2][:2]) < strict + soft and sum(got[5 * k + 3][:2]) < strict + soft
    assert got[rows.index("http://a.io/éfree")] == (0, 0, "allow")


ARTICLE = "<h2>A title</h2><p>First paragraph, with <b>marks</b> &amp; more.<p>Second &eacute;&#233; one,   with\n lines, too.<ul><li>An item, here.</ul><p>Third, the last of them."
BOIL = {
    "nav": "<nav><a href=/a>Home</a><a href=/b>More</a></nav>", "header": "<header>Site name, always.</header>", "script": "<script>if (a < b) { x('</p>'); }</script>",
    "style": "<style>p{}</style>", "ad": '<div class="ad">Buy now, cheap, today.</div>', "aside": "<aside><p>Other things, to read.</p></aside>",
    "form": "<form><label>Mail</label><input><button>Send</button></form>", "comments": '<section id="comments"><p>Great, thanks. I liked it, truly.</p></section>',
    "notice": '<div class="cookie-notice"><p>We use cookies, as all do.</p></div>', "footer": "<footer>&copy; Site, 2020. All rights.</footer>", "comment": "<!-- x > y -->",
}
WANT = "A title\n\nFirst paragraph, with marks & more.\n\nSecond éé one, with lines, too.\n\nAn item, here.\n\nThird, the last of them."


@pytest.mark.parametrize("box", ["<article>{}</article>", "<main><div>{}</div></main>", '<div class="post-body">{}</div>', "<div><div id=content>{}</div></div>"])
def test_article_without_the_rest(box):
    b = BOIL
    page = f"<!DOCTYPE html><html><head><title>T</title>{b['style']}{b['script']}</head><body>{b['nav']}{b['header']}{b['notice']}{b['ad']}{box.format(ARTICLE)}{b['comments']}{b['aside']}{b['form']}{b['comment']}{b['footer']}</body></html>"
    assert html_text.main_text(page) == WANT
    inside = page.replace(ARTICLE, ARTICLE.replace("<p>Third", b["ad"] + b["script"] + "<p>Third") + b["comments"])
    assert html_text.main_text(inside) == WANT


def test_odd_pages(spark):
    pages = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "just text", "x"), (4, "u", "<p>open, never closed", "x"), (5, "u", "<<<>>", "x"), (6, "u", "<nav>menu</nav>", "x"), (6, "u", "<nav>menu</nav>", "x"),
             (7, "u", "<p>" + "word, " * 50_000, "x"), (8, "u", "<div>" * 3000 + "deep, text." + "</div>" * 3000, "x")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(pages, PAGES)).collect()}
    assert [got[k].text for k in (1, 2, 3, 4, 6, 8)] == ["", "", "just text", "open, never closed", "", "deep, text."]
    assert got[7].n_chars == len(got[7].text) == 50_000 * 6 - 1
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


QUOTE = "<blockquote>" + "".join(f"<p>Quoted line {k}, which goes on for long, and longer, until it ends, at last, here.</p>" for k in range(9)) + "</blockquote>"


@pytest.mark.parametrize("box", ["<article>{}</article>", "<div>{}</div>"])
@pytest.mark.parametrize("inner", [
    "<p>An intro, of some words, before it.</p>" + QUOTE + "<p>A close, of some words, after it.</p>",
    "<p>An intro, of some words, before it.</p><div><div>" + QUOTE + "</div></div><p>A close, of some words, after it.</p>",
])
def test_text_beside_a_heavy_wrapper_stays(box, inner):
    got = html_text.main_text(f"<body>{BOIL['nav']}{box.format(inner)}{BOIL['footer']}</body>")
    assert got.startswith("An intro") and got.endswith("after it.") and got.count("Quoted line") == 9 and "Home" not in got


def test_a_paragraph_of_links_is_text_and_a_low_ratio_is_not_by_its_element_alone():
    link = '<p><a href="/x">All of this paragraph, each word, is one link, and still text.</a></p>'
    plain = "<p>Plain text, of some words, stands here, as it should.</p>"
    for box in ("<article>{}</article>", "<div>{}</div>"):
        assert "still text." in html_text.main_text(f"<body>{box.format(plain + link + plain)}</body>")
    menu = "<ul>" + "".join(f"<li><a href=/{k}>Tag{k}</a></li>" for k in range(12)) + "</ul>"
    got = html_text.main_text(f"<body><article>{plain * 6}{menu}</article></body>")
    assert got.count("Plain text") == 6 and "Tag6" not in got


def test_no_text_is_lost_beside_skipped_elements():
    tail = "<p>Three, four, five six. Seven, eight nine.</p>"
    assert html_text.main_text('<p>One, text. <svg class="i"/> two here.</p>' + tail).split("\n\n")[0] == "One, text. two here."
    assert html_text.main_text('<p>One, <svg><path d=""/><text>no</text></svg>text.</p>' + tail).split("\n\n")[0] == "One, text."
    assert html_text.main_text("<div><p>One, text. <select><option>x</select>Two.</p>" + tail + "</div>").split("\n\n")[0] == "One, text. Two."
    assert html_text.main_text("<div><p>One, text. <svg> lost</p>" + tail + "</div>").endswith("eight nine.")
    page = '<article><h1 class="entry-header">Title</h1><p>One, text that is long. And more, it follows.</p></article>'
    assert html_text.main_text(page).startswith("Title\n\n")


def test_ratios_decide_where_lists_alone_would_not():
    prose = "A long sentence, with commas, goes on and on. Another one follows, as it should. " * 3
    plain = "<body><div><div><span>Home</span></div><div><span>About</span></div></div><div>" + f"<p>{prose}</p>" * 4 + "</div></body>"
    found, _ = html_text.blocks(plain)
    assert all(b.prior == 1 for b in found)  # the lists alone would keep the menu
    assert html_text.main_text(plain) == "\n\n".join([prose.strip()] * 4)
    # and would drop a long passage for its class name
    named = f'<body><main>{f"<p>{prose}</p>" * 10}<section class="related"><p>{prose * 20}</p></section>{f"<p>{prose}</p>" * 10}</main></body>'
    assert html_text.main_text(named).count("A long sentence") == 120
    boring = f'<body><main><p>{prose}</p><section class="related"><p>See more</p><p>Next</p></section><p>{prose}</p></main></body>'
    assert html_text.main_text(boring) == "\n\n".join([prose.strip()] * 2)


_PROSE = "Sentence one of the article, with its marks. Another, longer sentence follows here, as it must."
_SHORT = {
    "list": "<ul>" + "".join(f"<li>item {i}</li>" for i in range(12)) + "</ul>",
    "table": "<table>" + "".join(f"<tr><td>row {i}</td></tr>" for i in range(10)) + "</table>",
    "bold": "".join(f"<div><b>line {i}</b></div>" for i in range(8)),
    "verse": "<p>" + "</p><p>".join(f"verse {i}" for i in range(9)) + "</p>",
    "code": "<pre>x = 1</pre><pre>y = 2</pre>",
    "quotes": "<blockquote><p>short</p><p>words</p></blockquote>",
}


@pytest.mark.parametrize("wrap", ["article", "main", "div", "section"])
@pytest.mark.parametrize("kind", list(_SHORT))
def test_short_text_of_the_article_stays(wrap, kind):
    """The expected text is read off the page's own parts: all between the article's tags, nothing outside."""
    import re

    for tail in ("", f"<p>{_PROSE}</p>"):
        inner = f"<h1>Title</h1><p>{_PROSE}</p><p>{_PROSE} Once more.</p>{_SHORT[kind]}{tail}"
        links = "<ul>" + "".join(f'<li><a href="/{i}">Other page {i}</a></li>' for i in range(6)) + "</ul>"
        page = (
            f'<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav><div class="menu"><a href="/m">Menu</a></div>'
            f'<{wrap}>{inner}{links}</{wrap}><div class="sidebar"><p>Side.</p></div><div class="ad">Buy this now</div><footer>Foot</footer></body></html>'
        )
        expected = [x for x in re.split(r"<[^>]*>", inner) if x]
        assert html_text.main_text(page).split("\n\n") == expected
