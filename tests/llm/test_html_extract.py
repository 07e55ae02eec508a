import random
import time

import pytest

from fieldstream.llm.html_extract import Page, extract, host_paths, votes

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t="</p><article>no</article>";</script></head>
<body class="no-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy now</div>
<div class="cookie-notice">We use cookies</div><{box}><header><h1>Head &amp; shoulders</h1></header><p><b>First <i>par</i>a&shy;.<br>Line&nbsp;two<p>Second para{more}.</p>
<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><div class="commentList comments"><p>Reader says a lot of things that are very long indeed and go on.</p></div><form>Name<input></form><aside>Side</aside></{close}>
<footer>&copy; Site</footer></body></html>"""
WANT = "Head & shoulders First para\xad. Line two Second para{more}. one two c1 c2"


def page(box="article", close="article", more=""):
    return PAGE.format(box=box, close=close, more=more)


def test_one_page():
    assert Page(page()).extract(None) == WANT.format(more="")
    assert Page(page()).extract(["no>such"]) == WANT.format(more="")


def test_odd_markup():
    for source in ("", "plain text", "<", "<p", "</p></div>", "<p>a<p>b</b></i>", "<script>never closed <p>x", "<!-- open", "<div " * 50, "<div " * 40_000, "<p class=x>" + "<div class='y'>" * 20_000 + "z", "<b>" * 3000 + "deep", "a < b & c &lt; d &#x41; &unknown;"):
        assert isinstance(Page(source).extract(None), str)
    assert Page("<p>a<p>b</b></i>").extract(None) == "a b"
    assert Page("<p title=it's>one</p><p title=\"a>b\">it's</p>").extract(None) == "one it's"
    assert Page("a < b & c &lt; d &#x41;").extract(None) == "a < b & c < d A"
    assert Page("<div>x<b>y</b>z <span>w</span></div>").extract(None) == "xyz w"


def test_paths_are_generalised():
    (path, _), *_ = votes("<body><div class='b post-12 A'><p>" + "word " * 50 + "</p></div></body>")
    assert path == ">body>div.a.b.post-#"


def test_hosts_agree(spark):
    long = " and more words" * 40
    box = ['div class="story s1"', "div"]
    rows = [(i, f"https://User@A.example:80/{i}", page(*box, more=long)) for i in range(6)]
    # its sidebar has more text than its story: only the host's path tells
    odd = page(*box).replace("<footer>", '<div class="extra"><p>' + "other text " * 60 + "</p></div><footer>")
    rows += [(10, "http://a.example/odd", odd), (11, "http://b.example/", odd), (12, None, page()), (13, "http://c.example", None), (14, "not a url", ""), (10, "http://a.example/odd", odd), (None, "http://a.example", page(*box))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract(df).collect()), key=str)
    assert got == sorted(map(tuple, extract(df, broadcast_bytes=0, salts=3).collect()), key=str)
    text = {**{i: WANT.format(more=long) for i in range(6)}, 10: WANT.format(more=""), 11: ("other text " * 60).strip(), 12: WANT.format(more=""), 13: "", 14: "", None: WANT.format(more="")}
    assert got == sorted(((i, u, text[i], len(text[i])) for i, u, _ in rows), key=str)
    assert extract(df.limit(0)).count() == 0


ARTICLE = "<h1>Title</h1>" + "".join(f"<p>Paragraph {k} of the story has several words in it.</p>" for k in range(8))
STORY = "Title " + " ".join(f"Paragraph {k} of the story has several words in it." for k in range(8))


def test_class_words_do_not_lose_an_article():
    nav, comments = "<nav><a href='/'>Home</a></nav>", "<section id='comments'><article class='comment'><p>" + "A reader says much about this. " * 30 + "</p></article></section>"
    for before, after in (
        ('<article class="post comments-open">', "</article>"), ('<div class="has-sidebar"><article>', "</article></div>"), ('<main class="ad-free">', "</main>"), ('<div class="page sidebar-left"><div class="text">', "</div></div>"),
        ('<form id="aspnetForm"><div>', "</div></form>"), ('<div class="widget-area"><main>', "</main></div>"), ('<article id="related">', "</article>"),
    ):
        assert Page(f"<body>{nav}{before}{ARTICLE}{after}<div class='ad'>Buy now</div><footer>f</footer></body>").extract(None) == STORY, before
        assert Page(f"<body>{nav}{before}{ARTICLE}{comments}{after}<div class='sidebar'>Side</div></body>").extract(None) == STORY, before


def test_deep_and_wide_pages_take_linear_time():
    deep = 50_000
    began = time.perf_counter()
    assert Page("<div>" * deep + "<p>" + "word " * 20).extract(None) == "word " * 19 + "word"
    assert Page("<b>" * deep + "x" + "</b>" * deep).extract(None) == "x"
    assert Page("<h2>" * deep + "x").extract(None) == "x"
    assert Page("<body><div><b>x" * deep).extract(None)
    assert Page("<i>" * deep + "</b>" * deep + "x").extract(None) == "x"
    wide = Page("<div class='a'><p>text</p></div>" * deep)
    assert wide.at_path(">div.a") == " ".join(["text"] * deep)
    assert time.perf_counter() - began < 30


def test_deep_paths_differ():
    page = Page("<div>" * 60 + "<div class='a'><p>one</p></div><div class='b'><p>two</p></div>")
    assert page.at_path(next(p for p in page.paths if p.endswith("div.a"))) == "one"
    assert len(set(page.paths)) == len(page.paths)
    assert max(map(len, page.paths)) < 1000


def test_a_page_without_its_hosts_layout_keeps_its_article(spark):
    common = "<body><div class='body'><p>" + "words of the story " * 40 + "</p></div></body>"
    other = "<body><div class='body'><p>teaser</p></div><div class='gallery'><p>" + "a long caption of a picture " * 30 + "</p></div></body>"
    rows = [(k, "http://a.example", common) for k in range(5)] + [(9, "http://a.example", other)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == ("words of the story " * 40).strip() and got[9] == ("a long caption of a picture " * 30).strip()


def made_page(rng, k):
    """A page made from random parts, and the text of its article by the way that it was made."""
    word = lambda: rng.choice(["alpha", "beta", "&amp;", "gamma&nbsp;", "d&#233;lta", "x&lt;y"])
    plain = lambda w: {"&amp;": "&", "gamma&nbsp;": "gamma", "d&#233;lta": "d\u00e9lta", "x&lt;y": "x<y"}.get(w, w)
    body, want = [], []
    for _ in range(rng.randint(3, 9)):
        words = [word() for _ in range(rng.randint(8, 40))]
        inner = " ".join(rng.choice(["{}", "<b>{}</b>", "<a href='/x'>{}</a>" if rng.random() < 0.2 else "<i>{}</i>", "{}\n"]).format(w) for w in words)
        tag = rng.choice(["p", "p", "p", "h2", "blockquote"])
        body.append(f"<{tag}>{inner}</{tag}>" if tag != "p" or rng.random() < 0.7 else f"<p>{inner}")
        want += map(plain, words)
        if rng.random() < 0.4:
            body.append(rng.choice(["<script>if (a < b) x('</p>');</script>", "<!-- no -->", "<form>Mail <input></form>", "<div class='share-buttons'>Share</div>", "<aside>Side note</aside>", "<style>p{}</style>"]))
    tag, name = ("article", "story s%d" % k) if k % 2 else ("div", "content")
    around = "<header><a href='/'>Site</a></header><nav><ul><li><a href='/a'>A</a></ul></nav>", "<div class='newsletter'><p>Subscribe now</p></div><footer><p>Imprint</p></footer>"
    return f"<html><head><title>t</title></head><body>{around[0]}<{tag} class='{name}'>{''.join(body)}</{tag}>{around[1]}</body></html>", " ".join(want)


def test_made_pages(spark):
    rng = random.Random(12)
    made = [made_page(rng, k) for k in range(200)]
    rows = [(k, f"https://h{k % 2}.example/{k}", source) for k, (source, _) in enumerate(made)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(made)}


def mixed(k, share):
    """A page of a host with two layouts: one has its article in div.content, the other in div.story, below an intro in div.content."""
    text = " ".join(f"word{k} and {j} more of the article" for j in range(40))
    side = "<div class='panel'><p>" + "the same panel on every page of this host " * 3 + "</p></div>"
    if k % 100 < 100 * share:
        return f"<body><div class='content'><p>{'An intro of the site stands here. ' * 4}</p></div><div class='story'><p>{text}</p></div>{side}</body>", text
    return f"<body><div class='content'><p>{text}</p></div>{side}</body>", text


@pytest.mark.parametrize("share", [0.05, 0.2, 0.5])
def test_mixed_layouts_keep_their_articles(spark, share):
    made = [mixed(k, share) for k in range(100)]
    rows = [(k, "http://mixed.example", source) for k, (source, _) in enumerate(made)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: text for k, (_, text) in enumerate(made)}


def test_one_page_of_its_own_layout(spark):
    """No other page speaks for its path; it has more than eleven times the text at the winning one."""
    rows = [(k, "http://mixed.example", mixed(k, 0)[0]) for k in range(1, 30)]
    odd, text = mixed(0, 1)
    got = {r.page_id: r.text for r in extract(spark.createDataFrame([*rows, (0, "http://mixed.example", odd.replace("stands here. " * 1, "here "))], "page_id long, url string, html string")).collect()}
    assert got[0] == text


READ = "<p>" + "A reader says much about this. " * 12 + "</p>"


def test_comments_of_readers_go():
    article = "<h1>Title</h1>" + "<p>Sentence of the story, one of several. </p>" * 20
    want = "Title " + " ".join(["Sentence of the story, one of several."] * 20)
    for block in (f'<div class="comments-open">{READ}</div>', f'<ol class="responses"><li>{READ}</li></ol>', f'<section id="discussion">{READ}</section>', f'<div class="has-comments"><div>{READ}</div></div>', f'<div id="replies-enabled">{READ}</div>'):
        for page in (f"<body><article>{article}{block}</article></body>", f"<body><div class='content'>{article}{block}</div></body>", f"<body><div class='content'>{article}</div>{block}</body>"):
            assert Page(page).extract(None) == want, page[-200:]
    for around in ('<div class="page comments-open">', '<div class="discussion">', '<body class="has-comments">', '<div class="post no-sidebar">'):
        assert Page(f"<body>{around}{article}</div></body>").extract(None) == want


def slow_twin(pages):
    """Votes, winners, layouts and choice by plain dictionaries over all pages."""
    hosts = {}
    for host, source in pages:
        for place, (path, share) in enumerate(votes(source)):
            row = hosts.setdefault(host, {}).setdefault(path, [0, 0, 0])
            row[0], row[1], row[2] = row[0] + share, row[1] + (place == 0), row[2] + 1
    chosen = {}
    for host, found in hosts.items():
        most = max(v[0] for v in found.values())
        wins = [p for p in sorted(found, key=lambda p: (-round(100 * found[p][0]), p))[:3] if 2 * found[p][0] >= most]
        chosen[host] = wins, [p for p, v in found.items() if p not in wins and v[1] >= 3 and 2 * v[1] >= v[2]]
    out = []
    for host, source in pages:
        page, (wins, layouts) = Page(source), chosen.get(host, ([], []))
        best = page.best()
        own, known = page.text(best), page.paths[best] in wins + layouts
        fits = [t for w in wins if (t := page.at_path(w)) and len(t) >= (0.5 if known else 0.09) * len(own)]
        out.append(fits[0] if fits else page.at_path(page.paths[best]) if known else own)
    return out


def test_equals_the_slow_twin(spark):
    rng = random.Random(8)
    pages = [(f"h{rng.randrange(4)}.example", rng.choice([lambda k: mixed(k, 0.3)[0], lambda k: made_page(rng, k)[0], lambda k: page(rng.choice(["article", 'div class="story s1"', "section"]), "div", " word" * rng.randrange(60))])(k)) for k in range(200)]
    df = spark.createDataFrame([(k, f"http://{h}/{k}", s) for k, (h, s) in enumerate(pages)], "page_id long, url string, html string").repartition(5)
    for limit in (1 << 20, -1):
        assert [r.text for r in sorted(extract(df, limit).collect(), key=lambda r: r.page_id)] == slow_twin(pages)
    assert any(r.layouts for r in host_paths(df).collect())
