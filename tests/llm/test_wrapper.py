import random
from functools import reduce

from proofsieve.llm import wrapper


def entry(page):
    return wrapper.wrapper_of(wrapper.parse(page))


def level(page):
    return entry(page)[2]


def read(page, *others):
    """The text of a page under the wrapper of it and other pages, and without a wrapper."""
    found = reduce(wrapper.align, map(entry, (page, *others)))
    parsed = wrapper.parse(page)
    return wrapper.extract(parsed, wrapper.Reading(found, len({page, *others}))), wrapper.extract(parsed, wrapper.Reading(wrapper.NO_WRAPPER, 0))


def test_alignment_finds_slots_options_and_repeats():
    a, b = level("<h1>A</h1><i>x</i><p>one</p>"), level("<h1>B</h1><p>one</p><p>two</p>")
    assert wrapper.expression(wrapper.aligned(a, b)) == "<h1>#PCDATA</h1>(<i>x</i>)?(<p>#PCDATA</p>)+"
    both = wrapper.aligned(level("<h2>a</h2><p>b</p><h2>c</h2>"), level("<p>z</p>"))
    assert wrapper.expression(both) == "((<h2>#PCDATA</h2>)?(<p>#PCDATA</p>)?)+"
    assert wrapper.aligned(a, a) == a
    assert wrapper.expression(level("<p><b>x<br><p>y")) == "(<p>(<b>x<br></br></b>)?(y)?</p>)+"


def page(k, text, article=True):
    open_, close = ("<article>", "</article>") if article else ("<div>", "</div>")
    return f'<html><head><title>t{k}</title><script>var a="</p>";</script></head><body><header><b>Site {k}</b></header><nav><a href="/x">m{k}</a></nav><!-- c --><div class="ad-box">buy {k}</div>{open_}{text}{close}<div id="comments"><p>nice {k}</p></div><p>All rights.</p><footer>f{k}</footer></body></html>'


TEXTS = ["<h1>T &amp; U</h1><p>a <b>b</b>ig\n cat&nbsp;<br>x</p>", "<p>one<p>two <i>three</i>", "<p>&lt;p&gt; é</p><form>f</form><aside>s</aside><ul><li>l1<li>l2</ul>"]
WANT = ["T & U a big cat x", "one two three", "<p> é l1 l2"]


def test_main_text(spark):
    rows = [(i, f"https://h{i % 2}.example.com/{i}?q=1", page(i, TEXTS[i % 3])) for i in range(12)]
    rows += [(50 + i, f"https://plain.example.com/{i}", page(i, TEXTS[i % 3], article=False)) for i in range(6)]
    rows += [(90, None, "<p>x"), (91, "nohost", None), (92, "https://h0.example.com/", ""), (0, rows[0][1], rows[0][2]), (None, rows[1][1], rows[1][2]), (93, "u://q/", "<div>" * 5000 + "deep"), (94, "u://r/", "<p>w " * 20000), (95, "u://s", "<a href='unclosed")]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, pages int, text string")
    got = wrapper.main_text(pages).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    for i in range(12):
        assert set(by[i]) == {WANT[i % 3]}
    for i in range(6):
        assert by[50 + i] == [WANT[i % 3]]
    assert by[90] == ["x"] and by[91] == [""] and by[92] == [""] and len(by[0]) == 2 and by[None] == [WANT[1]]
    assert by[93] == ["deep"] and by[94] == [" ".join(["w"] * 20000)] and by[95] == [""]
    found = {r.host: r for r in wrapper.wrappers(pages.select("html", wrapper._host("url").alias("host"))).collect()}
    assert found["h0.example.com"].pages == 8
    assert wrapper.main_text(pages.limit(0)).count() == 0


def test_whole_texts_and_different_pages_are_compared(spark):
    start = "same words " * 30
    rows = [(i, f"http://edited.example.com/{i}", f"<div><p>{start}version {i}</p></div>") for i in range(4)]
    rows += [(10 + i, "http://copied.example.com/", "<h1>Head</h1><p>only text</p>") for i in range(4)]
    rows += [(20 + i, f"http://plain.example.com/{i}", f"<h1>Site</h1><p>text {i}</p>") for i in range(3)]
    got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{start}version {i}" for i in range(4))
    assert all(got[10 + i] == "Head only text" for i in range(4))
    assert all(got[20 + i] == f"text {i}" for i in range(3))


def test_deep_elements_close_only_themselves():
    deep = "<div>" * 100
    end = "</div>" * 100
    text = lambda page: read(page)[0]
    assert text(f"<div><article>{deep}in{end}<p>after</p></article></div>out") == "in after"
    assert text(f"{deep}<nav>menu<div>x</div></nav>a<div>b</div>c{end}") == "a b c"
    assert text(f"{deep}junk<main><div>m</div>n<nav>menu</nav></main>junk{end}") == "m n"
    assert text(f"<div>{deep}<b>o</b>ne{end}</div><p>two") == "one two"


def pages_of(shape, n=4):
    """Pages of one shape; each number sign is some varying text of twelve words, each @ one of a hundred."""
    rng = random.Random(shape)
    some = lambda n: " ".join(f"w{rng.randint(0, 999)}" for _ in range(n))
    return ["".join(some(12) if c == "#" else some(100) if c == "@" else c for c in shape) for _ in range(n)]


def test_the_wrapper_decides():
    # A line that all articles share is template, under any tag and in a repeated group.
    for line in ("<div>House notice</div>", "<p>House notice</p>", "<p>House <b>notice</b></p>"):
        with_it, without = (read(*pages_of(f"<article><h1>#</h1><p>#</p>{x}<p>#</p></article>")) for x in (line, ""))
        assert "House notice" not in with_it[0] and "House notice" in with_it[1]
        assert len(with_it[0].split()) == len(without[0].split()) == 36
    # Of article elements the one with the text counts, teasers don't.
    got, bare = read(*pages_of("<body><div><article>#</article><article>#</article></div><article><p>@</p></article></body>"))
    assert len(got.split()) == 100 and len(bare.split()) == 124
    # An article element that has next to nothing of the text is not trusted.
    got, bare = read(*pages_of("<body><article>#</article><div><p>@</p><p>@</p></div></body>"))
    assert len(got.split()) == 212 and len(bare.split()) == 12
    # Lists of links outside articles go where pages differ, single links in texts stay.
    got, _ = read(*pages_of("<body><div><div><a>#</a></div></div><p>@ <a>#</a></p></body>"))
    assert len(got.split()) == 112
    # Elements that hold the text are not menus or adverts, whatever their name.
    for shape in ("<form><h1>#</h1><p>@</p></form><p>#</p>", "<div class=share><h1>#</h1><p>@</p></div><nav>#</nav>", "<form><p>@</p></form>"):
        assert len(read(*pages_of(shape))[0].split()) >= 100


def test_names_of_elements():
    for shape in ('<body class="has-sidebar has-header"><p>#</p></body>', '<article class="share-price-report">#</article>', '<p class="notice-of-death">#</p>', "<article><header><h1>#</h1></header></article>", '<main class="ad"><p>#</p></main>', '<div class="mainHeaderImage">#</div><p></p>'):
        for page in pages_of(shape, 2):
            assert len(read(page)[0].split()) == 12, shape
    for name in ("ad", "ad-box", "site-footer", "commentList", "cookie_banner", "top-nav"):
        got, _ = read(*pages_of(f'<article>#</article><div class="{name}">#</div>'.replace("article", "section")))
        assert len(got.split()) == 12, name


def test_copies_and_versions_keep_their_text():
    page = "<h1>Head</h1><p>only text</p>"
    assert read(page, page, page)[0] == "Head only text"
    first, second = "<article><h1>Title of it</h1><p>%s</p><p>old words</p></article>" % ("same " * 20), "<article><h1>Title of it</h1><p>%s</p><p>new</p></article>" % ("same " * 20)
    assert read(first, second)[0].startswith("Title of it same") and read(first, second)[0].endswith("old words")


def test_order_and_copies_do_not_matter():
    rng = random.Random(2)
    shapes = ["<div><h1>#</h1><p>#</p><ul><li>#<li>#</ul></div>", "<div><p>#</p>Fixed<p>#</p></div><nav>#</nav>", "<div><h1>#</h1>Fixed<p>#</p></div>"]
    pages = [p for s in shapes for p in pages_of(s, 3)]
    seen = set()
    for _ in range(5):
        rng.shuffle(pages)
        found = reduce(wrapper.align, map(entry, [*pages, *rng.choices(pages, k=4)]))
        reading = wrapper.Reading(found, 9)
        seen.add(tuple(wrapper.extract(wrapper.parse(p), reading) for p in sorted(pages)))
    assert len(seen) == 1 and sum("Fixed" in t for t in seen.pop()) == 6  # it isn't on all pages


def matches(level, children):
    """Brute force: whether nested tokens are in the language of a wrapper's level."""
    tokens = [c for c in children if not (isinstance(c, str) and (not c or c.isspace()))]

    def one(e, c):
        if isinstance(c, str):
            return e[0] == "#" and (e[2] is None or e[2] == " ".join(c.split()))
        return c[0] == e[0] and matches(e[2], c[1])

    def entries_from(entries, at):
        ends = {at}
        for e in entries:
            ends = (ends if e[1] else set()) | {k + 1 for k in ends if k < len(tokens) and one(e, tokens[k])}
        return ends

    ends = {0}
    for repeated, entries in level:
        now = {x for k in ends for x in entries_from(entries, k)}
        while repeated and (more := {x for k in now for x in entries_from(entries, k)} - now):
            now |= more
        ends = now
    return len(tokens) in ends


def test_wrappers_match_all_their_pages():
    rng = random.Random(4)
    made = lambda d: "".join(f"<{t}>{made(d + 1)}</{t}>" if d < 3 and (t := rng.choice(["div", "p", "ul", "b", ""])) else rng.choice("xyz ") for _ in range(rng.randint(0, 4)))
    for _ in range(150):
        pages = [made(0) for _ in range(rng.randint(1, 5))]
        found = reduce(wrapper.align, map(entry, pages))
        assert all(matches(found[2], wrapper.parse(p)) for p in pages), pages


def test_quotes_hold_values_only_after_an_equals_sign():
    texts = lambda page: [t.strip() for t in flat(wrapper.parse(page)) if t.strip()]

    def flat(nodes):
        for n in nodes:
            if isinstance(n, str):
                yield n
            else:
                yield from flat(n[1])

    assert texts('<p class="a"">Hello "world" again</p><p>two</p>') == ['Hello "world" again', "two"]
    assert texts("<p don't>It's fine</p><p>Tom's</p>") == ["It's fine", "Tom's"]
    assert texts("<p a=b\"c>d</p><p title='x>y' id = \"1>2\">e</p><p a= >f</p>") == ["d", "e", "f"]
    assert texts('<p a="never closed>x</p>') == ["x"] and texts("<p") == [] and texts('<script a="</script>">x</script>y') == ["y"]
    assert texts("<p " + 'a="' * 50_000) == []
