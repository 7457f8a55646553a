import functools
import random
import time
from collections import Counter

from graphloom.llm import html as h

PAGES = "page_id long, url string, html string"


def tree(rng, depth=3):
    return [rng.choice("abc"), [tree(rng, depth - 1) for _ in range(rng.randrange(4))] if depth else []]


def matched(a, b):
    """Simple tree matching by its recursive definition."""
    if a[0] != b[0]:
        return 0

    @functools.cache
    def best(i, j):
        if i == len(a[1]) or j == len(b[1]):
            return 0
        return max(best(i + 1, j), best(i, j + 1), matched(a[1][i], b[1][j]) + best(i + 1, j + 1))

    return best(0, 0) + 1


def test_alignment_is_a_largest_match():
    rng = random.Random(1)
    for _ in range(200):
        a, b = tree(rng), tree(rng)
        b[0] = a[0]
        pairs = h.align(a, b)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
        assert h._match(a, b, {}) == matched(a, b)
        assert 1 + sum(matched(a[1][i], b[1][j]) for i, j in pairs) == matched(a, b)


def test_long_lists_are_aligned_as_short_ones(monkeypatch):
    p, ad = ["p", []], ["div.ad", []]
    wrapper, one = ["", [["h1", []]] + [p] * 690 + [ad] + [p] * 10], ["", [["h1", []], ad] + [p] * 600]
    assert 700 * 601 > h._PAIRS and len(h.align(wrapper, one)) == 601
    rng = random.Random(5)
    for _ in range(200):
        a, b = tree(rng), tree(rng)
        b[0] = a[0]
        short = h.align(a, b)
        with monkeypatch.context() as m:
            m.setattr(h, "_PAIRS", 0)
            assert h.align(a, b) == short
        assert 1 + sum(matched(a[1][i], b[1][j]) for i, j in short) == matched(a, b)


def page(i, body, extra=""):
    return (
        f'<html><head><title>T{i}</title></head><body><div class="top">Our site</div><nav><a href="/x">x{i}</a></nav>{extra}'
        f"<article><h1>Title {i}</h1>{body}</article><p>All rights reserved</p><script>var a='<p>';</script></body></html>"
    )


def test_template_and_content(spark):
    rows = [(i, f"https://a.example/{i}", page(i, "".join(f"<p>Text {i} {k} &amp; more</p>" for k in range(1 + i % 3)), '<div id="ad">Buy now</div>' if i % 2 else "")) for i in range(12)]
    rows += [(100 + i, f"http://b.example:80/{i}", f"<table><tr><td>Name<td>n{i}<tr><td>Size<td>{i}</table>") for i in range(5)]
    got = {r.page_id: r.content for r in h.extract_content(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(12):
        assert got[i].split("\n") == [f"Title {i}"] + [f"Text {i} {k} & more" for k in range(1 + i % 3)]
    for i in range(5):
        assert got[100 + i].split("\n") == [f"n{i}", f"{i}"]


def test_edge_cases(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    wide = "".join(f"<p>{i}</p><b>x{i}</b>" for i in range(3000))
    rows = [
        (1, None, "<p>alone"), (2, "http://c.example/", None), (3, "http://c.example/", ""), (None, "http://c.example/", "<p>x"), (4, "nonsense", "text < only & more"),
        (5, "http://d.example/", deep), (6, "http://e.example/", wide), (7, "http://e.example/", wide.replace("<p>7</p>", "")), (8, "http://f.example/", "<p>same"), (8, "http://f.example/", "<p>same"),
    ]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS host", "2 AS tree", "3 AS slot", "4 AS row")
    got = {}
    for r in h.extract_content(df).collect():
        got.setdefault(r.page_id, []).append(r.content)
    assert got[1] == ["alone"] and got[2] == [None] and got[3] == [""] and got[4] == ["text < only & more"] and got[5] == ["deep"] and None not in got
    assert got[8] == ["", ""] and len(got[6]) == 1
    assert h.extract_content(df.limit(0)).count() == 0


def contents(spark, rows):
    return {r.page_id: r.content.split("\n") for r in h.extract_content(spark.createDataFrame(rows, PAGES)).collect()}


def test_copies_among_other_pages_keep_their_content(spark):
    body = lambda i, n: "".join(f"<p>Text {i} {k}</p>" for k in range(n))
    rows = [(i, f"https://g.example/{i}", page(i, body(i, 3))) for i in range(20)]
    rows += [(100, "https://g.example/long", page(50, body(50, 40))), (101, "https://g.example/long?print", page(50, body(50, 40), "<div>Print view</div>"))]
    rows += [(200 + i, f"https://h.example/{i}", page(max(i, 1), body(max(i, 1), 5))) for i in range(4)]  # 200 and 201 are copies
    got = contents(spark, rows)
    assert got[100] == ["Title 50"] + [f"Text 50 {k}" for k in range(40)] and got[101] == ["Print view"] + got[100]
    for i in range(4):
        assert got[200 + i] == [f"Title {max(i, 1)}"] + [f"Text {max(i, 1)} {k}" for k in range(5)]


def test_slots_decide_on_form_aside_and_footer(spark):
    rows = [(i, f"https://i.example/{i}", f"<body><form><p>Search</p><article><p>Text {i}</p><footer>By author {i}</footer></article><aside>Note {i}</aside><button>Send</button></form><footer>Imprint</footer></body>") for i in range(6)]
    got = contents(spark, rows)
    assert all(got[i] == [f"Text {i}", f"By author {i}", f"Note {i}"] for i in range(6))


def test_against_brute_force(spark):
    """Labels that differ among siblings leave one best match, so a slot is a path of labels: count texts by path."""
    rng = random.Random(11)
    master = {}

    def build(path, depth, i):
        names = master.setdefault(path, [f"div class=c{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 5))] if depth else [])
        out, found = "", []

        def text(slot):
            nonlocal out
            kind = master.setdefault((path, slot), rng.choice(["constant", "varying", "half", "blank"]))
            t = {"constant": f"K{slot}", "varying": f"v{i} {rng.randrange(10**6)}", "half": f"H{rng.randrange(3)}", "blank": " "}[kind]
            out += t
            if t.strip():
                found.append(((path, slot), t))

        for k, name in enumerate(names):
            if i and rng.random() < 0.2:  # the first page has all elements, which settles their order
                continue
            text(k)
            inner, more = build((*path, k), depth - 1, i)
            out += f"<{name}>{inner}</div>"
            found.extend(more)
        text(None)
        return out, found

    rows, expected = [], {}
    for host in range(3):
        master.clear()
        pages = [build((host,), 3, i) for i in range(30)] if host else []
        pages += [pages[3]] * 4 if host else [("<p>only <b>one</b>", [(1, "only"), (2, "one")])] * 3
        distinct = {tuple(f) for _, f in pages}
        n = len(distinct) if len(distinct) > 1 else len(pages)
        share = Counter(x for f in (distinct if len(distinct) > 1 else [f for _, f in pages]) for x in set(f))
        for i, (source, f) in enumerate(pages):
            rows.append((host * 100 + i, f"http://{host}.example/{i}", source))
            kept = [t for s, t in f if not (share[s, t] > 1 and share[s, t] >= 0.5 * n)]
            expected[host * 100 + i] = ("\n".join(kept), len(f), len(f) - len(kept))
    got = {r.page_id: (r.content, r.n_slots, r.n_template) for r in h.extract_content(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == expected and sum(n for _, _, n in got.values()) > 100


def test_groups_of_shapes_are_merged_by_levels(spark, monkeypatch):
    monkeypatch.setattr(h, "GROUP", 3)
    rows = [(i, "https://j.example/", f"<div class=top>Our site</div><article>{''.join(f'<p>Text {i} {k}</p>' for k in range(i + 1))}</article><div class=end>Imprint</div>") for i in range(25)]
    got = contents(spark, rows)
    assert all(got[i] == [f"Text {i} {k}" for k in range(i + 1)] for i in range(25))


def test_end_tags_in_any_case():
    for source in ("<HTML><HEAD><TITLE>x</TITLE></HEAD><BODY><P>Body text", "<Title>x</tItle ><p>Body text</P>", "<title>x<p>Body text", "<SCRIPT>a('<p>')</Script><p>Body text"):
        assert "Body text" in [h.clean(t) for t in h.texts(h.parse(source))], source
    assert [t for t in h.texts(h.parse("<TEXTAREA>a <b></TextArea>c")) if t] == ["a <b>", "c"]


def test_time_is_in_proportion_to_the_page():
    for piece in ('<a href="x', '<a href="x>', '<a ">" ', "<a '\"'>", "<!", "<!-- ", "<", "< ", "<script>", "<title>", "<script></SCRIPT>", "</b>", "<i></b>", "<div>", "<p>a", "<a class  ", "&", '<a b=">" c=\''):
        source = piece * (1_000_000 // len(piece))
        for tail in ("", ">", "<p>end"):
            began = time.process_time()
            h.texts(h.parse(source + tail))
            assert time.process_time() - began < 10, piece


def test_unequal_depths_and_widths():
    deep = lambda x: functools.reduce(lambda t, _: ["div", [t]], range(20000), [x, []])
    kinds = h.Kinds()
    a, b = deep("p"), deep("q")
    assert kinds.shared(kinds.of(a)[id(a)], kinds.of(b)[id(b)]) == 20000
    assert h.shape(h.tree_of(h.shape(a))) == h.shape(a)
    wrapper = h.induce([a, b])
    assert len(h.places(wrapper, h.numbered(wrapper), kinds, kinds.of(wrapper), ["", []])) == 1


def test_hidden_is_a_parameter_and_names_may_clash(spark):
    rows = [(i, "https://k.example/", f"<nav>Menu</nav><nav>You are at {i}</nav><p>Text {i}</p>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").selectExpr("*", "1 AS keys", "map(1, 2) AS texts", "3 AS template", "4 AS n", "5 AS c0", "6 AS rows")
    got = {r.page_id: r.content for r in h.extract_content(df, hidden=frozenset(("script", "style", "template", "head"))).collect()}
    assert got == {i: f"You are at {i}\nText {i}" for i in range(4)}
