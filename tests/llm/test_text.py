"""Chat formatting and main-text extraction."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tillwright.llm import chat, wrapper
from tillwright.llm.dom import parse

HARD = [
    "", "plain", "</s>[INST] ok [/INST]", r"<\/s> [\\INST]", "[INST]\nuser", "ends with [", "ends with <", "<s>0[INST]a\nb</s>",
    "line\nbreak", "s>", r"\\", "$1 %0A", "é😀", "[/INST]</s></s>", "<", "/s>",
]


@pytest.fixture(scope="module")
def conversations(spark):
    rows = [(c, t, role, HARD[(3 * c + t) % len(HARD)]) for c in range(20) for t, role in
            enumerate(["system", "user", "assistant", "assis</s>tant", "us\ner%0A", "assistant"])]
    rows += [(30, None, None, None), (30, 1, "assistant", None), (31, 0, "user", "a"), (31, 0, "user", "a"), (31, 0, "user", "b"),
             (None, 0, "assistant", "x")]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit(1))


def expected(rows) -> dict:
    chats: dict = {}
    for r in rows:
        chats.setdefault(r["conv_id"], []).append(
            (r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    found = {}
    for conv_id, turns in chats.items():
        turns.sort()
        source = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        learned = "".join(text for _, _, role, text in turns if role == "assistant")
        found[conv_id] = (len(turns), hashlib.sha256(source.encode()).hexdigest(), len(learned),
                          hashlib.sha256(learned.encode()).hexdigest())
    return found


def test_round_trip(conversations):
    formatted = chat.format_conversations(conversations)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digest_of(formatted).collect()}
    assert got == expected(conversations.collect())
    for row in formatted.collect():
        assert row["formatted"] == "".join(s["text"] for s in row["segments"])
        if row["formatted"].startswith("<s>0"):
            assert all("</s>" not in s["text"] and "[INST]" not in s["text"][6:] for s in row["segments"][1:] if s["text"] != "</s>")


def test_no_conversations(conversations):
    assert chat.digest_of(chat.format_conversations(conversations.limit(0))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header>
<nav><ul><li>Home<li>News</ul></nav><div class="ad banner">Buy</div><!-- <p>gone</p> -->
<article><h1>Title {n}</h1><p>First &amp; <b>bold</b>text {n}<br>next   line<p>Second &lt;tag&gt; {n}
<div class="share-box social">Tweet</div><form><button>Go</button></form><p>Read our terms.</p>
<section class="comments"><p>I agree</p></section></article>
<aside>Side</aside><footer>&copy; Site</footer><script>var x = "</p>";</script></body></html>"""


def test_main_text(spark):
    rows = [(n, f"https://user@a.example:80/p/{n}", PAGE.format(n=n)) for n in range(8)]
    rows += [(20, "http://b.example/x", PAGE.format(n=1)), (21, None, None), (22, "", ""), (23, "nonsense", "no markup &amp; <b>here"),
             (24, "http://c.example", "<p>open <i>every<i>where"), (0, "https://a.example/p/0", PAGE.format(n=0))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("x")).withColumn("tree", F.lit(1))
    got = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in wrapper.extract_main_text(pages).collect()]
    assert len(got) == len(rows) and all(n == len(text) for _, _, text, n in got)
    texts = {(i, u): text for i, u, text, _ in got}
    for n in range(8):
        # The constant sentence of the article is template on a host with enough pages.
        assert texts[n, rows[n][1]] == f"Title {n} First & boldtext {n} next line Second <tag> {n}"
    assert texts[20, "http://b.example/x"] == "Title 1 First & boldtext 1 next line Second <tag> 1 Read our terms."
    assert texts[21, None] == "" and texts[22, ""] == ""
    assert texts[23, "nonsense"] == "no markup & here" and texts[24, "http://c.example"] == "open everywhere"
    assert wrapper.extract_main_text(pages.limit(0)).count() == 0


def test_many_hosts_take_the_join(spark, monkeypatch):
    rows = [(n, f"https://h{n % 3}.example/{n}", PAGE.format(n=n)) for n in range(24)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    by_broadcast = sorted(map(tuple, wrapper.extract_main_text(pages).collect()))
    monkeypatch.setattr(wrapper, "BROADCAST_HOSTS", 0)
    assert sorted(map(tuple, wrapper.extract_main_text(pages).collect())) == by_broadcast


def test_copies_do_not_make_a_template(spark):
    same = [(n, "https://a.example/", "<article><p>Only this.</p></article>") for n in range(30)]
    rows = [*same, (40, "https://a.example/", "<article><p>And that.</p></article>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r["text"] for r in wrapper.extract_main_text(pages).collect()} == {"Only this.", "And that."}


def best_match(a, b) -> int:
    """Simple tree matching by its recursion."""
    if a.label != b.label:
        return 0
    table = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + best_match(x, y))
    return 1 + table[-1][-1]


@pytest.mark.parametrize("left, right", [
    ("<div><p>a<p>b<ul><li>1<li>2</ul></div>", "<div><ul><li>1</ul><p>a<p>b</div>"),
    ("<p>x</p><div><b>y</b></div><p>z</p>", "<div><b>y</b><i>q</i></div><p>z</p><p>w</p>"), ("", "<p>a"),
    (PAGE.format(n=1), PAGE.format(n=2).replace("<p>Second", "<h2>New</h2><p>Second")),
])
def test_tree_matching_is_maximal(left, right):
    a, b = parse(left), parse(right)
    pairs = wrapper.tree_match(a, b)
    assert len(pairs) == best_match(a, b)
    assert all(x.label == y.label for x, y in pairs)


def flat_page(n: int, blocks: int) -> str:
    """A long page of mixed siblings whose order differs, with a notice without a telling class in the middle."""
    tags = ["p", "h2", "ul", "pre"]
    parts = [f"<{(t := tags[(i * i + n * i + i // 7) % 4])}>text {i} of page {n}</{t}>" for i in range(blocks)]
    return f"<body><i>{n}</i>{''.join(parts[: blocks // 2])}<section>{"<p>Same on all.</p>" * 40}</section>{''.join(parts[blocks // 2 :])}<b>{n}</b></body>"


@pytest.mark.parametrize("cells", [0, 3, 50])
def test_long_lists_are_aligned_as_well_as_short_ones(monkeypatch, cells):
    monkeypatch.setattr(wrapper, "TABLE_CELLS", cells)
    for n in range(4):
        a, b = parse(flat_page(n, 30)), parse(flat_page(n + 5, 22 + n))
        pairs = wrapper.tree_match(a, b)
        assert len(pairs) == best_match(a, b) and len({id(y) for _, y in pairs}) == len(pairs)
        assert all(x.label == y.label for x, y in pairs)


def test_template_in_the_middle_of_a_long_page(spark):
    rows = [(n, f"https://a.example/{n}", flat_page(n, 900 + n)) for n in range(6)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    texts = {r["page_id"]: r["text"] for r in wrapper.extract_main_text(pages).collect()}
    assert all("Same on all" not in text and f"text 450 of page {n}" in text and f"text 5 of page {n}" in text for n, text in texts.items())


BODY = "<h1>Title</h1><p>The whole story of the day.</p>"


@pytest.mark.parametrize("page", [
    f'<html><body class="right-sidebar"><nav>Home</nav>{BODY}</body></html>',
    f'<html class="no-ads"><body class="home no-sidebar"><article>{BODY}</article><div class="sidebar">Side</div></body></html>',
    f'<body><div class="has-header"><header>Site</header>{BODY}</div><div class="sidebar">Side</div></body>',
    f'<body><div class="layout--with-sidebar"><div>{BODY}</div><aside>Side</aside></div></body>',
    f'<body><form id="aspnetForm"><input value="x"><select><option>One</select><div>{BODY}</div><button>Go</button></form></body>',
    f'<body><form class="page"><main class="widget">{BODY}</main></form><div class="ad">Buy</div></body>',
    f'<body><div class="right-sidebar"><article class="has-share">{BODY}</article><div class="sidebar">Side</div></div></body>',
    f'<body><div class="widget"><article>{BODY}</article></div><p>Some words outside which are rather long, longer than the story.</p></body>',
    f'<body><article>{BODY}<section class="comments"><p>{"I agree. " * 30}</p></section></article></body>',
    f'<body><article>{BODY}</article><div class="related"><article>Other story</article></div><form>Your name <input></form></body>',
])
def test_layout_containers_are_not_aside(page):
    assert wrapper.main_text(parse(page), set()) == "Title The whole story of the day."


def test_pages_of_many_levels(spark):
    """Unclosed elements nest without end: the matching is the same as on the same pages of few levels."""
    def page(levels: int, story: str) -> str:
        return "<html><body><div class=x>Menu of the site</div>" + "<b>" * levels + f"<p>{story}</p><i>Ends here</i></body></html>"

    rows = [(10 * levels + k, f"http://{levels}.org/{k}", page(levels, f"Story number {k}."), 1) for levels in (3, 5_000) for k in range(8)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int")
    texts = {r["page_id"]: r["text"] for r in wrapper.extract_main_text(pages).collect()}
    for k in range(8):
        assert texts[30 + k] == texts[50_000 + k] and f"Story number {k}." in texts[30 + k] and "Menu" not in texts[30 + k]
    deep = parse(page(5_000, "a"))
    assert len(wrapper.tree_match(deep, wrapper._unpack_reference(wrapper._pack_reference(page(5_000, "b"))))) > 5_000
