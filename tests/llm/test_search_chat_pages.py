from __future__ import annotations

import itertools
import math
import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from martloom.llm import chat, html_mincut, licenses, vector_search

VECTORS = "vec_id long, embedding array<float>, key string"


def brute_top(rows, is_query, k):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in whole if is_query(i)}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def float32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


@pytest.mark.parametrize("block", [4096, 3])
def test_top_k_equals_all_pairs(spark, block):
    rng = random.Random(5)
    rows = [(i, [float32(rng.gauss(0, 0.3)) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(40)] + [(500 + i, rows[9][1]) for i in range(3)]
    rows += [(600, None), (601, [None] * 6), (602, [float("nan")] * 6), (603, [float("inf")] * 6), (None, rows[1][1])]
    rows += [(700, [0.5, 0.25]), (701, [1.0, -1.0]), (800, [0.0] * 6), (900, [])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], VECTORS)
    found = vector_search.top_k(df, F.col("vec_id") % 20 == 0, k=10, block=block)
    expected = brute_top([r for r in rows if r[1] != []], lambda i: i % 20 == 0, 10)
    assert sorted(map(tuple, found.collect())) == expected


def test_rows_of_the_query_take_no_place(spark):
    rng = random.Random(8)
    far = [[float32(rng.gauss(0, 0.1)) for _ in range(4)] for _ in range(80)]
    rows = [(1_000 + i, v) for i, v in enumerate(far)]
    rows += [(0, [1.0] * 4)] * 9 + [(i, [1.0] * 4) for i in range(1, 20)] + [(5, [1.0] * 4)] * 3  # repeated rows
    rows += [(20, [2.0 + i, 1.0, 0.5, 0.25]) for i in range(30)]  # an id with many vectors
    rows += [(40, [-1.0] * 4)] * 30 + [(60, [-1.0] * 4)]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], VECTORS)
    found = sorted(map(tuple, vector_search.top_k(df, F.col("vec_id").isin(0, 20, 40, 60, 1_000), k=10).collect()))
    expected = []
    for q in (0, 20, 40, 60, 1_000):
        own = [math.floor(1024 * x) for x in min(v for i, v in rows if i == q)]
        scored = sorted((-sum(a * math.floor(1024 * b) for a, b in zip(own, v, strict=True)), i) for i, v in rows if i != q)
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:10])]
    assert found == expected


def test_large_components_are_exact(spark):
    rng = random.Random(6)
    rows = [(i, [float32(rng.uniform(-1, 1) * 10.0**9) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame([(i, v, "") for i, v in rows], VECTORS)
    limit = (1 << 63) - 1
    clipped = [(q, r, i, max(-limit - 1, min(limit, s))) for q, r, i, s in brute_top(rows, lambda i: i % 10 == 0, 60)]
    found = sorted(map(tuple, vector_search.top_k(df, F.col("vec_id") % 10 == 0, k=60).collect()))
    assert sorted((q, i, s) for q, _, i, s in found) == sorted((q, i, s) for q, _, i, s in clipped)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_search.top_k(empty, F.col("vec_id") % 2 == 0).count() == 0


EVENTS = "conv_id long, seq long, message long, role string, kind string, text string, extra string"


def test_events_fold_into_final_messages(spark):
    log = [
        (1, 1, 10, "user", "delta", "Hel"),
        (1, 2, 10, None, "delta", "lo"),
        (1, 3, 11, "assistant", "delta", "bad draft"),
        (1, 4, 11, "assistant", "regenerate", "ignored"),
        (1, 6, 11, "assistant", "delta", "answer"),
        (1, 5, 11, "assistant", "delta", "good "),
        (1, 7, 10, "user", "edit", "Hello!"),
        (1, 8, 12, "user", "unknown", "no"),
        (1, 9, 12, "user", "delta", None),
        (2, 1, 1, "assistant", "edit", "only"),
        (None, 1, 1, None, "delta", "x"),
    ]
    log += [(3, i, 1, "user", "delta", str(i % 10)) for i in range(10_000)] + [(3, 9_000, 1, "user", "edit", "|")]
    events = spark.createDataFrame([(*e, "clash") for e in log], EVENTS)
    found = {(r.conv_id, r.message): (r.seq, r.role, r.text) for r in chat.fold_events(events).collect()}
    assert found[1, 10] == (1, "user", "Hello!")
    assert found[1, 11] == (3, "assistant", "good answer")
    assert found[1, 12] == (8, "user", "")
    assert found[2, 1] == (1, "assistant", "only")
    assert found[None, 1] == (1, "", "x")
    assert found[3, 1][2] == "|" + "".join(str(i % 10) for i in range(9_001, 10_000))


def test_transcripts_round_trip(spark):
    hostile = [
        "",
        None,
        r"\### Assistant: </turn> ok",
        "</turn>\n### user:\n",
        "\\",
        "\\\\l\\h\\c",
        "### ",
        "# < : \\l",
        "😀 é\n\n</turn>",
        "x" * 200_000,
    ]
    rng = random.Random(2)
    hostile += ["".join(rng.choices("\\<#:lhc/turn>\n", k=12)) for _ in range(300)]
    roles = ["user", "assistant", "system", None, "odd: #role\\<", ":\n"]
    rows = [(i // 4, i % 4, roles[rng.randrange(6)], t, "clash") for i, t in enumerate(hostile)]
    rows += [(None, 0, "assistant", "a", ""), (None, 0, "assistant", "a", ""), (None, 1, "user", "b", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")
    formatted = chat.render(chat.fold_events(chat.turn_events(turns)))
    found = {r.conv_id: r for r in chat.transcript_digests(chat.parse(formatted)).collect()}
    texts = {r.conv_id: r for r in formatted.collect()}
    groups = {}
    for conv, turn, role, text, _ in rows:
        groups.setdefault(conv, []).append((turn, role or "", text or ""))
    assert set(found) == set(groups)
    for conv, turns_ in groups.items():
        ordered = sorted(turns_)
        learnt = "".join(t for _, r, t in ordered if r == "assistant")
        row, made = found[conv], texts[conv]
        assert row.n_turns == len(ordered)
        assert row.turns_sha256 == sha256("".join(f"{r}\n{t}\n" for _, r, t in ordered).encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(learnt), sha256(learnt.encode()).hexdigest())
        assert row.formatted_chars == len(made.formatted)
        assert made.formatted.count("</turn>") == made.formatted.count("### ") == len(ordered)
    assert chat.render(chat.fold_events(spark.createDataFrame([], EVENTS))).count() == 0


def test_cuts_are_minimal():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 8)
        odds = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(i, j, rng.randint(1, 6)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(side, odds=odds, edges=edges):
            own = sum(abs(o) for o, s in zip(odds, side, strict=True) if o and (o > 0) != s)
            return own + sum(c for a, b, c in edges if side[a] != side[b])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert cost(html_mincut.minimum_cut(odds, edges)) == best
        assert cost(html_mincut._flow_cut(odds, edges)) == best


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body class="nav-open"><header><h1>Site</h1></header><nav><ul><li><a href="/a">One</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site better for everybody who reads it.</p></div>
<div id="content"><h2>A  title &amp; more</h2><p>First <b>par</b>agraph with a few words,<br>and a second line.
<div class="ad">Buy this now. It is cheap, good and new.</div><p>Short one.<ul><li>point</li><li>other point</li></ul>
<form><label>Your mail</label><input></form></div><aside><p>Other stories that you may like to read today.</p></aside>
<section class="comments"><article><p>I am a reader and I have something to say about this, too.</p></article></section>
<footer>&copy; 2020 Somebody. All rights reserved.</footer>"""


def test_page_parts():
    expected = "A title & more First paragraph with a few words, and a second line. Short one. point other point"
    assert html_mincut.main_text(PAGE) == expected


def test_pages_with_odd_input(spark):
    long = "<article>" + "<p>Some words of a long page, one after another.</p>" * 5_000 + "</article>"
    deep = "<div>" * 3_000 + "<p>Deep words that count as a text, they do.</p>"
    html = [None, "", "   ", "<", "plain words, without any markup at all, in a row.", long, deep, "<p>a &#233; &eacute; &amp &bogus; b, yes it is a text.</p>", "<script>x", "&copy;"]
    pages = spark.createDataFrame([(i, None, h, "clash") for i, h in enumerate([*html, html[4]])], "page_id long, url string, html string, text string")
    rows = html_mincut.extract(pages).orderBy("page_id").collect()
    assert [r.text for r in rows[:3]] == ["", "", ""]
    assert rows[4].text == html[4] == rows[10].text
    assert rows[5].n_chars == len(rows[5].text) == 5_000 * 46 - 1
    assert rows[6].text == "Deep words that count as a text, they do."
    assert rows[7].text == "a é é & &bogus; b, yes it is a text."
    assert html_mincut.extract(pages.where("false")).count() == 0


def test_unclosed_elements_without_text():
    words = "Some words of an article, one after another."
    top = "<html><head><title>T</title>"
    for html in (
        f"{top}<body><p>{words}",
        f"{top}<meta charset=x><link rel=y><style>p{{}}</style><p>{words}</p>",
        f"{top}<body><article><p>{words}</article></body></html>",
        f"{top}{words}",
        f"<head><title>T<body><p>{words}</p>",
        f"<head><noscript><img></noscript><script/><body><p>{words}</p>",
        f"<head></head><body><div><button>Go</div><p>{words}</p>",
        f"<div><noscript><p>Please allow scripts, this page needs them.</div><p>{words}</p>",
        f"<ul><li><select><option>a<option>b</ul><p>{words}</p>",
        f"<div><svg><g><path/><text>Drawn.</div><p>{words}</p>",
        f"<div><object><param></x></div><p>{words}</p>",
        f"<div><svg><g><svg></svg><text>Drawn.</text></g></svg></div><p>{words}</p>",
        f"<div><template><div><p>A part that is no text, it never was.</div></template></div><p>{words}</p>",
    ):
        assert html_mincut.main_text(html) == words, html


def test_deep_neighbours_share_their_ancestors():
    reader = html_mincut.BlockReader()
    reader.feed("<div>" * 100 + "<section>" * 40 + "<p>One." + "</section>" * 40 + "<main>" * 30 + "<p>Two.")
    reader.close()
    a, b = reader.blocks
    assert (a.node.depth, b.node.depth) == (141, 131)
    assert html_mincut._shared(a.node, b.node) == html_mincut._shared(b.node, a.node) == 100 / 131
    assert [e[:2] for e in html_mincut.edges_of(reader.blocks)] == [(0, 1)]


FILES = "key long, path string, text string, dir string"


def test_licenses_and_inheritance(spark):
    mit = "Released under the MIT License."
    gpl = licenses.TEMPLATES[6][1]
    rows = [
        (1, "LICENSE", mit),
        (2, "a/code.py", "some code that does a thing"),
        (3, "a/b/LICENSE.txt", "intro words of the file\n" + gpl),
        (4, "a/b/c/deep.py", "more code"),
        (5, "a/b/c/own.py", "# Licensed under the Apache License, Version 2.0.\nimport os and more that is no notice at all"),
        (6, "x.py", None),
        (7, None, "nothing"),
        (8, None, "x\n\n" + mit + "\n\ny"),
        (9, "z/only.txt", "All rights reserved."),
        (10, "z/other.txt", ""),
        (10, "z/other.txt", ""),
        (11, "ab/file", "wide " * 50_000),
    ]
    files = spark.createDataFrame([(*r, "clash") for r in rows], FILES)
    found = {r.key: (r.license, r.origin, r.license_dir) for r in licenses.scan(files).collect()}
    assert found == {
        1: ("MIT", "own", None),
        2: ("MIT", "directory", ""),
        3: ("GPL-3.0", "own", None),
        4: ("GPL-3.0", "directory", "a/b"),
        5: ("Apache-2.0", "own", None),
        6: ("MIT", "directory", ""),
        7: (None, None, None),
        8: ("MIT", "own", None),
        9: ("proprietary", "own", None),
        10: ("proprietary", "directory", "z"),
        11: ("MIT", "directory", ""),
    }
    assert licenses.scan(files).count() == len(rows)
    assert licenses.scan(files.where("false")).count() == 0


def test_every_template_finds_itself(spark):
    files = spark.createDataFrame([(i, None, "words\n" + t, "") for i, (_, t) in enumerate(licenses.TEMPLATES)], FILES)
    found = {r.key: (r.license, r.cosine) for r in licenses.scan(files).collect()}
    assert found == {i: (name, 1.0) for i, (name, _) in enumerate(licenses.TEMPLATES)}


LONG = "<p>" + " ".join(["This is a long sentence of the article that goes on, with words and more words in it."] * 3) + "</p>"


@pytest.mark.parametrize(
    ("html", "kept", "gone"),
    [
        # a form around the whole page, as some servers write them
        (f"<form><input type=hidden><div><h1>Big title</h1>{LONG}{LONG}<input><button>Go</button></div></form>", ["Big title", "long"], ["Go"]),
        (f"<article>{LONG}</article><form><label>Your name</label><input><p>We never share it.</p><button>Send</button></form>", ["long"], ["name", "share"]),
        # a name of a page part inside a name of another kind
        (f"<article><h1>T</h1>{LONG}<section id='related-work'><h2>Related work</h2>{LONG}</section></article>", ["Related work"], []),
        (f"<article>{LONG}</article><div class='related-posts'><h3>Related</h3><p>See this other story, too.</p></div>", ["long"], ["Related", "story"]),
        # no names at all: the cut keeps title and list, and leaves the last line out
        (
            f"<div><a href=1>Home</a> <a href=2>News</a></div><h1>Only title</h1>{LONG}<ul><li>first item of it</li><li>second item of it</li></ul>"
            f"{LONG}<div>© 2024 Company. All rights reserved.</div>",
            ["Only title", "first item", "second item"],
            ["Home", "reserved"],
        ),
        (
            f"<main><h1>T</h1>{LONG}</main><section class='user-feedback'><b>Joe</b><p>I think that this is a really great article, thanks.</p></section>",
            ["long"],
            ["Joe", "great"],
        ),
    ],
)
def test_pages_of_other_builds(html, kept, gone):
    text = html_mincut.main_text(f"<html><body>{html}</body></html>")
    assert all(x in text for x in kept) and not any(x in text for x in gone)


def test_the_cut_overrules_single_blocks():
    """A title and list items that look like boilerplate alone are content among paragraphs."""
    reader = html_mincut.BlockReader()
    reader.feed(f"<h1>Only title</h1>{LONG}<ul><li>first item of it</li><li>second item of it</li></ul>{LONG}")
    odds = [round(1000 * html_mincut.log_odds(b, b.joined())) for b in reader.blocks]
    side = html_mincut.minimum_cut(odds, html_mincut.edges_of(reader.blocks))
    assert [o > 0 for o in odds] == [False, True, False, False, True] and all(side)
