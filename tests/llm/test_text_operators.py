"""Every operator against brute force, on rows with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polefold.llm import common, decontaminate, edit_prints, html_text, lang_id, line_dedup, maglev, packing, quality, simhash, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, raw string, words int, row int, key string, uid int, n int"


def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(400)] + ["é", "Ärger", "naïve"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = sentence(70)
    base = sentence(200)
    near = base.split()
    near[100] = "zzz"
    return [
        None, "", "   ", "One", "one two", base, base, base.upper(), " ".join(near), sentence(40) + "\n" + passage + "\n" + sentence(30),
        passage + " tail " + sentence(10), sentence(3) + "\n\n" + passage, "A" * 1500, "line that repeats often enough\nx\nline  that repeats often enough",
        sentence(9000), "日本語 のテキスト です", "\x00 odd \t white space \U0001f600", passage[:199], sentence(60), "Line that repeats OFTEN enough\n",
    ]


def rows():
    out = [(i, t, ["en", "fr", None][i % 3], "s", 1, "x", "y", 1, 2, "k", 3, 4) for i, t in enumerate(texts())]
    out.append(out[5])  # a repeated row
    out.append((None, "text without an id, long enough to be a unit", None, None, None, None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda x: tuple((v is not None, v) for v in x))


def ordered(values):
    return sorted(values, key=lambda x: tuple((v is not None, v) for v in x))


def brute_lines(docs, min_words):
    """(doc_id, text left, number of units removed) of each (doc_id, text)."""
    lowered = lambda u: "".join(c.lower() if "A" <= c <= "Z" else c for c in u)
    norm = lambda u: re.sub(r"^ | $", "", re.sub(r"[ \t\x0b\f\r]+", " ", lowered(u)))
    words = lambda n: len(n.split(" ")) + sum("\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" for c in n) if n else 0
    first, cut = {}, []
    for doc, text in docs:
        key = (doc is not None, doc or 0, hashlib.md5((text or "").encode()).digest())
        parts = re.split(r"((?<=[.!?]) |\n)", text or "")
        units = list(zip(parts[::2], [*parts[1::2], ""]))
        cut.append((doc, key, units))
        for no, (u, _) in enumerate(units):
            if words(norm(u)) >= min_words:
                first[norm(u)] = min(first.get(norm(u), (key, no)), (key, no))
    out = []
    for doc, key, units in cut:
        kept = [(u, behind) for no, (u, behind) in enumerate(units) if first.get(norm(u), (key, no)) == (key, no)]
        out.append((doc, "".join(u + b for u, b in kept[:-1]) + "".join(u for u, _ in kept[-1:]), len(units) - len(kept)))
    return out


@pytest.mark.parametrize("least", [1, 4, line_dedup.MIN_WORDS])
def test_line_dedup(docs, empty, least):
    got = line_dedup.dedup_lines(docs, least).select("doc_id", "clean_text", F.size("removed").alias("gone"))
    assert table(got, "doc_id", "clean_text", "gone") == ordered(brute_lines([(r[0], r[1]) for r in rows()], least))
    assert line_dedup.dedup_lines(empty, least).count() == 0
    assert {"fp", "raw", "words"} <= set(line_dedup.dedup_lines(docs).columns)


def test_line_dedup_offsets_and_clashing_names(spark):
    texts = [(1, "One two. Three four!  five\nsix"), (2, "x. three  FOUR! One two.\nsix."), (3, None), (4, "six. six")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in texts], "doc_id long, text string, uid int, whole int, unit int, digest int")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert [got[i].clean_text for i in (1, 2, 3, 4)] == ["One two. Three four!  five\nsix", "x. six.", "", ""]
    assert [tuple(x) for x in got[2].removed] == [(1, 3, 12), (2, 16, 8)]
    assert got[2].text[3:15] == "three  FOUR!" and [tuple(x) for x in got[4].removed] == [(0, 0, 4), (1, 5, 3)]
    assert got[1].uid == 1 and got[1].digest == 4 and got[3].n_units == 1


def test_line_dedup_short_units(spark):
    short = spark.createDataFrame([(1, "Read more\n\nx\nbody one"), (2, "read  more\n\nx"), (3, "日本語のテキストです\nx"), (4, "日本語のテキストです")], "doc_id long, text string")
    assert table(line_dedup.dedup_lines(short), "doc_id", "clean_text") == [(1, "Read more\n\nx\nbody one"), (2, ""), (3, "日本語のテキストです"), (4, "")]
    assert table(line_dedup.dedup_lines(short, 3), "doc_id", "clean_text") == [(1, "Read more\n\nx\nbody one"), (2, "read  more\n\nx"), (3, "日本語のテキストです\nx"), (4, "")]


def test_line_dedup_counts_signs_as_its_sql_does(spark, tmp_path):
    import duckdb

    units = ["\u65e5" * n for n in (10, 11, 12)] + ["\ud55c" * 30, "\u0e01" * 40, "\u3042 " * 6, " ".join("abcdefghijk"), " ".join("abcdefghijkl")]
    rows = [(i, unit) for i, unit in enumerate(units + units)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = line_dedup.query(spark, str(tmp_path))
    names = ["doc_id", "n_removed", "spans", "kept_sha256"]
    assert table(got, *names) == sorted(duck.sql(f"SELECT {', '.join(names)} FROM ({line_dedup.SQL})").fetchall())
    assert {r.doc_id for r in got.collect() if r.n_removed} == {9, 10, 13, 15}


def test_line_dedup_catches_passages_and_leaves_clean_documents(spark):
    """Documents that share a run of 50 words with an earlier one lose text, those that share none mostly keep all."""
    docs = [(r.doc_id, r.text) for r in common.table(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").collect()]
    seen, shared, later = {}, set(), set()
    for doc, text in docs:
        words = (text or "").lower().split()
        for i in range(len(words) - 49):
            owner = seen.setdefault(hash(tuple(words[i : i + 50])), doc)
            if owner != doc:
                shared |= {doc, owner}
                later.add(doc)
    gone = {doc for doc, _, n in brute_lines(docs, line_dedup.MIN_WORDS) if n}
    got = {r.doc_id for r in line_dedup.query(spark, "/root/testdata/sf0.01").where("n_removed > 0").collect()}
    assert got == gone
    clean = {doc for doc, _ in docs} - shared
    assert len(later & gone) >= 0.95 * len(later)
    assert len(clean - gone) >= 0.93 * len(clean)


def passages_between_odd_sentences():
    """(documents, passages): passages of 51 to 80 words without a whole unit of 12, each in three documents, and clean documents."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuéÄ") for _ in range(rng.randint(3, 8)))
    passages, docs = [], []
    for n in (51, 52, 60, 80):
        words = [word() + ("." if i % 11 == 10 else "") for i in range(n)]
        passages.append(words)
        for blank in (" ", "\n", "  \t"):
            docs.append(" ".join(word() for _ in range(rng.randint(0, 40))) + " " + blank.join(words).upper() + " " + " ".join(word() for _ in range(rng.randint(0, 40))))
    shared = " ".join(word() for _ in range(25))  # too short to be a passage
    docs += [f"{shared} {word()} {word()}", f"{' '.join(word() for _ in range(60))} {shared}", " ".join(word() for _ in range(5000)), "und " * 70, "und " * 90]
    return docs, passages


@pytest.mark.parametrize("width", [51, 50])
def test_passages_are_found_wherever_sentences_end(spark, width):
    texts, passages = passages_between_odd_sentences()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    by_lines = {r.doc_id for r in line_dedup.dedup_lines(docs, line_dedup.MIN_WORDS).where("size(removed) > 0").collect()}
    assert not by_lines & {i for i in range(12) if i % 3}  # the rule of units finds none of them
    got = {r.doc_id: r for r in line_dedup.dedup_passages(docs, width).collect()}
    split = [t.encode().lower().split() for t in texts]
    size = (width + 1) // 2
    for i, text in enumerate(texts):
        earlier = {tuple(w[k : k + size]) for w in split[:i] for k in range(len(w) - size + 1)}
        gone = {w for r in got[i].removed for w in range(r.word, r.word + r.words)}
        held = {w for k in range(len(split[i]) - size + 1) if tuple(split[i][k : k + size]) in earlier for w in range(k, k + size)}
        assert gone <= held and got[i].n_words == len(split[i])
        assert [x for k, x in enumerate(split[i]) if k not in gone] == got[i].clean_text.encode().lower().split()
        for r in got[i].removed:
            assert text[r.start : r.start + r.length].encode().lower().split() == split[i][r.word : r.word + r.words]
        if i < 12 and i % 3:
            passage = [w.upper().encode().lower() for w in passages[i // 3]]
            at = next(k for k in range(len(split[i])) if split[i][k : k + len(passage)] == passage)
            inside = set(range(at + width // 2, at + len(passage) - width // 2))
            assert gone and (inside <= gone if width % 2 else len(inside - gone) <= len(inside) // size)
        elif i < 16:
            assert not gone and got[i].clean_text == text
    assert [r.words for r in got[16].removed] == [90 - width // 2]  # one text of marks, at every word but the last ones


def test_passages_odd_rows(spark, docs, empty):
    assert line_dedup.dedup_passages(empty).count() == 0
    got = line_dedup.dedup_passages(docs)
    assert {"fp", "raw", "words", "uid"} <= set(got.columns) and got.count() == len(rows())
    found = {(r.doc_id, r.text): r for r in got.collect()}
    assert found[(0, None)].clean_text == "" and found[(0, None)].n_words == 0
    assert found[(1, "")].removed == [] and found[(2, "   ")].clean_text == "   "
    base = {i: found[(i, texts()[i])] for i in (5, 6, 7, 8, 9, 10, 11)}
    assert [bool(base[i].removed) for i in (5, 6, 7, 8, 9, 10, 11)] == [False, True, True, True, False, True, True]  # a repeated row keeps its text
    with pytest.raises(ValueError):
        line_dedup.dedup_passages(docs, 0)


def brute_removed(values, m):
    raws = [(t or "").encode() for t in values]
    seen = Counter(r[i : i + m] for r in raws for i in range(len(r) - m + 1))
    out = []
    for r in raws:
        spans = []
        for i in range(len(r) - m + 1):
            if seen[r[i : i + m]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + m
                else:
                    spans.append([i, i + m])
        kept, at = [], 0
        for b, e in spans:
            kept.append(r[at:b])
            at = e
        out.append((b"".join([*kept, r[at:]]), [tuple(s) for s in spans]))
    return out


@pytest.mark.parametrize(("m", "k", "part"), [(200, 100, 20_000), (200, 100, 2), (24, 9, 3)])
def test_suffix_dedup(docs, empty, m, k, part):
    want = ordered((r[0], clean.hex(), str(spans)) for r, (clean, spans) in zip(rows(), brute_removed([r[1] for r in rows()], m)))
    got = suffix_dedup.dedup(docs, m, k, part).collect()
    assert ordered((r.doc_id, bytes(r.clean).hex(), str([(s.begin, s.end) for s in r.removed])) for r in got) == want
    assert suffix_dedup.dedup(empty).count() == 0


def test_interval_expansion_on_random_strings():
    rng = np.random.default_rng(1)
    side, n = 6, 300
    left, right = rng.integers(0, 2, (n, side)).astype(np.uint8), rng.integers(0, 2, (n, side)).astype(np.uint8)
    n_left, n_right = rng.integers(0, side + 1, n), rng.integers(0, side + 1, n)
    right[np.arange(side)[None] >= n_right[:, None]] = 0  # padded
    group, number = rng.integers(0, 4, n), rng.integers(1, 2, n)
    low, high = suffix_dedup.expand(group, left, right, n_left, n_right, number)
    for i in range(n):
        hits = [t for t in range(side + 1) if t <= n_left[i] and side - t <= n_right[i] and any(
            j != i and group[j] == group[i] and t <= n_left[j] and side - t <= n_right[j] and (left[i, :t] == left[j, :t]).all() and (right[i, : side - t] == right[j, : side - t]).all() for j in range(n))]
        assert (low[i], high[i]) == ((min(hits), max(hits)) if hits else (side + 1, -1))


def test_every_window_holds_an_anchor():
    rng = random.Random(3)
    value = bytes(rng.choice(b"abc") for _ in range(900))
    _, at, _, _ = suffix_dedup.anchors([value, b"", value[100:500]], 50, 20)
    places = set(at[: len(at)].tolist())
    assert all(any(i <= p <= i + 30 for p in places) for i in range(len(value) - 49))


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="ad">Buy now, really.</div><div id="x"><article><h1>Big &amp; small</h1><p>First  paragraph, with <b>bold</b>
text.<p>Second&nbsp;one &#233; here, long enough to count as content.</p><aside>Related, things.</aside><ul><li>point one, of some length.<li>point two, of some length.</ul></article></div>
<div class="comments"><p>Nice article, I agree with it.</p></div><form>Sign up, please.</form><footer>&copy; 2020, all rights.</footer></body></html>"""


def test_html_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "c"), (2, None, None, "c"), (3, "u", "", "c"), (4, "u", "no markup at all", "c"), (5, "u", "<p>open <b>tags <p>only", "c"), (6, "u", "<nav>menu</nav>", "c"), (6, "u", "<nav>menu</nav>", "c")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(pages, "page_id", "url").collect()}
    assert got[1].text == "Big & small\nFirst paragraph, with bold text.\nSecond one é here, long enough to count as content.\npoint one, of some length.\npoint two, of some length."
    assert (got[2].text, got[3].text, got[6].text) == ("", "", "")
    assert got[4].text == "no markup at all"
    assert got[5].text == "open tags\nonly"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.extract(pages.limit(0), "page_id", "url").count() == 0


@pytest.mark.parametrize("attributes", ['title="A hidden gem"', 'data-note="was hidden before"', 'aria-label="Show hidden parts"', 'class="x hidden y"', "aria-hidden=true data-x='hidden'"])
def test_html_values_do_not_hide(attributes):
    body = "".join(f"<p>Paragraph {i} of the article, long enough to count as text.</p>" for i in range(4))
    assert html_text.main_text(f"<body><div {attributes}>{body}</div><p hidden>Not this one, it is hidden.</p><p style='display:none'>Nor this.</p></body>").count("Paragraph") == 4


@pytest.mark.parametrize("tag", ["svg", "select", "object", "noscript"])
def test_html_unclosed_raw_tags_take_linear_time(tag):
    began = time.process_time()
    html_text.blocks(f"<body><p>text</p>{f'<{tag}>x' * 60_000}")
    assert time.process_time() - began < 10


def test_html_names():
    page = '<body class="with-sidebar"><div class="has-sidebar"><article><p>Body text, long enough to count.</p></article></div><article class="comment"><p>I agree, really.</p></article><div hidden>Secret, hidden.</div></body>'
    assert html_text.main_text(page) == "Body text, long enough to count."


@pytest.mark.parametrize("name", ["review", "legal", "search", "header-fixed", "side-by-side", "article-body share"])
def test_html_names_do_not_discard_articles(name):
    body = [f"Sentence {i} of the article, which goes on for a while, and then some more of it." for i in range(6)]
    inner = "".join(f"<p>{x}</p>" for x in body)
    noise = '<nav><a href="/">Home</a></nav><div class="ad">Buy now, really.</div>'
    assert html_text.main_text(f'<body>{noise}<div class="{name}">{inner}</div><footer>(c) us, 2020.</footer></body>') == "\n".join(body)
    assert html_text.main_text(f'<body>{noise}<div>{inner}</div><div class="{name}"><p>Short, one.</p></div></body>') == "\n".join(body)


def test_html_teaser_in_article_does_not_discard_body():
    body = [f"Sentence {i} of the article, which goes on for a while, and then some more of it." for i in range(6)]
    inner = "".join(f"<p>{x}</p>" for x in body)
    got = html_text.main_text(f'<body><div id="x">{inner}</div><article class="card"><p>Other story, read it.</p></article></body>')
    assert got.split("\n")[:6] == body
    got = html_text.main_text(f'<body><div class="review">{inner}</div><article class="card"><p>Other, read it.</p></article></body>')
    assert got.split("\n")[:6] == body
    # most text inside: what is outside still goes
    assert html_text.main_text(f"<body><div><p>Just in, today.</p></div><article>{inner}</article></body>") == "\n".join(body)


BODY = [f"Sentence {i} of the article, which goes on for a while, and then some more of it." for i in range(6)]
AROUND = '<nav><ul><li><a href="/">Home</a><li><a href="/a">About us</a></ul></nav>'


@pytest.mark.parametrize(
    "page",
    [
        "<body><div>{a}</div><div><h1>Title</h1>{b}</div><div>(c) us.</div></body>",  # no article, no names
        '<body>{a}<section class="search"><h1>Title</h1>{b}</section><footer>All rights, ours.</footer></body>',
        '<body>{a}<section id="reviews"><h1>Title</h1>{b}</section><aside>Related, read it.</aside></body>',
        '<body>{a}<article><div class="entry-header"><h1>Title</h1></div>{b}</article><div class="ad">Buy now, really.</div></body>',
        '<body>{a}<main><h1>Title</h1>{b}<div class="comments"><div>I agree, really.</div></div></main></body>',
        '<body>{a}<article class="card"><span>Teaser, short.</span></article><div id="story"><h1>Title</h1>{b}</div></body>',
    ],
)
def test_html_text_by_paths(page):
    got = html_text.main_text(page.format(a=AROUND, b="".join(f"<p>{x}</p>" for x in BODY))).split("\n")
    assert got[:7] == ["Title", *BODY] or got[1:8] == ["Title", *BODY] or [x for x in got if x != "Teaser, short."][:7] == ["Title", *BODY]
    assert not {"Home", "About us", "(c) us.", "All rights, ours.", "I agree, really.", "Buy now, really.", "Related, read it."} & set(got)


def test_html_scores_against_brute_force():
    """Ratios from path strings, and that without the threshold the rest of the page comes too."""
    page = f'<body>{AROUND}<div id="x"><h1>Title</h1>{"".join(f"<p>{x}</p>" for x in BODY)}<p>A <a href="/l">link</a>, it is.</p></div><div><ul><li>one<li>two, three</ul></div></body>'
    tree, found = html_text.blocks(page)
    weights, _ = html_text._weights(tree, found)
    fused, own, bar = html_text.scores(tree, found, weights)
    paths = [tree.path(b.node) for b, _ in found]
    assert paths[:2] == ["body/nav!/ul/li"] * 2 and paths[-1] == "body/div/ul/li" and "body/div/p" in paths
    length, marks = [], []
    for p in paths:
        mine = [(max(len(t) - 2 * b.linked, 0), sum(c in ".,;:!?" for c in t)) for (b, t), q in zip(found, paths) if q == p]
        length.append(sum(m[0] for m in mine) / len(mine))
        marks.append(sum(m[1] for m in mine) / len(mine))
    w = weights.tolist()
    at = lambda x, i: x[min(max(i, 0), len(x) - 1)] * w[min(max(i, 0), len(x) - 1)]
    smooth = lambda x, i: 0.25 * at(x, i - 1) + 0.5 * at(x, i) + 0.25 * at(x, i + 1)
    want = [(smooth(length, i) * (smooth(marks, i) + 0.5)) ** 0.5 * w[i] for i in range(len(paths))]
    assert np.allclose(fused, want)
    assert np.allclose(own, [(at(length, i) * (at(marks, i) + 0.5)) ** 0.5 * w[i] for i in range(len(paths))])
    assert np.isclose(bar, min(0.5 * np.std(want), 0.6 * max(want)))


def test_html_text_needs_the_score(monkeypatch, spark, data):
    htmls = [r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    got = [html_text.main_text(h) for h in htmls]
    monkeypatch.setattr(html_text, "scores", lambda tree, found, weights: (np.ones(len(found)), np.ones(len(found)), 0.0))
    assert all(len(html_text.main_text(h)) > len(g) for h, g in zip(htmls, got))


@pytest.mark.parametrize("piece", ["<div>x", '<div class="ad"><p>x', "<ul><li>x", "<b>x", "<section><article>x. "])
def test_html_deep_pages_take_linear_time(piece):
    import time

    def took(n):
        began = time.process_time()
        html_text.main_text(piece * n)
        return time.process_time() - began

    took(1000)
    assert took(40_000) < 20 * max(took(5_000), 0.05)


def test_html_text_on_pages(spark, data):
    got = html_text.query(spark, data).join(spark.read.parquet(f"{data}/pages.parquet"), "page_id").collect()
    for r in got:
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        import html as h

        want = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*>", " ", b.replace("<b>", "")))).strip() for b in re.split(r"<p>|</p>|<h1>|</h1>", inside)]
        assert r.text == "\n".join(x for x in want if x)


BENCH = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "Short item"), (2, "Short item"), (10, "beta gamma delta epsilon zeta eta theta iota kappa lambda nu"), (3, None), (4, "  "), (None, "epsilon zeta eta"), (5, "un deux trois quatre cinq six")]
PLANTED = [(100, "x y alpha beta, gamma DELTA epsilon zeta eta theta iota kappa lambda nu z"), (101, "a short ITEM; short item short"), (102, "beta gamma delta epsilon zeta eta theta iota kappa"), (103, "un deux trois quatre cinq six sept un deux trois quatre cinq six"), (104, None), (105, "alpha")]


def brute_contamination(documents, bench):
    find = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in bench:
        w = find(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc, text in documents:
        w, hit, items = find(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    items |= windows[tuple(w[i : i + size])]
        names = sorted(str(i) for i in items if i is not None)
        out.append((doc, len(w), len(hit), ",".join(names)))
    return ordered(out)


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST, 0])
def test_decontaminate(spark, docs, empty, limit):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    planted = spark.createDataFrame(PLANTED, "doc_id long, text string")
    both = planted.union(docs.select("doc_id", "text")).withColumns({"words": F.lit(1), "row": F.lit(2), "prints": F.lit("x")})
    got = decontaminate.contamination(both, bench, max_broadcast=limit).withColumn("names", F.array_join("items", ","))
    assert table(got, "doc_id", "n_words", "n_hit", "names") == brute_contamination([*PLANTED, *[(r[0], r[1]) for r in rows()]], BENCH)
    assert decontaminate.contamination(empty, bench).count() == 0
    clean = decontaminate.contamination(both, bench.limit(0))
    assert clean.where("n_hit > 0").count() == 0
    assert clean.count() == both.count()


def test_winnowing_keeps_a_gram_of_every_window(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcde") * rng.randint(1, 2) for _ in range(n)) for n in (0, 1, 4, 5, 9, 10, 11, 40, 300)]
    hashes = F.transform(decontaminate.words_of(F.col("text")), lambda w: F.xxhash64(w))
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", decontaminate._grams(hashes, 5).alias("all"), decontaminate._kept(hashes, 10).alias("kept")).collect()
    for r in got:
        n, kept = len(r.text.split()), [v & decontaminate._PLACE for v in r.kept]
        assert len(r.all) == max(n - 4, 0) and set(r.kept) <= set(r.all)
        assert [v & decontaminate._PLACE for v in r.all] == list(range(len(r.all)))
        assert all(any(s <= p <= s + 5 for p in kept) for s in range(n - 9))
        want = {min(r.all[s : s + 6]) for s in range(n - 9)}
        assert want == set(r.kept) and len(kept) == len(set(kept))
        assert n < 100 or len(kept) < 0.5 * n


def test_decontaminate_keeps_python_out(spark, data):
    plan = decontaminate.query(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_maglev_table():
    shards, size = tuple("abcdefg"), 101
    got = maglev.fill_table(shards, size)
    # brute force: write all preference lists out, then take turns
    lists = [[(maglev._digest(f"offset:{s}") + j * (maglev._digest(f"skip:{s}") % (size - 1) + 1)) % size for j in range(size)] for s in shards]
    want, turn = [-1] * size, 0
    while -1 in want:
        order = lists[turn % len(shards)]
        want[next(x for x in order if want[x] < 0)] = turn % len(shards)
        turn += 1
    assert got == want
    counts = Counter(maglev.fill_table())
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = maglev.fill_table(maglev.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(maglev.fill_table(), fewer)) / maglev.TABLE_SIZE
    assert moved < 0.06
    with pytest.raises(ValueError):
        maglev.fill_table(shards, 100)


def test_maglev_placement(docs, empty):
    got = maglev.place(docs).collect()
    filled = maglev.fill_table()
    assert len(got) == len(rows())
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % maglev.TABLE_SIZE
        assert (r.slot, r.shard) == (slot, maglev.SHARDS[filled[slot]])
    assert maglev.place(empty).count() == 0


def test_maglev_shards_are_written(spark, docs, tmp_path):
    maglev.write_shards(docs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows())


def brute_simhash(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, empty):
    want = []
    prints = [(r[0], brute_simhash(r[1])) for r in rows()]
    for doc, fp in prints:
        reach, front = {fp}, [fp]
        while front:
            x = front.pop()
            more = {y for _, y in prints if bin(x ^ y).count("1") <= 3} - reach
            reach |= more
            front += more
        ids = [i for i, y in prints if y in reach and i is not None]
        want.append((doc, f"{fp:016x}", min(ids) if ids else None))
    assert table(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == ordered(want)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("tile", [4096, 3])
def test_simhash_links_lose_nothing(spark, tile):
    rng = random.Random(8)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    fps = {s for s in seeds} | {s ^ sum(1 << rng.randrange(64) for _ in range(k)) & (2**64 - 1) for s in seeds for k in (1, 2, 3, 4) for _ in range(4)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = dict(table(common.connected_components(simhash.links(df, tile=tile)), "node", "root"))
    for a in signed:
        near = [b for b in signed if bin((a ^ b) & (2**64 - 1)).count("1") <= 3]
        assert len({roots.get(x, x) for x in near}) == 1


def test_packing(docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    inner = Tokenizer.from_file(path)
    want = []
    for r in rows():
        ids = [*inner.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((r[0], piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = packing.pack_documents(docs, path)
    assert table(got, "doc_id", "piece", "start", "length", "ids_crc32") == ordered(want)
    filled = {}
    for r in got.collect():
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(w[3] for w in want)
    assert len(filled) == -(-total // 4096)
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_literal_markers(spark):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    inner = Tokenizer.from_file(path)  # as it comes: markers in a text are tokens
    values = ["a <|endoftext|> b", "a<|endoftext|>b don<|startoftext|>'t", "<|endoftext|><|startoftext|>\n<|endoftext|>", "A <|ENDOFTEXT|> x<|endoftext|", "e<|endoftext|>\u0301 É<|endoftext|>", "<|<|endoftext|>|>", "w <|endoftext|> " * 3000]
    tokenizer = packing.WordTokenizer(path)
    for value, ids in zip(values, tokenizer.ids([v.encode() for v in values])):
        assert np.frombuffer(ids, "<u4").tolist() == inner.encode(value, add_special_tokens=False).ids
    tokenizer.known |= {str(i): b"" for i in range(packing._MEMO + 1)}  # a full memo: new pieces are encoded as they come
    assert np.frombuffer(tokenizer.ids([b"new<|endoftext|>"])[0], "<u4").tolist() == inner.encode("new<|endoftext|>", add_special_tokens=False).ids
    want = []
    for i, value in enumerate(values):
        ids = [*inner.encode(value, add_special_tokens=False).ids, 1]
        want += [(i, at // 4096, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for at in range(0, len(ids), 4096)]
    got = packing.pieces(spark.createDataFrame(list(enumerate(values)), "doc_id long, text string"), path)
    assert table(got, "doc_id", "piece", "start", "length", "ids_crc32") == ordered(want)


def test_packing_ids_of_every_code_point():
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    inner, tokenizer = Tokenizer.from_file(path), packing.WordTokenizer(path)
    odd = [0x558, 0x58B, 0x58C, 0x88F, 0xC5C, 0xCDC, 0x208F, 0x209D, 0xA7CE, 0x130, 0x3A3, 0x345, 0x1C, 0x85]
    points = [*range(0x3000), *odd, *range(0x3000, 0x110000, 37)]
    texts = [f"Hi ab{chr(c)}cd E{chr(c)}\u0301 1{chr(c)}{chr(c)} 'S" for c in points if not 0xD800 <= c <= 0xDFFF]
    for text, ids, want in zip(texts, tokenizer.ids([t.encode() for t in texts]), inner.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text


def test_packing_deals_out_rows_alike(spark):
    same = spark.createDataFrame([(None, 0, 0, 1000, 5, "x")] * 41 + [(None, 0, 0, 96, 5, "y")] * 10, "doc_id long, piece int, start long, length long, ids_crc32 long, salt string")
    got = packing.pack(same).collect()
    assert {r.salt for r in got} == {"x", "y"}
    assert len({(r.sequence_id, r.offset) for r in got}) == 51
    assert len({r.sequence_id for r in got}) == 11


def test_packing_plan_is_whole_and_tight():
    rng = random.Random(4)
    counts = Counter(min(100, max(1, int(rng.expovariate(0.03)))) for _ in range(20_000))
    patterns = packing.plan(counts, 100)
    used = Counter()
    for lengths, times in patterns:
        assert sum(lengths) <= 100
        for x in lengths:
            used[x] += times
    assert used == counts
    bins, least = sum(t for _, t in patterns), -(-sum(k * v for k, v in counts.items()) // 100)
    assert bins <= 1.01 * max(least, sum(v for k, v in counts.items() if k > 50))
    assert packing.plan({}, 10) == []
    # the smallest piece gives way to two that fill the gap
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10) == [([6, 2, 2], 1), ([3], 1)]


def test_edit_prints(spark, docs, empty):
    got = {}
    for r in edit_prints.compare_with_next(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    line = sorted(((r[0] is not None, r[0] or 0), hashlib.md5((r[1] or "").encode()).digest(), r[0], r[1] or "") for r in rows())
    assert sum(map(len, got.values())) == len(line)
    for i, (_, _, doc, text) in enumerate(line):
        follow = line[(i + 1) % len(line)][3]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + follow[:cut]
        marks = edit_prints.fingerprints([text, edited, follow])
        match = [r for r in got[doc] if r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()]
        assert match
        r = match[0]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(text), marks[0], marks[1])
        assert (r.near_edited, r.near_next) == (edit_prints.likeness(marks[0], marks[1]), edit_prints.likeness(marks[0], marks[2]))
    assert edit_prints.compare_with_next(empty).count() == 0


def test_edit_walk_against_brute_force():
    rng = random.Random(2)
    values = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 500))) for _ in range(70)]
    stay = edit_prints._stay()
    for codes, steps in zip(map(edit_prints._codes, values), edit_prints.walk([edit_prints._codes(v) for v in values], [0] * len(values))):
        now = 0
        for code, step in zip(codes, steps):
            assert step == now
            kind = int(edit_prints._mix(np.array([code]))[0]) & (edit_prints.CLASSES - 1)
            now += int(stay[kind, now % edit_prints.PERIOD])


def test_edit_likeness_orders_edits():
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(4000))
    change = lambda n: "".join(rng.choice("xyz") if i in set(rng.sample(range(4000), n)) else c for i, c in enumerate(base))
    other = "".join(rng.choice("abcdefghijklmnop ") for _ in range(4000))
    marks = edit_prints.fingerprints([base, base[:900] + "qq" + base[905:], change(40), other])
    near = [edit_prints.likeness(marks[0], m) for m in marks]
    assert near[0] == 1 and near[1] > 0.8 and 0.5 < near[2] < 1 and near[3] < 0.1


def test_lang_id(spark, data, empty):
    got = lang_id.query(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    held = got.where("held_out and length(text) > 60")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count()
    profiles = lang_id.learn(spark.createDataFrame([("en", "abc abd"), ("fr", "xyz xyw"), ("fr", None)], "lang string, text string"))
    judge = lang_id.Judge(profiles)
    assert judge.predict("abc")[0] == "en" and judge.predict("xy")[0] == "fr"
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (None, "xyz"), (4, "abc" * 50_000)], "doc_id long, text string")
    assert table(lang_id.predict(odd, profiles), "doc_id", "lang_pred") == [(None, "fr"), (1, "und"), (2, "und"), (3, "und"), (4, "en")]
    assert lang_id.predict(empty, profiles).count() == 0
    assert lang_id.predict(odd, {}).where("lang_pred <> 'und'").count() == 0


def test_lang_profile_against_brute_force(spark):
    text = "Über das Öl, das du"
    plain = " über das öl das du "
    counts = Counter()
    for n in (1, 2, 3):
        for i in range(len(plain) - n + 1):
            gram = plain[i : i + n]
            if n > 1 or gram != " ":
                counts[gram] += 1
    code = lambda g: sum((1 if c == " " else ord(c)) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    want = [code(g) for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))]
    assert lang_id.ranked(text).tolist() == want
    assert lang_id.learn(spark.createDataFrame([("de", text)], "lang string, text string"))["de"] == want


def test_quality(spark):
    from pyspark.sql import Row  # noqa: F401

    data = "/root/testdata/sf0.01"
    got = quality.query(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert len(got) > 40
    assert (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean() > 0.95
    assert got.score.between(0, 1).all()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def brute_contexts(texts):
    """Context vectors word by word: row, mean of turned index vectors less the corpus's mean, drawn to zero."""
    index = lambda w: quality.index_vectors(quality.seeds([w]))[0].astype(float)
    sums, seen = np.zeros((quality.ROWS, quality.DIM)), np.zeros(quality.ROWS)
    for text in texts:
        words = (text or "").split()
        for i, w in enumerate(words):
            row = xxhash.xxh64_intdigest(w) % quality.ROWS
            seen[row] += 1
            if i:
                sums[row] += np.roll(index(words[i - 1]), 1)
            if i + 1 < len(words):
                sums[row] += np.roll(index(words[i + 1]), -1)
    mean = sums.sum(0) / max(seen.sum(), 1)
    return (sums - mean * seen[:, None]) / (seen[:, None] + quality.FEW)


def test_quality_contexts_come_from_the_whole_corpus(spark, docs, empty, monkeypatch):
    want = brute_contexts([r[1] for r in rows()])
    assert np.allclose(quality.contexts(docs.repartition(5)), want, atol=1e-5)
    assert not quality.contexts(empty).any()
    texts = ["a b c a a", "x", "", "a c b"] * 3
    for size in (3, 1):  # neighbours across the cuts of a long text count too, memo or not
        monkeypatch.setattr(quality, "_WORDS", size)
        monkeypatch.setattr(quality, "_MEMO", 2)
        counter = quality.ContextCounter()
        counter.add(texts)
        mean = counter.sums.sum(0) / counter.seen.sum()
        assert np.allclose((counter.sums - mean * counter.seen[:, None]) / (counter.seen[:, None] + quality.FEW), brute_contexts(texts), atol=1e-9)


def test_quality_input_against_brute_force(monkeypatch):
    rng = random.Random(9)
    words = [rng.choice(["red", "Blue", "x9", "green", "tea", "ox"]) for _ in range(500)]
    text, context = " ".join(words), brute_contexts([" ".join(words), "red tea ox", "tea red"]).astype(np.float32)
    index = lambda k: quality.index_vectors(quality.seeds([k]))[0]
    row = lambda w: context[xxhash.xxh64_intdigest(w) % quality.ROWS]
    vectors = [row(w) + 0.5 * index(w) + 1.5 * index("s" + quality.shape(w)) + 0.7 * index("e" + w[-3:]) for w in words]
    fit = [row(a) @ np.roll(index(b), -1) for a, b in zip(words, words[1:])]
    like = [index(a) @ index(b) / quality.PICKS for a, b in zip(words, words[1:])]
    want = np.concatenate([np.mean(vectors, 0), np.std(vectors, 0), [np.mean(fit), np.std(fit), np.mean(like), np.log1p(500) / 10]])
    for size, memo in ((1 << 14, 100_000), (499, 3), (64, 100_000), (1, 2)):
        monkeypatch.setattr(quality, "_WORDS", size)
        monkeypatch.setattr(quality, "_MEMO", memo)
        got = quality.Embedder(context).embed(["", "tea", text, "red tea", text, " "])
        assert np.allclose(got[2], want, atol=1e-4) and np.allclose(got[4], want, atol=1e-4)
        assert not got[0].any() and not got[5].any() and got[1].any()
        assert np.allclose(got[3], quality.Embedder(context).embed(["red tea"])[0], atol=1e-5)
    order = lambda t: quality.Embedder(context).embed([t])
    assert not np.allclose(order("red tea ox Blue"), order("red ox tea Blue"))
    assert not np.allclose(quality.Embedder(context).embed(["red tea"]), quality.Embedder(0 * context).embed(["red tea"]))
    assert quality.shape("Abc--D12é!") == "Aa-A0a!"


def test_quality_edges(docs, empty, spark):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (5, 1, None), (6, None, 1), (None, 1, 1), (7, 5, 0), (9, 0, 0), (9, 0, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
    classifier = quality.train(docs, labels)
    got = quality.score(docs, classifier).collect()
    assert len(got) == len(rows())
    assert all(0 <= r.score <= 1 for r in got)
    assert quality.train(docs, labels.limit(0)).network is None
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(empty, classifier).count() == 0
    assert quality.train(empty, labels).network is None
    beside = docs.withColumn("score", quality.score_column(spark, F.col("text"), classifier))
    assert table(beside, "doc_id", "score") == table(quality.score(docs, classifier), "doc_id", "score")


def test_pieces_have_schema(docs):
    assert isinstance(packing.pieces(docs, packing.vocabulary_path()).schema, T.StructType)


@pytest.mark.parametrize("tile", [512, 2])
def test_edit_classes(spark, empty, tile):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijk") for _ in range(5)) for _ in range(300)]
    bases = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (30, 90, 400, 1500)]
    values = [(None, None), (100, "")]
    for i, b in enumerate(bases):
        n = len(b)
        values += [(10 * i + 1, b), (10 * i + 2, b), (10 * i + 3, b[: n - n // 12] + "x" * (n // 12)), (10 * i + 4, b + "y" * (n // 10)), (10 * i + 5, "z" * (n // 2) + b[n // 2 :])]
    docs = spark.createDataFrame(values, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.fingerprint) for r in edit_prints.near_classes(docs, tile=tile).collect()}
    ids = [i for i, _ in values]
    marks = {i: got[i][1] for i in ids}
    for i in ids:
        reach, front = {i}, [i]
        while front:
            x = front.pop()
            more = {j for j in ids if edit_prints.likeness(marks[x], marks[j]) >= 0.8} - reach
            reach |= more
            front += more
        numbers = [j for j in reach if j is not None]
        assert got[i][0] == (min(numbers) if numbers else None)
    assert edit_prints.near_classes(empty).count() == 0


def test_edit_classes_recall_on_the_corpus(spark):
    """Of all pairs of different fingerprints that are alike enough, those that share a class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    edited = F.concat(F.expr("substring(text, 1, int(length(text) / 3))"), F.lit(" edit "), F.expr("substring(text, int(length(text) / 3) + 1, int(length(text) * 0.63))"))
    got = edit_prints.near_classes(docs.union(docs.where("doc_id % 4 = 0").select(F.col("doc_id") + 1_000_000, edited))).collect()
    assert len(got) == 1250
    of = {r.fingerprint: r.class_id for r in got}
    marks = sorted(of, key=lambda m: (m[:2], len(m)))
    sizes = {m: max(len(m) // 2 - 1, 1) << int(m[:2] or "0", 16) for m in marks}
    pairs = found = 0
    for i, a in enumerate(marks):
        for b in marks[i + 1 :]:
            if min(sizes[a], sizes[b]) >= 0.7 * max(sizes[a], sizes[b]) and edit_prints.likeness(a, b) >= edit_prints.LIKE:
                pairs += 1
                found += of[a] == of[b]
    assert pairs >= 100 and found >= 0.95 * pairs, (pairs, found)
