"""HTML extraction on hand-made and table pages; the pipeline against brute force."""

from __future__ import annotations

import html
import itertools
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from orderlens.llm import html_blocks, queries, secret_scan
from orderlens.llm.tokens import load_tokenizer
from test_similarity import brute_components, edits, plain_simhash, roots_of, word_edits
from test_text_rules import brute_clean
from orderlens.llm import line_cleaning

SF = "/root/testdata/sf0.001"
P = "It took the town three years to build the new library, which opens its doors on Monday."

PAGES = [
    (1, None, ""),
    (2, "", ""),
    (3, "<html><body></body></html>", ""),
    (4, f"<body><nav><a href=/>Home</a></nav><article><h1>Library</h1><p>{P}</p><p>Yes.</p></article><footer>&copy; us</footer>",
     f"Library {P} Yes."),
    (5, f"<main><p>A&amp;B &lt;i&gt; caf&eacute; &#8364;&nbsp;5\n\n x</p><script>var a='<p>no</p>';</script><p>{P}<br>next <b>bo</b>ld</p></main>",
     f"A&B <i> café € 5 x {P} next bold"),
    (6, f'<div class="sidebar"><p>{P}</p></div><div class="content"><p>{P}</p><p>{P}</p></div><div id="comments"><p>{P}</p></div>',
     f"{P} {P}"),
    (7, f"<head><title>no</title><style>p{{}}</style></head><body><!-- <p>no</p> --><article><p>{P}<p>{P} 2 < 3 > 1</article><form><p>{P}</p><select><option>no</select></form>",
     f"{P} {P} 2 < 3 > 1"),
    (8, f"<header><p>{P}</p></header><article><header><h1>Head line</h1></header><p>{P}</p><aside><p>{P}</p></aside></article>",
     f"Head line {P}"),
    (9, f'<div class="cookie-notice">{P}</div><article><p>{P}</p><div class="ad">{P}</div><p>{P}</p></article>', f"{P} {P}"),
    (9, f'<div class="cookie-notice">{P}</div><article><p>{P}</p><div class="ad">{P}</div><p>{P}</p></article>', f"{P} {P}"),
    (10, "<p " * 3000 + ">", ""),
    (11, "<article>" + f"<p>{P}</p>" * 3000, " ".join([P] * 3000)),
]


def test_extraction_of_handmade_pages(spark):
    df = spark.createDataFrame([(i, "u", h, "x") for i, h, _ in PAGES], "page_id long, url string, html string, blocks string")
    got = sorted((r.page_id, r.text) for r in html_blocks.extract_text(df).collect())
    want = sorted((i, t) for i, _, t in PAGES)
    for g, w in zip(got, want):
        if w[0] != 10:
            assert g == w
    assert len(got) == len(want)
    assert html_blocks.extract_text(df.limit(0)).collect() == []


@pytest.mark.parametrize("page, texts", [
    ("<article><p>Before.</p><button>Go<p>The rest.</p></article>", ["Before.", "The rest."]),
    ("<button>Go <p>one</p> <button>x</button> two", ["one", "two"]),
    ("<p>x <object>no <object>no</object> no</object> y</p>", ["x y"]),
    ("<p>A <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>a+b</annotation></math> sum.</p>", ["A a+b sum."]),
    ("<head><title>no</title><p>Text", ["Text"]),
    ("<p>a<script>no <p>no", ["a"]),
    ("<p>a <b title='x>y'>bold</b> 1 < 2 <!-- no --> e", ["a bold 1 < 2 e"]),
])
def test_open_elements_cost_only_themselves(page, texts):
    assert [t for t, _ in html_blocks.text_blocks(page)] == texts


def test_an_open_paragraph_ends_at_the_next():
    foreign = [f[-1] for _, f in html_blocks.text_blocks("<p class=notice>Ad<p>Text<ul><li class=ad>Ad<li>Item</ul>")]
    assert foreign == [1.0, 0.0, 1.0, 0.0]


@pytest.mark.parametrize("piece", [
    "<a ", "<![CDATA[", "<!", "<div>a", "<div></x>", "<button>", "<button ", '<a "x>"', '<a "<a \'', "<head>", "<p class=notice>x",
    ' "<a"', '<a "<a" ">" ', "&", "</script ", "<p class  ",
])
def test_pages_of_one_megabyte_end(piece):
    start = time.perf_counter()
    for page in (piece * (1_000_000 // len(piece)), "<button" + piece * (1_000_000 // len(piece)) + ">"):
        html_blocks.text_blocks(page)
    assert time.perf_counter() - start < 30


def test_held_out_accuracy_of_the_tree(spark):
    """Leave one labelled page out: blocks of unseen pages are classified right."""
    right = total = 0
    pages = html_blocks._LABELLED_PAGES
    for k in (0, 3, 5, 7, 10, 14, 17):
        train, test = [], []
        for j, page in enumerate(pages):
            feats = [f for _, f in html_blocks.text_blocks("".join(h for _, h in page))]
            labels = [y for y, h in page for _ in html_blocks.text_blocks(h)]
            (test if j == k else train).extend(zip(feats, map(float, labels)))
        tree = html_blocks.fit_tree(spark, train)
        df = spark.createDataFrame([(f, y) for f, y in test], "f array<double>, y double")
        for r in df.selectExpr(f"{tree.replace('b.f', 'f')} AS p", "y").collect():
            right += r.p == (r.y == 1.0)
            total += 1
    assert right / total >= 0.85


def article(page):
    """Main text of the table's pages by their one template."""
    inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    inner = re.sub(r"<(?:p|/p|h1|/h1|br|li|/li|ul|/ul|div[^>]*|/div)>", "\n", inner)
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "", inner)).split())


def test_op6_equals_template(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op6_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id]) and r.n_chars == len(r.text)


def brute_pipeline(docs):
    """(id, text) of the pipeline's documents before packing, by plain loops."""
    kept = []
    for i, t in docs:
        if brute_clean(t)[-1]:
            lines = kept_lines(t)
            kept.append((i, "\n".join(lines)))
    lines = [(i, n, x.strip(" \t\x0b\x0c\r")) for i, t in kept for n, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    texts = sorted({x[2] for x in lines})
    by_len = {}
    for x in texts:
        by_len.setdefault(len(x), []).append(x)
    pairs = []
    for x in texts:
        if len(x) >= 20:
            for m in range(len(x), len(x) + 3):
                for y in by_len.get(m, []):
                    # a cheap bound first: edits change the character counts by two at most
                    if (x < y or m > len(x)) and bag(x, y) <= 4 and edits(x, y) <= 2:
                        pairs.append((x, y))
    cut = {x: re.sub(r"([\u2e80-\U0010ffff])", r"\1 ", x).split(" ") for x in texts}
    wordy = [(x, cut[x], set(cut[x])) for x in texts if len(cut[x]) >= 19]
    for k, (x, v, vs) in enumerate(wordy):
        for y, w, ws in wordy[k + 1 :]:
            limit = (min(len(v), len(w)) - 9) // 10
            # a changed word takes one out of a line at most
            if abs(len(v) - len(w)) <= limit and len(vs - ws) <= limit and len(ws - vs) <= limit and word_edits(v, w) <= limit:
                pairs.append((x, y))
    root = roots_of(texts, pairs)
    first = {}
    for i, n, x in lines:
        first[root[x]] = min(first.get(root[x], (i, n)), (i, n))
    drop = {(i, n) for i, n, x in lines if first[root[x]] != (i, n) and len(x.split()) >= 3}
    kept = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in drop)) for i, t in kept]
    fps = {i: plain_simhash(t) for i, t in kept}
    comp = brute_components(fps.values(), 4)
    low = {}
    for i, f in fps.items():
        low[comp[f]] = min(low.get(comp[f], i), i)
    return [(i, secret_scan.redact(t, secret_scan.find_spans(t)[1])) for i, t in kept if low[comp[fps[i]]] == i]


def bag(x, y):
    from collections import Counter

    a, b = Counter(x), Counter(y)
    return sum(((a - b) + (b - a)).values())


def short_line(x):
    return 0 < len(re.findall(line_cleaning.WORD, x)) <= 3 and not re.search(line_cleaning.SENTENCE_END.replace("$", r"\Z"), x)


def kept_lines(text):
    out = []
    for short, run in itertools.groupby(text.split("\n"), short_line):
        run = list(run)
        out += [x for x in run if not (short and len(run) >= 3) and not line_fails(x)]
    return out


def line_fails(x):
    n = len(re.findall(line_cleaning.WORD, x))
    seps = len(re.findall(line_cleaning.SEPARATORS, x))
    return n > 0 and (
        2 * len(re.findall(line_cleaning.MARKS, x)) > n
        or (seps >= 2 and 4 * seps >= n)
        or (n <= 25 and bool(re.search(line_cleaning.BOILERPLATE, x)))
    )


def test_pipeline_equals_brute_force(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = dict(brute_pipeline(docs))
    tok = load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, SF).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == want.keys()
    for i, t in want.items():
        ids = np.concatenate([np.frombuffer(bytes(p.ids), "<u4") for p in sorted(pieces[i], key=lambda p: p.start)])
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_survive_odd_rows(spark, name, tmp_path):
    stage = dict(corpus_pipeline.STAGES)[name]
    long = "A very long line of words that goes on. " * 3000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", len(long)), (3, long, "en", "s", len(long)),
            (None, "Ten words are in this text, so that it stays here.", None, "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, df, SF)
    if name != "packing":
        assert out.columns == df.columns
    out.collect()
    assert stage(spark, df.limit(0), SF).collect() == []


def test_pipeline_drops_nothing_clean(spark, tmp_path):
    """Clean documents with text of their own reach the packed output."""
    rng = np.random.default_rng(2)
    words = [f"word{k}" for k in range(400)]
    clean = [(i, ". ".join(" ".join(rng.choice(words, 9)).capitalize() for _ in range(12)) + ".") for i in range(60)]
    rows = clean + [(100 + i, t) for i, t in clean[:20]] + [(200, "password = hunter2hunter2 " + clean[5][1][::-1])]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert {i for i, _ in clean} <= ids
    for r in out:
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) >= 0
