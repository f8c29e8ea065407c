"""Trained operators by held-out accuracy, HTML extraction, components, queries and the pipeline."""

import hashlib
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordwave.llm import linear, quality, queries, site_style, toxicity
from wordwave.llm.components import connected_components

MID = Path("/root/testdata/sf0.1")
SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not MID.exists(), reason="no test tables")


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    rates = [(0.6, 0.05), (0.5, 0.02), (0.4, 0.2)]
    votes = np.stack([np.where(y, rng.random(4000) < a, rng.random(4000) < b) for a, b in rates] + [rng.random(4000) < np.where(y, 0.05, 0.7)], axis=1)
    votes = np.concatenate([votes, votes[:, :1]], axis=1)  # a copy of a voter
    post, accuracy, share = linear.label_model(votes, np.array([1, 1, 1, 0, 1]), 0.3)
    assert ((post > 0.5) == y).mean() > 0.88
    assert accuracy[0] > accuracy[2] and share[0] < 0.7 and share[4] < 0.7 and share[1] > 0.9
    assert len(linear.label_model(np.zeros((0, 2), bool), np.array([1, 0]), 0.3)[0]) == 0


def drawn_votes(rng, n=6000, share=0.15):
    """Votes of the toxicity model's own joint distribution, and the exact posteriors that its true parameters give."""
    signal, noise = np.array([0.7, 0.6, 0.5, 0.4, 0.6, 0.3, 0.0, 0.0]), np.array([1e-5, 1e-5, 3e-5, 2e-5, 1e-5, 1e-5, 2e-4, 1e-4])
    size = rng.integers(20, 2000, n)
    y = rng.random(n) < share
    chance = 1 - np.exp(-noise * size[:, None])
    votes = (rng.random((n, 8)) < chance) | ((rng.random((n, 8)) < signal) & y[:, None])
    odds = np.log(share / (1 - share)) + (votes * np.log(1 + signal * (1 - chance) / chance)).sum(axis=1)
    return votes, size, y, 1 / (1 + np.exp(-odds)), signal


def test_toxicity_label_model_against_exact_posteriors():
    votes, size, y, exact, signal = drawn_votes(np.random.default_rng(5))
    found = toxicity.label_model(votes, np.arange(8), size)
    some = votes.any(axis=1)
    sure = some & (np.abs(exact - 0.5) > 0.2)
    assert ((found["posteriors"] > 0.5) == (exact > 0.5))[sure].mean() > 0.97
    assert abs(found["share"] - y.mean()) < 0.1 and found["posteriors"][~some].max() < 0.05
    assert np.corrcoef(found["signal"], signal)[0, 1] > 0.95 and found["signal"][6:].max() < 0.05
    # voters of one root, and voters whose chance votes are the same, count once
    twice = toxicity.label_model(np.concatenate([votes, votes[:, :1], votes[:, 6:7]], axis=1), np.array([*range(8), 0, 8]), size)
    assert np.abs(twice["posteriors"] - found["posteriors"]).max() < 0.05 and twice["say"][6] < 0.6 and twice["say"][1] == 1
    empty = toxicity.label_model(np.zeros((0, 3), bool), np.arange(3), np.zeros(0))
    assert len(empty["posteriors"]) == 0 and len(toxicity.label_model(np.zeros((4, 0), bool), np.zeros(0), np.ones(4))["posteriors"]) == 4


def test_style_voters_see_whole_texts():
    assert toxicity._patterns("low " * 2000 + "LOUD " * 9000)[:3] == [0, 0, 1] and toxicity._patterns("a b  c")[3] == 3


@needs_data
def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs.where(~held), labels.where(~held))
    got = toxicity.score(docs, model).join(labels.where(held), "doc_id").toPandas()
    rank = got["score"].rank()
    pos = got["toxic"] == 1
    auc = (rank[pos].mean() - (pos.sum() + 1) / 2) / (~pos).sum()
    assert auc > 0.95
    assert ((got["score"] >= 0.5) & ~pos).sum() <= 10 and ((got["score"] >= 0.5) & pos).sum() >= 0.7 * pos.sum()


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "bad " * 40_000, 5), (None, "x", 5), (3, "again", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0


@needs_data
def test_quality_keeps_clean_documents(spark):
    docs, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    got = quality.score(docs, quality.fit(docs)).join(labels, "doc_id").toPandas()
    clean = got["quality"] == 1
    assert got["keep"][clean].mean() > 0.995 and (~got["keep"][~clean]).mean() > 0.9


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, " ", 1), (3, "A fine line of words. " * 20_000, 1), (None, "One more plain sentence here.", 1)], "doc_id long, text string, keep int")
    model = quality.fit(docs)
    got = {r.doc_id: r.keep for r in quality.score(docs, model).collect()}
    assert got[1] is False and got[2] is False and len(got) == 4
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0))).count() == 0


def test_parse_pages():
    text = lambda h, low=frozenset(): site_style.main_text(h, low)
    assert text("<p>a &amp; b<p>c<b>d</b>e<!-- x --> f") == "a & b cde f"
    assert text('<nav>n</nav><header>h</header><article><h1>T</h1><p>x <span class="ad">buy</span> y</p><section id="comments">no</section></article><p>out</p>') == "T x y"
    assert text('<script>var a="</p>";</script><style>p{}</style><form>f</form><div class="cookie-notice">c</div><p>5 < 6 &lt; 7&nbsp;8</p>') == "5 < 6 < 7 8"
    assert text("") == "" and text("<") == "<" and text("<p") == "<p" and text("a<br>b") == "a b"
    assert text("<div><p>k</p></div><div class='x'><p>l</p></div>", {site_style.node_id(0, "div.x")}) == "k"
    assert text("<p title=it's>hello</p><p title='a>b' x=\"c'>d\">e</p>") == "hello e"
    assert text("<p>&am<b>p;</b> &lt;i&gt; &#x41;<i>&copy;</i></p>") == "&amp; <i> A©"
    long = "x" * 60  # labels are compared whole
    assert text(f"<div class={long}a><p>k</p></div><div class={long}b><p>l</p></div>", {site_style.node_id(0, f"div.{long}a")}) == "l"


def test_parse_in_proportion_to_depth():
    import time

    for page in ("<b>" * 20_000 + "<p>x" * 20_000, "<div>" * 20_000 + "x", "<p>a <b>b <i>c" * 20_000, "<table><b>" * 5_000 + "</b>" * 20_000 + "y", "<ul><li>" * 20_000 + "z"):
        began = time.time()
        assert site_style.parse(page)
        assert time.time() - began < 4


def test_style_tree_drops_repeated_branches(spark):
    pages = [(i, f"http://h.example/{i}", f"<body><div class='top'><p>Same line</p><p>Menu {i % 2}</p></div><div class='main'><p>Own text {i} of page</p></div></body>", "c") for i in range(12)]
    pages += [(100, "http://h.example/x", None, "c"), (101, None, "<p>bare</p>", "c"), (None, "http://other/", "<div class='top'><p>kept</p></div>", "c"), (0, *pages[0][1:])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in site_style.extract(df).collect()]
    assert len(got) == len(pages)
    d = dict((i, t) for i, t, _ in got)
    assert d[3] == "Own text 3 of page" and d[100] == "" and d[101] == "bare" and d[None] == "kept"
    assert all(n == len(t) for _, t, n in got)
    assert site_style.extract(df.limit(0)).count() == 0


def test_style_tree_judges_blocks_of_an_article(spark):
    own = lambda i: f"<h1>Title {i}</h1><p>First of {i}.</p><p>Second of {i}.</p>"
    pages = [(i, f"http://h.example/{i}", f"<body><article>{own(i)}<p>Tell your friends</p><div class='after'><p>Letters weekly</p><p>{'Even' if i % 2 else 'Odd'} offer</p></div></article></body>") for i in range(12)]
    pages += [(i, f"http://few.example/{i}", f"<main>{own(i)}<p>Tell your friends</p></main>") for i in range(20, 24)]
    pages += [(i, f"http://part.example/{i}", f"<main>{own(i)}<p>{'Said on some' if i < 34 else f'Third of {i}.'}</p></main>") for i in range(30, 40)]
    got = {r.page_id: r.text for r in site_style.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i} First of {i}. Second of {i}." for i in range(12))
    assert got[20] == "Title 20 First of 20. Second of 20. Tell your friends"
    assert got[30] == "Title 30 First of 30. Second of 30. Said on some"


def test_style_tree_counts_copies_of_a_page_once(spark):
    page = "<body><div><h1>Title</h1><p>Own text</p></div></body>"
    pages = [(i, "http://h.example/", f"<!-- {i} -->{page}") for i in range(8)] + [(i, None, f"<nav>{i}</nav><p>No host</p>") for i in range(10, 18)]
    pages += [(i, "http://four.example/", f"<article><p>Own {i % 4}</p><p>Same</p></article>") for i in range(20, 40)]
    got = {r.page_id: r.text for r in site_style.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: "Title Own text" if i < 10 else "No host" if i < 20 else f"Own {i % 4} Same" for i, *_ in pages}


def test_importance_by_hand(spark):
    rows = spark.createDataFrame([("h", 7, 0, 0)] * 4 + [("h", 7, 1, 5)] * 4 + [("h", 7, 2, 1)] * 4 + [("h", 7, 2, 2)], "host string, node long, kind int, value long")
    got = site_style.importances(rows).collect()[0]
    assert got.pages == 4 and got.importance == pytest.approx(0.9 * (1 - (1 + 0) / 2))


def brute_extract(pages):
    """The style tree over strings, all at once: paths of whole labels, sets of pages, entropies by hand."""
    import math

    made = {}
    for i, url, html in pages:
        blocks = site_style.candidates(html)
        made[i] = (url.split("/")[2], blocks, str([(p[-1:], t) for p, t, _ in blocks]))
    out = {}
    for i, (host, blocks, _) in made.items():
        others = {c: b for h, b, c in made.values() if h == host}  # copies once

        def below(path, b):
            return [t for p, t, _ in b if p[: len(path)] == path]

        def low(path):
            have = [b for b in others.values() if below(path, b)]
            if len(have) < 5:
                return False
            m = len(have)
            texts = {t for b in have for t in below(path, b)}
            spread = [math.log(sum(t in below(path, b) for b in have), m) for t in texts]
            layouts = {}
            for b in have:
                kids = [(p[len(path)] if len(p) > len(path) else 1) for p, _, _ in b if p[: len(path)] == path]
                run = tuple(k for j, k in enumerate(kids) if j == 0 or kids[j - 1] != k)
                layouts[run] = layouts.get(run, 0) + 1
            entropy = -sum(c / m * math.log(c / m, m) for c in layouts.values())
            return 0.9 * (1 - sum(spread) / len(texts)) + 0.1 * entropy < 0.25 - 1e-9

        def same(path, t):
            have = [b for b in others.values() if below(path, b)]
            n, m = sum(any(p == path and x == t for p, x, _ in b) for b in others.values()), len(have)
            return m >= 5 and 2 * n > 5 and 2 * n > m and 1 - math.log(n, m) < 0.25

        out[i] = " ".join(t for p, t, inside in blocks if not any(low(p[:k]) for k in range(max(1, inside), len(p) + 1)) and not same(p, t))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_extraction_matches_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta".split())
    pages = []
    for host in ("a.example", "b.example", "few.example"):
        for i in range(4 if host[0] == "f" else 9):
            own = "".join(f"<p>{word()} {word()} {rng.randrange(99)}</p>" for _ in range(rng.randrange(1, 4)))
            top = f"<div class='top'><p>Site {rng.randrange(2)}</p><ul><li>one<li>two</ul></div>"
            end = f"<section class='end{i}'><p>Read on</p><p>{rng.choice(['A', 'B'])}</p></section>"
            body = f"<article><div>{own}</div>{end}</article>" if host[0] == "b" else f"<div class='body'>{own}</div>{end}"
            pages.append((len(pages), f"http://{host}/{i}", f"<body>{top}{body}</body>"))
    pages.append((99, pages[0][1], pages[0][2]))
    got = {r.page_id: r.text for r in site_style.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = brute_extract(pages)
    assert got == want and any("Read on" not in t for t in got.values())


@needs_data
def test_tree_changes_few_pages_of_the_tables(spark):
    pages = spark.read.parquet(f"{MID}/pages.parquet").toPandas()
    texts = {r.page_id: r.text for r in site_style.extract(spark.read.parquet(f"{MID}/pages.parquet")).collect()}
    changed = sum(texts[i] != site_style.main_text(h or "", set()) for i, h in zip(pages["page_id"], pages["html"], strict=True))
    assert len(texts) == len(pages) and changed < 0.2 * len(pages)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (100, 100), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100
    assert connected_components(edges.limit(0)).count() == 0


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, duck, name):
    from helpers import rows

    assert rows(queries.QUERIES[name](spark, SMALL).toPandas()) == rows(duck.sql(queries.ORACLE_SQL[name]).df())


@needs_data
def test_query_columns(spark):
    spans = {r.doc_id: r for r in queries.op2_pii(spark, SMALL).collect()}
    assert len(spans) == 200 and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in spans.values()) > 0
    from test_llm_text import pii_brute, secrets_brute

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in spans.values():
        assert [s for s in r.spans.split(",") if s and "_crf" not in s] == [f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in pii_brute(texts[r.doc_id])]
        base = [s for s in r.spans.split(",") if s and "_crf" not in s]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [sum(s.startswith(k + ":") for s in base) for k in ("email", "ip", "card", "phone")] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
    for r in queries.op10_secrets(spark, SMALL).collect():
        want = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in secrets_brute(texts[r.doc_id])]
        assert [s for s in r.spans.split(",") if s and s.split(":")[0] in ("assign", "access", "hex")] == want
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        parts = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert [parts.count(k) for k in ("assign", "access", "hex")] == [r.n_assign, r.n_access, r.n_hex]


def mixed(x: int) -> int:
    """The hash finaliser on plain integers."""
    m = (1 << 64) - 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
    return x ^ (x >> 31)


def toxic_codes(text: str) -> set[int]:
    """The toxicity features of a text, word by word."""
    import re
    from collections import Counter

    m = (1 << 64) - 1
    found: Counter = Counter()
    raw = text.encode()
    folded = bytes(b + 32 if 65 <= b <= 90 or (i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E) else b for i, b in enumerate(raw))
    for w in re.findall(rb"[A-Za-z\x80-\xff]+", folded):
        terms = [(mixed((b + 1) * 0x9E3779B97F4A7C15 & m) | 1) * pow(0xD6E8FEB86659FD93, i, 1 << 64) for i, b in enumerate(w)]
        found[mixed(sum(terms) + 99 & m)] += 1
        for n in toxicity.STEMS:
            if len(w) > n:
                found[mixed(sum(terms[:n]) + n & m)] += 1
    mask = (1 << toxicity.BITS) - 1
    total: Counter = Counter()
    for h, c in found.items():
        total[h & mask] += c
    return {2 * f for f in total} | {2 * f + 1 for f, c in total.items() if c >= 2}


@needs_data
def test_toxicity_query_against_brute_force(spark):
    import zlib

    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    model = toxicity.fit(docs.where(remainder != 0), labels.where(remainder != 0).select("doc_id", "toxic"))
    weights = dict(zip(model["codes"].tolist(), model["weights"].tolist(), strict=True))
    got = queries.op5_toxicity(spark, SMALL).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        z = model["bias"] + sum(weights.get(c, 0.0) for c in toxic_codes(texts[r.doc_id]))
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9) and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


@needs_data
def test_quality_query_against_brute_force(spark):
    import re

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.fit(docs)
    rows = docs.collect() + docs.limit(1).collect()

    def kind(b):
        groups = (range(97, 123), range(65, 91), range(48, 58), range(128, 256), b".", b",;:", b"!?", b"*#$%&@^~=_", b"|")
        return next((i for i, g in enumerate(groups) if b in g), 9)

    got = {r.doc_id: r for r in queries.op7_quality(spark, SMALL).collect()}
    for d in rows:
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", d.text or "")]
        shapes: dict[int, int] = {}
        for i, w in enumerate(words):
            kinds = [kind(b) for b in w]
            capitals = kinds.count(1) >= 2 and kinds.count(0) == 0
            shape = ((kinds[0] * 10 + kinds[-1]) * 2 + capitals) * 2 + (i > 0 and words[i - 1] == w)
            shapes[shape] = shapes.get(shape, 0) + 1
        z = model["bias"]
        for shape, n in shapes.items():
            for level in range(1, 1 + sum(n / len(words) > x for x in (0.0, 0.01, 0.05, 0.2, 0.5))):
                z += model["weights"][mixed(shape * 8 + level + 1) % quality.BUCKETS]
        want = 1 - 1 / (1 + np.exp(-z)) if words else 0.0
        assert got[d.doc_id].quality_score == pytest.approx(want, abs=1e-9) and got[d.doc_id].keep == (got[d.doc_id].quality_score >= 0.5)
    twice = quality.score(docs.unionByName(docs), model).groupBy("doc_id").agg(F.countDistinct("quality_score").alias("n"), F.count(F.lit(1)).alias("m")).collect()
    assert all((r.n, r.m) == (1, 2) for r in twice)


def test_quality_label_model_against_exact_posteriors():
    """Where labellers are independent and one-sided, the model's ranking follows the exact posteriors of the joint distribution."""
    rng = np.random.default_rng(8)
    y = rng.random(5000) < 0.25
    rates = np.array([[0.7, 0.02], [0.6, 0.05], [0.5, 0.01], [0.3, 0.03], [0.02, 0.8], [0.05, 0.6]])  # fires if junk, if clean
    votes = rng.random((5000, 6)) < np.where(y[:, None], rates[:, 0], rates[:, 1])
    odds = np.log(0.25 / 0.75) + (votes * np.log(rates[:, 0] / rates[:, 1]) + ~votes * np.log((1 - rates[:, 0]) / (1 - rates[:, 1]))).sum(axis=1)
    post, accuracy, say = linear.label_model(votes, np.array([1, 1, 1, 1, 0, 0]), 0.2, alike=0.5)
    assert np.abs(post - 1 / (1 + np.exp(-odds))).mean() < 0.02 and (say == 1).all() and abs(post.mean() - y.mean()) < 0.03
    true = [y[votes[:, j]].mean() if j < 4 else (~y)[votes[:, j]].mean() for j in range(6)]
    assert np.abs(accuracy - true).max() < 0.03


@needs_data
def test_pipeline_against_its_steps(spark):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline
    from wordwave.llm import decontaminate, pii

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = {r.doc_id for r in quality.score(docs, quality.fit(docs)).where("keep").collect()}
    from test_llm_text import brute_components, greedy_tiles

    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {i for i, _, c in brute_components([(i, texts[i]) for i in sorted(good)], 5, 80) if i == c}
    items = [r.text.lower().split() for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    seeds = {tuple(w[k : k + 5]) for w in items for k in range(len(w) - 4)}

    def leaks(t):
        w = t.lower().split()
        if not any(tuple(w[k : k + 5]) in seeds for k in range(len(w) - 4)):
            return False
        return any(set(map(tuple, zip(*(w[k:] for k in range(5))))) & set(map(tuple, zip(*(x[k:] for k in range(5))))) and greedy_tiles(x, w, 5) >= 0.7 * len(x) for x in items)

    kept = {i for i in kept if not leaks(texts[i])}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) == kept
    clash = corpus_pipeline.add_tokens(spark, docs.limit(3).withColumn("n_tokens", F.lit("x")).withColumn("decoded_ok", F.lit(1)), SMALL)
    assert all(r.n_tokens == len(r.ids) and r.decoded_ok is True for r in clash.collect())
    for r in got.values():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text) and r.decoded_ok and r.n_tokens == len(r.ids)
    assert decontaminate is not None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "tokens"]
