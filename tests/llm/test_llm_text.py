"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import json
import math
import random
import re
import time
import zlib
from itertools import chain

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordwave.llm import chat, decontaminate, jaccard_join, media, pii, secrets, sentencepiece_trie

LONG = "word " * 40_000


def docs(spark, rows):
    """Documents with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, node string, n long, spans string")


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ------------------------------------------------------------- n-gram Jaccard join


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute_components(rows, width, threshold):
    sets = [(i, shingles(t, width)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min(least.get(r, i), i)
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def near_copies(rng, n):
    words = [f"w{k}" for k in range(300)]
    shared = [rng.choice(words) for _ in range(60)]
    rows = []
    for g in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 20, 60, 150]))] + (shared if g % 3 == 0 else [])
        for _ in range(rng.choice([1, 2, 5, 12])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append(" ".join(t))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("width,threshold", [(4, 85), (5, 80)])
def test_components_match_brute_force(spark, width, threshold):
    rows = near_copies(random.Random(width), 30)
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One two"), (1004, "ONE  two"), (1005, LONG), (1006, LONG + "end"), (1007, "é É"), (7, rows[7][1])]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, rows), width=width, threshold=threshold).collect()]
    assert sorted(got) == brute_components(rows, width, threshold)


def test_components_of_blocks(spark, monkeypatch):
    """Signatures with more nodes than a block are compared block by block."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 3)
    rows = near_copies(random.Random(9), 12)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, rows)).collect()]
    assert sorted(got) == brute_components(rows, 4, 85)


def test_partenum_signatures_lose_no_link():
    rng = np.random.default_rng(3)
    for n in (7, 13, 40, 160, 700):
        for _ in range(20):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            drop = int(rng.integers(0, 15 * 2 * n // 185 + 1))
            b = np.concatenate([a[drop // 2 :], rng.integers(0, 2**63, drop - drop // 2).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both) and set(a) != set(b):
                runs = np.concatenate([a, b])
                owner, sig = jaccard_join.signatures(runs, np.array([len(a), len(b)]), np.array([0, len(a)]), 85)
                assert set(sig[owner == 0]) & set(sig[owner == 1])


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(7)
    for n, m in ((30, 34), (900, 1100), (2000, 2300), (9000, 7600)):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n // 2], rng.integers(0, 2**63, m - n // 2).astype(np.uint64)])
        for least in (1024, 4096):
            x, y = jaccard_join._parities(np.concatenate([a, b]), np.array([0, n]), np.array([n, m]), least)
            length = min(len(x), len(y))
            p, q = (jaccard_join._folded(np.frombuffer(z, dtype=np.uint8)[None], length) for z in (x, y))
            found = jaccard_join._apart(p, q)[0]
            assert found <= n + m - 2 * len(np.intersect1d(a, b)) and found > 0
            assert jaccard_join._apart(p, p)[0] == 0


def test_components_of_nothing(spark):
    assert jaccard_join.jaccard_components(docs(spark, [])).count() == 0
    assert jaccard_join.jaccard_components(docs(spark, [(None, "a b c d e"), (None, "a b c d e")])).count() == 2
    kept = jaccard_join.keep_one_of_each(docs(spark, [(2, "a b c d e f"), (1, "A b c d e f"), (3, None), (4, ""), (None, "a b c d e f")]))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 4), (True, 0)] and kept.columns == ["doc_id", "text", "node", "n", "spans"]


# ------------------------------------------------------------- benchmark decontamination


def greedy_tiles(item, text, least):
    """Marks the longest common run of unmarked words, again and again."""
    used_i, used_t, covered = set(), set(), 0
    while True:
        best = (0,)
        for j in range(len(text)):
            for i in range(len(item)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and i + n not in used_i and j + n not in used_t:
                    n += 1
                if n > best[0]:
                    best = (n, j, i)
        if best[0] < least:
            return covered
        n, j, i = best
        used_i |= set(range(i, i + n))
        used_t |= set(range(j, j + n))
        covered += n


def test_fewest_positions_of_a_cover():
    """Of every way to cover an item by tiles, none holds fewer seed positions than is assumed."""
    for n in range(1, 41):
        width = min(5, n)
        need = max(math.ceil(0.7 * n - 1e-9), width)
        # fewest positions of disjoint tiles of at least ``width`` words that cover ``need`` words or more
        fewest = {0: 0}
        for covered in range(1, n + 1):
            ways = [fewest[covered - t] + t - width + 1 for t in range(width, covered + 1) if covered - t in fewest]
            if ways:
                fewest[covered] = min(ways)
        least = min(v for c, v in fewest.items() if c >= need)
        assert decontaminate._droppable(np.array([n]), 5, 0.7)[0] < least


def test_tiles_match_brute_force(spark):
    rng = random.Random(1)
    items = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 12, 30])))) for k in range(6)]
    rows = []
    for d in range(30):
        t = [rng.choice("abcdefgh") for _ in range(40)]
        w = rng.choice(items)[1].split()
        cut = rng.randrange(len(w))
        rows.append((d, " ".join(t[:20] + (w[cut:] + w[:cut] if d % 2 else w) + t[20:])))
    bench = spark.createDataFrame([(k, t, "z") for k, t in items] + [(99, None, "z"), (98, "", "z")], "item_id long, text string, doc_id string")
    rows += [(100, None), (101, ""), (102, LONG)]
    want = set()
    for d, t in rows[:-1]:
        for k, item in items:
            w = item.split()
            n = greedy_tiles(w, (t or "").split(), min(5, len(w)))
            if n >= 0.7 * len(w):
                want.add((d, k, n))
    got = {(r.doc_id, r.item_id, r.matched) for r in decontaminate.contamination(docs(spark, rows), bench).collect()}
    assert got == want
    import wordwave.llm.decontaminate as module

    before, module.BROADCAST_CHARS, module.ITEMS_AT_ONCE = module.BROADCAST_CHARS, 0, 2
    try:
        assert {(r.doc_id, r.item_id, r.matched) for r in module.contamination(docs(spark, rows), bench).collect()} == want
        # one seed that all texts and items hold, repeated documents, an item of common seeds alone
        common = "the same five words here "
        again = [(0, common + rows[0][1]), (0, common + rows[0][1]), (1, common * 8), (2, common + "x y z"), (3, None)]
        hard = spark.createDataFrame([(0, common + items[0][1], "z"), (1, common.strip(), "z"), (2, common * 2, "z")], "item_id long, text string, doc_id string")
        many = [tuple(r) for r in module.contamination(docs(spark, again), hard).collect()]
        module.BROADCAST_CHARS = before
        assert sorted(many) == sorted(tuple(r) for r in module.contamination(docs(spark, again), hard).collect()) and [r[:2] for r in sorted(many)] == [(0, 1), (0, 1), (1, 1), (1, 2), (2, 1)]
    finally:
        module.BROADCAST_CHARS, module.ITEMS_AT_ONCE = before, 500
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0
    assert decontaminate.contamination(docs(spark, rows), bench.limit(0)).count() == 0
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs(spark, rows), bench).collect()} == {d for d, _ in rows} - {d for d, *_ in want}


# ------------------------------------------------------------- personal data


def pii_brute(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_match_brute_force():
    rng = random.Random(2)
    for _ in range(5000):
        t = "".join(rng.choice("@@..0123456789-+ ()ab_%x𝔘") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == pii_brute(t), t


def segmentations(lattice, scores):
    """All (segments with kinds, score) of a window."""
    found = {0: [((), 0.0)]}
    for j in range(1, lattice.n + 1):
        found[j] = list(found[j - 1])
        for x in range(lattice.at[j - 1], lattice.at[j]):
            found[j] += [((*c, (x, k)), t + s) for c, t in found[int(lattice.first[x])] for k, s in enumerate(scores[x].tolist())]
    return found[lattice.n]


def test_semi_markov_decoding_is_exact():
    """The dynamic program finds the best segmentation, the right partition sum and the right posteriors."""
    rng = np.random.default_rng(5)
    text = "call +1 (706) 555-3138 4644 3483 a@b.co"
    weights = rng.normal(size=(len(pii.KINDS), pii.N_FEATURES))
    for run in pii.windows(text):
        lattice = pii.Lattice(text, run, weights)
        every = segmentations(lattice, lattice.scores)
        alpha, beta = lattice.sums(lattice.scores)
        total = np.log(np.exp([t for _, t in every]).sum())
        assert alpha[-1] == pytest.approx(total) and beta[0] == pytest.approx(total)
        best = max(every, key=lambda e: e[1])[0]
        assert tuple(lattice.best(lattice.scores)) == best
        sure = lattice.posteriors(lattice.scores)
        for x, k in best:
            assert sure[x, k] == pytest.approx(sum(np.exp(t - total) for c, t in every if (x, k) in c))


def test_long_windows_are_decoded_whole():
    """Any part of a long window between sure borders is decoded as it would be alone."""
    rng = np.random.default_rng(2)
    weights = rng.normal(size=(len(pii.KINDS), pii.N_FEATURES))
    tokens = [str(rng.integers(0, 10 ** int(rng.integers(1, 18)))) for _ in range(5000)]
    text = " ".join(tokens)
    (run,) = pii.windows(text)
    assert len(run) == 5000
    lattice = pii.Lattice(text, run, weights)
    whole = pii.Lattice(text, run)
    assert np.allclose(whole.features @ weights.T, lattice.scores)
    got = pii.decode(text, weights)
    assert all(a[2] <= b[0] for a, b in zip(got, got[1:]))
    best = [0.0]
    for j in range(1, 5001):
        best.append(max([best[-1]] + [best[int(lattice.first[x])] + lattice.scores[x].max() for x in range(lattice.at[j - 1], lattice.at[j])]))
    assert sum(lattice.scores[x, k] for x, k in lattice.best(lattice.scores)) == pytest.approx(best[-1])


def test_features_see_whole_segments():
    long, short = "a" * 300 + "@example.com", "a@example.com"
    assert (pii.span_features(long, 0, len(long), 1) == pii.span_features(short, 0, len(short), 1)).all()


def test_model_finds_what_the_patterns_miss():
    """On held-out lines: layouts and contacts that the base patterns do not accept."""
    weights = pii.train([])
    hits = wrong = missed = 0
    for text, spans in pii.examples([], seed=99):
        base, added = pii.all_spans(text, weights)
        want = {s for s in spans if s not in base and not any(a < s[2] and b > s[0] for a, _, b in base)}
        hits, wrong, missed = hits + len(want & set(added)), wrong + len(set(added) - want), missed + len(want - set(added))
    assert hits > 600 and wrong <= 0.01 * hits and hits > 1.5 * missed
    found = lambda t: [(pii.KINDS[k], t[a:b]) for a, k, b in pii.all_spans(t, weights)[1]]
    assert found("rg +1 (826) 555-4081 190.137.223.204 du") == [("phone", "+1 (826) 555-4081")]
    assert found("number 4111 1111 1111 1112 of 2019, version 2.0.1") == []


def test_personal_data(spark):
    texts = ["mail a.b@c.de now", "ip 10.0.0.1 or 999.1.1.1", "tel +49 (30) 1234-5678 x", "card 4111 1111 1111 1111", "", None, LONG, "1" * 50_000, "@" * 5_000 + " a@b.c"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "x@y.zz")]
    weights = pii.train([t for t in texts[:4]] * 3)
    got = pii.personal_data(docs(spark, rows), weights).collect()
    assert len(got) == len(rows)
    for r in got:
        t = "x@y.zz" if r.doc_id is None else texts[r.doc_id] or ""
        assert [tuple(x) for x in r.base] == pii_brute(t)
        assert all(b["start"] >= a["end"] or b["end"] <= a["start"] for a in r.base for b in r.added)
    masked = collected(pii.redact(docs(spark, rows), weights))
    assert masked[0].text == "mail [EMAIL] now" and masked[5].text is None and masked[0].spans == "y"
    assert pii.personal_data(docs(spark, []), weights).count() == 0


# ------------------------------------------------------------- chat


@pytest.mark.parametrize("seed", range(3))
def test_chat_round_trip(seed):
    rng = random.Random(seed)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", " [/INST]", "[INST] ", "\\", "\n", "[", "<", "a", "𝔘", ""]
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "system", "", "a\nb\\n"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 5))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_layouts(spark):
    records = [
        '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}],"id":3}',
        '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}',
        '{"instruction":"a","output":"b"}',
        '{"prompt":"a","response":"b"}',
        '{"question":"a","answer":"b"}',
        '{"prompt":"a","completion":"b"}',
    ]
    odd = [None, "", "[1]", '{"x":1}', '{"messages":[]}', '{"messages[]":{"role":"a","content":"b"}}', '{"prompt":' * 5000 + "1" + "}" * 5000]
    df = spark.createDataFrame([(i, r, "c") for i, r in enumerate(records + odd)], "conv_id long, record string, layout string")
    got = collected(chat.format_records(df), "conv_id")
    assert {got[i].formatted for i in range(6)} == {"<s>[INST] user\na [/INST]b</s>"}
    assert len({got[i].layout for i in range(6)}) == 6
    assert all(got[6 + k].formatted is None for k in range(len(odd)))
    mixed = [
        '{"messages":[{"role":5,"content":"a"},{"role":["x"],"content":{"y":1}}]}',
        '{"messages":[{"role":"c","text":"3","turn":null},{"role":"b","text":"2","turn":"z"},{"role":"d","text":"4","turn":[1]},{"role":"a","text":"1","turn":2},{"role":"e","text":"0","turn":NaN}]}',
        '{"conversations":[{"from":["human"],"value":null},{"from":7,"value":true}]}',
    ]
    turns = [chat.parse(chat.render(chat.canonical_turns(json.loads(r))[1])[0]) for r in mixed]
    assert turns[0] == [("5", "a"), ('["x"]', '{"y": 1}')]
    assert [t for _, t in turns[1]] == ["1", "2", "0", "4", "3"] and turns[2] == [('["human"]', ""), ("7", "true")]
    assert chat.format_records(df.limit(0)).count() == 0


def test_conversations(spark):
    rows = [(1, 2, "assistant", None), (1, 1, "user", "hi [INST]"), (1, 1, "user", "hi [INST]"), (2, None, None, ""), (None, 1, "assistant", LONG)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, record string")
    got = collected(chat.read_back(chat.format_records(chat.conversation_records(df))), "conv_id")
    assert got[1].n_turns == 3 and got[1].loss_chars == 0
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nhi [INST]\nuser\nhi [INST]\nassistant\n\n").hexdigest()
    assert got[2].n_turns == 1 and got[None].loss_chars == len(LONG)


# ------------------------------------------------------------- SentencePiece

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_pieces_match_the_library(spark):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(6)
    texts = ["  Hello   world\n\tfoo 日本 𝔘 ▁x ", "", " ", "a\0b <s> </s> <unk> <0x0A>", "x" * 3000, "▁▁▁", "ﬁ ½ é"]
    texts += ["".join(rng.choice(" \nabetnoshri  éñ日𝔘.,=<>▁") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [*enumerate(texts), (5000, None), (0, texts[0]), (None, "null id")]
    with open(MODEL, "rb") as f:
        model = f.read()
    got = sentencepiece_trie.encode_decode(docs(spark, rows), model, keep=("node", "n")).collect()
    assert len(got) == len(rows)
    for r in got:
        t = "null id" if r.doc_id is None else (texts[r.doc_id] if r.doc_id < 5000 else "")
        assert r.ids == library.encode(t) and r.decoded_ok and r.n_tokens == len(r.ids) and r.node == "x"
    assert sentencepiece_trie.encode_decode(docs(spark, []), model).count() == 0
    clash = docs(spark, rows[:3]).selectExpr("doc_id", "text", "n n_tokens", "node ids", "true decoded_ok", "spans")
    kept = sentencepiece_trie.encode_decode(clash, model, keep=tuple(clash.columns))
    assert kept.columns == ["doc_id", "text", "spans", "n_tokens", "ids", "decoded_ok"] and [len(r.ids) == r.n_tokens for r in kept.collect()] == [True] * 3
    m = sentencepiece_trie.Model(model)
    for t in texts[:80]:
        assert m.decode(library.encode(t)) == library.decode(library.encode(t))


def test_long_runs_of_marks():
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as f:
        m = sentencepiece_trie.Model(f.read())
    for text in (" " * 1000, " " * 37 + "hello" + " " * 400, "a" + "  " * 333 + "b"):
        assert list(chain.from_iterable(m.encode_words([w])[w] for w in m.units(text))) == library.encode(text)
    began = time.time()
    (word,) = m.units(" " * 100_000)
    assert len(m.encode_words([word])[word]) < 20_000 and time.time() - began < 10


def test_unigram_viterbi_is_best():
    m = sentencepiece_trie.Model.__new__(sentencepiece_trie.Model)
    m.pieces = ["<unk>", "▁", "a", "b", "ab", "ba", "▁a", "aba"]
    m.scores = [0.0, -2.0, -3.0, -3.0, -3.5, -3.4, -4.0, -6.0]
    m.kinds, m.bpe = [2] + [1] * 7, False
    m.vocabulary = {p: i for i, p in enumerate(m.pieces) if i}
    m.bytes_, m.unknown, m._accepts = {}, 0, {}
    m.ending = {}
    for p in m.vocabulary:
        m.ending.setdefault(p[-3:], set()).add(len(p))
    m.ending = {k: tuple(sorted(v | {n for n in (1, 2) if n < len(k) and k[-n:] in m.ending}, reverse=True)) for k, v in m.ending.items()}

    def best(w):
        if not w:
            return 0.0
        return max((m.scores[i] + best(w[len(p) :]) for p, i in m.vocabulary.items() if w.startswith(p)), default=-1e9)

    words = ["▁ab", "▁abab", "▁ababa", "▁baab", "abba"]
    for w, ids in m.encode_words(words).items():
        assert sum(m.scores[i] for i in ids) == pytest.approx(best(w)) and "".join(m.pieces[i] for i in ids) == w


# ------------------------------------------------------------- media


def test_media(spark):
    texts = ["", "a", "é" * 40, "x" * 64, "y" * 5000, LONG]
    rows = [*enumerate(texts), (50, None), (1, "a"), (None, "z")]
    got = media.media_features(media.with_media(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = ("z" if r.doc_id is None else "" if r.doc_id == 50 else texts[r.doc_id]).encode()
        padded = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        stored = media.write_media(padded)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.codec == "raw" and r.duration_s == len(padded) / 8000 and r.n_frames == len(padded) // 64
        for k, key in enumerate(r.keyframes):
            at = k * media.KEYFRAME_EVERY * 64
            assert stored[key["begin"] : key["end"]] == padded[at : at + 64]
    assert media.media_features(media.with_media(docs(spark, []))).count() == 0
    with pytest.raises(ValueError):
        list(media.walk(memoryview(b"\0\0\0\x20moov"), 0, 8))


# ------------------------------------------------------------- secrets


def secrets_brute(t):
    out = []
    for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[1]) >= 12:
            out.append((m.start(), 0, m.end()))
    for k, p, n in ((1, r"AKIA[A-Z0-9]+", 18), (2, r"[0-9a-f]+", 16)):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t) if len(m[0]) >= n]
    return sorted(out)


def test_secret_base_spans(spark):
    rng = random.Random(8)
    bits = ["password", "Token", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCD1234EFGH56", "deadbeef", "0123abcd", "xyz.QQ", "𝔘", "\n", "secret"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["", "x deadbeefdeadbeef " * 700]
    rows = [*enumerate(texts), (9000, None), (0, texts[0]), (None, "token=abcdefghijklmnop")]
    got = secrets.secret_spans(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = "token=abcdefghijklmnop" if r.doc_id is None else texts[r.doc_id] if r.doc_id < 9000 else ""
        assert [tuple(x) for x in r.base] == secrets_brute(t), t
    assert secrets.secret_spans(docs(spark, [])).count() == 0


def linked_brute(own, scope):
    """Parts (start, kind, end) with the nearest part of every other role in scope, where their complements are there."""
    out = []
    for p in own:
        near = {}
        for q in own:
            gap = max(q[0] - p[2], p[0] - q[2], 0)
            r = secrets.ROLES[q[1]]
            if r != secrets.ROLES[p[1]] and gap <= scope:
                near[r] = min(near.get(r, (gap, *q)), (gap, *q))
        need = {"identifier": "secret" in near, "secret": bool(near), "endpoint": len(near) == 2}
        if need[secrets.ROLES[p[1]]]:
            out.append((*p, *(near.get(r) for r in ("identifier", "secret", "endpoint"))))
    return sorted(out, key=str)


def test_weak_parts_need_complements(spark):
    far = " word" * 200
    rows = [
        (1, "see https://a.example.com/x only"),
        (2, "username: bob77 https://a.example.com/x password=short77"),
        (3, "username: bob77" + far + " password=short77"),
        (4, "username: bob77 token=abcdefghijkl99"),
        (5, "tail Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9 alone"),
        (6, "login: bob77 " + "aB3/" * 50 + "=="),
        (7, "username: bob77 https://a.example.com/" + "x" * 900 + " key Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9"),
    ]
    got = collected(secrets.secret_spans(docs(spark, rows)))
    names = {i: sorted(secrets.KINDS[s["kind"]] for s in r.linked) for i, r in got.items()}
    # of 7, the endpoint's end is near the secret, its start near the identifier; these two are far apart
    assert names == {1: [], 2: ["endpoint", "key_id", "weak_secret"], 3: [], 4: ["key_id"], 5: [], 6: ["key_id", "weak_secret"], 7: ["endpoint", "weak_secret"]}
    assert {(s["start"], s["end"]) for s in got[6].linked} == {(0, 12), (13, 215)}
    assert [(x["kind"], x["identifier"] and x["identifier"]["kind"], x["secret"] and x["secret"]["kind"]) for x in got[4].links] == [(3, None, 0), (0, 3, None)]


def test_links_match_brute_force(spark):
    rng = random.Random(4)
    for scope in (9, 90):
        texts = {}
        for key in range(6):
            at, own = 0, []
            for _ in range(rng.choice([1, 5, 60])):
                at += rng.choice([1, 7, 30, 300])
                own.append((at, rng.randrange(6), at + rng.choice([5, 20, 400])))
            texts[key] = own
        parts = spark.createDataFrame([(k, -k, *p) for k, own in texts.items() for p in own], "key long, key2 long, start long, kind int, end long")
        got = {}
        for r in secrets.linked_parts(parts, scope).collect():
            got.setdefault(r.key, []).append((r.start, r.kind, r.end, *(x and tuple(x) for x in (r.identifier, r.secret, r.endpoint))))
        assert {k: sorted(v, key=str) for k, v in got.items()} == {k: v for k, own in texts.items() if (v := linked_brute(own, scope))}


def test_secrets_stay_in_the_jvm(spark):
    plan = secrets.base_and_weak(docs(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert F is not None
