"""Personal data by a semi-Markov conditional random field.

Base patterns give the spans that are always reported.  Around them, a
semi-Markov CRF (Sarawagi and Cohen 2004) scores whole candidate segments of up
to ``MAX_TOKENS`` tokens with span features, and a bounded-entity dynamic
program chooses boundaries and types together.  Its weights are trained here,
on the windows of a bounded sample and on lines made of entities in layouts
that the patterns do not accept; at run time it adds such segments: addresses
with spelled-out marks, other separators, numbers that touch other numbers.
"""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, hash_sample, release_worker_state, session_for

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 7  # tokens of an entity, at most
SAMPLE_ROWS = 400  # texts that the weights are trained on, at most
SAMPLE_TOKENS = 20_000  # tokens of their windows, at most
MIN_POSTERIOR = 0.9  # of a segment that is added

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is entered at its first digit: from a later one the outcome is the same
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_SPACE = re.compile(r"\s")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            end = max(end, at + 1)
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    out.sort()
    return out


_EDGE = ".,;:!?\"'<>[]{}|*#$%&"
_AT = re.compile(r"@|[\[({<]\s?at\s?[\])}>]", re.I)
_DOT = re.compile(r"[\[({<]\s?dot\s?[\])}>]", re.I)
_MARK = re.compile(r"[0-9@]|[\[({<]\s?(?:at|dot)\s?[\])}>]", re.I)


def windows(text: str):
    """Runs of tokens that can be part of an entity, as (start, end) lists.

    These are tokens with a digit or @, and spelled-out marks such as ``(at)``
    with the token on either side.  Other tokens can be no part of a segment,
    so the dynamic program splits at them without loss.
    """
    run: list[tuple[int, int]] = []
    at = 0

    def begin_of(x, least):
        while x > least and not text[x - 1].isspace():
            x -= 1
        return x

    def end_of(x):
        space = _SPACE.search(text, x)
        return space.start() if space else len(text)

    while m := _MARK.search(text, at):
        tokens = [(begin_of(m.start(), at), end_of(m.end()))]
        if m[0][0] not in "0123456789@":
            before = len(text[at : tokens[0][0]].rstrip()) + at
            if before > at:
                tokens.insert(0, (begin_of(before, at), before))
            after = _WORD.search(text, tokens[-1][1])
            if after:
                tokens.append((after.start(), end_of(after.start())))
        if run and text[run[-1][1] : tokens[0][0]].strip():
            yield run
            run = []
        run += tokens
        at = tokens[-1][1]
    if run:
        yield run


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without punctuation at its ends and without a bracket whose partner lies outside; spelled-out marks stay."""
    while start < end:
        if text[start] in _EDGE and not _DOT.match(text, start) and not _AT.match(text, start):
            start += 1
        elif text[end - 1] in _EDGE and not (text[end - 1] in "]}>" and _MARK_END.search(text, max(start, end - 8), end)):
            end -= 1
        elif text[start] == "(" and text.count("(", start, end) > text.count(")", start, end):
            start += 1
        elif text[end - 1] == ")" and text.count(")", start, end) > text.count("(", start, end):
            end -= 1
        else:
            break
    return start, end


_WORD = re.compile(r"\S")
_MARK_END = re.compile(r"[\[({<]\s?(?:at|dot)\s?[\])}>]\Z", re.I)
_CUES = tuple(
    re.compile(rf"(?<![A-Za-z])(?:{words})\W{{0,3}}(?:\w{{1,4}}\W{{1,3}})?\Z", re.I)
    for words in ("e-?mail|mail|contact|write to", "ip|host|address|server", "card|visa|mastercard|amex|credit|account|pan", "tel|telephone|phone|call|mobile|fax|cell|whatsapp", "version|license|v|nr|no|page|order|invoice|year|id")
)
_GROUPS = re.compile(r"[0-9]+")
_NOT_NUMBER = re.compile(r"[^0-9().+/\x20-]")
_DOMAIN_END = re.compile(r"(?:\.|[\[({<]\s?dot\s?[\])}>]\s?)[A-Za-z]{2,12}\Z", re.I)
_DIGIT_STEPS = (1, 7, 9, 10, 11, 13, 14, 16, 17, 20)
N_FEATURES = 1 + MAX_TOKENS + len(_DIGIT_STEPS) + 5 + 27


def span_features(text: str, start: int, end: int, tokens: int) -> np.ndarray:
    """Features of a whole candidate segment and the words before it; none is one of the base patterns."""
    s = text[start:end]
    groups = _GROUPS.findall(s) if end - start < 4096 else [g[0] for g in _GROUPS.finditer(s)]
    sizes = [len(g) for g in groups]
    n = sum(sizes)
    f = np.zeros(N_FEATURES)
    f[0] = 1
    f[min(tokens, MAX_TOKENS)] = 1
    k = 1 + MAX_TOKENS
    for step in _DIGIT_STEPS:
        f[k] = n >= step
        k += 1
    before = text[max(0, start - 24) : start]
    for cue in _CUES:
        f[k] = bool(before) and cue.search(before) is not None
        k += 1
    ats = len(_AT.findall(s))
    plain = _NOT_NUMBER.search(s) is None
    domain = ats > 0 and _DOMAIN_END.search(s) is not None
    four = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    dots = plain and not any(c in s for c in " ()+/-")
    sums = 13 <= n <= 19 and luhn("".join(groups))
    rest = [
        ats == 1,
        ats > 1,
        _DOT.search(s) is not None,
        domain,
        ats == 1 and domain and not _AT.match(s),
        ats == 1 and not domain,
        plain,
        s[:1] == "+",
        s[:1] == "(",
        s[1:].count("+") > 0,
        s.count("(") != s.count(")"),
        four,
        four and dots,
        len(groups) == 4 and not four,
        sums,
        13 <= n <= 19 and not sums,
        sums and plain and s[:1] not in "+(",
        len(groups) == 1,
        sizes[-2:] == [3, 4],
        s[:1] == "+" and 10 <= n <= 15 and plain and not four,
        plain and 10 <= n <= 11 and len(groups) >= 3 and sizes[-1] == 4,
        plain and n < 10,
        plain and n > 19,
        set(sizes) == {4},
        len(groups) > 6,
        bool(s) and (s[0] in "-/)." or s[-1] in "-/(+."),
        not s,
    ]
    f[k : k + len(rest)] = rest
    return f


class Lattice:
    """Candidate segments of a window, ordered by their last token, then by their first.

    Segment x covers tokens first[x] to last[x] - 1; those that end with token
    j are at[j - 1] : at[j].
    """

    def __init__(self, text: str, run: list[tuple[int, int]], weights: np.ndarray | None = None):
        n = len(run)
        lengths = np.minimum(np.arange(1, n + 1), MAX_TOKENS)
        self.n, self.at = n, np.concatenate([[0], np.cumsum(lengths)]).tolist()
        self.last = np.repeat(np.arange(1, n + 1), lengths)
        self.first = self.last - (np.repeat(self.at[1:], lengths) - np.arange(len(self.last)))
        self.spans = [trimmed(text, run[i][0], run[j - 1][1]) for i, j in zip(self.first.tolist(), self.last.tolist(), strict=True)]
        self.features = self.scores = None
        rows = (span_features(text, a, b, j - i) for (a, b), i, j in zip(self.spans, self.first.tolist(), self.last.tolist(), strict=True))
        if weights is None:
            self.features = np.stack(list(rows))
        else:  # a block of feature rows at a time: a window of any length needs its scores only
            self.scores = np.empty((len(self.last), len(KINDS)))
            for k in range(0, len(self.last), 4096):
                block = np.stack(list(itertools.islice(rows, 4096)))
                self.scores[k : k + len(block)] = block @ weights.T

    def sums(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log partition sums up to and from every token border; a token outside of segments scores 0."""
        top = scores.max(axis=1)
        whole = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
        alpha, beta = [0.0] * (self.n + 1), [0.0] * (self.n + 1)
        first, whole, at = self.first.tolist(), whole.tolist(), self.at
        for j in range(1, self.n + 1):
            alpha[j] = _log_sum([alpha[j - 1], *(alpha[first[x]] + whole[x] for x in range(at[j - 1], at[j]))])
        for i in range(self.n - 1, -1, -1):
            ends = range(i + 1, min(self.n, i + MAX_TOKENS) + 1)
            beta[i] = _log_sum([beta[i + 1], *(beta[j] + whole[at[j] - (j - i)] for j in ends)])
        return np.array(alpha), np.array(beta)

    def posteriors(self, scores: np.ndarray) -> np.ndarray:
        alpha, beta = self.sums(scores)
        return np.exp(alpha[self.first][:, None] + scores + beta[self.last][:, None] - alpha[-1])

    def best(self, scores: np.ndarray) -> list[tuple[int, int]]:
        """(segment, kind) of the best segmentation; of ties, the one with fewer and earlier entities."""
        kinds = scores.argmax(axis=1).tolist()
        tops, first, at = scores.max(axis=1).tolist(), self.first.tolist(), self.at
        best, back = [0.0] * (self.n + 1), [-1] * (self.n + 1)
        for j in range(1, self.n + 1):
            best[j] = best[j - 1]
            for x in range(at[j - 1], at[j]):
                if best[first[x]] + tops[x] > best[j]:
                    best[j], back[j] = best[first[x]] + tops[x], x
        j, chosen = self.n, []
        while j > 0:
            if back[j] < 0:
                j -= 1
            else:
                chosen.append((back[j], kinds[back[j]]))
                j = first[back[j]]
        return chosen[::-1]


def _log_sum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(y - top) for y in x))


def _entity(rng: random.Random, kind: int) -> str:
    """A made-up entity of a kind, in the layout of the base patterns."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == 0:
        return f"{rng.choice('abcdefghij')}{rng.choice(['.', '_', ''])}{rng.choice(['smith', 'lee', 'ortiz', 'weber'])}{rng.choice(['', d(2)])}@{rng.choice(['mail', 'post', 'web'])}{rng.choice(['', d(1)])}.{rng.choice(['example', 'corp', 'uni'])}.{rng.choice(['com', 'org', 'net', 'de'])}"
    if kind == 1:
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == 2:
        body = rng.choice("3456") + d(rng.choice([13, 14, 14, 14, 15]))
        return next(body + c for c in "0123456789" if luhn(body + c))
    return f"+{rng.randrange(1, 99)} ({d(3)}) {d(3)}-{d(4)}"


def _varied(rng: random.Random, kind: int, s: str) -> str:
    """The entity as people write it to other rules than the base patterns'."""
    if kind == 0:
        local, _, domain = s.partition("@")
        o, c = rng.choice(["()", "[]", "{}"])
        gap = rng.choice(["", " "])
        return f"{local}{gap}{o}at{c}{gap}{domain.replace('.', f'{gap}{o}dot{c}{gap}') if rng.random() < 0.6 else domain}"
    if kind == 2:
        digits = re.sub(r"[^0-9]", "", s)
        return rng.choice([".", "/", " - ", "  "]).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    if kind == 3:
        parts = _GROUPS.findall(s)
        return rng.choice([f"({parts[-3]}) {parts[-2]}-{parts[-1]}", "-".join(parts[-3:]), ".".join(parts[-3:]), "+" + "/".join(parts), "+" + ".".join(parts)]) if len(parts) >= 3 else s
    return s


def _other(rng: random.Random) -> str:
    """A number that is no personal data."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    failing = next(x for x in iter(lambda: d(rng.choice([14, 15, 16, 16, 17, 18])), None) if not luhn(x))
    choices = [str(rng.randrange(1900, 2100)), f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(2)}", f"20{d(2)}-0{d(1)}-1{d(1)}", f"{d(2)}:{d(2)}", f"{d(3)},{d(2)}", d(rng.randrange(1, 9)), d(rng.randrange(20, 30)), failing, failing, "-".join((failing[:4], failing[4:8], failing[8:12], failing[12:])), f"{d(2)}%", f"3{d(3)}.{d(3)}.{d(3)}.{d(2)}", f"{d(5)}-{d(4)}", f"a{d(2)}f{d(4)}c", f"({d(2)})", f"@{d(3)}"]
    return rng.choice(choices)


_FRAMES = (("", ""), ("und der ", " das von"), ("the ", " of the"), ("de la ", ", que"), ("call ", " or write"), ("x ", "."), ("(", ")"))


def examples(texts: list[str], seed: int = 5, most_tokens: int = SAMPLE_TOKENS) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, labelled spans) to train on.

    The windows of ``texts``, whole, with their base spans as labels, up to
    ``most_tokens`` tokens; and lines made of entities (found ones and made-up
    ones) and other numbers, in layouts that the base patterns do not accept:
    spelled-out marks, other separators, entities that touch each other.  Their
    labels come from how the lines were made, not from the patterns.
    """
    rng = random.Random(seed)
    pool: list[list[str]] = [[_entity(rng, k) for _ in range(60)] for k in range(len(KINDS))]
    out, tokens = [], 0
    for text in texts:
        base = base_spans(text)
        for a, k, b in base:
            if len(pool[k]) < 400:
                pool[k].append(text[a:b])
        for run in windows(text):
            if tokens + len(run) <= most_tokens:
                tokens += len(run)
                low, high = max(0, run[0][0] - 24), run[-1][1]
                out.append((text[low:high], [(a - low, k, b - low) for a, k, b in base if run[0][0] <= a and b <= high]))
    for _ in range(2400):
        line, spans = rng.choice(_FRAMES)[0], []
        for step in range(rng.choice([1, 1, 2, 2, 3])):
            if step:
                line += rng.choice([" ", " ", " ", ", ", " and "])
            if rng.random() < 0.4:
                line += _other(rng)
            else:
                k = rng.randrange(len(KINDS))
                s = rng.choice(pool[k])
                s = _varied(rng, k, s) if rng.random() < 0.5 else s
                spans.append((len(line), k, len(line) + len(s)))
                line += s
        out.append((line + rng.choice(_FRAMES)[1], spans))
    return out


def train(texts: list[str], rounds: int = 10, rate: float = 0.2, l2: float = 1e-3) -> np.ndarray:
    """Weights (types x features) by stochastic gradient ascent on the likelihood of the labelled segmentations of :func:`examples`."""
    weights = np.zeros((len(KINDS), N_FEATURES))
    data = []
    for text, spans in examples(texts):
        want = {(a, b): k for a, k, b in spans}
        for run in windows(text):
            lattice = Lattice(text, run)
            gold = np.zeros((len(lattice.last), len(KINDS)))
            taken = 0
            for x, (span, i, j) in enumerate(zip(lattice.spans, lattice.first.tolist(), lattice.last.tolist(), strict=True)):
                if span in want and i >= taken:
                    gold[x, want[span]] = 1
                    taken = j
            data.append((lattice, gold))
    order = np.random.default_rng(3)
    for r in range(rounds):
        for x in order.permutation(len(data)):
            lattice, gold = data[x]
            off = gold - lattice.posteriors(lattice.features @ weights.T)
            weights += rate / (1 + r) * (off.T @ lattice.features - l2 * weights)
    return weights


def decode(text: str, weights: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, posterior) of the best segmentation's entities, window by window, each in one dynamic program."""
    out = []
    for run in windows(text):
        lattice = Lattice(text, run, weights)
        if chosen := lattice.best(lattice.scores):
            sure = lattice.posteriors(lattice.scores)
            out += [(lattice.spans[x][0], k, lattice.spans[x][1], float(sure[x, k])) for x, k in chosen]
    return sorted(out)


def all_spans(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the CRF's further ones: sure enough, and overlapping no base span."""
    base = base_spans(text)
    if not _MARK.search(text):
        return base, []
    added, ends, k, reach = [], base, 0, 0
    for a, kind, b, p in decode(text, weights):
        while k < len(ends) and ends[k][0] < b:
            reach = max(reach, ends[k][2])
            k += 1
        if p >= MIN_POSTERIOR and b > a and reach <= a:
            added.append((a, kind, b))
    return base, added


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> np.ndarray:
    """Trains on at most ``sample_rows`` whole texts with a digit or @, those of the least hashes."""
    rows = docs.select(F.col(text_col).cast("string").alias("t")).where("t rlike '[0-9@]'")
    got = hash_sample(rows, sample_rows, "t").orderBy(F.xxhash64("t"), "t").limit(sample_rows).collect()
    return train(sorted(r["t"] for r in got))


SPAN = "array<struct<start:long,kind:int,end:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))


def _column(spans):
    return pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in x] for x in spans], _SPAN_TYPE)


def personal_data(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): spans of every whole text, in code points, end exclusive; kind is a place in KINDS.

    Null and empty texts have none; repeated rows and null ids are kept; of
    tied segmentations the one with fewer and earlier entities wins; other
    columns are ignored; an empty table gives an empty result.  One pass
    without a shuffle.
    """
    session_for(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def over(batch):
        found = [all_spans(t or "", sent.value) for t in batch.column(1).to_pylist()]
        yield {"doc_id": batch.column(0), "base": _column([x for x, _ in found]), "added": _column([x for _, x in found])}

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), over, f"doc_id long, base {SPAN}, added {SPAN}")


def spans_text(column):
    """``kind:start:end`` of each span, comma-joined; kinds from len(KINDS) on are the CRF's own (name_crf)."""
    names = F.array(*(F.lit(k) for k in KINDS), *(F.lit(f"{k}_crf") for k in KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span of ``text_col`` replaced by its kind in brackets; other columns unchanged."""
    session_for(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    place = docs.columns.index(text_col)

    def mask(text):
        if text is None:
            return None
        base, added = all_spans(text, sent.value)
        out, at = [], 0
        for a, k, b in sorted(base + added):
            if a >= at:
                out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def over(batches):
        release_worker_state()
        for batch in batches:
            column = batch.column(place)
            yield batch.set_column(place, batch.schema.field(place), pa.array([mask(t) for t in column.to_pylist()], column.type))

    return docs.mapInArrow(over, docs.schema)
