"""Toxicity by weak supervision.

Voters say "toxic" or abstain: a fixed lexicon, words, stems and repeated stems
proposed by the labelled sample, and patterns (second-person frames,
exclamations, shouting).  Labels only propose which words are voters; a
generative label model then estimates from the votes alone how far each voter
is right and which voters say the same, and its posteriors train a hashed
linear classifier that scores every whole text.  Labels come back once, to set
the scale and threshold of the final score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, hash_sample, materialise, mix, session_for, text_slices
from .linear import calibrate, fit_logistic, sigmoid

BITS = 40  # of a feature's hash: long texts would meet voters by chance in a short one
FILTER_BITS = 22  # of the table that passes over most other features
STEMS = (4, 5, 6, 7, 8)  # bytes of a word's beginning that make a stem; the shortest is the word's root
SAMPLE_ROWS = 8000  # labelled rows, and as many of the documents, that the model is fitted on
VOTERS = 400  # proposed voters, at most
WEIGHTS = 20_000  # features of the classifier, at most
START, STRENGTH = 0.3, 2.0  # share of a voter's votes that are taken for chance at first, and the rows that this counts for
OWN = 0.5  # part of its own say that counts when a voter's rates are estimated
ALIKE = 0.9  # correlation from which two roots say the same
#: Insults of four languages, folded to lower case.
LEXICON = "idiot moron stupid dumb loser scum trash pathetic worthless disgusting clown jerk filthy vermin trottel dummkopf abschaum arschloch widerlich imbecile crétin connard salaud ordure idiota estúpido imbécil basura asqueroso escoria".split()

_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = True
_IS_LETTER[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_VALUE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def features(data: np.ndarray, offsets: np.ndarray, roots: bool = False) -> tuple[np.ndarray, ...]:
    """(text, feature) of all words and stems; letters with accents are folded to lower case (Latin-1).

    With ``roots`` also the feature of each word's root: voters with a root in
    common come from the same words.
    """
    n = len(data)
    none = (np.zeros(0, np.int64),) * (2 + roots)
    if n == 0:
        return none
    folded = _FOLD[data]
    accent = np.zeros(n, dtype=bool)
    accent[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    folded = np.where(accent, folded + np.uint8(32), folded)
    letter = _IS_LETTER[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    inner = offsets[offsets < n]
    first[inner] = letter[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return none
    place = np.arange(n) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0, *[]], starts, [n]])))
    text = np.searchsorted(offsets, starts, side="right") - 1
    lengths = np.add.reduceat(letter, starts, dtype=np.int64)
    power = _powers_to(int(lengths.max()) + 1)
    with np.errstate(over="ignore"):
        value = np.where(letter, _VALUE[folded], np.uint64(0)) * power[np.minimum(place, len(power) - 1)]
        owners, found = [text], [mix(np.add.reduceat(value, starts) + np.uint64(99))]
        root = found[0].copy()
        origin = [root]
        for m in STEMS:
            long = lengths > m
            h = mix(np.add.reduceat(np.where(place < m, value, np.uint64(0)), starts)[long] + np.uint64(m))
            if m == STEMS[0]:
                root[long] = h
            owners.append(text[long])
            found.append(h)
            origin.append(root[long])
    mask = np.uint64((1 << BITS) - 1)
    out = np.concatenate(owners), (np.concatenate(found) & mask).astype(np.int64)
    return (*out, (np.concatenate(origin) & mask).astype(np.int64)) if roots else out


def _powers_to(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        steps = np.full(min(n, 1 << 23), 0xD6E8FEB86659FD93, dtype=np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)


def counted(owner: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, code): code 2f where feature f occurs, and 2f+1 where it occurs twice or more."""
    key = owner * (1 << BITS) + feature
    key, counts = np.unique(key, return_counts=True)
    owner, feature = key >> BITS, key & ((1 << BITS) - 1)
    twice = counts >= 2
    return np.concatenate([owner, owner[twice]]), np.concatenate([2 * feature, 2 * feature[twice] + 1])


def _patterns(text: str) -> list[int]:
    """The pattern voters' votes, and the number of words."""
    low = text.lower()
    letters = sum(map(str.isalpha, text)) or 1
    return [
        int(" you are a " in low or " you're a " in low),
        int(low.count("!") > 0.05 * (low.count(" ") + 1)),
        int(sum(map(str.isupper, text)) > 0.5 * letters),
        len(text.split()),
    ]


def label_model(votes: np.ndarray, roots: np.ndarray, sizes: np.ndarray, rounds: int = 60, share: float = 0.1) -> dict:
    """Posteriors of "toxic", and the voters' rates and correlations, from votes alone, by expectation-maximisation.

    ``votes`` is a boolean matrix rows x voters, ``roots`` says which voters come
    from the same words: of these, the surest one that votes counts in a row;
    ``sizes`` are the rows' words.  A voter fires by chance at ``noise`` per word,
    and besides in a share ``signal`` of the toxic texts; so a vote in a long
    text says less.  Abstaining says nothing.  Roots whose chance votes are correlated
    beyond ALIKE (in texts as far as they are not toxic) divide their say.  Each voter's rates are weighted by the posteriors that the
    *other* roots give (and START of its votes are taken for chance, with the
    weight of STRENGTH rows; of its own say OWN counts), so that no voter confirms itself.  Rows without a vote
    that says something are toxic as often as voters miss: the rate is that at which two halves of
    the roots both miss, by capture and recapture.  ``share`` is where the share
    of toxic rows starts.  Repeated rows count each; no rows give empty posteriors.
    """
    n, m = votes.shape
    kinds, root = np.unique(roots, return_inverse=True)
    order = np.argsort(root, kind="stable")
    begins = np.searchsorted(root[order], np.arange(len(kinds)))
    v = votes[:, order].astype(np.float64)
    size = np.maximum(np.asarray(sizes, dtype=float), 1.0)
    fired = v.sum(axis=0)
    noise = START * (fired + 0.1) / max(size.sum(), 1.0)
    signal = np.full(m, 0.1)
    post, say = np.full(n, share), np.ones(len(kinds))
    if m and n:
        by_root, rate = np.maximum.reduceat(v, begins, axis=1), 0.05
        half = np.arange(len(kinds)) % 2 == 0
        one, two = by_root[:, half].any(axis=1), by_root[:, ~half].any(axis=1)
        for k in range(rounds):
            if k in (5, 15):
                say = _say(by_root, 1 - post)
            chance = noise * size[:, None]
            pull = np.maximum.reduceat(v * np.log1p(signal / chance), begins, axis=1) * say
            base, total = np.log(share / (1 - share)), pull.sum(axis=1)
            others = sigmoid(base + _evidence(total[:, None] - (1 - OWN) * pull, rate))[:, root[order]]
            clean = 1 - others
            noise = ((clean * v).sum(axis=0) + START * STRENGTH * fired / max(n, 1) + 1e-3) / ((clean * size[:, None]).sum(axis=0) + STRENGTH * size.mean())
            signal = np.clip(((others * v).sum(axis=0) - noise * (others * size[:, None]).sum(axis=0)) / (others.sum(axis=0) + 1e-9), 1e-5, 1 - 1e-5)
            new = sigmoid(base + _evidence(total, rate))
            miss = [((new * x * ~y).sum() + 0.5) / ((new * x).sum() + 1) for x, y in ((one, two), (two, one))]
            rate = miss[0] * miss[1]
            share = float(np.clip(new.mean(), 0.005, 0.5))
            change = np.abs(new - post).max()
            post = new
            if change < 1e-6 and k > 15:
                break
    back = np.empty(m, dtype=np.int64)
    back[order] = np.arange(m)
    right = (post @ v / np.maximum(fired, 1))[back] if m else np.zeros(0)
    return {"posteriors": post, "accuracies": right, "signal": signal[back], "noise": noise[back], "say": say[root], "share": share}


def _evidence(pull: np.ndarray, rate: float) -> np.ndarray:
    """Log odds that votes add: of a toxic text that the voters miss (``rate``) they say nothing, of others their pull."""
    return np.where(pull > 30, pull, np.log(rate + np.expm1(np.minimum(pull, 30))))


def _say(fires: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One over one plus a column's summed correlations of ALIKE or more with others, rows weighted."""
    total = weight.sum() + 1e-9
    centred = (fires - weight @ fires / total) * np.sqrt(weight)[:, None]
    spread = np.sqrt((centred**2).sum(axis=0)) + 0.1
    alike = centred.T @ centred / np.outer(spread, spread)
    np.fill_diagonal(alike, 0)
    return 1.0 / (1.0 + np.where(alike >= ALIKE, alike, 0).sum(axis=0))


def _lexicon_codes() -> tuple[np.ndarray, np.ndarray]:
    """(code, root) of the lexicon's words."""
    raw = [w.encode() for w in LEXICON]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in raw])])
    owner, feature, root = features(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, roots=True)
    return 2 * feature[: len(raw)], root[: len(raw)]  # words come first


def _tally(rows: DataFrame) -> DataFrame:
    """(code, root, value, every): of rows (text, value), the sum of values and the number of texts with each code; summed in each batch first."""

    def over(batch):
        value = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
        for at, to, data, offsets in text_slices(batch.column(0)):
            owner, feature, root = features(data, offsets, roots=True)
            known, first = np.unique(feature, return_index=True)
            owner, code = counted(owner, feature)
            codes, col = np.unique(code, return_inverse=True)
            yield {"code": codes, "root": root[first][np.searchsorted(known, codes >> 1)], "value": np.bincount(col, weights=value[at:to][owner], minlength=len(codes)), "every": np.bincount(col, minlength=len(codes))}

    found = arrow_map(rows.select("text", F.col("value").cast("double")), over, "code long, root long, value double, every long")
    return found.groupBy("code").agg(F.min("root").alias("root"), F.round(F.sum("value"), 9).alias("value"), F.sum("every").alias("every"))


def _odds(n: float, total: float) -> str:
    """SQL of the log odds of value over the rest, of n rows whose values sum to total."""
    return f"ln((value + 0.5) / ({total} + 1)) - ln((every - value + 0.5) / ({n - total} + 1))"


def _picked_codes(rows: DataFrame, codes: np.ndarray, extra) -> DataFrame:
    """(key, places, more): of rows (text, key), the places in the sorted ``codes`` of those that a text has, and ``extra`` of the text."""

    def over(batch):
        texts = batch.column(0).to_pylist()
        for at, to, data, offsets in text_slices(batch.column(0)):
            owner, code = counted(*features(data, offsets))
            place = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            hit = codes[place] == code if len(codes) else np.zeros(len(code), dtype=bool)
            owner, place = owner[hit], place[hit].astype(np.int32)
            order = np.argsort(owner, kind="stable")
            place, begins = place[order], np.searchsorted(owner[order], np.arange(to - at + 1))
            yield {"key": batch.column(1).slice(at, to - at), "places": pa.array([place[begins[k] : begins[k + 1]].tobytes() for k in range(to - at)], pa.binary()), "more": pa.array([extra(t or "") for t in texts[at:to]], pa.list_(pa.int64()))}

    return arrow_map(rows.select("text", "key"), over, "key long, places binary, more array<long>")


def _sparse(frame) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of a collected :func:`_picked_codes`."""
    places = [np.frombuffer(x, dtype=np.int32) for x in frame["places"]]
    return np.repeat(np.arange(len(places)), [len(x) for x in places]), (np.concatenate(places) if places else np.zeros(0)).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, voters: int = VOTERS) -> dict:
    """Fits the model on at most about ``sample_rows`` rows of ``labels`` (doc_id, toxic) and as many of ``docs``, taken by hash of doc_id.

    The labelled sample proposes at most ``voters`` voters and sets the final
    scale and threshold; the label model and the classifier are fitted on the
    sample of ``docs``, without labels.  Rows without a label or text are passed
    over; without both labels the model is their share alone.  The driver
    receives voters, votes, and the classifier's features of the sample.
    """
    session_for(docs.sparkSession)
    picked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("long")).alias("value"))
    picked = hash_sample(picked, sample_rows, "doc_id")
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = materialise(texts.join(F.broadcast(picked), "doc_id").select("text", "value").withColumn("key", F.monotonically_increasing_id()))
    n, total = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("value"), F.lit(0))).first()
    if total in (0, n):
        share = total / n if n else 0.0
        return {"codes": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": float(np.log((share + 1e-3) / (1 - share + 1e-3)))}
    # proposed voters: features whose texts are toxic far more often than others; the labels have no other say until the threshold
    tallied = _tally(labelled).withColumn("odds", F.expr(_odds(n, total))).where("value >= 3 and odds > 1 and value > 0.7 * every")
    proposed = tallied.orderBy(F.desc(F.col("odds") * F.sqrt("value")), "code").limit(voters).select("code", "root").collect()
    root_of = dict(zip(*(x.tolist() for x in _lexicon_codes()), strict=True)) | {r.code: r.root for r in proposed}
    voter = np.array(sorted(root_of), dtype=np.int64)
    sample = materialise(hash_sample(texts, sample_rows, "doc_id").select("text", F.monotonically_increasing_id().alias("key")))
    got = _picked_codes(sample, voter, _patterns).toPandas().sort_values("key", ignore_index=True)
    votes = np.zeros((len(got), len(voter) + 3), dtype=bool)
    votes[_sparse(got)] = True
    more = np.array(got["more"].tolist(), dtype=np.int64).reshape(len(got), 4)
    votes[:, len(voter) :] = more[:, :3] > 0  # the two patterns of style have a root in common
    found = label_model(votes, np.array([root_of[c] for c in voter.tolist()] + [-1, -2, -2]), more[:, 3])
    post = found["posteriors"]
    # the classifier sees features that at least three sampled texts have and that lean to toxic ones
    frame = got[["key"]].assign(value=post)
    leaning = _tally(sample.join(F.broadcast(docs.sparkSession.createDataFrame(frame)), "key")).where("every >= 3")
    leaning = leaning.withColumn("lean", F.expr(_odds(len(post), float(post.sum()))) * F.sqrt("value")).where("lean > 1.5")
    use = np.array(sorted(r.code for r in leaning.orderBy(F.desc("lean"), "code").limit(WEIGHTS).select("code").collect()), dtype=np.int64)
    nothing = lambda _: []
    seen = _picked_codes(sample, use, nothing).toPandas().sort_values("key", ignore_index=True)
    row, col = _sparse(seen)
    w, b = fit_logistic(row, col, np.ones(len(row)), (len(seen), len(use)), post, l2=0.1)
    known = _picked_codes(labelled, use, nothing).join(labelled.select("key", "value"), "key").toPandas().sort_values("key", ignore_index=True)
    row, col = _sparse(known)
    z, truth = np.bincount(row, weights=w[col], minlength=len(known)) + b, known["value"].to_numpy().astype(float)
    scale, shift = calibrate(z, truth)  # of the threshold, on the labels of the sample
    w, b = scale * w, scale * b + shift
    return {"codes": use, "weights": w, "bias": b, "voters": voter, "accuracies": found["accuracies"], "signal": found["signal"], "noise": found["noise"], "say": found["say"], "share": found["share"]}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text.

    Null and empty texts get the score of a text without features; repeated
    rows and null ids are kept; ties do not arise; other columns are ignored; an
    empty table gives an empty result.  One pass without a shuffle; the model
    (at most WEIGHTS weights) is sent to the executors.
    """
    session_for(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model["codes"], model["weights"], model["bias"]))
    low, tables = (1 << FILTER_BITS) - 1, []  # the table is made once a task

    def over(batch):
        codes, weights, bias = sent.value
        if not tables:
            tables.append(np.bincount((codes >> 1) & low, minlength=low + 1) > 0)
        (maybe,) = tables
        for at, to, data, offsets in text_slices(batch.column(1)):
            owner, feature = features(data, offsets)
            hit = maybe[feature & low]
            owner, code = counted(owner[hit], feature[hit])
            z = np.full(to - at, bias)
            if len(codes):
                place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                z += np.bincount(owner, weights=np.where(codes[place] == code, weights[place], 0.0), minlength=to - at)
            yield {"doc_id": batch.column(0).slice(at, to - at), "score": sigmoid(z)}

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), over, "doc_id long, score double")
