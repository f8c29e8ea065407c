"""Quality classifier by a weak-label model.

Heuristic labellers overlap and abstain; expectation-maximisation estimates
their accuracies without labels, and the posteriors of a bounded sample train a
linear scorer on hashed word shapes, which then scores every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SEPARATORS, arrow_map, hash_sample, hashed_words, mix, release_worker_state, session_for, text_slices
from .linear import fit_logistic, label_model, sigmoid

SAMPLE_ROWS = 6000  # texts that the model is fitted on, at most
PRIOR = 0.2  # share of junk that the label model starts from
BUCKETS = 1 << 12
_LEVELS = np.array([0.0, 0.01, 0.05, 0.2, 0.5])

_CLASS = np.full(256, 9, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
for _i, _chars in enumerate((b".", b",;:", b"!?", b"*#$%&@^~=_", b"|"), 4):
    _CLASS[list(_chars)] = _i


def shape_rows(column: pa.Array):
    """Per slice: (first row, last row + 1, statistics, levels): word shape shares per text.

    A word's shape is its first and last character class, whether it is all
    capitals and whether it repeats the word before.
    """
    for at, to, data, offsets in text_slices(column):
        n_docs = to - at
        words, begins = hashed_words(data, offsets, lower=False)
        counts = np.diff(begins)
        owner = np.repeat(np.arange(n_docs), counts)
        stats = np.zeros((n_docs, 10))
        codes = np.zeros(0, np.int64)
        if len(words):
            gap = _SEPARATORS[data]
            border = np.zeros(len(data) + 1, dtype=bool)
            border[offsets] = True
            starts = np.flatnonzero(~gap & (np.concatenate([[True], gap[:-1]]) | border[:-1]))
            ends = np.flatnonzero(~gap & (np.concatenate([gap[1:], [True]]) | border[1:])) + 1
            first, last = _CLASS[data[starts]], _CLASS[data[ends - 1]]
            kind = _CLASS[data]
            upper = np.concatenate([[0], np.cumsum(kind == 1)])
            lower = np.concatenate([[0], np.cumsum(kind == 0)])
            capitals = (upper[ends] - upper[starts] >= 2) & (lower[ends] == lower[starts])
            again = np.zeros(len(words), dtype=bool)
            again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
            codes = ((first * 10 + last) * 2 + capitals) * 2 + again
            share = lambda x: np.bincount(owner, weights=x, minlength=n_docs) / np.maximum(counts, 1)
            order = np.lexsort((words, owner))
            fresh = np.ones(len(words), dtype=bool)
            fresh[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
            distinct = np.bincount(owner[order][fresh], minlength=n_docs)
            length = ends - starts
            stats = np.stack(
                [counts, share(last == 7), share(last == 6), share(last == 8), share(capitals), share(again), distinct / np.maximum(counts, 1) ** 0.9, share(last == 4), share(length > 30), share((first == 1) & ~capitals)],
                axis=1,
            ).astype(float)
        table = np.zeros((n_docs, 400))
        if len(codes):
            np.add.at(table, (owner, codes), 1)
            table /= np.maximum(counts, 1)[:, None]
        yield at, to, stats, np.searchsorted(_LEVELS, table, side="left")


#: Thresholds are set by hand, wide of the shares that running prose has; how far each labeller is right, and which ones say the same, is estimated.
#: Labellers: name, 1 for junk and 0 for clean, and the test on the statistics of :func:`shape_rows`.
LABELLERS = [
    ("symbols", 1, lambda s: s[:, 1] > 0.15),
    ("symbols_many", 1, lambda s: s[:, 1] > 0.4),
    ("shouting", 1, lambda s: s[:, 2] > 0.2),
    ("capitals", 1, lambda s: s[:, 4] > 0.3),
    ("cells", 1, lambda s: s[:, 3] > 0.1),
    ("cells_many", 1, lambda s: s[:, 3] > 0.25),
    ("stutter", 1, lambda s: s[:, 5] > 0.25),
    ("stutter_many", 1, lambda s: s[:, 5] > 0.45),
    ("poor_words", 1, lambda s: (s[:, 6] < 0.12) & (s[:, 0] >= 60)),
    ("long_words", 1, lambda s: s[:, 8] > 0.2),
    ("plain_words", 0, lambda s: (s[:, 1] < 0.05) & (s[:, 2] < 0.1) & (s[:, 3] < 0.05) & (s[:, 4] < 0.15) & (s[:, 5] < 0.15)),
    ("varied_lines", 0, lambda s: (s[:, 5] < 0.05) & (s[:, 3] < 0.02) & (s[:, 4] < 0.05) & (s[:, 1] < 0.02)),
]


def _hashed(levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every shape and level that a text reaches."""
    rows, buckets = [], []
    for level in range(1, len(_LEVELS) + 1):
        row, shape = np.nonzero(levels >= level)
        rows.append(row)
        buckets.append((mix((shape * 8 + level + 1).astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, prior: float = PRIOR, text_col: str = "text", id_col: str = "doc_id") -> dict:
    """Fits on at most ``sample_rows`` texts, taken by hash of the id; no labels are used.

    Blank texts are left out; an empty sample gives a model that keeps all.
    """
    session_for(docs.sparkSession)

    def over(batch):
        for at, to, stats, levels in shape_rows(batch.column(1)):
            yield {"doc_id": batch.column(0).slice(at, to - at), "stats": pa.array(stats.tolist(), pa.list_(pa.float64())), "levels": pa.array([x.astype(np.int8).tobytes() for x in levels], pa.binary())}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = hash_sample(rows, sample_rows, "doc_id", F.length("text"))
    got = arrow_map(rows, over, "doc_id long, stats array<double>, levels binary").where("stats[0] > 0").limit(sample_rows).toPandas().sort_values(["doc_id", "levels"])
    if got.empty:
        return {"weights": np.zeros(BUCKETS), "bias": -5.0}
    stats = np.array(got["stats"].tolist())
    levels = np.stack([np.frombuffer(x, dtype=np.int8) for x in got["levels"]])
    votes = np.stack([test(stats) for _, _, test in LABELLERS], axis=1)
    post, accuracy, share = label_model(votes, np.array([p for _, p, _ in LABELLERS]), prior, alike=0.5)
    row, bucket = _hashed(levels)
    w, b = fit_logistic(row, bucket, np.ones(len(row)), (len(got), BUCKETS), post, l2=0.5)
    return {"weights": w, "bias": b, "accuracies": accuracy, "shares": share, "junk": float(post.mean())}


def score(docs: DataFrame, model: dict, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, quality_score, keep): 1 - the scorer's probability of junk; kept from 0.5 on.

    Null, empty and blank texts have no evidence and score 0 (not kept);
    repeated rows and null ids are kept as rows, ties at 0.5 are kept, other
    columns are ignored, an empty table gives an empty result.  One pass
    without a shuffle.
    """
    session_for(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model["weights"], model["bias"]))

    def over(batch):
        weights, bias = sent.value
        for at, to, stats, levels in shape_rows(batch.column(1)):
            row, bucket = _hashed(levels)
            z = np.bincount(row, weights=weights[bucket], minlength=to - at) + bias
            good = np.where(stats[:, 0] > 0, 1 - sigmoid(z), 0.0)
            yield {"doc_id": batch.column(0).slice(at, to - at), "quality_score": good, "keep": good >= 0.5}

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), over, "doc_id long, quality_score double, keep boolean")


def keep_good(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps; columns unchanged.  One pass after the fit."""
    model = fit(docs, sample_rows)
    sent = docs.sparkSession.sparkContext.broadcast((model["weights"], model["bias"]))

    def over(batches):
        release_worker_state()
        weights, bias = sent.value
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for at, to, stats, levels in shape_rows(batch.column(batch.schema.get_field_index("text")).cast(pa.string())):
                row, bucket = _hashed(levels)
                z = np.bincount(row, weights=weights[bucket], minlength=to - at) + bias
                keep[at:to] = (stats[:, 0] > 0) & (1 - sigmoid(z) >= 0.5)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(over, docs.schema)
