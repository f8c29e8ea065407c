"""Benchmark decontamination by greedy string tiling (Wise 1993, running Karp-Rabin).

Seeds are rolling hashes of ``min_tile`` consecutive words.  Texts that share a
seed with a test item are tiled against it: the longest common run of unmarked
words is marked in both, again and again, until no run of ``min_tile`` words is
left.  The marked share of the item's words is its coverage, which does not
depend on the order of the passages in the text.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, hashed_words, materialise, session_for, shingle_hashes, text_slices, without_ids

#: Benchmarks up to so many characters are sent to every executor; larger ones are joined by seed.
BROADCAST_CHARS = 16_000_000
#: Items that a text is tiled against in one row.
ITEMS_AT_ONCE = 500


def tiles(item: np.ndarray, text: np.ndarray, min_tile: int, seeds: dict[int, list[int]], places: np.ndarray, hashes: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy tiles (begin in item, begin in text, words), longest first; ties: earliest in the text, then in the item.

    ``places`` are the text's positions whose seed hash occurs in the item.
    """
    diagonals = defaultdict(list)
    for j, h in zip(places.tolist(), hashes.tolist(), strict=True):
        for i in seeds[h]:
            diagonals[j - i].append(i)
    heap = []
    for shift, begins in diagonals.items():
        begins.sort()
        start = previous = begins[0]
        for i in [*begins[1:], -9]:
            if i != previous + 1:
                n = previous - start + min_tile
                if np.array_equal(item[start : start + n], text[start + shift : start + shift + n]):
                    heap.append((-n, start + shift, start))
                start = i
            previous = i
    heapq.heapify(heap)
    in_item, in_text, out = np.zeros(len(item), bool), np.zeros(len(text), bool), []
    while heap:
        n, j, i = heapq.heappop(heap)
        n = -n
        taken = in_item[i : i + n] | in_text[j : j + n]
        if not taken.any():
            in_item[i : i + n] = in_text[j : j + n] = True
            out.append((i, j, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[1], taken.astype(np.int8), [1]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= min_tile:
                heapq.heappush(heap, (a - b, j + a, i + a))
    return out


class Items:
    """Seed tables of a benchmark; an item shorter than ``min_tile`` words is one seed of its own length."""

    def __init__(self, item_ids: list[int], texts: list[str], min_tile: int):
        self.min_tile, self.ids, self.words, self.seeds = min_tile, item_ids, {}, {}
        self.by_width: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        column = pa.array(texts, pa.large_string())
        for at, to, data, offsets in text_slices(column):
            words, begins = hashed_words(data, offsets)
            for k in range(at, to):
                own = words[begins[k - at] : begins[k - at + 1]]
                if not len(own):
                    continue
                width = min(min_tile, len(own))
                runs, _ = shingle_hashes(own, np.array([0, len(own)]), width)
                key = k  # items may share an id
                self.words[key], self.seeds[key] = own, defaultdict(list)
                for i, h in enumerate(runs.tolist()):
                    self.seeds[key][h].append(i)
                    self.by_width[width][h].add(key)
        self.sorted = {w: np.array(sorted(t), dtype=np.uint64) for w, t in self.by_width.items()}

    def search(self, words: np.ndarray, begins: np.ndarray):
        """(row, item, tiles) for every text and item that share a seed."""
        for width, known in self.sorted.items():
            counts = np.diff(begins)
            if not len(words) or counts.max() < width:
                continue
            runs, run_begins = shingle_hashes(words, begins, width)
            at = np.searchsorted(known, runs)
            at[at == len(known)] = 0
            hit = np.flatnonzero(known[at] == runs)
            if not len(hit):
                continue
            rows = np.searchsorted(run_begins, hit, side="right") - 1
            for row in np.unique(rows).tolist():
                mine = hit[rows == row]
                text = words[begins[row] : begins[row + 1]]
                if len(text) < width:
                    continue
                found, of_item = runs[mine], defaultdict(list)
                for p, h in zip((mine - run_begins[row]).tolist(), found.tolist(), strict=True):
                    for key in self.by_width[width][h]:
                        of_item[key].append((p, h))
                for key, seeds in sorted(of_item.items()):
                    places, hashes = np.array([p for p, _ in seeds]), np.array([h for _, h in seeds], dtype=np.uint64)
                    yield row, key, tiles(self.words[key], text, width, self.seeds[key], places, hashes)


SCHEMA = "doc_id long, item_id long, n_words long, matched long, n_tiles long, longest long, coverage double"


def _result(doc_ids, found, n_words, item_ids) -> dict:
    return {
        "doc_id": pa.array([doc_ids[r] for r, _, _ in found], pa.int64()),
        "item_id": pa.array([item_ids[k] for _, k, _ in found], pa.int64()),
        "n_words": pa.array([n_words[k] for _, k, _ in found], pa.int64()),
        "matched": pa.array([sum(n for *_, n in t) for _, _, t in found], pa.int64()),
        "n_tiles": pa.array([len(t) for *_, t in found], pa.int64()),
        "longest": pa.array([max(n for *_, n in t) for *_, t in found], pa.int64()),
        "coverage": pa.array([sum(n for *_, n in t) / n_words[k] for _, k, t in found], pa.float64()),
    }


def contamination(docs: DataFrame, benchmark: DataFrame, min_tile: int = 5, threshold: float = 0.7) -> DataFrame:
    """One row per (text, item) whose tiles cover at least ``threshold`` of the item's words.

    Columns: doc_id, item_id, n_words (of the item), matched, n_tiles, longest,
    coverage.  ``docs`` has doc_id and text, ``benchmark`` item_id and text;
    words are ``[^\\x20\\x09-\\x0D]+`` with ASCII letters lower-cased.

    Defined cases: null, empty and blank texts match nothing; an item shorter
    than ``min_tile`` words must occur as a whole; repeated documents give
    repeated rows, repeated items (equal id and text) count once, items that
    share an id are tiled each for itself; rows with a
    null id keep it (items with a null id are ignored); other columns are
    ignored; an empty table gives an empty result.

    Scale: the texts are read once and never shuffled while the benchmark's
    characters, summed first, stay within ``BROADCAST_CHARS``; beyond, seeds of
    both sides are joined, and only texts that share a rare one are tiled.
    """
    session_for(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    if size > BROADCAST_CHARS:
        return _by_seed_join(rows, items, min_tile, threshold)
    known = items.orderBy("item_id", "text").collect()
    shared = docs.sparkSession.sparkContext.broadcast(([r["item_id"] for r in known], [r["text"] for r in known]))
    tables: list[Items] = []

    def over(batch):
        if not tables:
            tables.append(Items(*shared.value, min_tile))
        table = tables[0]
        ids = batch.column(0).to_pylist()
        lengths = {k: len(w) for k, w in table.words.items()}
        for at, _, data, offsets in text_slices(batch.column(1)):
            words, begins = hashed_words(data, offsets)
            found = [(at + r, k, t) for r, k, t in table.search(words, begins) if sum(n for *_, n in t) >= threshold * lengths[k] - 1e-9 and t]
            yield _result(ids, found, lengths, table.ids)

    return arrow_map(rows, over, SCHEMA)


def _droppable(n_words: np.ndarray, min_tile: int, threshold: float) -> np.ndarray:
    """How many seed positions of items may go unseen: tiles that cover ``threshold`` hold one more at least.

    Tiles of w words or more that cover c words hold c - (w - 1) * (c // w)
    positions at least; the least counts of all c from ``threshold`` on, which
    recurs after w of them.
    """
    width = np.minimum(min_tile, n_words)
    least = np.maximum(np.ceil(threshold * n_words - 1e-9).astype(np.int64), width)
    covers = np.minimum(least[:, None] + np.arange(min_tile), n_words[:, None])
    return (covers - (width[:, None] - 1) * (covers // np.maximum(width, 1)[:, None])).min(axis=1) - 1


def _by_seed_join(rows: DataFrame, items: DataFrame, min_tile: int, threshold: float) -> DataFrame:
    """The way for benchmarks of any size: join on seed hashes, then tile every text once against its items.

    Each item passes over its most frequent seeds, as many positions as cannot
    make up for its coverage alone; so a seed that a third of all texts hold
    pairs these only with items that consist of such seeds.  Items of a text
    are gathered in lists of about ITEMS_AT_ONCE.
    """
    keyed = rows.where("text is not null").withColumn("key", F.xxhash64("doc_id", "text"))
    items = materialise(items.withColumn("item", F.xxhash64("item_id", "text")))

    def seeds(of_items: bool):
        def over(batch):
            for at, to, data, offsets in text_slices(batch.column(1)):
                words, begins = hashed_words(data, offsets)
                counts = np.diff(begins)
                for width in range(1, min_tile + 1):  # an item shorter than min_tile has seeds of its own length
                    runs, run_begins = shingle_hashes(words, begins, width)
                    owner = np.repeat(np.arange(to - at), np.diff(run_begins))
                    use = counts[owner] >= width
                    if of_items:
                        use &= np.minimum(counts[owner], min_tile) == width
                    pair, places = np.unique(np.stack([owner[use], runs[use].view(np.int64)], axis=1), axis=0, return_counts=True)
                    spare = _droppable(counts[pair[:, 0]], min_tile, threshold)
                    yield {"owner": batch.column(0).take(pa.array(at + pair[:, 0])), "seed": pair[:, 1], "places": places, "spare": spare}

        return over

    schema = "owner long, seed long, places long, spare long"
    of_items = materialise(arrow_map(items.select("item", "text"), seeds(True), schema).distinct())
    of_texts = arrow_map(keyed.select("key", "text"), seeds(False), schema).select(F.col("owner").alias("key"), "seed")
    hits = materialise(of_texts.join(of_items.select("seed").distinct(), "seed", "left_semi"))
    counted = of_items.join(hits.groupBy("seed").agg(F.count(F.lit(1)).alias("texts")), "seed")
    seen = F.sum("places").over(W.partitionBy("owner").orderBy(F.desc("texts"), "seed"))
    kept = counted.withColumn("seen", seen).where("seen > spare").select("seed", F.col("owner").alias("item"))
    pairs = materialise(hits.join(kept, "seed").select("key", "item").distinct())
    lists = pairs.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / ITEMS_AT_ONCE).alias("lists"))
    dealt = pairs.join(lists, "key").withColumn("list", F.pmod(F.xxhash64("item"), F.col("lists"))).join(items, "item")
    gathered = dealt.groupBy("key", "list").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    joined = gathered.select("key", "items").join(keyed, "key").select("doc_id", "text", F.col("items.item_id").alias("ids"), F.col("items.text").alias("texts"))

    def over(batch):
        for doc, body, ids, texts in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            table = Items(ids, texts, min_tile)
            lengths = {k: len(w) for k, w in table.words.items()}
            for _, _, data, offsets in text_slices(pa.array([body], pa.large_string())):
                words, begins = hashed_words(data, offsets)
                found = [(0, k, t) for _, k, t in table.search(words, begins) if t and sum(n for *_, n in t) >= threshold * lengths[k] - 1e-9]
                yield _result([doc], found, lengths, table.ids)

    return arrow_map(joined, over, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_tile: int = 5, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that cover no item; columns unchanged (rows with a null id stay)."""
    return without_ids(docs, contamination(docs, benchmark, min_tile, threshold).select("doc_id"), "doc_id")
