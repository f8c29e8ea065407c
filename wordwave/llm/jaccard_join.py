"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti, Kaushik 2006).

Texts become sets of word shingles.  Sizes are cut into bands; within a band,
two sets whose Jaccard similarity reaches the threshold differ in at most
``k`` elements.  The element domain is partitioned by hash into
``k // 2 + 1 + spare`` parts of three cells each: at least ``spare + 1`` parts
then hold at most one difference, so some two of their three cells agree.
Every set emits, for each part, the projections on the three pairs of cells;
linked sets share at least ``spare + 1`` such signatures.  So every set may pass
over its ``spare`` most frequent ones, in an order that all sets share: the
rarest signature that two linked sets have in common is kept by both, and no
link is lost.  This is what keeps empty projections, and those that hold
nothing but a passage that many texts share, from gathering unlike texts.
Candidates are verified exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, discard, hashed_words, materialise, mix, release_worker_state, session_for, shingle_hashes, text_slices, without_ids
from .components import connected_components

#: A join side up to this many rows (of two longs) may be broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 2_000_000
#: Parity cells of a set's sketch, and of the finer one of candidates; sets beyond LARGE elements have more.
SKETCH_BITS, FINE_BITS, LARGE = 1024, 4096, 2048
#: Nodes of a signature that are compared by sketches in one block, and bytes of their sets that are verified in one.
BLOCK_ROWS, BLOCK_BYTES = 1000, 1 << 23
#: Signatures that a task sorts at a time.
SIGNATURES_AT_ONCE = 500_000
#: Pairs that a task remembers, so as not to report them under each of their signatures.
MET_PAIRS = 50_000
#: Parts beyond the least number, as a share of it: so many signatures a set may pass over.
SPARE = 0.2
#: Signatures that more nodes than this share are passed over first; rarer ones never.
FREQUENT = 4

#: Signatures keep 48 bits: equal ones of different projections cost a comparison, never a link.
_SIGNATURE_MASK = np.uint64((1 << 48) - 1)
_CELL_SALT, _PART_SALT = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)


def _bands(threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last sizes of the bands: each spans a factor 1 / threshold.

    Wider bands would need fewer signatures, but shorter projections, and
    large sets would then share empty ones.
    """
    first, last = [1], []
    while first[-1] < 1 << 40:
        last.append(first[-1] * 100 // threshold)
        first.append(last[-1] + 1)
    return np.array(first[:-1], dtype=np.int64), np.array(last, dtype=np.int64)


def _parts(k):
    """(parts, spare ones among them) for sets that differ in at most ``k`` elements."""
    least = np.asarray(k, dtype=np.int64) // 2 + 1
    spare = np.ceil(SPARE * least).astype(np.int64)
    return least + spare, spare


def _differences(in_band, threshold: int):
    """The most elements by which linked sets of a band differ."""
    return (100 - threshold) * 2 * _bands(threshold)[1][in_band] // (100 + threshold)


def spare_signatures(sizes, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """How many signatures sets of these sizes may pass over, among the even and the odd ones.

    A set stands in its own band and the next; the last bit of a signature is
    that of the band.
    """
    first, _ = _bands(threshold)
    band = np.clip(np.searchsorted(first, sizes, side="right") - 1, 0, len(first) - 2)
    own, next_ = (_parts(_differences(band + up, threshold))[1] for up in (0, 1))
    return np.where(band % 2 == 0, own, next_), np.where(band % 2 == 0, next_, own)


def text_sets(column: pa.Array, width: int):
    """Per slice: first row, sorted distinct shingle hashes of all its texts, sizes, begins, set ids."""
    for at, to, data, offsets in text_slices(column):
        words, begins = hashed_words(data, offsets)
        runs, run_begins = shingle_hashes(words, begins, width)
        counts = np.diff(run_begins)
        owner = np.repeat(np.arange(to - at), counts)
        order = np.lexsort((runs, owner))
        runs = runs[order]
        fresh = np.ones(len(runs), dtype=bool)
        fresh[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
        runs, owner = runs[fresh], owner[fresh]
        sizes = np.bincount(owner, minlength=to - at).astype(np.int64)
        set_begins = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.zeros(to - at, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(ids, owner, mix(runs ^ np.uint64(0x3C6EF372FE94F82B)))
            ids = mix(ids + sizes.astype(np.uint64) * np.uint64(0xA54FF53A5F1D36F1))
        yield at, to, runs, sizes, set_begins, ids.view(np.int64)


def signatures(runs, sizes, begins, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, signature) of every set's PartEnum signatures."""
    first, _ = _bands(threshold)
    band = np.searchsorted(first, sizes, side="right") - 1
    owners, found = [], []
    for up in (0, 1):  # its own band, and the next one where that holds large enough partners
        in_band = band + up
        take = (sizes > 0) & ((up == 0) | (100 * sizes >= threshold * first[np.clip(in_band, 0, len(first) - 1)]))
        k = _differences(np.clip(in_band, 0, len(first) - 1), threshold)
        take &= k >= 1  # else only equal sets link, and these share their id
        docs = np.flatnonzero(take)
        if not len(docs):
            continue
        parts, _ = _parts(k[docs])
        cell_begins = np.concatenate([[0], np.cumsum(parts * 3)])
        lengths = sizes[docs]
        member = np.repeat(np.arange(len(docs)), lengths)
        total = int(lengths.sum())
        source = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(begins[docs], lengths)
        h = runs[source]
        placed = mix(h ^ _PART_SALT)
        part = (placed >> np.uint64(8)) % parts[member].astype(np.uint64)
        cell = cell_begins[member] + part.astype(np.int64) * 3 + ((placed & np.uint64(255)) % np.uint64(3)).astype(np.int64)
        cells = np.zeros(int(cell_begins[-1]), dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(cells, cell, mix(h ^ _CELL_SALT))
            who = np.repeat(np.arange(len(docs)), parts)
            number = (np.arange(len(who)) - np.repeat(np.cumsum(parts) - parts, parts)).astype(np.uint64)
            base = mix(number * np.uint64(0x9E3779B97F4A7C15) + in_band[docs][who].astype(np.uint64) * np.uint64(0x510E527FADE682D1))
            for c, d in ((0, 1), (0, 2), (1, 2)):
                owners.append(docs[who])
                sig = mix(base + np.uint64(c * 3 + d) + mix(cells[c::3] + np.uint64(c + 1)) * np.uint64(0x1F83D9ABFB41BD6B) + mix(cells[d::3] + np.uint64(d + 7)))
                found.append(sig & ~np.uint64(1) | (in_band[docs][who] & 1).astype(np.uint64))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(found) & _SIGNATURE_MASK


def _signature_rows(width: int, threshold: int):
    """Rows (place, node, sig): sharers of a signature among SIGNATURES_AT_ONCE go to its first node (their head).

    Only heads go on under their signature; so a signature that a third of all
    texts share reaches the shuffle once for so many.
    """

    def over(batch):
        sigs, nodes, held = [], [], 0
        for _, _, runs, sizes, begins, ids in text_sets(batch.column(0), width):
            _, keep = np.unique(ids, return_index=True)
            keep = np.sort(keep)
            lengths = sizes[keep]
            source = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(begins[keep], lengths)
            owner, found = signatures(runs[source], lengths, np.concatenate([[0], np.cumsum(lengths)])[:-1], threshold)
            sigs.append(found.view(np.int64))
            nodes.append(ids[keep][owner])
            held += len(found)
            if held >= SIGNATURES_AT_ONCE:
                yield from rows(np.concatenate(sigs), np.concatenate(nodes))
                sigs, nodes, held = [], [], 0
        if sigs:
            yield from rows(np.concatenate(sigs), np.concatenate(nodes))

    def rows(sig, node):
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new_sig = np.ones(len(sig), dtype=bool)
        new_sig[1:] = sig[1:] != sig[:-1]
        fresh = new_sig.copy()
        fresh[1:] |= node[1:] != node[:-1]
        head = node[np.maximum.accumulate(np.where(new_sig, np.arange(len(sig)), 0))]
        sig, node, head = sig[fresh], node[fresh], head[fresh]
        order = np.argsort(node, kind="stable")  # equal nodes side by side: shuffle files shrink by half
        sig, node, head = sig[order], node[order], head[order]
        own = head == node
        led = own & np.isin(sig, sig[~own])  # heads with members here: one more row, as a member of their own
        sig, node = np.concatenate([sig, sig[led]]), np.concatenate([node, node[led]])
        own = np.concatenate([own, np.zeros(int(led.sum()), dtype=bool)])
        place = np.where(own, sig, (mix(node.view(np.uint64) ^ sig.view(np.uint64)) & _SIGNATURE_MASK).view(np.int64))
        for at in range(0, len(sig), 50_000):
            to = at + 50_000
            # a head's row says its signature by its place alone
            yield {"place": place[at:to], "node": node[at:to], "sig": pa.array(sig[at:to], mask=own[at:to])}

    return over


def _shared(batches):
    """Of rows sorted by (sig, node), (sig, node) of signatures that several nodes share; some rows more than once.

    Works through runs that cross batches with one row held back; rows whose
    head is another node pass through.
    """
    release_worker_state()
    held_sig = held_node = None
    held_out = False
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(1).to_numpy(zero_copy_only=False)
        local = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        sig = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
        sig = np.where(local, sig, batch.column(0).to_numpy(zero_copy_only=False))
        out_s, out_n = [sig[local]], [node[local]]
        s, n = sig[~local], node[~local]
        if len(s):
            carried = held_sig is not None
            if carried:
                s, n = np.concatenate([[held_sig], s]), np.concatenate([[held_node], n])
            begins = np.ones(len(s), dtype=bool)
            begins[1:] = s[1:] != s[:-1]
            at = np.maximum.accumulate(np.where(begins, np.arange(len(s)), 0))
            first = n[at]
            differs = n != first
            size = np.zeros(len(s), dtype=bool)
            size[at[differs]] = True  # heads of runs with another node
            emit = differs | size
            if carried and held_out:
                emit[0] = False
            out_s.append(s[emit]), out_n.append(n[emit])
            last = at[-1]
            held_out = bool(size[last]) or (last == 0 and carried and held_out)
            held_sig, held_node = s[-1], first[-1]
        s, n = np.concatenate(out_s), np.concatenate(out_n)
        if len(s):
            yield pa.RecordBatch.from_pydict({"sig": s.astype(np.int64), "node": n.astype(np.int64)})


def _set_rows(width: int, bits: int = 0):
    """(node, n, parity) with a sketch of ``bits`` cells, or (node, n, elements) with the set itself."""

    def over(batch):
        for at, to, runs, sizes, begins, ids in text_sets(batch.column(0), width):
            _, keep = np.unique(ids, return_index=True)
            keep = keep[sizes[keep] > 0]
            if bits:
                yield {"node": ids[keep], "n": sizes[keep], "parity": pa.array(_parities(runs, begins[keep], sizes[keep], bits), pa.binary())}
            else:
                raw = runs.tobytes()
                yield {"node": ids[keep], "n": sizes[keep], "elements": pa.array([raw[8 * begins[i] : 8 * begins[i + 1]] for i in keep], pa.binary())}

    return over


def _parities(runs, begins, sizes, least: int) -> list[bytes]:
    """Each set's sketch: parities of its elements over hash cells, packed.

    Cells that differ between two sets never outnumber the elements that do, so
    they bound the difference from below, exactly.  Sets of up to LARGE elements
    have ``least`` cells, larger ones at least twice their elements, in
    powers of two, so that a longer sketch folds to a shorter one.
    """
    out = []
    for begin, n in zip(begins[: len(sizes)].tolist(), sizes.tolist(), strict=True):
        bits = least if n <= LARGE else max(least, 1 << (2 * n - 1).bit_length())
        cells = (runs[begin : begin + n] >> np.uint64(17)) & np.uint64(bits - 1)
        out.append(np.packbits((np.bincount(cells.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes())
    return out


def _matrices(sketches) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, sketches as rows of bytes) for every length of sketch."""
    lengths = np.array([len(x) for x in sketches], dtype=np.int64)
    out = []
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        out.append((at, np.frombuffer(b"".join(sketches[i] for i in at), dtype=np.uint8).reshape(len(at), length)))
    return out


def _folded(rows: np.ndarray, length: int) -> np.ndarray:
    """Sketches of ``length`` bytes, as 64-bit words: cells that share their low bits are one."""
    if rows.shape[1] > length:
        rows = np.bitwise_xor.reduce(rows.reshape(len(rows), rows.shape[1] // length, length), axis=1)
    return np.ascontiguousarray(rows).view(np.uint64)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of cells that differ."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _verify(threshold: int):
    def over(batch):
        pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        keep = [i for i, (x, y) in enumerate(pairs) if _linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), threshold)]
        picked = batch.take(pa.array(keep, pa.int64()))
        yield {"a": picked.column(0), "b": picked.column(1)}

    return over


def _most(n, m, threshold: int):
    """The most elements by which linked sets of these sizes differ."""
    return (100 - threshold) * (n + m) // (100 + threshold)


def _near(threshold: int):
    """Of rows (a, b, n_a, n_b, parity_a, parity_b), the pairs that sizes and parities allow."""

    def over(batch):
        a, b, n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        keep = 100 * np.minimum(n, m) >= threshold * np.maximum(n, m)
        left, right = _matrices(batch.column(4).to_pylist()), _matrices(batch.column(5).to_pylist())
        for at, rows in left:
            for to, others in right:
                both, x, y = np.intersect1d(at, to, assume_unique=True, return_indices=True)
                length = min(rows.shape[1], others.shape[1])
                keep[both] &= _apart(_folded(rows[x], length), _folded(others[y], length)) <= _most(n[both], m[both], threshold)
        yield {"a": a[keep], "b": b[keep]}

    return over


def _groups(batches):
    """Frames of rows (sig, left, right, ...) that share these three, of batches sorted by them; one frame is held at a time."""
    import pandas as pd

    held = None
    for batch in batches:
        frame = batch.to_pandas()
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        key = frame[["sig", "left", "right"]].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield frame.iloc[a:b]
        held = frame.iloc[cuts[-1] :]
    if held is not None:
        yield held


def _near_in_block(group, tiers, threshold: int):
    """(places, places) of nodes of a pair of blocks, of different roots, that sizes and sketches allow to link."""
    node, root, n, block = (group[k].to_numpy() for k in ("node", "root", "n", "block"))
    left, right = int(group["left"].iloc[0]), int(group["right"].iloc[0])
    for at, rows in tiers:
        for to, others in tiers:
            length = min(rows.shape[1], others.shape[1])
            x, y = block[at] == left, block[to] == right
            one, two, p, q = at[x], to[y], _folded(rows[x], length), _folded(others[y], length)
            for k in range(0, len(one), 128):
                i = one[k : k + 128]
                ok = root[i][:, None] != root[two][None, :]
                if left == right:
                    ok &= node[i][:, None] < node[two][None, :]
                ok &= 100 * np.minimum(n[i][:, None], n[two][None, :]) >= threshold * np.maximum(n[i][:, None], n[two][None, :])
                r, c = np.nonzero(ok)
                for g in range(0, len(r), 20_000):
                    s, t = r[g : g + 20_000], c[g : g + 20_000]
                    near = _apart(p[k + s], q[t]) <= _most(n[i[s]], n[two[t]], threshold)
                    yield i[s[near]], two[t[near]]


def _open_rows(threshold: int):
    """Of rows (sig, left, right, node, root, n, block, parity) sorted by the first three: (sig, node) of the nodes with an allowed partner.

    Each group is a pair of blocks of at most about BLOCK_ROWS nodes of a
    signature (or a block with itself).  Its pairs stay in the task; what
    leaves it is no more than the rows of the group.  Pairs that the task has
    met under an earlier signature do not count again; it remembers so many at
    a time.
    """

    def over(batches):
        release_worker_state()
        met: set[tuple[int, int]] = set()
        for group in _groups(batches):
            node = group["node"].to_numpy()
            found = list(_near_in_block(group, _matrices(group["parity"].tolist()), threshold))
            x, y = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            if 0 < len(x) <= MET_PAIRS:
                keys = list(zip(np.minimum(node[x], node[y]).tolist(), np.maximum(node[x], node[y]).tolist(), strict=True))
                fresh = np.array([k not in met for k in keys])
                x, y = x[fresh], y[fresh]
                if len(met) > MET_PAIRS:
                    met.clear()
                met.update(keys)
            if len(x):
                at = np.unique(np.concatenate([x, y]))
                yield pa.RecordBatch.from_pydict({"sig": np.full(len(at), group["sig"].iloc[0], dtype=np.int64), "node": node[at]})

    return over


def _forest(threshold: int):
    """Of rows (sig, left, right, node, root, n, block, elements) sorted by the first three: links (a, b) that span what the group's links join.

    Pairs are verified on the whole sets in the task, and only while their
    nodes are not joined yet: a group of m nodes gives m - 1 links at most.
    """

    def over(batches):
        release_worker_state()
        for group in _groups(batches):
            node, root, n = (group[k].to_numpy() for k in ("node", "root", "n"))
            sets = [np.frombuffer(x, dtype=np.uint64) for x in group["elements"]]
            tiers = _matrices(_parities(np.concatenate(sets), np.cumsum([0, *(len(x) for x in sets)]), n, FINE_BITS))
            above: dict[int, int] = {}

            def top(r):
                while r in above:
                    r = above[r]
                return r

            a, b = [], []
            for x, y in _near_in_block(group, tiers, threshold):
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    p, q = top(int(root[i])), top(int(root[j]))
                    if p != q and _linked(sets[i], sets[j], threshold):
                        above[max(p, q)] = min(p, q)
                        a.append(node[i]), b.append(node[j])
            if a:
                yield pa.RecordBatch.from_pydict({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    return over


def _near_pairs(pairs: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b), those that sizes and the sketches (node, n, parity) allow."""
    of = lambda x: sketches.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "parity_a", "parity_b")
    return materialise(arrow_map(joined, _near(threshold), "a long, b long"))


def _ends(pairs: DataFrame) -> DataFrame:
    """The nodes of pairs (a, b)."""
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _owned(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """One text of every wanted node."""
    owners = materialise(nodes.join(wanted, "node", "left_semi").select("owner"))
    return texts.join(_small(owners), F.col("doc_id").eqNullSafe(F.col("owner")), "left_semi").select("text")


def _small(df: DataFrame) -> DataFrame:
    """``df``, a written table, marked for broadcast if it has few enough rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """Of pairs (a, b), those whose sets are similar enough: the texts of their nodes are read again, and only these."""
    sketches = materialise(arrow_map(_owned(_ends(pairs), nodes, texts), _set_rows(width, FINE_BITS), "node long, n long, parity binary"))
    fine = _near_pairs(pairs, sketches, threshold)
    sets = materialise(arrow_map(_owned(_ends(fine), nodes, texts), _set_rows(width), "node long, n long, elements binary"))
    of = lambda x: sets.select(F.col("node").alias(x), F.col("elements").alias(f"set_{x}"))
    joined = fine.join(of("a"), "a").join(of("b"), "b")
    return materialise(arrow_map(joined.select("a", "b", "set_a", "set_b"), _verify(threshold), "a long, b long").distinct())


def _kept_signatures(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sig, node) of ``shared`` without the spare signatures of each node: its most frequent ones, band by band.

    The order (frequency, then signature) is the same for all nodes.
    """
    frequent = materialise(shared.groupBy("sig").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > FREQUENT))
    counted = shared.join(_small(frequent), "sig", "left")
    parity = F.col("sig").bitwiseAND(F.lit(1))
    rank = F.row_number().over(W.partitionBy("node", "parity").orderBy(F.desc("m"), "sig"))
    hot = counted.where("m is not null").withColumn("parity", parity).join(nodes.select("node", "spare_even", "spare_odd"), "node")
    hot = hot.withColumn("rank", rank).where(F.col("rank") > F.when(F.col("parity") == 0, F.col("spare_even")).otherwise(F.col("spare_odd")))
    return counted.where("m is null").select("sig", "node").unionByName(hot.select("sig", "node"))


def _open_groups(placed: DataFrame, measure, limit: int) -> DataFrame:
    """(sig, low, low_blocks, blocks) of the signatures whose rows (sig, node, root, n) hold several roots; of those with the same nodes, one.

    Groups whose ``measure`` (a column, summed) is beyond ``limit`` are cut into
    blocks: ``low_blocks`` for the nodes of the least root, which need no
    comparison among themselves, and ``blocks`` for the others.
    """
    sized = placed.withColumn("w", measure.cast("long"))
    found = sized.groupBy("sig").agg(
        F.min("root").alias("low"),
        F.max("root").alias("high"),
        F.sum("w").alias("w"),
        F.count(F.lit(1)).alias("m"),
        F.bit_xor(F.xxhash64("node")).alias("h"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("g"),
    )
    groups = materialise(found.where("low <> high").groupBy("m", "h", "g").agg(F.min(F.struct("sig", "low", "w")).alias("x")).select("x.*"))
    large = groups.where(F.col("w") > limit).select("sig", "low")
    others = sized.join(large, "sig").where("root <> low").groupBy("sig").agg(F.sum("w").alias("others"))
    blocks = lambda x: F.ceil(x / limit).cast("int")
    return materialise(
        groups.join(others, "sig", "left").select("sig", "low", F.coalesce(blocks(F.col("w") - F.col("others")), F.lit(0)).alias("low_blocks"), F.coalesce(blocks(F.col("others")), F.lit(1)).alias("blocks"))
    )


def _dealt(placed: DataFrame, groups: DataFrame, extra: DataFrame, column: str, partitions: int) -> DataFrame:
    """Rows of the groups' pairs of blocks: (sig, left, right, node, root, n, block, ``column`` of ``extra`` by node), sorted by the first three."""
    rows = placed.join(_small(groups), "sig").join(extra.select("node", column), "node")
    apart = (F.col("low_blocks") > 0) & (F.col("root") == F.col("low"))  # blocks below 0
    block = F.when(apart, -1 - F.pmod(F.xxhash64("node"), F.col("low_blocks"))).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.when(apart, 0).otherwise(-F.col("low_blocks")), F.col("blocks") - 1))
    rows = rows.withColumn("block", block.cast("int")).withColumn("other", other)
    rows = rows.select("sig", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "node", "root", "n", "block", column)
    return rows.repartition(partitions, "sig", "left", "right").sortWithinPartitions("sig", "left", "right")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, threshold: int = 85) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    Two texts link when ``100 * |A & B| >= threshold * |A | B|`` over their
    distinct ``width``-word shingles (ASCII letters lower-cased; a text with
    fewer words has one shingle, its whole sequence); ``component_id`` is the
    smallest id that links reach.  Texts with equal sets form one node.

    Defined cases: null, empty and blank texts have no shingles, n_shingles 0
    and their own id as component; repeated rows and rows with a null id are
    kept (a null id never becomes a component id unless all are null); other
    columns of ``docs`` are ignored, whatever their names; an empty table
    gives an empty result.  Nodes are 64-bit set hashes: two different sets
    collide with probability 2**-64 a pair.

    Scale: signatures are numbers computed from Arrow batches; one shuffle of
    (signature, node) rows, heads of a batch only; frequent signatures are
    passed over as far as the spare parts allow; each node is compared with the
    least node of each signature; only where a signature still holds different
    components are its nodes compared across these, in blocks of bounded size
    and by sketches (128 bytes, more for large sets) whose bound is exact.
    Those blocks give the nodes with an allowed partner, not pairs; among these
    few the whole sets are verified in the task, and only links that join
    something leave it, at most one less than a group has nodes.
    """
    session_for(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def ids(batch):
        keys = batch.column(0)
        for at, to, runs, sizes, begins, nodes in text_sets(batch.column(1), width):
            even, odd = spare_signatures(sizes, threshold)
            yield {"doc_id": keys.slice(at, to - at), "n_shingles": sizes, "node": pa.array(nodes, mask=sizes == 0), "parity": pa.array(_parities(runs, begins, sizes, SKETCH_BITS), pa.binary()), "spare_even": even, "spare_odd": odd}

    members = materialise(arrow_map(rows, ids, "doc_id long, n_shingles long, node long, parity binary, spare_even long, spare_odd long"))
    # one row for each distinct set; its text is read again from the row of the smallest id
    least = ("n_shingles", "parity", "spare_even", "spare_odd")
    nodes = materialise(members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("owner"), *(F.min(c).alias("n" if c == "n_shingles" else c) for c in least)))
    texts = rows.where("text is not null")
    partitions = _partitions(docs)
    signed = arrow_map(texts.select("text"), _signature_rows(width, threshold), "place long, node long, sig long")
    shared = signed.repartition(partitions, "place").sortWithinPartitions("place", "sig", "node").mapInArrow(_shared, "sig long, node long").distinct()
    shared = materialise(shared)
    kept = materialise(_kept_signatures(shared, nodes))
    discard(shared)
    # every node against the least of each of its signatures
    heads = kept.groupBy("sig").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("m")).where("m > 1").select("sig", "b")
    pairs = kept.join(heads, "sig").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    links = _links(_near_pairs(pairs, nodes, threshold), nodes, texts, width, threshold)
    roots = connected_components(links)

    # signatures that still hold nodes of different components: first which nodes have an allowed partner, then these alone, verified
    placed = materialise(kept.join(nodes.select("node", "n"), "node").join(roots, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root"), "n"))
    discard(kept)
    dealt = _dealt(placed, _open_groups(placed, F.lit(1), BLOCK_ROWS), nodes, "parity", partitions)
    open_ = materialise(dealt.mapInArrow(_open_rows(threshold), "sig long, node long").distinct())
    if not open_.isEmpty():
        sets = materialise(arrow_map(_owned(open_.select("node").distinct(), nodes, texts), _set_rows(width), "node long, n long, elements binary"))
        every, placed = placed, materialise(placed.join(_small(open_), ["sig", "node"], "left_semi"))
        discard(every)
        dealt = _dealt(placed, _open_groups(placed, 8 * F.col("n"), BLOCK_BYTES), sets, "elements", partitions)
        more = materialise(dealt.mapInArrow(_forest(threshold), "a long, b long").distinct())
        if not more.isEmpty():
            roots = connected_components(links.unionByName(more))
    keyed = members.join(roots, members["node"] == roots["node"], "left").select(members["doc_id"], members["n_shingles"], F.coalesce(roots["root"], members["node"]).alias("root"))
    keyed = materialise(keyed)
    least = materialise(keyed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1").select("root", "least"))
    return keyed.join(_small(least), "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; columns unchanged.

    Blank texts and rows with a null id stay; rows that repeat the kept id are
    the same document and stay.
    """
    found = jaccard_components(docs, id_col, text_col, width, threshold)
    return without_ids(docs, found.where("doc_id <> component_id").select("doc_id"), id_col)
