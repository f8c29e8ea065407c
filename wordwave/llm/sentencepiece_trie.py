"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

The distinct marked words of a batch are sorted, which lays them out as a
depth-first walk of their trie: a word keeps the forward states of the prefix
it shares with the word before and computes the rest.  A forward state is the
last piece of the best segmentation of a prefix.  For unigram models the best
has the highest score.  For BPE models scores do not add up; there the one
last piece is right that the prefix's segmentation accepts as neighbour, i.e.
that merging the two pieces' characters leaves as these two pieces.  A prefix
of a merged sequence is itself the merged sequence of its text, so exactly one
candidate passes, and the pass gives the library's own result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, session_for, worker_state

MARK = "▁"
#: Characters of text that are encoded at a time; a larger part shares more prefixes.
SLICE_CHARS = 1 << 21
#: Distinct words whose pieces a worker keeps between batches.
CACHE_WORDS = 400_000
_UNITS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


def _fields(data: bytes):
    """(field number, value) of a protocol buffer message."""
    at, n = 0, len(data)

    def varint(at):
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value, at
            shift += 7

    while at < n:
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif key & 7 == 5:
            value, at = data[at : at + 4], at + 4
        else:
            value, at = data[at : at + 8], at + 8
        yield key >> 3, value


class Model:
    """Pieces of a SentencePiece model file with identity normalisation and a dummy prefix."""

    def __init__(self, data: bytes):
        self.pieces, self.kinds, self.scores = [], [], []
        self.bpe, normaliser = False, {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(piece.get(3, 1))
            elif field == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif field == 3:
                normaliser = dict(_fields(value))
        if normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1):
            raise ValueError("only models with identity normalisation, a dummy prefix and kept white space")
        self.vocabulary = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 1}
        self.bytes_ = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 6}
        self.unknown = self.kinds.index(2)
        # a piece is never cut inside by the units: marks stand in front only, and no piece holds a new line
        if any(MARK in p.lstrip(MARK) or ("\n" in p and p != "\n") for p in self.vocabulary):
            raise ValueError("a piece crosses words")
        self.surface = [bytes([int(p[3:5], 16)]) if k == 6 else p.replace(MARK, " ").encode() if k == 1 else b" \xe2\x81\x87 " if k == 2 else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]
        self._accepts: dict[int, bool] = {}  # by a << 20 | b
        self._halves()
        # lengths of the pieces that end in given (up to three) characters, longest first: where a last piece can begin
        made = [p for p, i in self.vocabulary.items() if not self.bpe or len(p) == 1 or self.halves[i] is not None]
        lengths: dict[str, set[int]] = {}
        for p in made:
            lengths.setdefault(p[-3:], set()).add(len(p))
        self.ending = {k: tuple(sorted(v | {n for n in (1, 2) if n < len(k) and k[-n:] in lengths}, reverse=True)) for k, v in lengths.items()}

    def merge(self, text: str) -> list[int]:
        """Pieces by repeated merging of the best-scored neighbours (first among equals): the plain definition of BPE.

        Neighbours that can merge wait in a heap, so that a long run costs its
        length times a logarithm.
        """
        get, scores, n = self.vocabulary.get, self.scores, len(text)
        ends, nexts, befores = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-scores[k], i, i + 1, i + 2) for i in range(n - 1) if (k := get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, middle, end = heapq.heappop(heap)
            if ends[i] != middle or middle >= n or ends[middle] != end:
                continue  # one of the two has been merged since
            ends[i], ends[middle], nexts[i] = end, -1, nexts[middle]
            if nexts[i] < n:
                befores[nexts[i]] = i
                if (k := get(text[i : ends[nexts[i]]])) is not None:
                    heapq.heappush(heap, (-scores[k], i, end, ends[nexts[i]]))
            if (j := befores[i]) >= 0 and (k := get(text[j:end])) is not None:
                heapq.heappush(heap, (-scores[k], j, i, end))
        out, i = [], 0
        while i < n:
            out.append(self.vocabulary.get(text[i], ~ord(text[i])) if ends[i] == i + 1 else self.vocabulary[text[i : ends[i]]])
            i = nexts[i]
        return out

    def _halves(self) -> None:
        """The two pieces that each piece's last merge joins; None for characters and for pieces that merging never makes."""
        self.halves: list[tuple[int, int] | None] = [None] * len(self.pieces)
        if not self.bpe:
            return
        get = self.vocabulary.get
        for piece, i in self.vocabulary.items():
            parts = list(piece)
            while len(parts) > 2:
                joined = [(-self.scores[k], n) for n in range(len(parts) - 1) if (k := get(parts[n] + parts[n + 1])) is not None]
                if not joined:
                    break
                n = min(joined)[1]
                parts[n : n + 2] = [parts[n] + parts[n + 1]]
            if len(parts) == 2 and parts[0] in self.vocabulary and parts[1] in self.vocabulary:
                self.halves[i] = (get(parts[0]), get(parts[1]))

    def accepts(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a (negative: a character without a piece).

        Merging is played backwards at the border: the later of the two
        pieces' last merges is undone, and no piece across the border may have
        been due before it (or, on the right, at the same rank: the leftmost is
        due first).
        """
        if a < 0 or b < 0:
            return True
        known = self._accepts.get(a << 20 | b)
        if known is None:
            if len(self._accepts) > 400_000:
                self._accepts.clear()
            known = self._accepts[a << 20 | b] = self._borders(a, b)
        return known

    def _borders(self, a: int, b: int) -> bool:
        pieces, scores, halves, get = self.pieces, self.scores, self.halves, self.vocabulary.get
        due, equal = -np.inf, False  # a crossing piece is due before a merge of score ``due``
        while True:
            across = get(pieces[a] + pieces[b])
            if across is not None and (scores[across] > due or equal and scores[across] == due):
                return False
            left, right = halves[a], halves[b]
            if left is not None and (right is None or scores[a] < scores[b]):
                due, equal, a = scores[a], False, left[1]
            elif right is not None:
                due, equal, b = scores[b], True, right[0]
            else:
                return True

    def out(self, ids) -> tuple[int, ...]:
        """Byte pieces in place of characters without a piece."""
        if not ids or min(ids) >= 0:
            return tuple(ids)
        return tuple(chain.from_iterable([i] if i >= 0 else [self.bytes_.get(b, self.unknown) for b in chr(~i).encode()] for i in ids))

    def encode_words(self, words) -> dict[str, tuple[int, ...]]:
        """Pieces of distinct words, in one depth-first walk over the trie of the sorted words."""
        found: dict[str, tuple[int, ...]] = {}
        get, ending, scores, accepts, memo, bpe = self.vocabulary.get, self.ending.get, self.scores, self.accepts, self._accepts, self.bpe
        unknown_score = min(scores) - 10.0
        size = max(map(len, words), default=0) + 1
        last, begin, best = [None] * size, [0] * size, [0.0] * size
        previous = ""
        for word in sorted(words):
            if bpe and word[:2] == MARK * 2:
                found[word] = self.out(self.merge(word))  # runs of marks tie in score; few words have them
                continue
            n, most = 0, min(len(word), len(previous))
            while n < most and word[n] == previous[n]:
                n += 1
            for i in range(n + 1, len(word) + 1):
                pick, start, top = ~ord(word[i - 1]), i - 1, -np.inf
                near = ending(word[i - 3 : i]) if i > 2 else None
                for length in near or ending(word[i - 2 : i] if i > 1 else word[0]) or ending(word[i - 1]) or ():
                    j = i - length
                    if j < 0:
                        continue
                    piece = get(word[j:i])
                    if piece is None:
                        continue
                    if bpe:
                        before = last[j]
                        if before is None or before < 0:
                            pick, start = piece, j
                            break
                        ok = memo.get(before << 20 | piece)
                        if ok or ok is None and accepts(before, piece):
                            pick, start = piece, j
                            break
                    elif best[j] + scores[piece] > top:
                        pick, start, top = piece, j, best[j] + scores[piece]
                last[i], begin[i] = pick, start
                if not bpe:
                    best[i] = top if pick >= 0 else best[start] + unknown_score
            previous = word
            ids, i = [], len(word)
            while i > 0:
                ids.append(last[i])
                i = begin[i]
            ids.reverse()
            found[word] = self.out(ids)
        return found

    def units(self, text: str) -> list[str]:
        """Marked words of a text; pieces never cross them."""
        return _UNITS.findall(MARK + text.replace(" ", MARK)) if text else []

    def decode(self, ids) -> str:
        """The text of pieces; bytes that are no UTF-8 become U+FFFD each, as in the library."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _worker_state(model_bytes: bytes) -> tuple[Model, dict]:
    """Model and word cache of this worker process, kept between tasks."""
    return worker_state(("sentencepiece", zlib.crc32(model_bytes)), lambda: (Model(model_bytes), {}))


def encode_decode(docs: DataFrame, model_bytes: bytes, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), cache_words: int = CACHE_WORDS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_ok) and the columns ``keep`` of every whole text.

    ``decoded_ok`` says that decoding the ids gives the text again (U+2581 in a
    text comes back as a space, as in the library).  Null and empty texts have
    no pieces; repeated rows and null ids are kept; other columns, also such as
    are named n_tokens or ids, are ignored unless in ``keep``; of these, the ones
    named as a result are replaced by it; an empty table
    gives an empty result.  One pass without a shuffle; the model file (half a
    megabyte) is sent to the executors; a worker keeps about ``cache_words``
    words between slices of ``slice_chars`` characters, which trades memory for
    time and changes no result.
    """
    session_for(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model_bytes)
    kept = [c for c in docs.columns if c in keep and c not in ("n_tokens", "ids", "decoded_ok")]
    names = ["doc_id"] + [c for c in kept if c not in ("doc_id", "__text")]
    rows = docs.select(*(F.col(id_col).cast("long").alias("doc_id") if c == "doc_id" else F.col(c) for c in names), F.col(text_col).cast("string").alias("__text"))
    n_names = len(names)

    def over(batch):
        model, cache = _worker_state(sent.value)
        texts = batch.column(n_names).to_pylist()
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < slice_chars):
                size += len(texts[to] or "")
                to += 1
            cut = [model.units(t or "") for t in texts[at:to]]
            present = set(chain.from_iterable(cut))
            new = present.difference(cache)
            if len(cache) + len(new) > cache_words:  # what this slice needs stays: frequent words are among it
                kept_words = {w: cache[w] for w in present - new}
                cache.clear()
                cache.update(kept_words)
            cache.update(model.encode_words(new))
            look, arrays, good = cache.__getitem__, [], []
            for text, words in zip(texts[at:to], cut, strict=True):
                ids = list(chain.from_iterable(map(look, words)))
                good.append(model.decode(ids) == (text or "").replace(MARK, " "))
                arrays.append(np.array(ids, dtype=np.int32))
            lengths = np.array([len(x) for x in arrays], dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
            yield {n: batch.column(i).slice(at, to - at) for i, n in enumerate(names)} | {"n_tokens": lengths, "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), "decoded_ok": pa.array(good)}
            at = to

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n_names])
    return arrow_map(rows, over, f"{columns}, n_tokens long, ids array<int>, decoded_ok boolean", keeps_state=True)
