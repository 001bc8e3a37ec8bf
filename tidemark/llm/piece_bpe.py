"""Encoding and decoding with a SentencePiece BPE model, as vectorised merge rounds.

A text is cut into words (a blank run and what follows it; no piece of the model holds a blank after
another character, so no merge crosses). The words of a batch that are new lie in one flat array of
symbols. In each round every word finds the smallest rank among its neighbouring pairs by a segmented
minimum, merges all places that have it, leftmost first and without overlap, and the array is
compacted; words without a pair leave. Ranks order pieces by score, as the model does. Where a merged
piece could at once join its neighbour at the same or a better rank, a word merges one place a round
only, the leftmost; this keeps the order of single merges. Runs of blanks have equal scores for all
lengths; as that lets single merges fill the longest piece from the left, they are laid out directly.

Symbols that are no pieces become their UTF-8 bytes. Decoding joins the pieces' bytes by table,
drops the blank that encoding puts in front, and reads invalid bytes as U+FFFD.

Cases: a null text is empty and has the end id only. Blanks of all kinds but U+0020 are ordinary
characters. U+2581 in a text reads back as a blank, as with the library. A word of more than LONG
characters could need a round for nearly each of them; it is merged through a queue of its pairs
instead, in time that grows little faster than its length.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BLANK = "▁"
#: Words a task remembers.
MEMORY = 700_000
#: Characters of a word that rounds are for.
LONG = 2_000
_WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_NONE = np.int64(1 << 40)
#: Symbols from here on are characters that are no pieces.
_CHARS = 1 << 20


class PieceModel:
    """The tables of a model: pieces by id, pairs that merge, bytes."""

    def __init__(self, proto: bytes) -> None:
        lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        self.end = lib.eos_id()
        ordinary = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.piece = {names[i]: i for i in ordinary}
        self.byte = {int(names[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        text = {i: names[i].replace(BLANK, " ").encode() for i in ordinary}
        text |= {i: bytes([b]) for b, i in self.byte.items()}
        text |= {i: " ⁇ ".encode() for i in range(n) if lib.is_unknown(i)}
        self.text = [text.get(i, b"") for i in range(n)]
        self.starts_blank = np.array([i in text and names[i].startswith(BLANK) for i in range(n)])
        self.runs = max((len(names[i]) for i in ordinary if set(names[i]) == {BLANK}), default=1)
        scores = {i: lib.get_score(i) for i in ordinary}
        runs = {scores[i] for i in ordinary if set(names[i]) == {BLANK} and len(names[i]) > 1}
        if len(runs) > 1 or runs and min(scores.values()) not in runs:
            raise ValueError("runs of blanks must share the lowest score")
        rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        for i in ordinary:
            name = names[i]
            if set(name) == {BLANK} and len(name) > 1:
                continue  # laid out directly
            for cut in range(1, len(name)):
                left, right = self._symbol(name[:cut]), self._symbol(name[cut:])
                if left is not None and right is not None:
                    pairs[left << 21 | right] = (rank[scores[i]], i)
        keys = sorted(pairs)
        self.keys = np.array(keys or [-1], np.int64)
        self.ranks = np.array([pairs[k][0] for k in keys] or [_NONE], np.int64)
        self.merged = np.array([pairs[k][1] for k in keys] or [0], np.int64)
        self._by_key: dict[int, tuple[int, int]] | None = None
        # ranks whose piece may join a neighbour at no worse a rank, or that several pieces share
        of_piece = {i: rank[scores[i]] for i in ordinary}
        shared: set[int] = set()
        seen: dict[int, int] = {}
        for k, (r, m) in pairs.items():
            if seen.setdefault(r, m) != m:
                shared.add(r)
            for side in (k >> 21, k & (1 << 21) - 1):
                if side < _CHARS and side in of_piece and r <= of_piece[side] and len(names[side]) > 1:
                    shared.add(of_piece[side])
        self.single = np.zeros(len(rank) + 1, bool)
        self.single[list(shared)] = True

    def _symbol(self, s: str) -> int | None:
        found = self.piece.get(s)
        return found if found is not None else _CHARS + ord(s) if len(s) == 1 else None

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 21 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; a word holds a blank in front at most."""
        short = [w for w in words if len(w) <= LONG]
        by_rounds = iter(self._rounds(short))
        return [next(by_rounds) if len(w) <= LONG else self._with_bytes(self._queued(w)) for w in words]

    def _queued(self, word: str) -> np.ndarray:
        """Symbols of one word: pairs wait by rank, then from the left, and are looked at again when they come."""
        points = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.int64)
        distinct, back = np.unique(points, return_inverse=True)
        symbols = np.array([self._symbol(chr(p)) for p in distinct.tolist()], np.int64)[back]
        rank, _ = self._pairs(symbols[:-1], symbols[1:])
        at, n = symbols.tolist(), len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        # a pair is its place and both symbols; one that is no longer there is passed over
        waiting = [(r, i, at[i], at[i + 1]) for i, r in enumerate(rank.tolist()) if r < _NONE]
        heapq.heapify(waiting)
        pairs = self._table()
        while waiting:
            _, i, left, right = heapq.heappop(waiting)
            j = after[i]
            if at[i] != left or j >= n or at[j] != right:
                continue
            at[i], at[j] = pairs[left << 21 | right][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    new = pairs.get(at[a] << 21 | at[b])
                    if new is not None:
                        heapq.heappush(waiting, (new[0], a, at[a], at[b]))
        return np.array([x for x in at if x >= 0], np.int64)

    def _table(self) -> dict[int, tuple[int, int]]:
        if self._by_key is None:
            self._by_key = {k: (r, m) for k, r, m in zip(self.keys.tolist(), self.ranks.tolist(), self.merged.tolist(), strict=True)}
        return self._by_key

    def _rounds(self, words: list[str]) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        distinct, back = np.unique(points, return_inverse=True)
        symbols = np.array([self._symbol(chr(p)) for p in distinct.tolist()], np.int64)[back]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, merged = self._next(symbols, word)
        while len(symbols):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(word)))
            alive = np.repeat(least < _NONE, length)
            if not alive.all():
                done.append((word[~alive], symbols[~alive]))
                symbols, word, rank, merged = symbols[alive], word[alive], rank[alive], merged[alive]
                if not len(symbols):
                    break
                length, least = length[least < _NONE], least[least < _NONE]
            least = np.repeat(least, length)
            at = np.flatnonzero(rank == least)
            # of places that touch, every second from the left of their run
            gap = np.diff(at, prepend=-2) > 1
            run = np.maximum.accumulate(np.where(gap, np.arange(len(at)), 0))
            one = self.single[rank[at]]
            new_word = np.diff(word[at], prepend=-1) != 0
            at = at[np.where(one, new_word, (np.arange(len(at)) - run) % 2 == 0)]
            symbols[at] = merged[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            symbols, word, rank, merged = symbols[keep], word[keep], rank[keep], merged[keep]
            changed = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            self._renew(symbols, word, rank, merged, changed)
        if not done:
            return [np.empty(0, np.int64) for _ in words]
        word, symbols = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        symbols, counts = symbols[order], np.bincount(word, minlength=len(words))
        out = np.split(symbols, np.cumsum(counts)[:-1])
        for w in np.unique(word[order][symbols >= _CHARS]).tolist():
            out[w] = self._with_bytes(out[w])
        return out

    def _next(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, merged = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)
        self._renew(symbols, word, rank, merged, np.arange(len(symbols)))
        return rank, merged

    def _renew(self, symbols: np.ndarray, word: np.ndarray, rank: np.ndarray, merged: np.ndarray, at: np.ndarray) -> None:
        """The pairs that begin at ``at``."""
        rank[at] = _NONE
        at = at[at < len(symbols) - 1]
        at = at[word[at] == word[at + 1]]
        rank[at], merged[at] = self._pairs(symbols[at], symbols[at + 1])

    def _with_bytes(self, ids: np.ndarray) -> np.ndarray:
        out: list[int] = []
        for i in ids.tolist():
            out += [i] if i < _CHARS else [self.byte[b] for b in chr(i - _CHARS).encode()]
        return np.array(out, np.int64)

    def blanks(self, n: int) -> list[int]:
        """Ids of a run of ``n`` blanks that joins nothing else."""
        full, rest = divmod(n, self.runs)
        sizes, at = [1] * rest, 0
        while at < len(sizes) - 1:  # the leftmost pair that makes a piece, then again from the left
            if BLANK * (sizes[at] + sizes[at + 1]) in self.piece:
                sizes[at : at + 2] = [sizes[at] + sizes[at + 1]]
                at = 0
            else:
                at += 1
        return [self.piece[BLANK * s] for s in [self.runs] * full + sizes]

    def decode(self, ids: np.ndarray) -> str:
        ids = ids[ids != self.end]
        out = b"".join([self.text[i] for i in ids.tolist()])
        if len(ids) and self.starts_blank[ids[0]]:
            out = out[1:]
        return out.decode("utf-8", "replace")


class Encoder:
    """Encodes texts word by word and remembers words."""

    def __init__(self, proto: bytes) -> None:
        self.model = PieceModel(proto)
        self.known: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > MEMORY:
            self.known = {}
        new = [w for w in words if w not in self.known]
        for w, ids in zip(new, self.model.encode_words(new), strict=True):
            self.known[w] = ids.astype("<i4").tobytes()

    def _piece(self, part: str) -> bytes:
        """A word with any number of blanks in front of it, or blanks alone."""
        bare = part.lstrip(BLANK)
        n = len(part) - len(bare)
        if n <= 1 and bare:
            return self.known[part]
        ids = np.frombuffer(self.known[BLANK + bare], "<i4") if bare else np.empty(0, "<i4")
        if len(ids) and ids[0] != self.model.piece.get(BLANK):
            n -= 1
        else:
            ids = ids[1:]
        return np.array(self.model.blanks(n), "<i4").tobytes() + ids.tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, the end id last."""
        end = np.array([self.model.end], "<i4").tobytes()
        split, simple = [], []
        for t in texts:
            t = t or ""
            # blanks that stand alone separate words that begin with one
            easy = bool(t) and BLANK not in t and "  " not in t and t[0] != " " and t[-1] != " "
            simple.append(easy)
            split.append(t.split(" ") if easy else _WORDS.findall(BLANK + t.replace(" ", BLANK)) if t else [])
        needed = {w for words, easy in zip(split, simple, strict=True) if easy for w in words}
        words = {BLANK + w for w in needed}
        for parts, easy in zip(split, simple, strict=True):
            if not easy:
                words |= {p if p[0] != BLANK else BLANK + p.lstrip(BLANK) for p in parts}
        self._learn(words - {BLANK})
        known = self.known
        out = []
        for parts, easy in zip(split, simple, strict=True):
            out.append(b"".join([known[BLANK + w] for w in parts] if easy else map(self._piece, parts)) + end)
        return out


@functools.lru_cache(maxsize=1)
def piece_encoder(proto: bytes) -> Encoder:
    """One for all tasks of a worker process, so that they share the words it remembers."""
    return Encoder(proto)


def encode_decode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id_col, ids (array<int>, the end id last), decoded (string)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(sent.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [np.frombuffer(x, "<i4") for x in encoder.encode(texts)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            decoded = pa.array([encoder.model.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), decoded], names=["id", "ids", "decoded"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(run, "id long, ids array<int>, decoded string")
    return out.select(F.col("id").alias(id_col), "ids", "decoded")
