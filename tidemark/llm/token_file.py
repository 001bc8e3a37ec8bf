"""Token-ID files: frequency-ranked ids in byte-aligned variable-length coding.

Texts are tokenized once. The ids' counts over the whole corpus rank them: the 256 commonest take one
byte, the next 65,280 two, and so on up to four. Lengths are kept apart from the data, as two bits an
id in control bytes, and are read by table lookup: a control byte gives four lengths at once, their
running sums the places of all bytes of a block.

A dataset is a folder: ``ranks.bin`` (ids by rank, 32-bit little-endian) and one file per range of
document ids, in ascending order. A file is MAGIC and then blocks of whole documents: BLOCK_HEAD
(documents, ids, control bytes, data bytes), the documents' ids, their null flags and numbers of
tokens, the control bytes (each document's filled up to a whole byte), the data. An index table
(file, place and size of each block, first token) tells where everything is.

Files are cut in two levels. Rows are dealt to ranges of keys, at rows of a random sample of bounded size
(SHARE of them or more a range, so that ranges are even); each range is sorted by one task, which begins a
new file wherever its own running sum of ids has filled one. So files hold about FILE bytes of ids whatever
the corpus; what grows beyond SAMPLE / SHARE ranges is how many files a task writes one after the other.
Rows that share a doc_id may lie in several files.

Cases: a null text is empty and has the end id only. A null doc_id comes first. Rows that share a
doc_id follow each other by the hash of their ids; rows that are equal in both are interchangeable. An
empty table gives a file without blocks. Very long texts are one block of their own. A tokenizer whose
normalizer or splitting isn't the one that words can be cut by gets whole texts.
"""

from __future__ import annotations

import functools
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import small_batches, written
from .files import Replacing, opened

MAGIC = b"TIDETOK1"
BLOCK_HEAD = struct.Struct("<QQQQ")
#: Ids of a block, and bytes of coded ids of a file, about.
BLOCK, FILE = 1 << 18, 32 << 20
#: Rows (about) that the limits of ranges are taken from, and as many of them a range as make it even.
SAMPLE, SHARE = 1_000_000, 16
#: Words a tokenizing task remembers.
MEMORY = 2_000_000
#: The normalizer and the splitting under which blanks part words, case doesn't count and no piece
#: holds letters and a bar.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([^\sA-Za-z0-9À-ÖØ-öø-ÿ]*)")


class WordTokenizer:
    """Ids of whole texts from a tokenizer that drops white space, so that words can be encoded apart.

    ``by_word`` says whether the model is of that kind; texts go to any other as they are. Else texts are cut at blanks and line ends only. A word of plain letters with plain punctuation after
    it is encoded as those two parts; any other piece is encoded as it is. Each part goes to the
    tokenizer once and is then remembered.
    """

    def __init__(self, model: str) -> None:
        self.tokenizer = Tokenizer.from_str(model)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {"": b""}
        told = json.loads(model)
        normal, split = (told.get("normalizer") or {}).get("normalizers", []), (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        self.by_word = [n["type"] for n in normal] == NORMALIZERS and normal[1] == blanks and split[:1] == [SPLIT] and not told.get("post_processor")
        self.bar = self.tokenizer.encode("|", add_special_tokens=False).ids

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """Letter runs, many a call: the bar between two of them shows where each ends."""
        if len(self.bar) != 1:
            return {p: np.array(e.ids, self.kind).tobytes() for p, e in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False), strict=True)}
        out: dict[str, bytes] = {}
        for at in range(0, len(parts), 500):
            some = parts[at : at + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" | ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            raw, size = ids.tobytes(), self.kind.itemsize
            bars = (np.flatnonzero(ids == self.bar[0]) * size).tolist()
            out |= {p: raw[a:b] for p, a, b in zip(some, [0, *[b + size for b in bars]], [*bars, len(raw)], strict=True)}
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        known = self.known
        missing = set().union(*split).difference(known)
        if len(known) + len(missing) > MEMORY:
            self.known = known = {"": b""}
            missing = {w for words in split for w in words if w}
        plain, odd = {}, []
        for w in missing:
            m = _PLAIN.fullmatch(w)
            if m and m[2].isascii():
                plain[w] = (m[1].lower(), m[2])
            else:
                odd.append(w)
        marks = {p for _, p in plain.values() if p and p not in known}
        odd += marks
        for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, self.kind).tobytes()
        letters = {a for a, _ in plain.values() if a not in known}
        known |= self._learn(list(letters))
        for w, (a, p) in plain.items():
            known[w] = known[a] + known[p]
        return [b"".join(map(known.__getitem__, words)) for words in split]


@functools.lru_cache(maxsize=1)
def word_tokenizer(model: str) -> WordTokenizer:
    """One for all tasks of a worker process, so that they share the words it remembers."""
    return WordTokenizer(model)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data of one document's ranks."""
    sizes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = sizes - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    columns = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), columns[np.arange(4) < sizes[:, None]].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All ranks of a block; ``counts``: ranks of each document."""
    sizes = _LENGTHS[control].reshape(-1)
    filled = -(-counts // 4) * 4
    # what fills up a document's last control byte has no data
    if len(counts):
        first = np.repeat(np.cumsum(filled) - filled, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        sizes = sizes[first]
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    more = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    out = more[at]
    for k in range(1, 4):
        out |= np.where(sizes > k, more[at + k] << np.uint32(8 * k), np.uint32(0))
    return out


def tokenized(docs: DataFrame, id_col: str, text_col: str, model: str, end_id: int) -> DataFrame:
    """(id, none, ids): none where the id is null; the ids as little-endian 16-bit integers (32-bit in larger vocabularies)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_tokenizer(sent.value)
        end = np.array([end_id], words.kind).tobytes()
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "none": batch["none"], "ids": [x + end for x in words.encode(batch["text"].tolist())]})

    # ids stay whole numbers in pandas, where a null would make them floats
    whole = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)))
    return docs.select(whole.alias("id"), F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{text_col}`").alias("text")).mapInPandas(run, "id long, none boolean, ids binary")


def _ranked(tokens: DataFrame, kind: np.dtype, vocabulary: int) -> np.ndarray:
    """All ids of the vocabulary, the commonest first; what comes to the driver is one count an id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch["ids"]), kind), minlength=vocabulary)
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"token": seen, "n": counts[seen]})

    counts = np.zeros(vocabulary, np.int64)
    for r in tokens.select("ids").mapInPandas(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[r["token"]] = r["n"]
    return np.argsort(-counts, kind="stable").astype("<u4")


def write_tokens(docs: DataFrame, path: str, model: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the dataset under ``path``; returns its index: file_no, file, place, size, first, docs, tokens.
    ``first`` counts the ids before a block in its file."""
    spark = docs.sparkSession
    words = WordTokenizer(model)
    kind, vocabulary = words.kind, max(words.tokenizer.get_vocab_size(), end_id + 1)
    tokens = written(tokenized(docs, id_col, text_col, model, end_id), "tokens")
    ranked = _ranked(tokens, kind, vocabulary)
    with Replacing(f"{path}/ranks.bin") as out:
        out.write(ranked.tobytes())
    rank_of = np.empty(vocabulary, np.uint32)
    rank_of[ranked] = np.arange(vocabulary, dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank_of)

    edges = _edges(tokens, spark.sparkContext.defaultParallelism)
    rows = tokens.select("id", "none", F.xxhash64("ids").alias("h"), "ids")

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = 0
        for batch in batches:
            ranks = [sent.value[np.frombuffer(x, kind)] for x in batch["ids"]]
            both = [pack(r) for r in ranks]
            keys = _keys(batch["none"], batch["id"], batch["h"])
            # equal rows may go to either side of an edge at them, so that a hot one is spread over its files
            low, high = np.searchsorted(edges, keys, side="left"), np.searchsorted(edges, keys, side="right")
            part = low + (np.arange(turn, turn + len(batch)) % (high - low + 1))
            turn += len(batch)
            yield pd.DataFrame({"part": part, "id": batch["id"], "none": batch["none"], "h": batch["h"], "n": [len(r) for r in ranks], "control": [c for c, _ in both], "data": [d for _, d in both]})

    coded = rows.mapInPandas(code, "part int, id long, none boolean, h long, n long, control binary, data binary")
    ranged = coded.repartitionById(len(edges) + 1, "part").sortWithinPartitions(F.desc("none"), "id", "h")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, index = TaskContext.get().partitionId(), []
        rows = (row for batch in batches for row in zip(batch["id"], batch["none"], batch["n"], batch["control"], batch["data"], strict=True))
        row = next(rows, None)
        while row is not None or not index:
            part = len({x[0] for x in index})
            file, first = f"{path}/part-{number:06d}-{part:06d}.tok", 0
            with Replacing(file) as out:
                out.write(MAGIC)
                while row is not None and out.size < FILE + FILE // 2:
                    held, n = [], 0
                    while row is not None and (not held or n + int(row[2]) <= BLOCK):
                        held.append(row)
                        n += int(row[2])
                        row = next(rows, None)
                    block, place = _block(held), out.size
                    out.write(block)
                    index.append((number << 32 | part, file, place, len(block), first, len(held), n))
                    first += n
            if not index:
                break  # a range without rows leaves a file without blocks
        yield pd.DataFrame(index, columns=["file_no", "file", "place", "size", "first", "docs", "tokens"])

    return written(ranged.select("id", "none", "n", "control", "data").mapInPandas(write, "file_no long, file string, place long, size long, first long, docs long, tokens long"), "index")


def _keys(none: pd.Series, ids: pd.Series, hashes: pd.Series) -> np.ndarray:
    """Keys whose order as bytes is that of the file: rows without an id, then ids, then hashes."""
    out = np.zeros((len(ids), 17), np.uint8)
    out[:, 0] = ~none.to_numpy(bool)
    for at, x in ((1, ids), (9, hashes)):
        up = x.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        out[:, at : at + 8] = up.astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.reshape(-1).view("S17")


def _edges(tokens: DataFrame, least: int) -> np.ndarray:
    """Keys at which a new range begins, so that ranges hold about FILE bytes of ids, or SHARE rows of the sample."""
    n, size = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()
    some = tokens.select("none", "id", F.xxhash64("ids").alias("h"), F.octet_length("ids").alias("size"))
    some = (some.sample(SAMPLE / n, seed=1) if n > SAMPLE else some).toPandas()
    keys = _keys(some["none"], some["id"], some["h"])
    order = np.argsort(keys, kind="stable")
    ranges = max(least, min(-(-size // FILE), len(keys) // SHARE))
    full = np.cumsum(some["size"].to_numpy(np.float64)[order])
    at = np.searchsorted(full, full[-1] * np.arange(1, ranges) / ranges) if len(full) else np.empty(0, int)
    return keys[order][at]


def _block(rows: list[tuple]) -> bytes:
    ids = np.array([r[0] for r in rows], "<i8")
    null = np.array([r[1] for r in rows], np.uint8)
    counts = np.array([r[2] for r in rows], "<u8")
    control, data = b"".join(r[3] for r in rows), b"".join(r[4] for r in rows)
    return BLOCK_HEAD.pack(len(rows), int(counts.sum()), len(control), len(data)) + ids.tobytes() + null.tobytes() + counts.tobytes() + control + data


def read_block(block: bytes, ranked: np.ndarray) -> list[tuple[int | None, np.ndarray]]:
    """(document id, token ids) of each document of a block."""
    docs, tokens, n_control, n_data = BLOCK_HEAD.unpack_from(block)
    at = BLOCK_HEAD.size
    ids = np.frombuffer(block, "<i8", docs, at)
    null = np.frombuffer(block, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(block, "<u8", docs, at + 9 * docs).astype(np.int64)
    at += 17 * docs
    ranks = unpack(np.frombuffer(block, np.uint8, n_control, at), np.frombuffer(block, np.uint8, n_data, at + n_control), counts)
    if len(ranks) != tokens:
        raise ValueError("a block doesn't hold the ids it says")
    parts = np.split(ranked[ranks], np.cumsum(counts)[:-1])
    return [(None if z else int(i), p) for i, z, p in zip(ids, null, parts, strict=True)]


def read_tokens(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """One row per document from the files: id (null where it was), start (ids of all documents before it), ids (little-endian 32-bit)."""
    totals = index.groupBy("file_no").agg(F.sum("tokens").alias("t"))
    before = F.sum("t").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(F.col("file_no").alias("no"), F.coalesce(before, F.lit(0)).alias("start"))
    places = index.join(starts, F.col("file_no") == F.col("no")).select("file", "place", "size", (F.col("start") + F.col("first")).alias("start"))
    places = places.repartition(max(spark.sparkContext.defaultParallelism, index.count() // 4), "file", "place")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, inner = opened(f"{path}/ranks.bin")
        with store.open_input_stream(inner) as source:
            ranked = np.frombuffer(source.read(), "<u4")
        for batch in batches:
            for file, place, size, start in zip(batch["file"], batch["place"], batch["size"], batch["start"], strict=True):
                store, inner = opened(file)
                with store.open_input_file(inner) as source:
                    source.seek(int(place))
                    docs = read_block(source.read(int(size)), ranked)
                sizes = np.array([len(x) for _, x in docs])
                yield pd.DataFrame({"id": pd.array([i for i, _ in docs], "Int64"), "start": int(start) + np.cumsum(sizes) - sizes, "ids": [x.astype("<u4").tobytes() for _, x in docs]})

    return places.mapInPandas(run, "id long, start long, ids binary")
