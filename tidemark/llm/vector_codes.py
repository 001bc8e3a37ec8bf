"""Vector compression by parts: each part of a vector becomes the index of its nearest codebook entry.

Codebooks are fitted by Lloyd rounds over all vectors, with Hamerly's bounds: for each part of each
vector an upper bound of the distance to its entry and a lower bound of the distance to any other are
kept from round to round. Entries move between rounds; the bounds move along (the upper by what the own
entry moved, the lower by what the others moved at most). Only where the upper doesn't stay strictly
below the lower are distances taken again, first to the own entry, then to all. All distances are whole
numbers, so ties are ties, and go to the lower index: a tie never passes the strict test. Bounds are
single floats, the upper rounded up and the lower down, so rounding only costs a scan.

The state (whole components, codes, bounds: about the input's size) is a table that each round writes
anew. What meets in a round are sums by part and entry, pre-aggregated in every task; what comes to the
driver is a codebook.

Cases: vectors that are null or hold null or non-finite components take no part. All others need the
same number of components, divisible by ``parts``; any other length, or a component too large for exact
squares (2^27 once scaled, less where a part has over 64 components), raises an error: nothing is dropped
for its size. The first codebooks are the ``entries`` rows of the smallest ids, equal ids by components, null
ids last; fewer rows give fewer entries. Entries that no part is nearest to stay as they are. Repeated
rows are rows each. An empty table gives an empty result and no codebooks. The caller's other columns stay
as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, packed, written

#: Parts whose distances to a whole codebook are held at once.
SCAN = 1 << 14
_KEPT = "vec binary, code binary, upper binary, lower binary"


def quantized(vectors: DataFrame, vector_col: str, scale: int) -> DataFrame:
    """(rec, v): the caller's other columns and floor(scale * x) of the components, where the vector takes part."""
    v = F.col(f"`{vector_col}`")
    whole = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))

    def scaled(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) <= float(1 << 27), F.floor(y)).otherwise(F.raise_error(F.lit("a scaled component is too large"))).cast("int")

    return vectors.where(whole).select(packed(vectors.drop(vector_col)), F.transform(v, scaled).alias("v"))


def squares(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(row, entry): exact squared distances of one part position."""
    out = np.zeros((len(parts), len(book)), np.int64)
    for k in range(parts.shape[1]):
        out += (parts[:, k, None] - book[None, :, k]) ** 2
    return out


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, np.inf).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(x, 0).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lower of equals), and bounds: upper of its distance, lower of the next one's."""
    code, upper, lower = np.empty(len(parts), np.uint8), np.empty(len(parts), np.float32), np.empty(len(parts), np.float32)
    for at in range(0, len(parts), SCAN):
        d = squares(parts[at : at + SCAN], book)
        rows = np.arange(len(d))
        some = d.argmin(1)
        code[at : at + SCAN] = some
        upper[at : at + SCAN] = _up(np.sqrt(d[rows, some].astype(np.float64)))
        if len(book) == 1:
            lower[at : at + SCAN] = np.finfo(np.float32).max
        else:
            d[rows, some] = np.iinfo(np.int64).max
            lower[at : at + SCAN] = _down(np.sqrt(d.min(1).astype(np.float64)))
    return code, upper, lower


def drifts(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each entry of a position moved, and at most any other one; rounded up."""
    moved = _up(np.sqrt(((new - old) ** 2).sum(1).astype(np.float64))).astype(np.float64)
    moved[(new == old).all(1)] = 0
    others = np.array([np.delete(moved, k).max(initial=0) for k in range(len(moved))])
    return moved, others


def again(parts: np.ndarray, book: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes and bounds after entries moved, and how many parts were scanned against the whole codebook."""
    code = code.copy()
    upper, lower = _up(upper.astype(np.float64) + moved[code]), _down(np.maximum(lower.astype(np.float64) - others[code], 0))
    loose = np.flatnonzero(~(upper < lower))
    if len(loose):
        upper[loose] = _up(np.sqrt(((parts[loose] - book[code[loose]]) ** 2).sum(1).astype(np.float64)))
        loose = loose[~(upper[loose] < lower[loose])]
        code[loose], upper[loose], lower[loose] = nearest(parts[loose], book)
    return code, upper, lower, len(loose)


def _read(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _vecs(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """(row, part, component)."""
    flat = batch["v"].flatten().to_numpy(zero_copy_only=False) if "v" in batch.schema.names else _read(batch["vec"], "<i4")
    return flat.astype(np.int64).reshape(len(batch), parts, -1)


def _state(batch: pa.RecordBatch) -> list[np.ndarray] | None:
    return None if "v" in batch.schema.names else [_read(batch[c], k) for c, k in (("code", "u1"), ("upper", "<f4"), ("lower", "<f4"))]


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _assigned(vecs: np.ndarray, state: list[np.ndarray] | None, books: list[np.ndarray], moves: list | None) -> list[np.ndarray]:
    """Codes and bounds of all parts: from scratch, or from what is kept."""
    out = [np.empty(vecs.shape[:2], k) for k in (np.uint8, np.float32, np.float32)]
    for p, book in enumerate(books):
        if state is None:
            found = nearest(vecs[:, p], book)
        else:
            found = again(vecs[:, p], book, *[s[:, p] for s in state], *moves[p])[:3]
        for o, x in zip(out, found, strict=True):
            o[:, p] = x
    return out


def _sums(state: DataFrame, parts: int, entries: int) -> list[tuple[int, int, int, int]]:
    """(part x entries + entry, component, sum, members): as many rows as the codebooks have numbers, at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, members = None, np.zeros(parts * entries, np.int64)
        for batch in batches:
            vecs = _vecs(batch, parts)
            cell = (_read(batch["code"], "u1").astype(np.int64) + np.arange(parts) * entries).reshape(-1)
            total = np.zeros((parts * entries, vecs.shape[2]), np.int64) if total is None else total
            np.add.at(total, cell, vecs.reshape(len(cell), -1))
            members += np.bincount(cell, minlength=parts * entries)
        if total is not None:
            seen, width = np.flatnonzero(members), total.shape[1]
            cell, at = np.repeat(seen, width), np.tile(np.arange(width), len(seen))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cell, at, total[cell, at], members[cell])], ["cell", "at", "total", "n"])

    rows = state.select("vec", "code").mapInArrow(run, "cell long, at long, total long, n long")
    by_cell = rows.groupBy("cell", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return [tuple(r) for r in by_cell.collect()]


def compress(vectors: DataFrame, vector_col: str, id_col: str, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, list[np.ndarray]]:
    """(rec, code, error) of every vector that takes part, and the final codebook of each part position.

    ``rec`` holds the caller's columns, ``code`` a byte for each part, ``error`` the summed squared distances.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte")
    spark = vectors.sparkSession
    rows = quantized(vectors, vector_col, scale)
    first = rows.select(F.col(f"rec.`{id_col}`").alias("id"), "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    out = f"rec {rows.schema['rec'].dataType.simpleString()}"
    if not first:
        return spark.createDataFrame([], f"{out}, code binary, error long"), []
    size = len(first[0]["v"])
    if size % parts or not size:
        raise ValueError(f"vectors of {size} components have no {parts} equal parts")
    if any(len(r["v"]) != size for r in first):
        raise ValueError("vectors differ in their number of components")
    width = size // parts
    if width * (2 << 27) ** 2 > 1 << 62:
        raise ValueError("parts of over 64 components are not exact in 64 bits")
    seeds = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width)
    books = [seeds[:, p].copy() for p in range(parts)]
    alike = F.when(F.size("v") == size, F.col("v")).otherwise(F.raise_error(F.lit("vectors differ in their number of components")).cast("array<int>"))
    state: DataFrame | None = None
    moves: list | None = None
    for _ in range(rounds):
        kept, state = state, written(_step(rows.select("rec", alike.alias("v")) if state is None else state, out, books, moves), "codes")
        if kept is not None:
            dropped(kept)
        old, books = books, [b.copy() for b in books]
        for cell, at, total, n in _sums(state, parts, len(first)):
            books[cell // len(first)][cell % len(first), at] = total // n
        moves = [drifts(a, b) for a, b in zip(old, books, strict=True)]
    return _final(rows.select("rec", alike.alias("v")) if state is None else state, out, books, moves), books


def _step(table: DataFrame, out: str, books: list[np.ndarray], moves: list | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = _vecs(batch, len(books))
            found = _assigned(vecs, _state(batch), books, moves)
            yield pa.RecordBatch.from_arrays([batch["rec"], _bytes(vecs.astype("<i4")), *map(_bytes, found)], ["rec", "vec", "code", "upper", "lower"])

    return table.mapInArrow(run, f"{out}, {_KEPT}")


def _final(table: DataFrame, out: str, books: list[np.ndarray], moves: list | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = _vecs(batch, len(books))
            code = _assigned(vecs, _state(batch), books, moves)[0]
            error = sum(((vecs[:, p] - book[code[:, p]]) ** 2).sum(1) for p, book in enumerate(books))
            yield pa.RecordBatch.from_arrays([batch["rec"], _bytes(code), pa.array(error)], ["rec", "code", "error"])

    return table.mapInArrow(run, f"{out}, code binary, error long")


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()
