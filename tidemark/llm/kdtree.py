"""Exact top-k search by inner product, with a KD-tree per shard.

A few median splits, learnt from a sample of SAMPLE numbers at most, cut the space into LEAVES cells at
most; a cell with more than SHARD vectors is dealt to several shards by hash. Each shard is one tree:
median splits on the widest coordinate, down to LEAF rows. A node holds the tight bounding box of its
rows, their centre with the radius about it, and the largest length. The score of a query within a
node is bounded by the least of what these three allow.

A query is searched in its own shard first. Its k-th score there is what the other shards start from:
only cells whose bound reaches it are visited. A tree is searched best-first, nodes being opened in
the order of their bounds, until these are below the k-th best score so far. Queries and trees are
tables that meet by shard and block of BLOCK queries in cogrouped tasks: two rounds for any number of
queries, none of which passes through the driver. A task holds one tree and one block.

Only vectors on clusters let bounds discard much. Evenly spread directions in many dimensions have
every leaf opened, so that work is queries times vectors there, as for any exact method.

Cases: vectors that are null, or hold a null or non-finite component, take no part; nor does a null
id. A component that is no long once scaled raises an error, and so does a found score that is none:
nothing is dropped for its size. Vectors meet those of their own dimension only. Repeated rows of a
candidate are candidates each; a query row that repeats (id and vector) is one query; rows that share
the query's id are its own and no candidates of it. Ties go to the smaller id. Fewer candidates than
k give fewer rows, an empty table none. An id is taken to be held by a few rows only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

SHARD = 16_384
LEAF = 128
BLOCK = 65_536
#: Numbers in the sample that the first splits are learnt from, and in the summary of all cells.
SAMPLE, SUMMARY = 1 << 21, 1 << 19
_TREE = "dim int, cell int, part int, ids binary, vecs binary, boxes binary, balls binary, nodes binary"
_HITS = "query_no long, vec_id long, score long"
_TOP = "dim int, cell int, box binary, ball binary"


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, e): floor(scale * x) of every component, for the vectors that take part."""
    v = F.col(f"`{vector_col}`")
    whole = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))

    def scaled(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < float(1 << 62), F.floor(y)).otherwise(F.raise_error(F.lit("a scaled component is no 64-bit integer")).cast("long"))

    return vectors.where(whole & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, scaled).alias("e"))


def split_cells(vecs: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, value) of a full binary tree of median splits with ``cells`` leaves (a power of two), in heap order."""
    axis, value = np.zeros(cells - 1, np.int64), np.zeros(cells - 1, np.int64)
    rows = {0: vecs}
    for at in range(cells - 1):
        mine = rows.pop(at)
        if len(mine):
            axis[at] = int(np.argmax(mine.max(0).astype(float) - mine.min(0).astype(float)))
            value[at] = np.sort(mine[:, axis[at]])[len(mine) // 2]
        right = mine[:, axis[at]] >= value[at]
        rows[2 * at + 1], rows[2 * at + 2] = mine[~right], mine[right]
    return axis, value


def cell_of(vecs: np.ndarray, axis: np.ndarray, value: np.ndarray) -> np.ndarray:
    at = np.zeros(len(vecs), np.int64)
    for _ in range((len(axis) + 1).bit_length() - 1):
        at = 2 * at + 1 + (vecs[np.arange(len(vecs)), axis[at]] >= value[at])
    return at - len(axis)


def _ball(vecs: np.ndarray) -> np.ndarray:
    """Centre, radius and largest length, rounded up so that no row is outside."""
    rows = vecs.astype(float)
    centre = rows.mean(0) if len(rows) else np.zeros(vecs.shape[1])
    far = lambda x: np.sqrt((x * x).sum(1)).max(initial=0) * (1 + 1e-9) + 1e-6
    return np.concatenate([centre, [far(rows - centre), far(rows)]])


def build_tree(ids: np.ndarray, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in leaf order, and per node its box (lo, hi), ball, and (start, end, left, right; left -1 in leaves)."""
    order = np.arange(len(ids))
    boxes, balls, nodes, todo = [], [], [], [(0, len(ids), -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        rows = vecs[order[start:end]]
        lo, hi = rows.min(0, initial=np.iinfo(np.int64).max), rows.max(0, initial=np.iinfo(np.int64).min)
        at = len(nodes)
        boxes.append((lo, hi))
        balls.append(_ball(rows))
        nodes.append([start, end, -1, -1])
        if parent >= 0:
            nodes[parent][2 + side] = at
        wide = hi.astype(float) - lo
        if end - start > LEAF and (wide > 0).any():
            axis = int(np.argmax(wide))
            middle = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(rows[:, axis], middle)]
            todo += [(start, start + middle, at, 0), (start + middle, end, at, 1)]
    return ids[order], vecs[order], np.array(boxes, np.int64), np.array(balls, float), np.array(nodes, np.int64)


def bounds_of(queries: np.ndarray, boxes: np.ndarray, balls: np.ndarray) -> np.ndarray:
    """(query, node): no row of the node scores more; rounding never hides a row."""
    q, dim = queries.astype(float), queries.shape[1]
    length = np.sqrt((q * q).sum(1))[:, None]
    box = np.maximum(q, 0) @ boxes[:, 1].T.astype(float) + np.minimum(q, 0) @ boxes[:, 0].T.astype(float)
    ball = q @ balls[:, :dim].T + length * balls[:, dim]
    far = length * balls[:, dim + 1]
    return np.minimum(np.minimum(box, ball), far) + far * 1e-9 + 1


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id; ``floor`` is what must be reached to enter."""

    def __init__(self, k: int, floors: np.ndarray) -> None:
        self.k = k
        self.known = [[] for _ in floors]
        self.floor = [int(f) for f in floors]

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray, own: int) -> None:
        heap = self.known[q]
        good = np.flatnonzero((scores >= self.floor[q]) & (ids != own))
        for s, i in zip(scores[good].tolist(), ids[good].tolist(), strict=True):
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -i))
            elif (s, -i) > heap[0]:
                heapq.heapreplace(heap, (s, -i))
        if len(heap) == self.k:
            self.floor[q] = max(self.floor[q], heap[0][0])


def search_tree(tree: tuple, queries: np.ndarray, own: np.ndarray, best: Best) -> int:
    """Best-first search of one tree for all ``queries``; how many leaves were opened."""
    ids, vecs, boxes, balls, nodes = tree
    # sums of products are exact in doubles below 2^53, in longs below 2^63, in Python's integers beyond
    largest = float(np.abs(vecs.astype(float)).max(initial=0)) * float(np.abs(queries.astype(float)).max(initial=0)) * max(1, vecs.shape[1])
    kind = float if largest < 2.0**53 else np.int64 if largest < 2.0**62 else object
    rows, qs = vecs.astype(kind), queries.astype(kind)
    shape, opened = nodes.tolist(), 0
    for begin in range(0, len(queries), 1024):
        bounds = bounds_of(queries[begin : begin + 1024], boxes, balls)
        for q in range(begin, begin + len(bounds)):
            bound = bounds[q - begin].tolist()
            todo = [(-bound[0], 0)]
            while todo and -todo[0][0] >= best.floor[q]:
                start, end, left, right = shape[heapq.heappop(todo)[1]]
                if left < 0:
                    scores = rows[start:end] @ qs[q]
                    best.offer(q, scores.astype(np.int64) if kind is float else scores, ids[start:end], int(own[q]))
                    opened += 1
                else:
                    heapq.heappush(todo, (-bound[left], left))
                    heapq.heappush(todo, (-bound[right], right))
    return opened


def _packed(vecs: np.ndarray) -> bytes:
    """As 32-bit integers where these will do."""
    small = np.abs(vecs.astype(float)).max(initial=0) < 2.0**31
    return vecs.astype("<i4" if small else "<i8").tobytes()


def _unpacked(raw: bytes, rows: int, dim: int) -> np.ndarray:
    kind = "<i4" if len(raw) == 4 * rows * dim else "<i8"
    return np.frombuffer(raw, kind).astype(np.int64).reshape(rows, dim)


def _matrix(vecs: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate([_unpacked(v, 1, dim) for v in vecs]) if len(vecs) else np.empty((0, dim), np.int64)


def _grow(rows: pd.DataFrame) -> pd.DataFrame:
    dim = int(rows["dim"].iloc[0])
    ids, vecs, boxes, balls, nodes = build_tree(rows["id"].to_numpy(np.int64), _matrix(rows["vec"], dim))
    made = {"dim": dim, "cell": int(rows["cell"].iloc[0]), "part": int(rows["part"].iloc[0]), "ids": ids.tobytes(), "vecs": _packed(vecs), "boxes": boxes.tobytes(), "balls": balls.tobytes(), "nodes": nodes.tobytes()}
    return pd.DataFrame([made])


def _top(roots: pd.DataFrame) -> pd.DataFrame:
    """One box and one ball for all shards of a cell."""
    dim = int(roots["dim"].iloc[0])
    boxes = np.array([np.frombuffer(b, np.int64)[: 2 * dim] for b in roots["boxes"]]).reshape(len(roots), 2, dim)
    balls = np.array([np.frombuffer(b, float)[: dim + 2] for b in roots["balls"]])
    centre = balls[:, :dim].mean(0)
    apart = np.sqrt(((balls[:, :dim] - centre) ** 2).sum(1)) * (1 + 1e-9) + 1e-6
    ball = np.concatenate([centre, [(apart + balls[:, dim]).max(), balls[:, dim + 1].max()]])
    box = np.stack([boxes[:, 0].min(0), boxes[:, 1].max(0)])
    return pd.DataFrame([{"dim": dim, "cell": int(roots["cell"].iloc[0]), "box": box.tobytes(), "ball": ball.tobytes()}])


def _celled(rows: DataFrame, splits: dict[int, tuple[np.ndarray, np.ndarray]], columns: str) -> DataFrame:
    """``rows`` (..., dim, e) with cell and vec instead of e."""
    sent = rows.sparkSession.sparkContext.broadcast(splits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.drop(columns="e")
            cell, vec = np.zeros(len(batch), np.int64), np.empty(len(batch), object)
            for dim, at in out.groupby("dim").indices.items():
                vecs = np.array([np.asarray(e, np.int64) for e in batch["e"].iloc[at]], np.int64).reshape(len(at), int(dim))
                cell[at] = cell_of(vecs, *sent.value[int(dim)]) if int(dim) in sent.value else 0
                for i, v in zip(at.tolist(), vecs, strict=True):
                    vec[i] = _packed(v)
            yield out.assign(cell=cell, vec=vec)

    return rows.mapInPandas(run, f"{columns}, cell int, vec binary")


def _splits(rows: DataFrame, n: int, shard: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per dimension the first splits; the sample and the number of cells are bounded by numbers held, not by rows."""
    most = rows.agg(F.max("dim")).first()[0] or 1
    cells = 1 << min(max(0, -(-n // shard) - 1).bit_length(), max(1, SUMMARY // most).bit_length() - 1)
    if cells == 1:
        return {}
    every = max(1, -(-n * most // SAMPLE))

    def fit(some: pd.DataFrame) -> pd.DataFrame:
        dim = int(some["dim"].iloc[0])
        axis, value = split_cells(np.array([np.asarray(e) for e in some["e"]], np.int64).reshape(len(some), dim), cells if dim else 1)
        return pd.DataFrame([{"dim": dim, "axis": axis.tobytes(), "value": value.tobytes()}])

    some = rows.where((F.pmod(F.xxhash64(F.lit("sample"), "id", "e"), F.lit(every)) == 0) & (F.col("dim") > 0))
    learnt = some.groupBy("dim").applyInPandas(fit, "dim int, axis binary, value binary").collect()
    return {r["dim"]: (np.frombuffer(r["axis"], np.int64), np.frombuffer(r["value"], np.int64)) for r in learnt}


def _meet(trees: DataFrame, visits: DataFrame, most: int, k: int) -> DataFrame:
    """(query_no, vec_id, score): what each tree holds for the queries (query_no, id, dim, vec, floor, cell, part)
    that visit it; at most ``most`` visit one."""
    blocks = max(1, -(-most // BLOCK))
    trees = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    visits = visits.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "query_no"), F.lit(blocks)).cast("int"))

    def run(tree: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        for t in tree.itertuples():
            if not len(asked):
                continue
            ids = np.frombuffer(t.ids, np.int64)
            nodes = np.frombuffer(t.nodes, np.int64).reshape(-1, 4)
            boxes, balls = np.frombuffer(t.boxes, np.int64).reshape(len(nodes), 2, t.dim), np.frombuffer(t.balls, float).reshape(len(nodes), t.dim + 2)
            parts = ids, _unpacked(t.vecs, len(ids), t.dim), boxes, balls, nodes
            best = Best(k, asked["floor"].to_numpy(np.int64))
            search_tree(parts, _matrix(asked["vec"], t.dim), asked["id"].to_numpy(np.int64), best)
            found += [(q, -i, s) for q, heap in zip(asked["query_no"].tolist(), best.known, strict=True) for s, i in heap]
        if any(not -(1 << 63) <= s < 1 << 63 for _, _, s in found):
            raise OverflowError("a score is no 64-bit integer")
        return pd.DataFrame(found, columns=["query_no", "vec_id", "score"]).astype("int64")

    keys = ("dim", "cell", "part", "block")
    return trees.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(run, _HITS)


def _reached(asked: DataFrame, tops: DataFrame) -> Column:
    """The cells whose bound reaches the query's floor; ``tops`` is bounded by SUMMARY numbers a dimension."""
    known: dict[int, tuple] = {}
    rows = tops.collect()
    for dim in {r["dim"] for r in rows}:
        mine = [r for r in rows if r["dim"] == dim]
        known[dim] = np.array([r["cell"] for r in mine]), np.array([np.frombuffer(r["box"], np.int64) for r in mine]).reshape(len(mine), 2, dim), np.array([np.frombuffer(r["ball"], float) for r in mine])
    sent = asked.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("array<int>")
    def of(dims: pd.Series, vecs: pd.Series, floors: pd.Series) -> pd.Series:
        out = np.empty(len(dims), object)
        for dim, at in dims.groupby(dims).indices.items():
            cells, boxes, balls = sent.value.get(int(dim), (np.empty(0, int), np.empty((0, 2, int(dim)), np.int64), np.empty((0, int(dim) + 2))))
            reach = bounds_of(_matrix(vecs.iloc[at], int(dim)), boxes, balls) >= floors.iloc[at].to_numpy(float)[:, None]
            for i, r in zip(at.tolist(), reach, strict=True):
                out[i] = cells[r].tolist()
        return pd.Series(out)

    return of(F.col("dim"), F.col("vec"), F.col("floor"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """The k best candidates of ``vectors`` for every row of ``queries``: query_id, rank (from 1), vec_id, score."""
    rows = written(quantized(vectors, id_col, vector_col, scale).select("id", "e", F.size("e").alias("dim")), "vectors")
    splits = _splits(rows, rows.count(), SHARD)
    placed = written(_celled(rows.select("id", "dim", "e"), splits, "id long, dim int"), "placed")
    dropped(rows)
    # a row a cell and dimension: bounded as the summary is
    parts = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("parts"))
    parts = F.broadcast(written(parts.select(F.col("dim").alias("pd"), F.col("cell").alias("pc"), "parts"), "parts"))
    here = (F.col("dim") == F.col("pd")) & (F.col("cell") == F.col("pc"))
    dealt = placed.join(parts, here).select("id", "dim", "cell", "vec", F.pmod(F.xxhash64(F.lit("part"), "id", "vec"), F.col("parts")).cast("int").alias("part"))
    trees = written(dealt.groupBy("dim", "cell", "part").applyInPandas(_grow, _TREE), "trees")
    tops = trees.select("dim", "cell", "boxes", "balls").groupBy("dim", "cell").applyInPandas(_top, _TOP)

    asked = quantized(queries, id_col, vector_col, scale).distinct()
    asked = asked.select("id", F.size("e").alias("dim"), F.xxhash64("id", "e").alias("query_no"), "e")
    asked = _celled(asked, splits, "id long, dim int, query_no long").join(parts, here, "left")
    # a query's own shard
    asked = written(asked.select("id", "dim", "query_no", "vec", "cell", F.pmod("query_no", F.coalesce("parts", F.lit(1))).cast("int").alias("part")), "queries")
    least = F.lit(int(np.iinfo(np.int64).min))
    crowd = asked.groupBy("dim", "cell", "part").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    seeds = written(_meet(trees, asked.withColumn("floor", least), crowd, k), "seeds")
    floors = seeds.groupBy("query_no").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).select(F.col("query_no").alias("no"), F.col("s").alias("known"))
    known = asked.join(floors, F.col("query_no") == F.col("no"), "left").withColumn("floor", F.coalesce("known", least))
    visits = known.select("query_no", "id", "dim", "vec", "floor", F.col("cell").alias("home"), F.col("part").alias("home_part"), F.explode(_reached(asked, tops)).alias("cell"))
    visits = visits.join(parts, here).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("cell <> home or part <> home_part")
    hits = seeds.union(_meet(trees, visits.select("query_no", "id", "dim", "vec", "floor", "cell", "part"), asked.count(), k))
    # equal candidates of a query stay apart, so ranks count rows
    rank = F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id"))
    best = hits.withColumn("rank", rank).where(F.col("rank") <= k)
    names = asked.select(F.col("query_no").alias("no"), F.col("id").alias("query_id"))
    return best.join(names, F.col("query_no") == F.col("no")).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id_col), "score")
