"""Exact top-k inner-product search with one KD-tree for each shard.

Shards are regions of space: the top median splits of a tree over a bounded sample (`sample` rows) deal every row to a
region, and a region of more than `shard_rows` rows is cut into pieces by hash (copies of one vector too). A shard's
tree halves its rows at the median of the dimension with the widest range and keeps a tight bounding box for each node. A
query visits leaves best-first: a box bounds its inner product from above by the better end in each dimension, and the search
ends when no bound can beat the kth score so far. Each query first searches one shard of its home region, the one whose
box's middle scores best. The kth score found there is propagated: the query is sent only to regions whose own box, tight over all rows,
can still reach it, and starts with it as its floor. The candidates are merged at last.

Query blocks meet shards by an equality join on region and piece (a stated query set against all rows, in blocks). A task holds one
tree and one block. Boxes of regions are held by each task that sends blocks: at most `sample` / 16 regions whatever the number of rows.
Work on a tree is pure, so a lost executor's share is simply done again.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id; vectors
meet vectors of the same length only; a query never returns its own id; repeated rows are candidates of their own (equal ones in
the result are all kept, up to k); ties go to the smaller id; an empty table gives no rows; other columns are not read.
Integers must keep inner products within 64 bits.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaweave.llm.common import bounded_sample, table, written


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """The type to multiply in: float64 is much faster, and exact below 2^52."""
    size = float(np.abs(a, dtype=np.float64).max(initial=0)) * float(np.abs(b, dtype=np.float64).max(initial=0)) * max(1, b.shape[1])
    return np.float64 if size < 2**52 else np.int64


def _bounds(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Each query's greatest possible product with a row of each box."""
    return np.maximum(queries, 0) @ hi.T.astype(queries.dtype) + np.minimum(queries, 0) @ lo.T.astype(queries.dtype)


class Regions:
    """The top splits of a KD-tree over a sample; a row goes left where its component is below the split."""

    def __init__(self, vecs: np.ndarray, most: float, least: int = 16):
        """Regions of about `most` rows of the sample, but never below `least`."""
        self.axis, self.split, self.child, self.region, self.n = [], [], [], [], 0
        todo = [np.arange(len(vecs))]
        for own in todo:  # grows while it is read
            at = vecs[own]
            axis = int((at.max(0).astype(np.float64) - at.min(0)).argmax()) if at.size else 0
            x = at[:, axis] if at.size else np.zeros(0, np.int64)
            if len(own) <= most or len(own) < 2 * least or x.min() == x.max():
                self.axis.append(0)
                self.split.append(0)
                self.child.append(-1)
                self.region.append(self.n)
                self.n += 1
                continue
            split = np.partition(x, len(x) // 2)[len(x) // 2]
            split = split if split > x.min() else x[x > split].min()
            self.axis.append(axis)
            self.split.append(split)
            self.child.append(len(todo))
            self.region.append(-1)
            todo += [own[x < split], own[x >= split]]
        self.axis, self.split, self.child, self.region = (np.array(c, np.int64) for c in (self.axis, self.split, self.child, self.region))

    def of(self, vecs: np.ndarray) -> np.ndarray:
        at = np.zeros(len(vecs), np.int64)
        inner = np.flatnonzero(self.child[at] >= 0)
        while len(inner):
            node = at[inner]
            at[inner] = self.child[node] + (vecs[inner, self.axis[node]] >= self.split[node])
            inner = inner[self.child[at[inner]] >= 0]
        return self.region[at]


class KdTree:
    """Nodes in breadth-first arrays; a leaf holds rows start:end of `vecs`."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, leaf: int = 256):
        order = np.arange(len(ids))
        lo, hi, start, end, child, least = [], [], [], [], [], []
        todo = [(0, len(ids))]
        at = 0
        while at < len(todo):
            s, e = todo[at]
            at += 1
            own = vecs[order[s:e]]
            lo.append(own.min(0) if e > s else np.zeros(vecs.shape[1], vecs.dtype))
            hi.append(own.max(0) if e > s else np.zeros(vecs.shape[1], vecs.dtype))
            start.append(s)
            end.append(e)
            least.append(ids[order[s:e]].min() if e > s else 0)
            if e - s <= leaf or not vecs.shape[1]:
                child.append(-1)
                continue
            d = int((hi[-1].astype(np.float64) - lo[-1]).argmax())
            half = (e - s) // 2
            order[s:e] = order[s:e][np.argpartition(own[:, d], half, kind="introselect")]
            child.append(len(todo))
            todo += [(s, s + half), (s + half, e)]
        self.ids, self.vecs = ids[order], vecs[order]
        self.lo, self.hi, self.least = np.array(lo), np.array(hi), np.array(least)
        self.start, self.end, self.child = start, end, child

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's row, ids, scores) of the k best rows that reach the query's floor."""
        kind = _exact(self.vecs, queries)
        vecs, qs = self.vecs.astype(kind), queries.astype(kind)
        bounds = _bounds(qs, self.lo, self.hi)
        for r, own in enumerate(query_ids):
            yield (r, *self._one(int(own), qs[r], bounds[r].tolist(), int(floor[r]), k, vecs))

    def _one(self, own: int, q: np.ndarray, bound: list, floor: int, k: int, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        import heapq

        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        kth, kth_id = floor, None  # the id matters only when k rows are held
        heap = [(-bound[0], 0)]
        while heap:
            b, n = heapq.heappop(heap)
            if -b < kth:
                break
            if -b == kth and kth_id is not None and self.least[n] > kth_id:
                continue
            c = self.child[n]
            if c >= 0:
                heapq.heappush(heap, (-bound[c], c))
                heapq.heappush(heap, (-bound[c + 1], c + 1))
                continue
            s, e = self.start[n], self.end[n]
            got = vecs[s:e] @ q
            keep = np.flatnonzero(got >= kth)
            if not len(keep):
                continue
            new = self.ids[s:e][keep]
            fits = new != own
            ids = np.concatenate([ids, new[fits]])
            scores = np.concatenate([scores, got[keep][fits].astype(np.int64)])
            if len(ids) >= k:
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
                kth, kth_id = int(scores[-1]), int(ids[-1])
        return ids, scores


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = pa.concat_arrays([c for c in flat.chunks]) if isinstance(flat, pa.ChunkedArray) else flat
    return np.asarray(flat.flatten(), np.int64).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _small(a: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type."""
    top = int(np.abs(a).max(initial=0))
    return a.astype(np.int8 if top < 127 else np.int16 if top < 32767 else np.int32 if top < 2**31 - 1 else np.int64)


def usable(vector: Column) -> Column:
    """A vector without null or non-finite components."""
    infinite = float("inf")
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id, ints, dim."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("ints"), F.size("v").alias("dim"))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """A batch's rows for each length of vectors, with their matrix."""
    dims = np.asarray(batch.column("dim"))
    for dim in np.unique(dims):
        part = batch.take(pa.array(np.flatnonzero(dims == dim)))
        yield int(dim), part, _matrix(pa.chunked_array([part.column("ints")]), part.num_rows)


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, shard_rows: int = 8192, block_rows: int = 1024, leaf: int = 256, sample: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on vec_id. sample: rows that the regions are fitted on."""
    given = quantised(vectors, id_col, vector_col, scale)
    n = given.count()
    drawn: dict[int, list] = {}
    for row in bounded_sample(given, sample, id_col="vec_id").toLocalIterator():
        drawn.setdefault(row.dim, []).append(row.ints)
    most = shard_rows * max(1, sum(map(len, drawn.values()))) / max(1, n)
    fitted = {dim: Regions(np.array(v, np.int64).reshape(len(v), -1), most) for dim, v in drawn.items() if len(v) > 16}
    drawn.clear()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part, vecs in _by_length(b):
                region = fitted[dim].of(vecs) if dim in fitted else np.zeros(part.num_rows, np.int64)
                yield part.append_column("region", pa.array(region, pa.int64()))

    # `lot` is stored, so that copies of a row can be told apart in every later reading.
    dealt = written(given.withColumn("lot", F.monotonically_increasing_id()).mapInArrow(deal, "vec_id long, ints array<long>, dim int, lot long, region long"))
    sizes = written(dealt.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("pieces")))

    def build(group: pa.Table) -> pa.Table:
        ids = np.asarray(group["vec_id"], np.int64)
        tree = KdTree(ids, _small(_matrix(group["ints"], len(ids))), leaf)
        keys = [group[c].slice(0, 1).combine_chunks() for c in ("dim", "region", "piece")]
        box = [pa.array([x[0].astype(np.int64)], pa.list_(pa.int64())) for x in (tree.lo, tree.hi)]
        return pa.table([*keys, *box, pa.array([pickle.dumps(tree, 5)], pa.binary())], ["dim", "region", "piece", "lo", "hi", "tree"])

    lot = F.xxhash64("vec_id", "lot")
    shards = dealt.join(sizes, ["dim", "region"]).withColumn("piece", F.pmod(lot, "pieces")).drop("pieces")
    trees = written(shards.groupBy("dim", "region", "piece").applyInArrow(build, "dim int, region long, piece long, lo array<long>, hi array<long>, tree binary"))
    ends = trees.where(F.col("dim").isin(list(fitted))).select("dim", "region", F.posexplode(F.arrays_zip("lo", "hi"))).groupBy("dim", "region", "pos").agg(F.min("col.lo").alias("lo"), F.max("col.hi").alias("hi"))
    # One box for each region that the sample gave.
    own = ends.groupBy("dim", "region").agg(F.array_sort(F.collect_list(F.struct("pos", "lo", "hi"))).alias("b")).select("dim", "region", "b.lo", "b.hi")
    found_boxes: dict[int, list] = {}
    for row in own.toLocalIterator():
        found_boxes.setdefault(row.dim, []).append((row.region, row.lo, row.hi))
    boxes = {dim: (np.array([x[0] for x in v], np.int64), _small(np.array([x[1] for x in v], np.int64)), _small(np.array([x[2] for x in v], np.int64))) for dim, v in found_boxes.items()}
    found_boxes.clear()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part, vecs in _by_length(b):
                home = np.zeros(part.num_rows, np.int64)
                if dim in boxes:
                    regions, lo, hi = boxes[dim]
                    home = regions[(vecs.astype(np.float64) @ (lo.astype(np.float64) + hi).T).argmax(1)]
                part = part.drop_columns(["region"])
                yield part.append_column("region", pa.array(home, pa.int64()))

    def pack(group: pa.Table) -> pa.Table:
        ids = np.asarray(group["vec_id"], np.int64)
        blob = pickle.dumps((ids, _small(_matrix(group["ints"], len(ids))), np.asarray(group["floor"], np.int64)), 5)
        keys = [group[c].slice(0, 1).combine_chunks() for c in ("dim", "region", "piece")]
        return pa.table([*keys, pa.array([blob], pa.binary())], ["dim", "region", "piece", "queries"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's queries to each region that can still give one of their k best; `done` is the piece already searched."""
        names = ["dim", "region", "done", "queries"]
        for b in batches:
            for dim, home, piece, blob in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if dim not in boxes:
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([home], pa.int64()), pa.array([piece], pa.int64()), pa.array([blob], pa.binary())], names)
                    continue
                ids, qs, floor = pickle.loads(blob)
                regions, lo, hi = boxes[dim]
                kind = _exact(np.stack([lo, hi]), qs)
                reach = _bounds(qs.astype(kind), lo, hi) >= floor[:, None]
                for i in np.flatnonzero(reach.any(0)):
                    q = reach[:, i]
                    part = pickle.dumps((ids[q], qs[q], floor[q]), 5)
                    done = piece if regions[i] == home else -1
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([regions[i]], pa.int64()), pa.array([done], pa.int64()), pa.array([part], pa.binary())], names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, None
        for b in batches:
            for i in range(b.num_rows):
                name = tuple(b.column(c)[i].as_py() for c in range(3))
                if name != last:
                    last, tree = name, pickle.loads(b.column(3)[i].as_py())
                ids, qs, floor = pickle.loads(b.column(4)[i].as_py())
                out: list[list[np.ndarray]] = [[], [], []]
                for r, found, scores in tree.search(ids, qs, floor, k):
                    out[0].append(np.full(len(found), ids[r]))
                    out[1].append(found)
                    out[2].append(scores)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    found = "query_id long, vec_id long, score long"
    packed = "dim int, region long, piece long, queries binary"
    least = F.lit(-(1 << 63)).cast("long")
    settled = dealt.where(is_query).mapInArrow(settle, "vec_id long, ints array<long>, dim int, lot long, region long")
    blocks = settled.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    numbered = settled.join(blocks, ["dim", "region"]).join(sizes, ["dim", "region"]).withColumn("block", F.pmod(lot, "blocks"))
    queries = written(numbered.withColumn("piece", F.pmod("block", "pieces")).drop("pieces", "blocks", "lot"))
    block = ["dim", "region", "piece", "block"]
    home = queries.withColumn("floor", least).groupBy(*block).applyInArrow(pack, packed)
    asked = ["dim", "region", "piece", "tree", "queries"]
    first = written(home.join(trees, ["dim", "region", "piece"]).select(*asked).mapInArrow(search, found))
    floors = first.groupBy(F.col("query_id").alias("_q")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(least).alias("floor"))
    bounded = queries.join(floors, F.col("vec_id") == F.col("_q"), "left").drop("_q").withColumn("floor", F.coalesce("floor", least))
    sent = bounded.groupBy(*block).applyInArrow(pack, packed).mapInArrow(send, "dim int, region long, done long, queries binary")
    pieces = sent.join(sizes, ["dim", "region"]).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).where("piece <> done")
    # In the join's order equal shards are neighbours, so a task unpacks each tree once.
    rest = pieces.join(trees, ["dim", "region", "piece"]).select(*asked).mapInArrow(search, found)
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.ints, c.ints)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
