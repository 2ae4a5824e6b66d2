"""Approximate nearest neighbours with balanced posting lists.

Centroids come from a bounded sample by recursive halving at the median of a two-means direction,
so lists start out balanced. A vector joins its nearest list and, if it lies near a boundary
(distance within ``1 + REPLICATE`` of the nearest), further ones that no list already chosen
shadows: a list is shadowed by one whose centroid is nearer to its own than ``SHADOW`` times the
vector is. A query searches the centroids by best-first walk over their neighbour graph, held in
memory, and probes all lists whose distance is within ``1 + PRUNE`` of the nearest. Where the nearest
list is the first list of fewer than ``k + 1`` distinct vectors, the ratio counts from the list, nearest
first, at which there are so many, so an answer is short only if the table is. On clustered
vectors the lists are few; on vectors spread evenly over a sphere they are most, since nothing tells
near lists from far ones. Lists above ``BLOCK`` vectors are split into blocks that are all searched,
so no list is capped. Distances are exact, in double precision on the original vectors.

Equal vectors are one node that keeps its ``k + 1`` smallest ids: no answer can hold more of them.
Vectors that are null, empty, zero, or hold null or non-finite components take no part; nor do those
whose length is not the commonest one. Ties go to smaller ids. Repeated rows are candidates each,
and a query row leaves out itself only. Null ids take part as candidates nowhere. An empty table
gives an empty result. Only the id and the vector are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import lean, materialize, ship

LIST, MAX_LISTS, SAMPLE, BLOCK = 128, 4096, 32_768, 4096
REPLICATE, COPIES, SHADOW = 0.1, 4, 0.6
PRUNE, BEAM, DEGREE = 0.17, 64, 24
SALTS = 64


def halve(x: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of ``lists`` near-equal parts of x, by recursive median cuts, then two Lloyd steps."""
    parts = [x]
    while len(parts) < lists:
        parts.sort(key=len)
        p = parts.pop()
        if len(p) < 2:
            parts.append(p)
            break
        a, b = p[rng.choice(len(p), 2, replace=False)]
        for _ in range(4):
            side = ((p - (a + b) / 2) @ (a - b)) > 0
            if side.all() or not side.any():
                break
            a, b = p[side].mean(axis=0), p[~side].mean(axis=0)
        order = np.argsort(p @ (a - b), kind="stable")
        parts += [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]
    c = np.stack([p.mean(axis=0) for p in parts])
    for _ in range(2):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return np.unique(c, axis=0)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0))


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], c).argmin(axis=1) for i in range(0, len(x), 4096)])


class Graph:
    """Centroids with a neighbour graph: the nearest ones, plus links that keep it in one piece."""

    def __init__(self, c: np.ndarray):
        self.c, n = c, len(c)
        d = distances(c, c)
        np.fill_diagonal(d, np.inf)
        k = min(DEGREE, n - 1)
        near = np.argpartition(d, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((n, 0), dtype=np.int64)
        links = [set(x.tolist()) for x in near]
        for i in range(n):
            for j in list(links[i]):
                links[j].add(i)
            if i:  # a chain reaches every centroid
                links[i].add(i - 1)
                links[i - 1].add(i)
        self.links = [np.array(sorted(x), dtype=np.int64) for x in links]
        self.start = int(np.argmin(((c - c.mean(axis=0)) ** 2).sum(axis=1)))
        #: Well spread entries, by the halving order of the centroids.
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))
        self.between = d

    def search(self, q: np.ndarray, spread: float = PRUNE, beam: int = BEAM) -> list[tuple[float, int]]:
        """The centroids found within ``1 + spread`` of the nearest, nearest first.

        Best first: the walk ends when ``beam`` centroids are expanded and all that is left lies outside.
        """
        seen = np.zeros(len(self.c), dtype=bool)
        first = np.unique(np.append(self.entries, self.start))
        seen[first] = True
        met = list(zip(np.sqrt(((self.c[first] - q) ** 2).sum(axis=1)).tolist(), first.tolist(), strict=True))
        todo, nearest, expanded = list(met), min(met)[0], 0
        heapq.heapify(todo)
        while todo:
            d, i = heapq.heappop(todo)
            if d > nearest * (1 + spread) and expanded >= beam:
                break
            expanded += 1
            new = self.links[i][~seen[self.links[i]]]
            if len(new):
                seen[new] = True
                found = list(zip(np.sqrt(((self.c[new] - q) ** 2).sum(axis=1)).tolist(), new.tolist(), strict=True))
                nearest = min(nearest, min(found)[0])
                met += found
                for x in found:
                    heapq.heappush(todo, x)
        return sorted(x for x in met if x[0] <= nearest * (1 + spread))

    def probes(self, q: np.ndarray, first: np.ndarray, need: int) -> list[int]:
        """The lists to probe; ``first`` tells of each how many vectors have it as their nearest list."""
        near = [i for _, i in self.search(q)]
        if first[near[0]] >= need:
            return near
        d = np.sqrt(((self.c - q) ** 2).sum(axis=1))
        order = np.argsort(d, kind="stable")
        last = min(int(np.searchsorted(np.cumsum(first[order]), need)), len(order) - 1)
        return order[(np.arange(len(order)) <= last) | (d[order] <= d[order[last]] * (1 + PRUNE))].tolist()

    def postings(self, x: np.ndarray) -> list[list[int]]:
        """The lists of each vector."""
        out = []
        for lo in range(0, len(x), 1024):
            d = distances(x[lo : lo + 1024], self.c)
            k = min(COPIES * 3, d.shape[1])
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            for row, cand in zip(d, near, strict=True):
                cand = cand[np.argsort(row[cand], kind="stable")]
                own: list[int] = []
                for i in cand.tolist():
                    if row[i] > row[cand[0]] * (1 + REPLICATE) or len(own) >= COPIES:
                        break
                    if all(self.between[i, j] >= SHADOW * row[i] for j in own):
                        own.append(i)
                out.append(own)
        return out


def shelves(sizes: dict[int, int]) -> list[tuple[int, int, int]]:
    """(list, shelf, blocks): neighbouring lists share a shelf of at most BLOCK vectors; a list above that
    has a shelf of its own, in blocks. A query gives one partial answer a shelf and block."""
    out, shelf, room = [], 0, 0
    for name in sorted(sizes):
        n = sizes[name]
        if n > room or n > BLOCK:
            shelf, room = shelf + 1, BLOCK
        out.append((name, shelf, max(1, -(-n // BLOCK))))
        room = room - n if n <= BLOCK else 0
    return out


def _vectors(column) -> np.ndarray:
    """Packed float64 vectors of one length as a matrix."""
    rows = list(column)
    return np.frombuffer(b"".join(rows), dtype="<f8").reshape(len(rows), -1)


def _top(q: np.ndarray, v: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query the exact distances to all vectors, and which could be among the ``keep`` nearest."""
    d = np.empty((len(q), len(v)))
    for i in range(len(q)):
        d[i] = np.sqrt(((v - q[i]) ** 2).sum(axis=1))
    if len(v) > keep:
        limit = np.partition(d, keep - 1, axis=1)[:, keep - 1 : keep]
        return d, d <= limit
    return d, np.ones_like(d, dtype=bool)


def _nodes(rows: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: node, v, ids (its k + 1 smallest)."""
    own = Window.partitionBy("h1", "h2")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)))
    few = salted.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2", "salt").orderBy("vec_id", "uid"))).filter(F.col("r") <= k + 1).drop("r")
    few = few.withColumn("r", F.row_number().over(own.orderBy("vec_id", "uid"))).filter(F.col("r") <= k + 1)
    return few.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 rows at most


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship(spark)
    e = F.col("e")
    sound = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("e")).filter(
        F.col("vec_id").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    )

    def packed(batches):
        for b in batches:
            e = b.column(1)
            flat, cut = e.flatten().to_numpy(zero_copy_only=False) + 0.0, e.offsets.to_numpy() - e.offsets[0].as_py()  # no -0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([flat[x:y].astype("<f8").tobytes() for x, y in zip(cut, cut[1:], strict=False)], pa.binary())], names=["vec_id", "v"])

    rows = materialize(
        sound.mapInArrow(lean(packed), "vec_id long, v binary").select("vec_id", "v", F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2"), F.monotonically_increasing_id().alias("uid")),
        "ann-rows",
    )
    lengths = {r.n: r.c for r in rows.groupBy(F.length("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()}
    rows = rows.filter(F.length("v") == next(iter(lengths), 0))
    nodes = materialize(_nodes(rows, k).withColumn("node", F.monotonically_increasing_id()), "ann-nodes")
    n = nodes.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    share = F.xxhash64(F.lit(3), "h1").bitwiseAND((1 << 52) - 1) / float(1 << 52) < SAMPLE / n
    sample = _vectors([r.v for r in nodes.filter(share).select("v", "h1").orderBy("h1").collect()] or [nodes.first().v])
    graph = Graph(halve(sample, max(1, min(MAX_LISTS, n // LIST, len(sample) // 4)), np.random.default_rng(2)))
    shared = spark.sparkContext.broadcast(graph)  # MAX_LISTS centroids at most

    def posted(batches):
        for b in batches:
            if b.num_rows:
                lists = shared.value.postings(_vectors(b.column("v").to_pylist()))
                at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                first = pa.array([j == 0 for x in lists for j in range(len(x))], pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([i for x in lists for i in x], pa.int32()), first, *(b.column(c).take(pa.array(at)) for c in ("node", "v", "ids"))], names=["list", "first", "node", "v", "ids"])

    def probed(batches):
        for b in batches:
            if b.num_rows:
                lists = [shared.value.probes(q, first, k + 1) for q in _vectors(b.column("v").to_pylist())]
                at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                yield pa.RecordBatch.from_arrays([pa.array([i for x in lists for i in x], pa.int32()), *(b.column(c).take(pa.array(at)) for c in ("node", "v"))], names=["list", "node", "v"])

    postings = materialize(nodes.select("node", "v", "ids").mapInArrow(lean(posted), "list int, first boolean, node long, v binary, ids array<long>"), "ann-postings")
    counts = postings.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.count_if("first").alias("f")).collect()  # MAX_LISTS rows at most
    sizes = {r["list"]: r.n for r in counts}
    first = np.zeros(len(graph.c), dtype=np.int64)
    first[[r["list"] for r in counts]] = [r.f for r in counts]
    # one for each side: cogroup cannot tell the columns of a shared one apart
    mine, theirs = (spark.createDataFrame(shelves(sizes), "list int, shelf int, blocks int") for _ in range(2))
    asked = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "h1", "h2", "uid").join(nodes.select("h1", "h2", "node"), ["h1", "h2"])
    asking = nodes.join(asked.select("node").distinct(), "node", "left_semi").select("node", "v").repartition("node")
    right = postings.join(F.broadcast(mine), "list").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = asking.mapInArrow(lean(probed), "list int, node long, v binary").join(F.broadcast(theirs), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def block(key: tuple, q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(p):
            v, ids, node = _vectors(p["v"]), p["ids"].tolist(), p["node"].to_numpy()
            of_list, asked_list = p.groupby("list").indices, q.groupby("list").indices
            qv, qs = _vectors(q["v"]), q["node"].to_numpy()
            best: dict[int, set] = {}  # per query its k + 1 best so far, over the shelf's lists
            for name, at in asked_list.items():
                own = of_list.get(name)
                for lo in range(0, len(at) if own is not None else 0, 256):
                    part = at[lo : lo + 256]
                    d, near = _top(qv[part], v[own], k + 1)
                    for i, x in enumerate(part.tolist()):
                        new = {(d[i, j], e, node[own[j]], r) for j in np.flatnonzero(near[i]).tolist() for r, e in enumerate(ids[own[j]])}
                        best[qs[x]] = set(heapq.nsmallest(k + 1, best.get(qs[x], set()) | new))
            out = [(x, c, r, e, s) for x, found in best.items() for s, e, c, r in found]
        got = pd.DataFrame(out, columns=["q", "c", "i", "vec_id", "score"])
        return got.astype({"q": "int64", "c": "int64", "i": "int32", "vec_id": "int64", "score": "float64"})

    found = left.select("shelf", "block", "list", "node", "v").groupBy("shelf", "block").cogroup(right.select("shelf", "block", "list", "node", "v", "ids").groupBy("shelf", "block")).applyInPandas(
        block, "q long, c long, i int, vec_id long, score double"
    )
    once = found.groupBy("q", "c", "i").agg(F.min("vec_id").alias("vec_id"), F.min("score").alias("score"))  # replicas
    order = Window.partitionBy("q").orderBy("score", "vec_id", "c", "i")
    few = once.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    answers = few.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score", (F.col("c") == F.col("q")).alias("same")))).alias("all"))  # k + 1 each
    own = F.expr("array_position(transform(all, x -> x.same and x.vec_id = query_id), true)")
    rest = F.when(F.col("own") > 0, F.filter("all", lambda x, i: i + 1 != F.col("own"))).otherwise(F.col("all"))
    return (
        asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("q"))
        .join(answers, "q")
        .withColumn("own", own)
        .select("query_id", F.posexplode(F.slice(rest, 1, k)).alias("pos", "x"))
        .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
    )
