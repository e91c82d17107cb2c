"""Exact top-k inner-product search by ball trees, branch and bound.

Vectors become whole numbers floor(scale * x). They are dealt into shards by space: each goes
to the nearest of some of the vectors (``PIVOTS`` at most), and cells with many vectors are
dealt out further, so that no shard outgrows ``SHARD_ROWS`` by much, however many vectors are
alike. Each shard is built once into a ball tree, stored as one row. Queries come in blocks of at most
``QUERY_BLOCK`` of one cell. A first pass answers each block from a shard of its own cell; the
k-th score found there is the score to beat in all other shards. Then the shards' outer balls
are held against each query, and only the queries that a shard may still serve are sent to it; the
tree stays where it is but for one copy for every ``TOGETHER`` requests. In a shard, a request
goes down the tree from the root with all its queries: a query leaves a node whose bound
(inner product with the centre + norm x radius) is below its current k-th score, or equal to
it where the node's smallest id cannot win the tie; of two children, the one with the higher
bound goes first, and each leaf raises the k-th scores for what follows. Rows of the results
are k for each query and shard; a window keeps the best k.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part;
a query meets vectors of its own length only; rows that repeat an id are rows of their own, each
a candidate for the other, and each answered if the id is asked for; fewer than k others give
fewer rows; an empty table gives none; null ids take no part; other columns are ignored.
Components of 2^62 or more (scaled), and inner products that could exceed 63 bits, are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterlake.llm import common

SHARD_ROWS, QUERY_BLOCK, LEAF, PIVOTS, TOGETHER = 4096, 512, 64, 4096, 64
#: Bytes of outer balls that are sent to all tasks at once.
ROOT_BYTES = 64 << 20
SCALE = 1024
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Tree:
    """Of a shard's vectors (sorted by id): nodes as arrays, rows permuted so that each node is a range."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, v: np.ndarray):
        x = v.astype(np.float64)
        order = np.arange(len(ids))
        self.lo, self.hi, self.left, self.right, centre, self.radius, self.low_id = [], [], [], [], [], [], []

        def build(a: int, z: int) -> int:
            node = len(self.lo)
            own = x[order[a:z]]
            c = own.mean(axis=0)
            far = ((own - c) ** 2).sum(axis=1)
            for held, value in ((self.lo, a), (self.hi, z), (self.left, -1), (self.right, -1), (centre, c), (self.radius, np.sqrt(far.max())), (self.low_id, ids[order[a:z]].min())):
                held.append(value)
            if z - a > LEAF and far.max() > 0:
                p = own[far.argmax()]
                q = own[((own - p) ** 2).sum(axis=1).argmax()]
                side = np.argsort(own @ (q - p), kind="stable")
                order[a:z] = order[a:z][side]
                m = (a + z) // 2
                self.left[node] = build(a, m)
                self.right[node] = build(m, z)
            return node

        if len(ids):
            build(0, len(ids))
        self.ids, self.rows, self.v = ids[order], rows[order], v[order]
        self.centre = np.array(centre).reshape(len(centre), -1)

    def pack(self) -> dict[str, bytes]:
        node = np.array([self.lo, self.hi, self.left, self.right, self.low_id], dtype="<i8")
        return {"ids": np.stack([self.ids, self.rows]).astype("<i8").tobytes(), "vectors": self.v.astype("<i8").tobytes(), "nodes": node.tobytes(), "balls": np.column_stack([self.radius, self.centre]).astype("<f8").tobytes()}

    @classmethod
    def unpack(cls, row: dict, dim: int) -> Tree:
        t = cls.__new__(cls)
        t.ids, t.rows = np.frombuffer(row["ids"], "<i8").reshape(2, -1)
        t.v = np.frombuffer(row["vectors"], "<i8").reshape(-1, dim)
        t.lo, t.hi, t.left, t.right, t.low_id = np.frombuffer(row["nodes"], "<i8").reshape(5, -1)
        balls = np.frombuffer(row["balls"], "<f8").reshape(-1, dim + 1)
        t.radius, t.centre = balls[:, 0], balls[:, 1:]
        return t

    def search(self, q_rows: np.ndarray, q: np.ndarray, k: int, kth: np.ndarray, kth_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and scores (k columns), and how many of them count, of each query here; the k-th score to beat and its id are raised in place."""
        n = len(q_rows)
        ids, best = np.full((n, k), _MOST, dtype=np.int64), np.full((n, k), _LEAST, dtype=np.int64)
        count = np.zeros(n, dtype=np.int64)
        if not len(self.ids) or not n:
            return ids, best, count
        qf = q.astype(np.float64)
        size = np.sqrt((qf**2).sum(axis=1))
        vf = self.v.astype(np.float64)
        most = np.abs(vf).max(initial=1) * np.abs(qf).max(initial=1) * q.shape[1]
        if most >= 2.0**63:
            raise OverflowError("inner products of these vectors may exceed 63 bits")
        exact = most < 2.0**53  # then float64 products and sums are whole and exact
        bound = _bounds(qf, size, self.centre, self.radius)

        def go(node: int, who: np.ndarray) -> None:
            up = bound[who, node]
            who = who[(up > kth[who]) | ((up >= kth[who]) & (self.low_id[node] <= kth_id[who]))]
            if not len(who):
                return
            if self.left[node] >= 0:
                a, b = self.left[node], self.right[node]
                first, second = (a, b) if bound[who, a].sum() >= bound[who, b].sum() else (b, a)
                go(first, who)
                go(second, who)
                return
            lo, hi = self.lo[node], self.hi[node]
            got = (qf[who] @ vf[lo:hi].T).astype(np.int64) if exact else q[who] @ self.v[lo:hi].T
            own = self.ids[lo:hi]
            keep = (got > kth[who][:, None]) | ((got == kth[who][:, None]) & (own[None, :] <= kth_id[who][:, None]))
            keep &= self.rows[lo:hi][None, :] != q_rows[who][:, None]
            for r in np.flatnonzero(keep.any(axis=1)):
                w, c = who[r], np.flatnonzero(keep[r])
                s = np.concatenate([best[w, : count[w]], got[r, c]])
                i = np.concatenate([ids[w, : count[w]], own[c]])
                at = np.lexsort((i, ~s))[:k]  # ~s falls where s rises, without overflow
                m = count[w] = len(at)
                best[w, :m], ids[w, :m] = s[at], i[at]
                if m == k and (best[w, -1] > kth[w] or best[w, -1] == kth[w] and ids[w, -1] < kth_id[w]):
                    kth[w], kth_id[w] = best[w, -1], ids[w, -1]

        go(0, np.arange(n))
        return ids, best, count


def _bounds(q: np.ndarray, size: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Of each query and ball: no inner product with a vector of the ball is larger."""
    bound = q @ centre.T + size[:, None] * radius[None, :]
    return bound + 1e-9 * (np.abs(bound) + size[:, None] * np.sqrt((centre**2).sum(axis=1))[None, :]) + 1e-3


def whole(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, dim) of each row that takes part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.coalesce(~bad, F.lit(False))

    def fit(c):
        return F.when(F.abs(c * scale) < 2.0**62, F.floor(c * scale).cast("long")).otherwise(F.raise_error(F.lit("a component is 2^62 or more")).cast("long"))

    return df.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, fit).alias("v")).withColumn("dim", F.size("v"))


TREE = ["ids", "vectors", "nodes", "balls"]
ASK = ["q_ids", "q_rows", "q", "kth", "kth_id"]
FOUND = "query_id long, query_row long, vec_id long, score long"


def _ddl(names: list[str], kind: str) -> str:
    return ", ".join(f"{c} {kind}" for c in names)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]):
    """Runs of rows of equal keys, over batches sorted by them."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        k = np.stack([held[c].to_numpy().astype(np.int64) for c in keys])
        cut = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        at = 0
        for z in cut.tolist():
            yield held.slice(at, z - at)
            at = z
        held = held.slice(at)
    if held is not None and held.num_rows:
        yield held


def _celled(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """With ``cell``, the number of the nearest pivot of the vector's length."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors of each length at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, dtype=np.int32)
            dims = batch.column("dim").to_numpy()
            v = batch.column("v")
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                x = np.array(v.take(pa.array(own)).flatten(), dtype=np.float64).reshape(-1, d)
                p = sent.value[d]
                cell[own] = (0.5 * (p**2).sum(axis=1)[None, :] - x @ p.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return vectors.mapInArrow(run, "vec_id long, v array<long>, dim int, row long, asked boolean, cell int")


def _pieces(df: DataFrame, rows: int) -> DataFrame:
    """With ``piece``: the rows of a (dim, cell) dealt into pieces of about ``rows`` rows."""
    counts = common.stored(df.groupBy("dim", "cell").agg(F.ceil(F.count("*") / rows).alias("pieces")), "cells")
    return common.salted_join(df, counts, ["dim", "cell"], "row").withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int")).drop("pieces")


def _request(t: pa.Table, dim: int, v: np.ndarray) -> dict[str, bytes]:
    n = t.num_rows
    return {"q_ids": t["vec_id"].to_numpy().astype("<i8").tobytes(), "q_rows": t["row"].to_numpy().astype("<i8").tobytes(), "q": v.tobytes(), "kth": np.full(n, _LEAST, "<i8").tobytes(), "kth_id": np.full(n, _MOST, "<i8").tobytes()}


def _opened(row: dict) -> list[np.ndarray]:
    ids, rows, q, kth, kth_id = (np.frombuffer(row[c], "<i8") for c in ASK)
    return [ids, rows, q.reshape(len(ids), -1), kth.copy(), kth_id.copy()]


def _rows(ids, rows, found) -> pa.RecordBatch:
    got, best, count = found
    at = np.arange(got.shape[1])[None, :] < count[:, None]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, count)), pa.array(np.repeat(rows, count)), pa.array(got[at]), pa.array(best[at])], names=["query_id", "query_row", "vec_id", "score"])


def search(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the rows of ``vectors`` (as ``whole`` gives them) that the condition ``queries`` picks."""
    spark = vectors.sparkSession
    common.ready(spark)
    asked = F.coalesce(queries, F.lit(False)).alias("asked")
    vectors = common.stored(vectors.select("vec_id", "v", "dim", F.monotonically_increasing_id().alias("row"), asked), "vectors")
    sizes = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each vector length
    pivots = {}
    for dim, n in sizes.items():
        own = vectors.where(F.col("dim") == dim).select("row", "v").orderBy(F.xxhash64("row", F.lit("pivot")), "row").limit(min(PIVOTS, -(-n // SHARD_ROWS)))
        pivots[dim] = np.array([r["v"] for r in own.collect()], dtype=np.float64).reshape(-1, dim)
    celled = common.stored(_celled(vectors, pivots), "celled")
    common.discard(vectors)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("piece", pa.int32()), *((c, pa.binary()) for c in TREE)])
        for t in _groups(batches, ["dim", "cell", "piece"]):
            dim = t["dim"][0].as_py()
            v = np.array(t["v"].combine_chunks().flatten()).reshape(-1, dim)
            row = {c: t[c][0].as_py() for c in ("dim", "cell", "piece")}
            yield pa.RecordBatch.from_pylist([row | Tree(t["vec_id"].to_numpy(), t["row"].to_numpy(), v).pack()], schema=kind)

    by = ["dim", "cell", "piece"]
    dealt = _pieces(celled.drop("asked"), SHARD_ROWS).select(*by, "vec_id", "row", "v")
    trees = dealt.repartition(*by).sortWithinPartitions(*by, "vec_id").mapInArrow(build, f"{_ddl(by, 'int')}, {_ddl(TREE, 'binary')}")
    trees = common.stored(trees.withColumn("shard", F.monotonically_increasing_id()), "trees")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), *((c, pa.binary()) for c in ASK)])
        for t in _groups(batches, by):
            dim = t["dim"][0].as_py()
            row = {"dim": dim, "cell": t["cell"][0].as_py()}
            yield pa.RecordBatch.from_pylist([row | _request(t, dim, np.array(t["v"].combine_chunks().flatten(), dtype="<i8"))], schema=kind)

    blocks = _pieces(celled.where("asked"), QUERY_BLOCK).select(*by, "vec_id", "row", "v").repartition(*by).sortWithinPartitions(*by, "vec_id").mapInArrow(pack, f"dim int, cell int, {_ddl(ASK, 'binary')}")

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), *((c, pa.binary()) for c in ASK), *((c, pa.binary()) for c in ("f_ids", "f_best", "f_count"))])
        for batch in batches:
            for row in batch.to_pylist():
                ids, rows, q, kth, kth_id = _opened(row)
                found = Tree.unpack(row, row["dim"]).search(rows, q, k, kth, kth_id)
                out = {c: row[c] for c in ("dim", "shard", "q_ids", "q_rows", "q")} | {"kth": kth.tobytes(), "kth_id": kth_id.tobytes()}
                out |= {c: x.astype("<i8").tobytes() for c, x in zip(("f_ids", "f_best", "f_count"), found)}
                yield pa.RecordBatch.from_pylist([out], schema=kind)

    own = trees.where("piece = 0").drop("piece")
    primed = blocks.join(own, ["dim", "cell"]).mapInArrow(first_pass, f"dim int, shard long, {_ddl(ASK, 'binary')}, f_ids binary, f_best binary, f_count binary")
    primed = common.stored(primed, "primed")

    def first_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, rows, *_ = _opened(row)
                got, best, count = (np.frombuffer(row[c], "<i8") for c in ("f_ids", "f_best", "f_count"))
                yield _rows(ids, rows, (got.reshape(-1, k), best.reshape(-1, k), count))

    found = primed.mapInArrow(first_found, FOUND)
    asks = [_routed(primed, part) for part in _roots(trees, sizes)]
    if asks:
        requests = asks[0]
        for x in asks[1:]:
            requests = requests.unionByName(x)
        found = found.unionByName(_answered(trees, common.stored(requests, "requests"), k))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _roots(trees: DataFrame, sizes: dict[int, int]) -> Iterator[dict[int, dict]]:
    """The shards' outer balls by vector length, in parts of at most about ``ROOT_BYTES``."""
    listing = trees.select("dim", "shard", F.substring("balls", F.lit(1), 8 * (F.col("dim") + 1)).alias("ball"), F.substring("nodes", F.octet_length("nodes").cast("int") / 5 * 4 + 1, F.lit(8)).alias("low_id"))
    size = trees.agg(F.sum(8 * (F.col("dim") + 1))).first()[0] or 0
    parts = size // ROOT_BYTES + 1
    for p in range(parts if size else 0):
        rows = listing.where(F.pmod(F.xxhash64("shard"), F.lit(parts)) == p).collect()
        out = {}
        for dim in sizes:
            own = [r for r in rows if r["dim"] == dim]
            if own:
                ball = np.frombuffer(b"".join(bytes(r["ball"]) for r in own), "<f8").reshape(-1, dim + 1)
                out[dim] = {"shard": np.array([r["shard"] for r in own]), "radius": ball[:, 0], "centre": ball[:, 1:], "low_id": np.frombuffer(b"".join(bytes(r["low_id"]) for r in own), "<i8")}
        yield out


def _routed(primed: DataFrame, roots: dict[int, dict]) -> DataFrame:
    """(dim, shard, queries) for each shard but a block's first and the queries of the block that it may serve."""
    sent = primed.sparkSession.sparkContext.broadcast(roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), *((c, pa.binary()) for c in ASK)])
        for batch in batches:
            for row in batch.to_pylist():
                root = sent.value.get(row["dim"])
                if root is None:
                    continue
                cols = _opened(row)
                qf = cols[2].astype(np.float64)
                bound = _bounds(qf, np.sqrt((qf**2).sum(axis=1)), root["centre"], root["radius"])
                kth, kth_id = cols[3][:, None], cols[4][:, None]
                keep = (bound > kth) | ((bound >= kth) & (root["low_id"][None, :] <= kth_id))
                keep[:, root["shard"] == row["shard"]] = False
                rows = []
                for j in np.flatnonzero(keep.any(axis=0)):
                    own = keep[:, j]
                    rows.append({"dim": row["dim"], "shard": int(root["shard"][j])} | {c: x[own].astype("<i8").tobytes() for c, x in zip(ASK, cols)})
                    if len(rows) == 64:
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return primed.mapInArrow(run, f"dim int, shard long, {_ddl(ASK, 'binary')}")


def _answered(trees: DataFrame, requests: DataFrame, k: int) -> DataFrame:
    """The rows that the requests find: each tree goes once to every ``TOGETHER`` requests for it, and is opened once there."""
    chunks = common.stored(requests.groupBy("shard").agg(F.ceil(F.count("*") / TOGETHER).alias("chunks")), "request-chunks")
    many = common.salted_join(requests, chunks, "shard", "q_rows")
    asked = many.select("dim", "shard", F.pmod(F.xxhash64("q_rows"), F.col("chunks")).alias("chunk"), F.lit(1).alias("kind"), *ASK, *(F.lit(None).cast("binary").alias(c) for c in TREE))
    copies = trees.join(common.sized(chunks), "shard").select("dim", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("kind"), *(F.lit(None).cast("binary").alias(c) for c in ASK), *TREE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["kind"] == 0:
                    at, tree = row["shard"], Tree.unpack(row, row["dim"])
                    continue
                if row["shard"] != at:
                    raise ValueError("a request's tree is missing")
                ids, rows, q, kth, kth_id = _opened(row)
                yield _rows(ids, rows, tree.search(rows, q, k, kth, kth_id))

    both = asked.unionByName(copies).repartition("shard", "chunk").sortWithinPartitions("shard", "chunk", "kind")
    return both.mapInArrow(run, FOUND)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(whole(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), F.col("vec_id") % 100 == 0)


ORACLE = f"""WITH c AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT rid, vec_id, len(v) AS dim, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM c),
s AS (SELECT a.rid, a.vec_id AS query_id, b.rid AS other, b.vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score FROM e a JOIN e b ON a.i = b.i AND a.dim = b.dim AND a.rid <> b.rid WHERE a.vec_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""
