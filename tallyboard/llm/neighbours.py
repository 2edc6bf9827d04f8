"""Nearest neighbours by inner product: a vantage-point tree for every shard.

Vectors get one more component, sqrt(M**2 - |x|**2), with M the largest norm: then the
largest inner product is the smallest distance, and the triangle inequality holds. Rows are
dealt to shards by the nearest of some pivots, shards above a size are cut into pieces by a
hash, and every piece is laid out as a balanced vantage-point tree: a vantage point, the
half of the rest that is nearer to it, the farther half, and the rings (least and greatest
distance) that these fill. A query first searches the pieces of its own shard and then,
knowing how near its answers are, the other shards.

A shard or subtree is passed over when ``factor`` times the distance that the triangle
inequality proves exceeds the distance of the last answer so far. Factor one passes over
only what cannot hold an answer, so the search is exact; larger factors relax that.

Equal vectors are one entry with its smallest ids (one more than are asked for, so that a
query may be among them): more can't be answers. Equal query vectors are searched once.
Pieces and blocks of queries are bounded, so is the memory of a task. Inner products are
summed in the order of components, in double precision.

Bounds: pivots are a fixed number of vectors with the least hashes, at most ``MAX_PIVOTS``;
every vector is indexed. The rows per shard that are broadcast or brought to the driver are
as many as pivots, and one more per length of vectors without a pivot.

Edge cases: rows without an id, null, empty or zero vectors, and vectors that hold null or
non-finite components take no part. Vectors are compared with those of their own length.
Of rows that repeat an id the smallest vector takes part. Ties go to the smaller id. Fewer
candidates than asked for are all returned. An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.session import materialise

NEAREST = 20
#: Relaxation of the triangle inequality; one is exact.
FACTOR = 1.0
SHARD_ROWS = 10_000
BLOCK_QUERIES = 1_000
MAX_PIVOTS = 4096
LEAF = 128
_PAIRS = 50_000
_SLACK = 1e-6


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, vector (doubles), hash of the rows that take part, one per id."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    ).filter(
        F.col("vec_id").isNotNull()
        & F.forall("vector", finite)
        & F.exists("vector", lambda x: F.coalesce(x != 0, F.lit(False)))
    )
    repeated = materialise(
        rows.groupBy("vec_id").agg(F.count("*").alias("rows")).filter("rows > 1").drop("rows"),
        "repeated-ids",
    )
    if not repeated.isEmpty():
        one = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector"))
        rows = rows.join(repeated, "vec_id", "left_anti").unionByName(one)
    return rows.withColumn("hash", F.xxhash64("vector"))


def distinct_vectors(rows: DataFrame, nearest: int) -> DataFrame:
    """hash, vector, dims and ids: the ``nearest`` + 1 smallest, ascending."""
    order = Window.partitionBy("hash", "vector").orderBy("vec_id")
    first = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= nearest + 1)
    held = first.groupBy("hash", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return materialise(held.withColumn("dims", F.size("vector")), "vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _lift(x: np.ndarray, most: float) -> np.ndarray:
    """The component that makes all norms equal to ``most``."""
    return np.sqrt(np.maximum(most * most - np.einsum("ij,ij->i", x, x), 0))


def _pivot_distances(x: np.ndarray, pivots: np.ndarray, most: float, lifted: bool) -> np.ndarray:
    """Distances to pivots of rows (lifted) or of queries, whose last component is 0."""
    squares = np.einsum("ij,ij->i", x, x)[:, None]
    products = x @ pivots.T
    if lifted:
        products += _lift(x, most)[:, None] * _lift(pivots, most)[None, :]
        squares = most * most
    return np.sqrt(np.maximum(squares + most * most - 2 * products, 0))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = np.asarray(batch["dims"])
    for d in np.unique(dims):
        yield int(d), batch.filter(pa.array(dims == d))


def _homes(rows: DataFrame, pivots: dict[int, np.ndarray], most: float, lifted: bool) -> DataFrame:
    """``rows`` with shard (the nearest pivot of its length, or -1) and distance from it."""
    names = rows.columns

    def deal(batches):
        for batch in batches:
            for d, part in _by_length(batch):
                if d in pivots:
                    far = _pivot_distances(_matrix(part["vector"]), pivots[d], most, lifted)
                    shard = far.argmin(1)
                    distance = far[np.arange(len(far)), shard]
                else:
                    shard, distance = np.full(len(part), -1), np.zeros(len(part))
                columns = [*part.columns, pa.array(shard, pa.int32()), pa.array(distance, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "shard", "distance"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(deal, f"{kinds}, shard int, distance double")


def lay_out(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` in the order of the tree, and the rings of the node at each place.

    A node over places lo to hi has its vantage point at lo, the nearer half up to
    (lo + 1 + hi) // 2 and then the farther half; up to ``leaf`` places (two or more) are a leaf.
    """
    n = len(x)
    order, rings = np.arange(n), np.full((n, 4), np.nan)
    most = np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0))
    lift = _lift(x, most)
    nodes = [(0, n)]
    while nodes:
        lo, hi = nodes.pop()
        if hi - lo <= leaf:
            continue
        v, rest = order[lo], order[lo + 1 : hi]
        near = np.sqrt(np.maximum(2 * most * most - 2 * (x[rest] @ x[v] + lift[rest] * lift[v]), 0))
        half = (lo + 1 + hi) // 2 - lo - 1
        by = np.argpartition(near, half)
        order[lo + 1 : hi], near = rest[by], near[by]
        rings[lo] = near[:half].min(), near[:half].max(), near[half:].min(), near[half:].max()
        nodes += [(lo + 1, lo + 1 + half), (lo + 1 + half, hi)]
    return order, rings


class Search:
    """The ``nearest`` best rows of one tree for a block of queries."""

    def __init__(self, x, ids, rings, queries, floor, nearest: int, factor: float, leaf: int = LEAF):
        self.x, self.ids, self.rings, self.q = x, ids, rings, queries
        self.nearest, self.factor, self.leaf = nearest, factor, leaf
        self.most = np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0))
        self.square = np.einsum("ij,ij->i", queries, queries)
        size = np.sqrt(self.square)
        self.slack = _SLACK * (size + self.most)
        self.noise = 1e-9 * size * self.most
        self.score = np.full((len(queries), nearest), -np.inf)
        self.row = np.full((len(queries), nearest), -1)
        self.floor = np.asarray(floor, np.float64)
        self.last = self.floor.copy()
        self.scored = 0

    def _distance(self, who, score):
        return np.sqrt(np.maximum(self.square[who] + self.most**2 - 2 * score, 0))

    def run(self) -> None:
        nodes = [(0, len(self.x), np.arange(len(self.q)), np.zeros(len(self.q)))]
        while nodes:
            lo, hi, who, proven = nodes.pop()
            reach = self._distance(who, self.last[who]) + self.slack[who]
            who = who[~(self.factor * proven > reach)]
            if not len(who):
                continue
            if hi - lo <= self.leaf:
                self._offer(who, lo, hi)
                continue
            self._offer(who, lo, lo + 1)
            away = self._distance(who, self.q[who] @ self.x[lo])
            a, b, c, d = self.rings[lo]
            near = np.maximum(np.maximum(away - b, a - away), 0)
            far = np.maximum(np.maximum(away - d, c - away), 0)
            first, mid = near <= far, (lo + 1 + hi) // 2
            # taken from the end: the nearer half for those it is nearer to, then the other
            nodes.append((lo + 1, mid, who[~first], near[~first]))
            nodes.append((mid, hi, who, far))
            nodes.append((lo + 1, mid, who[first], near[first]))

    def _offer(self, who: np.ndarray, lo: int, hi: int) -> None:
        about = self.q[who] @ self.x[lo:hi].T
        self.scored += about.size
        at, row = np.nonzero(about >= (self.last[who] - self.noise[who])[:, None])
        if not len(at):
            return
        at, row = who[at], row + lo
        score = np.empty(len(at))
        for k in range(0, len(at), _PAIRS):
            s = slice(k, k + _PAIRS)
            score[s] = np.cumsum(self.q[at[s]] * self.x[row[s]], axis=1)[:, -1]
        touched = np.unique(at)
        held = self.row[touched] >= 0
        at = np.concatenate([np.repeat(touched, held.sum(1)), at])
        row = np.concatenate([self.row[touched][held], row])
        score = np.concatenate([self.score[touched][held], score])
        order = np.lexsort((self.ids[row], -score, at))
        at, row, score = at[order], row[order], score[order]
        nth = _nth(at)
        kept = nth < self.nearest
        self.row[at[kept], nth[kept]] = row[kept]
        self.score[at[kept], nth[kept]] = score[kept]
        self.last[touched] = np.maximum(self.floor[touched], self.score[touched, -1])


def _nth(groups: np.ndarray) -> np.ndarray:
    """The place of each element in its stretch of equal ones."""
    at = np.arange(len(groups))
    opens = np.append(True, groups[1:] != groups[:-1])[: len(groups)]
    return at - np.maximum.accumulate(np.where(opens, at, 0))


_TREE = pa.schema(
    [("dims", pa.int32()), ("shard", pa.int32()), ("piece", pa.int64()), ("place", pa.int32()),
     ("ids", pa.list_(pa.int64())), ("vector", pa.list_(pa.float64())), ("rings", pa.list_(pa.float64()))]
)
_TREE_DDL = (
    "dims int, shard int, piece long, place int, ids array<long>, vector array<double>, rings array<double>"
)
_HIT = pa.schema([("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_HIT_DDL = "key long, vec_id long, score double"


def _plant(table: pa.Table) -> pa.Table:
    table = table.sort_by("hash")
    order, rings = lay_out(_matrix(table["vector"]))
    table = table.take(pa.array(order))
    columns = [table[c].combine_chunks() for c in ("dims", "shard", "piece")]
    columns += [pa.array(np.arange(len(order)), pa.int32()), table["ids"], table["vector"]]
    flat = pa.array(rings.ravel(), pa.float64())
    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 4), pa.int32()), flat))
    return pa.Table.from_arrays(columns, names=_TREE.names).cast(_TREE)


class Index:
    """Trees of all pieces (``trees``), written to the shared folder, and what is known of
    each shard: its rows, rings around its pivot and number of pieces (``shards``)."""

    def __init__(self, vectors: DataFrame, shard_rows: int = SHARD_ROWS):
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
        rows, self.most = vectors.agg(F.count("*"), F.max(norm)).first()
        wanted = min(MAX_PIVOTS, -(-rows // shard_rows))
        drawn = [r.vector for r in vectors.orderBy("hash", "vector").limit(wanted).select("vector").collect()]
        self.pivots = {d: np.array([v for v in drawn if len(v) == d]) for d in {len(v) for v in drawn}}
        if rows == 0:
            self.most = 0.0
        homes = materialise(_homes(vectors, self.pivots, self.most, True), "homes")
        self.shards = materialise(
            homes.groupBy("dims", "shard").agg(
                F.count("*").alias("rows"), F.min("distance").alias("least"), F.max("distance").alias("greatest")
            ).withColumn("pieces", F.ceil(F.col("rows") / shard_rows)),
            "shards",
        )
        pieced = homes.join(F.broadcast(self.shards.select("dims", "shard", "pieces")), ["dims", "shard"])
        # the hash dealt rows their pivots' order, so pieces go by another one
        pieced = pieced.withColumn("piece", F.pmod(F.xxhash64("hash", "shard"), "pieces"))
        self.trees = materialise(
            pieced.select("dims", "shard", "piece", "hash", "ids", "vector")
            .groupBy("dims", "shard", "piece")
            .applyInArrow(_plant, _TREE_DDL),
            "trees",
        )

    def search(self, asked: DataFrame, nearest: int = NEAREST, factor: float = FACTOR) -> DataFrame:
        """key, vec_id, score: the best ``nearest`` rows for each of ``asked`` (key, vector)."""
        asked = asked.withColumn("dims", F.size("vector"))
        homes = materialise(_homes(asked, self.pivots, self.most, False).drop("distance"), "asked")
        floor = F.lit(float("-inf"))
        near = materialise(self._visit(homes.withColumn("floor", floor), nearest, factor), "near-hits")
        last = best(near, nearest).groupBy("key").agg(F.min("score").alias("floor"), F.count("*").alias("found"))
        known = homes.join(last, "key", "left").withColumn(
            "floor", F.when(F.col("found") >= nearest, F.col("floor")).otherwise(floor)
        )
        others = known.mapInArrow(
            self._others(factor), "key long, vector array<double>, dims int, shard int, floor double"
        )
        return best(near.unionByName(self._visit(others, nearest, factor)), nearest)

    def _others(self, factor: float):
        """Other shards that the triangle inequality, relaxed, doesn't rule out."""
        rings: dict[int, list] = {}
        for d in self.pivots:
            # one row per pivot
            found = {r.shard: r for r in self.shards.filter(F.col("dims") == d).collect()}
            rings[d] = [
                (found[k].least, found[k].greatest) if k in found else None for k in range(len(self.pivots[d]))
            ]
        pivots, most = self.pivots, self.most

        def deal(batches):
            for batch in batches:
                for d, part in _by_length(batch):
                    if d not in pivots:
                        continue
                    x, home = _matrix(part["vector"]), np.asarray(part["shard"])
                    away = _pivot_distances(x, pivots[d], most, False)
                    square = np.einsum("ij,ij->i", x, x)
                    floor = np.asarray(part["floor"], np.float64)
                    reach = np.sqrt(np.maximum(square + most * most - 2 * floor, 0))
                    reach += _SLACK * (np.sqrt(square) + most)
                    for k, ring in enumerate(rings[d]):
                        if ring is None:
                            continue
                        proven = np.maximum(np.maximum(away[:, k] - ring[1], ring[0] - away[:, k]), 0)
                        open_to = ~(factor * proven > reach) & (home != k)
                        if open_to.any():
                            some = part.filter(pa.array(open_to))
                            shard = pa.array(np.full(len(some), k), pa.int32())
                            yield pa.RecordBatch.from_arrays(
                                [some["key"], some["vector"], some["dims"], shard, some["floor"]],
                                ["key", "vector", "dims", "shard", "floor"],
                            )

        return deal

    def _visit(self, asked: DataFrame, nearest: int, factor: float) -> DataFrame:
        """Search all pieces of a shard for each row (key, vector, dims, shard, floor)."""
        asked = materialise(asked, "visits")
        # one row per shard that is asked
        blocks = asked.groupBy("dims", "shard").agg(
            F.ceil(F.count("*") / BLOCK_QUERIES).alias("blocks")
        )
        told = materialise(blocks.join(self.shards.select("dims", "shard", "pieces"), ["dims", "shard"]), "blocks")
        each = asked.join(F.broadcast(told), ["dims", "shard"]).select(
            "dims", "shard",
            F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"),
            F.pmod(F.xxhash64("key"), "blocks").alias("block"),
            "key", "vector", "floor",
        )
        trees = self.trees.join(F.broadcast(told.drop("pieces")), ["dims", "shard"]).select(
            *_TREE.names, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        )
        by = ["dims", "shard", "piece", "block"]

        def look(tree: pa.Table, block: pa.Table) -> pa.Table:
            if not len(tree) or not len(block):
                return _HIT.empty_table()
            tree = tree.sort_by("place")
            ids = tree["ids"].combine_chunks()
            firsts = np.asarray(ids.offsets)
            found = Search(
                _matrix(tree["vector"]), np.asarray(ids.values)[firsts[:-1]], _matrix(tree["rings"]),
                _matrix(block["vector"]), block["floor"], nearest, factor,
            )
            found.run()
            return _hits(found, np.asarray(block["key"]), np.asarray(ids.values), firsts)

        return each.groupBy(*by).cogroup(trees.groupBy(*by)).applyInArrow(
            lambda block, tree: look(tree, block), _HIT_DDL
        )


def _hits(found: Search, keys: np.ndarray, ids: np.ndarray, firsts: np.ndarray) -> pa.Table:
    """The ids of the vectors found, the best ``nearest`` of each query."""
    at, nth = np.nonzero(found.row >= 0)
    row, score = found.row[at, nth], found.score[at, nth]
    copies = firsts[row + 1] - firsts[row]
    first = np.repeat(firsts[row] - np.cumsum(copies) + copies, copies)
    vec = ids[first + np.arange(copies.sum())]
    at, score = np.repeat(at, copies), np.repeat(score, copies)
    order = np.lexsort((vec, -score, at))
    at, vec, score = at[order], vec[order], score[order]
    kept = _nth(at) < found.nearest
    return pa.Table.from_arrays(
        [pa.array(keys[at[kept]], pa.int64()), pa.array(vec[kept], pa.int64()), pa.array(score[kept], pa.float64())],
        schema=_HIT,
    )


def best(hits: DataFrame, nearest: int) -> DataFrame:
    """The ``nearest`` best of each key."""
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= nearest)
    return ranked.drop("nth")


def nearest_neighbours(
    embeddings: DataFrame,
    queries: DataFrame,
    nearest: int = NEAREST,
    factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score of ``queries`` (rows of ``embeddings``, by vec_id)."""
    rows = materialise(usable(embeddings), "usable")
    index = Index(distinct_vectors(rows, nearest), shard_rows)
    own = rows.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    asked = materialise(own.groupBy("hash", "vector").agg(F.min("vec_id").alias("key")), "asked-vectors")
    who = own.join(asked, ["hash", "vector"]).select(F.col("vec_id").alias("query_id"), "key")
    # one more than asked for, as a query may find itself
    hits = index.search(asked.select("key", "vector"), nearest + 1, factor)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        who.join(hits, "key")
        .filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )


def query(spark, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(embeddings, embeddings.filter("vec_id % 20 = 0"))


SQL = r"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
