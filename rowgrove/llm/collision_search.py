"""Approximate nearest neighbours by collision counting over single projections.

Every vector is projected on ``PROJECTIONS`` random directions, and each block of vectors keeps one sorted array per direction. A query opens a
window around its own projection in every array. Widening the radius step by step (virtual rehashing) widens the windows,
and each vector that enters one counts a collision; vectors that collide in enough windows are verified by their exact
distance in double precision. A query stops in a block when it has verified enough neighbours within the radius, so what it
would still miss is what the collision threshold misses.

Blocks of vectors meet blocks of queries (a stated query set): rows of vectors are dealt by a hash into blocks of a fixed expected size, and each
query block's results are merged by a grouped top-k. Nothing is collected.

Defined results: rows without an id and vectors that are null, empty, zero, or hold null or non-finite components take no part, as queries or candidates; vectors of another
dimension than the query's are no candidates; rows with the query's id are its own; ties go to the smaller id; repeated rows count once, and of rows with one id and
different vectors the one of fewest components and smallest numbers, in their order; with fewer candidates than
asked for all are returned; an empty table gives an empty result; other columns are ignored.

Work: a window that holds a near vector holds about a third of all others too (projections of far vectors crowd together), so each query's windows touch a share
of all vectors in every projection, whatever the layout. Blocks keep that in memory, at one byte for a collision count, instead of shuffling a row for each
collision. The work is queries times vectors; a constant number of queries against a growing table is linear.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_small, reliable, ship, table

NEIGHBOURS = 10
QUERY_STEP = 100
PROJECTIONS = 128
#: Half a window for radius 1: a vector at the radius collides with a chance of P1 in each projection.
HALF_WINDOW, P1 = 0.9, 0.6319
#: Standard deviations below the expected collisions at which the threshold lies.
SLACK = 2.0
#: Factor between radii.
WIDEN = 1.06
#: Vectors in a block, queries in a block, about.
BLOCK_ROWS, QUERY_ROWS = 16_384, 8_192
SEED = 90_001


class SortedProjections:
    """One sorted array per direction over the vectors of a block."""

    def __init__(self, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = SEED):
        self.vectors = vectors
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], projections)).astype(np.float32)
        projected = (vectors.astype(np.float32) @ self.directions).T
        self.order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(projected, self.order, axis=1)
        self.threshold = max(1, int(P1 * projections - SLACK * (P1 * (1 - P1) * projections) ** 0.5))

    def start_radius(self, queries: np.ndarray) -> float:
        """Half the typical distance to the nearest of a few vectors: a start only, any smaller radius finds the same."""
        few = self.vectors[:: max(1, len(self.vectors) // 64)].astype(np.float64)
        near = [np.sqrt(((few - q) ** 2).sum(axis=1)) for q in queries[:: max(1, len(queries) // 16)].astype(np.float64)]
        near = [d[d > 0].min() for d in near if (d > 0).any()]
        return 0.5 * float(np.median(near)) if near else 1.0

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, distances) of the k nearest verified vectors of each query, nearest first."""
        n, m = len(self.vectors), len(self.sorted)
        at = (queries.astype(np.float32) @ self.directions).T
        low = np.stack([np.searchsorted(s, a) for s, a in zip(self.sorted, at, strict=True)])
        high = low.copy()
        count = np.zeros((len(queries), n), np.uint8 if m < 256 else np.uint16)
        found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in queries]
        open_ = np.arange(len(queries))
        radius = self.start_radius(queries)
        while len(open_):
            half = np.float32(HALF_WINDOW * radius)
            wide = [(np.searchsorted(s, a[open_] - half), np.searchsorted(s, a[open_] + half, side="right")) for s, a in zip(self.sorted, at, strict=True)]
            new_low, new_high = np.minimum(low[:, open_], [x for x, _ in wide]), np.maximum(high[:, open_], [x for _, x in wide])
            still = []
            for i, q in enumerate(open_.tolist()):
                rings = [o[a:b] for o, x, y, z, w in zip(self.order, new_low[:, i], low[:, q], high[:, q], new_high[:, i], strict=True) for a, b in ((x, y), (z, w)) if a < b]
                before = count[q]
                now = before + np.bincount(np.concatenate(rings), minlength=n).astype(before.dtype) if rings else before
                fresh = np.flatnonzero((now >= self.threshold) & (before < self.threshold))
                count[q] = now
                have_ids, have = found[q]
                if len(fresh):
                    fresh = fresh[ids[fresh] != own[q]]
                    distance = np.sqrt(((self.vectors[fresh].astype(np.float64) - queries[q].astype(np.float64)) ** 2).sum(axis=1))
                    have_ids, have = np.concatenate((have_ids, ids[fresh])), np.concatenate((have, distance))
                    best = np.lexsort((have_ids, have))[:k]
                    have_ids, have = have_ids[best], have[best]
                    found[q] = have_ids, have
                covered = (new_low[:, i] == 0).all() and (new_high[:, i] == n).all()
                if not covered and (len(have) < k or have[k - 1] > radius):
                    still.append(q)
            low[:, open_], high[:, open_] = new_low, new_high
            open_ = np.array(still, np.int64)
            radius *= WIDEN
        return found


def _usable(vector):
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(plain, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query, *, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest verified vectors of every row for which ``is_query`` (a condition) holds."""
    ship(vectors.sparkSession)
    usable = vectors.where(_usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.size(vector).alias("dim"), is_query.alias("asks"))
    # Ids that occur more than once are few or none; only those are put in order.
    twice = usable.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if not twice.isEmpty():
        first = usable.join(broadcast_small(twice), "id", "left_semi").groupBy("id").agg(F.min(F.struct("dim", "v", "asks")).alias("r")).select("id", "r.v", "r.dim", "r.asks")
        usable = usable.join(broadcast_small(twice), "id", "left_anti").unionByName(first)
        usable = reliable(usable)
    rows, asking = usable.agg(F.count("*"), F.count_if("asks")).first()
    blocks, asks = max(1, -(-rows // block_rows)), max(1, -(-asking // query_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    ask = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(asks)).cast("int")
    candidates = usable.withColumn("block", block).withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))) if asks > 1 else F.lit(0))
    questions = usable.where("asks").withColumn("ask", ask).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(these: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(these) or not len(queries):
            return empty
        these, queries = these.sort_values("id"), queries.sort_values("id")
        ids, own = these["id"].to_numpy(np.int64), queries["id"].to_numpy(np.int64)
        index = SortedProjections(np.stack(these["v"]))
        asked = np.stack(queries["v"])
        out = [empty]
        for a in range(0, len(own), 256):  # bounds the table of counts
            for q, (near, score) in zip(own[a : a + 256], index.search(asked[a : a + 256], own[a : a + 256], ids, k), strict=True):
                out.append(pd.DataFrame({"query_id": q, "vec_id": near, "score": score}))
        return pd.concat(out, ignore_index=True)

    met = candidates.groupBy("block", "ask", "dim").cogroup(questions.groupBy("block", "ask", "dim")).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(QUERY_STEP)) == 0)
