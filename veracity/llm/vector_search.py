"""Exact top-k inner-product search by branch and bound over ball trees.

The top of the tree covers the whole table: it is cut from a bounded sample of the rows, halving along
the widest coordinate, and each row goes down to one of its balls, whose centre is the sample's mean
and whose radius is the largest distance of any row in it.  A ball is a shard; one with too many rows
(copies of a vector, say) is dealt to several shards by a hash.  No row of a ball scores above
``query . centre + |query| radius``.

Every query is searched first in the ball with the highest bound.  Its kth score there goes with it:
only balls that can reach that score meet the query at all.  In a shard the tree goes on: a node is
bounded only for queries whose bound at its parent reaches their kth score so far, leaves are visited
in the order of their bounds, and a query leaves off once the bound is below its kth score.  The
queries of a block advance together: those whose next leaf is the same are scored in one product.
Shards stream through their task, rows before queries, so neither is copied for the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracity.llm.storage import materialize

LOW = np.iinfo(np.int64).min


class BallTree:
    """Median cuts along the widest coordinate down to ``size`` rows (or to ``most`` leaves), with a ball for every node."""

    def __init__(self, x: np.ndarray, size: int, most: int = 1 << 30):
        self.cut: list[tuple | None] = [None]  # (axis, value, left, right), None for a leaf
        self.rows = {0: np.arange(len(x))}
        open_, leaves = [0], 1
        while open_:
            node = open_.pop(0)
            rows = self.rows[node]
            spread = np.ptp(x[rows], axis=0) if len(rows) else np.zeros(1)
            if len(rows) <= size or leaves >= most or not spread.any():
                continue
            axis = int(spread.argmax())
            value = np.partition(x[rows, axis], len(rows) // 2)[len(rows) // 2]
            left = x[rows, axis] < value
            if not left.any():  # the lower half are copies of the median
                value = x[rows, axis][x[rows, axis] > value].min()
                left = x[rows, axis] < value
            self.cut[node] = (axis, value, len(self.cut), len(self.cut) + 1)
            for part in (rows[left], rows[~left]):
                self.rows[len(self.cut)] = part
                open_.append(len(self.cut))
                self.cut.append(None)
            leaves += 1
        self.leaves = [i for i, c in enumerate(self.cut) if c is None]
        self.centre = np.array([x[self.rows[i]].mean(axis=0) if len(self.rows[i]) else np.zeros(x.shape[1]) for i in range(len(self.cut))])
        self.radius = np.array([np.sqrt(((x[r] - c) ** 2).sum(axis=1).max()) if len(r) else 0.0 for r, c in zip((self.rows[i] for i in range(len(self.cut))), self.centre)])

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf (its number among the leaves) of each row."""
        number = {leaf: i for i, leaf in enumerate(self.leaves)}
        out, open_ = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while open_:
            node, rows = open_.pop()
            if self.cut[node] is None:
                out[rows] = number[node]
            elif len(rows):
                axis, value, left, right = self.cut[node]
                low = x[rows, axis] < value
                open_ += [(left, rows[low]), (right, rows[~low])]
        return out

    def bounds(self, q: np.ndarray, least: np.ndarray, slack: float) -> np.ndarray:
        """Upper bound of each query's scores in each leaf; LOW where a node above it can't reach ``least``."""
        norm = np.sqrt((q**2).sum(axis=1))
        upper = np.full((len(q), len(self.cut)), LOW)
        alive = {0: np.arange(len(q))}
        for node in range(len(self.cut)):
            who = alive.pop(node)
            upper[who, node] = np.floor(q[who] @ self.centre[node] + norm[who] * self.radius[node] + slack).astype(np.int64)
            if self.cut[node] is not None:
                alive[self.cut[node][2]] = alive[self.cut[node][3]] = who[upper[who, node] >= least[who]]
        return upper[:, self.leaves]


class Shard:
    """The rows of one shard: ids and whole-number vectors of one length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = 128):
        order = np.argsort(ids, kind="stable")
        self.ids, self.whole, self.leaf = ids[order], x[order], leaf
        self.x, self.tree = self.whole.astype(np.float64), None

    def search(self, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int):
        """(query row, id, score) of every query's k best rows that score ``least`` or more.

        Rows with the query's own id are left out; ties go to the smaller id.  Scores are exact: products
        of whole numbers below 2**43 in sum are exact in doubles; above that Python's integers are used,
        and scores outside 64 bits are held at its ends.
        """
        ids = self.ids
        bound = float(np.abs(q).max(initial=0)) * float(np.abs(self.whole).max(initial=0)) * max(1, self.x.shape[1])
        if bound >= 2.0**42:
            exact = q.astype(object) @ self.whole.T.astype(object)
            for i in range(len(q)):
                rows = sorted((j for j in range(len(ids)) if ids[j] != q_ids[i] and exact[i, j] >= least[i]), key=lambda j: (-exact[i, j], ids[j]))[:k]
                yield from ((i, ids[j], max(min(int(exact[i, j]), 2**63 - 1), -(2**63))) for j in rows)
            return
        self.tree = self.tree or BallTree(self.x, self.leaf)
        q = q.astype(np.float64)
        leaves = [self.tree.rows[i] for i in self.tree.leaves]
        # one key holds a score and, in its low bits, the rank of the id from behind: larger is better
        shift = max(1, int(len(ids)).bit_length())
        upper = self.tree.bounds(q, least, 1e-6 * (1 + bound**0.5))
        visit = np.argsort(-upper.astype(np.float64), axis=1, kind="stable")
        best = np.full((len(q), k), LOW)
        floor_ = least.copy()
        active = np.arange(len(q))
        for step in range(len(leaves)):
            nxt = visit[active, step]
            go = (upper[active, nxt] >= floor_[active]) & (upper[active, nxt] > LOW)
            active, nxt = active[go], nxt[go]
            if not len(active):
                break
            by = np.argsort(nxt, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(nxt[by]) > 0])
            for a, b in zip(starts, np.r_[starts[1:], len(by)]):
                who, rows = active[by[a:b]], leaves[nxt[by[a]]]
                score = np.rint(q[who] @ self.x[rows].T).astype(np.int64)
                keys = np.where((ids[rows][None, :] != q_ids[who][:, None]) & (score >= floor_[who][:, None]), (score << shift) + (len(ids) - rows)[None, :], LOW)
                both = np.concatenate([best[who], keys], axis=1)
                best[who] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            kth = best[active].min(axis=1)
            floor_[active] = np.where(kth > LOW, np.maximum(floor_[active], kth >> shift), floor_[active])
        at, slot = np.nonzero(best > LOW)
        keys = best[at, slot]
        yield from zip(at, ids[len(ids) - (keys & ((1 << shift) - 1))], keys >> shift)


def _search(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """queries: dim, ball, sub, id, v, least; rows: dim, ball, sub, id, v.  A shard's rows come before its queries."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, vectors, shard = None, [], [], None
        for pdf in batches:
            out = []
            for (dim, ball, sub, is_q), part in pdf.groupby(["dim", "ball", "sub", "is_q"], sort=True):
                if at != (dim, ball, sub):
                    at, ids, vectors, shard = (dim, ball, sub), [], [], None
                v = np.stack(part["v"].to_numpy()) if dim else np.empty((len(part), 0), np.int64)
                if not is_q:
                    ids.append(part["id"].to_numpy())
                    vectors.append(v)
                elif ids:
                    shard = shard or Shard(np.concatenate(ids), np.concatenate(vectors))
                    q_ids = part["id"].to_numpy()
                    out += [(q_ids[i], vec, score) for i, vec, score in shard.search(q_ids, v, part["least"].to_numpy(np.int64), k)]
            if out:
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    cols = ["dim", "ball", "sub", "id", "v"]
    both = queries.select(*cols, "least", F.lit(True).alias("is_q")).unionByName(rows.select(*cols, F.lit(LOW).alias("least"), F.lit(False).alias("is_q")))
    return both.repartition("dim", "ball", "sub").sortWithinPartitions("dim", "ball", "sub", "is_q").mapInPandas(task, "query_id long, vec_id long, score long")


def top_k(queries: DataFrame, rows: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, shard_rows: int = 4096, balls: int = 1024, sample: int = 16384) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each query by inner product.

    Components become ``floor(scale * x)``.  Vectors that are null or empty, hold a null or
    non-finite component, or have a null id take no part, as query or as row; vectors are compared
    with those of their own length only.  A query's own id is never returned; fewer than k rows give
    fewer results; an empty table gives none.  A repeated query id is searched once, with the least
    of its vectors; a repeated row is returned as often as it stands.  Other columns are not read.

    The driver holds about ``sample`` rows and the centres and radii of up to ``balls`` balls a length,
    whatever the table's size; they only decide which shards a query can skip.
    """

    def whole(df: DataFrame) -> DataFrame:
        x = F.transform(vec_col, lambda c: c.cast("double"))
        ok = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        return df.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & (F.size("x") > 0) & ok).select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))

    q, x = whole(queries).groupBy("id").agg(F.min("v").alias("v")), whole(rows)
    total = rows.count()
    some = x.where(F.pmod(F.xxhash64("id", F.lit("tree")), F.lit(max(1, total // sample))) == 0).limit(2 * sample).toPandas()
    trees = {}
    for dim, part in some.groupby(some["v"].map(len)) if len(some) else ():
        trees[dim] = BallTree(np.stack(part["v"].to_numpy()).astype(np.float64), 1, max(1, min(balls, -(-total * len(part) // (len(some) * shard_rows)))))

    @F.pandas_udf("dim int, ball int, far double")
    def placed(vectors: pd.Series) -> pd.DataFrame:
        dims = vectors.map(len).to_numpy()
        ball, far = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            v = np.stack(vectors.iloc[rows].to_numpy()).astype(np.float64)
            centre = 0.0
            if dim in trees:
                ball[rows] = trees[dim].place(v)
                centre = trees[dim].centre[np.array(trees[dim].leaves)[ball[rows]]]
            far[rows] = np.sqrt(((v - centre) ** 2).sum(axis=1))
        return pd.DataFrame({"dim": dims, "ball": ball, "far": far})

    x = materialize(x.withColumn("at", placed("v")).select("id", "v", "at.*"), "vectors")
    sizes = x.groupBy("dim", "ball").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()
    subs = {(r["dim"], r["ball"]): max(1, -(-r["n"] // shard_rows)) for r in sizes}
    there: dict[int, tuple] = {}
    for dim in {r["dim"] for r in sizes}:
        own = sorted((r["ball"], r["radius"]) for r in sizes if r["dim"] == dim)
        centre = np.array([trees[dim].centre[trees[dim].leaves[b]] for b, _ in own]) if dim in trees else np.zeros((1, dim))
        there[dim] = np.array([b for b, _ in own]), centre, np.array([r for _, r in own]), np.array([subs[dim, b] for b, _ in own])

    @F.pandas_udf("array<struct<ball:int,sub:int>>")
    def reach(vectors: pd.Series, least: pd.Series, first: pd.Series) -> pd.Series:
        """The shard to search first, or all others that can hold a score of ``least``."""
        out = []
        for v, low, one in zip(vectors, least, first):
            if len(v) not in there:
                out.append([])
                continue
            number, centre, radius, split = there[len(v)]
            v = np.asarray(v, np.float64)
            upper = centre @ v + np.sqrt(v @ v) * radius
            top = int(upper.argmax())
            if one:
                out.append([{"ball": int(number[top]), "sub": 0}])
            else:
                slack = 1e-6 * (1 + np.abs(upper))
                out.append([{"ball": int(number[i]), "sub": s} for i in np.flatnonzero(upper + slack >= low) for s in range(split[i]) if (i, s) != (top, 0)])
        return pd.Series(out)

    many = [F.lit(c) for (dim, ball), n in subs.items() if n > 1 for c in ((dim << 20) + ball, n)]
    split = F.coalesce(F.element_at(F.create_map(*many), F.col("dim") * (1 << 20) + F.col("ball")), F.lit(1)) if many else F.lit(1)
    x = x.select("dim", "ball", F.pmod(F.xxhash64("id", F.lit("shard")), split).cast("int").alias("sub"), "id", "v")
    meet = lambda df, first: df.withColumn("at", F.explode(reach("v", "least", F.lit(first)))).select(F.size("v").alias("dim"), "at.ball", "at.sub", "id", "v", "least")
    first = materialize(_search(meet(q.withColumn("least", F.lit(LOW)), True), x, k), "first-hits")
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    primed = q.join(kth, q["id"] == kth["query_id"], "left").select("id", "v", F.coalesce("kth", F.lit(LOW)).alias("least"))
    found = first.unionByName(_search(meet(primed, False), x, k))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""


def op6_exact_top_k(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows.where("vec_id % 20 = 0"), rows)
