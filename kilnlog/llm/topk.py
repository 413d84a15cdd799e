"""Exact top-k by inner product: aggregation of sorted lists without random access.

Every dimension of a block of candidates is a list sorted by value, read from the end that is best for the
query's sign.  After depth L a candidate's score has a lower bound (what was read of it, plus each
unread list's worst value) and an upper bound (plus each unread list's value at depth L).  Depth
grows by half of the rest until every candidate outside a short list of survivors has an upper bound below the k-th
lower bound; the survivors' final scores are then resolved by reading their other entries.  Queries advance
together, so that a round is a few matrix products.  Bounds are doubles with their rounding error added; final scores are integers.

The queries go in blocks of bounded size, each broadcast in one pass over the candidates, which stay where they are: a task takes
its candidates in blocks and keeps k a query, and the tasks' best meet in an aggregation.  Memory is bounded by the block sizes, so an id of very many rows fills no task.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor rows without an id.  Vectors meet
only vectors of their own length.  Equal rows and rows of equal id all
take part, each for itself, but never against a query of their own id; equal queries are asked once.  Ties go to the smaller id.  Scores beyond 64 bits are its ends.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnlog.llm.common import materialise, table, tidy

CANDIDATES, QUERIES = 8192, 512
BLOCK_QUERIES = 1 << 16  # that a pass over the candidates serves


def _scores(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products, of longs if they fit, within 64 bits."""
    if float(np.abs(c.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).sum()) < 2**62:
        return c @ q
    return np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in c.astype(object) @ q.astype(object)], np.int64)


def top_of_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best candidates of other ids, by bounds from sorted lists; q and c are longs."""
    n, d = c.shape
    own = q_ids[:, None] == c_ids[None, :]
    exact_q, exact_c, q, c = q, c, q.astype(np.float64), c.astype(np.float64)
    order = np.argsort(c, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(n)[:, None], (n, d)), axis=0)
    values = np.take_along_axis(c, order, axis=0)  # each list, ascending
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    # of a sum of d products of rounded factors; none where all is exact
    slack = np.abs(q) @ np.abs(c).max(axis=0)
    slack = np.where(slack < 2.0**53, 0.0, slack * (8 * d + 64) * 2.0**-53)
    depth, live = n // 2, np.arange(len(q))
    out: list[tuple] = []
    while len(live):
        depth = min(n, depth + max(1, (n - depth) // 2))
        u, w = up[live], down[live]
        top, low = rank >= n - depth, rank < depth  # read from the large end, from the small end
        seen = u @ np.where(top, c, 0).T + w @ np.where(low, c, 0).T
        at_top, at_low = (values[n - depth], values[depth - 1])
        upper = seen + (u * at_top) @ (~top).T.astype(float) + (w * at_low) @ (~low).T.astype(float) + slack[live, None]
        lower = seen + (u * values[0]) @ (~top).T.astype(float) + (w * values[-1]) @ (~low).T.astype(float) - slack[live, None]
        lower[own[live]], upper[own[live]] = -np.inf, -np.inf
        m = min(k, n)
        kth = np.partition(lower, n - m, axis=1)[:, n - m]
        stay = (upper >= kth[:, None]) & ~own[live]
        done = (stay.sum(axis=1) <= max(4 * k, n // 64)) | (depth >= n)
        for i in np.flatnonzero(done):
            cand = np.flatnonzero(stay[i])
            score = _scores(exact_c[cand], exact_q[live[i]])
            best = np.lexsort((c_ids[cand], ~score))[:k]  # ~ turns the order of longs round without an overflow
            out.append((np.full(len(best), live[i]), cand[best], score[best]))
        live = live[~done]
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Best:
    """The k best (score, id) of each of n queries so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score, self.id, self.full = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), bool)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """rows: queries, each together."""
        at = np.unique(rows)
        old = np.repeat(at, self.k)[self.full[at].reshape(-1)]
        rows = np.r_[rows, old]
        ids, scores = np.r_[ids, self.id[at][self.full[at]]], np.r_[scores, self.score[at][self.full[at]]]
        by = np.lexsort((ids, ~scores, rows))
        rows, ids, scores = rows[by], ids[by], scores[by]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.k
        self.full[at] = False
        self.score[rows[keep], place[keep]], self.id[rows[keep], place[keep]], self.full[rows[keep], place[keep]] = scores[keep], ids[keep], True


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10, *, candidate_block: int = CANDIDATES, query_block: int = QUERIES, pass_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score); vectors and queries have _id long and _v array<long>."""
    queries = queries.distinct()
    passes = max(1, -(-queries.count() // pass_queries))
    dealt = materialise(spark, queries.withColumn("_pass", F.pmod(F.xxhash64("_id", "_v"), F.lit(passes)).cast("int")), "topk-queries")
    found = None
    for p in range(passes):
        # about pass_queries rows
        mine = dealt.where(F.col("_pass") == p).select("_id", "_v").toArrow()
        by_length: dict[int, tuple] = {}
        sizes = np.array([len(v) for v in mine["_v"].to_pylist()], np.int64)
        ids = mine["_id"].to_numpy()
        for d in np.unique(sizes):
            own = np.flatnonzero(sizes == d)
            by_length[int(d)] = ids[own], np.array(mine["_v"].take(own).to_pylist(), np.int64)
        asked = spark.sparkContext.broadcast(by_length)

        def part(batches, asked=asked):
            import pandas as pd

            best = {d: Best(len(q_ids), k) for d, (q_ids, _) in asked.value.items()}
            held: dict[int, list] = {d: [] for d in best}

            def meet(d: int) -> None:
                c_ids = np.concatenate([x for x, _ in held[d]])
                c = np.concatenate([x for _, x in held[d]])
                q_ids, q = asked.value[d]
                held[d] = []
                for lo in range(0, len(q_ids), query_block):
                    r, i, s = top_of_block(q_ids[lo : lo + query_block], q[lo : lo + query_block], c_ids, c, k)
                    best[d].add(r + lo, c_ids[i], s)

            for pdf in batches:
                lengths = pdf["_v"].map(len).to_numpy()
                for d in set(lengths.tolist()) & best.keys():
                    own = np.flatnonzero(lengths == d)
                    c_ids, c = pdf["_id"].to_numpy()[own], np.stack(pdf["_v"].to_numpy()[own]).astype(np.int64)
                    for lo in range(0, len(own), candidate_block):
                        held[d].append((c_ids[lo : lo + candidate_block], c[lo : lo + candidate_block]))
                        if sum(len(x) for x, _ in held[d]) >= candidate_block:
                            meet(d)
            for d in best:
                if held[d]:
                    meet(d)
                rows, place = np.nonzero(best[d].full)
                yield pd.DataFrame({"query_id": asked.value[d][0][rows], "vec_id": best[d].id[rows, place], "score": best[d].score[rows, place]})

        one = materialise(spark, vectors.mapInPandas(tidy(part), "query_id long, vec_id long, score long"), "topk-found")
        asked.destroy()
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(fine).select(F.col(id_col).cast("long").alias("_id"), F.transform(v, lambda x: F.floor(x.cast("double") * 1024)).alias("_v"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(spark, vectors, vectors.where(F.col("_id") % 100 == 0), 10)


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 1024)::bigint) as v from embeddings
  where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10
"""
