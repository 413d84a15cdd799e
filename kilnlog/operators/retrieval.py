"""Chunks, BM25, exact and quantised vector search, and their fusion.  All searches take many queries at once."""

from __future__ import annotations

import contextlib
import logging
from itertools import islice
from typing import Protocol

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnlog.functions.lines import SOLID, words
from kilnlog.sources.logs import exists, stored

QUERY_BYTES = 16 << 20
#: Of a table of query vectors so many are compared at once, with so many rows at a time.
BLOCK_QUERIES, BLOCK_ROWS = 1024, 4096


def chunk_chars(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """(source, chunk_index, chunk_id, text) of (source, text); blank chunks take no index."""
    step = max(size - overlap, 1)
    starts = F.transform(F.sequence(F.lit(0), F.length("text") - 1, F.lit(step)), lambda s: F.substring("text", s + 1, F.lit(size)))
    filled = docs.where(F.length("text") > 0).select("source", F.posexplode(F.filter(starts, lambda c: c.rlike(SOLID))).alias("chunk_index", "text"))
    return filled.select("source", "chunk_index", F.concat_ws(":", "source", "chunk_index").alias("chunk_id"), "text")


def chunk_lines(lines: DataFrame, size: int = 50, overlap: int = 5) -> DataFrame:
    """(source, chunk_index, start_line, end_line, text) of numbered lines; a line goes to each window that holds it."""
    step = max(size - overlap, 1)
    first, last = F.greatest(F.floor((F.col("line_no") - size) / step) + 1, F.lit(0)), F.floor(F.col("line_no") / step)
    dealt = lines.select(F.col("file").alias("source"), "line_no", "raw", F.explode(F.sequence(first, last)).alias("_w"))
    parts = dealt.groupBy("source", "_w").agg(F.min("line_no").alias("start_line"), (F.max("line_no") + 1).alias("end_line"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]), "\n").alias("text"))
    filled = parts.where(F.col("text").rlike(SOLID))
    return filled.select("source", (F.row_number().over(Window.partitionBy("source").orderBy("_w")) - 1).alias("chunk_index"), "start_line", "end_line", "text")


def bm25_index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings (term, id, tf) and lengths (id, length) of (id, text)."""
    tok = docs.select("id", words(F.col("text")).alias("_w"))
    return tok.select("id", F.explode("_w").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf")), tok.select("id", F.size("_w").alias("length"))


def _asked(queries: DataFrame) -> DataFrame:
    """(query_id, term, _q): the words of each query and how often it has them."""
    return queries.select("query_id", F.explode(words(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("_q"))


def _few(terms: DataFrame) -> DataFrame:
    """terms, marked for broadcast if their summed bytes are few."""
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0]
    return F.broadcast(terms) if size <= QUERY_BYTES else terms


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, *, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, id, score, rank) with positive scores of (id, text) for (query_id, text); ties to the smaller id.

    One pass counts the documents of each word that is asked for, one scores them where they are and keeps k a query in every task.
    index, as bm25_index gives it, stands for the texts of docs; then the postings of the words asked for are joined.
    A negative idf becomes epsilon times the mean idf of all words, which takes a pass of its own, made only if some idf is
    negative; repeated query words count again.
    """
    asked = stored(_asked(queries), "asked")
    terms = _few(asked.select("term").distinct())
    tok = docs.select("id", words(F.col("text")).alias("_w"))
    weight = lambda df: F.log((n - F.col(df) + 0.5) / (F.col(df) + 0.5))
    if index is None:
        # each document also has the empty word, which no text has: its row tells the number of documents and of all words
        seen = tok.select(F.size("_w").alias("_n"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("_w"))).alias("term"))
        marked = terms.select("term").unionByName(docs.sparkSession.createDataFrame([("",)], "term string"))
        counts = stored(seen.join(_few(marked), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("_df"), F.sum("_n").alias("_sum")), "word-counts")
        n, total = counts.where("term = ''").agg(F.sum("_df"), F.sum("_sum")).first()
        mean = total / n if n else 0
    else:
        postings = stored(index[0].join(terms, "term", "left_semi").join(index[1], "id"), "postings")
        n, mean = index[1].agg(F.count(F.lit(1)), F.avg("length")).first()
        counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    if not n or not mean:
        return docs.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {docs.schema['id'].dataType.simpleString()}, score double, rank int")
    idf = counts.where("term <> ''").select("term", weight("_df").alias("_idf"))
    low = 0.0
    if not idf.where("_idf < 0").isEmpty():
        every = index[0].select("term") if index is not None else tok.select(F.explode(F.array_distinct("_w")).alias("term"))
        low = epsilon * every.groupBy("term").agg(F.count(F.lit(1)).alias("_df")).agg(F.avg(weight("_df"))).first()[0]
    asked = asked.join(idf, "term").withColumn("_idf", F.when(F.col("_idf") < 0, low).otherwise(F.col("_idf")))
    if index is None:
        gain = lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
        return _text_search(tok, asked.select("query_id", "term", (F.col("_q") * F.col("_idf")).alias("_w")), k, gain)
    part = F.col("_q") * F.col("_idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    scored = postings.join(asked, "term").groupBy("query_id", "id").agg(F.sum(part).alias("score")).where("score > 0")
    return top(scored, k)


def _text_search(tok: DataFrame, asked: DataFrame, k: int, gain) -> DataFrame:
    """(query_id, id, score, rank): the k best positive sums over a query's words of weight times gain(count in the document, its words).

    tok has (id, _w), the words; asked (query_id, term, _w), the weights.  The queries come to the driver a block at a time; each block is scored in
    one pass over the documents, a task at a time keeping k a query, so rows of a word, a query and a document never exist.
    """
    spark, kinds = tok.sparkSession, [df.schema[c].dataType.simpleString() for df, c in ((asked, "query_id"), (tok, "id"))]
    each = asked.groupBy("query_id").agg(F.collect_list(F.struct("term", "_w")).alias("_terms")).toLocalIterator()  # a row is as long as its query
    out = None
    while block := list(islice(each, BLOCK_QUERIES)):
        pairs = sorted((t["term"], q, t["_w"]) for q, r in enumerate(block) for t in r["_terms"])
        terms = sorted({t for t, _, _ in pairs})
        place = {t: i for i, t in enumerate(terms)}
        begins = np.searchsorted(np.array([place[t] for t, _, _ in pairs]), np.arange(len(terms) + 1))
        shared = spark.sparkContext.broadcast((terms, begins, np.array([q for _, q, _ in pairs]), np.array([w for _, _, w in pairs]), len(block)))

        def part(batches, shared=shared):
            import pyarrow as pa
            import pyarrow.compute as pc

            terms, begins, whose, weight, n = shared.value
            wanted, held = pa.array(terms, pa.string()), None
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    own = batch.slice(lo, 256)
                    words_ = own["_w"].flatten()
                    length = pc.fill_null(pc.list_value_length(own["_w"]), 0).to_numpy().astype(np.int64)
                    term = pc.fill_null(pc.index_in(words_, value_set=wanted), -1).to_numpy().astype(np.int64)
                    doc = np.repeat(np.arange(own.num_rows), length)
                    at, tf = np.unique(doc[term >= 0] * len(terms) + term[term >= 0], return_counts=True)
                    doc, term = at // len(terms), at % len(terms)
                    many = begins[term + 1] - begins[term]
                    # each posting meets the queries that ask for its word
                    ends = np.cumsum(many)
                    pair = np.arange(int(many.sum())) - np.repeat(ends - many, many) + np.repeat(begins[term], many)
                    score = np.bincount(whose[pair] * own.num_rows + np.repeat(doc, many), weights=np.repeat(gain(tf, length[doc]), many) * weight[pair], minlength=n * own.num_rows)
                    score = np.round(score.reshape(n, own.num_rows), 9)  # as in top()
                    held = _best(own, score, held, k, above=0.0)
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(held[0].astype(np.int32)), held[2], pa.array(held[1])], ["_q", "id", "score"])

        found = tok.mapInArrow(part, f"_q int, id {kinds[1]}, score double")
        names = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(block)], f"_q int, query_id {kinds[0]}")
        one = stored(top(found.join(F.broadcast(names), "_q"), k), "found")
        shared.destroy()
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, score double, rank int")


def top(scored: DataFrame, k: int) -> DataFrame:
    # sums of one document's parts come in any order; nine digits make its ties ties
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def overlap(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Share of a query's distinct words that a document has: the way out for queries without a BM25 hit."""
    own = F.array_distinct(words(F.col("text")))
    asked = queries.select("query_id", own.alias("_own")).select("query_id", F.explode("_own").alias("term"), (1 / F.size("_own")).alias("_w"))
    return _text_search(docs.select("id", own.alias("_w")), asked, k, lambda tf, length: tf)


def lexical(docs: DataFrame, queries: DataFrame, k: int = 10, *, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """BM25, and word overlap for the queries that it gives nothing."""
    found = stored(bm25(docs, queries, k, index=index), "found")  # k rows a query
    rest = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return found if rest.isEmpty() else found.unionByName(overlap(docs, rest, k))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _best(rows, scores: np.ndarray, held, k: int, above: float | None = None):
    """held, (query, score, id) of the best so far, with the k best of a slice of rows: the larger score, then the smaller id; only scores above a limit, if there is one."""
    import pyarrow as pa
    import pyarrow.compute as pc

    key = np.where(np.isnan(scores), -np.inf, -scores)
    last = np.partition(key, k - 1, axis=1)[:, k - 1] if key.shape[1] > k else np.full(len(key), np.inf)
    near = key <= last[:, None]
    q, at = np.nonzero(near if above is None else near & (scores > above))
    score, ids = scores[q, at], rows["id"].take(pa.array(at))
    if held is not None:
        q, score, ids = np.r_[held[0], q], np.r_[held[1], score], pa.concat_arrays([held[2], ids])
    place = np.empty(len(q), np.int64)
    place[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(q))
    order = np.lexsort((place, np.where(np.isnan(score), -np.inf, -score), q))
    own = q[order]
    order = order[np.arange(len(own)) - np.searchsorted(own, own) < k]
    return q[order], score[order], ids.take(pa.array(order))


def _search(rows: DataFrame, queries: DataFrame, k: int, turn=None) -> DataFrame:
    """(query_id, id, score, rank): for each row of (query_id, q) the k best of (id, v, scale) by the inner product times scale.

    The queries come to the driver a block at a time; each block is compared with all rows, in a pass that keeps k a query in
    every task.  Sums run in the order of dot.  Null vectors, and those that hold nulls, neither ask nor are found; all have one width.
    """
    spark, kinds = rows.sparkSession, [df.schema[c].dataType for df, c in ((queries, "query_id"), (rows, "id"))]
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    rows, out = rows.where(whole("v")).select("id", "v", "scale"), None
    asked = queries.where(whole("q")).select("query_id", "q").toLocalIterator()
    while block := list(islice(asked, BLOCK_QUERIES)):
        q = np.array([r["q"] for r in block], np.float64)
        shared = spark.sparkContext.broadcast(q if turn is None else turn(q))

        def part(batches, shared=shared):
            import pyarrow as pa

            q, held = shared.value, None
            for batch in batches:
                for lo in range(0, batch.num_rows, BLOCK_ROWS):
                    own = batch.slice(lo, BLOCK_ROWS)
                    v = own["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(own.num_rows, -1)
                    scores = np.zeros((len(q), own.num_rows))
                    for j in range(v.shape[1]):
                        scores += q[:, j, None] * v[:, j]
                    held = _best(own, scores * own["scale"].to_numpy(), held, k)
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(held[0].astype(np.int32)), held[2], pa.array(held[1])], ["_q", "id", "score"])

        found = rows.mapInArrow(part, f"_q int, id {kinds[1].simpleString()}, score double")
        rank = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), "id"))
        names = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(block)], f"_q int, query_id {kinds[0].simpleString()}")
        best = found.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "_q")
        one = stored(best.select("query_id", "id", "score", "rank"), "nearest")
        shared.destroy()
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, score double, rank int")


def vector_top(vectors: DataFrame, query: list[float] | DataFrame, k: int = 10) -> DataFrame:
    """(id, score, rank) of (id, v) by inner product with one vector: one pass, a top-k in every task.

    For a table (query_id, q) of vectors, (query_id, id, score, rank) of each.
    """
    if isinstance(query, DataFrame):
        return _search(vectors.select("id", "v", F.lit(1.0).alias("scale")), query, k)
    scored = vectors.select("id", dot(F.col("v"), F.array(*(F.lit(float(x)) for x in query))).alias("score"))
    best = scored.orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def signs(width: int, seed: int) -> np.ndarray:
    return np.where(np.random.default_rng(seed).integers(0, 2, width, dtype=np.int8) == 1, 1.0, -1.0)


def padded(n: int) -> int:
    return 1 if n <= 1 else 1 << (n - 1).bit_length()


def rotate(x: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Rows of x, padded, signed and turned by an orthonormal Walsh-Hadamard transform."""
    w = len(sign)
    out = np.zeros((len(x), w))
    out[:, : x.shape[1]] = x
    out *= sign
    h = 1
    while h < w:
        pair = out.reshape(len(out), -1, 2, h)
        out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(out), w)
        h *= 2
    return out / np.sqrt(w)


def quantise(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    levels = (1 << (min(max(bits, 2), 8) - 1)) - 1
    most = np.abs(x).max(axis=1)
    scale = np.where(most > 0, most / levels, 1.0)
    return np.clip(np.rint(x / scale[:, None]), -levels, levels).astype(np.int16), scale


def encode(vectors: DataFrame, *, width: int, bits: int = 4, seed: int = 0) -> DataFrame:
    """(id, codes, scale) of (id, v)."""
    sign = signs(padded(width), seed)

    def part(batches):
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                codes, scale = quantise(rotate(np.array(pdf["v"].tolist(), np.float64), sign), bits)
                yield pd.DataFrame({"id": pdf["id"], "codes": list(codes), "scale": scale})

    return vectors.select("id", "v").mapInPandas(part, f"id {vectors.schema['id'].dataType.simpleString()}, codes array<smallint>, scale double")


def quantised_top(encoded: DataFrame, query: list[float] | DataFrame, k: int = 10, *, seed: int = 0) -> DataFrame:
    """(id, score, rank): the rotated query against codes, with the scale taken out of the sum; for a table of queries as vector_top."""
    if isinstance(query, DataFrame):
        return _search(encoded.select("id", F.col("codes").alias("v"), "scale"), query, k, lambda q: rotate(q, signs(padded(q.shape[1]), seed)))
    turned = rotate(np.array([query], np.float64), signs(padded(len(query)), seed))[0]
    scored = encoded.select("id", (F.col("scale") * dot(F.col("codes"), F.array(*(F.lit(float(x)) for x in turned)))).alias("score"))
    best = scored.orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def fuse(first: DataFrame, second: DataFrame, k: int = 10, *, constant: int = 60, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Reciprocal-rank fusion of two ranked results (query_id, id, rank from 1); ties go to what the first list has earlier."""
    part = lambda df, w, side: df.select("query_id", "id", (F.lit(w) / (constant + F.col("rank"))).alias("_s"), F.struct(F.lit(side).alias("side"), F.col("rank").alias("rank")).alias("_at"))
    both = part(first, weights[0], 0).unionByName(part(second, weights[1], 1)).groupBy("query_id", "id").agg(F.sum("_s").alias("score"), F.min("_at").alias("_at"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "_at"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


class VectorBackend(Protocol):
    def search(self, query: list[float], k: int) -> DataFrame: ...
    def save(self, path: str) -> None: ...


class ExactBackend:
    """(id, v) as it is."""

    def __init__(self, vectors: DataFrame) -> None:
        self.vectors = vectors

    def search(self, query: list[float], k: int) -> DataFrame:
        return vector_top(self.vectors, query, k)

    def save(self, path: str) -> None:
        self.vectors.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ExactBackend:
        return cls(spark.read.parquet(path))


class QuantisedBackend:
    VERSION = 1

    def __init__(self, encoded: DataFrame, bits: int, seed: int) -> None:
        self.encoded, self.bits, self.seed = encoded, bits, seed

    @classmethod
    def build(cls, vectors: DataFrame, width: int, bits: int = 4, seed: int = 0) -> QuantisedBackend:
        return cls(encode(vectors, width=width, bits=bits, seed=seed), bits, seed)

    def search(self, query: list[float], k: int) -> DataFrame:
        return quantised_top(self.encoded, query, k, seed=self.seed)

    def save(self, path: str) -> None:
        self.encoded.write.mode("overwrite").parquet(f"{path}/vectors")
        meta = [("quantised", self.VERSION, self.bits, self.seed)]
        self.encoded.sparkSession.createDataFrame(meta, "backend string, version int, bits int, seed int").coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> QuantisedBackend:
        meta = spark.read.schema("backend string, version int, bits int, seed int").json(f"{path}/meta").first()
        if meta is None or (meta["backend"], meta["version"]) != ("quantised", cls.VERSION):
            raise ValueError(f"{path} has no quantised vectors of version {cls.VERSION}")
        return cls(spark.read.parquet(f"{path}/vectors"), meta["bits"], meta["seed"])


def backend(vectors: DataFrame, width: int, name: str = "quantised", bits: int = 4) -> VectorBackend | None:
    """The named way to search vectors; None for lexical search alone."""
    return {"quantised": lambda: QuantisedBackend.build(vectors, width, bits), "exact": lambda: ExactBackend(vectors), "none": lambda: None}[name]()


FALLBACK = ("quantised", "exact", "none")


def first_backend(vectors: DataFrame, width: int, name: str = "quantised", bits: int = 4) -> VectorBackend | None:
    """The named backend, or else the next one of FALLBACK that can serve these vectors."""
    for kind in FALLBACK[FALLBACK.index(name) :]:
        try:
            found = backend(vectors, width, kind, bits)
            if found is not None:
                found.search([0.0] * width, 1).collect()  # a probe
            return found
        except Exception as e:  # whatever keeps a backend from working, the next one may
            logging.getLogger(__name__).warning("%s vector search is not available: %s", kind, e)
    return None


def load_backend(spark: SparkSession, path: str, name: str = "quantised") -> VectorBackend | None:
    """The saved backend of that name at path, or else the next one that is there."""
    kinds = {"quantised": QuantisedBackend, "exact": ExactBackend}
    for kind in FALLBACK[FALLBACK.index(name) : -1]:
        with contextlib.suppress(ValueError, AnalysisException):
            return kinds[kind].load(spark, f"{path}/{kind}")
    return None


def unit(encode) -> Column:
    """A column function from texts to vectors of length one: encode gives an array of a row for each of a list of texts; zero vectors stay."""

    @F.pandas_udf("array<float>")
    def vectors(texts):
        import pandas as pd

        x = np.asarray(encode(texts.fillna("").tolist()), np.float64)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return pd.Series(list((x / np.where(size > 0, size, 1)).astype(np.float32)))

    return vectors


@F.udtf(returnType="chunk_index int, chunk_id string, text string")
class ChunkText:
    """chunk_chars as a table function: lateral chunk_text(source, text, size, overlap)."""

    def eval(self, source: str, text: str, size: int, overlap: int):
        step, n = max(size - overlap, 1), 0
        for at in range(0, len(text or ""), step):
            if (part := text[at : at + size]).strip():
                yield n, f"{source}:{n}", part
                n += 1


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_text", ChunkText)


def load_or_build(spark: SparkSession, path: str, build, *, force: bool = False) -> DataFrame:
    """The table at path; build() makes and stores it if it is absent or force is set."""
    if force or not exists(spark, path):
        # written whole before the old table goes, since build() may read it
        fresh = stored(build(), "index")
        fresh.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
