"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams.

Trusted texts are counted as folded character n-grams of order N; words of these tables are mostly
seen once, so characters tell clean from broken text where words can't.  The model is its counts, grouped by n-gram: occurrences for order N;
for the lower orders the numbers of distinct left extensions (raw counts for n-grams at a
text's start); discounts come from the counts of counts.  A shard of the counts holds whole contexts, so it turns them into discounted shares, context
weights and interpolated probabilities by itself.

Scoring joins the n-grams of every whole text with these tables.  Texts go into blocks of some millions of characters; a block's distinct
n-grams are dealt over the model's shards, meet them in a sort-merge join, and the probabilities go back to the block, whose texts, which lie in
the buckets of a scratch table, add up their logarithms in place.  A position belongs to the shard of the two characters before it, and so do the n-grams and contexts of all orders above two
that it needs; the few short ones go to all shards.  Nothing of the model reaches the driver or a broadcast, and its size only sets the number of shards.
A document's perplexity is exp of the mean negative log probability of its characters and of its end.

Two models are trained, each on a half of the trusted documents, and a document is scored by the one that
has not seen it, so trusted scores are comparable with all others.  The threshold of a language is a quantile of the
perplexities of its trusted documents times a margin, from a histogram over all of them; a language with fewer
than min_trusted trusted documents takes the threshold over all languages.

Defined cases: null texts are empty; an empty text has no characters to judge and is rejected.  A null language is a language of its own.
A document is trusted if any of its labels is quality 1 and not toxic.  Without trusted documents nothing is rejected but empty texts.
Scores are shrunk to the trusted mean by PRIOR characters so that a few words are not judged as harshly as a page.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnlog.llm.common import bucketed, carried, materialise, restored, scratch, small_side, table, tidy

ORDER = 5
BITS = 12  # of a folded character
QUANTILE = 0.999
MARGIN = 1.05
PRIOR = 40
MIN_TRUSTED = 30
SHARD_ROWS = 100_000  # of the model in a shard
BLOCK_CHARS = 1 << 24  # of texts that ask for their n-grams together
PACK_CHARS = 1 << 18  # of texts that are compressed together
SALT_GRAMS = 1 << 26  # that one task answers for a shard


def fold(lowered: str) -> np.ndarray:
    """Codes 2..4095 of lower case: digits are one class; code points over 2047 share 2048 classes."""
    a = np.frombuffer(lowered.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    high = a >= 2048
    a[high] = 2048 + a[high] % 2048
    a[(a >= 48) & (a <= 57)] = 48
    a[a < 2] = 2
    return a


def positions(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each character and each end (code 1) its n-gram of the full order as an integer, and the text it is in.

    A text is preceded by order - 1 starts (code 0), so n-grams at its beginning have zeros in front.
    """
    low = [t.lower() for t in texts]
    own, n = np.array([i for i, t in enumerate(low) if t], np.int64), np.array([len(t) for t in low if t], np.int64)
    if not len(n):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.cumsum(n + order) - (n + order)  # of each text's starts; its characters and its end follow
    codes = np.zeros(int((n + order).sum()), np.int64)
    codes[np.arange(int(n.sum())) + np.repeat(begin + order - 1 - (np.cumsum(n) - n), n)] = fold("".join(low))
    codes[begin + order - 1 + n] = 1
    grams = np.zeros(len(codes) - order + 1, np.int64)
    for j in range(order):
        grams |= codes[j : len(codes) - order + 1 + j] << (BITS * (order - 1 - j))
    keep = np.ones(len(grams), bool)
    over = (begin[:-1] + n[:-1] + 1)[:, None] + np.arange(order - 1)[None, :]  # those that reach into the next text
    keep[over.reshape(-1)] = False
    return grams[keep], np.repeat(own, n + 1)


def _slot(grams: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)


class Distinct:
    """The distinct integers of those added; most repeats are told by a table of what was last seen at a slot."""

    def __init__(self, bits: int = 19) -> None:
        self.bits, self.seen, self.parts, self.n = bits, np.full(1 << bits, -1, np.int64), [], 0

    def add(self, values: np.ndarray) -> None:
        at = _slot(values, self.bits)
        fresh = self.seen[at] != values
        values = values[fresh]
        self.seen[at[fresh]] = values
        self.parts.append(values)
        self.n += len(values)
        if self.n > 1 << 21:
            self.parts = [self.sorted()]
            self.n = 0

    def sorted(self) -> np.ndarray:
        return np.unique(np.concatenate(self.parts)) if self.parts else np.zeros(0, np.int64)


class Lookup:
    """Numbers by distinct integers, in a table of slots and, for those that share a slot, in sorted order."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        by = np.argsort(keys)
        self.keys, self.values = keys[by], values[by]
        self.bits = max(8, int(len(keys)).bit_length() + 1)
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.slots[_slot(self.keys, self.bits)] = np.arange(len(keys))

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        at = self.slots[_slot(wanted, self.bits)]
        missed = np.flatnonzero(self.keys[at] != wanted)
        at[missed] = np.searchsorted(self.keys, wanted[missed])
        return self.values[at]


def _count_grams(order: int, batch_rows: int = 1_000_000):
    def part(batches):
        import pandas as pd

        held: dict[int, list] = {0: [], 1: []}

        def out(fold_: int):
            keys = np.concatenate([k for k, _ in held[fold_]])
            n = np.concatenate([c for _, c in held[fold_]])
            u, inv = np.unique(keys, return_inverse=True)
            held[fold_] = [(u, np.bincount(inv, weights=n, minlength=len(u)).astype(np.int64))]

        for pdf in batches:
            for f in (0, 1):
                texts = pdf["_text"][pdf["_fold"] == f].tolist()
                for lo, hi in _slices(texts):
                    grams, _ = positions(texts[lo:hi], order)
                    held[f].append(np.unique(grams, return_counts=True))
                    if sum(len(k) for k, _ in held[f]) > batch_rows:
                        out(f)
        for f in (0, 1):
            if held[f]:
                out(f)
                yield pd.DataFrame({"_fold": f, "_g": held[f][0][0], "_c": held[f][0][1]})

    return part


def _suffix(g: Column, n: int) -> Column:
    return g.bitwiseAND(F.lit((1 << (BITS * n)) - 1))


def train(spark: SparkSession, trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """(_fold, _order, _g, _c): the counts of the model, occurrences for the full order and distinct left extensions for the lower ones.

    trusted has _fold and _text; a fold's model holds the texts of that fold.
    """
    counts = materialise(spark, trusted.mapInPandas(tidy(_count_grams(order)), "_fold int, _g long, _c long").groupBy("_fold", "_g").agg(F.sum("_c").alias("_c")), "kn-counts")
    up, every = counts, counts.withColumn("_order", F.lit(order))
    for n in range(order - 1, 0, -1):
        # an n-gram that begins with a start has one left extension only, so its occurrences count instead
        first = F.shiftright(_suffix(F.col("_g"), n), BITS * (n - 1))
        raw = (first == 0) if n > 1 else F.lit(False)
        up = up.groupBy("_fold", _suffix(F.col("_g"), n).alias("_g")).agg(F.sum(F.when(raw, F.col("_c")).otherwise(1)).alias("_c"))
        every = every.unionByName(up.withColumn("_order", F.lit(n)))
    return materialise(spark, every.select(*MODEL), "kn-model")


def discounts(model: DataFrame, order: int = ORDER) -> dict[tuple[int, int], list[float]]:
    """Of each fold and order what counts of one, two, three and more lose, from the counts of counts."""
    of = {(r[0], r[1], r[2]): r[3] for r in model.where("_c <= 4").groupBy("_fold", "_order", "_c").count().collect()}  # 4 rows an order and fold

    def one(f: int, n: int) -> list[float]:
        n1, n2, n3, n4 = (of.get((f, n, i), 0) for i in (1, 2, 3, 4))
        if min(n1, n2, n3, n4) == 0:
            return [0.5, 1.0, 1.5]
        y = n1 / (n1 + 2 * n2)
        return [min(max(d, 0.1), i) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]

    return {(f, n): one(f, n) for f in (0, 1) for n in range(1, order + 1)}


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, none: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), none)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], none)


class Shard:
    """A shard's probabilities and context weights by fold and order, from its counts.

    The n-grams of a context share the shard, and so do an n-gram and its suffixes above the orders that every shard has.
    """

    def __init__(self, rows, less: dict[tuple[int, int], list[float]]) -> None:
        """rows: an Arrow table of the columns of MODEL."""
        f, n, g, c = (rows[x].to_numpy() for x in MODEL)
        none = np.zeros(0, np.int64), np.zeros(0)
        self.p: dict = {}  # (fold, order): n-grams, probabilities
        self.b: dict = {}  # (fold, characters): contexts, weights
        for fold_, order in sorted(less):
            own = np.flatnonzero((f == fold_) & (n == order))
            own = own[np.argsort(g[own])]
            if not len(own):
                self.p[fold_, order] = self.b[fold_, order - 1] = none
                continue
            grams, counts = g[own], c[own]
            lost = np.array(less[fold_, order])[np.minimum(counts, 3) - 1]
            contexts, at = np.unique(grams >> BITS, return_index=True)
            total = np.add.reduceat(counts, at).astype(np.float64)
            weight = np.add.reduceat(lost, at) / total
            size = np.diff(np.r_[at, len(grams)])
            low = 1.0 / (1 << BITS) if order == 1 else _find(*self.p[fold_, order - 1], grams & ((1 << (BITS * (order - 1))) - 1), 0.0)
            self.p[fold_, order] = grams, (counts - lost) / np.repeat(total, size) + np.repeat(weight, size) * low
            self.b[fold_, order - 1] = contexts, weight


def probabilities(shard: Shard, f: int, grams: np.ndarray, order: int) -> np.ndarray:
    """Of each full n-gram its last character's probability; unseen n-grams go down an order at their context's weight."""
    p, weight, left = np.zeros(len(grams)), np.ones(len(grams)), np.arange(len(grams))
    for n in range(order, 0, -1):
        g = grams[left] & ((1 << (BITS * n)) - 1)
        got = _find(*shard.p[f, n], g, -1.0)
        hit = got >= 0
        p[left[hit]] = got[hit] * weight[left[hit]]
        left = left[~hit]
        if not len(left):
            return p
        weight[left] *= _find(*shard.b[f, n - 1], g[~hit] >> BITS, 1.0)
    p[left] = weight[left] / (1 << BITS)
    return p


def pair_shard(pair, shards: int):
    """The shard of two characters, of a numpy array or a column of longs; the products stay below 2^56."""
    if isinstance(pair, Column):
        return F.pmod(F.shiftright(pair * F.lit(_SPREAD), 20), F.lit(shards)).cast("int")
    return ((pair * _SPREAD) >> 20) % shards


_SPREAD = 2654435761
_FOLD = 60  # the bit over an n-gram that tells its fold, while both folds are collected
MODEL = ("_fold", "_order", "_g", "_c")


def squeeze(values: np.ndarray) -> bytes:
    """Sorted 60-bit integers by their differences, or floats, as compressed byte planes."""
    import pyarrow as pa

    x = np.diff(values, prepend=0) if values.dtype == np.int64 else values
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), codec="zstd", asbytes=True)


def unsqueeze(data: bytes, n: int, kind) -> np.ndarray:
    import pyarrow as pa

    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=width * n, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    x = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
    return np.cumsum(x) if kind is np.int64 else x


def _to_blocks(order: int, shards: int, block_chars: int):
    """Texts to blocks: rows of fold -1 are packs of rows (an Arrow stream), the others a block's distinct n-grams of a fold and shard."""
    def part(batches):
        import secrets

        import pyarrow as pa

        def rows(block, found):
            cols = list(zip(*found, strict=True))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
            arrays = [pa.array([block] * len(found), pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
            return pa.RecordBatch.from_arrays(arrays, ["_block", "_fold", "_shard", "_n", "_data"])

        def grams_of(held):
            out, every = [], held.sorted()
            for f in (0, 1):
                grams = every[every >> _FOLD == f] & ((1 << _FOLD) - 1)
                of = pair_shard((grams >> BITS) & ((1 << (2 * BITS)) - 1), shards)
                for k in np.unique(of):
                    own = grams[of == k]
                    out.append((f, int(k), len(own), squeeze(own)))
            return out

        # a random number names a block: its rows are written once, by the attempt that is committed
        block, held, chars = secrets.randbits(62), Distinct(), 0
        for batch in batches:
            texts, folds = [t or "" for t in batch["_text"].to_pylist()], batch["_fold"].to_numpy()
            for lo, hi in _slices(texts, PACK_CHARS):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
                    out.write_batch(batch.slice(lo, hi - lo))
                yield rows(block, [(-1, 0, hi - lo, sink.getvalue().to_pybytes())])
                grams, own = positions(texts[lo:hi], order)
                held.add(grams | (folds[lo:hi].astype(np.int64) << _FOLD)[own])
                chars += sum(map(len, texts[lo:hi]))
                if chars >= block_chars:
                    if found := grams_of(held):
                        yield rows(block, found)
                    block, held, chars = secrets.randbits(62), Distinct(), 0
        if found := grams_of(held):
            yield rows(block, found)

    return part


def _segments(batch, by: list[str]):
    """Slices of a batch whose rows agree in the columns by."""
    if batch.num_rows:
        keys = np.stack([batch[c].to_numpy() for c in by])
        cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield tuple(int(k[lo]) for k in keys), batch.slice(lo, hi - lo)


def _join_shards(order: int, less: dict[tuple[int, int], list[float]]):
    """Streams rows sorted by shard, the model's first: (block, fold, n, n-grams, probabilities) of each row of n-grams."""
    def part(batches):
        import pyarrow as pa

        at, held, shard = None, [], None
        for batch in batches:
            for (*key, kind), rows in _segments(batch, ["_shard", "_salt", "_kind"]):
                if key != at:
                    at, held, shard = key, [], None
                if kind == 0:
                    held.append(rows.select(list(MODEL)))
                    continue
                if shard is None:
                    shard = Shard(pa.Table.from_batches(held, rows.select(list(MODEL)).schema), less)
                    held = []
                for block, f, n, data in zip(*(rows[c].to_pylist() for c in ("_block", "_fold", "_n", "_data")), strict=True):
                    found = probabilities(shard, f, unsqueeze(data, n, np.int64), order).astype(np.float32)
                    columns = [pa.array([block], pa.int64()), pa.array([f], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary()), pa.array([squeeze(found)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["_block", "_fold", "_n", "_data", "_p"])

    return part


def _score_block(order: int):
    """A block's packs and its n-grams' probabilities: the packs' rows with their sums."""
    def block(packs, answers):
        import pyarrow as pa

        held: dict = {0: [], 1: []}
        for f, n, data, p in zip(*(answers[c].to_pylist() for c in ("_fold", "_n", "_data", "_p")), strict=True):
            held[f].append((unsqueeze(data, n, np.int64), unsqueeze(p, n, np.float32)))
        tables = {}
        for f, parts in held.items():
            if parts:
                g, p = (np.concatenate(x) for x in zip(*parts, strict=True))
                tables[f] = Lookup(g, np.log(p.astype(np.float64)))
        out = []
        for data in packs["_data"]:
            for pack in pa.ipc.open_stream(data.as_buffer()):
                texts, folds = [t or "" for t in pack["_text"].to_pylist()], pack["_fold"].to_numpy()
                grams, own = positions(texts, order)
                lps = np.zeros(len(grams))
                for f, found in tables.items():
                    mine = folds[own] == f
                    lps[mine] = found(grams[mine])
                nll, n = -np.bincount(own, weights=lps, minlength=len(texts)), np.bincount(own, minlength=len(texts))
                keep = [c for c in pack.schema.names if c != "_text"]
                out.append(pa.RecordBatch.from_arrays([*(pack[c] for c in keep), pa.array(nll, pa.float64()), pa.array(n.astype(np.int64), pa.int64())], [*keep, "_nll", "_n"]))
        return pa.Table.from_batches(out)

    return block


def score(spark: SparkSession, docs: DataFrame, model: DataFrame, order: int = ORDER, shard_rows: int = SHARD_ROWS, block_chars: int = BLOCK_CHARS, salt_grams: int = SALT_GRAMS) -> DataFrame:
    """docs (with _fold: the fold of the model to use, and _text) without _text, with _nll and _n: the summed negative log probability and its number of characters.

    A row for each row of docs, written to the shared folder.  model is joined as it is, in ceil(rows / shard_rows) shards.
    """
    shards = max(1, math.ceil(model.count() / shard_rows))
    # blocks fall into buckets by chance, so there are some more buckets than blocks
    buckets = min(50_000, 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()))
    rows = docs.mapInArrow(tidy(_to_blocks(order, shards, block_chars)), "_block long, _fold int, _shard int, _n long, _data binary")
    with scratch(spark), bucketed(spark, rows, "_block", buckets, "kn-blocks") as blocks:
        asked = blocks.where("_fold >= 0")
        # a shard that is asked for more often than a task should answer is dealt over salts, each with the shard's rows
        salts = asked.groupBy("_shard").agg(F.ceil(F.sum("_n") / salt_grams).cast("int").alias("_salts"))
        salts = small_side(materialise(spark, salts, "kn-salts"), 16)
        home = pair_shard(_suffix(F.shiftright("_g", BITS), 2), shards)
        homes = F.when(F.col("_order") <= 2, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(home))
        known = model.withColumn("_shard", F.explode(homes)).join(salts, "_shard").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
        none = {"_block": F.lit(0).cast("long"), "_n": F.lit(0).cast("long"), "_data": F.lit(None).cast("binary")}
        known = known.select("_shard", "_salt", F.lit(0).alias("_kind"), *MODEL, *(c.alias(k) for k, c in none.items()))
        rest = {"_order": F.lit(0), "_g": F.lit(0).cast("long"), "_c": F.lit(0).cast("long")}
        asked = asked.join(salts, "_shard").withColumn("_salt", F.pmod(F.xxhash64("_block", "_fold"), F.col("_salts")).cast("int"))
        asked = asked.select("_shard", "_salt", F.lit(1).alias("_kind"), "_fold", *(c.alias(k) for k, c in rest.items()), "_block", "_n", "_data")
        met = known.unionByName(asked).repartition("_shard", "_salt").sortWithinPartitions("_shard", "_salt", "_kind")
        answers = met.mapInArrow(tidy(_join_shards(order, discounts(model, order))), "_block long, _fold int, _n long, _data binary, _p binary")
        keep = [c for c in docs.columns if c != "_text"]
        schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
        packs = blocks.where("_fold < 0").select("_block", "_data")
        done = packs.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(_score_block(order), f"{schema}, _nll double, _n long")
        return materialise(spark, done, "kn-scores", outlive=True)


def _slices(texts: list[str], chars: int = 1 << 20):
    lo = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= chars:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()


def classify(spark: SparkSession, docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN, min_trusted: int = MIN_TRUSTED, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(_id, _text_key, _lang, n_scored, perplexity, threshold, keep) of every row of docs; trusted has _id."""
    fold_ = F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)).cast("int")
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.col(lang_col).alias("_lang"), F.xxhash64(text).alias("_text_key"), fold_.alias("_half"))
    trusted = materialise(spark, trusted, "kn-trusted")
    model = train(spark, marked.join(small_side(trusted, 16), "_id", "left_semi").select(F.col("_half").alias("_fold"), "_text"), order)
    scored = score(spark, marked.withColumn("_fold", 1 - F.col("_half")).drop("_half"), model, order, shard_rows).drop("_fold")
    known = scored.join(small_side(trusted, 16), "_id", "left_semi").where("_n > 0")
    means = known.groupBy("_lang").agg((F.sum("_nll") / F.sum("_n")).alias("_mean"), F.count(F.lit(1)).alias("_docs"))
    overall, = known.agg(F.sum("_nll") / F.sum("_n")).first()
    means = means.where(F.col("_docs") >= min_trusted).select(F.col("_lang").alias("_lang2"), F.lit(True).alias("_own"), "_mean")
    with_mean = lambda df: df.join(means, F.col("_lang").eqNullSafe(F.col("_lang2")), "left")
    mean = F.coalesce("_mean", F.lit(overall or 0.0))
    shrunk = (F.col("_nll") + PRIOR * mean) / (F.col("_n") + PRIOR)
    # _own is null for the languages under min_trusted, which go together in the histogram; a null language may have its own limit
    # bins of a thousandth: exact to that, and at most some ten thousand rows a language whatever the number of documents
    bins = with_mean(known).groupBy("_own", "_lang2", F.floor(shrunk * 1000).alias("_bin")).count()
    w = Window.partitionBy("_own", "_lang2")
    at = lambda df: df.withColumn("_up", F.sum("count").over(w.orderBy("_bin"))).withColumn("_all", F.sum("count").over(w)).where(F.col("_up") >= F.col("_all") * quantile).groupBy("_own", "_lang2").agg(((F.min("_bin") + 1) / 1000.0).alias("_limit"))
    limits = at(bins).where("_own").select(F.col("_lang2").alias("_lang3"), "_limit")
    whole = at(bins.groupBy("_bin").agg(F.sum("count").alias("count")).withColumns({"_own": F.lit(None).cast("boolean"), "_lang2": F.lit(None).cast("string")})).first()
    rest = whole["_limit"] if whole else math.inf
    limit = F.coalesce("_limit", F.lit(float(rest))) + math.log(margin)
    return (
        with_mean(scored)
        .join(limits, F.col("_own") & F.col("_lang2").eqNullSafe(F.col("_lang3")), "left")
        .select("_id", "_text_key", "_lang", F.col("_n").alias("n_scored"), F.exp(shrunk).alias("perplexity"), F.exp(limit).alias("threshold"), ((F.col("_n") > 0) & (shrunk <= limit)).alias("keep"))
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = classify(spark, docs, trusted_ids(table(spark, sf_dir, "labels")))
    return judged.select(F.col("_id").alias("doc_id"), F.col("_lang").alias("lang"), "n_scored", "perplexity", "threshold", "keep")


def keep_good(spark: SparkSession, docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier keeps, with their columns."""
    judged = classify(spark, docs, trusted, **options)
    bad = small_side(materialise(spark, judged.where(~F.col("keep")).select(F.col("_id").alias("_bad_id"), F.col("_text_key").alias("_bad_key")).distinct(), "kn-bad"), 24)
    keys = {"_id": F.col(options.get("id_col", "doc_id")), "_key": F.xxhash64(F.coalesce(F.col(options.get("text_col", "text")), F.lit("")))}
    return restored(carried(docs, **keys).join(bad, F.col("_id").eqNullSafe(F.col("_bad_id")) & (F.col("_key") == F.col("_bad_key")), "left_anti"), docs)
