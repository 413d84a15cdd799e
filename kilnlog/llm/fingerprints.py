"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is the set of its paragraphs' 64-bit digests; a paragraph is a line, cut every PIECE code points so that
a text of one line has parts too.  A sketch of 3 x m cells keeps in each cell the number, the xor and the check
xor of the digests hashed to it.  The sketches of two versions subtract; peeling cells that hold one digest recovers the
digests that differ.  A cell table too small for the difference does not peel to empty; then both
versions are sketched again with four times the cells, until it does.  Once a table has
several times as many cells as digests and still fails (equal positions of some digests), the sets are compared as they are.

The fingerprint is the sketch at the first size, in hex, with the number of digests: equal texts have equal fingerprints.
Likeness is the Jaccard similarity of the digest sets, from the sizes and the recovered difference; of two empty sets it is 1.

Documents stream through range buckets in descending doc_id, as many as their bytes ask for and one in a partition; a bucket's rows come sorted and the first
row of the next bucket is sent along, so each row meets the next document without a window over the table, and texts are shuffled once.  An id of
very many rows, or rows without one, take several buckets by the hash of the text.

Defined cases: a null text is empty.  Rows of equal id follow each other in the order of their text digests; null ids come last.
A single document is its own next document.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnlog.llm.common import table, tidy

PIECE = 128
BUCKET_BYTES = 32 << 20
CELLS = 12  # cells in each of the three parts of a sketch of the first size


def digests(text: str) -> np.ndarray:
    import xxhash

    out = set()
    for line in text.split("\n"):
        if len(line) <= PIECE:
            if line:
                out.add(xxhash.xxh3_64_intdigest(line))
        else:
            out.update(xxhash.xxh3_64_intdigest(line[i : i + PIECE]) for i in range(0, len(line), PIECE))
    return np.fromiter(out, np.uint64, len(out))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(29))


def _places(keys: np.ndarray, m: int) -> list[np.ndarray]:
    return [(_mix(keys, s) % np.uint64(m)).astype(np.int64) + j * m for j, s in enumerate((0x1F, 0x2E3, 0x3D51))]


def _check(keys: np.ndarray) -> np.ndarray:
    return _mix(keys, 0x77777)


class Sketches:
    """Sketches of several texts side by side: count, key xor and check xor, each (texts, 3 m)."""

    def __init__(self, n: int, m: int) -> None:
        self.m, self.count = m, np.zeros((n, 3 * m), np.int64)
        self.key, self.check = np.zeros((n, 3 * m), np.uint64), np.zeros((n, 3 * m), np.uint64)

    @classmethod
    def of(cls, sets: list[np.ndarray], m: int) -> Sketches:
        out = cls(len(sets), m)
        keys = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        out.put(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), keys, 1)
        return out

    def put(self, row: np.ndarray, keys: np.ndarray, sign) -> None:
        check = _check(keys)
        for p in _places(keys, self.m):
            at = row * (3 * self.m) + p
            np.add.at(self.count.reshape(-1), at, sign)
            np.bitwise_xor.at(self.key.reshape(-1), at, keys)
            np.bitwise_xor.at(self.check.reshape(-1), at, check)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(0, self.m)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows, digests, signs) recovered, and whether each row peeled to empty; consumes the sketches."""
        found: list[tuple] = []
        while True:
            r, c = np.nonzero(np.abs(self.count) == 1)
            pure = _check(self.key[r, c]) == self.check[r, c]
            r, c = r[pure], c[pure]
            if not len(r):
                break
            keys, sign = self.key[r, c], self.count[r, c]
            order = np.lexsort((keys, r))
            r, keys, sign = r[order], keys[order], sign[order]
            one = np.r_[True, (r[1:] != r[:-1]) | (keys[1:] != keys[:-1])]
            r, keys, sign = r[one], keys[one], sign[one]
            found.append((r, keys, sign))
            self.put(r, keys, -sign)
            if sum(len(x[0]) for x in found) > 4 * self.count.size:
                break  # a damaged table could go round for ever
        clean = ~(self.count.any(axis=1) | self.key.any(axis=1) | self.check.any(axis=1))
        rows, keys, signs = (np.concatenate(x) if found else np.zeros(0, t) for x, t in zip(zip(*found, strict=True) if found else ((), (), ()), (np.int64, np.uint64, np.int64), strict=True))
        return rows, keys, signs, clean


def difference_sizes(a: list[np.ndarray], b: list[np.ndarray], m: int = CELLS) -> np.ndarray:
    """How many digests each pair of sets differs in, by subtracting and peeling, with larger sketches where that fails."""
    out, left = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(left):
        rows, _, _, clean = Sketches.of([a[i] for i in left], m).minus(Sketches.of([b[i] for i in left], m)).peel()
        out[left] = np.bincount(rows, minlength=len(left))
        left = left[~clean]
        m *= 4
        for i in [i for i in left if m > 8 * (len(a[i]) + len(b[i])) + 64]:
            out[i] = len(np.setxor1d(a[i], b[i]))
            left = left[left != i]
    return out


def recovered(a: np.ndarray, b: np.ndarray, m: int = CELLS) -> tuple[set[int], set[int]]:
    """The paragraph digests that only a has and that only b has."""
    while m <= 8 * (len(a) + len(b)) + 64:
        _, keys, signs, clean = Sketches.of([a], m).minus(Sketches.of([b], m)).peel()
        if clean[0]:
            return {int(k) for k, s in zip(keys, signs, strict=True) if s > 0}, {int(k) for k, s in zip(keys, signs, strict=True) if s < 0}
        m *= 4
    return set(np.setdiff1d(a, b).tolist()), set(np.setdiff1d(b, a).tolist())


def fingerprints(sets: list[np.ndarray]) -> list[str]:
    s = Sketches.of(sets, CELLS)
    packed = np.concatenate([s.key.view(np.uint8).reshape(len(sets), -1), (s.check & np.uint64(0xFFFF)).astype(np.uint16).view(np.uint8).reshape(len(sets), -1), s.count.astype(np.uint16).view(np.uint8).reshape(len(sets), -1)], axis=1)
    return [f"{len(x):x}-{packed[i].tobytes().hex()}" for i, x in enumerate(sets)]


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    both = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.float64)
    diff = difference_sizes(a, b)
    return np.where(both + diff > 0, (both - diff) / np.maximum(both + diff, 1), 1.0)


def edited(text: str, other: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


def _cuts_above(value: Column, cuts: list[int]) -> Column:
    """How many of the descending cuts are at least value, by two searches of about sqrt(len(cuts)) steps."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    above = lambda c: value <= c
    coarse = F.size(F.filter(F.array(*(F.lit(g[0]) for g in groups)), above))
    inside = F.element_at(F.array(*(F.array(*map(F.lit, g)) for g in groups)), coarse)
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * width + F.size(F.filter(inside, above)))


def in_descending_order(docs: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """(_id, _text, _bucket, _order) in sorted buckets of descending id, one a partition; _order 1 marks the row sent along from the next bucket.

    n_buckets is meant; by default as many as give each BUCKET_BYTES of text, and a partition each to the session's shuffles.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    n_rows, n_null, n_bytes = rows.agg(F.count(F.lit(1)), F.count_if(F.col("_id").isNull()), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    n = n_buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / BUCKET_BYTES))
    found = rows.select(F.percentile_approx("_id", [i / n for i in range(1, n)], 10 * n) if n > 1 else F.lit(None)).first()[0] or []
    cuts = sorted(set(found), reverse=True)
    # an id that is several cuts has as many buckets, by ranges of the text's hash; the ids below it begin in the last of them
    subs = [found.count(c) for c in cuts]
    null_subs = max(1, round(n_null * n / max(1, n_rows)))
    share = (F.xxhash64("_text").cast("double") + 2.0**63) / 2.0**64
    base = F.when(F.col("_id").isNull(), len(cuts) + 1).otherwise(_cuts_above(F.col("_id"), cuts))
    offsets = np.cumsum([1, *subs, null_subs])
    first, many = (F.element_at(F.array(*map(F.lit, x)), base + 1) for x in ([0, *map(int, offsets[:-1])], [1, *subs, null_subs]))
    hot = F.col("_id").isNull() | F.col("_id").isin([c for c, k in zip(cuts, subs, strict=True) if k > 1])
    bucket = first + F.when(hot, F.least(F.floor(share * many), many - 1)).otherwise(many - 1)
    rows = rows.withColumn("_bucket", bucket.cast("int"))
    # the first rows of each bucket that has rows, and the bucket before it: as many rows as buckets; a number for the order by id, then hash (without its last bits)
    big = "decimal(38,0)"
    key = F.coalesce("_id", F.lit(0)).cast(big) * F.lit(1 << 62).cast(big) - F.shiftright(F.xxhash64("_text"), 2).cast(big)
    rows = rows.withColumn("_key", key.cast(big))
    firsts = rows.groupBy("_bucket").agg(F.max("_key").alias("_first"))
    ring = Window.orderBy("_bucket")
    firsts = firsts.withColumn("_prev", F.lag("_bucket").over(ring)).withColumn("_last", F.max("_bucket").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select(F.col("_bucket").alias("_b"), "_first", F.coalesce("_prev", "_last").alias("_prev"))
    sent = rows.join(F.broadcast(firsts), (F.col("_bucket") == F.col("_b")) & (F.col("_key") == F.col("_first")), "left")
    place = lambda bucket, order: F.struct(F.col(bucket).alias("b"), F.lit(order).alias("o"))
    copies = F.when(F.col("_b").isNull(), F.array(place("_bucket", 0))).otherwise(F.array(place("_bucket", 0), place("_prev", 1)))
    out = sent.select("_id", "_text", F.explode(copies).alias("_c")).select("_id", "_text", F.col("_c.b").alias("_bucket"), F.col("_c.o").alias("_order"))
    return out.repartitionById(int(offsets[-1]), "_bucket").sortWithinPartitions("_bucket", "_order", F.col("_id").desc_nulls_last(), F.xxhash64("_text"), "_text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, *, n_buckets: int | None = None, chunk_chars: int = 4 << 20) -> DataFrame:
    def stream(batches):
        import pandas as pd

        def judged(rows):  # (id, text, next text)
            own, new = [digests(t) for _, t, _ in rows], [edited(t, x) for _, t, x in rows]
            new_sets, next_sets = [digests(t) for t in new], [digests(x) for _, _, x in rows[-1:]]
            next_sets = own[1:] + next_sets if all(rows[i][2] is rows[i + 1][1] for i in range(len(rows) - 1)) else [digests(x) for _, _, x in rows]
            return pd.DataFrame({
                "doc_id": pd.array([r[0] for r in rows], dtype="Int64"),
                "n_chars": [len(r[1]) for r in rows],
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new],
                "fingerprint": fingerprints(own),
                "edited_fingerprint": fingerprints(new_sets),
                "near_edited": likeness(own, new_sets),
                "near_next": likeness(own, next_sets),
            })

        def pairs():
            held = None
            for pdf in batches:
                ids = pdf["_id"].astype("Int64")
                for i, t, b, o in zip(ids, pdf["_text"], pdf["_bucket"], pdf["_order"], strict=True):
                    if held is not None and held[2] == b:
                        yield held[0], held[1], t
                        held = None
                    elif held is not None:
                        raise ValueError("a bucket ended without the row that follows it")
                    if o == 0:
                        held = (None if i is pd.NA else int(i), t, b)
            if held is not None:
                raise ValueError("a bucket ended without the row that follows it")

        rows, chars = [], 0
        for row in pairs():
            rows.append(row)
            chars += len(row[1])
            if chars >= chunk_chars or len(rows) >= 2048:
                yield judged(rows)
                rows, chars = [], 0
        if rows:
            yield judged(rows)

    return in_descending_order(docs, n_buckets).mapInPandas(tidy(stream), RESULT)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
