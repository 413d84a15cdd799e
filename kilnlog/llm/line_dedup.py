"""Line dedup: sorted hash ranges give keep bitmaps.

Lines become (hash, document, position) rows.  These are range-partitioned by (hash, document) and sorted inside
the partitions by position too; a streaming pass over each partition meets every hash as one run and emits
one summary a run: documents, lines, first occurrence.  As the ranges are cut by document as well, a very
frequent line spreads over many partitions, and the few runs that a cut divides are united afterwards.
Lines found in enough documents lose all their lines, or all but the first occurrence (keep="first").  The result is a compressed
keep bitmap for each document that loses a line; texts do not move.

Defined cases: a null text is one empty line.  Rows of equal id and text are one document; rows of equal id
count as one document for the threshold, a null id too.  Keys shorter than min_chars are always kept.
Hashes have 128 bits.  A bitmap is zlib over packed bits, 1 for kept lines.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnlog.llm.common import BROADCAST_BYTES, carried, materialise, restored, table, tidy
from kilnlog.llm.url_filter import LOWER, UPPER

HOT_LINES = 1_000_000
_BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_BLANK)), UPPER, LOWER)


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(_doc, _text, _n, _pos, _h1, _h2): a row for each line whose key is long enough."""
    split = docs.select(F.col(f"`{id_col}`").alias("_doc"), _text_key(text_col).alias("_text"), F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n", -1).alias("_lines"))
    each = split.select("_doc", "_text", F.size("_lines").alias("_n"), F.posexplode("_lines").alias("_pos", "_line")).withColumn("_key", line_key(F.col("_line")))
    return each.where(F.length("_key") >= min_chars).select("_doc", "_text", "_n", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))


def _runs(batches):
    """Streams sorted rows; one summary for each run of equal hashes, which may go over batches."""
    import pandas as pd

    held = None  # h1, h2, docs, lines, first doc, first pos, last doc
    for pdf in batches:
        if not len(pdf):
            continue
        h1, h2, pos = (pdf[c].to_numpy() for c in ("_h1", "_h2", "_pos"))
        doc = pdf["_doc"].astype("Int64")
        none, doc = doc.isna().to_numpy(), doc.fillna(0).to_numpy(np.int64)
        start = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        fresh = start | np.r_[True, (doc[1:] != doc[:-1]) | (none[1:] != none[:-1])]
        at = np.flatnonzero(start)
        n_docs, n_lines = np.add.reduceat(fresh.astype(np.int64), at), np.diff(np.r_[at, len(h1)])
        out = [[int(h1[i]), int(h2[i]), int(d), int(n), None if none[i] else int(doc[i]), int(pos[i])] for i, d, n in zip(at, n_docs, n_lines, strict=True)]
        if held is not None:
            if held[0][:2] == out[0][:2]:
                out[0][2] += held[0][2] - ((None if none[0] else int(doc[0])) == held[1])
                out[0][3] += held[0][3]
                out[0][4:] = held[0][4:]
            else:
                out.insert(0, held[0])
        held = (out.pop(), None if none[-1] else int(doc[-1]))
        if out:
            yield _frame(pd, out)
    if held is not None:
        yield _frame(pd, [held[0]])


def _frame(pd, rows):
    cols = list(zip(*rows, strict=True))
    return pd.DataFrame({"_h1": cols[0], "_h2": cols[1], "_docs": cols[2], "_lines": cols[3], "_first_doc": pd.array(cols[4], dtype="Int64"), "_first_pos": cols[5]})


def _bitmap(n: int, dropped) -> bytes:
    keep = np.ones(n, np.uint8)
    keep[np.asarray(dropped, np.int64)] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def keep_bitmaps(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep: str = "none", broadcast_bytes: int = BROADCAST_BYTES, hot_lines: int = HOT_LINES) -> DataFrame:
    """(_doc, _text, n_lines, n_dropped, keep_bitmap) of the documents that lose lines."""
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    rows = materialise(spark, lines(docs, id_col, text_col, min_chars), "line-hashes")
    # rows of equal id and text count their lines once
    ranged = rows.select("_h1", "_h2", "_doc", "_pos").repartitionByRange("_h1", "_h2", "_doc").sortWithinPartitions("_h1", "_h2", "_doc", "_pos")
    runs = ranged.mapInPandas(tidy(_runs), "_h1 long, _h2 long, _docs long, _lines long, _first_doc long, _first_pos int")
    united = runs.groupBy("_h1", "_h2").agg(F.sum("_docs").alias("_docs"), F.sum("_lines").alias("_lines"), F.min(F.struct(F.col("_first_doc"), F.col("_first_pos"))).alias("_first"))
    often = materialise(spark, united.where(F.col("_docs") >= min_docs).select("_h1", "_h2", "_lines", "_first"), "line-often")
    if often.limit(broadcast_bytes // 64 + 1).count() * 64 <= broadcast_bytes:
        lost = rows.join(F.broadcast(often), ["_h1", "_h2"])
    else:
        # hashes of very many lines are few, at most all lines / HOT_LINES; the others fill no task
        hot = often.where(F.col("_lines") >= hot_lines)
        rest = rows.join(F.broadcast(hot.select("_h1", "_h2")), ["_h1", "_h2"], "left_anti").join(often.where(F.col("_lines") < hot_lines), ["_h1", "_h2"])
        lost = rows.join(F.broadcast(hot), ["_h1", "_h2"]).unionByName(rest)
    if keep == "first":
        lost = lost.where(~(F.col("_doc").eqNullSafe(F.col("_first._first_doc")) & (F.col("_pos") == F.col("_first._first_pos"))))

    @F.pandas_udf("binary")
    def bitmap(n, dropped):
        import pandas as pd

        return pd.Series([_bitmap(a, b) for a, b in zip(n, dropped, strict=True)], dtype=object)

    per_doc = lost.groupBy("_doc", "_text").agg(F.max("_n").alias("n_lines"), F.collect_set("_pos").alias("_dropped"))
    return per_doc.select("_doc", "_text", F.col("n_lines").cast("long").alias("n_lines"), F.size("_dropped").cast("long").alias("n_dropped"), bitmap("n_lines", "_dropped").alias("keep_bitmap"))


def kept_text(text: str, bitmap: bytes | None) -> str:
    if bitmap is None:
        return text
    parts = text.split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(parts))
    return "\n".join(p for p, k in zip(parts, keep, strict=True) if k)


def with_bitmaps(spark: SparkSession, docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as carried() has them, with _id, _keep, the bitmap or null, and _n_dropped; the bitmaps are broadcast if they are few, and joined by shuffle if not."""
    bitmaps = materialise(spark, bitmaps, "line-bitmaps").select(F.col("_doc").alias("_doc2"), F.col("_text").alias("_text2"), F.col("keep_bitmap").alias("_keep"), F.col("n_dropped").alias("_n_dropped"))
    size = bitmaps.agg(F.coalesce(F.sum(F.length("_keep") + 64), F.lit(0))).first()[0]
    if size <= 32 << 20:
        bitmaps = F.broadcast(bitmaps)
    rows = carried(docs, _id=F.col(f"`{id_col}`"), _key=_text_key(text_col))
    return rows.join(bitmaps, F.col("_id").eqNullSafe(F.col("_doc2")) & (F.col("_key") == F.col("_text2")), "left").drop("_doc2", "_text2", "_key")


def dedup_lines(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs with its text column replaced by the kept lines; null stays null where nothing is dropped."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")

    @F.pandas_udf("string")
    def apply(text, bitmap):
        import pandas as pd

        return pd.Series([None if t is None else kept_text(t, b) for t, b in zip(text, bitmap, strict=True)], dtype=object)

    joined = with_bitmaps(spark, docs, keep_bitmaps(spark, docs, **options), id_col=id_col, text_col=text_col)
    own = F.col(f"_c{docs.columns.index(text_col)}")
    return restored(joined, docs, **{text_col: F.when(F.col("_keep").isNull(), own).otherwise(apply(own, F.col("_keep")))})


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = with_bitmaps(spark, docs, keep_bitmaps(spark, docs, min_docs=10, min_chars=1)).select("_id", F.col("_c1").alias("text"), "_keep", "_n_dropped")

    def digest(batches):
        import pandas as pd

        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            kept = [kept_text(t, b) for t, b in zip(texts, pdf["_keep"], strict=True)]
            yield pd.DataFrame({
                "doc_id": pdf["_id"].astype("Int64"),
                "n_lines": [t.count("\n") + 1 for t in texts],
                "n_dropped": pdf["_n_dropped"].fillna(0).astype("int64"),
                "kept_sha256": [hashlib.sha256(k.encode()).hexdigest() for k in kept],
            })

    return joined.mapInPandas(tidy(digest), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10),
m as (select k.doc_id, pos, line, f.key is not null as hit from k left join f on k.key = f.key)
select doc_id, count(*)::bigint as n_lines, sum(hit::int)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not hit), '')) as kept_sha256
from m group by doc_id
"""
