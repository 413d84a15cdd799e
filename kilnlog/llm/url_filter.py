"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed entry is a host and a path; it fits a URL whose host is the entry's or a subdomain of it and
whose path starts with the entry's.  Each distinct URL is turned into the keys that could be listed
(its host suffixes times its path prefixes of the lengths that occur in the list); the filter passes few of them, and
a hash join with the list removes its false positives.  The longest entry decides.

The filter has 512-bit blocks of eight 64-bit words with one bit set in each; it is built by partition
and united by bit_or, so building needs no collected list.  What reaches the driver is the filter,
bounded by max_filter_bytes: a longer list only passes more false positives to the join.

Defined cases: null URLs and URLs without :// have empty host and path and fit nothing.  Equal URLs are
judged once and the verdict joined to every row, so repeated rows, ties and hot hosts cost nothing.  An entry
listed twice counts once; if it is listed with both verdicts, block wins.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnlog.llm.common import carried, restored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY = 16
_WORDS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    return F.translate(host, UPPER, LOWER), rest.substr(F.length(host) + 1, F.length(rest))


def _bits(keys: list[str], n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each key the block and the mask of each of its eight words."""
    import xxhash

    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
    block = ((h >> np.uint64(32)) % np.uint64(n_blocks)).astype(np.int64)
    low = h & np.uint64(0xFFFFFFFF)
    odd = np.array([0x47B6137B44974D91, 0x8824AD5BA2B7289D, 0x705495C72DF1424B, 0x9EFC49475C6BFB31, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1, 0x9B05688C2B3E6C1F], np.uint64)
    with np.errstate(over="ignore"):
        bit = (low[:, None] * odd[None, :]) >> np.uint64(58)
    return block, np.uint64(1) << bit


class BlockedBloom:
    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @classmethod
    def build(cls, listed: DataFrame, key: str, n_keys: int, max_filter_bytes: int = 64 << 20) -> BlockedBloom:
        n_blocks = max(1, min(math.ceil(n_keys * BITS_PER_KEY / 512), max_filter_bytes // 64))

        def part(batches):
            import pandas as pd

            for pdf in batches:
                block, mask = _bits(pdf[key].tolist(), n_blocks)
                words = np.zeros((len(u := np.unique(block)), _WORDS), np.uint64)
                np.bitwise_or.at(words, np.searchsorted(u, block), mask)
                yield pd.DataFrame({"block": u} | {f"w{i}": words[:, i].view(np.int64) for i in range(_WORDS)})

        schema = "block long, " + ", ".join(f"w{i} long" for i in range(_WORDS))
        rows = listed.select(key).mapInPandas(part, schema).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS))).toPandas()
        words = np.zeros((n_blocks, _WORDS), np.uint64)
        if len(rows):
            words[rows["block"].to_numpy()] = rows[[f"w{i}" for i in range(_WORDS)]].to_numpy(np.int64).view(np.uint64)
        return cls(words)

    def might_hold(self, keys: list[str]) -> np.ndarray:
        block, mask = _bits(keys, len(self.words))
        return ((self.words[block] & mask) == mask).all(axis=1)


def judge_urls(spark: SparkSession, urls: DataFrame, listed: DataFrame, *, url_col: str = "url", default: str = "allow", max_filter_bytes: int = 64 << 20) -> DataFrame:
    """The rows of urls with host, path, rule and verdict, in the place of columns of these names; listed has host, path, verdict."""
    ranked = listed.where("host is not null and path is not null").groupBy("host", "path").agg(F.max(F.when(F.col("verdict") == "block", "block").otherwise("allow")).alias("_verdict"))
    rules = ranked.select(F.concat_ws("\u0000", "host", "path").alias("_key"), F.concat("host", "path").alias("_rule"), "_verdict", F.length("path").alias("_len"))
    lengths = sorted(r[0] for r in rules.select("_len").distinct().collect())  # at most the longest path
    bloom = spark.sparkContext.broadcast(BlockedBloom.build(rules, "_key", rules.count(), max_filter_bytes).words)
    url = F.col(f"`{url_col}`")
    host, path = host_and_path(url)
    distinct = urls.select(url.alias("_url")).distinct().where("_url is not null")
    parts = distinct.select("_url", *(c.alias(n) for c, n in zip(host_and_path(F.col("_url")), ("_host", "_path"), strict=True)))

    def probe(batches):
        import pandas as pd

        filt = BlockedBloom(bloom.value)
        for pdf in batches:
            keys, at = [], []
            for i, (h, p) in enumerate(zip(pdf["_host"], pdf["_path"], strict=True)):
                names = h.split(".")
                for j in range(len(names)):
                    suffix = ".".join(names[j:])
                    for n in lengths:
                        if n > len(p):
                            break
                        keys.append(f"{suffix}\0{p[:n]}")
                        at.append(i)
            if keys:
                hit = np.flatnonzero(filt.might_hold(keys))
                yield pd.DataFrame({"_url": pdf["_url"].to_numpy()[np.array(at)[hit]], "_key": [keys[i] for i in hit]})

    fits = parts.mapInPandas(probe, "_url string, _key string").join(rules, "_key")
    best = fits.groupBy("_url").agg(F.max_by(F.struct("_rule", "_verdict"), F.struct(F.length("_rule"), "_rule")).alias("_best"))
    rows = carried(urls, _of=url, _host=host, _path=path).join(best, F.col("_of") == F.col("_url"), "left")
    return restored(rows, urls, host=F.col("_host"), path=F.col("_path"), rule=F.col("_best._rule"), verdict=F.coalesce("_best._verdict", F.lit(default)))


#: Verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge_urls(spark, table(spark, sf_dir, "pages").select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
with r(verdict, host, path) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u as (select page_id, url, case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') else '' end as rest from pages),
p as (select page_id, url, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) as path from u),
d as (select distinct host, path from p),
b as (select d.host, d.path, arg_max({'rule': r.host || r.path, 'verdict': r.verdict}, length(r.host || r.path)) as best
  from d join r on (d.host = r.host or ends_with(d.host, '.' || r.host)) and starts_with(d.path, r.path) group by 1, 2)
select page_id, coalesce(p.host, '') as host, coalesce(p.path, '') as path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict
from p left join b on p.host = b.host and p.path = b.path
"""
