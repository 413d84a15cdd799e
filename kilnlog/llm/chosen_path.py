"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles (lower case, split at white space; fewer than five words make one shingle).  Equal texts are
one record and so are equal sets.  Each set has a signature of SIZE minima (one permutation, empty bins filled from others).  A run
walks down a tree: at each node one or two of the signature's positions are sampled, 1 / 0.8 on
average, and the record goes to the child named by its value there; sets with similarity of 0.8 or more meet in a leaf with a probability
that depends on the depth alone, and the number of runs follows from the target recall at the greatest depth.  A bucket of at
most SMALL records is a leaf; larger ones are split further, down to MAX_DEPTH.

Leaves are not expanded into pairs.  In each leaf a record is tied to every leader that its signature is near (of ties that close a
circle only some are written), or becomes a leader; by the triangle inequality two sets of similarity 0.8 in a leaf are tied to a
common leader.  Leaves that are still large are cut into salted parts whose leaders meet again; leaders that don't become fewer make larger parts, and from some size on go on down the tree.  The components of the ties are
groups; inside each group all exact similarities are computed, in tiles of bounded size, and only counts of links and a
spanning forest of each tile leave the task.  So all links between different texts in a group are counted, whether or not a leaf held both.

Defined cases: null texts are empty; texts without words are one class without links.  Null ids are kept as rows, a class's id is its least id that is not null.
Rows of equal text share class, copy_id and links; links count the other distinct texts at similarity 0.8 or more.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnlog.llm.common import carried, materialise, restored, small_side, table, tidy
from kilnlog.llm.components import components

WORDS, THRESHOLD = 5, 0.8
SIZE, CARRIED = 128, 64  # positions of a signature; of these, one byte each goes along
RECALL, START_DEPTH, MAX_DEPTH, SMALL = 0.999, 3, 5, 256
LEADER, TIE = 0.55, 0.22  # of estimated similarity: 0.35 for a sure tie, less three deviations
TILE = 512
CROWD, APART_DEPTH = 1 << 14, 10  # leaders apart that one task compares; levels below, at which 25 runs bring two at 0.55 together less than once


def survival(depth: int, s: float = THRESHOLD) -> float:
    """The probability that two sets of similarity s share a node at depth in one run."""
    x = 1.0
    for _ in range(depth):
        x = 0.75 * s * x + 0.25 * (1 - (1 - s * x) ** 2)
    return x


def runs_for(recall: float, depth: int = MAX_DEPTH) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(depth))))


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


class Words(dict):
    """Hashes of words, kept while there are fewer than 200,000."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, words: Words) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.array([words[w] for w in found], np.uint64)
    n = max(1, len(h) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(WORDS, len(h))):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return np.unique(mix(out))


_FILL = np.random.default_rng(5).integers(0, SIZE, (SIZE, 96))


def signature(found: np.ndarray) -> np.ndarray:
    bins = (found >> np.uint64(57)).astype(np.int64)
    first = np.r_[True, bins[1:] != bins[:-1]]
    sig, full = np.zeros(SIZE, np.uint64), np.zeros(SIZE, bool)
    sig[bins[first]], full[bins[first]] = found[first], True
    if not full.all():
        empty = np.flatnonzero(~full)
        hit = full[_FILL[empty]]
        source = _FILL[empty, hit.argmax(axis=1)]
        source = np.where(hit.any(axis=1), source, bins[0])
        with np.errstate(over="ignore"):
            sig[empty] = mix(sig[source] + hit.argmax(axis=1).astype(np.uint64) + np.uint64(1))
    return sig


def descend(keys: np.ndarray, rows: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children's keys and rows: one position of each node's, a second one for a quarter of the nodes."""
    h = mix(keys)
    size = np.uint64(sigs.shape[1])
    out = []
    for part, which in ((slice(None), np.ones(len(keys), bool)), (None, (h >> np.uint64(62)) == 0)):
        pos = ((h if part is not None else h >> np.uint64(20)) % size).astype(np.int64)[which]
        r = rows[which]
        with np.errstate(over="ignore"):
            child = mix(keys[which] * np.uint64(0x9E3779B97F4A7C15) + mix(sigs[r, pos].astype(np.uint64)) + pos.astype(np.uint64) + np.uint64(part is None))
        out.append((child, r))
    return np.concatenate([k for k, _ in out]), np.concatenate([r for _, r in out])


def _records(n_runs: int):
    def part(batches):
        import pandas as pd

        words = Words()
        for pdf in (b.iloc[i : i + 1024] for b in batches for i in range(0, len(b), 1024)):
            sets = [shingles(t or "", words) for t in pdf["_text"]]
            some = [i for i, s in enumerate(sets) if len(s)]
            sigs = np.array([signature(sets[i]) for i in some], np.uint64).reshape(len(some), SIZE)
            keys = np.repeat(mix(np.arange(1, n_runs + 1, dtype=np.uint64)), len(some))
            rows = np.tile(np.arange(len(some)), n_runs)
            for _ in range(START_DEPTH):
                keys, rows = descend(keys, rows, sigs)
            order = np.argsort(rows, kind="stable")
            cuts = np.searchsorted(rows[order], np.arange(1, len(some)))
            leaves = np.split(keys[order].view(np.int64), cuts) if some else []
            short = (mix(sigs[:, :CARRIED]) & np.uint64(255)).astype(np.uint8)
            at = {i: j for j, i in enumerate(some)}
            with np.errstate(over="ignore"):
                yield pd.DataFrame({
                    "_id": pdf["_id"].astype("Int64").array,
                    "_t1": pdf["_t1"].to_numpy(),
                    "_t2": pdf["_t2"].to_numpy(),
                    "_node": np.array([mix(mix(s).sum() + np.uint64(len(s))) if len(s) else 0 for s in sets], np.uint64).view(np.int64),
                    "_sig": [short[at[i]].tobytes() if i in at else b"" for i in range(len(sets))],
                    "_leaves": [np.unique(leaves[at[i]]) if i in at else np.zeros(0, np.int64) for i in range(len(sets))],
                })

    return part


def _split(batches):
    """Rows of buckets that are too large go one level down."""
    import pandas as pd

    for pdf in batches:
        if len(pdf):
            sigs = np.frombuffer(b"".join(pdf["_sig"]), np.uint8).reshape(-1, CARRIED)
            keys, rows = descend(pdf["_leaf"].to_numpy().view(np.uint64), np.arange(len(pdf)), sigs)
            yield pd.DataFrame({"_leaf": keys.view(np.int64), "_node": pdf["_node"].to_numpy()[rows], "_sig": pdf["_sig"].to_numpy()[rows]})


def _respread(n_runs: int, depth: int):
    """Records of a leaf to new leaves, in so many runs of depth levels below it."""
    def part(batches):
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                sigs = np.frombuffer(b"".join(pdf["_sig"]), np.uint8).reshape(-1, CARRIED)
                with np.errstate(over="ignore"):
                    keys = mix((pdf["_leaf"].to_numpy().view(np.uint64)[None, :] + mix(np.arange(1, n_runs + 1, dtype=np.uint64))[:, None]).reshape(-1))
                rows = np.tile(np.arange(len(pdf)), n_runs)
                for _ in range(depth):
                    keys, rows = descend(keys, rows, sigs)
                yield pd.DataFrame({"_leaf": keys.view(np.int64), "_node": pdf["_node"].to_numpy()[rows], "_sig": pdf["_sig"].to_numpy()[rows]}).drop_duplicates(["_leaf", "_node"])

    return part


def _groups(batches, by: list[str]):
    """The frames of equal keys in sorted batches."""
    import pandas as pd

    held: list = []
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf.reset_index(drop=True)
        key = pdf[by].to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        parts = [pdf.iloc[a:b] for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(pdf)], strict=True)]
        if held and (held[0][by].iloc[0].to_numpy() == key[0]).all():
            held.append(parts.pop(0))
        if parts:
            if held:
                yield pd.concat(held) if len(held) > 1 else held[0]
            yield from parts[:-1]
            held = [parts[-1]]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _lead(batches):
    """Streams rows sorted by leaf and salt: (leaf, node, sig) of each leader with a null tie, (node, leader) of each tie."""
    import pandas as pd

    for pdf in batches_of_groups(batches, ["_leaf", "_salt"]):
        out = []
        for group in pdf:
            nodes, sigs = group["_node"].to_numpy(), np.frombuffer(b"".join(group["_sig"]), np.uint8).reshape(-1, CARRIED)
            left, leaf = np.arange(len(nodes)), group["_leaf"].iat[0]
            part = np.arange(len(nodes))  # what is tied already
            while len(left):
                i, left = left[0], left[1:]
                near = (sigs == sigs[i]).mean(axis=1)
                tied = np.flatnonzero((near >= TIE) & (part != part[i]))
                labels, first = np.unique(part[tied], return_index=True)
                out += [(leaf, int(nodes[tied[j]]), int(nodes[i]), None) for j in first]  # one tie for each part that joins
                part[np.isin(part, labels)] = part[i]
                out.append((leaf, int(nodes[i]), None, sigs[i].tobytes()))
                left = left[near[left] < LEADER]
        if out:
            cols = list(zip(*out, strict=True))
            yield pd.DataFrame({"_leaf": cols[0], "_node": cols[1], "_to": pd.array(cols[2], dtype="Int64"), "_sig": pd.Series(cols[3], dtype=object)})


def batches_of_groups(batches, by: list[str], rows: int = 4096):
    """Lists of whole groups, together of about so many rows."""
    held, n = [], 0
    for g in _groups(batches, by):
        held.append(g)
        n += len(g)
        if n >= rows:
            yield held
            held, n = [], 0
    if held:
        yield held


_LEAF = "_leaf long, _node long, _sig binary"


def _ties(spark: SparkSession, sets: DataFrame, small: int, max_depth: int, recall: float, crowd: int) -> DataFrame:
    """(a, b): a record and a leader that its signature is near."""
    sigs = sets.select("_node", "_sig")
    rows = sets.select(F.explode("_leaves").alias("_leaf"), "_node")
    counted = rows.groupBy("_leaf").count().where("count > 1")
    leaf_rows = materialise(spark, rows.join(counted, "_leaf").join(sigs, "_node").select("_leaf", "_node", "_sig", "count"), "path-leaves")
    done, large = [leaf_rows.where(F.col("count") <= small)], leaf_rows.where(F.col("count") > small)
    for _ in range(START_DEPTH, max_depth):
        if large.isEmpty():
            break
        deeper = materialise(spark, large.select("_leaf", "_node", "_sig").mapInPandas(tidy(_split), _LEAF), "path-split")
        counted = deeper.groupBy("_leaf").count().where("count > 1")
        deeper = materialise(spark, deeper.join(counted, "_leaf").select("_leaf", "_node", "_sig", "count"), "path-leaves")
        done.append(deeper.where(F.col("count") <= small))
        large = deeper.where(F.col("count") > small)
    now = large
    for d in done:
        now = now.unionByName(d)
    found = None
    while True:
        salt = F.pmod(F.xxhash64("_node"), F.ceil(F.col("count") / small)).cast("int")
        dealt = now.withColumn("_salt", salt).repartition("_leaf", "_salt").sortWithinPartitions("_leaf", "_salt", "_node")
        led = materialise(spark, dealt.select("_leaf", "_salt", "_node", "_sig").mapInPandas(tidy(_lead), "_leaf long, _node long, _to long, _sig binary"), "path-leaders")
        ties = led.where("_to is not null").select(F.col("_node").alias("a"), F.col("_to").alias("b")).distinct()
        found = ties if found is None else found.unionByName(ties)
        cut = now.where(F.col("count") > small).select("_leaf").distinct()
        again = led.where("_to is null").select("_leaf", "_node", "_sig").join(cut, "_leaf", "left_semi")
        again = materialise(spark, again.join(again.groupBy("_leaf").count(), "_leaf"), "path-again")
        if again.isEmpty():
            return found.distinct()
        if again.count() > 0.7 * now.where(F.col("count") > small).count():
            # these leaders are hardly near each other, so their parts stay as many
            if small < crowd:
                small *= 4
            else:
                # they go on down the tree, in as many runs as the recall asks for, so deep that fewer pairs of them meet again than now do
                spread = again.select("_leaf", "_node", "_sig").mapInPandas(tidy(_respread(runs_for(recall, APART_DEPTH), APART_DEPTH)), _LEAF)
                spread = materialise(spark, spread, "path-spread")
                again = materialise(spark, spread.join(spread.groupBy("_leaf").count().where("count > 1"), "_leaf"), "path-again")
        now = again


def _tile(batches):
    """Exact similarities inside each tile pair; rows (node, links, to): a record's number of linked texts, or an edge of the spanning forest."""
    import pandas as pd

    for groups in batches_of_groups(batches, ["_group", "_i", "_j"], 512):
        out: list[tuple] = []
        for g in groups:
            g = g.drop_duplicates("_node")
            nodes, texts, tile = g["_node"].to_numpy(), g["_texts"].to_numpy(), g["_tile"].to_numpy()
            if len(nodes) < 2:
                continue
            sets = [np.frombuffer(b, np.uint64) for b in g["_set"]]
            sizes = np.array([len(s) for s in sets])
            every, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            u, inv, n = np.unique(every, return_inverse=True, return_counts=True)
            shared = n[inv] > 1
            inv, own = np.unique(inv[shared], return_inverse=True)[1], own[shared]
            common = np.zeros((len(nodes), len(nodes)), np.float32)
            order = np.argsort(inv, kind="stable")
            inv, own = inv[order], own[order]
            width = max(1, min((8 << 20) // len(nodes), len(inv) and int(inv[-1]) + 1))
            for lo in range(0, (inv[-1] + 1) if len(inv) else 0, width):
                a, b = np.searchsorted(inv, [lo, lo + width])
                m = np.zeros((len(nodes), width), np.float32)
                m[own[a:b], inv[a:b] - lo] = 1
                common += m @ m.T
            union = sizes[:, None] + sizes[None, :] - common
            link = 5 * common >= 4 * union
            np.fill_diagonal(link, False)
            if g["_i"].iat[0] != g["_j"].iat[0]:
                link &= tile[:, None] != tile[None, :]
            links = link @ texts.astype(np.int64)
            out += [(int(x), int(k), None) for x, k in zip(nodes, links, strict=True) if k]
            seen = np.zeros(len(nodes), bool)
            for start in range(len(nodes)):
                if seen[start]:
                    continue
                seen[start], todo = True, [start]
                while todo:
                    x = todo.pop()
                    for y in np.flatnonzero(link[x] & ~seen):
                        seen[y] = True
                        out.append((int(nodes[y]), 0, int(nodes[x])))
                        todo.append(y)
        if out:
            cols = list(zip(*out, strict=True))
            yield pd.DataFrame({"_node": cols[0], "_links": cols[1], "_to": pd.array(cols[2], dtype="Int64")})


def jaccard_join(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL, small: int = SMALL, max_depth: int = MAX_DEPTH, tile: int = TILE, crowd: int = CROWD) -> DataFrame:
    """(_id, _t1, _t2, class_id, copy_id, n_links) of every row of docs; _t1 and _t2 hash the text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(1), text).alias("_t2"), text.alias("_text"))
    schema = "_id long, _t1 long, _t2 long, _node long, _sig binary, _leaves array<long>"
    records = materialise(spark, keyed.mapInPandas(tidy(_records(runs_for(recall, max_depth))), schema), "path-records")
    texts = records.groupBy("_t1", "_t2").agg(F.min("_id").alias("_copy"), F.first("_node").alias("_node"))
    texts = materialise(spark, texts, "path-texts")
    per_set = texts.groupBy("_node").agg(F.count(F.lit(1)).alias("_texts"), F.min("_copy").alias("_least"), F.min(F.struct("_t1", "_t2", "_copy")).alias("_rep"))
    sets = records.groupBy("_node").agg(F.first("_sig").alias("_sig"), F.first("_leaves").alias("_leaves")).where("_node <> 0")
    groups = components(spark, _ties(spark, materialise(spark, sets, "path-sets"), small, max_depth, recall, crowd)).withColumnRenamed("root", "_group")
    sized = groups.groupBy("_group").count()
    members = groups.join(sized, "_group").join(per_set.withColumnRenamed("_node", "node"), "node").select(F.col("node").alias("_node"), "_group", "_texts", F.ceil(F.col("count") / tile).cast("int").alias("_tiles"), F.col("_rep._t1").alias("_r1"), F.col("_rep._t2").alias("_r2"), F.col("_rep._copy").alias("_rid"))
    members = materialise(spark, members, "path-members")
    chosen = keyed.join(small_side(members, 96), (F.col("_t1") == F.col("_r1")) & (F.col("_t2") == F.col("_r2")) & F.col("_id").eqNullSafe(F.col("_rid")))

    def to_sets(batches):
        import pandas as pd

        words = Words()
        for pdf in batches:
            yield pd.DataFrame({"_node": pdf["_node"], "_group": pdf["_group"], "_texts": pdf["_texts"], "_tiles": pdf["_tiles"], "_set": [shingles(t, words).tobytes() for t in pdf["_text"]]})

    sent = chosen.select("_node", "_group", "_texts", "_tiles", "_text").mapInPandas(tidy(to_sets), "_node long, _group long, _texts long, _tiles int, _set binary")
    own = F.pmod(F.xxhash64("_node"), F.col("_tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_tiles") - 1), lambda o: F.struct(F.least(o, F.col("_tile")).alias("i"), F.greatest(o, F.col("_tile")).alias("j")))
    dealt = sent.withColumn("_tile", own).withColumn("_p", F.explode(pairs)).select("_group", F.col("_p.i").alias("_i"), F.col("_p.j").alias("_j"), "_node", "_texts", "_tile", "_set")
    dealt = dealt.repartition("_group", "_i", "_j").sortWithinPartitions("_group", "_i", "_j")
    judged = materialise(spark, dealt.mapInPandas(tidy(_tile), "_node long, _links long, _to long"), "path-judged")
    roots = components(spark, judged.where("_to is not null").select(F.col("_node").alias("a"), F.col("_to").alias("b"))).select(F.col("node").alias("_node"), "root")
    links = judged.where("_to is null").groupBy("_node").agg(F.sum("_links").alias("_links"))
    nodes = per_set.join(roots, "_node", "left").join(links, "_node", "left").withColumn("_root", F.coalesce("root", "_node"))
    least = nodes.groupBy("_root").agg(F.min("_least").alias("class_id"))
    of_node = nodes.join(least, "_root").select("_node", "class_id", F.when(F.col("_node") == 0, F.lit(0)).otherwise(F.coalesce("_links", F.lit(0)) + F.col("_texts") - 1).cast("long").alias("n_links"))
    of_text = texts.join(of_node, "_node").select("_t1", "_t2", F.col("_copy").alias("copy_id"), "class_id", "n_links")
    return records.select("_id", "_t1", "_t2").join(of_text, ["_t1", "_t2"]).select("_id", "_t1", "_t2", "class_id", "copy_id", "n_links")


def one_of_each(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose id is the least of their class, each class once, with their columns; classes without an id keep one row."""
    joined = materialise(spark, jaccard_join(spark, docs, id_col=id_col, text_col=text_col, **options), "path-joined")
    key = F.struct(F.col("_id").isNull().alias("n"), "_id", "_t1", "_t2")
    of_class = [F.coalesce("class_id", "_t1"), F.col("class_id").isNull()]
    first = joined.groupBy(of_class[0].alias("_class"), of_class[1].alias("_none")).agg(F.min(key).alias("_k"))
    first = materialise(spark, first.select(F.col("_k._id").alias("_kid"), F.col("_k._t1").alias("_k1"), F.col("_k._t2").alias("_k2")), "path-first")
    # met by row, not by class, so that a class of very many rows is no hot key
    is_first = F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_t1") == F.col("_k1")) & (F.col("_t2") == F.col("_k2"))
    as_keys = lambda df: small_side(materialise(spark, df.select(F.col("_id").alias("_kid"), F.col("_t1").alias("_k1"), F.col("_t2").alias("_k2")), "path-keys"), 32)
    dropped = as_keys(joined.select("_id", "_t1", "_t2").distinct().join(first, is_first, "left_anti"))
    repeated = as_keys(joined.join(first, is_first, "left_semi").groupBy("_id", "_t1", "_t2").count().where("count > 1"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kept = carried(docs, _id=F.col(f"`{id_col}`").cast("long"), _t1=F.xxhash64(text), _t2=F.xxhash64(F.lit(1), text)).join(dropped, is_first, "left_anti")
    if repeated.isEmpty():
        return restored(kept, docs)
    once = kept.join(repeated, is_first, "left_semi").dropDuplicates(["_id", "_t1", "_t2"])
    return restored(kept.join(repeated, is_first, "left_anti").unionByName(once), docs)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return joined.select(F.col("_id").alias("doc_id"), "class_id", "copy_id", "n_links")


#: All pairs of texts that share a shingle, and the closure of their links.
ORACLE = """
with recursive tx as (select coalesce(text, '') as text, min(doc_id) as copy_id from documents group by 1),
wd as (select copy_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') as w from tx),
sh as (select distinct copy_id, array_to_string(w[i:i + 4], ' ') as s from wd, unnest(range(1, greatest(len(w) - 4, 1) + 1)) u(i) where len(w) > 0),
sz as (select copy_id, count(*) as n from sh group by 1),
pr as (select a.copy_id as x, b.copy_id as y, count(*) as c from sh a join sh b on a.s = b.s and a.copy_id <> b.copy_id group by 1, 2),
lk as (select x, y from pr join sz a on a.copy_id = x join sz b on b.copy_id = y where 5 * c >= 4 * (a.n + b.n - c)),
cc(x, y) as (select copy_id, copy_id from tx union select cc.x, lk.y from cc join lk on lk.x = cc.y),
cl as (select x, min(y) as class_id from cc group by 1),
bl as (select min(copy_id) as class_id from wd where len(w) = 0),
nl as (select x, count(*) as n from lk group by 1)
select d.doc_id, case when len(wd.w) = 0 then bl.class_id else cl.class_id end as class_id, tx.copy_id, coalesce(nl.n, 0)::bigint as n_links
from documents d join tx on coalesce(d.text, '') = tx.text join wd on wd.copy_id = tx.copy_id join cl on cl.x = tx.copy_id left join nl on nl.x = tx.copy_id, bl
"""
