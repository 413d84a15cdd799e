"""Template mining: an online fixed-depth parse tree over tokens (Drain, ICWS 2017).

Lines of different token counts never meet in the tree, so (stream, token count) is the unit of order; its lines are
streamed in order through one task, with only the clusters in memory.  Ids are global: clusters are
numbered by their first lines.  Below the root stand the token counts, so a depth of 4 means one leading token above the clusters.
The bound on clusters holds for each stream and token count: a new cluster over it ends the one that was hit longest ago, which keeps its lines and its id
but gets no more.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilnlog.functions.lines import content, tokens
from kilnlog.functions.text import entity, keywords, quote
from kilnlog.profiles import MinerOptions

WILD = "<*>"
_OUT = "file string, line_no long, n_tokens int, cluster int, template_at_parse string"


class Tree:
    """Clusters of lines of one token count: a leaf by leading tokens, the best similarity inside the leaf.

    A leading token goes to the child of its name or else to the wild one.  A new cluster opens a child for its token, but for tokens with digits
    and when a node has no room: the last of max_children is the wild one.
    """

    def __init__(self, options: MinerOptions) -> None:
        self.options, self.clusters, self.leaves, self.children = options, [], {}, {}
        self.live: dict[int, tuple[str, ...]] = {}  # cluster to leaf, the one hit last at the end

    def _leading(self, line: list[str]) -> list[str]:
        return line[: max(0, min(self.options.depth - 3, len(line) - 1))]

    def _find(self, line: list[str]) -> tuple[str, ...] | None:
        at: tuple[str, ...] = ()
        for t in self._leading(line):
            known = self.children.get(at, set())
            if t not in known and WILD not in known:
                return None
            at += (t if t in known else WILD,)
        return at

    def _open(self, line: list[str]) -> tuple[str, ...]:
        at: tuple[str, ...] = ()
        for t in self._leading(line):
            known = self.children.setdefault(at, set())
            if t not in known:
                room = self.options.max_children - len(known) - (WILD not in known)
                t = WILD if room < 1 or any(c.isdigit() for c in t) else t
                known.add(t)
            at += (t,)
        return at

    def seed(self, template: list[str]) -> None:
        leaf = self._open(template)
        self.leaves.setdefault(leaf, []).append(len(self.clusters))
        self.live[len(self.clusters)] = leaf
        self.clusters.append(list(template))
        if len(self.live) > max(1, self.options.max_clusters):
            oldest = next(iter(self.live))
            self.leaves[self.live.pop(oldest)].remove(oldest)

    def shape(self) -> dict:
        """What stands beside the clusters, as JSON can hold it."""
        return {"children": [[list(at), sorted(known)] for at, known in self.children.items()], "live": [[i, list(leaf)] for i, leaf in self.live.items()]}

    def restore(self, clusters: list[list[str]], shape: dict) -> None:
        self.clusters = clusters
        self.children = {tuple(at): set(known) for at, known in shape["children"]}
        self.live = {i: tuple(leaf) for i, leaf in shape["live"]}
        for i in sorted(self.live):
            self.leaves.setdefault(self.live[i], []).append(i)

    def add(self, line: list[str]) -> int:
        leaf = self._find(line)
        best, best_at = (-1.0, -1), -1
        for i in self.leaves.get(leaf, ()):
            t = self.clusters[i]
            same = sum(a == b for a, b in zip(t, line, strict=True) if a != WILD)
            if (key := (same / len(line) if line else 1.0, t.count(WILD))) > best:
                best, best_at = key, i
        if best_at < 0 or best[0] < self.options.similarity:
            self.seed(line)
            return len(self.clusters) - 1
        self.live[best_at] = self.live.pop(best_at)
        self.clusters[best_at] = [a if a == b else WILD for a, b in zip(self.clusters[best_at], line, strict=True)]
        return best_at


def _mine(options: MinerOptions):
    def stream(batches) -> Iterator:
        import pandas as pd

        key, tree = None, Tree(options)
        for pdf in batches:
            out = []
            for file, n, at, line, seeded in zip(pdf["file"], pdf["n_tokens"], pdf["line_no"], pdf["_tokens"], pdf["_seed"], strict=True):
                if (file, n) != key:
                    key, tree = (file, n), Tree(options)
                if seeded:
                    tree.seed(list(line))
                    continue
                c = tree.add(list(line))
                out.append((file, at, n, c, " ".join(tree.clusters[c])))
            if out:
                yield pd.DataFrame(out, columns=["file", "line_no", "n_tokens", "cluster", "template_at_parse"])

    return stream


def mine(lines: DataFrame, options: MinerOptions = MinerOptions(), seeds: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """(file, line_no, n_tokens, cluster, template_at_parse) of every line that isn't empty; lines have file, line_no, raw.

    seeds, (file, template_id, template) of an earlier run, go in first.
    """
    rows = lines.where(F.col("raw") != "").select("file", "line_no", tokens(content(F.col("raw")), options.delimiters).alias("_tokens"), F.lit(False).alias("_seed"))
    if seeds is not None:
        rows = rows.unionByName(seeds.select("file", F.col("template_id").alias("line_no"), F.split("template", " ").alias("_tokens"), F.lit(True).alias("_seed")))
    rows = rows.withColumn("n_tokens", F.size("_tokens")).repartition("file", "n_tokens").sortWithinPartitions("file", "n_tokens", F.desc("_seed"), "line_no")
    return rows.select("file", "line_no", "n_tokens", "_tokens", "_seed").mapInPandas(_mine(options), _OUT)


def templates(mined: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(file, template_id, template, count, n_tokens, cluster, first_line), ids from 1 by first line; the template is the last one."""
    out = mined.groupBy("file", "n_tokens", "cluster").agg(F.count(F.lit(1)).alias("count"), F.min("line_no").alias("first_line"), F.max_by("template_at_parse", "line_no").alias("template"))
    if seeds is None:
        rank = F.row_number().over(Window.partitionBy("file").orderBy("first_line"))
        return out.select("file", rank.cast("long").alias("template_id"), "template", "count", "n_tokens", "cluster", "first_line")
    old = seeds.select("file", F.col("template_id").alias("_id"), F.col("template").alias("_template"), F.col("count").alias("_count"), F.size(F.split("template", " ")).alias("n_tokens"))
    old = old.withColumn("cluster", F.row_number().over(Window.partitionBy("file", "n_tokens").orderBy("_id")) - 1)
    most = old.groupBy("file").agg(F.max("_id").alias("_most"))
    both = old.join(out, ["file", "n_tokens", "cluster"], "full").join(most, "file", "left")
    fresh = F.row_number().over(Window.partitionBy("file", F.col("_id").isNull()).orderBy("first_line"))
    return both.select("file", F.coalesce("_id", F.coalesce("_most", F.lit(0)) + fresh).cast("long").alias("template_id"), F.coalesce("template", "_template").alias("template"), (F.coalesce("_count", F.lit(0)) + F.coalesce("count", F.lit(0))).alias("count"), "n_tokens", "cluster", "first_line")


def parsed_lines(lines: DataFrame, mined: DataFrame, found: DataFrame, options: MinerOptions = MinerOptions()) -> DataFrame:  # noqa: B008
    """lines with template_id, template_at_parse and params: what stood at the template's wild places as of that line."""
    ids = found.select("file", "n_tokens", "cluster", "template_id")
    own = mined.join(ids, ["file", "n_tokens", "cluster"]).select("file", "line_no", "template_id", "template_at_parse")
    line, tpl = tokens(content(F.col("raw")), options.delimiters), F.split("template_at_parse", " ")
    params = F.when(F.size(line) == F.size(tpl), F.transform(F.filter(F.arrays_zip(line.alias("a"), tpl.alias("b")), lambda x: x["b"] == WILD), lambda x: x["a"])).otherwise(F.array().cast("array<string>"))
    return lines.join(own, ["file", "line_no"]).withColumn("params", params)


_STATE = "struct<clusters:array<struct<cluster_id:bigint,cluster_count:bigint,log_template_tokens:array<string>>>>"


def write_state(found: DataFrame, path: str) -> None:
    """The templates of one log as one JSON object, in the order of ids; as long as the log has templates."""
    rows = F.sort_array(F.collect_list(F.struct(F.col("template_id").alias("cluster_id"), F.col("count").alias("cluster_count"), F.split("template", " ").alias("log_template_tokens"))))
    found.agg(F.to_json(F.struct(rows.alias("clusters"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_state(spark: SparkSession, path: str, file: str) -> DataFrame:
    """(file, template_id, template, count) of such a file, as mine() and templates() take them for a log."""
    state = spark.read.text(path, wholetext=True).select(F.from_json("value", _STATE).alias("s")).select(F.explode("s.clusters").alias("c"))
    return state.select(F.lit(file).alias("file"), F.col("c.cluster_id").alias("template_id"), F.array_join("c.log_template_tokens", " ").alias("template"), F.col("c.cluster_count").alias("count"))


def top(found: DataFrame, n: int = 20) -> DataFrame:
    return found.orderBy(F.desc("count"), "template_id").limit(n)


def compact_template(template, count=None):
    hit = F.lit("") if count is None else F.concat(F.lit("|hit="), count.cast("string"))
    return F.concat(F.lit("TPL|"), entity(template), hit, F.lit("|kw="), keywords(template), F.lit('|"'), quote(template), F.lit('"'))


FORMAT = "aaak-log-v1"  # fixed value: the name of the compact form


def compact_templates(found: DataFrame, n: int = 5) -> DataFrame:
    """(file, summary): the n templates of most lines, later ids first among equals; no row for a stream without templates."""
    n = max(n, 1)
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("count"), F.desc("template_id")))
    best = found.withColumn("_n", place).where(F.col("_n") <= n).select("file", "_n", compact_template(F.col("template"), F.col("count")).alias("_line"))
    rows = best.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]).alias("_rows"))
    return rows.select("file", F.array_join(F.concat(F.array(F.concat(F.lit(f"TPLSET|fmt={FORMAT}|count="), F.size("_rows").cast("string"))), "_rows"), "\n").alias("summary"))
