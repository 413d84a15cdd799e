"""Template mining over growing logs: the parse tree of a stream and token count is kept between batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from kilnlog.functions.lines import content, tokens
from kilnlog.operators.templates import Tree
from kilnlog.profiles import MinerOptions

OUT = "file string, seq long, n_tokens int, cluster int, template_at_parse string"


class TemplateProcessor(StatefulProcessor):
    """Adds the lines of a batch, in the order of seq, to the tree that the earlier ones made."""

    def __init__(self, options: MinerOptions) -> None:
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tree", StructType([StructField("clusters", StringType()), StructField("hits", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        tree = Tree(self.options)
        if self.state.exists():
            clusters, shape = (json.loads(x) for x in self.state.get())
            tree.restore(clusters, shape)
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for seq, line in zip(pdf["seq"], pdf["words"], strict=True):
            c = tree.add(list(line))
            out.append((key[0], seq, key[1], c, " ".join(tree.clusters[c])))
        self.state.update((json.dumps(tree.clusters), json.dumps(tree.shape())))
        yield pd.DataFrame(out, columns=["file", "seq", "n_tokens", "cluster", "template_at_parse"])

    def close(self) -> None:
        pass


def stream_templates(lines: DataFrame, options: MinerOptions = MinerOptions()) -> DataFrame:  # noqa: B008
    """A stream (file, seq, n_tokens, cluster, template_at_parse) of a stream (file, seq, raw), of lines that aren't empty; needs the RocksDB state store."""
    own = tokens(content(F.col("raw")), options.delimiters)
    rows = lines.where(F.col("raw") != "").select("file", "seq", own.alias("words"), F.size(own).alias("n_tokens"))
    return rows.groupBy("file", "n_tokens").transformWithStateInPandas(TemplateProcessor(options), OUT, "Append", "None")
