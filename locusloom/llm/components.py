"""Connected components of a table of links, as a distributed union-find.

Links are first thinned by a union-find over each bounded batch of a partition: a batch leaves one link per
node to the least node of its group. Then rounds of hooking every node to its least neighbour and contracting
the links run on tables until no link is left. Nothing is collected; every round is written to the shared
folder, so that a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.llm.common import stage


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch of links as links from a node to the least node of its group."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        pairs = [(find(x), x) for x in parent]
        made = np.array([p for p in pairs if p[0] != p[1]], dtype=np.int64).reshape(-1, 2)
        yield pd.DataFrame({"a": made[:, 0], "b": made[:, 1]})


def components(links: DataFrame) -> DataFrame:
    """(a, b) links between whole numbers -> (node, root): root is the least node that can be reached.

    Only nodes that have a link come out. Repeated links, both directions and loops are allowed.
    """
    links = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).filter("a <> b")
    links = stage(links.mapInPandas(_forest, "a bigint, b bigint").distinct(), "links")
    found = None
    while not links.isEmpty():
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up"))
        hook = stage(hook, "hook")
        up2 = hook.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        jump = stage(hook.join(up2, "up").select("node", F.col("up2").alias("root")), "jump")
        if found is None:
            found = jump
        else:
            nxt = jump.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = found.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            found = stage(found, "found")
        ends = jump.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        links = links.join(ends, "a").join(ends.toDF("b", "rb"), "b").filter("ra <> rb")
        links = stage(links.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    return found if found is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
