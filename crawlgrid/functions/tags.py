"""the tag rule between a spider (or job) and a node."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_match(spider_tags: Column, node_tags: Column) -> Column:
    """Both tag lists empty → match; exactly one empty → no match; otherwise
    every spider tag must be among the node's tags. NULL lists count as empty."""
    s = F.coalesce(spider_tags, F.array().cast("array<string>"))
    n = F.coalesce(node_tags, F.array().cast("array<string>"))
    return (F.when((F.size(s) == 0) & (F.size(n) == 0), F.lit(True))
            .when((F.size(s) == 0) | (F.size(n) == 0), F.lit(False))
            .otherwise(F.size(F.array_except(s, n)) == 0))
