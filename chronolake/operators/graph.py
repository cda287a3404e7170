"""Ancestors in a graph of features or places."""

from __future__ import annotations

from pyspark.sql import DataFrame


def ancestors(edges: DataFrame) -> DataFrame:
    """node and every ancestor of it, once. ``edges``: child, parent, without cycles."""
    return edges.sparkSession.sql(
        """with recursive up(node, ancestor) as (select child, parent from {e} union all select u.node, e.parent from up u join {e} e on e.child = u.ancestor)
select distinct node, ancestor from up""",
        e=edges,
    )
