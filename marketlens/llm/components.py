"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows of a written table's file, about.
FILE_ROWS = 250_000


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every id in ``links`` (a, b); nulls are skipped.

    Each round every id takes the smallest component among its neighbours', then that id's own
    component in turn, so paths halve. Rounds end when nothing changes; each is written to a table.
    Minima are combined before the shuffle, and joins on a much-linked id are ordinary joins that
    adaptive execution can split. An id with a link to itself alone is its own component.
    """
    links = links.where("a is not null and b is not null")
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    # a table of so many rows needs no more tasks than this to be written; small ones need one
    files = max(1, -(-both.count() // FILE_ROWS))
    found = written(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component")).coalesce(files))
    while True:
        near = (both.join(found, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("near")))
        lower = found.join(near, F.col("id") == F.col("a")).select("id", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        # an id's component is an id of the same group, so its own component may be lower still
        jump = found.select(F.col("id").alias("_at"), F.col("component").alias("_further"))
        step = written(lower.join(jump, F.col("now") == F.col("_at")).select("id", "was", F.least("now", "_further").alias("component")).coalesce(files))
        found = step.select("id", "component")
        if not step.where("component < was").limit(1).count():
            return found
