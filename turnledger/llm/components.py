"""Connected components of a link table, by label passing over written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.stages import written


def components(links: DataFrame) -> DataFrame:
    """(key, class) of every key in ``links`` (columns a, b): class is the component's smallest key.

    Each round a key takes the smallest label of its neighbours, then the label of its label,
    so a path of n keys needs about log n rounds. A round is written before the next reads
    it; only the count of changed labels comes back. Links are few keys wide, and the
    smallest label of a hub's neighbours is combined before the shuffle.
    """
    both = written(
        links.select(F.col("a").alias("key"), F.col("b").alias("other"))
        .unionByName(links.select(F.col("b").alias("key"), F.col("a").alias("other")))
        .distinct(),
        "links",
    )
    labels = written(
        both.groupBy("key").agg(F.min("other").alias("_m")).select("key", F.least("key", "_m").alias("class")), "labels"
    )
    # Only keys whose label changed tell their neighbours.
    changed = labels
    while True:
        near = both.join(changed.select(F.col("key").alias("other"), F.col("class").alias("_c")), "other")
        offered = near.groupBy("key").agg(F.min("_c").alias("_n"))
        # The label's own label: a label is always a key.
        jump = labels.select(F.col("key").alias("class"), F.col("class").alias("_j"))
        step = (
            labels.join(offered, "key", "left")
            .join(jump, "class")
            .select("key", F.col("class").alias("_old"), F.least("class", "_n", "_j").alias("class"))
        )
        done = written(step, "labels")
        labels, changed = done.select("key", "class"), done.filter("_old <> class").select("key", "class")
        if not changed.limit(1).count():
            return labels
