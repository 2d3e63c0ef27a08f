"""What changed between consecutive full snapshots of a table.

EXCEPT ALL in both directions removes what two snapshots share; the residues are joined by key and labelled. Both
directions come out of one aggregation: the distinct rows of the later snapshot count +1, those of the earlier one -1, and
a row's net count is what EXCEPT ALL leaves of it on either side.

The records travel twice. First as two hashes of their key (twelve bytes), to count the keys of each delivery; the
chance that two of a billion keys of a delivery share both is below one in ten billion. Then, with the snapshots they
belong to, once by sitemap and key: repeats, the net counts and the full join of the residues by key all keep to that
partitioning, so that they need no exchange of their own. Neither exchange is by delivery or by sitemap alone, so that
a large one is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many snapshots (32 bytes each) are sent to all executors; beyond, they are joined by delivery, where adaptive
#: execution splits the deliveries that are too large for a task.
MAX_BROADCAST = 500_000


def complete_deliveries(deliveries: DataFrame, records: DataFrame, key: str = "loc") -> DataFrame:
    """delivery_id, sitemap_id, snap_no, received_at of the deliveries that hold as many distinct keys as declared_rows."""
    keys = records.select("delivery_id", F.xxhash64(key).alias("_h"), F.hash(key).alias("_g")).distinct()
    held = keys.groupBy("delivery_id").agg(F.count(F.lit(1)).alias("_held"))
    rows = deliveries.select("delivery_id", "sitemap_id", "snap_no", "received_at", "declared_rows")
    rows = rows.where("delivery_id is not null and sitemap_id is not null and snap_no is not null")
    rows = rows.join(held, "delivery_id", "left").where(F.coalesce("_held", F.lit(0)) == F.col("declared_rows"))
    return rows.select("delivery_id", "sitemap_id", "snap_no", "received_at")


def consecutive(complete: DataFrame) -> DataFrame:
    """delivery_id, sitemap_id, later, earlier: the snap_no of the pairs in which each snapshot is the later, the earlier.

    later is null for the first snapshot of a sitemap. earlier is the snap_no of the next one, null for the last. Of
    several deliveries of one snapshot the last received counts (of equals the larger delivery_id)."""
    last = complete.groupBy("sitemap_id", "snap_no").agg(F.max_by("delivery_id", F.struct("received_at", "delivery_id")).alias("delivery_id"))
    order = Window.partitionBy("sitemap_id").orderBy("snap_no")
    ranked = last.select("*", F.lead("snap_no").over(order).alias("earlier"), F.lag("snap_no").over(order).alias("_before"))
    pairs = ranked.select("delivery_id", "sitemap_id", F.when(F.col("_before").isNotNull(), F.col("snap_no")).alias("later"), "earlier")
    return pairs.where("later is not null or earlier is not null")


def _signed() -> Column:
    return F.array(F.struct(F.col("later").alias("snap_no"), F.lit(1).alias("sign")), F.struct(F.col("earlier").alias("snap_no"), F.lit(-1).alias("sign")))


def snapshot_changes(deliveries: DataFrame, records: DataFrame, key: str = "loc", values: Sequence[str] = ("lastmod", "priority")) -> DataFrame:
    """sitemap_id, snap_no, key, change_kind (added, removed or changed) for each pair of consecutive snapshots.

    Null equals only null, NaN equals NaN. Repeated rows of a delivery count once; should a key have rows with different
    values in one delivery, all of them are its value: the key is changed unless both snapshots hold the same rows. Rows
    with a null key or without a delivery are no records. A delivery of nothing that declares nothing is an empty snapshot.
    Other columns, whatever their names, don't matter."""
    names = [f"_v{i}" for i in range(len(values))]
    rows = records.where(F.col(key).isNotNull() & F.col("delivery_id").isNotNull())
    sides = consecutive(complete_deliveries(deliveries, rows, key))
    few = deliveries.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    rows = rows.select("delivery_id", F.col(key).alias("_key"), *[F.col(c).alias(n) for c, n in zip(values, names, strict=True)])
    rows = rows.join(F.broadcast(sides) if few else sides, "delivery_id")
    # A key's rows in all snapshots of its sitemap, repeats dropped: gathered before the exchange already, so that the key
    # travels once a task. At most a row a snapshot (and value, where a delivery contradicts itself).
    held = rows.groupBy("sitemap_id", "_key").agg(F.collect_set(F.struct("later", "earlier", *names)).alias("_held"))
    signed = held.select("sitemap_id", "_key", F.inline("_held")).select("sitemap_id", "_key", *names, F.inline(_signed())).where("snap_no is not null")
    group = ["sitemap_id", "_key", "snap_no"]
    net = signed.groupBy(*group, *names).agg(F.max("sign").alias("_most"), F.min("sign").alias("_least"))  # their sum is the net count
    joined = net.groupBy(*group).agg((F.max("_most") > 0).alias("_later"), (F.min("_least") < 0).alias("_earlier"), F.max(F.col("_most") + F.col("_least") != 0).alias("_differs"))
    kind = F.when(~F.col("_earlier"), "added").when(~F.col("_later"), "removed").otherwise("changed")
    return joined.where("_differs").select("sitemap_id", "snap_no", F.col("_key").alias(key), kind.alias("change_kind"))
