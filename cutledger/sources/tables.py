"""Table rewrites: upsert, cascade delete, user erasure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutledger.sources.schemas import LINKS
from cutledger.sources.versioned import VersionedTable


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows replaced by the update row of the same key, new keys appended.

    ``updates`` must hold one row per key; applying it twice gives the same table.
    """
    return target.join(updates.select(*keys), keys, "left_anti").unionByName(updates.select(target.columns))


def write_upsert(path: str, updates: DataFrame, keys: list[str]) -> None:
    """Upsert into the versioned table at ``path``, rewriting only the partitions the updates touch.

    Replacement rows must stay in the partition of the row they replace. The new version counts as a whole or not at all.
    """
    VersionedTable(updates.sparkSession, path).upsert(updates, keys)


def cascade_delete(tables: dict[str, DataFrame], parent: str, parent_ids: DataFrame) -> dict[str, DataFrame]:
    """Remove the chosen parents and, level by level, every row that links to a removed one.

    ``parent_ids`` has one column ``id``. Only tables present in ``tables`` are followed.
    """
    gone = {parent: parent_ids.select("id").distinct()}
    out = dict(tables)
    queue = [parent]
    while queue:
        top = queue.pop(0)
        for child, column, owner in LINKS:
            if owner != top or child not in out:
                continue
            dead = gone[top].select(F.col("id").alias(column))
            if any(o == child and c in out for c, _, o in LINKS):
                lost = tables[child].join(dead, column, "left_semi").select("id")
                gone[child] = gone[child].unionByName(lost).distinct() if child in gone else lost
                queue.append(child)
            out[child] = out[child].join(dead, column, "left_anti")
    out[parent] = out[parent].join(gone[parent], "id", "left_anti")
    return {name: out[name].select(tables[name].columns) for name in tables}


DROPPED_WITH_USER = ["payments", "subscriptions", "download_grants"]
UNLINKED_FROM_USER = ["user_events", "feedbacks"]


def erase_users(tables: dict[str, DataFrame], user_ids: DataFrame) -> dict[str, DataFrame]:
    """Drop the users' payments, plans and grants; keep their events and feedback without the link."""
    ids = user_ids.select(F.col("id").alias("user_id")).distinct()
    out = {}
    for name, df in tables.items():
        if name == "users":
            out[name] = df.join(ids.withColumnRenamed("user_id", "id"), "id", "left_anti")
        elif name in DROPPED_WITH_USER:
            out[name] = df.join(ids, "user_id", "left_anti").select(df.columns)
        elif name in UNLINKED_FROM_USER:
            marked = df.join(ids.withColumn("_gone", F.lit(True)), "user_id", "left")
            kept = F.when(F.col("_gone").isNull(), F.col("user_id"))
            out[name] = marked.withColumn("user_id", kept).select(df.columns)
        else:
            out[name] = df
    return out
