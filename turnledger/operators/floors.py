"""Floors: incoming validation, keyed upsert, snapshot reconcile, active set.

A floor is one assistant message of a chat, a swipe an alternative version of it.
Stored variants: floor_id, chat_id, branch_id, message_index, swipe_id, body_fingerprint,
content, active, status, created_at, updated_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions.keys import fingerprint, floor_key
from turnledger.operators.bm25 import SCOPE
from turnledger.operators.ranking import latest_per_key, top_k
from turnledger.operators.skew import salted_join

VARIANT = [
    "floor_id",
    *SCOPE,
    "message_index",
    "swipe_id",
    "body_fingerprint",
    "content",
    "active",
    "status",
    "created_at",
    "updated_at",
]
LOCATOR = [*SCOPE, "message_index", "_swipe"]


def _swipe() -> Column:
    return F.coalesce(F.col("swipe_id"), F.lit(0))


def floor_violation() -> Column:
    """Why an incoming floor is rejected, null when it is fine."""
    return (
        F.when(F.col("chat_id").isNull() | (F.col("chat_id") == ""), "chat_id is required")
        .when(F.col("message_index").isNull() | (F.col("message_index") < 0), "message_index")
        .when(F.col("swipe_id") < 0, "swipe_id")
        .when(F.col("content").isNull() | (F.col("content") == ""), "content is required")
    )


def split_incoming(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conforming rows, rejects with a reason)."""
    marked = incoming.withColumn("reason", floor_violation())
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def with_keys(incoming: DataFrame) -> DataFrame:
    """Adds body_fingerprint and the content-addressed floor_id."""
    return incoming.withColumn("body_fingerprint", fingerprint(F.col("content"))).withColumn(
        "floor_id",
        floor_key(
            F.col("branch_id"),
            F.col("chat_id"),
            F.col("message_index"),
            F.col("swipe_id"),
            F.col("body_fingerprint"),
        ),
    )


def duplicate_locators(incoming: DataFrame) -> DataFrame:
    """Locators given more than once; their whole request is rejected."""
    return (
        incoming.groupBy(*SCOPE, "message_index", _swipe().alias("swipe_id"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )


def reject_duplicate_requests(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of clean requests, duplicate locators). A request is one scope's snapshot."""
    duplicates = duplicate_locators(incoming)
    bad = duplicates.select(*SCOPE).distinct()
    clean = salted_join(incoming, bad, SCOPE, [F.col("message_index")], "left_anti")
    return clean, duplicates


def upsert_floors(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Keyed upsert: an existing floor takes the new content, fingerprint, status and time
    but keeps its active flag and creation time; a new floor starts active."""
    fresh = latest_per_key(incoming, ["floor_id"], ["updated_at"])
    old = F.col("old.floor_id").isNotNull()
    new = F.col("new.floor_id").isNotNull()

    def pick(name: str, keep_old: bool = False) -> Column:
        first, second = ("old", "new") if keep_old else ("new", "old")
        base = F.when(old if first == "old" else new, F.col(f"{first}.{name}"))
        return base.otherwise(F.col(f"{second}.{name}")).alias(name)

    joined = stored.alias("old").join(
        fresh.alias("new"), F.col("old.floor_id") == F.col("new.floor_id"), "full_outer"
    )
    replaced = {"content", "body_fingerprint", "status", "updated_at"}
    columns = [
        F.when(old, F.col("old.active")).otherwise(F.lit(True)).alias("active")
        if name == "active"
        else pick(name, keep_old=name not in replaced)
        for name in VARIANT
    ]
    return joined.select(*columns)


def active_floors(variants: DataFrame, active: DataFrame) -> DataFrame:
    """The active variant of every message index, joined from the active set."""
    details = variants.select("floor_id", "swipe_id", "body_fingerprint", "content", "status")
    return active.select(*SCOPE, "message_index", "floor_id").join(details, "floor_id")


def locate(variants: DataFrame, locators: DataFrame, only_best: bool = False) -> DataFrame:
    """Variants at (index, swipe or 0): active ones first, then the newest. Adds ``rank``."""
    wanted = locators.select(*SCOPE, "message_index", _swipe().alias("_swipe")).distinct()
    found = variants.withColumn("_swipe", _swipe()).join(wanted, LOCATOR, "left_semi")
    order = [F.desc("active"), F.desc("updated_at"), F.asc("floor_id")]
    limit = 1 if only_best else (1 << 31) - 1
    return top_k(found, LOCATOR, order, limit).drop("_swipe")


def reconcile(stored: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Diff of full chat snapshots against the stored variants.

    ``incoming`` has one complete snapshot per scope (scope, message_index, swipe_id,
    content). The result is every stored and created variant with its next ``active`` and
    ``status`` and an ``outcome``:

    * ``reused``   – incoming and already stored; a stale one becomes pending again
    * ``created``  – incoming and new
    * ``replaced`` – the active variant whose locator now has other content: stale
    * ``removed``  – its message index is gone from the snapshot: stale
    * ``inactive`` – another variant of a message that is still there; status kept
    * ``untouched`` – its scope sent no snapshot

    All joins are on floor or message keys, which no chat can dominate; only the test
    "did this scope send a snapshot" is on the scope, and that side is salted.
    """
    given = with_keys(incoming).select(
        "floor_id", *SCOPE, "message_index", "swipe_id", "body_fingerprint", "content"
    )
    joined = stored.alias("s").join(
        given.alias("g"), F.col("s.floor_id") == F.col("g.floor_id"), "full_outer"
    )
    known, sent = F.col("s.floor_id").isNotNull(), F.col("g.floor_id").isNotNull()
    base = joined.select(
        *[
            F.coalesce(f"s.{c}", f"g.{c}").alias(c)
            for c in ["floor_id", *SCOPE, "message_index", "body_fingerprint", "content"]
        ],
        F.when(known, F.col("s.swipe_id")).otherwise(F.col("g.swipe_id")).alias("swipe_id"),
        F.col("s.active").alias("_active"),
        F.col("s.status").alias("_status"),
        F.col("s.created_at").alias("_created"),
        F.col("s.updated_at").alias("_updated"),
        F.when(known & sent, "reused").when(sent, "created").alias("outcome"),
    ).withColumn("_swipe", _swipe())

    created_at = base.filter("outcome = 'created'").select(*LOCATOR, F.lit(True).alias("_taken"))
    indexes = given.select(*SCOPE, "message_index", F.lit(True).alias("_index")).distinct()
    scopes = given.select(*SCOPE, F.lit(True).alias("_scope")).distinct()

    marked = base.join(created_at, LOCATOR, "left").join(indexes, [*SCOPE, "message_index"], "left")
    marked = salted_join(marked, scopes, SCOPE, [F.col("floor_id")], "left")
    outcome = (
        F.when(F.col("outcome").isNotNull(), F.col("outcome"))
        .when(F.col("_scope").isNull(), "untouched")
        .when(F.col("_index").isNull(), "removed")
        .when(F.col("_active") & F.col("_taken"), "replaced")
        .otherwise("inactive")
    )
    final = marked.withColumn("outcome", outcome)
    is_in = F.col("outcome").isin("reused", "created")
    return final.select(
        "floor_id",
        *SCOPE,
        "message_index",
        "swipe_id",
        "body_fingerprint",
        "content",
        F.when(F.col("outcome") == "untouched", F.col("_active")).otherwise(is_in).alias("active"),
        F.when(F.col("outcome") == "created", "pending")
        .when((F.col("outcome") == "reused") & (F.col("_status") == "stale"), "pending")
        .when(F.col("outcome").isin("replaced", "removed"), "stale")
        .otherwise(F.col("_status"))
        .alias("status"),
        F.coalesce("_created", now).alias("created_at"),
        F.when(F.col("outcome") == "untouched", F.col("_updated")).otherwise(now).alias("updated_at"),
        "outcome",
    )


def reconcile_counts(reconciled: DataFrame) -> DataFrame:
    """Sizes of the result lists per scope."""
    return reconciled.groupBy(*SCOPE).agg(
        F.count_if(F.col("active")).alias("active"),
        F.count_if(F.col("outcome") == "reused").alias("reused"),
        F.count_if(F.col("outcome") == "created").alias("created"),
        F.count_if(F.col("outcome").isin("replaced", "removed")).alias("stale"),
    )


def replace_active_set(active: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Next active set: scopes with a snapshot are replaced whole, others stay."""
    columns = [*SCOPE, "message_index", "floor_id"]
    sent = reconciled.filter("outcome in ('reused', 'created')").select(*columns)
    touched = reconciled.filter("outcome <> 'untouched'").select(*SCOPE).distinct()
    kept = salted_join(active.select(*columns), touched, SCOPE, [F.col("floor_id")], "left_anti")
    return kept.unionByName(sent)
