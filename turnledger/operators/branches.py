"""Branches of chats: forks, activation, host bindings, the default branch.

``branches``: branch_id, chat_id, parent_branch_id, fork_floor_id, active, created_at.
``bindings``: host_chat_id, branch_id, parent_host_chat_id, main_chat_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions.keys import fingerprint, floor_key
from turnledger.operators.bm25 import SCOPE
from turnledger.operators.floors import VARIANT
from turnledger.operators.skew import salted_join


def default_branch(chat_id: Column, active_branch_id: Column) -> Column:
    return F.coalesce(active_branch_id, F.concat(F.lit("main:"), chat_id))


def resolve_branches(requests: DataFrame, chats: DataFrame) -> DataFrame:
    """Branch of each request: the one it names, else the chat's active, else the default."""
    known = chats.select("chat_id", F.col("active_branch_id").alias("_active"))
    joined = salted_join(requests, known, ["chat_id"], [F.xxhash64(*requests.columns)], "left")
    resolved = F.coalesce("branch_id", default_branch(F.col("chat_id"), F.col("_active")))
    return joined.withColumn("branch_id", resolved).drop("_active")


def check_forks(forks: DataFrame, variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid forks with ``fork_index``, rejects).

    ``forks``: chat_id, source_branch_id, fork_floor_id, branch_id (the new branch). The
    fork floor has to belong to the source branch of the same chat.
    """
    floors = variants.select(
        F.col("floor_id").alias("fork_floor_id"),
        "chat_id",
        F.col("branch_id").alias("source_branch_id"),
        F.col("message_index").alias("fork_index"),
    )
    joined = forks.join(floors, ["fork_floor_id", "chat_id", "source_branch_id"], "left")
    rejects = joined.filter("fork_index is null").drop("fork_index")
    return joined.filter("fork_index is not null"), rejects.withColumn(
        "reason", F.lit("fork floor must belong to the source branch")
    )


def _rekey() -> Column:
    return floor_key(
        F.col("branch_id"),
        F.col("chat_id"),
        F.col("message_index"),
        F.col("swipe_id"),
        F.col("body_fingerprint"),
    )


def fork_variants(forks: DataFrame, variants: DataFrame) -> DataFrame:
    """Copies of every variant up to the fork index under the new branch.

    Floors are matched to forks by source scope with the floors salted, so one long chat
    is copied by many tasks.
    """
    plan = forks.select("chat_id", "source_branch_id", "branch_id", "fork_index")
    source = variants.withColumnRenamed("branch_id", "source_branch_id")
    copied = salted_join(source, plan, ["chat_id", "source_branch_id"], [F.col("floor_id")]).filter(
        F.col("message_index") <= F.col("fork_index")
    )
    return copied.withColumn("floor_id", _rekey()).select(*VARIANT)


def add_forked(variants: DataFrame, copies: DataFrame) -> DataFrame:
    """Stored variants plus the copies; a floor that already exists is left as it is."""
    fresh = copies.dropDuplicates(["floor_id"]).join(
        variants.select("floor_id"), "floor_id", "left_anti"
    )
    return variants.select(*VARIANT).unionByName(fresh.select(*VARIANT))


def fork_active_set(forks: DataFrame, active: DataFrame, variants: DataFrame) -> DataFrame:
    """Active set of the new branches: the source's active floors up to the fork index."""
    plan = forks.select("chat_id", "source_branch_id", "branch_id", "fork_index")
    details = variants.select("floor_id", "swipe_id", "body_fingerprint")
    source = (
        active.select(*SCOPE, "message_index", "floor_id")
        .join(details, "floor_id")
        .withColumnRenamed("branch_id", "source_branch_id")
    )
    copied = salted_join(source, plan, ["chat_id", "source_branch_id"], [F.col("floor_id")]).filter(
        F.col("message_index") <= F.col("fork_index")
    )
    return copied.withColumn("floor_id", _rekey()).select(*SCOPE, "message_index", "floor_id")


def activate_branches(branches: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(branches with exactly one active per requested chat, rejected requests)."""
    target = requests.select("chat_id", "branch_id")
    ids = branches.select(F.col("branch_id").alias("_known")).distinct()
    valid = target.join(ids, F.col("branch_id") == F.col("_known"), "left_semi")
    rejects = target.join(ids, F.col("branch_id") == F.col("_known"), "left_anti").withColumn(
        "reason", F.lit("branch does not exist")
    )
    chosen = valid.select("chat_id", F.col("branch_id").alias("_target"))
    updated = salted_join(branches, chosen, ["chat_id"], [F.col("branch_id")], "left").withColumn(
        "active",
        F.when(F.col("_target").isNull(), F.col("active")).otherwise(
            F.col("branch_id") == F.col("_target")
        ),
    )
    return updated.drop("_target"), rejects


def active_floor_rows(branches: DataFrame, active: DataFrame) -> DataFrame:
    """Active floors of active branches, one row each, to be read in message order."""
    current = branches.filter("active").select(*SCOPE)
    return salted_join(
        active.select(*SCOPE, "message_index", "floor_id"), current, SCOPE, [F.col("floor_id")]
    )


def bind_host_chats(
    requests: DataFrame, bindings: DataFrame, chats: DataFrame, variants: DataFrame
) -> DataFrame:
    """Outcome of binding host chats to branches, one row per request.

    ``requests``: host_chat_id, main_chat_id (null for a root chat), fork_index,
    fork_swipe_id, fork_content, new_branch_id. A bound chat keeps its branch. A root chat
    takes its active or default branch. A child forks its parent's branch at the floor with
    the same index, swipe (null matches null only) and content; nothing is copied yet.
    """
    bound = bindings.select("host_chat_id", F.col("branch_id").alias("_bound"))
    parent = bindings.select(
        F.col("host_chat_id").alias("main_chat_id"), F.col("branch_id").alias("_parent")
    )
    roots = chats.select(F.col("chat_id").alias("_chat"), F.col("active_branch_id").alias("_active"))
    chat = F.coalesce("main_chat_id", "host_chat_id")
    spread = [F.col("host_chat_id")]
    joined = requests.join(bound, "host_chat_id", "left")
    joined = salted_join(joined, parent, ["main_chat_id"], spread, "left")
    joined = salted_join(joined.withColumn("_chat", chat), roots, ["_chat"], spread, "left")
    source = F.coalesce("_parent", default_branch(F.col("_chat"), F.col("_active")))
    wanted = joined.withColumn("_source", source).withColumn(
        "_body", fingerprint(F.col("fork_content"))
    )
    floors = variants.select(
        F.col("floor_id").alias("_fork"),
        F.col("chat_id").alias("_fc"),
        F.col("branch_id").alias("_fb"),
        F.col("message_index").alias("_fi"),
        F.col("swipe_id").alias("_fs"),
        F.col("body_fingerprint").alias("_ff"),
    )
    same = (
        (F.col("main_chat_id") == F.col("_fc"))
        & (F.col("_source") == F.col("_fb"))
        & (F.col("fork_index") == F.col("_fi"))
        & F.col("fork_swipe_id").eqNullSafe(F.col("_fs"))
        & (F.col("_body") == F.col("_ff"))
    )
    matched = wanted.join(floors, same, "left")
    child = F.col("main_chat_id").isNotNull()
    outcome = (
        F.when(F.col("_bound").isNotNull(), "already_bound")
        .when(~child, "root")
        .when(F.col("fork_index").isNull(), "fork_missing")
        .when(F.col("_fork").isNull(), "fork_not_in_parent")
        .otherwise("forked")
    )
    branch = (
        F.when(F.col("outcome") == "already_bound", F.col("_bound"))
        .when(F.col("outcome") == "root", F.col("_source"))
        .when(F.col("outcome") == "forked", F.col("new_branch_id"))
    )
    return matched.withColumn("outcome", outcome).select(
        "host_chat_id",
        "main_chat_id",
        "outcome",
        branch.alias("branch_id"),
        F.when(F.col("outcome") == "forked", F.col("_source")).alias("parent_branch_id"),
        F.when(F.col("outcome") == "forked", F.col("_fork")).alias("fork_floor_id"),
    )
