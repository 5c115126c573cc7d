"""Merging analysis candidates into states: identities, patches, locks, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions.keys import join_pointer, split_pointer
from turnledger.functions.text import non_blank, trim_ws
from turnledger.operators.bm25 import SCOPE
from turnledger.operators.quality import locked_writes
from turnledger.operators.skew import salted_join

# How many distinct sources a record remembers unless the caller says otherwise.
DEFAULT_SOURCES = 50


def _key(name: Column) -> Column:
    return F.lower(trim_ws(name))


def alias_table(known: DataFrame) -> DataFrame:
    """(scope, key, character_id): every id, name and alias, folded; the first character wins.

    ``known``: scope, character_id, canonical_name, aliases, ordinal.
    """
    names = F.concat(F.array("character_id", "canonical_name"), F.col("aliases"))
    return (
        known.select(*SCOPE, "character_id", "ordinal", F.explode(names).alias("_n"))
        .filter("_n is not null")
        .groupBy(*SCOPE, _key(F.col("_n")).alias("key"))
        .agg(F.min_by("character_id", "ordinal").alias("character_id"))
    )


def resolve_identities(mentions: DataFrame, known: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``character_id``: the known character a raw mention means, else the trimmed mention."""
    keyed = mentions.withColumn("key", _key(F.col(raw)))
    found = salted_join(keyed, alias_table(known), [*SCOPE, "key"], [F.xxhash64(*mentions.columns)], "left")
    return found.withColumn(
        "character_id", trim_ws(F.coalesce("character_id", F.col(raw)))
    ).drop("key")


def _unquote(value: Column) -> Column:
    return F.when(
        value.startswith('"'),
        F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0],
    )


def known_characters(rows: DataFrame) -> DataFrame:
    """Characters of state rows: the profiles, then ids that only have a trace."""
    parts = split_pointer(F.col("path"))
    head, who, field = F.get(parts, 0), F.get(parts, 1), F.get(parts, 2)
    split = rows.select(*SCOPE, head.alias("_h"), who.alias("character_id"), field.alias("_f"), "value", F.size(parts).alias("_n"))
    entities = split.filter("_h in ('profiles', 'traces') and character_id is not null")
    direct = F.col("_n") == 3
    people = entities.groupBy(*SCOPE, "character_id").agg(
        F.max(F.col("_h") == "profiles").alias("_profile"),
        F.max(F.when((F.col("_h") == "profiles") & direct & (F.col("_f") == "canonicalName"), F.col("value"))).alias("_name"),
        F.max(F.when((F.col("_h") == "profiles") & direct & (F.col("_f") == "aliases"), F.col("value"))).alias("_aliases"),
    )
    none = F.array().cast("array<string>")
    return people.select(
        *SCOPE,
        "character_id",
        F.coalesce(_unquote(F.col("_name")), F.col("character_id")).alias("canonical_name"),
        F.coalesce(F.from_json("_aliases", "array<string>"), none).alias("aliases"),
        F.col("_profile").alias("has_profile"),
    )


def locked_paths(rows: DataFrame) -> DataFrame:
    """Locks of state rows as ``profiles.<id>.<path>``."""
    parts = split_pointer(F.col("path"))
    lists = rows.filter(F.col("path").rlike("^/profiles/[^/]+/lockedPaths$"))
    return lists.select(
        *SCOPE, F.get(parts, 1).alias("_id"), F.explode(F.from_json("value", "array<string>")).alias("_p")
    ).select(*SCOPE, F.concat_ws(".", F.lit("profiles"), "_id", "_p").alias("locked_path"))


def normalize_patch(rows: DataFrame) -> DataFrame:
    """Patch rows that say something: no nulls, no blank strings, lists trimmed and distinct.

    ``rows``: scope, seq, path, value (JSON text; arrays whole). A null affinity is a value.
    """
    text = _unquote(F.col("value"))
    items = F.from_json("value", "array<string>")
    clean = F.array_distinct(F.filter(F.transform(items, trim_ws), lambda x: x != ""))
    is_list = F.col("value").startswith("[")
    plain_list = is_list & ~F.col("value").contains("{")
    keeps_null = F.col("path").rlike("/affinity/(inner|outer)$")
    quoted = F.regexp_replace(F.to_json(F.array(trim_ws(text))), r"^\[|\]$", "")
    value = (
        F.when(plain_list, F.to_json(clean))
        .when(F.col("value").startswith('"'), F.when(non_blank(text).isNotNull(), quoted))
        .when((F.col("value") == "null") & ~keeps_null, F.lit(None))
        .otherwise(F.col("value"))
    )
    return rows.withColumn("value", value).filter("value is not null")


def merge_patches(base: DataFrame, patches: DataFrame) -> DataFrame:
    """State leaves after all patches: per path the last patch that says something wins.

    ``base``: scope, path, value. Characters a patch mentions for the first time also get a
    profile named after their id. Adds ``source_seq``, null where the base value stands.
    """
    said = normalize_patch(patches).select(*SCOPE, "seq", "path", "value")
    parts = split_pointer(F.col("path"))
    ids = F.get(parts, 1)
    mentioned = (
        said.filter(F.get(parts, 0).isin("profiles", "traces"))
        .groupBy(*SCOPE, ids.alias("character_id"))
        .agg(F.min("seq").alias("seq"))
    )
    have = base.filter(F.get(parts, 0) == "profiles").select(*SCOPE, ids.alias("character_id")).distinct()
    quoted = F.regexp_replace(F.to_json(F.array("character_id")), r"^\[|\]$", "")
    stubs = (
        mentioned.join(have, [*SCOPE, "character_id"], "left_anti")
        .select(
            *SCOPE,
            (F.col("seq") - F.lit(0.5)).alias("seq"),
            join_pointer(F.array(F.lit("profiles"), "character_id", F.lit("canonicalName"))).alias("path"),
            quoted.alias("value"),
        )
    )
    ground = base.select(*SCOPE, F.lit(None).cast("double").alias("seq"), "path", "value")
    everything = (
        said.withColumn("seq", F.col("seq").cast("double")).unionByName(stubs).unionByName(ground)
    )
    order = F.coalesce("seq", F.lit(float("-inf")))
    return everything.groupBy(*SCOPE, "path").agg(
        F.max_by("value", order).alias("value"),
        F.ceil(F.max("seq")).cast("long").alias("source_seq"),
    )


def patch_log(patches: DataFrame) -> DataFrame:
    """Leaf log of patches (scope, seq, path, value): what they say, and a profile named after
    its id where a character is mentioned for the first time."""
    said = normalize_patch(patches).select(*SCOPE, "seq", "path", "value")
    parts = split_pointer(F.col("path"))
    first = (
        said.filter(F.get(parts, 0).isin("profiles", "traces"))
        .groupBy(*SCOPE, F.get(parts, 1).alias("_id"))
        .agg(F.min("seq").alias("seq"))
    )
    stubs = first.select(
        *SCOPE,
        "seq",
        join_pointer(F.array(F.lit("profiles"), "_id", F.lit("canonicalName"))).alias("path"),
        F.regexp_replace(F.to_json(F.array("_id")), r"^\[|\]$", "").alias("value"),
    )
    unnamed = stubs.join(said.select(*SCOPE, "seq", "path"), [*SCOPE, "seq", "path"], "left_anti")
    return said.unionByName(unnamed)


def enforce_locks(
    patches: DataFrame, locks: DataFrame, keys: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(patch rows of accepted candidates, rejected candidates).

    ``keys`` identify a candidate. One write that touches a lock rejects all of it.
    """
    hits = locked_writes(patches, locks, keys)
    rejected = hits.groupBy(*keys).agg(F.min("path").alias("path"))
    return patches.join(rejected.select(*keys), keys, "left_anti"), rejected


def merge_collection(
    previous: DataFrame, incoming: DataFrame, keys: list[str], max_sources: int | None = DEFAULT_SOURCES
) -> DataFrame:
    """Story items with provenance: equal content keeps its sources, other items add this one.

    ``previous``: keys, id, content, source_ids; ``incoming``: keys, id, content, source_id.
    The list keeps the last ``max_sources`` distinct sources; None keeps all.
    """
    before = previous.select(
        *keys, "id", F.col("content").alias("_content"), F.col("source_ids").alias("_ids")
    )
    joined = incoming.join(before, [*keys, "id"], "left")
    empty = F.array().cast("array<string>")
    old = F.coalesce("_ids", empty)
    pushed = F.array_append(F.array_remove(old, F.col("source_id")), F.col("source_id"))
    bounded = pushed
    if max_sources is not None:
        bounded = F.when(F.size(pushed) > max_sources, F.slice(pushed, -max_sources, max_sources)).otherwise(pushed)
    return joined.select(
        *keys,
        "id",
        "content",
        F.when(F.col("_content").eqNullSafe(F.col("content")), old).otherwise(bounded).alias("source_ids"),
    )

