"""Content keys: fingerprints, floor keys, JSON pointers, vector-space keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnledger.functions.text import trim_ws

# Versions that take part in dependency fingerprints.
PROTOCOL_VERSION = 1
SCHEMA_VERSION = 1

# Headers that only carry credentials.
CREDENTIAL_HEADERS = ["authorization", "proxy-authorization", "x-api-key", "api-key", "cookie"]


def fingerprint(col: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col, 256))


def dependency_fingerprint(
    body: Column,
    previous_state: Column,
    prompt_version: Column,
    protocol: int = PROTOCOL_VERSION,
    schema: int = SCHEMA_VERSION,
) -> Column:
    return fingerprint(
        F.concat_ws(
            "\n",
            body,
            F.coalesce(previous_state, F.lit("")),
            F.lit(str(protocol)),
            F.lit(str(schema)),
            prompt_version,
        )
    )


def floor_key(
    branch_id: Column, chat_id: Column, message_index: Column, swipe_id: Column, body: Column
) -> Column:
    return F.concat_ws(
        ":",
        branch_id,
        chat_id,
        message_index.cast("string"),
        F.coalesce(swipe_id, F.lit(0)).cast("string"),
        body,
    )


def escape_segment(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def unescape_segment(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def join_pointer(segments: Column) -> Column:
    """``[a, b/c]`` becomes ``/a/b~1c``; no segments give the empty root pointer."""
    return F.concat_ws(
        "", F.transform(segments, lambda s: F.concat(F.lit("/"), escape_segment(s)))
    )


def split_pointer(path: Column) -> Column:
    """Segments of a pointer, null when it does not start with a slash."""
    parts = F.split(path, "/", -1)
    tail = F.transform(F.slice(parts, 2, F.size(parts)), unescape_segment)
    return (
        F.when(path == "", F.array().cast("array<string>"))
        .when(path.startswith("/"), tail)
        .otherwise(F.lit(None).cast("array<string>"))
    )


def ancestors(path: Column, include_self: bool = False) -> Column:
    """Every pointer strictly above ``path`` (the root ``''`` first), optionally with itself."""
    parts = F.split(path, "/", -1)
    last = F.size(parts) if include_self else F.size(parts) - 1
    above = F.transform(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
        lambda n: F.array_join(F.slice(parts, 1, n), "/"),
    )
    only_self = F.array(F.lit("")) if include_self else F.array().cast("array<string>")
    return F.when(path == "", only_self).otherwise(above)


def vector_space_fingerprint(
    api_type: Column, base_url: Column, headers: Column, model: Column, raw_url: Column | None = None
) -> Column:
    """Key of the vector space a stored embedding belongs to.

    ``base_url`` must already be canonical (see ``functions.parse.canonical_base_url``);
    where it is null because the URL is not valid, the trimmed ``raw_url`` stands for it.
    Header names are trimmed, lower-cased and sorted; credential headers are left out.
    """
    entries = F.transform(
        F.map_entries(headers),
        lambda e: F.struct(F.lower(trim_ws(e["key"])).alias("name"), e["value"].alias("value")),
    )
    kept = F.array_sort(
        F.filter(
            entries, lambda e: (e["name"] != "") & ~e["name"].isin(CREDENTIAL_HEADERS)
        )
    )
    shape = F.struct(
        api_type.alias("apiType"),
        (base_url if raw_url is None else F.coalesce(base_url, trim_ws(raw_url))).alias("baseUrl"),
        F.coalesce(kept, F.array().cast("array<struct<name:string,value:string>>")).alias("headers"),
        model.alias("model"),
    )
    return fingerprint(F.to_json(shape))
