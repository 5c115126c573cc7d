"""State as an event log: flattened documents, versions, snapshots, diffs, fingerprints.

A log row is ``scope, seq, op, path, kind, value``: at ``seq`` the pointer ``path`` was
set to a value (JSON text), to an object (``kind='object'``, its members follow as rows of
the same seq) or removed. Arrays are values. A row is alive while nothing newer touched
its own path or any path above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from turnledger.functions.json_tree import tree_changes, tree_rows
from turnledger.functions.keys import ancestors, escape_segment, split_pointer
from turnledger.operators.bm25 import SCOPE, staged
from turnledger.operators.skew import (
    DEFAULT_BLOCK,
    last_before,
    last_known,
    ordinal,
    previous_row,
    running_xor,
    salted_join,
)

# Members that record bookkeeping, not story state.
VOLATILE = ["updatedAt", "source", "sourceFloorIds", "sourceHostChatIds"]
DEFAULT_CHECKPOINT_INTERVAL = 20
#: Documents nested up to this are opened by Generates, which copy every row once a level; and
#: rows that a task holds of the others.
NATIVE_DEPTH, ROWS_OUT = 0, 10_000
#: Points of a log, or of a segment of it, that meet the same versions.
POINTS = 128
_WORDS = ["_w0", "_w1", "_w2", "_w3"]
EMPTY_FINGERPRINT = "sha256:" + hashlib.sha256(b"0:0:0:0").hexdigest()


# ---------------------------------------------------------------- documents and rows


def flatten_documents(
    docs: DataFrame,
    keys: list[str],
    column: str,
    max_depth: int | None = None,
    expand_arrays: bool = False,
) -> DataFrame:
    """One row ``(keys, path, kind, value)`` per member of a JSON document column.

    Objects give a container row and their members. Arrays, scalars and whatever lies
    below ``max_depth`` are values kept as JSON text with sorted keys; with
    ``expand_arrays`` arrays are containers too, their members numbered from 0. Without
    ``max_depth`` documents are opened to the bottom in one pass over their text (those nested
    up to ``NATIVE_DEPTH`` by one Generate a level), so a deep document slows no other and the
    plan does not follow the deepest.
    """
    if max_depth is None:
        deep = _nested_beyond(F.col(column), NATIVE_DEPTH) if NATIVE_DEPTH else F.lit(True)
        texts = docs.filter(deep).select(*keys, canonical_json(F.col(column)).alias("_text"))
        opened = _by_rows(texts, keys, ["_text"], _ROW_FIELDS, lambda text: tree_rows(text, expand_arrays))
        if not NATIVE_DEPTH:
            return opened
        return flatten_documents(docs.filter(~deep), keys, column, NATIVE_DEPTH, expand_arrays).unionByName(opened)
    rows = docs.select(
        *keys,
        F.lit("").alias("path"),
        F.try_parse_json(column).alias("_v"),
        F.lit(0).alias("_d"),
    ).filter("_v is not null")
    itself = F.array(F.struct("path", "_v", "_d"))
    nothing = F.filter(itself, lambda _: F.lit(False))
    for depth in range(max_depth):
        named = F.map_entries(_members(F.col("_v")))
        children = F.coalesce(_children(named, depth), nothing)
        if expand_arrays:
            numbered = F.transform(
                _elements(F.col("_v")),
                lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value")),
            )
            children = F.coalesce(_children(named, depth), _children(numbered, depth), nothing)
        grown = F.concat(itself, F.when(F.col("_d") == depth, children).otherwise(nothing))
        rows = rows.select(*keys, F.explode(grown).alias("_r")).select(
            *keys, "_r.path", "_r._v", "_r._d"
        )
    open_ = F.col("_d") < max_depth
    kind = F.when(open_ & _members(F.col("_v")).isNotNull(), "object")
    if expand_arrays:
        kind = kind.when(open_ & _elements(F.col("_v")).isNotNull(), "array")
    return rows.withColumn("kind", kind.otherwise("value")).select(
        *keys,
        "path",
        "kind",
        F.when(F.col("kind") == "value", F.to_json("_v")).alias("value"),
    )


def open_documents(docs: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``flatten_documents`` to the bottom, arrays as containers, with ``members``: the escaped
    names of an object's members, joined by ``/``. What is not JSON is one row without kind."""
    texts = docs.select(*keys, canonical_json(F.col(column)).alias("_text"))
    return _by_rows(texts, keys, ["_text"], [*_ROW_FIELDS, "members"], lambda text: tree_rows(text, True, True), (("", None, None, None),))


_ROW_FIELDS = ["path", "kind", "value"]
_CHANGE_FIELDS = ["op", "path", "old_kind", "old_value", "new_kind", "new_value"]


def _by_rows(texts: DataFrame, keys: list[str], columns: list[str], fields: list[str], open_, nothing: tuple = ()) -> DataFrame:
    """Rows ``(keys, fields)`` that ``open_`` gives for the ``columns`` of each row; those whose
    columns are all null give ``nothing``."""
    # Nulls are left out by the tasks: a filter would be pushed below the dealing of a small file.
    given = texts.select(*keys, *columns)
    schema = StructType([*given.select(*keys).schema.fields, *[StructField(f, StringType()) for f in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, found = [], []

            def made(batch=batch):
                heads = batch.select(keys).take(pa.array(source, pa.int64())) if keys else None
                arrays = [*(heads.columns if keys else []), *(pa.array(v, pa.string()) for v in zip(*found))]
                return pa.RecordBatch.from_arrays(arrays, [*keys, *fields])

            for at, row in enumerate(zip(*(batch.column(c).to_pylist() for c in columns))):
                for out in nothing if row.count(None) == len(row) else open_(*row):
                    source.append(at)
                    found.append(out)
                    if len(found) == ROWS_OUT:
                        yield made()
                        source, found = [], []
            if found:
                yield made()

    return given.mapInArrow(run, schema)


def diff_texts(pairs: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Topmost changes between two JSON columns of a row, as ``diff_documents`` lists them.

    Pairs with equal canonical texts go first; of the others, containers get digests from the
    bottom up and only those that differ are opened. A null or unreadable document is absent.
    No document is written out as rows, nothing is shuffled, and any depth has the same plan.
    """
    texts = pairs.select(*keys, canonical_json(F.col(before)).alias("_old"), canonical_json(F.col(after)).alias("_new"))
    return _by_rows(texts.filter(~F.col("_old").eqNullSafe(F.col("_new"))), keys, ["_old", "_new"], _CHANGE_FIELDS, tree_changes)


def _nested_beyond(text: Column, levels: int) -> Column:
    """Whether brackets outside of strings nest deeper than ``levels``: each pass closes the innermost."""
    marks = F.regexp_replace(F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', ""), r"[^\[\]{}]+", "")
    for _ in range(levels):
        marks = F.regexp_replace(marks, r"\{\}|\[\]", "")
    return F.coalesce(marks != "", F.lit(False))


def _members(value: Column) -> Column:
    return value.try_cast("map<string,variant>")


def _elements(value: Column) -> Column:
    return value.try_cast("array<variant>")


def _children(entries: Column, depth: int) -> Column:
    return F.transform(
        entries,
        lambda e: F.struct(
            F.concat(F.col("path"), F.lit("/"), escape_segment(e["key"])).alias("path"),
            e["value"].alias("_v"),
            F.lit(depth + 1).alias("_d"),
        ),
    )


def is_volatile(path: Column) -> Column:
    return F.arrays_overlap(split_pointer(path), F.array(*[F.lit(v) for v in VOLATILE]))


_TOKEN = r'"(?:[^"\\]|\\.)*"|[\[\]{}:,]|[^\[\]{}:,"\s]+'


def _without_volatile(text: Column) -> Column:
    """JSON text without the volatile members of its objects, at any depth.

    One pass over the text's tokens. ``open``: the brackets still open, an object that has
    kept a member as ``o``; ``skip``: how many were open where a member is left out, 0 outside
    of one; ``key``: whether a string would be a member's name.
    """
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("open"), F.lit(0).alias("skip"), F.lit(False).alias("key"))

    def step(s: Column, t: Column) -> Column:
        depth, top = F.length(s["open"]), F.right(s["open"], F.lit(1))
        shorter = F.substring(s["open"], F.lit(1), depth - 1)
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        skipped = s["skip"] > 0
        ends = skipped & (depth == s["skip"]) & (closes | (t == ","))  # of the member left out
        passed = skipped & ~ends
        name = s["key"] & t.startswith('"')
        dropped = name & t.isin(*[f'"{v}"' for v in VOLATILE])
        shown = (
            F.when(passed | dropped, "")
            .when((t == ",") & (top != "["), "")
            .when(name & (top == "o"), F.concat(F.lit(","), t))
            .otherwise(t)
        )
        open_ = (
            F.when(opens, F.concat(s["open"], t))
            .when(closes, shorter)
            .when(name & ~dropped & ~passed, F.concat(shorter, F.lit("o")))
            .otherwise(s["open"])
        )
        skip = F.when(passed, s["skip"]).when(dropped, depth).otherwise(0)
        key = F.when(passed, False).otherwise((t == "{") | ((t == ",") & (top != "[")))
        return F.struct(F.concat(s["out"], shown).alias("out"), open_.alias("open"), skip.alias("skip"), key.alias("key"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), start, step, lambda s: s["out"])


def stable_value(value: Column) -> Column:
    """An array value without the volatile members of all objects in it."""
    named = value.startswith("[") & value.rlike('"(%s)"' % "|".join(VOLATILE))
    return F.when(named, _without_volatile(value)).otherwise(value)


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and no spacing; null when it does not parse."""
    return F.to_json(F.try_parse_json(text))


def _row_words(path: Column, kind: Column, value: Column) -> list[Column]:
    digest = F.sha2(F.concat_ws("\n", path, kind, F.coalesce(value, F.lit(""))), 256)
    return [
        F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("long").alias(w)
        for i, w in enumerate(_WORDS)
    ]


def _fingerprint_of_words() -> Column:
    return F.concat(
        F.lit("sha256:"), F.sha2(F.concat_ws(":", *[F.col(w).cast("string") for w in _WORDS]), 256)
    )


def state_fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Semantic fingerprint per document of its rows, volatile members left out, also those
    of objects inside arrays.

    The XOR of the hashes of all non-volatile rows: order-free, so it is combined before
    the shuffle and no document is ever gathered in one place.
    """
    volatile = is_volatile(F.col("path"))
    words = rows.select(
        *keys,
        volatile.alias("_volatile"),
        *_row_words(F.col("path"), F.col("kind"), stable_value(F.col("value"))),
    )
    # A document of volatile rows only has the fingerprint of the empty state.
    folded = words.groupBy(*keys).agg(
        *[F.bit_xor(F.when(F.col("_volatile"), 0).otherwise(F.col(w))).alias(w) for w in _WORDS]
    )
    return folded.select(*keys, _fingerprint_of_words().alias("state_fingerprint"))


def diff_documents(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Topmost changes that turn one set of document rows into another.

    add / remove / replace per path; below an added, removed or replaced path nothing is
    listed again.
    """
    left = before.select(*keys, "path", F.col("kind").alias("old_kind"), F.col("value").alias("old_value"))
    right = after.select(*keys, "path", F.col("kind").alias("new_kind"), F.col("value").alias("new_value"))
    both = left.join(right, [*keys, "path"], "full_outer")
    same_object = (F.col("old_kind") == "object") & (F.col("new_kind") == "object")
    op = (
        F.when(F.col("old_kind").isNull(), "add")
        .when(F.col("new_kind").isNull(), "remove")
        .when(same_object, F.lit(None))
        .when(
            (F.col("old_kind") != F.col("new_kind"))
            | ~F.col("old_value").eqNullSafe(F.col("new_value")),
            "replace",
        )
    )
    changed = both.withColumn("op", op).filter("op is not null")
    # Only a path that had or has members can cover another change.
    covering = changed.filter("old_kind = 'object' or new_kind = 'object'").select(
        *keys, F.col("path").alias("_above")
    )
    probes = changed.select(*keys, "path", F.explode(ancestors(F.col("path"))).alias("_above"))
    covered = probes.join(covering, [*keys, "_above"], "left_semi").select(*keys, "path").distinct()
    return changed.join(covered, [*keys, "path"], "left_anti").select(
        *keys, "op", "path", "old_kind", "old_value", "new_kind", "new_value"
    )


def partition_of(path: Column) -> Column:
    """Section of a change: profiles, traces, story or root."""
    head = F.get(split_pointer(path), 0)
    return F.when(head.isin("profiles", "traces", "story"), head).otherwise("root")


# ---------------------------------------------------------------- replay


def _covering_paths(paths: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Changed paths that lie above some row."""
    above = rows.select(*keys, F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return paths.join(above, [*keys, "path"], "left_semi")


def latest_state(events: DataFrame, until: DataFrame | None = None) -> DataFrame:
    """Alive rows per scope after its last event, or at ``until`` (scope, at_seq)."""
    if until is not None:
        events = salted_join(events, until.select(*SCOPE, "at_seq"), SCOPE, [F.col("seq")]).filter(
            F.col("seq") <= F.col("at_seq")
        )
    return alive_rows(events, SCOPE)


def alive_rows(events: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each key that nothing newer touched at their own path or above it."""
    newest = (
        events.groupBy(*keys, "path")
        .agg(F.max_by(F.struct("seq", "op", "kind", "value"), "seq").alias("_e"))
        .select(*keys, "path", "_e.seq", "_e.op", "_e.kind", "_e.value")
    )
    cover = _covering_paths(newest.select(*keys, "path", "seq"), newest, keys).select(
        *keys, F.col("path").alias("_above"), F.col("seq").alias("_killed")
    )
    present = newest.filter("op <> 'remove'")
    probes = present.select(
        *keys, "path", "seq", F.explode(ancestors(F.col("path"))).alias("_above")
    )
    dead = (
        salted_join(probes, cover, [*keys, "_above"], [F.col("path")])
        .filter(F.col("_killed") > F.col("seq"))
        .select(*keys, "path")
        .distinct()
    )
    return present.join(dead, [*keys, "path"], "left_anti").select(
        *keys, "path", "kind", "value", "seq"
    )


def state_versions(events: DataFrame, size: int = DEFAULT_BLOCK, keys: list[str] = SCOPE) -> DataFrame:
    """Every value a path ever had with its life span ``[valid_from, valid_to)``.

    A span ends at the next change of the path itself or of any path above it; null means
    it is still alive. ``keys``: of a log, or of a part of one that stands by itself.
    """
    changes = events.select(*keys, "path", "seq")
    paths = changes.select(*keys, "path").distinct()
    links = events.filter("op <> 'remove'").select(
        *keys, "path", "seq", F.explode(ancestors(F.col("path"), include_self=True)).alias("_above")
    )
    links = salted_join(
        links,
        paths.withColumnRenamed("path", "_above"),
        [*keys, "_above"],
        [F.col("path"), F.col("seq")],
        "left_semi",
    )
    marks = changes.select(
        *keys, F.col("path").alias("_above"), (F.col("seq") * 2).alias("_pos"), F.col("seq").alias("_mark")
    )
    probes = (
        links.select(*keys, "_above", (F.col("seq") * 2 + 1).alias("_pos"))
        .distinct()
        .withColumn("_mark", F.lit(None).cast("long"))
    )
    line = last_known(
        marks.unionByName(probes), [*keys, "_above"], "_pos", "_mark", "_next", size, backward=True
    )
    ends = line.filter("_mark is null").select(
        *keys, "_above", ((F.col("_pos") - 1) / 2).cast("long").alias("seq"), "_next"
    )
    spans = (
        links.join(ends, [*keys, "_above", "seq"])
        .groupBy(*keys, "path", "seq")
        .agg(F.min("_next").alias("valid_to"))
    )
    return (
        events.filter("op <> 'remove'")
        .join(spans, [*keys, "path", "seq"])
        .select(*keys, "path", "kind", "value", F.col("seq").alias("valid_from"), "valid_to")
    )


def segment_rows(versions: DataFrame, last: DataFrame, width: int, keys: list[str] = SCOPE) -> DataFrame:
    """Versions listed under every segment of ``width`` seqs they are alive in.

    The rows of a segment that began before it are the checkpoint at its start.
    ``last`` (scope, last_seq) closes the spans that are still open.
    """
    closed = salted_join(versions, last, keys, [F.col("path"), F.col("valid_from")])
    end = F.least(F.coalesce(F.col("valid_to") - 1, F.col("last_seq")), F.col("last_seq"))
    first = F.floor(F.col("valid_from") / width)
    return (
        closed.filter((F.col("valid_from") <= F.col("last_seq")) & (end >= F.col("valid_from")))
        .withColumn("segment", F.explode(F.sequence(first, F.floor(end / width))))
        .drop("last_seq")
    )


def state_at(
    versions: DataFrame, points: DataFrame, last: DataFrame, width: int = DEFAULT_BLOCK, keys: list[str] = SCOPE
) -> DataFrame:
    """Snapshot rows for many points ``(scope, query_id, at_seq)``.

    A log of few points (``POINTS``) is met by all of them. Elsewhere points are numbered and meet
    only the versions of their own segment of so many points (``width`` where that is less), so a
    version is listed once for many points that it is alive at, however far apart their seqs are.
    """
    size = max(1, min(width, POINTS))
    asked = points.select(*keys, "query_id", "at_seq").where("at_seq is not null")
    many = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_many")).where(F.col("_many") > size).select(*keys)
    alive = (F.col("valid_from") <= F.col("at_seq")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("at_seq")))
    columns = [*keys, "query_id", "path", "kind", "value", "valid_from"]
    if many.isEmpty():
        return versions.join(asked, keys).filter(alive).select(*columns)
    versions, many = staged(versions, "versions"), F.broadcast(staged(many, "many_points"))
    few = versions.join(many, keys, "left_anti").join(asked.join(many, keys, "left_anti"), keys)
    long, crowd = versions.join(many, keys, "left_semi"), asked.join(many, keys, "left_semi")
    numbered = staged(ordinal(crowd.select(*keys, "at_seq").distinct(), keys, "at_seq", "_n", size=DEFAULT_BLOCK), "points")
    # The points of a version are those after the last one before it, up to the last one before its end.
    spans = long.withColumnsRenamed({"valid_from": "_from", "valid_to": "_to"})
    spans = last_before(spans, numbered, keys, "_from", "at_seq", {"valid_from": "_n"})
    spans = last_before(spans, numbered, keys, "_to", "at_seq", {"valid_to": "_n"})
    spans = spans.withColumn("valid_from", F.coalesce("valid_from", F.lit(0))).withColumn("valid_to", F.coalesce("valid_to", F.lit(0)))
    ends = numbered.groupBy(*keys).agg((F.max("_n") - 1).alias("last_seq"))
    listed = segment_rows(spans, ends, size, keys).drop("valid_from", "valid_to").withColumnsRenamed({"_from": "valid_from", "_to": "valid_to"})
    placed = crowd.join(numbered, [*keys, "at_seq"]).withColumn("segment", F.floor((F.col("_n") - 1) / size)).drop("_n")
    hit = listed.join(placed, [*keys, "segment"])
    return few.filter(alive).select(*columns).unionByName(hit.filter(alive).select(*columns))


def last_seq(events: DataFrame) -> DataFrame:
    return events.groupBy(*SCOPE).agg(F.max("seq").alias("last_seq"))


def change_rows(events: DataFrame, versions: DataFrame, size: int = DEFAULT_BLOCK) -> DataFrame:
    """What each event did to its path: add, replace, remove; events without effect are left out."""
    alive = versions.select(
        *SCOPE, "path", F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to")
    )
    before = previous_row(
        events,
        [*SCOPE, "path"],
        "seq",
        {"_seq": "seq", "old_kind": "kind", "old_value": "value", "_op": "op"},
        size,
    )
    joined = before.join(
        alive,
        (before.chat_id == alive.chat_id)
        & (before.branch_id == alive.branch_id)
        & (before.path == alive.path)
        & (before._seq == alive._from)
        & (before.seq == alive._to),
        "left",
    ).select(before["*"], alive["_from"])
    had = F.col("_from").isNotNull()
    same = (
        had
        & F.col("old_kind").eqNullSafe(F.col("kind"))
        & F.col("old_value").eqNullSafe(F.col("value"))
        & (F.col("kind") != "object")
    )
    change = (
        F.when((F.col("op") == "remove") & had, "remove")
        .when(F.col("op") == "remove", F.lit(None))
        .when(~had, "add")
        .when(~same, "replace")
    )
    return (
        joined.withColumn("change", change)
        .filter("change is not null")
        .select(
            *SCOPE,
            "seq",
            "path",
            partition_of(F.col("path")).alias("section"),
            F.col("change").alias("op"),
            F.when(had, F.col("old_value")).alias("old_value"),
            F.col("value").alias("new_value"),
        )
    )


def missing_removals(events: DataFrame, versions: DataFrame) -> DataFrame:
    """Removals of a path that was not there: an error in a patch."""
    ended = versions.filter("valid_to is not null").select(
        *SCOPE, "path", F.col("valid_to").alias("seq")
    )
    return (
        events.filter("op = 'remove'")
        .join(ended, [*SCOPE, "path", "seq"], "left_anti")
        .select(*SCOPE, "seq", "path")
    )


def node_fingerprints(versions: DataFrame, floors: DataFrame, size: int = DEFAULT_BLOCK) -> DataFrame:
    """State fingerprint after every floor ``(scope, seq)``, including floors without change.

    Each version switches its hash on where it begins and off where it ends, so the state
    after a floor is a running XOR: no snapshot is ever built.
    """
    stable = versions.filter(~is_volatile(F.col("path"))).select(
        *SCOPE,
        "valid_from",
        "valid_to",
        *_row_words(F.col("path"), F.col("kind"), stable_value(F.col("value"))),
    )
    moments = F.filter(F.array("valid_from", "valid_to"), lambda s: s.isNotNull())
    toggles = stable.select(*SCOPE, F.explode(moments).alias("seq"), *_WORDS)
    zero = floors.select(*SCOPE, "seq", *[F.lit(0).cast("long").alias(w) for w in _WORDS])
    per_seq = (
        toggles.unionByName(zero)
        .groupBy(*SCOPE, "seq")
        .agg(*[F.bit_xor(w).alias(w) for w in _WORDS])
    )
    return running_xor(per_seq, SCOPE, "seq", _WORDS, size).select(
        *SCOPE, "seq", _fingerprint_of_words().alias("state_fingerprint")
    )


def leaf_changes(log: DataFrame, size: int = DEFAULT_BLOCK) -> DataFrame:
    """``log`` (scope, seq, path, value; one row a path and seq) with ``old_value`` and ``op``,
    null where nothing changes."""
    linked = previous_row(log, [*SCOPE, "path"], "seq", {"old_value": "value"}, size)
    op = F.when(F.col("old_value").isNull(), "add").when(F.col("old_value") != F.col("value"), "replace")
    return linked.withColumn("op", op)


def leaf_fingerprints(changes: DataFrame, floors: DataFrame, size: int = DEFAULT_BLOCK) -> DataFrame:
    """State fingerprint at every floor (scope, seq) of a log of leaf values.

    A change toggles the hash of the old and of the new row, so all states of a chain are
    one running XOR and none of them is built.
    """
    said = changes.filter("op is not null").filter(~is_volatile(F.col("path")))
    kind = F.lit("value")
    toggles = said.select(*SCOPE, "seq", *_row_words(F.col("path"), kind, stable_value(F.col("value")))).unionByName(
        said.filter("old_value is not null").select(
            *SCOPE, "seq", *_row_words(F.col("path"), kind, stable_value(F.col("old_value")))
        )
    )
    zero = floors.select(*SCOPE, "seq", *[F.lit(0).cast("long").alias(w) for w in _WORDS])
    per_seq = toggles.unionByName(zero).groupBy(*SCOPE, "seq").agg(*[F.bit_xor(w).alias(w) for w in _WORDS])
    running = running_xor(per_seq, SCOPE, "seq", _WORDS, size)
    return running.join(floors.select(*SCOPE, "seq").distinct(), [*SCOPE, "seq"], "left_semi").select(
        *SCOPE, "seq", _fingerprint_of_words().alias("state_fingerprint")
    )


def checkpoint_marks(
    nodes: DataFrame, interval: int = DEFAULT_CHECKPOINT_INTERVAL, size: int = DEFAULT_BLOCK
) -> DataFrame:
    """Which nodes of a chain get a checkpoint.

    ``nodes``: scope, message_index, forced (true where a manual edit wrote one). A
    checkpoint is due once ``interval`` nodes have passed since the last one.
    """
    numbered = ordinal(nodes, SCOPE, "message_index", "_n", size)
    forced = numbered.withColumn("_f", F.when(F.col("forced"), F.col("_n")))
    based = last_known(forced, SCOPE, "message_index", "_f", "_base", size)
    gap = F.col("_n") - F.coalesce("_base", F.lit(0))
    return based.withColumn(
        "checkpoint", F.col("forced") | ((gap > 0) & (gap % max(1, interval) == 0))
    ).drop("_n", "_f", "_base")


def verify_snapshots(expected: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Integrity errors: snapshots that are missing or do not hash to what their node says.

    ``expected``: keys, state_fingerprint; ``rows``: keys, path, kind, value.
    """
    actual = state_fingerprints(rows, keys).withColumnRenamed("state_fingerprint", "_actual")
    joined = expected.join(actual, keys, "left")
    # An empty state has no rows.
    same = F.coalesce("_actual", F.lit(EMPTY_FINGERPRINT)) == F.col("state_fingerprint")
    reason = F.when(same, None).when(F.col("_actual").isNull(), "snapshot is missing").otherwise(
        "snapshot does not hash to its fingerprint"
    )
    return joined.withColumn("reason", reason).filter("reason is not null").drop("_actual")


def broken_links(nodes: DataFrame, deltas: DataFrame) -> DataFrame:
    """Nodes whose predecessor or delta is missing."""
    ids = nodes.select(F.col("state_node_id").alias("previous_state_node_id"), F.lit(True).alias("_p"))
    with_delta = deltas.select("state_node_id", F.lit(True).alias("_d")).distinct()
    joined = nodes.join(ids, "previous_state_node_id", "left").join(with_delta, "state_node_id", "left")
    reason = F.when(
        F.col("previous_state_node_id").isNotNull() & F.col("_p").isNull(), "previous node is missing"
    ).when(F.col("_d").isNull(), "delta is missing")
    return joined.withColumn("reason", reason).filter("reason is not null").select(
        *SCOPE, "state_node_id", "reason"
    )
