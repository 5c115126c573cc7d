"""Rebuilding broken chains: analyse and commit whole runs of floors of all scopes at once."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.functions.keys import dependency_fingerprint
from turnledger.operators import chain as ch
from turnledger.operators.bm25 import SCOPE
from turnledger.operators.merge import patch_log
from turnledger.operators.skew import DEFAULT_BLOCK, ordinal, previous_row, salted_join
from turnledger.operators.state_log import VOLATILE, leaf_changes, leaf_fingerprints

# An extractor reads the text of one floor and returns (pointer, JSON text) pairs.
Extractor = Callable[[str], list[tuple[str, str]]]


@dataclass(frozen=True)
class StateExtractor:
    """An extractor that also reads the state before its floor: ``ask(text, state)``, the state
    as pointer to JSON text. Its answers hold only for that state, so floors are asked in order
    and a node is reused only where body, prompt and the state before are those it was made from."""

    ask: Callable[[str, Mapping[str, str]], list[tuple[str, str]]]


_EXTRACTED = (
    "chat_id string, branch_id string, floor_id string, message_index bigint, attempts int, "
    "error string, path string, value string"
)

_NODE = [
    *SCOPE, "floor_id", "message_index", "state_node_id", "previous_state_fingerprint", "dependency_fingerprint",
    "state_fingerprint", "status", "created_at",
]
_DELTAS = (
    "chat_id string, branch_id string, state_node_id string, message_index bigint, path string, op string, "
    "old_value string, new_value string"
)


def regex_extractor(rules: dict[str, str]) -> Extractor:
    """Deterministic extractor: a pointer takes the first group of its pattern's first match."""
    compiled = {path: re.compile(pattern) for path, pattern in rules.items()}

    def extract(text: str) -> list[tuple[str, str]]:
        out = []
        for path, pattern in compiled.items():
            found = pattern.search(text or "")
            if found:
                out.append((path, '"' + found.group(1).replace("\\", "\\\\").replace('"', '\\"') + '"'))
        return out

    return extract


def extract_patches(floors: DataFrame, extractor: Extractor, attempts: int = 3) -> DataFrame:
    """Patch rows per floor, extracted batch by batch on the executors.

    A failing floor is tried up to ``attempts`` times and then leaves one row with its error;
    a floor with nothing to say leaves one row without a path.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                pairs, error, tries = None, None, 0
                while pairs is None and tries < max(1, attempts):
                    tries += 1
                    try:
                        pairs, error = extractor(row.content), None
                    except Exception as exc:  # the extractor is user code
                        error = str(exc)
                key = (row.chat_id, row.branch_id, row.floor_id, row.message_index, tries, error)
                for path, value in pairs or [(None, None)]:
                    out.append((*key, path, value))
            names = [c.split()[0] for c in _EXTRACTED.split(", ")]
            yield pd.DataFrame(out, columns=names)

    columns = [*SCOPE, "floor_id", F.col("message_index").cast("bigint").alias("message_index"), "content"]
    return floors.select(*columns).mapInPandas(run, _EXTRACTED)


class LeafState:
    """One chain's leaves while its floors are walked, with the running words of its fingerprint."""

    def __init__(self):
        self.leaves: dict[str, str] = {}
        self.words = [0, 0, 0, 0]

    def _toggle(self, path: str, value: str) -> None:
        parts = [p.replace("~1", "/").replace("~0", "~") for p in path.split("/")[1:]]
        if set(parts) & set(VOLATILE):
            return
        if value.startswith("[") and any(f'"{v}"' in value for v in VOLATILE):
            value = json.dumps(_stripped(json.loads(value)), separators=(",", ":"), ensure_ascii=False)
        digest = hashlib.sha256(f"{path}\nvalue\n{value}".encode()).hexdigest()
        for i in range(4):
            self.words[i] ^= int(digest[15 * i : 15 * i + 15], 16)

    def put(self, path: str, value: str) -> None:
        if path in self.leaves:
            self._toggle(path, self.leaves[path])
        self.leaves[path] = value
        self._toggle(path, value)

    def say(self, pairs: list[tuple[str, str]]) -> None:
        """What a floor says, as ``patch_log`` cleans it, with the names of new profiles."""
        said = {path: clean for path, value in pairs if (clean := _clean(path, value)) is not None}
        for path in list(said):
            parts = path.split("/")
            name = f"/profiles/{parts[2]}/canonicalName" if len(parts) > 2 and parts[1] in ("profiles", "traces") else None
            mentioned = name and any(p.startswith((f"/profiles/{parts[2]}/", f"/traces/{parts[2]}/")) for p in self.leaves)
            if name and not mentioned:
                said.setdefault(name, json.dumps(parts[2].replace("~1", "/").replace("~0", "~"), ensure_ascii=False))
        for path, value in said.items():
            self.put(path, value)

    def fingerprint(self) -> str:
        return "sha256:" + hashlib.sha256(":".join(map(str, self.words)).encode()).hexdigest()


def _stripped(value):
    if isinstance(value, list):
        return [_stripped(v) for v in value]
    if isinstance(value, dict):
        return {k: _stripped(v) for k, v in value.items() if k not in VOLATILE}
    return value


def _clean(path: str, value: str | None) -> str | None:
    if value is None or value == "null" and not path.endswith(("/affinity/inner", "/affinity/outer")):
        return None
    shown = lambda v: json.dumps(v, separators=(",", ":"), ensure_ascii=False)
    if value.startswith('"'):
        text = json.loads(value).strip()
        return shown(text) if text else None
    if value.startswith("[") and "{" not in value:
        return shown(list(dict.fromkeys(t for t in (str(x).strip() for x in json.loads(value)) if t)))
    return value


def extract_in_order(run: DataFrame, before: DataFrame, made: DataFrame, extractor: StateExtractor, attempts: int = 3) -> DataFrame:
    """Patch rows of the floors of ``run`` (with content), each asked with the state before it.

    ``before``: scope, path, value, the leaves before the run. ``made``: floor_id, node_id,
    previous_state_fingerprint, path, value, what earlier nodes of these floors said; where a
    node was made from the very state before the floor, its patches stand and nobody is
    asked (0 attempts). A chain stops at a floor that fails.

    Asking in order makes a chain one sequence: its rows are sorted by the shuffle and stream
    through one task, which holds the chain's leaves and one floor at a time. Chains go in
    parallel.
    """
    null = lambda t: F.lit(None).cast(t)
    shape = lambda df, **c: df.select(*SCOPE, *[c.get(n, null(t)).alias(n) for n, t in _WALKED])
    at = F.col("message_index")
    states = shape(before, kind=F.lit(0), path=F.col("path"), value=F.col("value"))
    nodes = made.join(run.select(*SCOPE, "floor_id", "message_index"), "floor_id")
    nodes = shape(nodes, kind=F.lit(1), message_index=at, node_id=F.col("node_id"), base=F.col("previous_state_fingerprint"), path=F.col("path"), value=F.col("value"))
    floors = shape(run, kind=F.lit(2), message_index=at, floor_id=F.col("floor_id"), base=F.col("_base"), content=F.col("content"))
    lines = states.unionByName(nodes).unionByName(floors)
    count = int(run.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartition(count, *SCOPE).sortWithinPartitions(*SCOPE, "message_index", "kind", "node_id")
    names = [c.split()[0] for c in _EXTRACTED.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scope = state = None
        for batch in batches:
            out = []
            for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                if (row.chat_id, row.branch_id) != scope:
                    scope, state = (row.chat_id, row.branch_id), LeafState()
                    first, failed, earlier = True, False, {}
                if row.kind == 0:
                    state.put(row.path, row.value)
                elif row.kind == 1:
                    pairs = earlier.setdefault(row.node_id, (row.base, []))[1]
                    if row.path is not None:
                        pairs.append((row.path, row.value))
                elif not failed:
                    previous = row.base if first else state.fingerprint()
                    same = [n for n, (base, _) in sorted(earlier.items()) if base == previous]
                    pairs, error, tries = earlier[same[-1]][1] if same else None, None, 0
                    while pairs is None and tries < max(1, attempts):
                        tries += 1
                        try:
                            pairs, error = extractor.ask(row.content, dict(state.leaves)), None
                        except Exception as exc:  # the extractor is user code
                            error = str(exc)
                    failed = pairs is None
                    key = (*scope, row.floor_id, row.message_index, tries, error)
                    out += [(*key, path, value) for path, value in pairs or [(None, None)]]
                    state.say(pairs or [])
                    first, earlier = False, {}
            yield pd.DataFrame(out, columns=names)

    return ordered.mapInPandas(walk, _EXTRACTED)


_WALKED = [
    ("kind", "int"), ("message_index", "bigint"), ("floor_id", "string"), ("base", "string"), ("content", "string"),
    ("node_id", "string"), ("path", "string"), ("value", "string"),
]


@dataclass
class Rebuilt:
    """``nodes`` and ``patches`` with the new ones; ``deltas`` of the new nodes; ``left``: floors
    whose chain does not hold, each with its reason; ``rounds`` that did any work."""

    nodes: DataFrame
    patches: DataFrame
    deltas: DataFrame
    left: DataFrame
    rounds: int


def next_run(prefix: DataFrame, failed: DataFrame, block: int, size: int = DEFAULT_BLOCK) -> DataFrame:
    """Up to ``block`` floors per broken chain, from its first invalid one on.

    A chain whose first invalid floor has failed waits for somebody to look at it.
    """
    numbered = ordinal(prefix, SCOPE, "message_index", "_n", size)
    first = (
        numbered.filter(~F.col("valid"))
        .groupBy(*SCOPE)
        .agg(F.min_by(F.struct("_n", "floor_id", "previous_state_fingerprint"), "message_index").alias("_f"))
        .select(*SCOPE, F.col("_f._n").alias("_first"), F.col("_f.floor_id").alias("floor_id"), F.col("_f.previous_state_fingerprint").alias("_base"))
        .join(failed.select("floor_id"), "floor_id", "left_anti")
        .drop("floor_id")
    )
    return (
        salted_join(numbered, first, SCOPE, [F.col("floor_id")])
        .filter((F.col("_n") >= F.col("_first")) & (F.col("_n") < F.col("_first") + block))
        .select(*SCOPE, F.col("message_index").cast("bigint").alias("message_index"), "floor_id", "body_fingerprint", "_base")
    )


def made_nodes(run: DataFrame, nodes: DataFrame, prompt_version: str) -> DataFrame:
    """Nodes of the run's floors made from their body and prompt, whatever state they started from."""
    prompt = F.lit(prompt_version)
    made = nodes.select("floor_id", "state_node_id", "created_at", "previous_state_fingerprint", "dependency_fingerprint")
    return run.select("floor_id", "body_fingerprint").join(made, "floor_id").filter(
        F.col("dependency_fingerprint")
        == dependency_fingerprint(F.col("body_fingerprint"), F.col("previous_state_fingerprint"), prompt)
    )


def reusable_nodes(run: DataFrame, nodes: DataFrame, prompt_version: str) -> DataFrame:
    """(floor_id, source_node_id): what a floor's text said is known, so an extractor that reads
    nothing else is not asked again."""
    return made_nodes(run, nodes, prompt_version).groupBy("floor_id").agg(F.max_by("state_node_id", F.struct("created_at", "state_node_id")).alias("source_node_id"))


def chain_patches(prefix: DataFrame, run: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches of the valid nodes of the run's chains."""
    chain = prefix.filter("valid").select("state_node_id")
    scopes = run.select(*SCOPE).distinct()
    before = patches.join(chain, "state_node_id", "left_semi")
    return salted_join(before, scopes, SCOPE, [F.col("path"), F.col("message_index")], "left_semi")


def commit_run(
    prefix: DataFrame,
    run: DataFrame,
    said: DataFrame,
    nodes: DataFrame,
    patches: DataFrame,
    prompt_version: str,
    number: int,
    keep: Callable[[DataFrame, str], DataFrame],
    size: int = DEFAULT_BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, deltas) of the floors of ``run``, in order on top of each chain's valid nodes.

    ``said``: the patch rows of the run. The states of all floors come from one running
    pass over the leaf log of the chain, so a run of any length is one job. A floor that
    already has a node with the dependency it comes to gets none: its chain holds again.

    ``keep`` writes a table under a name and reads it again. An ordered scan reads its input up
    to four times, so each one starts from a written table: scans over scans would multiply.
    """
    rows = chain_patches(prefix, run, patches).unionByName(said).select(*SCOPE, F.col("message_index").alias("seq"), "path", "value")
    changes = keep(leaf_changes(keep(patch_log(keep(rows, "rows")), "log"), size), "changes")
    floors = run.select(*SCOPE, F.col("message_index").alias("seq"))
    states = leaf_fingerprints(changes, floors, size).withColumnRenamed("seq", "message_index")
    reached = keep(run.join(states, [*SCOPE, "message_index"]), "states")
    linked = previous_row(reached, SCOPE, "message_index", {"_previous": "state_fingerprint"}, size).withColumn(
        "previous_state_fingerprint", F.coalesce("_previous", "_base")
    )
    node_id = F.concat_ws(":", F.lit("node"), "floor_id", F.lit(str(number)))
    made = linked.select(
        *SCOPE,
        "floor_id",
        "message_index",
        node_id.alias("state_node_id"),
        "previous_state_fingerprint",
        dependency_fingerprint(
            F.col("body_fingerprint"), F.col("previous_state_fingerprint"), F.lit(prompt_version)
        ).alias("dependency_fingerprint"),
        "state_fingerprint",
        F.lit("synced").alias("status"),
        F.lit(number).cast("bigint").alias("created_at"),
    ).join(nodes.select("floor_id", "dependency_fingerprint"), ["floor_id", "dependency_fingerprint"], "left_anti")
    made = keep(made.select(*_NODE), "new_nodes")
    deltas = changes.filter("op is not null").withColumnRenamed("seq", "message_index").join(
        made.select(*SCOPE, "message_index", "state_node_id"), [*SCOPE, "message_index"]
    )
    return made, deltas.select(*SCOPE, "state_node_id", "message_index", "path", "op", "old_value", F.col("value").alias("new_value"))


def rebuild_until_valid(
    positions: DataFrame,
    nodes: DataFrame,
    patches: DataFrame,
    extractor: Extractor | StateExtractor,
    prompt_version: str,
    root: str,
    first_round: int = 1,
    first_block: int = 8,
    growth: int = 8,
    attempts: int = 3,
    size: int = DEFAULT_BLOCK,
    fold_size: int = ch.FOLD_BLOCK,
) -> Rebuilt:
    """Analyse broken chains until each holds or waits at a floor that fails.

    All chains advance together by runs of ``first_block`` floors, ``growth`` times longer every
    round: a chain of n floors takes about log n rounds, and one that matches again
    after its edit is found soon. An extractor of texts reads single floors, so a run is extracted
    in one pass, and what a text said before is used again from any state; one that reads the
    state (``StateExtractor``) walks each chain's run in order and uses a node again only for
    the same dependency. A run is committed in order up to its first failure. A floor is asked ``attempts``
    times in total and never again; what rests on it is returned in ``left``. Every
    round is written under ``root`` (a shared folder) before it is used, so a lost executor
    costs one round at most and no floor is sent twice. ``first_round`` numbers the rounds, and
    with them the new nodes, after those of earlier calls.
    """
    spark = positions.sparkSession
    text = positions.select("floor_id", "content")
    failed = spark.createDataFrame([], "floor_id string, attempts int, error string")
    deltas = None
    number, block = first_round - 1, first_block

    def written(df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    while True:
        number += 1
        path = f"{root}/round={number}"
        prefix = written(ch.trusted_prefix(positions, nodes, F.lit(prompt_version), fold_size=fold_size), f"{path}/prefix")
        run = written(next_run(prefix, failed, block, size), f"{path}/run")
        if run.isEmpty():
            break
        known = reusable_nodes(run, nodes, prompt_version)
        if isinstance(extractor, StateExtractor):
            known, earlier = known.limit(0), made_nodes(run, nodes, prompt_version).select("floor_id", F.col("state_node_id").alias("node_id"), "previous_state_fingerprint")
            earlier = earlier.join(patches.select(F.col("state_node_id").alias("node_id"), "path", "value"), "node_id", "left")
            log = patch_log(chain_patches(prefix, run, patches).select(*SCOPE, F.col("message_index").alias("seq"), "path", "value"))
            leaves = log.groupBy(*SCOPE, "path").agg(F.max_by("value", "seq").alias("value"))
            found = extract_in_order(run.join(text, "floor_id"), leaves, earlier, extractor, attempts)
        else:
            known = written(known, f"{path}/known")
            found = extract_patches(run.join(known, "floor_id", "left_anti").join(text, "floor_id"), extractor, attempts)
        found = written(found, f"{path}/extracted")
        bad = found.filter("error is not null")
        cut = bad.groupBy(*SCOPE).agg(F.min("message_index").alias("_cut"))
        good = salted_join(run, cut, SCOPE, [F.col("floor_id")], "left").filter(
            F.col("_cut").isNull() | (F.col("message_index") < F.col("_cut"))
        ).drop("_cut")
        good = written(good, f"{path}/good")
        node_id = F.concat_ws(":", F.lit("node"), "floor_id", F.lit(str(number)))
        again = known.join(patches.select(F.col("state_node_id").alias("source_node_id"), "path", "value"), "source_node_id")
        pairs = found.filter("path is not null").select("floor_id", "path", "value").unionByName(again.select("floor_id", "path", "value"))
        said = good.select(*SCOPE, "floor_id", "message_index", node_id.alias("state_node_id")).join(pairs, "floor_id").drop("floor_id")
        said = written(said.select(*SCOPE, "state_node_id", "message_index", "path", "value"), f"{path}/said")
        new_nodes, changed = commit_run(
            prefix, good, said, nodes, patches, prompt_version, number, lambda df, name: written(df, f"{path}/{name}"), size
        )
        new_deltas = written(changed, f"{path}/new_deltas")
        said = written(said.join(new_nodes.select("state_node_id"), "state_node_id", "left_semi"), f"{path}/new_patches")
        nodes = nodes.select(*new_nodes.columns).unionByName(new_nodes)
        patches = patches.select(*said.columns).unionByName(said)
        deltas = new_deltas if deltas is None else deltas.unionByName(new_deltas)
        failed = failed.unionByName(bad.select("floor_id", "attempts", "error"))
        block *= growth
    if deltas is None:
        deltas = spark.createDataFrame([], _DELTAS)
    left = prefix.filter(~F.col("valid")).join(failed, "floor_id", "left").select(
        *SCOPE, "message_index", "floor_id", "attempts", F.coalesce("error", F.lit("the chain before it does not hold")).alias("reason")
    )
    return Rebuilt(nodes, patches, deltas, left, number - first_round)
