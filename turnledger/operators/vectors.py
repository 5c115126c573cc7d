"""Exact vector search and embedding upkeep."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions.keys import fingerprint
from turnledger.functions.text import trim_ws
from turnledger.operators.bm25 import SCOPE, by_score
from turnledger.operators.ranking import positive_or, top_k
from turnledger.operators.skew import DEFAULT_SALTS, salted_join

DEFAULT_TOP_K = 10
# Scores keep this many decimals, so equal vectors tie wherever their block was computed.
SCORE_DECIMALS = 12
_BLOCK_BYTES = 4 << 20
# Rows of unfinished blocks that a task holds, and products that are looked at together.
_HELD_BYTES, _SLICE_BYTES = 32 << 20, 16 << 20


def embedding_text(columns: set[str] | None = None) -> Column:
    """Title, summary, characters, plotlines and tags joined by single spaces."""

    def field(name: str) -> Column:
        return F.col(name) if columns is None or name in columns else F.lit(None)

    scalar = [F.coalesce(field("title").cast("string"), F.lit("")), field("summary")]
    lists = [
        F.coalesce(field(n).cast("array<string>"), F.array().cast("array<string>"))
        for n in ("character_ids", "plotline_ids", "tags")
    ]
    return trim_ws(F.array_join(F.concat(F.array(*scalar), *lists), " "))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two numeric arrays; 0 for empty, unequal or zero vectors."""

    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norm = F.sqrt(dot(left, left) * dot(right, right))
    same = (F.size(left) > 0) & (F.size(left) == F.size(right))
    return F.when(same & (norm > 0), dot(left, right) / norm).otherwise(F.lit(0.0))


def _pack(ids: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Turn vector rows into blocks: id arrays plus one matrix of unit rows.

    Rows of a scope are gathered over the batches of a task until they fill a block.
    """

    def block(key: tuple, parts: list[tuple[dict, np.ndarray]]) -> pd.DataFrame:
        out = {"chat_id": [key[0]], "branch_id": [key[1]], "dim": [key[2]]}
        for name in ids:
            out[name] = [np.concatenate([p[name] for p, _ in parts]).tolist()]
        out["matrix"] = [np.concatenate([m for _, m in parts]).tobytes()]
        return pd.DataFrame(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[tuple, list] = {}
        held = 0
        for batch in batches:
            batch = batch.assign(_dim=batch["vector"].map(len))
            for key, rows in batch.groupby([*SCOPE, "_dim"], sort=False):
                step = max(1, _BLOCK_BYTES // (8 * max(key[2], 1)))
                for start in range(0, len(rows), step):
                    part = rows.iloc[start : start + step]
                    matrix = np.asarray(part["vector"].tolist(), dtype="float64")
                    if key[2] == 0:
                        continue
                    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
                    usable = (norms[:, 0] > 0) & np.isfinite(norms[:, 0])
                    if not usable.any():
                        continue
                    unit = matrix[usable] / norms[usable]
                    parts = waiting.setdefault(key, [])
                    if sum(len(m) for _, m in parts) + len(unit) > step:
                        if parts:
                            yield block(key, parts)
                        held -= sum(m.nbytes for _, m in parts)
                        parts.clear()
                    parts.append(({name: part[name].to_numpy()[usable] for name in ids}, unit))
                    held += unit.nbytes
            if held > _HELD_BYTES:
                yield from (block(key, parts) for key, parts in waiting.items() if parts)
                waiting, held = {}, 0
        yield from (block(key, parts) for key, parts in waiting.items() if parts)

    return run


def _candidates(near: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) places that hold the k largest products of every query, and few others.

    The k-th largest of the maxima of column groups is not above the k-th largest product;
    ``slack`` is what two products may be wrong by. Products that can't be above zero are left out.
    """
    n = near.shape[1]
    width = n // max(4 * k, 64)
    if width < 2:
        edge = np.partition(near, n - k, axis=1)[:, n - k] if n > k else np.full(len(near), -np.inf, near.dtype)
    else:
        groups = n // width
        tops = near[:, : groups * width].reshape(len(near), width, groups).max(axis=1)
        edge = np.partition(tops, groups - k, axis=1)[:, groups - k]
    return np.nonzero(near >= np.maximum(edge, 0)[:, None] - np.float32(slack))


def _best_pairs(k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Multiply a query block with a vector block; emit at most k rows per query.

    Products in single precision tell which pairs can be among the best; only those are
    multiplied in double precision. Both go by slices of bounded size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                dim = int(row.dim)
                stored = np.frombuffer(row.matrix, dtype="float64").reshape(-1, dim)
                asked = np.frombuffer(row.query_matrix, dtype="float64").reshape(-1, dim)
                short, short_asked = stored.astype("float32"), asked.astype("float32")
                floors, names = np.asarray(row.start_floor), np.asarray(row.memory_id)
                if names.dtype == object:
                    names = names.astype(str)
                queries = np.asarray(row.query_id, dtype=object)
                tie = np.empty(len(names), np.int64)
                tie[np.lexsort((names, floors))] = np.arange(len(names))
                # Unit rows: what rounding the inputs and adding dim products in single precision can change.
                slack = 4 * (dim + 4) * 2.0**-24
                step = max(1, _SLICE_BYTES // (4 * len(stored)))
                for low in range(0, len(asked), step):
                    part = asked[low : low + step]
                    q, at = _candidates(short_asked[low : low + step] @ short.T, k, slack)
                    score = np.empty(len(q))
                    few = max(1, _SLICE_BYTES // (8 * dim))
                    for i in range(0, len(q), few):
                        score[i : i + few] = np.einsum("ij,ij->i", part[q[i : i + few]], stored[at[i : i + few]])
                    score = np.round(score, SCORE_DECIMALS)
                    order = np.lexsort((tie[at], -score, q))
                    order = order[score[order] > 0]
                    q, at, score = q[order], at[order], score[order]
                    first = np.searchsorted(q, np.arange(len(part)))
                    best = np.arange(len(q)) - first[q] < k
                    q, at, score = q[best], at[best], score[best]
                    if len(q):
                        yield pd.DataFrame(
                            {
                                "chat_id": row.chat_id,
                                "branch_id": row.branch_id,
                                "query_id": queries[low + q],
                                "memory_id": names[at],
                                "start_floor": floors[at],
                                "score": score,
                            }
                        )

    return run


def vector_topk(
    vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K, salts: int = DEFAULT_SALTS
) -> DataFrame:
    """Best k memories per query by cosine, scores above zero only.

    ``vectors``: scope, memory_id, start_floor, vector; ``queries``: scope, query_id, vector.
    Both sides become matrix blocks of bounded size and meet on (scope, dimension). A
    pair of blocks is one matrix product that emits only the best k per query. The
    blocks of one large scope are salted over many tasks; the query blocks are repeated ``salts`` times.
    """
    k = positive_or(k, DEFAULT_TOP_K)
    types = dict(queries.dtypes)
    query_type = types["query_id"]
    stored_types = dict(vectors.dtypes)
    id_type, floor_type = stored_types["memory_id"], stored_types["start_floor"]
    clean = F.col("vector").cast("array<double>").alias("vector")
    valid = (F.size("vector") > 0) & F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    scope = "chat_id string, branch_id string, dim int"
    blocks = (
        vectors.select(*SCOPE, "memory_id", "start_floor", clean)
        .filter(valid)
        .mapInPandas(
            _pack(["memory_id", "start_floor"]),
            f"{scope}, memory_id array<{id_type}>, start_floor array<{floor_type}>, matrix binary",
        )
    )
    asked = (
        queries.select(*SCOPE, "query_id", clean)
        .filter(valid)
        .mapInPandas(_pack(["query_id"]), f"{scope}, query_id array<{query_type}>, matrix binary")
        .withColumnRenamed("matrix", "query_matrix")
    )
    pairs = salted_join(blocks, asked, [*SCOPE, "dim"], spread=[F.col("memory_id")], salts=salts)
    best = pairs.mapInPandas(
        _best_pairs(k),
        f"chat_id string, branch_id string, query_id {query_type}, memory_id {id_type}, "
        f"start_floor {floor_type}, score double",
    )
    return top_k(best, [*SCOPE, "query_id"], by_score(digits=None), k)


def parse_vectors(refs: DataFrame, memories: DataFrame) -> DataFrame:
    """Stored embeddings of known memories; malformed or non-finite vectors are left out."""
    parsed = refs.withColumn("vector", F.from_json("vector_json", "array<double>"))
    finite = F.col("vector").isNotNull() & F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    known = memories.select(*SCOPE, "memory_id")
    return parsed.filter(finite).drop("vector_json").join(known, "memory_id")


def embedding_plan(
    memories: DataFrame,
    refs: DataFrame,
    binding: str,
    failures: DataFrame | None = None,
    now: Column | None = None,
    full: bool = False,
) -> DataFrame:
    """Action per memory: ``keep``, ``embed``, ``cooldown`` or ``remove``.

    A vector is kept while the text key and the vector-space key are both unchanged. The
    same text that failed recently waits until ``retry_at``. ``full`` ignores what is stored.
    """
    keys = [*SCOPE, "memory_id"]
    text = embedding_text(set(memories.columns))
    wanted = (
        memories.filter(~F.col("stale"))
        .select(*keys, text.alias("text"))
        .withColumn("content_fingerprint", fingerprint(F.col("text")))
    )
    stored = refs.select(
        *keys,
        F.col("content_fingerprint").alias("_content"),
        F.col("binding_fingerprint").alias("_binding"),
    )
    joined = wanted.join(stored, keys, "full_outer")
    if failures is not None:
        failed = failures.select(
            *keys, F.col("content_fingerprint").alias("_failed"), F.col("retry_at")
        )
        joined = joined.join(failed, keys, "left")
    else:
        joined = joined.withColumn("_failed", F.lit(None).cast("string")).withColumn(
            "retry_at", F.lit(None).cast("timestamp")
        )
    moment = now if now is not None else F.current_timestamp()
    fresh = (F.col("_content") == F.col("content_fingerprint")) & (F.col("_binding") == binding)
    waiting = (F.col("_failed") == F.col("content_fingerprint")) & (F.col("retry_at") > moment)
    action = F.when(F.col("text").isNull(), "remove")
    if not full:
        action = action.when(F.coalesce(fresh, F.lit(False)), "keep").when(
            F.coalesce(waiting, F.lit(False)), "cooldown"
        )
    return joined.select(
        *keys, "text", "content_fingerprint", action.otherwise("embed").alias("action")
    )


def plan_counts(plan: DataFrame) -> DataFrame:
    """Rows per scope and action."""
    return plan.groupBy(*SCOPE).agg(
        *[
            F.count_if(F.col("action") == name).alias(name)
            for name in ("keep", "embed", "cooldown", "remove")
        ]
    )


class PermanentEncodeError(Exception):
    """Raised by an encoder when trying again cannot help."""


Encoder = Callable[[list[str]], list[list[float]]]


def hashing_encoder(dim: int = 64) -> Encoder:
    """Deterministic encoder for tests: words hashed into signed buckets."""
    import hashlib

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * dim
            for word in text.lower().split():
                digest = hashlib.sha256(word.encode()).digest()
                vector[digest[0] % dim] += 1.0 if digest[1] % 2 else -1.0
            out.append(vector)
        return out

    return encode


def embed_texts(plan: DataFrame, encode: Encoder, attempts: int = 3) -> DataFrame:
    """Vectors for the ``embed`` rows of a plan, encoded batch by batch on the executors.

    A failing batch is retried text by text, so one bad text fails alone. Rows carry
    either a vector or an error.
    """

    def one(text: str) -> tuple[list[float] | None, str | None]:
        error = "no attempt"
        for _ in range(max(1, attempts)):
            try:
                return encode([text])[0], None
            except PermanentEncodeError as exc:
                return None, str(exc)
            except Exception as exc:  # the encoder is user code
                error = str(exc)
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            try:
                results = [(v, None) for v in encode(texts)]
            except Exception:
                results = [one(t) for t in texts]
            yield batch.drop(columns=["text"]).assign(
                vector=[r[0] for r in results], error=[r[1] for r in results]
            )

    todo = plan.filter("action = 'embed'").select(
        *SCOPE, "memory_id", "content_fingerprint", "text"
    )
    return todo.mapInPandas(
        run,
        "chat_id string, branch_id string, memory_id string, content_fingerprint string, "
        "vector array<double>, error string",
    )


def sync_embeddings(
    refs: DataFrame, plan: DataFrame, encoded: DataFrame, binding: str
) -> DataFrame:
    """The next embedding table: kept rows as stored plus the newly encoded ones."""
    keys = [*SCOPE, "memory_id"]
    kept = refs.join(plan.filter("action = 'keep'").select(*keys), keys, "left_semi")
    added = encoded.filter("error is null").select(
        *keys, "content_fingerprint", F.lit(binding).alias("binding_fingerprint"), "vector"
    )
    return kept.select(*added.columns).unionByName(added)


def sync_counts(plan: DataFrame, encoded: DataFrame) -> DataFrame:
    """Indexed, failed and removed memories per scope after a sync."""
    flags = plan.filter("action <> 'embed'").select(*SCOPE, F.col("action").alias("outcome"))
    done = encoded.select(
        *SCOPE, F.when(F.col("error").isNull(), "keep").otherwise("cooldown").alias("outcome")
    )
    return (
        flags.unionByName(done)
        .groupBy(*SCOPE)
        .agg(
            F.count_if(F.col("outcome") == "keep").alias("indexed"),
            F.count_if(F.col("outcome") == "cooldown").alias("failed"),
            F.count_if(F.col("outcome") == "remove").alias("removed"),
        )
    )
