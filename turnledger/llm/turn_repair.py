"""Cheapest repair of the turn structure of conversations, by Four-Russians block tables.

A valid conversation's role initials read ``(s?(ua)+)?``. Edits keep a row (0), give it the role
user or assistant (2), delete it (3) or insert an empty turn (2); a truncated row that stays
costs 1 more, blank and repeated rows must go. The cost still to come, as a vector over the
four states of that pattern and less its smallest entry, is one of a few dozen vectors. For
each of them and each block of ``BLOCK`` symbols the vector before the block and the cost
taken off are computed once; a conversation is then a walk of table lookups from its last
block to its first. Blocks are expanded against that walk, from the first on: the states that
the least audit so far can be in go along as a set, so ties between edits that read alike
stay open until a later row settles them. Expansions are remembered by (vector, block, set).

On Spark: faults come from aggregates over digests of the texts; rows are sorted by range, so
that a long conversation lies in several tasks, and become strings of one letter a row. Only
these meet by conversation (a byte a row, as long as the audit that is asked for). The hash of
the repaired texts is one hash over all of them in order, so one task streams a conversation's
texts through it, a batch at a time.

Defined cases: a null id, turn, role or text counts as one space in the damage and in texts, and
rows with a null id are one conversation, returned with a null id; rows of one turn are ordered
by role, then by the text's SHA-256; equal rows are duplicates of the first; rows of any length
and roles of any kind (an empty one has no initial) are read; a conversation without rows gets
zeros, an empty audit and the hash of nothing; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.llm.stages import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Symbols of a block.
BLOCK = 4
#: Letters of one row of a conversation's part: role s, u, a, other by fault none, truncated, forced.
CODES = "abcdefghijkl"
PART = 1 << 16

_S, _U, _A, _X = range(4)
# State after a turn of that role; states: nothing yet, after s, after u, after a.
_AFTER = {(0, _S): 1, (0, _U): 2, (1, _U): 2, (3, _U): 2, (2, _A): 3}
_SYMBOLS = 9  # forced, or role by truncated or not


def _after(state: int, role: int) -> int | None:
    return _AFTER.get((state, role))


def _with_inserts(h: list[float]) -> tuple[float, ...]:
    for _ in range(3):
        h = [min([h[q], *(INSERT + h[t] for r in (_U, _A) if (t := _after(q, r)) is not None)]) for q in range(4)]
    return tuple(h)


def _before(h: tuple[float, ...], symbol: int) -> tuple[float, ...]:
    """Costs to come before a row, from those after it. Symbol 0 is forced out."""
    out = [DELETE + c for c in h]
    if symbol:
        cut, role = divmod(symbol - 1, 4)
        for q in range(4):
            for cost, r in ((KEEP, role), (REROLE, _U), (REROLE, _A)):
                if (t := _after(q, r)) is not None:
                    out[q] = min(out[q], cost + TRUNCATED * cut + h[t])
    return _with_inserts(out)


class BlockTables:
    """All normalised vectors, their steps and the steps of whole blocks."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        end = _with_inserts([0, float("inf"), float("inf"), 0])
        self.vectors, number, steps = [end], {end: 0}, []
        for v in self.vectors:  # grows while it is read
            for symbol in range(_SYMBOLS):
                raw = _before(v, symbol)
                low = min(raw)
                norm = tuple(c - low for c in raw)
                if norm not in number:
                    number[norm] = len(self.vectors)
                    self.vectors.append(norm)
                steps.append((number[norm], int(low)))
        table = np.array(steps, np.int64).reshape(len(self.vectors), _SYMBOLS, 2)
        self.next, self.off = table[..., 0], table[..., 1]
        # Block (s1 ... sB), first symbol most significant, taken from its last symbol on.
        to = np.arange(len(self.vectors))[:, None]
        cost = np.zeros_like(to)
        for _ in range(block):
            cost = np.concatenate([cost + self.off[to, s] for s in range(_SYMBOLS)], axis=1)
            to = np.concatenate([self.next[to, s] for s in range(_SYMBOLS)], axis=1)
        self.block_next, self.block_off = to, cost
        self.expanded: dict[tuple[int, int, int], tuple[str, int]] = {}

    def _letters(self, symbols: list[int], vector: int, states: int) -> tuple[str, int]:
        """Edits over ``symbols`` and the states after them; ``vector`` holds after the last."""
        ids = [vector]
        for s in reversed(symbols):
            ids.append(int(self.next[ids[-1], s]))
        ids.reverse()
        out = []
        for i, s in enumerate(symbols):
            here, there, off = self.vectors[ids[i]], self.vectors[ids[i + 1]], int(self.off[ids[i + 1], s])
            cut, role = divmod(s - 1, 4) if s else (0, None)
            while True:
                at = [q for q in range(4) if states >> q & 1]
                stay = [q for q in at if here[q] + off == DELETE + there[q]]
                if stay:
                    out.append("D")
                    states = sum(1 << q for q in stay)
                    break
                insert = {t for q in at for r in (_U, _A) if (t := _after(q, r)) is not None and here[q] == INSERT + here[t]}
                if insert:
                    out.append("I")
                    states = sum(1 << t for t in insert)
                    continue
                for letter, cost, roles in (("K", KEEP, [role]), ("R", REROLE, [_U, _A])):
                    to = {t for q in at for r in roles if (t := _after(q, r)) is not None and here[q] + off == cost + TRUNCATED * cut + there[t]}
                    if to:
                        break
                out.append(letter)
                states = sum(1 << t for t in to)
                break
        return "".join(out), states

    def repair(self, symbols: np.ndarray) -> tuple[int, str]:
        """Cost and least audit of a conversation."""
        head = len(symbols) % self.block
        powers = _SYMBOLS ** np.arange(self.block - 1, -1, -1)
        blocks = (symbols[head:].reshape(-1, self.block) @ powers).tolist()
        after, cost = [0], 0
        for b in reversed(blocks):
            cost += int(self.block_off[after[-1], b])
            after.append(int(self.block_next[after[-1], b]))
        first = after[-1]
        for s in symbols[:head][::-1].tolist():
            cost += int(self.off[first, s])
            first = int(self.next[first, s])
        cost += int(self.vectors[first][0])
        audit, states = self._letters(symbols[:head].tolist(), after[-1], 1)
        parts = [audit]
        for k, b in enumerate(blocks):
            key = (after[len(blocks) - 1 - k], b, states)
            if key not in self.expanded:
                inside = symbols[head + k * self.block : head + (k + 1) * self.block].tolist()
                self.expanded[key] = self._letters(inside, key[0], states)
            letters, states = self.expanded[key]
            parts.append(letters)
        left = min(self.vectors[0][q] for q in range(4) if states >> q & 1)
        parts.append("I" * int(left // INSERT))
        return cost, "".join(parts)


_tables: list[BlockTables] = []


def block_tables() -> BlockTables:
    if not _tables:
        _tables.append(BlockTables())
    return _tables[0]


def _symbols(codes: str) -> tuple[np.ndarray, int]:
    """Symbols of a conversation, and its adjacent rows that may not follow each other."""
    raw = np.frombuffer(codes.encode(), np.uint8).astype(np.int64) - ord(CODES[0])
    fault, role = np.divmod(raw, 4)
    ok = ((role[:-1] == _S) | (role[:-1] == _A)) & (role[1:] == _U) | (role[:-1] == _U) & (role[1:] == _A)
    return np.where(fault == 2, 0, 1 + role + 4 * fault), int((~ok).sum())


def _repairer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = block_tables()
    for batch in batches:
        found = [(*tables.repair(s), illegal) for s, illegal in map(_symbols, batch.column("codes").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int64())],
            ["conv", "cost", "audit", "illegal"],
        )


def _part_writer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted rows of one conversation as strings, numbered in their order."""
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    conv, held, size = None, [], 0

    def flush() -> tuple:
        nonlocal seq, held, size
        row = (conv, part, seq, "".join(held))
        seq, held, size = seq + 1, [], 0
        return row

    ready: list[tuple] = []
    for batch in batches:
        for c, codes in zip(batch.column("conv").to_pylist(), batch.column("codes").to_pylist()):
            if held and (c != conv or size > PART):
                ready.append(flush())
            conv = c
            held.append(codes)
            size += len(codes)
        if ready:
            yield _parts(ready)
            ready = []
    if held:
        yield _parts([flush()])


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows), kinds)], ["conv", "part", "seq", "codes"])


def _hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each conversation's repaired turns; its audit comes before its rows."""
    conv = edits = None
    n = odd = 0
    digest = hashlib.sha256()
    done: list[tuple[str, str]] = []

    def turn(role: str, text: str) -> None:
        nonlocal n
        digest.update((b"\n" if n else b"") + f"{role}:".encode() + text.encode())
        n += 1

    def inserts() -> str:
        """The next letter that stands for a row, '' at the end."""
        for letter in edits:
            if letter != "I":
                return letter
            turn("assistant" if (n + odd) % 2 else "user", "")
        return ""

    def close():
        nonlocal digest
        if conv is not None:
            inserts()
            done.append((conv, digest.hexdigest()))
            digest = hashlib.sha256()

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "audit", "role", "text")]
        for c, audit, role, text in zip(*columns):
            if audit is not None:
                close()
                conv, edits, n = c, iter(audit), 0
                odd = (len(audit) - audit.count("D")) % 2
                continue
            letter = inserts()
            if letter != "D":
                turn(role if letter == "K" else "assistant" if (n + odd) % 2 else "user", text)
        if done:
            yield _hashes(done)
            done = []
    close()
    if done:
        yield _hashes(done)


def _hashes(done: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(v), pa.string()) for v in zip(*done)], ["conv", "repaired_sha256"])


def damaged(rows: DataFrame) -> DataFrame:
    """The rows (conv, turn, role, text) after the damage that the checksum of id and turn names."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(kind == 4, "user").otherwise(blank("role"))
    out = rows.select(conv_key().alias("conv"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    return out.where("kind <> 0").withColumn("copies", F.when(F.col("kind") == 3, 2).otherwise(1)).drop("kind")


def conv_key():
    return F.coalesce(F.concat(F.lit("#"), F.col("conv_id").cast("string")), F.lit(""))


#: Order of the rows of a conversation.
_ORDER = ["has_turn", "turn", "role", "digest"]


def _marked(rows: DataFrame) -> DataFrame:
    """Different rows of a conversation with their number, faults and letters.

    The letters of m equal rows: the first one's, then m - 1 that are forced out.
    """
    visible = r"[^\x20\x09-\x0D]"
    light = rows.withColumn("blank", ~F.col("text").rlike(visible)).withColumn("cut", ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"))
    light = light.groupBy("conv", "has_turn", "turn", "role", "digest", "blank", "cut").agg(F.sum("copies").cast("int").alias("m"))
    light = written(light, "turns")
    place = F.struct("has_turn", "turn")
    first = light.where(~F.col("blank")).groupBy("conv", "role", "digest").agg(F.min(place).alias("first"))
    marked = light.join(first, ["conv", "role", "digest"], "left").withColumn("again", ~F.col("blank") & (place > F.col("first")))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", _S).when(initial == "u", _U).when(initial == "a", _A).otherwise(_X)
    fault = F.when(F.col("blank") | F.col("again"), 2).when(F.col("cut"), 1).otherwise(0)
    letter = lambda f: F.substring(F.lit(CODES), f * 4 + role + 1, F.lit(1))
    return marked.withColumn("codes", F.concat(letter(fault), F.repeat(letter(F.lit(2)), F.col("m") - 1)))


def repair_turns(conversations: DataFrame) -> DataFrame:
    """Per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spark = conversations.sparkSession
    rows = damaged(conversations.select("conv_id", "turn", "role", "text"))
    rows = rows.withColumn("has_turn", F.col("turn").isNotNull()).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    marked = written(_marked(rows), "marked_turns")
    ones = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    kept_blank, again, m = F.col("blank"), F.col("again"), F.col("m")
    counts = marked.groupBy("conv").agg(
        ones(F.when(kept_blank, m).otherwise(0)).alias("blank"),
        ones(F.when(~kept_blank, m - 1 + again.cast("int")).otherwise(0)).alias("duplicate"),
        ones((F.col("cut") & ~kept_blank & ~again).cast("int")).alias("truncated"),
    )
    turns = marked.select("conv", "turn").distinct().groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    )
    parts = marked.repartitionByRange("conv", *_ORDER).sortWithinPartitions("conv", *_ORDER).select("conv", "codes")
    parts = parts.mapInArrow(_part_writer, "conv string, part int, seq bigint, codes string")
    whole = parts.groupBy("conv").agg(F.expr("array_join(transform(array_sort(collect_list(struct(part, seq, codes))), x -> x.codes), '') as codes"))
    repaired = written(whole.mapInArrow(_repairer, "conv string, cost bigint, audit string, illegal bigint"), "repairs")
    texts = rows.select("conv", F.lit(None).cast("string").alias("audit"), *_ORDER, "text", F.explode(F.expr("sequence(1, copies)")).alias("copy")).drop("copy")
    null = lambda t: F.lit(None).cast(t)
    heads = repaired.select("conv", "audit", null("boolean").alias("has_turn"), null("bigint").alias("turn"), null("string").alias("role"), null("binary").alias("digest"), null("string").alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stream = heads.unionByName(texts).repartition(n, "conv").sortWithinPartitions("conv", *_ORDER).select("conv", "audit", "role", "text")
    hashes = stream.mapInArrow(_hasher, "conv string, repaired_sha256 string")
    # All tables from here on have a row a conversation.
    out = conversations.select(conv_key().alias("conv"), "conv_id").distinct()
    for table in (turns, counts, repaired, hashes):
        out = out.join(table, "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op11_turn_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair_turns(spark.read.parquet(f"{sf}/conversations.parquet"))


def _sql() -> str:
    def edit(state: str, cost: str, letter: str) -> str:
        return f"printf('%06d', CAST({state}[1:6] AS INTEGER) + {cost}) || {state}[7:] || '{letter}'"

    def least(*options: str) -> str:
        return f"least({', '.join(options)})"

    def keep(state: str, initial: str) -> str:
        return f"CASE WHEN fault IN (0, 1) AND role[1:1] = '{initial}' THEN {edit(state, 'fault', 'K')} END"

    def rerole(state: str) -> str:
        return f"CASE WHEN fault IN (0, 1) THEN {edit(state, '2 + fault', 'R')} END"

    drop = [edit(f"v{q}", "3", "D") for q in range(4)]
    to_user = [f(f"v{q}", *a) for q in (0, 1, 3) for f, a in ((keep, "u"), (rerole, ""))]
    taken = f"""SELECT w.c, w.pos + 1 AS pos, {drop[0]} AS v0, {least(drop[1], keep("v0", "s"))} AS v1,
        {least(drop[2], *to_user)} AS v2, {least(drop[3], keep("v2", "a"), rerole("v2"))} AS v3
        FROM walk w JOIN turns t ON t.c = w.c AND t.pos = w.pos + 1"""
    opened = f"SELECT c, pos, v0, v1, {least('v2', *[edit(f'v{q}', '2', 'I') for q in (0, 1, 3)])} AS v2, v3 FROM ({taken})"
    closed = f"SELECT c, pos, v0, v1, v2, {least('v3', edit('v2', '2', 'I'))} AS v3 FROM ({opened})"
    step = "xor(xor(a, e) >> 1, (xor(a, e) & 1) * 3988292384)"
    bits = "flatten(list_transform(string_split(k, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), lambda a, e: {step}), 4294967295)"
    return f"""
WITH RECURSIVE source AS (
    SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
    FROM conversations
), kinds AS (SELECT *, {crc} % 20 AS kind FROM source),
hit AS (
    SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM kinds WHERE kind <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
        NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
        NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut
    FROM hit
), seen AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 AS again FROM placed),
turns AS MATERIALIZED (
    SELECT c, pos, turn, role, text, CASE WHEN blank THEN 3 WHEN again THEN 2 WHEN cut THEN 1 ELSE 0 END AS fault,
        lag(role) OVER (PARTITION BY c ORDER BY pos) AS role_before
    FROM seen
), walk AS (
    SELECT DISTINCT c, CAST(0 AS BIGINT) AS pos, '000000' AS v0, CAST(NULL AS VARCHAR) AS v1, '000002I' AS v2, '000004II' AS v3 FROM turns
    UNION ALL {closed}
), best AS (SELECT c, max_by(least(v0, v3), pos) AS best FROM walk GROUP BY c),
letters AS (
    SELECT c, best[7:] AS audit, unnest(range(1, length(best) - 5)) AS i FROM best
), spelled AS (
    SELECT c, i, audit[i:i] AS letter, length(replace(audit[1:i], 'I', '')) AS pos, length(replace(audit[1:i], 'D', '')) AS place,
        length(replace(audit, 'D', '')) % 2 AS odd
    FROM letters
), written AS (
    SELECT s.c, string_agg(
        CASE WHEN s.letter = 'K' THEN t.role WHEN (s.place + s.odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
        || CASE WHEN s.letter = 'I' THEN '' ELSE t.text END, chr(10) ORDER BY s.i) AS whole
    FROM spelled s LEFT JOIN turns t ON t.c = s.c AND t.pos = s.pos
    WHERE s.letter <> 'D' GROUP BY s.c
), counts AS (
    SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
        count(*) FILTER (pos > 1 AND role_before[1:1] || role[1:1] NOT IN ('su', 'ua', 'au')) AS illegal
    FROM turns GROUP BY c
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(best[1:6] AS BIGINT), 0) AS cost,
    coalesce(best[7:], '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM source) ids
LEFT JOIN counts USING (c) LEFT JOIN best USING (c) LEFT JOIN written USING (c)
"""


OP11_SQL = _sql()
