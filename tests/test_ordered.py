"""Ordered scans against plain Python, with blocks far smaller than the data."""

import random

import pytest

from turnledger.operators import pack, skew
from turnledger.operators.chain import trusted_prefix
from turnledger.operators.state_log import (
    latest_state,
    node_fingerprints,
    last_seq,
    state_at,
    state_fingerprints,
    state_versions,
)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for key in "abc":
        for order in sorted(rng.sample(range(200), 60)):
            out.append((key, order, rng.choice([None, rng.randrange(100)]), rng.randrange(1 << 40)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, o bigint, v int, x bigint").repartition(4)


def by_key(rows):
    for key in sorted({r[0] for r in rows}):
        yield key, [r for r in rows if r[0] == key]


def test_ordinal_and_previous(spark, rows):
    got = {(r.k, r.o): r.ordinal for r in skew.ordinal(frame(spark, rows), ["k"], "o", size=7).collect()}
    prev = {(r.k, r.o): r.p for r in skew.previous_row(frame(spark, rows), ["k"], "o", {"p": "o"}, 7).collect()}
    for key, group in by_key(rows):
        before = None
        for n, row in enumerate(group):
            assert got[(key, row[1])] == n + 1
            assert prev[(key, row[1])] == before
            before = row[1]


@pytest.mark.parametrize("backward", [False, True])
def test_last_known(spark, rows, backward):
    got = {(r.k, r.o): r.w for r in skew.last_known(frame(spark, rows), ["k"], "o", "v", "w", 7, backward).collect()}
    for key, group in by_key(rows):
        seen = None
        for row in reversed(group) if backward else group:
            seen = row[2] if row[2] is not None else seen
            assert got[(key, row[1])] == seen


def test_running_xor(spark, rows):
    got = {(r.k, r.o): r.x for r in skew.running_xor(frame(spark, rows), ["k"], "o", ["x"], 7).collect()}
    for key, group in by_key(rows):
        acc = 0
        for row in group:
            acc ^= row[3]
            assert got[(key, row[1])] == acc


def test_last_before(spark, rows):
    points = spark.createDataFrame(
        [(k, i, None if i == 9 else i * 23) for k in "abcd" for i in range(10)], "k string, i int, at bigint"
    )
    got = {(r.k, r.i): r.hit for r in skew.last_before(points, frame(spark, rows), ["k"], "at", "o", {"hit": "o"}, 7).collect()}
    assert len(got) == 40
    for key in "abcd":
        orders = [r[1] for r in rows if r[0] == key]
        for i in range(10):
            below = [o for o in orders if i == 9 or o < i * 23]
            assert got[(key, i)] == (max(below) if below else None)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_pairs_each_row_once(spark, how):
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(200)], "k string, i int")
    small = spark.createDataFrame([("hot", 1), ("k3", 2), ("k9", 3)], "k string, s int")
    from pyspark.sql import functions as F

    salted = skew.salted_join(big, small, ["k"], [F.col("i")], how, 5)
    plain = big.join(small, ["k"], how)
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.select(*salted.columns).collect()))


# ---------------------------------------------------------------- chain


def walk(positions, nodes, prompt, dep):
    """The trusted prefix of one scope in plain Python."""
    strict = lineage = ""
    ok = lin = True
    out = {}
    for index, floor, body in positions:
        mine = sorted((n for n in nodes if n["floor_id"] == floor), key=lambda n: (n["created_at"], n["state_node_id"]), reverse=True)
        s = next((n for n in mine if n["dependency_fingerprint"] == dep(body, strict, prompt)), None) if ok else None
        l = next((n for n in mine if (n["previous_state_fingerprint"] or "") == lineage), None) if lin else None
        ok, lin = s is not None, l is not None
        shown = s or l or (mine[0] if mine else None)
        out[index] = (shown and shown["state_node_id"], ok, lin)
        strict, lineage = (s["state_fingerprint"] if s else strict), (l["state_fingerprint"] if l else lineage)
    return out


def test_trusted_prefix_matches_a_plain_walk(spark):
    import hashlib

    from pyspark.sql import functions as F

    def dep(body, previous, prompt):
        text = "\n".join([body, previous, "1", "1", prompt])
        return "sha256:" + hashlib.sha256(text.encode()).hexdigest()

    rng = random.Random(11)
    positions, nodes, want = [], [], {}
    for c in range(12):
        chat, mine, made, states = f"c{c}", [], [], [""]
        for index in range(0, 40, 2):
            floor, body = f"{chat}f{index}", f"b{rng.randrange(3)}"
            mine.append((index, floor, body))
            now = []
            for n in range(rng.choice([1, 1, 2, 3]) if rng.random() > 0.02 else 0):
                previous = rng.choice(states)
                state = f"s{rng.randrange(2)}@{index}"
                now.append(state)
                made.append(
                    {
                        "chat_id": chat, "branch_id": "b", "floor_id": floor, "message_index": index,
                        "state_node_id": f"{floor}n{n}", "previous_state_fingerprint": previous or None,
                        "dependency_fingerprint": dep(body, previous, "p1" if rng.random() > 0.03 else "p0"),
                        "state_fingerprint": state, "created_at": rng.randrange(5),
                    }
                )
            # Cover every earlier state, so that most chains go on for a while.
            for previous in states if rng.random() > 0.05 else []:
                made.append(
                    {
                        "chat_id": chat, "branch_id": "b", "floor_id": floor, "message_index": index,
                        "state_node_id": f"{floor}x{len(made)}", "previous_state_fingerprint": previous or None,
                        "dependency_fingerprint": dep(body, previous, "p1"),
                        "state_fingerprint": rng.choice(now or ["t"]), "created_at": rng.randrange(5),
                    }
                )
            states = sorted({n["state_fingerprint"] for n in made if n["floor_id"] == floor}) or states
        positions += [(chat, "b", i, f, b, "synced") for i, f, b in mine]
        nodes += made
        want.update({(chat, i): v for i, v in walk(mine, made, "p1", dep).items()})
    p = spark.createDataFrame(positions, "chat_id string, branch_id string, message_index bigint, floor_id string, body_fingerprint string, status string")
    schema = "chat_id string, branch_id string, floor_id string, message_index bigint, state_node_id string, previous_state_fingerprint string, dependency_fingerprint string, state_fingerprint string, created_at int"
    n = spark.createDataFrame([tuple(x[f.split()[0]] for f in schema.split(", ")) for x in nodes], schema)
    for fold_size, levels in ((3, 2), (5, 1), (4096, 0)):
        got = trusted_prefix(p, n, F.lit("p1"), 7, fold_size, levels).collect()
        assert {(r.chat_id, r.message_index): (r.state_node_id, r.valid, r.lineage_valid) for r in got} == want
    assert 20 < sum(v[1] for v in want.values()) < len(want)


# ---------------------------------------------------------------- state log

LOG = "chat_id string, branch_id string, seq bigint, op string, path string, kind string, value string"


def random_log(seed, steps=60):
    rng = random.Random(seed)
    doc, log, history = {}, [], {}
    for seq in range(steps):
        kind = rng.choice(["set", "set", "object", "remove"])
        top, leaf = rng.choice("ab"), rng.choice("xy")
        if kind == "set":
            if not isinstance(doc.get(top), dict):
                doc[top] = {}
                log.append((seq, "replace", f"/{top}", "object", None))
            doc[top][leaf] = str(seq % 5)
            log.append((seq, "replace", f"/{top}/{leaf}", "value", str(seq % 5)))
        elif kind == "object":
            doc[top] = {leaf: "new"}
            log.append((seq, "replace", f"/{top}", "object", None))
            log.append((seq, "replace", f"/{top}/{leaf}", "value", "new"))
        elif top in doc:
            if rng.random() < 0.5 and leaf in doc[top]:
                del doc[top][leaf]
                log.append((seq, "remove", f"/{top}/{leaf}", None, None))
            else:
                del doc[top]
                log.append((seq, "remove", f"/{top}", None, None))
        history[seq] = {k: dict(v) for k, v in doc.items()}
    return log, history


def rows_of(doc):
    out = set()
    for top, members in doc.items():
        out.add((f"/{top}", "object", None))
        out |= {(f"/{top}/{leaf}", "value", v) for leaf, v in members.items()}
    return out


def test_log_replay_equals_sequential_patching(spark):
    events, histories = [], {}
    for c in range(6):
        log, histories[f"c{c}"] = random_log(c)
        events += [(f"c{c}", "b", *e) for e in log]
    log = spark.createDataFrame(events, LOG).repartition(3)
    ends = {k: h[max(h)] for k, h in histories.items()}
    final = latest_state(log).collect()
    versions = state_versions(log, 9)
    points = spark.createDataFrame(
        [(c, "b", str(s), s) for c in histories for s in range(0, 60, 7)],
        "chat_id string, branch_id string, query_id string, at_seq bigint",
    )
    shots = state_at(versions, points, last_seq(log), 8).collect()
    floors = spark.createDataFrame([(c, "b", s) for c in histories for s in range(60)], "chat_id string, branch_id string, seq bigint")
    running = {(r.chat_id, r.seq): r.state_fingerprint for r in node_fingerprints(versions, floors, 9).collect()}
    whole = spark.createDataFrame(
        [(c, s, *row) for c, h in histories.items() for s in h for row in rows_of(h[s])],
        "chat_id string, seq int, path string, kind string, value string",
    )
    direct = {(r.chat_id, r.seq): r.state_fingerprint for r in state_fingerprints(whole, ["chat_id", "seq"]).collect()}
    for c, history in histories.items():
        assert {(r.path, r.kind, r.value) for r in final if r.chat_id == c} == rows_of(ends[c])
        for s in range(0, 60, 7):
            here = {(r.path, r.kind, r.value) for r in shots if r.chat_id == c and r.query_id == str(s)}
            assert here == rows_of(history[s]), (c, s)
        for s in history:
            if history[s]:
                assert running[(c, s)] == direct[(c, s)]


def test_re_added_object_does_not_bring_back_its_members(spark):
    rows = [
        (0, "replace", "/a", "object", None), (0, "replace", "/a/x", "value", "1"),
        (1, "replace", "/a/y", "value", "2"), (2, "remove", "/a", None, None),
        (3, "replace", "/a", "object", None), (3, "replace", "/a/y", "value", "3"),
        (4, "remove", "/a/y", None, None),
    ]
    log = spark.createDataFrame([("c", "b", *r) for r in rows], LOG)
    assert [(r.path, r.kind) for r in latest_state(log).collect()] == [("/a", "object")]


# ---------------------------------------------------------------- packing


def test_pack_skips_what_does_not_fit_and_goes_on(spark):
    options = pack.PackOptions(max_count=3, token_limit=30, header="[H]\n\n")
    items = [("m1", "x" * 40), ("m2", "y" * 400), ("m3", "记忆" * 3), ("m4", "z"), ("m5", "late")]
    rows = [("c", "b", "q", i + 1, "high_relevance", m, 10 - i, 10 - i, None, t, 30.0) for i, (m, t) in enumerate(items)]
    schema = "chat_id string, branch_id string, query_id string, ord int, source string, memory_id string, start_floor int, end_floor int, title string, summary string, budget double"
    got = pack.pack(spark.createDataFrame(rows, schema), options).first()
    taken, text = [], ""
    for i, (m, t) in enumerate(items):
        block = f"[记忆 {10 - i}-{10 - i}]\n{t}"
        trial = options.header + "\n\n".join(b for _, b in sorted([*taken, (10 - i, block)]))
        cjk = sum(1 for ch in trial if "\u4e00" <= ch <= "\u9fff")
        if len(taken) < 3 and cjk + -(-(len(trial) - cjk) // 4) <= 30:
            taken.append((10 - i, block))
            text = trial
    assert got.text == text
    assert len(got.memory_ids) == got.packed_count == len(taken)
    assert got.skipped_by_token_budget + got.skipped_by_count + got.packed_count == 5
