"""Documents of any depth: rows and topmost changes by one pass over canonical text."""

import json
import random

import pytest

from turnledger.operators import state_log

TEXTS = ["", "x", "a/b", "~", 'q"{', "é\n", "\\", "[1]"]


def random_document(rng, depth):
    kind = rng.randrange(4) if depth else 3
    if kind < 2:
        return {rng.choice(TEXTS + ["k", "l"]): random_document(rng, depth - 1) for _ in range(rng.randrange(4))}
    if kind == 2:
        return [random_document(rng, depth - 1) for _ in range(rng.randrange(3))]
    return rng.choice([None, True, 0, 1, 2.5, *TEXTS])


def changed(rng, value):
    if isinstance(value, dict) and value:
        out = dict(value)
        name = rng.choice(list(out))
        if rng.random() < 0.2:
            del out[name]
        else:
            out[name] = changed(rng, out[name])
        return out
    return rng.choice([value, {"new": {"er": 1}}, 7, [value]])


def nested(levels, leaf):
    return '{"k":' * levels + leaf + "}" * levels


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("expand", [False, True])
def test_both_ways_to_open_documents_agree(spark, monkeypatch, expand):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, json.dumps(random_document(rng, 5))) for i in range(60)], "id int, doc string")
    native = rows_of(state_log.flatten_documents(docs, ["id"], "doc", 7, expand))
    for depth in (0, 2):
        monkeypatch.setattr(state_log, "NATIVE_DEPTH", depth)
        monkeypatch.setattr(state_log, "ROWS_OUT", 3)
        assert rows_of(state_log.flatten_documents(docs, ["id"], "doc", None, expand)) == native


def test_changes_by_digests_equal_changes_of_rows(spark):
    rng = random.Random(9)
    pairs = []
    for i in range(80):
        old = random_document(rng, 5)
        new = changed(rng, changed(rng, old)) if i % 4 else random_document(rng, 4)
        pairs.append((i, json.dumps(old), json.dumps(new, indent=i % 2 or None)))
    pairs += [(100, None, '{"a":1}'), (101, '{"a":{"b":1}}', None), (102, None, None), (103, "no json", "[1]"), (103, "{}", "{}")]
    df = spark.createDataFrame(pairs, "id int, old string, new string")
    one_each = df.filter("id < 103")
    sides = [state_log.flatten_documents(one_each, ["id"], c, 7) for c in ("old", "new")]
    want = rows_of(state_log.diff_documents(*sides, ["id"]))
    got = rows_of(state_log.diff_texts(df, ["id"], "old", "new"))
    assert [r for r in got if r[0] < 103] == want and len(want) > 60
    assert [r[1:] for r in got if r[0] == 103] == [("add", "", None, None, "value", "[1]")]
    assert state_log.diff_texts(df.limit(0), ["id"], "old", "new").collect() == []


def test_five_hundred_levels(spark):
    df = spark.createDataFrame([(1, nested(500, "1"), nested(500, "2")), (2, "{}", '{"a":0}')], "id int, old string, new string")
    assert rows_of(state_log.diff_texts(df, ["id"], "old", "new")) == [
        (1, "replace", "/k" * 500, "value", "1", "value", "2"),
        (2, "add", "/a", None, None, "value", "0"),
    ]
    opened = state_log.flatten_documents(df, ["id"], "old").filter("id = 1").collect()
    assert len(opened) == 501 and sum(r.kind == "object" for r in opened) == 500
