"""Exact dedup, near dedup, phrase removal and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from turnledger.llm import bagminhash, contamination, exact_dedup, phrase_automata
from turnledger.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def tokens(text):
    return [x.lower() for x in re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", text or "")]


# ---------------------------------------------------------------- exact


def test_exact_dedup_decisions(spark, table, odd):
    docs = table(odd, extra=True)
    index = exact_dedup.create_index(spark)
    exact_dedup.append_batch(docs, index, "one")
    exact_dedup.append_batch(docs, index, "one")  # a batch that is run again adds nothing
    got = {(r.doc_id, r.text, r._keep_id, r._group_size, r._kept) for r in exact_dedup.with_decisions(docs, index).collect()}
    groups = {}
    for i, t in odd:
        groups.setdefault(t or "", []).append(i)
    want = set()
    for i, t in odd:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want.add((i, t, keep, len(ids), i == keep))
    assert got == want


def test_exact_dedup_of_new_batches(spark, table):
    index = exact_dedup.create_index(spark, buckets=4)
    exact_dedup.append_batch(table([(1, "a"), (2, "b")]), index, "one")
    exact_dedup.append_batch(table([(3, "b"), (4, "c"), (5, "c")]), index, "two")
    got = {r.doc_id: (r._keep_id, r._kept) for r in exact_dedup.with_decisions(table([(3, "b"), (4, "c"), (5, "c")]), index).collect()}
    assert got == {3: (2, False), 4: (5, False), 5: (5, True)}
    plan = spark.table(index).join(table([(9, "z")]).selectExpr("unhex(sha2(text, 256)) digest").hint("merge"), "digest", "left_anti")
    assert "SelectedBucketsCount: 4 out of 4" in plan._jdf.queryExecution().toString()


def test_drop_copies_keeps_columns(table):
    docs = table([(1, "a"), (2, "a"), (2, "a"), (3, None), (4, "")], extra=True)
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 4]
    assert exact_dedup.drop_copies(table([])).count() == 0


# ---------------------------------------------------------------- near


def bag(text, size=5):
    t = tokens(text)
    if 0 < len(t) < size:
        return Counter([tuple(t)])
    return Counter(zip(*(t[i:] for i in range(size))))


def weighted_jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 0.0


def brute_classes(rows):
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or (bags[i] and weighted_jaccard(bags[i], bags[j]) >= 0.8):
                root[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(i)
    out = Counter()
    for own in members.values():
        ids = [rows[i][0] for i in own if rows[i][0] is not None]
        for i in own:
            out[(rows[i][0], min(ids) if ids else None, len(own))] += 1
    return out


def near_rows(seed=3):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(12):
        base = prose(rng, rng.choice([6, 40, 150])).split()
        for _ in range(rng.choice([1, 3, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            n += 1
            rows.append((n, " ".join(copy)))
    repeated = prose(rng, 10)
    rows += [(n + 1, " ".join([repeated] * 20)), (n + 2, " ".join([repeated] * 21)), (n + 3, " ".join([repeated] * 40))]
    return rows


def test_near_classes_equal_brute_force(table, odd):
    rows = near_rows() + [(i + 1000 if i is not None else i, t) for i, t in odd]
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in bagminhash.near_classes(table(rows, extra=True)).collect())
    assert got == brute_classes(rows)


def test_near_classes_of_empty_table(table):
    assert bagminhash.near_classes(table([])).count() == 0


def test_one_document_of_each_class_stays(table):
    rows = near_rows(5)
    out = bagminhash.drop_near_copies(table(rows))
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, c, _ in brute_classes(rows)})


def test_signature_agreement_is_the_weighted_similarity():
    """Share of equal registers over many pairs of weighted sets, within three deviations."""
    m = 2048
    for a, b in [({1: 1, 2: 1, 3: 1}, {1: 1, 2: 1, 4: 1}), ({1: 5, 2: 3}, {1: 3, 2: 7}), ({1: 9}, {1: 13}), ({1: 1, 2: 16}, {2: 11}), ({3: 6}, {3: 7})]:
        values = np.random.default_rng(0).integers(0, 1 << 63, 9, dtype=np.uint64)[[*a, *b]]
        rows = np.array([0] * len(a) + [1] * len(b))
        table = bagminhash.bag_signatures(values, rows, np.array([*a.values(), *b.values()]), 2, m)
        want = sum(min(a.get(x, 0), b.get(x, 0)) for x in a | b) / sum(max(a.get(x, 0), b.get(x, 0)) for x in a | b)
        assert abs((table[0] == table[1]).mean() - want) < 3.5 * (want * (1 - want) / m) ** 0.5 + 0.005


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    rows, weights = np.repeat(np.arange(30), 100), rng.integers(1, 9, 3000)
    whole = bagminhash.bag_signatures(values, rows, weights, 30)
    for r in range(0, 30, 7):
        own = rows == r
        assert (bagminhash.bag_signatures(values[own], rows[own] * 0, weights[own], 1)[0] == whole[r]).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (5, 4), (3, 9), *[(i, i + 1) for i in range(100, 140)]]
    got = {r["key"]: r["class"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 11: 10, 4: 4, 5: 4, **{i: 100 for i in range(100, 141)}}
    assert got == want


# ---------------------------------------------------------------- phrases


def brute_repeats(rows, size=20):
    """Rows of one id and text are one document; null ids come first."""
    distinct = sorted({(-1 if i is None else i, t or "") for i, t in rows})
    seen, out = set(), {}
    for i, t in distinct:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = set()
        for p in range(len(words) - size + 1):
            w = tuple(words[p : p + size])
            if w in seen:
                gone.update(range(p, p + size))
            seen.add(w)
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        out[i, t] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return Counter((i, *out[-1 if i is None else i, t or ""]) for i, t in rows)


def phrase_rows(seed=1):
    rng = random.Random(seed)
    shared = [prose(rng, n) for n in (19, 20, 21, 60)]
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(shared), prose(rng, rng.randrange(0, 30))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(50, rows[3][1]), (51, rows[3][1] + " tail"), (52, "a b " * 60), (53, "z " * 25)]
    return rows


def phrase_result(docs):
    return Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in phrase_automata.without_repeats(docs).collect())


def test_phrases_equal_brute_force(table, odd):
    rows = phrase_rows() + [(i + 100 if i is not None else i, t) for i, t in odd]
    assert phrase_result(table(rows, extra=True)) == brute_repeats(rows)
    assert phrase_result(table([])) == Counter()


def test_phrases_of_split_owners(table, monkeypatch):
    """Frequent anchors are dealt over shards by document and merged."""
    monkeypatch.setattr(phrase_automata, "SPLIT_AT", 3)
    rows = phrase_rows(2)
    assert phrase_result(table(rows)) == brute_repeats(rows)


def test_phrases_of_many_rows_without_id_or_of_one_id(table):
    """Such rows are documents of their own: nothing gathers all of them, one keeps the passage."""
    shared = " ".join(f"s{j}" for j in range(60))
    rows = [(i, f"{n}a {n}b {shared} {n}c") for n, i in enumerate([None] * 5000 + [7] * 5000)]
    got = phrase_automata.without_repeats(table(rows + [(7, "same " + shared)] * 3000)).collect()
    assert len(got) == 13000 and all(r.n_removed in (0, 60) for r in got)
    assert [r.doc_id for r in got if r.n_removed == 0] == [None]


def test_phrases_in_small_pieces(table, spark, monkeypatch):
    rows = phrase_rows(4)
    pieces = []
    whole = phrase_automata._resolve
    import pyarrow as pa

    monkeypatch.setattr(phrase_automata, "PIECE_WORDS", 50)
    monkeypatch.setattr(phrase_automata, "_resolve", lambda piece: pieces.append(len(piece)) or whole(piece))
    rows = [(o, 1, 0, d, 0, 0, b" ".join(b"%d-%d" % (o, i) for i in range(21))) for o in range(4) for d in (o, o + 9)]
    columns = [pa.array(c) for c in zip(*rows)]
    batch = pa.RecordBatch.from_arrays(columns, ["owner", "split", "shard", "doc", "key", "start", "words"])
    marks = [tuple(r.values())[:4] for b in phrase_automata._shard_marks(iter([batch])) for r in b.to_pylist()]
    assert len(pieces) > 1 and sum(pieces) == len(rows)
    assert marks == [(o + 9, 0, 0, 21) for o in range(4)]


# ---------------------------------------------------------------- contamination


def brute_contained(rows, items):
    out = Counter()
    for i, t in rows:
        own = set(bag(t)) if len(tokens(t)) >= 5 else set()
        for n, text in items:
            want = set(bag(text)) if len(tokens(text)) >= 5 else set()
            if want and len(want & own) >= 0.8 * len(want) - 1e-9:
                out[i, n, len(want), len(want & own)] += 1
    return out


def test_contamination_equals_brute_force(spark, table, odd):
    rng = random.Random(8)
    items = [(n, prose(rng, k)) for n, k in enumerate([5, 7, 16, 20, 36, 60, 130, 3])] + [(None, "only four words here"), (99, None)]
    rows = [(i, prose(rng, rng.randrange(0, 900))) for i in range(30)]
    for k in range(30, 60):
        item = rng.choice(items[:7])[1].split()
        if k % 3 == 0:
            item[rng.randrange(len(item))] = "changed"
        cut = rng.randrange(len(item)) if k % 4 == 0 else 0
        text = prose(rng, 300).split()
        rows.append((k, " ".join([*text[:150], *item[:cut], *text[150:200], *item[cut:], *text[200:]]).upper()))
    rows += odd
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.item_shingles, r.shared_shingles) for r in contamination.contained_items(table(rows, extra=True), asked).collect())
    assert got == brute_contained(rows, items)
    assert contamination.contained_items(table([]), asked).count() == 0
    assert contamination.contained_items(table(rows), asked.limit(0)).count() == 0


def test_items_in_several_blocks(spark, table, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 500)
    rng = random.Random(9)
    items = [(n, prose(rng, 30)) for n in range(10)]
    rows = [(n, f"before {t} after") for n, t in items]
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contamination.contained_items(table(rows), asked).collect()}
    assert got == {(n, n) for n in range(10)}
    clean = contamination.drop_contaminated(table([*rows, (77, "clean text of six words here"), (None, None)]), asked)
    assert sorted(str(r.doc_id) for r in clean.collect()) == ["77", "None"]


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_warc", "op5_substring_dedup", "op6_exact_dedup", "op10_near_dedup"])
def test_queries_equal_sql(spark, name):
    import check_queries
    import duckdb

    con = duckdb.connect()
    for t in check_queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    message, _, good = check_queries.compare(spark, con, name, "/root/testdata/sf0.001")
    assert good, message


def test_rows_of_one_id_are_decided_one_by_one(table):
    from turnledger.llm.bagminhash import drop_near_copies
    from turnledger.llm.contamination import drop_contaminated

    text = "some words that stand here in a row and then go on for quite a while longer than that, " * 3
    other = "another text of this id which shares nothing at all with those before it in the table"
    near = drop_near_copies(table([(1, text), (2, text + "z"), (2, other), (None, text)], extra=True))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in near.collect()) == [(0, text), (1, text), (2, other)]
    twice = drop_near_copies(table([(4, text), (4, text + "z"), (4, other)]))
    assert sorted(r["text"] == other for r in twice.collect()) == [False, True]
    items = table([(7, text)]).withColumnRenamed("doc_id", "item_id")
    clean = drop_contaminated(table([(2, text), (2, other), (None, text), (None, None)], extra=True), items)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in clean.collect()) == [(0, ""), (2, other)]
    assert clean.columns[0] == "doc_id" and "score" in clean.columns
