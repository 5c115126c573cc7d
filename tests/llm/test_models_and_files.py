"""Models, token files, archives, sampling and pseudonyms against brute force and round trips."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter
from datetime import date, timedelta

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnledger.llm import ngram_filter, piece_sampling, pseudonyms, token_files, toxicity, warc
from turnledger.llm.stages import fresh_path
from turnledger.llm.text_arrays import PLAIN, chunked_words, text_buffer

BAD = ["vilest", "rotten", "filthy"]
WORDS = [f"w{i}" for i in range(300)]
PIECES = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- toxicity


def toxic_rows(n=400, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        toxic = int(i % 5 == 0)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD).upper()
        rows.append((i, " ".join(words), "en" if i % 2 else "fr"))
        labels.append((i, toxic))
    return rows, labels


def test_toxicity_of_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels[:300], "doc_id long, toxic int")
    net = toxicity.train(docs, known)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, net).collect()}
    held = [(got[i], y) for i, y in labels[300:]]
    assert min(s for s, y in held if y) > max(s for s, y in held if not y)
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, y in labels if not y}


def test_language_and_id_do_not_enter_a_score(spark):
    rows, labels = toxic_rows(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    other = docs.selectExpr("doc_id + 1000 doc_id", "text", "'xx' lang")
    one = {r.doc_id: r.score for r in toxicity.scored(docs, net).collect()}
    two = {r.doc_id - 1000: r.score for r in toxicity.scored(other, net).collect()}
    assert one == two


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    """The sample's texts do not come to the driver; the network is that of a local fit."""
    rows, labels = toxic_rows(200)
    docs = spark.createDataFrame([(*r[:2], "en") for r in rows], "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    order = [r.doc_id for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    text, toxic = {r[0]: r[1] for r in rows}, dict(labels)
    used = [i for n, i in enumerate(order) if n % 5 != 4]
    local = toxicity.fit(toxicity._slots_of(pa.array([text[i] for i in used])), np.array([toxic[i] for i in used]))

    fit, driver = toxicity.fit, os.getpid()

    def elsewhere(*sample):
        assert os.getpid() != driver
        return fit(*sample)

    monkeypatch.setattr(toxicity, "fit", elsewhere)
    net = toxicity.train(docs, known)
    assert np.allclose(net.embedding, local.embedding) and np.allclose(net.out, local.out) and net.thresholds


def test_toxicity_of_odd_rows(spark, odd):
    rows, labels = toxic_rows(100)
    docs = spark.createDataFrame([*rows, *[(i, t, None) for i, t in odd]], "doc_id long, text string, lang string")
    net = toxicity.train(docs, spark.createDataFrame([*labels, (4, None)], "doc_id long, toxic int"))
    scores = [r.score for r in toxicity.scored(docs, net).collect()]
    assert len(scores) == len(rows) + len(odd) and all(0 <= s <= 1 for s in scores)
    for known in ([], [(1, 0), (2, 0)], [(1, 1)]):
        net = toxicity.train(docs, spark.createDataFrame(known, "doc_id long, toxic int"))
        assert {r.score for r in toxicity.scored(docs, net).collect()} == {float(bool(known and known[0][1]))}
    assert toxicity.scored(docs.limit(0), net).count() == 0


def test_thresholds_see_all_labelled_rows(spark):
    """A language with many labels has its own threshold, however small the fitted sample."""
    rows, labels = toxic_rows(1200)
    rows = [(i, text, "de" if i % 4 == 3 else "en") for i, text, *_ in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.train(docs, known, sample=60)
    assert set(net.thresholds) == {None, "en", "de"}
    toxic = dict(labels)
    scores = [(r.score, toxic[r.doc_id], r.lang) for r in toxicity.scored(docs, net).collect()]

    def f1(cut, lang):
        own = [(s >= cut, y) for s, y, at in scores if at == lang]
        return 2 * sum(p and y for p, y in own) / max(1, sum(p + y for p, y in own))

    for lang in ("en", "de"):
        best = max(f1(s, lang) for s, _, at in scores if at == lang)
        assert f1(net.thresholds[lang], lang) > best - 0.05


# ---------------------------------------------------------------- language model


def lm_tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def check_base_scores(spark, docs, rows, train_rows):
    model, vocabulary = ngram_filter.train(train_rows)
    counts = Counter(w for r in train_rows.collect() for w in lm_tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    got = Counter(
        (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in ngram_filter.scores(docs, model, vocabulary).collect()
    )
    want = Counter()
    for i, t in rows:
        ws = lm_tokens(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        want[i, len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 6)] += 1
    assert got == want


@pytest.mark.parametrize("frequent", [1 << 19, 5, 0])
def test_base_scores_equal_brute_force(spark, table, odd, monkeypatch, frequent):
    monkeypatch.setattr(ngram_filter, "FREQUENT", frequent)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 80))).title()) for i in range(20, 60)] + odd
    docs = table(rows, extra=True)
    check_base_scores(spark, docs, rows, docs.filter("doc_id is null or doc_id % 7 <> 2").select("text"))


def test_base_scores_without_training(spark, table):
    docs = table([(1, "a b"), (2, None)])
    check_base_scores(spark, docs, [(1, "a b"), (2, None)], docs.limit(0).select("text"))
    check_base_scores(spark, docs.limit(0), [], docs.select("text"))


def test_filter_gives_levels_of_counts():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    counts = np.maximum(1, (rng.pareto(1.0, 5000) * 3)).astype(np.int64)
    low = keys & np.uint64((1 << 40) - 1)
    levels = ngram_filter.level_of(counts)
    size = int(levels.sum() * ngram_filter.BITS_PER_LEVEL / 8) + 1
    bits = np.frombuffer(ngram_filter.fill_part(low, levels, size), np.uint8)
    read = ngram_filter.CountFilter(bits, 0, size).counts(keys)
    exact = ngram_filter._MIDDLE[levels]
    assert (read >= exact).all() and (read == exact).mean() > 0.95
    absent = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert (ngram_filter.CountFilter(bits, 0, size).counts(absent) > 0).mean() < 0.03
    assert np.all(np.abs(np.log(exact / counts)) <= np.log(ngram_filter.BASE) + 1e-9)


def test_pairs_of_training_text_are_likelier(spark, table):
    rng = random.Random(4)
    text = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(30)]
    model, vocabulary = ngram_filter.train(table(list(enumerate(text))).select("text"))
    new = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(5)]
    got = {r.doc_id: r for r in ngram_filter.scores(table([(0, text[0]), *[(100 + i, t) for i, t in enumerate(new)]]), model, vocabulary).collect()}
    assert all(r.score < 0 for r in got.values())
    assert got[0].score > got[0].base_score and all(got[0].score > got[100 + i].score for i in range(5))


@pytest.mark.parametrize("part", [1 << 21, 1 << 9])
def test_all_pairs_are_stored_at_any_size(spark, table, monkeypatch, part):
    """Pairs seen once and all words count, whatever the bytes of the filters and their parts."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(300))) for i in range(40)]
    for name, value in (("PAIR_BYTES", 512), ("WORD_BYTES", 64), ("PART_TOKENS", part), ("ASKED", 1000)):
        monkeypatch.setattr(ngram_filter, name, value, raising=False)
    model, vocabulary = ngram_filter.train(table(rows[:30]).select("text"))
    got = {r.doc_id: r.score for r in ngram_filter.scores(table(rows), model, vocabulary).collect()}
    words, pairs = Counter(), Counter()
    for _, text in rows[:30]:
        tokens = lm_tokens(text)
        words.update(tokens)
        pairs.update(zip([tokens[-1], *tokens], tokens))
    middle = lambda n: ngram_filter._MIDDLE[ngram_filter.level_of(np.array([n]))[0]] if n else 0.0
    unit = words.total() + len(words) + 1.0
    for i, text in rows:
        tokens, want = lm_tokens(text), 0.0
        for a, b in zip([tokens[-1], *tokens], tokens):
            seen = middle(words[a])
            share = min(middle(pairs[a, b]), seen) / max(seen, 1.0)
            want += math.log10(0.4 * share + 0.6 * min(1.0, (middle(words[b]) + 1) / unit))
        # False positives of the filters move few tokens; a lost pair costs about 1 each.
        assert abs(got[i] - want) < 0.08 * len(tokens), (i, got[i], want)


# ---------------------------------------------------------------- token files


def test_token_files_equal_whole_texts(spark, table, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(3)
    extra = ["It's DON'T rock'n'roll, 3.14 <|endoftext|> a<|b", "Ünïcode ÀÉ é  x y ﬁ İ ß", "semi;colon:end!? -- ...", "a.b.c,d"]
    rows = [(i, t) for i, t in enumerate(extra, 200)] + [(i, " ".join(rng.choice(WORDS) for _ in range(900))) for i in range(300, 310)] + odd
    docs = table(rows, extra=True)
    folder = fresh_path(spark, "tokens")
    manifest = token_files.write_tokens(docs, folder, VOCABULARY)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_tokens(manifest, folder).collect()]
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r[0], r[2], r[3]) for r in got) == want
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()


def test_token_sequences_are_views(spark, table):
    docs = table([(i, "alpha beta gamma " * 700) for i in range(4)])
    folder = fresh_path(spark, "tokens")
    files = token_files.write_tokens(docs.coalesce(1), folder, VOCABULARY).filter("tokens > 0").collect()
    system, path = warc.open_folder(folder)
    for row in files:
        file = token_files.TokenFile(system, f"{path}/{row.file}")
        total = sum(file.docs["n_tokens"].to_pylist())
        whole = np.concatenate(list(file.pieces(0, total)))
        used = 0
        for n in range(-(-total // token_files.LENGTH)):
            ids, mask = file.sequence(n)
            assert len(ids) == len(mask) == token_files.LENGTH and not ids.flags.owndata
            assert (ids[mask] == whole[used : used + mask.sum()]).all()
            used += int(mask.sum())
        assert used == total
    empty = token_files.write_tokens(docs.limit(0), fresh_path(spark, "tokens"), VOCABULARY)
    assert token_files.read_tokens(empty, folder).count() == 0


# ---------------------------------------------------------------- WARC


def test_url_keys():
    assert warc.url_key("http://www.Example.org:80/a?b=1#c") == "org,example)/a?b=1"
    assert warc.url_key("https://x.y.com:8443") == "com,y,x:8443)/"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


def page_rows():
    rows = [(i, f"http://h{i % 7}.example.org/p{i % 40}", f"<p>{i % 50} é</p>" * (i % 5)) for i in range(300)]
    return rows + [(None, "http://h1.example.org/p1", "<p>null id</p>"), (400, None, None), (401, "http://[bad", "x"), (7, "http://again.org/", "x y"), (7, "http://again.org/", "x y")]


def test_archives_read_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 20)
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' key", "1 at")
    folder = fresh_path(spark, "warc")
    captures = warc.write_archives(pages, folder)
    parts = warc.write_index(captures, folder)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload_ok) for r in warc.read_captures(captures.select("url_key").distinct(), folder, parts).collect())
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter()
    for i, _, h in rows:
        body, keep = (h or "").encode(), first.get(h or "")
        response = i == keep
        want[i, len(body), warc.payload_digest(body), "response" if response else "revisit", None if response else keep, True] += 1
    assert got == want

    # One key through the directory, and keys that are not there.
    held = [(r.first_key, r.file) for r in parts.collect()]
    reader = warc.CaptureReader(folder, held)
    want = sorted(i for i, u, _ in rows if u == "http://h3.example.org/p3" and i is not None)
    assert sorted(c[0] for c in reader.captures("org,example,h3)/p3")) == want
    assert not list(reader.captures("org,example,h3)/p")) and not list(reader.captures("zzz"))


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    folder = fresh_path(spark, "warc")
    captures = warc.write_archives(pages, folder, min_revisit=5)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_captures(captures.select("url_key").distinct(), folder, warc.write_index(captures, folder)).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}
    nothing = warc.write_archives(pages.limit(0), fresh_path(spark, "warc"))
    assert nothing.count() == 0 and warc.write_index(nothing, folder).count() == 0


# ---------------------------------------------------------------- SentencePiece


def segmentations(vocabulary, text):
    names = {vocabulary.model.id_to_piece(int(i)).replace("▁", " "): vocabulary.weights[n] for n, i in enumerate(vocabulary.ids[: vocabulary.pieces])}
    out = {}

    def go(at, done, weight):
        if at == len(text):
            out[tuple(done)] = weight
            return
        for end in range(at + 1, len(text) + 1):
            if " " in text[at + 1 : end]:
                break
            if text[at:end] in names:
                go(end, [*done, text[at:end]], weight + names[text[at:end]])

    go(0, [], 0.0)
    total = np.logaddexp.reduce(list(out.values()))
    return {k: v - total for k, v in out.items()}


def draws(vocabulary, text, n, k):
    data, offsets = text_buffer(pa.array([text] * n))
    found = piece_sampling.sample_chunk(vocabulary, data, offsets, np.arange(n), k)
    name = lambda ids: tuple(vocabulary.model.id_to_piece(int(x)).replace("▁", " ") for x in ids)
    return found, [[name(ids[first[i] : first[i + 1]]) for i in range(n)] for _, _, _, ids, first in found]


def test_samples_follow_the_lattice():
    vocabulary = piece_sampling.Vocabulary.of(PIECES)
    n, k = 6000, 3
    for text in (" nt", " on e", " ab"):
        exact = segmentations(vocabulary, text)
        found, named = draws(vocabulary, text, n, k)
        sets = list(zip(*named))
        assert all(len(set(s)) == k for s in sets)
        assert all(abs(found[j][1][i] - exact[named[j][i]]) < 1e-9 for j in range(k) for i in range(200))
        p = {x: math.exp(v) for x, v in exact.items()}
        first, pair = Counter(named[0]), Counter(zip(named[0], named[1]))
        for x in p:
            assert abs(first[x] / n - p[x]) < 5 * (p[x] * (1 - p[x]) / n) ** 0.5 + 0.002
        for x, y in list(pair)[:6]:
            want = p[x] * p[y] / (1 - p[x])
            assert abs(pair[x, y] / n - want) < 5 * (want * (1 - want) / n) ** 0.5 + 0.002
        # Inclusion scores weigh the samples without bias.
        weight = sum(np.exp(found[j][1] - found[j][2]) for j in range(k))
        assert abs(weight.mean() - 1) < 0.05


def test_all_segmentations_when_few():
    vocabulary = piece_sampling.Vocabulary.of(PIECES)
    exact = segmentations(vocabulary, " a")
    found, named = draws(vocabulary, " a", 3, 5)
    count = sum(int(exists[0]) for exists, *_ in found)
    assert count == len(exact) == len({named[j][0] for j in range(count)})
    assert all(found[j][2][0] == 0 for j in range(count))


def test_samples_decode_to_the_text(spark, table, odd):
    rows = [(i + 10 if i is not None else i, t) for i, t in odd] + [(100, "Hello  world\n\tnaïve façade 漢字😀"), (101, "▁x")]
    docs = table(rows, extra=True)
    out = piece_sampling.decoded(piece_sampling.sampled(docs, PIECES, k=2), PIECES).collect()
    texts = {i: (t or "").replace("▁", " ") for i, t in rows}
    assert Counter(r.doc_id for r in out if r.draw == 1) == Counter(i for i, _ in rows)
    assert all(r.decoded == texts[r.doc_id] for r in out)
    again = piece_sampling.sampled(docs.repartition(5), PIECES, k=2).collect()
    assert Counter((r.doc_id, r.draw, tuple(r.ids)) for r in out) == Counter((r.doc_id, r.draw, tuple(r.ids)) for r in again)
    assert all(r.round_trip for r in piece_sampling.digests(docs, PIECES).collect())
    assert piece_sampling.sampled(table([]), PIECES).count() == 0


# ---------------------------------------------------------------- pseudonyms


def network(places, kind, key):
    """The Feistel network in plain Python."""
    half = len(places) // 2
    sides = [list(places[:half]), list(places[half:])]
    tweak = f"{kind}/{len(places)}"
    for r in range(1, pseudonyms.ROUNDS + 1):
        target, other = (0, 1) if r % 2 == 0 else (1, 0)
        seed = hashlib.sha256(f"{key}|{tweak}|{r}|{','.join(str(v) for v, _ in sides[other])}".encode()).hexdigest()
        sides[target] = [
            ((v + int(hashlib.sha256(f"{seed}|{i}".encode()).hexdigest()[:8], 16)) % b, b) for i, (v, b) in enumerate(sides[target])
        ]
    return [v for v, _ in sides[0] + sides[1]]


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))


def results(spark, texts, key="k"):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return [(r._pseudonymised, r._kinds) for r in pseudonyms.pseudonymised(df, key).collect()]


def test_cards_dates_and_ips_equal_the_plain_network(spark):
    rng = random.Random(6)
    cards, dates, ips = [], [], []
    for _ in range(8):
        d = [rng.randrange(10) for _ in range(15)]
        cards.append("".join(map(str, [*d, next(c for c in range(10) if luhn([*d, c]) % 10 == 0)])))
        dates.append(date(1900, 1, 1) + timedelta(days=rng.randrange(73049)))
        ips.append(".".join(str(rng.randrange(256)) for _ in range(4)))
    got = [t for t, _ in results(spark, [*cards, *[d.isoformat() for d in dates], *ips])]
    for c, g in zip(cards, got[:8]):
        new = network([(int(x), 10) for x in c[:-1]], "card", "k")
        assert [int(x) for x in g[:-1]] == new and luhn([int(x) for x in g]) % 10 == 0
    for d, g in zip(dates, got[8:16]):
        a, b = network([((d - date(1900, 1, 1)).days // 4297, 17), ((d - date(1900, 1, 1)).days % 4297, 4297)], "date", "k")
        assert g == (date(1900, 1, 1) + timedelta(days=a * 4297 + b)).isoformat()
    for i, g in zip(ips, got[16:]):
        assert g == ".".join(map(str, network([(int(x), 256) for x in i.split(".")], "ip", "k")))


def test_formats_links_and_what_stays(spark):
    card = "4512357872779712"
    texts = [
        f"pay {card}, or 4512-3578-7277-9712 12 now",
        "ssn 123-45-6789; 000-12-3456; 666-12-3456",
        "call +1 (824) 555-6522 or +49 30 1234 5678",
        "on 29.02.1984 and 2001/03/04, not 29.02.1985 or 1850-01-01",
        "to GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765432, not GB83WEST12345698765432",
        "mail Foo.Bar9@x.org.",
        "plain 4512357872779713 v1.2.3.4.5 x4512357872779712 256.1.1.1 2020",
        None,
        "",
    ]
    got = results(spark, texts)
    assert [len(k) for _, k in got] == [2, 1, 2, 2, 2, 1, 0, 0, 0]
    one, two = re.findall(r"\d{16}|\d{4}(?:-\d{4}){3}", got[0][0])
    assert one == two.replace("-", "") != card and got[0][0].endswith(" 12 now")
    assert re.fullmatch(r"ssn (?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}; 000-12-3456; 666-12-3456", got[1][0])
    assert re.fullmatch(r"call \+1 \([2-9]\d\d\) [2-9]\d\d-\d{4} or \+4\d \d\d \d{4} \d{4}", got[2][0])
    assert re.fullmatch(r"on \d\d\.\d\d\.\d{4} and \d{4}/\d\d/\d\d, not 29\.02\.1985 or 1850-01-01", got[3][0])
    spaced, plain = re.findall(r"GB\d\d[A-Z ]+[\d ]+\d", got[4][0])[:2]
    assert spaced.replace(" ", "") == plain and "GB83WEST12345698765432" in got[4][0]
    value = plain[4:] + plain[:4]
    assert int("".join(str(int(c, 36)) for c in value)) % 97 == 1
    assert re.fullmatch(r"mail [A-Z][a-z]{2}\.[A-Z][a-z]{2}\d@x\.org\.", got[5][0])
    assert [t for t, _ in got[6:]] == texts[6:]
    assert results(spark, texts[:1], "other")[0] != got[0] and results(spark, texts[:1])[0] == got[0]


def test_numbers_outside_of_the_american_plan(spark):
    rng = random.Random(3)
    numbers = {f"+1 ({a}) {b}-{rng.randrange(10000):04d}" for a in ("017", "117", "900", "217") for b in ("055", "155", "012")}
    numbers |= {f"+1 ({a:03d}) 555-7713" for a in range(200)}
    numbers = sorted(numbers)
    docs = spark.createDataFrame([(i, f"{x}, again {x}.") for i, x in enumerate(numbers)], "doc_id long, text string")
    rows = pseudonyms.pseudonymised(docs, "k").orderBy("doc_id").collect()
    out = [re.fullmatch(r"(\+1 \(\d{3}\) \d{3}-\d{4}), again (.*)\.", r._pseudonymised).groups() for r in rows]
    assert all(r._kinds == ["phone", "phone"] for r in rows) and all(a == b for a, b in out)
    new = [a for a, _ in out]
    assert len(set(new)) == len(numbers) and sum(a == b for a, b in zip(new, numbers)) == 0
    assert not any(re.match(r"\+1 \([2-9]\d\d\) [2-9]", x) for x in new)


def test_networks_are_permutations(spark):
    ssn = [f"{a:03d}-{b:02d}-{c:04d}" for a in (1, 665, 667, 899) for b in (1, 99) for c in (1, 9999)]
    days = [(date(1900, 1, 1) + timedelta(days=d)).isoformat() for d in range(0, 73049, 701)]
    got = [t for t, _ in results(spark, ssn + days)]
    assert len(set(got)) == len(got) == len(ssn) + len(days)


def test_no_python_in_native_plans(spark, table):
    for df in (pseudonyms.op4_pseudonyms(spark, "/root/testdata/sf0.001"),):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


# ---------------------------------------------------------------- pipeline, shared arrays


def test_words_of_chunks_do_not_depend_on_the_chunk():
    texts = ["a b", None, "", "  x\ty\n", "long " * 100, "é ü"]
    whole = [(w.hash.tolist(), w.counts.tolist()) for _, _, w in chunked_words(pa.array(texts), PLAIN, False)]
    parts = [(w.hash.tolist(), w.counts.tolist()) for _, _, w in chunked_words(pa.array(texts), PLAIN, False, limit=4)]
    assert sum((h for h, _ in parts), []) == whole[0][0] and sum((c for _, c in parts), []) == whole[0][1]
    assert whole[0][1] == [2, 0, 0, 2, 100, 2]


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, rows, sf), "t")
        assert kept.columns == docs.columns, name
        assert kept.exceptAll(rows).count() == 0, name
        rows = kept
    last = corpus_pipeline.STAGES[-1][1](spark, rows, sf)
    assert last.filter("draw = 1").count() == rows.count() < docs.count()
    assert last.filter("not round_trip").count() == 0
    texts = [r.text for r in rows.collect()]
    assert len(set(texts)) == len(texts)


def test_other_queries_load_without_this_subpackage():
    import subprocess
    import sys

    code = (
        "import sys\n"
        "sys.modules['turnledger.llm'] = None\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries())\n"
        "assert names and not any(n.startswith('op1') for n in names), names\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(__import__("pathlib").Path(__file__).parents[2]))
