"""Toxicity score of whole texts by a small convolutional network trained in numpy.

A word (A-Z as a-z; runs of letters and digits) is the sum of three hashed embeddings: of the
word, of its first four and of its first five bytes. Filters over 1, 2 and 3 words are
pooled by their maximum over the text and joined by a logistic unit. The first embedding
column starts as the smoothed log ratio of the toxic and clean texts that hold the hash, the
other columns start random; all are trained by Adam on mini-batches of texts.

The network is fitted on at most ``SAMPLE`` labelled rows of each label, those with the
smallest hash of the id: a bound on the fit only, every text is scored whole. The shares of
the labels in the sample are not those in the data, so the offset is corrected by the
shares among all training labels. Thresholds by language come from the scores of all labelled
rows that are not trained on, counted in fine bins. Language never enters the score.

Defined cases: null is an empty text, and an empty text has a score (that of pooled zeros);
a document without label is scored only; without labels of both kinds the score is the share
of toxic labels (0 without labels) for every text; languages with few labels, or null, take
the threshold of all; rows repeated in ``documents`` or ``labels`` count as often.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from turnledger.llm.text_arrays import ALNUM, chunked_words, mix

BITS, DIM, WIDTHS, FILTERS = 16, 8, (1, 2, 3), 8
SAMPLE, EPOCHS, STEPS, RATE = 3000, 4, 700, 0.01
CUT = 0.3
#: Score bins for a unit of the log odds, for the thresholds.
BINS = 64
_C = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)]


def word_slots(words) -> np.ndarray:
    """Three embedding rows for each word, shape (words, 3)."""
    n = len(words.start)
    out = np.empty((n, 3), np.int32)
    out[:, 0] = (words.hash * _C[0]) >> np.uint64(64 - BITS)
    if not n:
        return out
    padded = np.concatenate([words.data, np.zeros(5, np.uint8)]).astype(np.uint64)
    padded[(padded >= 65) & (padded <= 90)] += np.uint64(32)
    size = words.end - words.start
    code = np.zeros(n, np.uint64)
    for i in range(5):
        code = code * np.uint64(257) + np.where(size > i, padded[words.start + i] + np.uint64(1), np.uint64(0))
        if i >= 3:
            out[:, i - 2] = mix(code + _C[i - 2]) >> np.uint64(64 - BITS)
    return out


@dataclass
class Network:
    embedding: np.ndarray  # (2**BITS, DIM)
    filters: list[np.ndarray]  # for each width (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    offset: float
    thresholds: dict[str | None, float] = field(default_factory=dict)
    shift: float = 0.0
    constant: float | None = None

    def pooled(self, slots: np.ndarray, first: np.ndarray):
        """Pooled filter values of each text, and the words they come from."""
        n = len(first) - 1
        x = self.embedding[slots[:, 0]] + self.embedding[slots[:, 1]] + self.embedding[slots[:, 2]] if len(slots) else np.zeros((0, DIM), np.float32)
        filled = np.flatnonzero(np.diff(first) > 0)
        values, places = [], []
        end = np.repeat(first[1:], np.diff(first))
        for w, b in zip(self.filters, self.bias):
            y = np.zeros((len(x), FILTERS), np.float32)
            for j in range(len(w)):
                z = x @ w[j]
                # Words past the end of the text count as zero vectors.
                k = len(x) - j
                if j:
                    inside = (np.arange(k) + j) < end[:k]
                    y[:k] += z[j:] * inside[:, None]
                else:
                    y += z
            y += b
            top = np.zeros((n, FILTERS), np.float32)
            if len(filled):
                top[filled] = np.maximum.reduceat(y, first[:-1][filled], axis=0)
            values.append(np.maximum(top, 0))
            places.append((y, top))
        return x, np.concatenate(values, axis=1), places

    def logits(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(slots, first)[1] @ self.out + self.offset + self.shift

    def scores(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(slots, first).astype(np.float64), -40, 40)))


class _Adam:
    def __init__(self, shape):
        self.m, self.v, self.t = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0

    def step(self, value, grad, rate):
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.001 * (grad * grad - self.v)
        value -= rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _join(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return (np.concatenate(texts) if texts else np.zeros((0, 3), np.int32)), first


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Network:
    """Train on slot arrays of texts. Texts of both labels are needed."""
    rng = np.random.default_rng(seed)
    seen = np.zeros((2, 1 << BITS))
    for t, y in zip(texts, labels):
        seen[int(y), np.unique(t)] += 1
    n = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    ratio = np.log((seen[1] + 0.5) / (n[1] + 1.0)) - np.log((seen[0] + 0.5) / (n[0] + 1.0))
    ratio *= np.minimum(1.0, seen.sum(axis=0) / 5.0)
    embedding = rng.normal(0, 0.05, (1 << BITS, DIM)).astype(np.float32)
    embedding[:, 0] = ratio / 4
    filters, bias = [], []
    for w in WIDTHS:
        f = rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32)
        f[0, 0, : FILTERS // 2] = 1.0 / w
        filters.append(f)
        bias.append(np.full(FILTERS, -0.2, np.float32))
    net = Network(embedding, filters, bias, np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), -1.0)
    out_step = _Adam(net.out.shape)
    f_steps = [_Adam(f.shape) for f in filters]
    b_steps = [_Adam(b.shape) for b in bias]
    offset = np.array([net.offset], np.float32)
    o_step = _Adam(1)
    # Small samples go through more often.
    epochs = max(EPOCHS, -(-STEPS * 32 // max(1, len(texts))))
    for epoch in range(epochs):
        rate = RATE / (1 + EPOCHS * epoch / epochs)
        order = rng.permutation(len(texts))
        for low in range(0, len(order), 32):
            pick = order[low : low + 32]
            slots, first = _join([texts[i] for i in pick])
            y = labels[pick].astype(np.float32)
            net.offset = float(offset[0])
            x, h, places = net.pooled(slots, first)
            p = 1 / (1 + np.exp(-np.clip(h @ net.out + net.offset, -30, 30)))
            g = ((p - y) / len(pick)).astype(np.float32)
            gh = g[:, None] * net.out[None, :]
            out_step.step(net.out, h.T @ g, rate)
            o_step.step(offset, np.array([g.sum()], np.float32), rate)
            rows = np.repeat(np.arange(len(pick)), np.diff(first))
            for k, (values, top) in enumerate(places):
                gk = gh[:, k * FILTERS : (k + 1) * FILTERS] * (top > 0)
                best = np.full(top.shape, -1)
                at, col = np.nonzero(values == top[rows])
                best[rows[at], col] = at
                r, c = np.nonzero((best >= 0) & (gk != 0))
                at = best[r, c]
                grad_f, f = np.zeros_like(filters[k]), filters[k]
                for j in range(len(f)):
                    ok = at + j < first[1:][r]
                    word = at[ok] + j
                    np.add.at(grad_f[j].T, c[ok], gk[r[ok], c[ok], None] * x[word])
                    change = -rate * 20 * gk[r[ok], c[ok], None] * f[j][:, c[ok]].T
                    for s in range(3):
                        np.add.at(net.embedding, slots[word, s], change)
                f_steps[k].step(filters[k], grad_f, rate)
                b_steps[k].step(bias[k], gk.sum(axis=0), rate)
    net.offset = float(offset[0])
    return net


def _best_cut(bins: list, label_weights: tuple[float, float]) -> float:
    """The threshold with the best F1 from (low, high, clean, toxic) of score bins; half-way
    to the next lower score."""
    bins = sorted(bins, reverse=True)
    low, high, clean, toxic = np.array(bins, float).T
    hits, wrong = np.cumsum(toxic) * label_weights[1], np.cumsum(clean) * label_weights[0]
    k = int(np.argmax(2 * hits / (hits + wrong + hits[-1])))
    return float((low[k] + (high[k + 1] if k + 1 < len(bins) else 0.0)) / 2)


def _set_thresholds(net: Network, docs: DataFrame, known: DataFrame, fitted: list[int]) -> None:
    """Thresholds from the scores of all labelled rows that were not fitted on.

    Each label counts as among all labelled rows, as the fitted ones do not have its share.
    """
    ids = docs.sparkSession.createDataFrame([(int(i),) for i in sorted(set(fitted))], "doc_id bigint").withColumn("used", F.lit(True))
    score = F.least(F.greatest("score", F.lit(1e-18)), F.lit(1 - 1e-15))
    labelled = scored(docs, net).join(known.withColumn("doc_id", F.col("doc_id").cast("bigint")), "doc_id").join(F.broadcast(ids), "doc_id", "left")
    counted = (
        labelled.groupBy("lang", F.col("used").isNotNull().alias("used"), F.floor(F.log(score / (1 - score)) * BINS).alias("bin"))
        .agg(F.min("score").alias("low"), F.max("score").alias("high"), F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic"))
        .collect()
    )

    def free(rows: list) -> tuple[int, int]:
        return sum(r["clean"] for r in rows if not r["used"]), sum(r["toxic"] for r in rows if not r["used"])

    def cut(rows: list) -> float:
        own = rows if not all(free(rows)) else [r for r in rows if not r["used"]]
        weights = tuple(sum(r[c] for r in rows) / max(1, sum(r[c] for r in own)) for c in ("clean", "toxic"))
        bins: dict[int, list] = {}
        for r in own:
            x = bins.setdefault(r["bin"], [1.0, 0.0, 0, 0])
            x[:] = min(x[0], r["low"]), max(x[1], r["high"]), x[2] + r["clean"], x[3] + r["toxic"]
        return _best_cut(list(bins.values()), weights)

    net.thresholds[None] = cut(counted)
    for name in {r["lang"] for r in counted} - {None}:
        rows = [r for r in counted if r["lang"] == name]
        if min(free(rows)) >= 20:
            net.thresholds[name] = cut(rows)


def _slots_of(texts: pa.Array) -> list[np.ndarray]:
    out = []
    for _, _, words in chunked_words(texts, ALNUM, True):
        slots = word_slots(words)
        out += [slots[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
    return out


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a sample (doc_id, text, toxic): the pickled fields of the network and the ids it was fitted
    on; nothing where the sample has one label only."""
    ids, labels, slots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for batch in batches:
        ids.append(batch.column("doc_id").to_numpy())
        labels.append(batch.column("toxic").to_numpy().astype(np.int64))
        slots += _slots_of(batch.column("text"))
    ids, y = np.concatenate(ids), np.concatenate(labels)
    if len(np.unique(y)) < 2:
        return
    test = np.arange(len(y)) % 5 == 4
    if not (0 < y[test].sum() < test.sum() and 0 < y[~test].sum() < (~test).sum()):
        test[:] = False
    net = fit([s for s, t in zip(slots, test) if not t], y[~test])
    used = y[~test]
    net.shift = -float(np.log(used.sum() / (len(used) - used.sum())))
    yield pa.RecordBatch.from_arrays(
        [pa.array([pickle.dumps(vars(net))], pa.binary()), pa.array([ids[~test].tolist()], pa.list_(pa.int64()))], ["net", "fitted"]
    )


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """A network from labelled rows: ``docs`` (doc_id, text, lang), ``labels`` (doc_id, toxic).

    The sample is fitted on in one task; its texts do not come to the driver, the network does."""
    known = labels.filter("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(shares.values())
    if len(shares) < 2:
        return Network(np.zeros((1 << BITS, DIM), np.float32), [], [], np.zeros(0), 0.0, {}, 0.0, shares.get(1, 0) / total if total else 0.0)
    drawn = None
    for toxic in (0, 1):
        part = known.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        drawn = part if drawn is None else drawn.unionByName(part)
    rows = F.broadcast(drawn).join(docs.select("doc_id", "text"), "doc_id")
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), "toxic")
    found = rows.mapInArrow(_fitted, "net binary, fitted array<bigint>").collect()
    if not found:
        return Network(np.zeros((1 << BITS, DIM), np.float32), [], [], np.zeros(0), 0.0, {}, 0.0, shares[1] / total)
    net = Network(**pickle.loads(found[0]["net"]))
    net.shift += float(np.log(shares[1] / shares[0]))
    _set_thresholds(net, docs, known, found[0]["fitted"])
    return net


def _scorer(shared, names: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            found = [np.zeros(0)]
            for _, _, words in chunked_words(batch.column("text"), ALNUM, True):
                found.append(net.scores(word_slots(words), words.first))
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(found))], [*names, "score"])

    return score


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang and score of every row; lang only for the thresholds."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return rows.mapInArrow(_scorer(shared, ["doc_id", "lang"]), "doc_id bigint, lang string, score double")


def language_cut(net: Network):
    """Column: the threshold of the row's language."""
    general = F.lit(net.thresholds.get(None, CUT))
    own = [x for kv in net.thresholds.items() if kv[0] is not None for x in (F.lit(kv[0]), F.lit(kv[1]))]
    return F.coalesce(F.create_map(*own)[F.coalesce("lang", F.lit(""))], general) if own else general


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose score is below their language's threshold, with their columns."""
    net = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    columns = docs.columns
    plain = [c for c in columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in plain]).alias("rest"), "text")
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])
    out = rows.mapInArrow(_scorer(shared, ["rest", "text"]), schema).withColumn("lang", F.col("rest.lang"))
    kept = out.filter(F.col("score") < language_cut(net))
    return kept.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in columns])


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    net = train(docs, labels.filter(F.coalesce(_remainder(4), F.lit(0)) != 2))
    return scored(docs, net).select(
        "doc_id",
        F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
        (F.col("score") >= language_cut(net)).alias("flagged"),
    )
