"""Alignment of two tokenizers' tokens by the bytes they cover, and corpus counts of linked ids.

A task encodes a chunk of documents with both tokenizers and lays all tokens of the chunk on
one byte axis. ``pandas.merge_asof``, keyed by document, finds for each token's start the
covering token of the other side; of two overlapping tokens the later start always lies in
the other one, so the union of both directions is every overlapping pair. Where ends of both
sides are equal, a group ends.

Per document only the different id pairs with their numbers are written; counts over the
corpus come from them by one aggregation. Sums go back to the documents in two parts: pairs
counted often (at most ``FREQUENT``, so a bounded broadcast) meet them in the task, all others
in a join on the pair, which has no hot key since those counts are small.

Defined cases: a null or empty text, and one whose tokens do not give back its bytes, has no
tokens (zeros, empty hash); each row is decided by itself also where ids repeat or are null;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.llm.stages import written
from turnledger.llm.text_arrays import CHUNK, row_chunks, text_buffer

#: Most id pairs whose counts are broadcast; the others are joined.
FREQUENT = 1 << 17
#: An id pair is one number: the first side's id times this, plus the second side's.
SHIFT = 1 << 20


class Side:
    """Byte lengths and printed forms of one tokenizer's entries."""

    def __init__(self, entries: list[bytes], last: bytes):
        self.entries = entries
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.printed = [b"%d," % i for i in range(len(entries))] + [b"%d%s" % (i, last) for i in range(len(entries))]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


# The split of a byte-level vocabulary without a pattern of its own.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of ASCII and Latin letters, on which every library's character classes agree.
_LATIN = re.compile("[\x00-\x7f\u00a1-\u024f]*").fullmatch


def rank_encoder(path: str, entries: list[bytes]):
    """The same vocabulary for tiktoken, which is several times faster; None where merges are
    not in the order of ids or the file asks for more than that split."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    plain = spec["model"]["type"] == "BPE" and not spec["normalizer"] and not spec["model"].get("ignore_merges")
    split = spec["pre_tokenizer"] or {}
    plain = plain and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    ids = [spec["model"]["vocab"].get(a + b) for a, b in merges]
    if not plain or None in ids or ids != sorted(ids):
        return None
    special = {t["id"] for t in spec["added_tokens"]}
    ranks = {entries[i]: i for i in spec["model"]["vocab"].values() if i not in special}
    return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


class Coders:
    """Both tokenizers. A task loads its own: a tokenizer that travels to a worker with this
    module's state would lose its setting for special tokens."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        letters = byte_letters()
        names = {i: t for t, i in self.first.get_vocab(with_added_tokens=True).items()}
        entries = [bytes(map(letters.__getitem__, names.get(i, ""))) for i in range(max(names) + 1)]
        self.a = Side(entries, b"|")
        self.ranks = rank_encoder(first, entries)
        self.second = SentencePieceProcessor(model_file=second)
        entries = []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            entries.append(bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode())
        self.b = Side(entries, b";")
        if len(self.b.entries) > SHIFT:
            raise ValueError("the second vocabulary is larger than the pair numbers allow")

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none for a text that either side does not give back."""
        fast = [self.ranks is not None and _LATIN(t) is not None for t in texts]
        others = iter(self.first.encode_batch_fast([" " + t for t, f in zip(texts, fast) if not f], add_special_tokens=False))
        ids_a = [self.ranks.encode_ordinary(" " + t) if f else next(others).ids for t, f in zip(texts, fast)]
        ids_b = self.second.encode(texts, num_threads=1) if texts else []
        for i, text in enumerate(texts):
            raw = f" {text}".encode()
            if not text or any(b"".join(map(s.entries.__getitem__, ids)) != raw for s, ids in ((self.b, ids_b[i]), (self.a, ids_a[i]))):
                ids_a[i], ids_b[i] = [], []
        return ids_a, ids_b


def _laid(side: Side, ids: list[list[int]]) -> pd.DataFrame:
    """Tokens of all documents of a chunk: document, id, first byte and end on one axis."""
    counts = np.array([len(x) for x in ids], np.int64)
    flat = np.fromiter(chain.from_iterable(ids), np.int64, counts.sum())
    end = np.cumsum(side.sizes[flat])
    return pd.DataFrame({"doc": np.repeat(np.arange(len(ids)), counts), "id": flat, "at": end - side.sizes[flat], "end": end})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of every overlapping pair: each start with the token that covers it.

    Tokens of a document cover the same bytes on both sides, so an earlier start of the other
    side always exists and is the covering token's.
    """
    a = a.assign(a=np.arange(len(a)))
    b = b.assign(b=np.arange(len(b)))
    covering_b = pd.merge_asof(a[["doc", "at", "a"]], b[["doc", "at", "b"]], on="at", by="doc")
    covering_a = pd.merge_asof(b[["doc", "at", "b"]], a[["doc", "at", "a"]].assign(start=a["at"]), on="at", by="doc")
    covering_a = covering_a[covering_a["start"] < covering_a["at"]]  # equal starts are in the first direction
    return (
        np.concatenate([covering_b["a"].to_numpy(), covering_a["a"].to_numpy()]).astype(np.int64),
        np.concatenate([covering_b["b"].to_numpy(), covering_a["b"].to_numpy()]).astype(np.int64),
    )


def group_numbers(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token, counted over the chunk: a group ends where ends are equal."""
    ends = np.intersect1d(a["end"].to_numpy(), b["end"].to_numpy(), assume_unique=True)
    return np.searchsorted(ends, a["end"].to_numpy()), np.searchsorted(ends, b["end"].to_numpy())


def _printed(coders: Coders, a: pd.DataFrame, b: pd.DataFrame, ga: np.ndarray, gb: np.ndarray, rows: int) -> list[str]:
    """sha256 of ``a1,a2|b1;a3|b2,b3`` for each document, '' for one without tokens."""
    if not len(ga):
        return [""] * rows
    groups = int(ga[-1]) + 1
    n_a, n_b = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
    upto_a, before_b = np.cumsum(n_a), np.cumsum(n_b) - n_b
    last = lambda g: np.append(g[1:] != g[:-1], True)
    size_a = len(coders.a.entries)
    words = np.empty(len(ga) + len(gb), np.int64)
    words[np.arange(len(ga)) + before_b[ga]] = a["id"].to_numpy() + size_a * last(ga)
    words[np.arange(len(gb)) + upto_a[gb]] = 2 * size_a + b["id"].to_numpy() + len(coders.b.entries) * last(gb)
    table = coders.a.printed + coders.b.printed
    total = np.bincount(a["doc"], minlength=rows) + np.bincount(b["doc"], minlength=rows)
    stop = np.cumsum(total)
    out = []
    for low, high in zip((stop - total).tolist(), stop.tolist()):
        out.append(hashlib.sha256(b"".join(map(table.__getitem__, words[low:high].tolist()))[:-1]).hexdigest() if high > low else "")
    return out


_ALIGNED = (
    "uid bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string,"
    " pairs array<bigint>, times array<int>"
)
_NAMES = ["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _aligner(first: str, second: str):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coders, seen = Coders(first, second), TaskContext.get().partitionId() << 36
        for batch in batches:
            column = batch.column("text")
            for low, high in row_chunks(text_buffer(column)[1], CHUNK):
                texts = [t or "" for t in column.slice(low, high - low).to_pylist()]
                ids_a, ids_b = coders.encode(texts)
                a, b = _laid(coders.a, ids_a), _laid(coders.b, ids_b)
                at_a, at_b = overlaps(a, b)
                ga, gb = group_numbers(a, b)
                rows = high - low
                of_doc = a["doc"].to_numpy()[at_a]
                pair = a["id"].to_numpy()[at_a] * SHIFT + b["id"].to_numpy()[at_b]
                order = np.lexsort((pair, of_doc))
                of_doc, pair = of_doc[order], pair[order]
                new = np.append(True, (of_doc[1:] != of_doc[:-1]) | (pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, bool)
                where = np.flatnonzero(new)
                times = np.diff(np.append(where, len(pair)))
                different = np.bincount(of_doc[where], minlength=rows)
                new_group = np.append(True, ga[1:] != ga[:-1]) if len(ga) else np.zeros(0, bool)
                count = lambda docs: pa.array(np.bincount(docs, minlength=rows), pa.int64())
                columns = [
                    pa.array(np.arange(seen, seen + rows)),
                    batch.column("doc_id").slice(low, rows),
                    count(a["doc"]),
                    count(b["doc"]),
                    count(a["doc"].to_numpy()[new_group]),
                    count(of_doc),
                    pa.array(_printed(coders, a, b, ga, gb, rows), pa.string()),
                    _lists(pair[where], different, pa.int64()),
                    _lists(times, different, pa.int32()),
                ]
                seen += rows
                yield pa.RecordBatch.from_arrays(columns, _NAMES)

    return align


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: numbers of tokens, groups and links, the hash of its groups, and
    its different linked id pairs (``pairs``) with how often each occurs (``times``)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_aligner(first, second), _ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """How many documents hold each id pair, and whether no pair of its first id has more."""
    counts = written(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair_counts")
    first = F.expr(f"pair div {SHIFT}")
    # One row per id of the first vocabulary, so its size is bounded by that file.
    top = counts.groupBy(first.alias("id")).agg(F.max("n").alias("top"))
    return counts.join(F.broadcast(top), first == F.col("id")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _often(counts: DataFrame, most: int) -> int:
    """Smallest power of two that at most ``most`` pairs reach."""
    sizes = {r["k"]: r["n"] for r in counts.groupBy(F.expr("bigint(floor(log2(n)))").alias("k")).agg(F.count("*").alias("n")).collect()}
    level, held = max(sizes, default=0) + 1, 0
    while level > 0 and held + sizes.get(level - 1, 0) <= most:
        level -= 1
        held += sizes.get(level, 0)
    return 1 << level


def link_statistics(docs: DataFrame, first: str, second: str, most: int = FREQUENT) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    aligned = written(align(docs, first, second), "aligned", "zstd")
    counts = written(pair_counts(aligned), "pair_totals")
    least = _often(counts, most)
    links = aligned.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("uid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    often, rare = counts.where(F.col("n") >= least), counts.where(F.col("n") < least)
    met = links.join(F.broadcast(often), "pair", "left")
    sums = (F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    known = met.where(F.col("n").isNotNull()).groupBy("uid").agg(*sums)
    others = met.where(F.col("n").isNull()).select("uid", "pair", "times").join(rare, "pair").groupBy("uid").agg(*sums)
    both = known.unionByName(others).groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    return aligned.drop("pairs", "times").join(both, "uid", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256",
    )


def op12_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return link_statistics(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
