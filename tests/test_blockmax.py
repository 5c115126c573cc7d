"""Block-max search against the search of all postings."""

import random

from pyspark.sql import functions as F

from tests.test_text_and_search import MEMORY, QUERIES
from turnledger.operators import blockmax, bm25

RARE = [f"rare{i}" for i in range(12)]


def corpus(spark, n=1500, seed=4):
    """One large scope: common words everywhere, each rare word in a few neighbouring documents."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choices(["gate", "dinner", "road", "river", "king"], k=rng.randrange(3, 9))
        if i % 125 < 3:
            words += [RARE[i // 125]] * rng.randrange(1, 4)
        rows.append(("c", "b", f"m{i}", i, rng.choice(words), " ".join(words), [], i % 97 == 0))
    rows += [("c", "b", f"t{i}", n // 2, "gate", "gate road", [], False) for i in range(90)]  # ties on one floor
    rows += [("c", "small", f"s{i}", 1, None, "gate rare1", [], False) for i in range(3)]
    return spark.createDataFrame(rows, MEMORY)


def asked(spark):
    texts = [f"{r} gate road" for r in RARE] + ["gate", "king river", "nothing", "", "gate road"]
    return spark.createDataFrame([("c", b, str(i), t) for b in ("b", "small", "none") for i, t in enumerate(texts)], QUERIES)


def rows(df):
    out = df.select("branch_id", "query_id", "rank", "memory_id", F.round("score", 9).alias("score")).collect()
    return sorted(map(tuple, out))


def kept(spark, folder, name, df):
    df.write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")


def test_block_max_equals_all_postings_and_skips(spark, tmp_path):
    memories, queries = corpus(spark), asked(spark)
    postings, lengths = blockmax.build_blocks(memories)
    postings, lengths = kept(spark, tmp_path, "postings", postings), kept(spark, tmp_path, "lengths", lengths)
    blocks = kept(spark, tmp_path, "blocks", blockmax.block_maxima(postings))
    for k, first in ((10, 4), (1, 1)):
        want = rows(bm25.search_index(postings.drop("range"), lengths, queries, k))
        assert rows(blockmax.block_max_topk(postings, blocks, lengths, queries, k, first)) == want
    read = {r.query_id: r for r in blockmax.blocks_read(postings, blocks, lengths, queries, 1).filter("branch_id = 'b'").collect()}
    some = [read[str(i)] for i in range(len(RARE))]
    assert sum(r.blocks_read for r in some) * 4 < sum(r.blocks for r in some)
    assert sum(r.postings_read for r in some) * 4 < sum(r.postings for r in some)
    # The bounds hold for other averages too: lengths of a scope that has grown since.
    grown = lengths.unionByName(lengths.withColumn("length", F.col("length") * 9).withColumn("memory_id", F.concat("memory_id", F.lit("x"))))
    want = rows(bm25.search_index(postings.drop("range"), grown, queries, 3))
    assert rows(blockmax.block_max_topk(postings, blocks, grown, queries, 3)) == want


def test_block_max_of_empty_tables(spark):
    memories = corpus(spark, 5)
    postings, lengths = blockmax.build_blocks(memories.limit(0))
    assert blockmax.block_max_topk(postings, blockmax.block_maxima(postings), lengths, asked(spark)).count() == 0
    postings, lengths = blockmax.build_blocks(memories)
    assert blockmax.block_max_topk(postings, blockmax.block_maxima(postings), lengths, asked(spark).limit(0)).count() == 0
