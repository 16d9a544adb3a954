"""Very long texts through the operators whose own tests have short ones, and the clean-up of stored tables."""

import os

from pyspark.sql import functions as F

from roadtrace.llm import chat, common, decontaminate, mixing
from roadtrace.session import checkpoint_dir


def test_decontamination_of_a_long_text(spark):
    item = " ".join(f"item{i}" for i in range(12))
    filler = " ".join(f"w{i % 997}" for i in range(200_000))
    docs = spark.createDataFrame([(1, f"{filler} {item} {filler}"), (2, filler)], "doc_id long, text string")
    got = {r.id: r for r in decontaminate.contaminated_words(
        docs, spark.createDataFrame([(7, item)], "item_id long, text string"), window=10).collect()}
    assert (got[1].n_words, got[1].n_hit, list(got[1]["items"])) == (400_012, 12, ["7"])
    assert (got[2].n_words, got[2].n_hit) == (200_000, 0)


def test_chat_of_a_long_text(spark):
    text = "<|im_end|>\\ word " * 150_000
    rows = [(1, 0, "user", text), (1, 1, "assistant", "short"), (1, 2, "assistant", text)]
    out = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    read = out.select("target", F.size(chat.read_turns(F.col("formatted"))).alias("n"),
                      F.sha2(chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")), 256).alias("loss")).collect()
    import hashlib
    assert sorted((r.n, r.loss) for r in read) == [(2, hashlib.sha256(b"short").hexdigest()),
                                                   (3, hashlib.sha256(text.encode()).hexdigest())]


def test_mixing_a_long_text(spark):
    rows = [(1, "a", "w " * 500_000), (2, "a", "x"), (3, "b", "y z")]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got[1].size == 500_000 and got[1].taken <= 1_000_000
    assert sum(got[i].taken for i in (1, 2)) == int(got[1].target + 0.5) and got[3].taken == 4


def test_stored_tables_can_be_dropped(spark):
    common.stored(spark.range(3), "some-table")
    folder = f"{checkpoint_dir(spark)}/llm".removeprefix("file://")
    assert os.listdir(folder)
    common.drop_stored(spark)
    assert not os.path.exists(folder)
    assert common.stored(spark.range(3), "some-table").count() == 3
