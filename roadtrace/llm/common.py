"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Everything that is not a word character once A-Z is lower-cased (fixed by the query contracts).
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII white space (fixed by the query contracts).
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read back.

    Cuts the lineage on storage that survives executors.  The schema is
    passed on, so an empty frame (no part files) reads back as well.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Delete the tables that ``stored`` has written for this application; frames that read them are gone with them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/llm")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def lowered(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Lower-cased words: runs of digits, letters and everything beyond ASCII.  Null: none."""
    return F.array_remove(F.split(F.coalesce(lowered(text), F.lit("")), NOT_WORD), "")


def white_words(text: Column) -> Column:
    """Words between ASCII white space, unchanged.  Null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def text_key(text: Column) -> Column:
    """64-bit key of a text (never null); with the id it tells apart rows that share an id."""
    return F.xxhash64(text)


def training_fold(doc_id: Column) -> Column:
    """True for rows whose crc32(id as text) mod 5 is not 0; a null id is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def pieces(batches, rows: int = 512):
    """Arrow batches in runs of a few rows, so that few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def bytes_of(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts: one pass that reads only the text column."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0


def with_columns(docs: DataFrame, results: dict[str, Column], row: str = "row") -> list[Column]:
    """Columns for a select: the fields of the struct column ``row`` plus the results.

    A result replaces an input column of the same name (names compare
    without case, as Spark resolves them).
    """
    names = docs.schema[row].dataType.fieldNames()
    taken = {n.lower() for n in results}
    kept = [F.col(row).getField(n).alias(n) for n in names if n.lower() not in taken]
    return kept + [c.alias(n) for n, c in results.items()]
