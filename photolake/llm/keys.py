"""Keys for documents whose doc_id doesn't name one text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.session import stash

#: From here on keys stand for rows without a doc_id or with one that names several texts.
ODD = 1 << 62


def free_name(name: str, taken: list[str]) -> str:
    """The name with as many underscores behind it as make it unlike all names taken."""
    have = {x.lower() for x in taken}
    while name.lower() in have:
        name += "_"
    return name


def row_keys(docs: DataFrame, name: str = "_key") -> DataFrame:
    """The documents with a key that is equal only for rows of one doc_id and text.

    It is the doc_id where that names a single text. Rows without a doc_id, and
    all rows of a doc_id with several texts, get a hash of both from ODD on, so
    that they come after usual ids in any order.
    """
    said = F.xxhash64("text", F.lit(1))
    mark = free_name("_split", [*docs.columns, name])
    texts = docs.filter("doc_id is not null").select("doc_id", said.alias("h")).groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    split = stash(texts.filter("a <> b").select("doc_id", F.lit(True).alias(mark)), "split")
    odd = F.coalesce(F.col(mark), F.col("doc_id").isNull())
    key = F.when(odd, F.xxhash64("doc_id", "text").bitwiseAND(F.lit(ODD - 1)).bitwiseOR(F.lit(ODD))).otherwise(F.col("doc_id"))
    return docs.join(split, "doc_id", "left").withColumn(name, key).select(*docs.columns, name)
