"""Exact duplicates: a group for each 128-bit content hash, with the bytes inside each group compared.

Rows become narrow first: an id, a row key, the hash and a digest. Counts and keepers of the hashes come from those, by
partial aggregation, so a group of copies never stands in one task. Texts are compared by grouping on hash and text
together: each task collapses its own copies before anything is sent. A hash that turns out to stand for several texts
has its rows told apart by the texts themselves.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk.llm.common import discard, hinted, stored, with_group


def lower_ascii(text: Column) -> Column:
    """text with A to Z lower-cased and every other letter as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def content_hash(data: Column) -> Column:
    """128 bits of a binary column."""
    return F.unhex(F.md5(data))


def find_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    normalise: Callable[[Column], Column] = lower_ascii,
    largest: bool = False,
    digest: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Documents are copies where their normalised texts are the same bytes; null texts are empty ones. One row of each group
    is kept, that with the smallest id, or the largest. A null id comes after all others, so it is kept only where a group
    has nothing else; of rows that share the kept id exactly one is kept. An empty table gives no rows. Other columns of
    docs, whatever their names, are not read. ``digest`` hashes normalised texts as binary; a weak one costs time only.
    """
    body = normalise(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).cast("binary")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), body.alias("body")).withColumn("hash", digest(F.col("body")))
    narrow = lambda df: df.select("id", F.monotonically_increasing_id().alias("row"), "hash", F.unhex(F.sha2("body", 256)).alias("sha"), "variant")
    rows = stored(narrow(texts.withColumn("variant", F.lit(None).cast("binary"))), "copies-rows")
    clashes = stored(clashing_hashes(texts), "copies-clashes")
    if not clashes.isEmpty():
        apart = narrow(texts.join(hinted(clashes), "hash", "left_semi").withColumn("variant", F.col("body")))
        together, rows = rows, stored(rows.join(hinted(clashes), "hash", "left_anti").unionByName(apart), "copies-rows")
        discard(together)
    # The kept row is the greatest by id, or by the id's rank from below; a null id is the least of all either way.
    better = F.max(F.struct("id", "row")) if largest else F.min(F.struct(F.isnull("id").alias("absent"), "id", "row"))
    groups = rows.groupBy("hash", "variant").agg(F.count(F.lit(1)).alias("group_size"), better.alias("best"))
    groups = stored(groups.where("group_size > 1").select("hash", "variant", "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row")), "copies-groups")
    alone = F.isnull("group_size")
    return with_group(rows, groups, ["hash", "variant"], "group_size", rows.count()).select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def clashing_hashes(texts: DataFrame) -> DataFrame:
    """Hashes (column hash) that more than one text (column body) has."""
    distinct = texts.groupBy("hash", "body").agg(F.count(F.lit(1)).alias("copies"))
    return distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("bodies")).where("bodies > 1").select("hash")
