"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each distinct 5-word shingle is hashed once; the top bits of the hash choose one of BINS bins, and the least hash of a
bin is its value. An empty bin takes the value of the first non-empty bin among random probes of its own, the same for all documents, so
equal sets agree and unequal ones agree by their likeness. The fingerprint keeps BITS low-order
bits of each bin as hex digits; likeness corrects for bits that agree by chance.

Words: lower-cased, between ASCII blanks. With fewer than five words the whole sequence is one shingle. Defined results:
null, empty and blank texts have the fingerprint of all zeros, which is alike (1.0) to itself and not alike (0.0) to any
other; repeated rows get equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrisk.llm.common import BLANKS, fresh_name, hashable, without

WORDS, BITS, BINS = 5, 4, 256
SHIFT = 64 - (BINS - 1).bit_length()
PER_LONG = 64 // BITS
NIBBLES = 0x1111111111111111
PROBES = 48


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANKS), lambda w: w != "")


def _shingle_hashes(ws: Column) -> Column:
    n = F.size(ws)
    every = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WORDS)]))
    return F.when(n >= WORDS, every).when(n > 0, F.array(F.xxhash64(ws)))


def _bin(h: Column) -> Column:
    return (F.shiftright(h, SHIFT) + BINS // 2).cast("int")


def _firsts(sorted_hashes: Column) -> Column:
    """The least hash of each non-empty bin. Sorted hashes rise through the bins, so a bin's first hash is its least."""
    return F.filter(sorted_hashes, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(sorted_hashes, i - 1))))


def _binned(firsts: Column) -> Column:
    """BINS values, null where a bin is empty."""
    blanks = lambda n: F.array_repeat(F.lit(None).cast("long"), n)

    def spread(h: Column, i: Column) -> Column:
        following = F.coalesce(_bin(F.get(firsts, i + 1)), F.lit(BINS))
        return F.concat(F.array(h), blanks(following - _bin(h) - 1))

    return F.when(F.size(firsts) > 0, F.concat(blanks(_bin(F.get(firsts, F.lit(0)))), F.flatten(F.transform(firsts, spread))))


def _densified(bins: Column, firsts: Column) -> Column:
    """Each empty bin has an order of all bins, alike for all documents, and takes the first that is not empty: first come
    the bins that PROBES hashes of (bin, attempt) name, then all bins by their hash with the empty one. The order is of
    random bins throughout, so two documents that fill the same bins take the same one, whichever part of the order it
    comes from, and any filled bin is as likely as another. The second part is what keeps an order finite: with f of BINS
    bins filled it is reached by a share (1 - f / BINS) ** PROBES of the empty ones."""

    def fill(i: Column) -> Column:
        probes = [F.get(bins, F.xxhash64(i, F.lit(k)).bitwiseAND(BINS - 1).cast("int")) for k in range(PROBES)]
        ranked = F.array_min(F.transform(firsts, lambda h: F.struct(F.xxhash64(i, _bin(h)).alias("rank"), h.alias("h"))))
        return F.coalesce(F.get(bins, i), *probes, ranked["h"])

    return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), fill)


def _packed(dense: Column) -> Column:
    pack = lambda acc, v: F.shiftleft(acc, BITS).bitwiseOR(v.bitwiseAND(F.lit((1 << BITS) - 1)))
    longs = F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), lambda g: F.aggregate(F.slice(dense, g * PER_LONG + 1, F.lit(PER_LONG)), F.lit(0).cast("long"), pack))
    return F.when(dense.isNotNull(), longs)


def with_fingerprint(df: DataFrame, text: Column, out: str) -> DataFrame:
    """df with ``out``: the packed fingerprint of text, BINS / PER_LONG longs; null for a text without words."""
    # A step's column is used more than once by the next, so that Catalyst keeps it instead of pasting it into lambdas.
    step = {n: fresh_name(df, f"{n}_{out}") for n in ("words", "hashes", "firsts", "bins", "dense")}
    col = {n: F.col(c) for n, c in step.items()}
    df = df.withColumn(step["words"], words(text))
    df = df.withColumn(step["hashes"], F.array_sort(_shingle_hashes(col["words"]))).drop(step["words"])
    df = df.withColumn(step["firsts"], _firsts(col["hashes"])).drop(step["hashes"])
    df = df.withColumn(step["bins"], _binned(col["firsts"]))
    df = df.withColumn(step["dense"], F.when(col["bins"].isNotNull(), _densified(col["bins"], col["firsts"]))).drop(step["bins"], step["firsts"])
    return df.withColumn(out, _packed(col["dense"])).drop(step["dense"])


def hexed(packed: Column) -> Column:
    digits = F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")
    return F.coalesce(F.lower(digits), F.lit("0" * (BINS * BITS // 4)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two packed fingerprints, corrected for bins that agree by chance."""

    def unlike(x: Column) -> Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(NIBBLES)))

    differing = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda acc, x: acc + unlike(x))
    chance = 2.0**-BITS
    fit = (1 - differing / BINS - chance) / (1 - chance)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), fit))


def _place(cuts: list, key: Column) -> Column:
    """How many of the sorted cuts are at most key, looked up in two steps of about the square root of their number."""
    width = max(1, int(len(cuts) ** 0.5))
    parts = [cuts[k : k + width] for k in range(0, len(cuts), width)]
    if not parts:
        return F.lit(0)
    part = F.size(F.filter(F.array(*[F.lit(p[0]) for p in parts]), lambda c: c <= key))
    inside = F.size(F.filter(F.get(F.array(*[F.array(*map(F.lit, p)) for p in parts]), part - 1), lambda c: c <= key))
    return F.when(part == 0, 0).otherwise((part - 1) * width + inside)


def with_following(df: DataFrame, id_col: str, columns: dict[str, str], rows_per_bucket: int = 2000, most_buckets: int = 16_384) -> DataFrame:
    """df with columns of the row that follows in descending order of the id; the first row follows the last.

    columns: of df, to the new names. Rows are dealt into ranges of ids (ids of equal value stay together), and each
    range gets the first row of the next range as a guest, so no task sees more than a range, and sorts it with spilling.
    Equal ids follow by the hash of the row; null ids come last. most_buckets bounds what the plan holds: a range of 100 TB
    is 6 GB then.
    """
    bucket, guest, tie, new = (fresh_name(df, n) for n in ("bucket", "guest", "tie", "target"))
    key = F.col(f"`{id_col}`")
    n = df.count()
    buckets = max(1, min(most_buckets, n // rows_per_bucket))
    cuts = df.agg(F.percentile_approx(key, [k / buckets for k in range(1, buckets)] or [0.5], 10_000)).first()[0] or []
    df = df.withColumn(bucket, F.when(key.isNull(), -1).otherwise(_place(sorted(set(cuts)), key)))
    tops = sorted((r[0], r[1]) for r in df.groupBy(bucket).agg(F.max(key)).collect())
    # The first row of a range is the guest of the range above it, the very first one of the lowest.
    to = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    home = df.withColumns({guest: F.lit(False), tie: F.xxhash64(*hashable(df.drop(bucket)))})
    if to:
        spark = df.sparkSession
        moves = spark.createDataFrame([(b, t) for (b, _), (_, t) in zip(tops, to, strict=True)], f"`{bucket}` int, `{new}` int")
        held = [top for top, _ in to if top is not None]
        heads = home.where(key.isin(held) | (key.isNull() if len(held) < len(to) else F.lit(False)))
        heads = heads.join(F.broadcast(moves), bucket).withColumns({bucket: F.col(new), guest: F.lit(True)}).drop(new)
        home = home.unionByName(heads)
    order = Window.partitionBy(bucket).orderBy(F.col(guest), key.desc_nulls_last(), F.col(tie))
    out = home.withColumns({name: F.lead(F.col(f"`{c}`")).over(order) for c, name in columns.items()})
    return out.where(~F.col(guest)).drop(bucket, guest, tie)
