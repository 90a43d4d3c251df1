"""Hard negatives: rows of another label that score high against an anchor, yet clearly below its positives.

Scores are exact inner products of whole-number vectors. They are multiplied as residues: modulo a few small primes both
sides fit so narrowly into float32 that a float matrix product is exact, and Chinese remaindering puts the residues
together to the signed score. Anchors come in blocks of bounded size; for each block two passes go over all rows, each task
keeping its own best rows of every anchor, and windows select among what tasks kept. Results of a block are stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrisk.llm.common import discard, in_arrow, stored
from gridrisk.llm.vectors import usable, vector_of, whole

#: float32 holds whole numbers up to 2 ** 24 exactly.
EXACT = 2**24
NONE = np.iinfo(np.int64).min
#: Anchors by rows that a task scores at a time.
TILE = (256, 2048)


def primes_for(dims: int, most: int) -> list[int]:
    """The largest primes whose centred residues give exact float32 products over dims components, as many as it takes to
    tell all scores between -most and most apart."""
    half = int((EXACT / dims) ** 0.5)
    found, product, p = [], 1, 2 * half + 1
    while product <= 2 * most:
        while p > 2 and any(p % q == 0 for q in range(2, int(p**0.5) + 1)):
            p -= 1
        if p <= 2:
            raise ValueError(f"vectors of {dims} components are too long for float32 residues")
        found.append(p)
        product, p = product * p, p - 1
    return found


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """The residue of x that is nearest to 0; of floats that are whole numbers below 2 ** 52 too."""
    if x.dtype == np.float64:
        return x - p * np.rint(x / p)
    x = x % p
    return np.where(x > p // 2, x - p, x)


def products(left: dict[int, np.ndarray], right: dict[int, np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact scores, long (rows of left, rows of right), from float32 residues by prime. Mixed radix digits are centred as
    well, so the signed score needs no correction."""
    score, radix = 0, 1
    for p in primes:
        residue = centred((left[p] @ right[p].T).astype(np.float64), p)
        if radix == 1:
            score = residue
        else:
            digit = centred(residue - centred(score, p), p)
            digit = centred(digit * pow(radix, -1, p), p)
            if radix * p >= 2**52:
                score, digit = score.astype(np.int64), digit.astype(np.int64)
            score = score + radix * digit
        radix *= p
    return score.astype(np.int64)


class Best:
    """The first k by score, then least id, of each of n lists."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), NONE), np.zeros((n, k), np.int64)

    def least(self) -> np.ndarray:
        """What a score must reach to get into each list."""
        return self.scores[:, -1]

    def offer(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(lists):
            return
        k, touched = self.scores.shape[1], np.unique(lists)
        lists = np.concatenate([lists, np.repeat(touched, k)])
        scores, ids = np.concatenate([scores, self.scores[touched].ravel()]), np.concatenate([ids, self.ids[touched].ravel()])
        order = np.lexsort((ids, -scores, lists))  # NONE, the least long, is its own negative, so it must not take part
        order = order[scores[order] != NONE]
        lists, scores, ids = lists[order], scores[order], ids[order]
        first = np.searchsorted(lists, lists)
        place = np.arange(len(lists)) - first
        lists, scores, ids, place = (x[place < k] for x in (lists, scores, ids, place))
        self.scores[lists, place], self.ids[lists, place] = scores, ids

    def batch(self) -> pa.RecordBatch:
        at, _ = np.nonzero(self.scores != NONE)
        there = self.scores != NONE
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(self.ids[there]), pa.array(self.scores[there])], ["list", "id", "score"])


def _best(rows: DataFrame, anchors: dict, lists: int, k: int, wanted) -> DataFrame:
    """The first k rows of every list (columns list, id, score, rank). wanted(at, scores, same, other, least) gives the
    lists, places of anchors and places of rows that may enter, for a tile of scores of anchors at."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        vectors, dims = a["vectors"], a["vectors"].shape[1]
        best, ready = Best(lists, k), {}
        most_left = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)).max())
        for batch in batches:
            ints = whole(batch.column("vector"), dims)
            ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            for start in range(0, len(ids), TILE[1]):
                part = slice(start, start + TILE[1])
                most_right = float(np.sqrt((ints[part].astype(np.float64) ** 2).sum(axis=1)).max())
                primes = primes_for(dims, int(most_left * most_right * (1 + 1e-9)) + 1)
                for p in primes:
                    if p not in ready:
                        ready[p] = centred(vectors, p).astype(np.float32)
                right = {p: centred(ints[part], p).astype(np.float32) for p in primes}
                for top in range(0, len(vectors), TILE[0]):
                    at = slice(top, top + TILE[0])
                    scores = products({p: ready[p][at] for p in primes}, right, primes)
                    same = a["labels"][at, None] == labels[None, part]
                    for entry, i, j in wanted(a, at, scores, same, a["ids"][at, None] != ids[None, part], best.least()):
                        best.offer(entry, scores[i, j], ids[part][j])
        yield best.batch()

    kept = in_arrow(rows, task, "list long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k)


def _positives(a, at, scores, same, other, least):
    i, j = np.nonzero(same & other & (scores >= least[at, None]))
    yield at.start + i, i, j


def _negatives(a, at, scores, same, other, least):
    width = a["low"].shape[1]
    for n in range(width):
        entry = (np.arange(len(a["ids"]))[at]) * width + n
        floor = np.maximum(a["low"][at, n], least[entry])
        i, j = np.nonzero(~same & (scores <= a["high"][at, n, None]) & (scores >= floor[:, None]))
        yield entry[i], i, j


def mine_negatives(
    df: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    *,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    anchors_per_block: int = 65_536,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (longs, rank an int): for each anchor and
    each of its first positives, the first rows of another label with low % to high % of the positive's score.

    is_anchor is a condition on df's columns. A row's label and id are longs. Higher scores come first, then smaller ids.
    An anchor's positives are rows of its label with another id. Rows whose id or label is null, whose vector is null,
    empty or holds null or non-finite components, or isn't as long as the vector of the anchor with the smallest id, take
    no part. Repeated rows count each, and an anchor that occurs twice gives its rows twice. Components are kept within
    ``vectors.bits``. Tables without anchors, or empty, give no rows. Other columns, whatever their names, are not read.
    """
    usable_rows = usable(vector_col) & F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull()
    rows = df.where(usable_rows).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
        vector_of(df, vector_col).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    anchors = stored(rows.where("anchor").drop("anchor").withColumn("row", F.monotonically_increasing_id()), "anchors")
    first = anchors.select("id", F.size("vector").alias("dims")).orderBy("id", "dims").first()
    fits = F.size("vector") == (first.dims if first else 0)
    rows, anchors = rows.where(fits).drop("anchor"), anchors.where(fits)
    blocks = -(-anchors.count() // anchors_per_block)
    found = []
    for block in range(blocks):
        a = anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).drop("row").toArrow().combine_chunks()
        if a.num_rows:
            found.append(stored(_mined(rows, a, first.dims, positives, negatives, low, high), "negatives"))
    discard(anchors)
    none = df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, found, none)


def _mined(rows: DataFrame, block: pa.Table, dims: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Both passes for one block of anchors."""
    ids, labels = block["id"].to_numpy(), block["label"].to_numpy()
    a = {"ids": ids, "labels": labels, "vectors": whole(block["vector"].combine_chunks(), dims)}
    best = _best(rows, a, len(ids), positives, _positives).toArrow()  # so many rows for each anchor of the block
    at, place = best["list"].to_numpy(), best["rank"].to_numpy() - 1
    score, name = np.zeros((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
    score[at, place], name[at, place] = best["score"].to_numpy(), best["id"].to_numpy()
    lowest, highest = np.ones_like(score), np.zeros_like(score)  # no score lies between
    lowest[at, place], highest[at, place] = -(-low * score[at, place] // 100), high * score[at, place] // 100
    mined = _best(rows, a | {"low": lowest, "high": highest}, len(ids) * positives, negatives, _negatives)
    pairs = pa.table({"list": np.arange(score.size), "anchor_id": np.repeat(ids, positives), "positive_id": name.ravel(), "positive_score": score.ravel()})
    pairs = rows.sparkSession.createDataFrame(pairs)
    return mined.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(F.broadcast(pairs), "list").drop("list")
