"""Toxicity by nearest labelled examples: exact TF-IDF cosine through block-max inverted indexes.

The examples are at most ``most_examples`` labelled rows of the learning fold (the least hashes of their ids, toxic ones
first up to half), clean ones included, each with all of its words. Both classes are counted over all learning labels,
and an example counts by the inverse sampling rate of its class in idf, prior, votes and Platt scaling, so that scores
don't depend on the sample's toxic share. Texts are vectors of all words that some example
has, (1 + ln tf) * weight, unit length. The weight is the idf over all examples times a square that grows with how far
the word's shares in toxic and clean examples lie apart; it is never 0, so no word is left out.

For a query the k examples of highest cosine are found exactly: examples lie in blocks and each block knows the highest
weight of every common word. Rare words are added up first, blocks are visited by falling upper bound, and the search
ends when no bound exceeds the k-th cosine. Votes count by cosine; Platt scaling on leave-one-out votes of the examples
makes them probabilities. Texts without any word of the examples get the calibrated share of toxic examples among
examples without words.

Defined results: null and empty texts have no words; null labels are ignored; without toxic examples every score is the
prior; equal cosines rank by the examples' order (hash of the id); repeated rows are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridrisk.llm.common import in_arrow, without

MARKS = ".,;:!?*#$%&\"'()[]|<>~^-_"


#: Words in more than 1 / COMMON of the examples are added up block by block, the others through their lists.
COMMON = 8


def terms_of(text: str | None) -> Counter:
    """Words without marks at their ends, with their counts."""
    return Counter(w for x in (text or "").lower().split() if (w := x.strip(MARKS)))


def word_weights(n_toxic: np.ndarray, n_clean: np.ndarray, toxic: float, clean: float, rates: tuple[float, float]) -> np.ndarray:
    """Weights of words that n_toxic of the toxic examples and n_clean of the clean ones hold; pseudo-examples smooth
    the shares, which no sampling rate (inverse: rates, clean and toxic) changes. The idf is of the whole fold."""
    every = toxic + clean
    apart = np.log((n_toxic + toxic / every) / (toxic + 1)) - np.log((n_clean + clean / every) / (clean + 1)) if toxic and clean else 0.0
    return (0.1 + np.abs(apart)) ** 2 * (np.log((1 + toxic * rates[1] + clean * rates[0]) / (1 + n_toxic * rates[1] + n_clean * rates[0])) + 1)


@dataclass(frozen=True)
class Index:
    """An inverted index of unit vectors in blocks of consecutive examples. Terms are numbered by falling frequency, so
    that the first n_common are the common ones."""

    terms: dict[str, int]
    weights: list[float]
    ids: np.ndarray
    y: np.ndarray
    mass: np.ndarray  # inverse sampling rates, 1 on average
    bounds: np.ndarray  # where each term's list starts in places and values
    places: np.ndarray
    values: np.ndarray
    n_common: int
    block: int
    k: int
    slope: float
    shift: float
    prior: float
    blank: float

    @property
    def blocks(self) -> list[dict[int, tuple[np.ndarray, np.ndarray]]]:
        """The lists of each block: term -> (places in the block, weights)."""
        out: list[dict] = [{} for _ in range(-(-len(self.ids) // self.block))]
        for t in range(len(self.terms)):
            at, w = self.places[self.bounds[t] : self.bounds[t + 1]], self.values[self.bounds[t] : self.bounds[t + 1]]
            for b in np.unique(at // self.block):
                here = at // self.block == b
                out[b][t] = at[here] - b * self.block, w[here]
        return out

    @cached_property
    def common(self) -> np.ndarray:
        """Weights of the common terms, blocks x terms x places."""
        n_blocks = -(-len(self.ids) // self.block)
        out = np.zeros((n_blocks, self.n_common, self.block))
        n = self.bounds[self.n_common]
        at = self.places[:n]
        out[at // self.block, np.repeat(np.arange(self.n_common), np.diff(self.bounds[: self.n_common + 1])), at % self.block] = self.values[:n]
        return out

    @cached_property
    def highest(self) -> np.ndarray:
        """The highest weight of each common term in each block, terms x blocks."""
        return self.common.max(2).T

    def vector(self, bag: Counter) -> dict[int, float]:
        raw = {t: (1 + log(n)) * self.weights[t] for w, n in bag.items() if (t := self.terms.get(w)) is not None}
        norm = sqrt(sum(v * v for v in raw.values())) or 1.0
        return {t: v / norm for t, v in raw.items()}

    def nearest(self, vector: dict[int, float], skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples, exactly, without the example skip."""
        ts = np.fromiter(vector, np.int64, len(vector))
        qs = np.fromiter(vector.values(), float, len(ts))
        rare = ts >= self.n_common
        starts, sizes = self.bounds[ts[rare]], self.bounds[ts[rare] + 1] - self.bounds[ts[rare]]
        lists = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        n_blocks = -(-len(self.ids) // self.block)
        found = np.bincount(self.places[lists], self.values[lists] * np.repeat(qs[rare], sizes), n_blocks * self.block).astype(float)
        if skip >= 0:
            found[skip] = -np.inf
        parts = found.reshape(n_blocks, self.block)
        tc, qc = ts[~rare], qs[~rare]
        if len(tc) and n_blocks:
            bounds = parts.max(1) + qc @ self.highest[tc]
            least = np.partition(found, -self.k)[-self.k] if len(found) > self.k else 0.0
            top = np.empty(0)
            for b in np.argsort(-bounds, kind="stable"):
                if bounds[b] + 1e-12 < least:
                    break
                parts[b] += qc @ self.common[b, tc]
                top = np.concatenate([top, parts[b][parts[b] >= least]])
                if len(top) > self.k:
                    top = np.partition(top, -self.k)[-self.k :]
                    least = max(least, top[0])
        hit = np.flatnonzero(found > 0)
        if len(hit) > self.k:
            hit = hit[found[hit] >= np.partition(found[hit], -self.k)[-self.k]]
        hit = hit[np.argsort(-found[hit], kind="stable")][: self.k]
        return hit, found[hit]

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """The log-odds of the distance-weighted share of toxic neighbours."""
        votes = cosines * self.mass[places]
        share = ((votes * self.y[places]).sum() + self.prior) / (votes.sum() + 1)
        return float(np.log(share / (1 - share)))

    def score(self, vector: dict[int, float]) -> tuple[float, np.ndarray, np.ndarray]:
        if not vector:
            return self.blank, np.empty(0, np.int64), np.empty(0)
        places, cosines = self.nearest(vector)
        return float(1 / (1 + np.exp(-(self.slope * self.vote(places, cosines) + self.shift)))), places, cosines


def build_index(ids: list, texts: list[str | None], labels: np.ndarray, k: int = 15, block: int = 64, rates: tuple[float, float] = (1.0, 1.0)) -> Index:
    """rates: of how many clean and of how many toxic labelled rows an example of that class stands."""
    y = np.asarray(labels, float)
    stands = np.where(y > 0, rates[1], rates[0])
    mass = stands / stands.mean() if len(y) else stands
    bags = [terms_of(t) for t in texts]
    held = Counter(w for b in bags for w in b)
    terms = {w: i for i, w in enumerate(sorted(held, key=lambda w: (-held[w], w)))}
    numbers = [np.fromiter((terms[w] for w in b), np.int64, len(b)) for b in bags]
    of_class = [np.bincount(np.concatenate([x for x, v in zip(numbers, y, strict=True) if v == c] or [np.empty(0, np.int64)]), minlength=len(terms)).astype(float) for c in (1, 0)]
    weights = word_weights(*of_class, y.sum(), len(y) - y.sum(), rates)
    prior = (y @ stands + 0.5) / (stands.sum() + 1)
    bare = np.array([not b for b in bags], bool)
    blank = (y[bare] @ mass[bare] + prior) / (mass[bare].sum() + 1) if len(y) else 0.5
    empty = np.empty(0)
    n_common = sum(n * COMMON > len(y) for n in held.values())
    draft = Index(terms, weights.tolist(), np.array(ids), y, mass, np.zeros(len(terms) + 1, np.int64), empty, empty, n_common, block, k, 1.0, 0.0, float(prior), float(blank))
    vectors = [draft.vector(b) for b in bags]
    every = np.concatenate([*numbers, np.empty(0, np.int64)])
    order = np.argsort(every, kind="stable")
    lists = {
        "bounds": np.searchsorted(every[order], np.arange(len(terms) + 1)),
        "places": np.repeat(np.arange(len(y)), [len(b) for b in bags])[order],
        "values": np.array([v for x in vectors for v in x.values()], float)[order],
    }
    index = Index(**draft.__dict__ | lists)
    kept = np.flatnonzero(~bare)
    if not len(kept):
        return index
    votes = np.array([index.vote(*index.nearest(vectors[i], skip=i)) for i in kept])
    slope, shift = _platt(votes, y[kept], mass[kept])
    return replace(index, slope=slope, shift=shift)


def _platt(votes: np.ndarray, y: np.ndarray, mass: np.ndarray) -> tuple[float, float]:
    """Newton steps of a weighted logistic fit with smoothed targets and a small ridge towards slope 1."""
    toxic = y @ mass
    target = np.where(y > 0, (toxic + 1) / (toxic + 2), 1 / (mass.sum() - toxic + 2))
    w = np.array([1.0, 0.0])
    x = np.stack([votes, np.ones_like(votes)], 1)
    ridge = np.diag([1.0, 0.01])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (mass * (p - target)) + ridge @ (w - np.array([1.0, 0.0]))
        w = w - np.linalg.solve((x.T * (mass * p * (1 - p))) @ x + ridge, grad)
    return max(float(w[0]), 0.05), float(w[1])


def learn_toxicity(docs: DataFrame, labels: DataFrame, learning: Column, most_examples: int = 4_000, **params) -> Index:
    """labels: doc_id, label 0/1. Toxic examples come first, up to half of most_examples. Of rows that share an id, the
    least text counts."""
    fold = labels.where(learning).where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    there = {int(r["label"]): r["count"] for r in fold.groupBy("label").count().collect()}
    n_toxic = min(there.get(1, 0), most_examples // 2)
    taken = {1: n_toxic, 0: min(there.get(0, 0), most_examples - n_toxic)}
    toxic = fold.where("label = 1").orderBy(*order).limit(taken[1])
    clean = fold.where("label = 0").orderBy(*order).limit(taken[0])
    few = docs.select("doc_id", "text").join(F.broadcast(toxic.unionByName(clean)), "doc_id")
    rows = few.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).orderBy(*order).toPandas()
    rates = tuple(there[c] / taken[c] if taken[c] else 1.0 for c in (0, 1))
    return build_index(rows["doc_id"].tolist(), rows["text"].tolist(), rows["label"].to_numpy(float), rates=rates, **params)


def score_toxicity(docs: DataFrame, index: Index, text_col: str = "text", evidence: int = 3) -> DataFrame:
    """docs with ``score`` and ``evidence``: the nearest examples as (doc_id, cosine, label). Columns of these names
    are replaced. The index has a bound: the words of most_examples rows."""
    docs = without(docs, "score", "evidence")
    kind = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("evidence", kind)])
    place = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    arrow = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.score(own.vector(terms_of(t.as_py()))) for t in batch.column(place)]
            proof = [[{"doc_id": int(own.ids[p]), "cosine": float(c), "label": int(own.y[p])} for p, c in zip(ps[:evidence], cs[:evidence], strict=True)] for _, ps, cs in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _, _ in found], pa.float64()), pa.array(proof, arrow)], names=schema.names)

    return in_arrow(docs, score, schema)
