"""A log-bilinear language model trained with noise-contrastive estimation.

Tokens map to classes: the commonest training tokens stand alone, others share a class by their last two characters if
that ending is common, the rest share one, and the end of a text is a token. There are 4 N ** 0.25 classes (128 at least)
for N training tokens, two thirds of them single words, so the words with vectors of their own grow with the corpus while
a square table of classes, the largest thing that tasks hold, grows with the square root of it. The context of two
preceding classes predicts the next class: ``score(w | a, b) = (C1 R[a] + C2 R[b]) . Q[w] + bias[w]``, normalised by a
softmax over all classes. A token inside its class has the add-one probability (c + 1) / (N_class + V_class + 1) of its
exact training count c. So every text has a proper probability.

What the model learns from is gathered from all training texts: exact counts of every token, and all class triples,
counted in chunks of some CHUNK tokens. The chunks stay where tasks wrote them. In each of a few rounds every task trains
on its chunks with numpy, in NCE minibatches whose number is in proportion to the tokens of the chunk, and Spark averages
the parameters of the tasks, weighted by tokens. Since the score is bilinear, a token needs three look-ups in square
tables: one product for each preceding class, and the logarithm of the normaliser, which tasks compute once for all pairs
of classes by matrix products.

Counts of rare tokens reach the texts without a join on words: each task packs (token hash, text, count) into blocks by
hash range; a range holds all of a token's occurrences, learning and held out, so it computes the counts and answers each
block with its texts' sums of log10(c + 1) and numbers of known tokens; the replies to a batch of texts meet in one task. Tokens of the hot list (HOT commonest) never travel: their
exact counts are broadcast, at most HOT of them.

Defined results: null and empty texts are one end token; texts are keyed by a hash of id and text, so repeated rows have
equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrisk.llm.common import discard, in_arrow, stored
from gridrisk.llm.text import Hashes, lower_words, word_hashes

LEAST_CLASSES, HOT, CHUNK = 128, 65_536, 2_000_000
#: Training draws one token of so many, over all rounds.
TOKENS_PER_DRAW, BATCH = 8, 1024
#: The end of a text: words are never empty, so the empty word stands for it.
END = b""


@dataclass(frozen=True)
class Vocabulary:
    """Classes: 0 is the end, then the commonest tokens, then endings, last the rest."""

    hot: dict[bytes, int]
    alone: dict[bytes, int]
    endings: dict[bytes, int]
    total: int
    distinct: int
    class_tokens: np.ndarray
    class_distinct: np.ndarray

    @property
    def size(self) -> int:
        return 2 + len(self.alone) + len(self.endings)

    def unigram(self) -> np.ndarray:
        """Smoothed shares of the classes among the training tokens."""
        tokens = self.class_tokens.copy()
        tokens[0] = self.hot.get(END, 0)
        for word, k in self.alone.items():
            tokens[k] = self.hot[word]
        return (tokens + 0.5) / (tokens + 0.5).sum()

    def class_of(self, word: bytes) -> int:
        if word == END:
            return 0
        own = self.alone.get(word)
        return own if own is not None else self.endings.get(word.decode("utf-8", "ignore")[-2:].encode(), self.size - 1)


class Classes(dict):
    """Classes of words, remembered; forgotten when there are too many."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        if len(self) >= Hashes.MOST:
            self.clear()
        c = self[word] = self.vocabulary.class_of(word)
        return c


def class_number(tokens: int) -> int:
    """How many classes a corpus of so many tokens gets."""
    return max(LEAST_CLASSES, int(4 * tokens**0.25))


def count_tokens(texts: DataFrame, text: Column) -> DataFrame:
    """Exact counts (token, count) over all texts, ends included; each task adds up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                seen.update(lower_words(t.as_py()))
                seen[END] += 1
            if len(seen) > 1_000_000:
                yield flush(seen)
                seen = Counter()
        yield flush(seen)

    def flush(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "count"])

    parts = in_arrow(texts.select(text.alias("text")), count, "token binary, count long")
    return parts.groupBy("token").agg(F.sum("count").alias("count"))


def learn_vocabulary(counts: DataFrame) -> Vocabulary:
    """counts: a stored table of count_tokens. Collects the commonest tokens, HOT or as many as have classes of their
    own, and the endings that have a class."""
    total, distinct = counts.agg(F.sum("count"), F.count("*")).first()
    classes_in_all = class_number(total or 0)
    most_endings = classes_in_all // 3 - 2
    hot = {bytes(r["token"]): r["count"] for r in counts.orderBy(F.desc("count"), "token").limit(max(HOT, classes_in_all)).collect()}
    ending = F.right(F.col("token").cast("string"), F.lit(2)).cast("binary")
    words = [w for w in hot if w != END]
    alone = {w: k + 1 for k, w in enumerate(words[: classes_in_all - most_endings - 2])}
    rest = counts.where((F.octet_length("token") > 0) & ~F.col("token").isin(list(map(bytearray, alone)) or [bytearray(b"\x00")]))
    by_ending = rest.groupBy(ending.alias("e")).agg(F.sum("count").alias("n"), F.count("*").alias("v")).orderBy(F.desc("n"), "e")
    top = by_ending.limit(most_endings).collect()
    endings = {bytes(r["e"]): len(alone) + 1 + k for k, r in enumerate(top)}
    size = 2 + len(alone) + len(endings)
    tokens, kinds = np.zeros(size), np.zeros(size)
    for r in top:
        tokens[endings[bytes(r["e"])]], kinds[endings[bytes(r["e"])]] = r["n"], r["v"]
    n, v = rest.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    tokens[-1], kinds[-1] = n - tokens.sum(), v - kinds.sum()
    return Vocabulary(hot, alone, endings, total or 0, distinct, tokens, kinds)


def count_triples(texts: DataFrame, text: Column, vocabulary: Vocabulary) -> DataFrame:
    """A stored table of chunks (tokens, cells, counts): the class triples (before last, last, next) of some CHUNK tokens
    each and how often they occur there. Texts start after two ends."""
    shared, size = texts.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.size

    def chunk(runs: list[np.ndarray]) -> pa.RecordBatch:
        cells, counts = np.unique(np.concatenate(runs), return_counts=True)
        row = [pa.array([int(counts.sum())]), pa.array([cells.tobytes()], pa.binary()), pa.array([counts.astype(np.int32).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(row, names=["tokens", "cells", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, runs, tokens = Classes(shared.value), [], 0
        for batch in batches:
            for t in batch.column(0):
                c = classes(lower_words(t.as_py()), known)
                runs.append((c[:-2] * size + c[1:-1]) * size + c[2:])
                tokens += len(runs[-1])
                if tokens >= CHUNK:
                    yield chunk(runs)
                    runs, tokens = [], 0
        if runs:
            yield chunk(runs)

    return stored(in_arrow(texts.select(text.alias("text")), count, "tokens long, cells binary, counts binary"), "lm-triples")


def classes(words: list[bytes], known: Classes) -> np.ndarray:
    """Two ends, the classes of the words, and the end."""
    return np.fromiter((0, 0, *map(known.__getitem__, words), 0), np.int64, len(words) + 3)


@dataclass(frozen=True)
class LogBilinear:
    """Word vectors r (classes x width), position matrices c1 and c2, output vectors q, biases."""

    r: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    q: np.ndarray
    bias: np.ndarray

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores of (before last, next) and of (last, next); the score of a triple is their sum."""
        return (self.r @ self.c1) @ self.q.T, (self.r @ self.c2) @ self.q.T + self.bias

    def normaliser(self, before: int, halves: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The logarithm of the normaliser for every last class after one class."""
        first, second = halves or self.halves()
        scores = second + first[before]
        top = scores.max(-1, keepdims=True)
        return (top + np.log(np.exp(scores - top).sum(-1, keepdims=True)))[:, 0]

    def table(self) -> np.ndarray:
        """log10 probabilities of the next class, (before last, last, next); for small models."""
        first, second = self.halves()
        log_z = np.stack([self.normaliser(a) for a in range(len(self.r))])
        return (first[:, None, :] + second[None, :, :] - log_z[:, :, None]) / np.log(10)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.c1, self.c2, self.q, self.bias)])

    @staticmethod
    def of_flat(flat: np.ndarray, size: int, width: int) -> LogBilinear:
        shapes = ((size, width), (width, width), (width, width), (size, width), (size,))
        ends = np.cumsum([int(np.prod(x)) for x in shapes])
        return LogBilinear(*(x.reshape(shape) for x, shape in zip(np.split(flat, ends[:-1]), shapes, strict=True)))


def _added(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indices of at and the sums of their rows."""
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[starts], np.add.reduceat(rows[order], starts, axis=0)


def _nce_steps(p: LogBilinear, power: LogBilinear, cells: np.ndarray, counts: np.ndarray, unigram: np.ndarray, steps: int, rates: np.ndarray, noise: int, rng: np.random.Generator) -> None:
    """AdaGrad on the NCE loss, in place; only rows that a minibatch touches change. The noise words of a minibatch come
    from the unigram distribution of classes and are shared by its rows, so that gradients are matrix products."""
    size = len(unigram)
    log_noise, draw, draw_noise = np.log(noise * unigram), np.cumsum(counts, dtype=float), np.cumsum(unigram)

    def step_by(rate: float, value: np.ndarray, squares: np.ndarray, at, g: np.ndarray) -> None:
        squares[at] += g**2
        value[at] -= rate * g / np.sqrt(squares[at])

    for step in range(steps):
        k = cells[np.minimum(np.searchsorted(draw, rng.random(BATCH) * draw[-1], side="right"), len(cells) - 1)]
        noisy = np.minimum(np.searchsorted(draw_noise, rng.random(noise)), size - 1)
        a, b, true = k // size**2, k // size % size, k % size
        ra, rb = p.r[a], p.r[b]
        context = ra @ p.c1 + rb @ p.c2
        delta_true = (context * p.q[true]).sum(1) + p.bias[true] - log_noise[true]
        delta_noise = context @ p.q[noisy].T + p.bias[noisy] - log_noise[noisy]
        err_true = (1 / (1 + np.exp(-np.clip(delta_true, -30, 30))) - 1) / BATCH
        err_noise = 1 / (1 + np.exp(-np.clip(delta_noise, -30, 30))) / BATCH
        g_context = err_true[:, None] * p.q[true] + err_noise @ p.q[noisy]
        words, g_words = _added(np.concatenate([a, b]), np.concatenate([g_context @ p.c1.T, g_context @ p.c2.T]))
        outputs = np.concatenate([true, noisy])
        nexts, g_nexts = _added(outputs, np.concatenate([err_true[:, None] * context, err_noise.T @ context]))
        g_bias = np.bincount(outputs, np.concatenate([err_true, err_noise.sum(0)]), size)[nexts]
        g_c1, g_c2 = ra.T @ g_context, rb.T @ g_context
        for value, squares, at, g in ((p.r, power.r, words, g_words), (p.c1, power.c1, slice(None), g_c1), (p.c2, power.c2, slice(None), g_c2), (p.q, power.q, nexts, g_nexts), (p.bias, power.bias, nexts, g_bias)):
            step_by(rates[step], value, squares, at, g)


def train_nce(chunks: DataFrame, vocabulary: Vocabulary, width: int = 24, noise: int = 40, steps: int = 3000, rounds: int = 4, rate: float = 0.15, seed: int = 11) -> LogBilinear:
    """chunks: a table of count_triples. The minibatches of all rounds and chunks together draw one token of
    TOKENS_PER_DRAW, in small corpora so many that there are about ``steps`` of them."""
    spark, size, rng = chunks.sparkSession, vocabulary.size, np.random.default_rng(seed)
    unigram = vocabulary.unigram()
    shape = (size, width)
    flat = LogBilinear(rng.normal(0, 0.1, shape), np.eye(width) * 0.5, np.eye(width) * 0.7, rng.normal(0, 0.1, shape), np.log(unigram)).flat()
    power = np.full_like(flat, 1e-3)
    share = max(1 / TOKENS_PER_DRAW, steps * BATCH / max(1, vocabulary.total)) / rounds / BATCH
    for turn in range(rounds):
        start = spark.sparkContext.broadcast((flat, power))

        def train(batches: Iterator[pa.RecordBatch], turn=turn, start=start) -> Iterator[pa.RecordBatch]:
            own, squares = (x.copy() for x in start.value)
            p, sq = LogBilinear.of_flat(own, size, width), LogBilinear.of_flat(squares, size, width)
            seen = 0
            for batch in batches:
                for n, cells, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    mine = max(1, round(n * share))
                    rates = rate * (1 - (turn + np.arange(mine) / mine) / rounds)
                    draws = np.random.default_rng((seed, turn, n, seen))
                    _nce_steps(p, sq, np.frombuffer(cells.as_buffer(), np.int64), np.frombuffer(counts.as_buffer(), np.int32), unigram, mine, rates, noise, draws)
                    seen += n
            if seen:
                at = pa.array(np.arange(len(own)), pa.int32())
                yield pa.RecordBatch.from_arrays([at, pa.array(own * seen), pa.array(squares * seen), pa.array(np.full(len(own), float(seen)))], names=["at", "p", "power", "n"])

        trained = in_arrow(chunks, train, "at int, p double, power double, n double")
        means = trained.groupBy("at").agg((F.sum("p") / F.sum("n")).alias("p"), (F.sum("power") / F.sum("n")).alias("power")).toPandas()
        if len(means):
            flat, power = (np.ascontiguousarray(x) for x in means.sort_values("at")[["p", "power"]].to_numpy().T)
        start.unpersist()
    return LogBilinear.of_flat(flat, size, width)


def log_normalisers(spark: SparkSession, model: LogBilinear) -> np.ndarray:
    """The logarithms of the normalisers of all pairs (before last, last): 4 bytes for each pair of classes."""
    size, shared = len(model.r), spark.sparkContext.broadcast(model)

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = shared.value.halves()
        for batch in batches:
            for before in batch.column(0).to_pylist():
                row = shared.value.normaliser(before, halves).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([before]), pa.array([row.tobytes()], pa.binary())], names=["before", "row"])

    tasks = max(1, min(size, size**3 // 100_000_000))
    rows = in_arrow(spark.range(0, size, 1, tasks), normalise, "before long, row binary").collect()
    return np.stack([np.frombuffer(r["row"], np.float32) for r in sorted(rows, key=lambda r: r["before"])])


def _packed(shared, ranges: int):
    """Tasks that turn (key, learning, text) into blocks (range, origin, block) of rare tokens; a block holds the hashes,
    then the text keys, text after text, then the counts, negative where the text is held out. The origin is the same for
    all blocks of a batch of texts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, known = shared.value.hot, Hashes()
        for batch in batches:
            hashes, keys, counts = [], [], []
            for key, learning, text in zip(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), batch.column(2), strict=True):
                rare = Counter(w for w in lower_words(text.as_py()) if w not in hot)
                if rare:
                    hashes.append(word_hashes(list(rare), known))
                    keys.append(np.full(len(rare), key, np.int64))
                    counts.append(np.fromiter(rare.values(), np.int32, len(rare)) * (1 if learning.as_py() else -1))
            if not hashes:
                continue
            h, k, c = np.concatenate(hashes), np.concatenate(keys), np.concatenate(counts).astype(np.int32)
            at = (h >> np.uint64(32)).astype(np.int64) * ranges >> 32
            order, origin = np.argsort(at, kind="stable"), pa.array(k[:1])
            bounds = np.searchsorted(at[order], np.arange(ranges + 1))
            for r in np.flatnonzero(np.diff(bounds)):
                o = order[bounds[r] : bounds[r + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), origin, pa.array([h[o].tobytes() + k[o].tobytes() + c[o].tobytes()], pa.binary())], names=["range", "origin", "block"])

    return pack


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the tokens of a range and answers each of its blocks by one reply to the origin: the text keys, then the sums
    of log10(c + 1) over the text's tokens in the block, then how many of these are known."""
    origins, parts = [], [[], [], []]
    for batch in batches:
        origins += batch.column(1).to_pylist()
        for block in batch.column(2):
            raw = block.as_buffer()
            n = raw.size // 20
            parts[0].append(np.frombuffer(raw, np.uint64, n))
            parts[1].append(np.frombuffer(raw, np.int64, n, 8 * n))
            parts[2].append(np.frombuffer(raw, np.int32, n, 16 * n))
    if not origins:
        return
    bounds = np.cumsum([0, *map(len, parts[0])])
    h, k, c = (np.concatenate(x) for x in parts)
    del parts
    token = np.unique(h, return_inverse=True)[1]
    learnt = np.bincount(token, np.maximum(c, 0))
    times = np.abs(c).astype(np.int64)
    value, known = times * np.log10(learnt + 1)[token], times * (learnt > 0)[token]
    for origin, start, end in zip(origins, bounds, bounds[1:], strict=False):
        keys = k[start:end]
        firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        raw = keys[firsts].tobytes() + np.add.reduceat(value[start:end], firsts).tobytes() + np.add.reduceat(known[start:end], firsts).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([origin], pa.int64()), pa.array([raw], pa.binary())], names=["origin", "block"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text key the sums over all replies; a task holds one sum per text and a batch of replies."""
    keys, logs, known = np.empty(0, np.int64), np.empty(0), np.empty(0)
    for batch in batches:
        parts = [[keys], [logs], [known]]
        for block in batch.column(1):
            raw = block.as_buffer()
            n = raw.size // 24
            parts[0].append(np.frombuffer(raw, np.int64, n))
            parts[1].append(np.frombuffer(raw, np.float64, n, 8 * n))
            parts[2].append(np.frombuffer(raw, np.int64, n, 16 * n))
        keys, at = np.unique(np.concatenate(parts[0]), return_inverse=True)
        logs, known = (np.bincount(at, np.concatenate(x), len(keys)) for x in parts[1:])
    if len(keys):
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(logs), pa.array(known.astype(np.int64))], names=["key", "rare_log", "rare_known"])


def rare_sums(texts: DataFrame, vocabulary: Vocabulary, ranges: int) -> DataFrame:
    """texts: key, learning, text. Per key: rare_log and rare_known. Origins only say which sums meet early: the last
    grouping adds up what any of them hold of a key."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)
    blocks = in_arrow(texts.select("key", "learning", "text"), _packed(shared, ranges), "range int, origin long, block binary")
    replies = in_arrow(blocks.repartitionById(ranges, "range"), _summed, "origin long, block binary")
    sums = in_arrow(replies.repartition(ranges, "origin"), _merged, "key long, rare_log double, rare_known long")
    return sums.groupBy("key").agg(F.sum("rare_log").alias("rare_log"), F.sum("rare_known").alias("rare_known"))


def score_texts(texts: DataFrame, vocabulary: Vocabulary, model: LogBilinear) -> DataFrame:
    """texts: key, text. Per row: key, n_tokens, hot_known, hot_log (sum of log10(c + 1)) and model_log, the model's
    log10 probability but for log10(c + 1) of tokens in shared classes that are not hot."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, model, log_normalisers(spark, model)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, bilinear, log_z = shared.value
        known, size, log_z = Classes(words_of), words_of.size, log_z.ravel()
        before, last = (x.astype(np.float32).ravel() for x in bilinear.halves())
        within = np.log10(words_of.class_tokens + words_of.class_distinct + 1)
        single = np.zeros(size, bool)
        single[: len(words_of.alone) + 1] = True
        within[single] = 0
        hot = {w: float(np.log10(n + 1)) for w, n in words_of.hot.items()}
        end = hot.get(END, 0.0)
        for batch in batches:
            rows = []
            for t in batch.column(1):
                words = lower_words(t.as_py())
                c = classes(words, known)
                own = np.fromiter((hot.get(w, -1.0) for w in words), float, len(words))
                here = own >= 0
                first, second, third = c[:-2] * size, c[1:-1], c[2:]
                log = float(before[first + third].sum(dtype=float) + last[second * size + third].sum(dtype=float) - log_z[first + second].sum(dtype=float)) / np.log(10)
                inside = c[2:-1]
                log += float(own[here & ~single[inside]].sum() - within[inside].sum())
                rows.append((len(words) + 1, int(here.sum()) + (END in hot), float(own[here].sum()) + end, log))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())],
                names=["key", "n_tokens", "hot_known", "hot_log", "model_log"],
            )

    return in_arrow(texts.select("key", "text"), score, "key long, n_tokens long, hot_known long, hot_log double, model_log double")


def score_corpus(docs: DataFrame, learning: Column, id_col: str = "doc_id", text_col: str = "text", tokens_per_range: int = 2_000_000, **training) -> DataFrame:
    """One row per document: the id, held_out, n_tokens, n_known, train_tokens, base_score and score. Rare tokens are summed
    in ranges of their hashes that get so many tokens at most on average, frequent ones in tasks of texts."""
    texts = docs.select(F.col(f"`{id_col}`"), F.xxhash64(f"`{id_col}`", f"`{text_col}`").alias("key"), F.coalesce(learning, F.lit(True)).alias("learning"), F.col(f"`{text_col}`").alias("text"))
    learnt = texts.where("learning")
    counts = stored(count_tokens(learnt, F.col("text")), "lm-counts")
    vocabulary = learn_vocabulary(counts)
    triples = count_triples(learnt, F.col("text"), vocabulary)
    model = train_nce(triples, vocabulary, **training)
    discard(triples, counts)
    keyed = texts.select(id_col, "key", "learning")
    # Equal rows share a key: each adds the same to the sums, which are parted again.
    alike = [F.first(c).alias(c) for c in ("n_tokens", "hot_known", "hot_log", "model_log")]
    scored = stored(score_texts(texts, vocabulary, model).groupBy("key").agg(F.count("*").alias("rows"), *alike), "lm-scored")
    tokens = scored.agg(F.sum(F.col("rows") * F.col("n_tokens"))).first()[0] or 0
    ranges = max(16, tokens // tokens_per_range)
    found = keyed.join(scored, "key").join(rare_sums(texts, vocabulary, ranges), "key", "left")
    rare = F.coalesce(F.col("rare_log") / F.col("rows"), F.lit(0.0))
    rare_known = F.coalesce((F.col("rare_known") / F.col("rows")).cast("long"), F.lit(0))
    base = F.log10(F.lit(float(vocabulary.total + vocabulary.distinct + 1)))
    return found.select(
        id_col,
        (~F.col("learning")).alias("held_out"),
        "n_tokens",
        (F.col("hot_known") + rare_known).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("hot_log") + rare - F.col("n_tokens") * base).alias("base_score"),
        (F.col("model_log") + rare).alias("score"),
    )
