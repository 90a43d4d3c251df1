"""N-gram Jaccard join by grouped prefixes, and the components of its links.

A document is the set of its distinct 5-word shingles (fewer words: the whole sequence). Two documents link when
100 * |intersection| >= 80 * |union|, exactly; for sizes m and n that is an intersection of at least 4 (m + n) / 9, or a
symmetric difference of at most (m + n) / 9. Documents with equal sets are one class, known by a 64-bit hash of the set.

1. Sieve. Sets sorted by hash that link share at least l shingles of their first n - ceil(0.8 n) + l. Every class posts
   these with l = n / 10, 30 % of its shingles. A class stays if enough of what it posted is posted by another class.
   No range gets a shingle that very many classes hold: a sample of classes tells which these are, they count as shared
   wherever they occur, and their classes learn of them where they are read.
2. Frequencies. Classes that stay post whole sets, so each learns which of its shingles others hold, and how many. Shingles
   that no other class holds count as the rarest. In order of frequency, two sets that link share one of their first
   n - ceil(0.8 n) + 1, the prefix; a class with fewer shared shingles than ceil(0.8 n) links with nothing.
3. Groups. Classes with identical prefixes and sizes collapse into one group, which posts its prefix once. Group pairs
   that share a posted shingle pass the size, position and sketch filters or go; what is left expands to members, and
   these are verified on whole sets.
4. Copies. Members first compare themselves to their group's first member, and groups to the best of a few centres, one
   for each shingle and size; so a cluster of near copies becomes one component with work in proportion to its size. Group
   pairs then need a look only across components. Hot shingles are split: units outside the shingle's largest component
   meet all others in chunks.

The sketch of a set is the parity of its shared shingles in 512 bins: bins that differ are shingles that differ. A group
keeps the bins that are odd for all members and those that are odd for any, so two groups surely differ in the bins that
are odd for all of one and for none of the other.

Defined results: texts without words and null texts have no shingles, link with nothing and are their own component;
repeated rows are exact copies; the least id of a component leaves null ids out where it has others; an empty table gives
no rows. Columns of docs other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk.llm.common import discard, hinted, in_arrow, stored
from gridrisk.llm.components import components
from gridrisk.llm.text import GOLD, mixed, shingle_sets

WIDTH = 5
#: Shingles that a range of the hash space gets on average, and that a task deals out at a time.
TOKENS_PER_RANGE = 1_000_000
#: A shingle of so many classes, or of a millionth of all postings, is hot: it is found in a sample and sent to no range.
HOT_CLASSES = TOKENS_PER_RANGE // 4
#: Classes of a hot shingle that the sample has on average; half as many make it known.
SAMPLED = 64
#: What a hot shingle counts as, for all classes that hold it.
HOT = 2**31 - 1
#: Units that one task of a hot shingle looks at for each unit outside the shingle's largest component.
CHUNK = 1_000
SKETCH = 8  # longs


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def least_overlap(n):
    """Of a set of n with any set that it links with."""
    return -(-4 * n // 5)


def sieve_depth(n):
    """The l of the sieve, which grows with n."""
    return np.maximum(1, n // 10)


def set_key(shingles: np.ndarray) -> np.int64:
    with np.errstate(over="ignore"):
        return mixed(np.add.reduce(mixed(shingles ^ GOLD)) + np.uint64(len(shingles)) * GOLD).astype(np.uint64).view(np.int64)


def measured(texts: DataFrame) -> DataFrame:
    """texts: id, copy (a hash of the text), text. Per row: id, copy, n, cls (null without shingles) and what the class
    posts to the sieve, given once in a task."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sizes, keys, posts = [], [], []
            for s in shingle_sets(batch.column(2), WIDTH):
                n, key = len(s), int(set_key(s)) if len(s) else None
                sizes.append(n)
                keys.append(key)
                posts.append(s[: n - least_overlap(n) + int(sieve_depth(n))].tobytes() if n and key not in seen else None)
                seen.add(key)
            if len(seen) > 500_000:
                seen.clear()
            columns = [pa.array(sizes, pa.int32()), pa.array(keys, pa.int64()), pa.array(posts, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "copy", "n", "cls", "posts"])

    kind = texts.schema["id"].dataType.simpleString()
    return in_arrow(texts.select("id", "copy", "text"), measure, f"id {kind}, copy long, n int, cls long, posts binary")


def hot_tokens(sets: DataFrame, total: float, least: int | None = None) -> np.ndarray:
    """The tokens, sorted, that surely have many classes: least of them, by default HOT_CLASSES or a millionth of total,
    all postings. They come from a sample of classes by their hash, so one with few more than that may be missing, which
    costs memory and no result; at most some two million are found. Each has two classes at least."""
    least = least or max(HOT_CLASSES, int(total / 1_000_000))
    one_of = max(1, least // SAMPLED)
    chosen = sets.where(F.pmod(F.xxhash64("cls", F.lit("hot")), F.lit(one_of)) == 0)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flat = np.frombuffer(tokens, np.uint64)
                yield pa.RecordBatch.from_arrays([signed(flat), pa.array(np.full(len(flat), key))], names=["token", "cls"])

    rows = in_arrow(chosen.select("cls", "tokens"), spread, "token long, cls long").distinct().groupBy("token").agg(F.count("*").alias("classes"))
    found = rows.where(F.col("classes") >= max(2, least // one_of // 2)).select("token").toArrow()
    return np.sort(found["token"].to_numpy().view(np.uint64)) if found.num_rows else np.empty(0, np.uint64)


def is_hot(flat: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(flat), bool)
    return hot[np.minimum(np.searchsorted(hot, flat), len(hot) - 1)] == flat


def held_hot(sets: DataFrame, shared) -> DataFrame:
    """cls, n and those of its tokens that are hot, once for each class that has any. shared: the broadcast hot tokens."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            rows = []
            for key, n, tokens in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                flat = np.frombuffer(tokens, np.uint64)
                if (own := is_hot(flat, hot)).any():
                    rows.append((key, n, flat[own].tobytes()))
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["cls", "n", "tokens"])

    return in_arrow(sets.select("cls", "n", "tokens"), task, "cls long, n int, tokens binary").dropDuplicates(["cls"])


def hot_blocks(sets: DataFrame, shared, ranges: int, columns: Callable[[np.ndarray, np.ndarray, list[np.ndarray]], tuple]) -> DataFrame:
    """Blocks (range, block) by range of classes for the hot tokens alone; columns makes a block of classes, sizes and
    their hot tokens."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, size = (batch.column(k).to_numpy() for k in range(2))
            tokens = [np.frombuffer(t, np.uint64) for t in batch.column(2).to_pylist()]
            for r, o in by_class(key, ranges):
                yield block_row(r, *columns(key[o], size[o], [tokens[k] for k in o]))

    return in_arrow(held_hot(sets, shared), task, "range int, block binary")


def dealt(sets: DataFrame, ranges: int, shared) -> DataFrame:
    """sets: cls, n, tokens (binary). Blocks (range, block) by range of the hash space; a block is the classes, their sizes
    and how many tokens each has in the range, then the tokens. Hot tokens (shared, a broadcast) are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(t, np.uint64) for t in batch.column(2).to_pylist()]
            start = 0
            while start < len(tokens):  # about TOKENS_PER_RANGE tokens at a time
                end, held = start, 0
                while end < len(tokens) and held < TOKENS_PER_RANGE:
                    held, end = held + len(tokens[end]), end + 1
                flat = np.concatenate(tokens[start:end])
                owner = np.repeat(np.arange(end - start), [len(t) for t in tokens[start:end]])
                if len(shared.value):
                    cold = ~is_hot(flat, shared.value)
                    flat, owner = flat[cold], owner[cold]
                at = (mixed(flat) >> np.uint64(32)).astype(np.int64) * ranges >> 32
                order = np.argsort(at, kind="stable")
                bounds = np.searchsorted(at[order], np.arange(ranges + 1))
                keys, sizes = (batch.column(k).to_numpy(zero_copy_only=False)[start:end] for k in range(2))
                for r in np.flatnonzero(np.diff(bounds)):
                    o = order[bounds[r] : bounds[r + 1]]
                    own, counts = np.unique(owner[o], return_counts=True)
                    block = keys[own].astype(np.int64).tobytes() + sizes[own].astype(np.int32).tobytes() + counts.astype(np.int32).tobytes() + flat[o].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([len(own)], pa.int32()), pa.array([block], pa.binary())], names=["range", "classes", "block"])
                start = end

    blocks = in_arrow(sets.select("cls", "n", "tokens"), pack, "range int, classes int, block binary")
    return blocks.repartitionById(ranges, "range")


def held_by_two(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
    """Of the blocks of a range: token, class, size and number of classes of every token that two classes hold."""
    tokens, keys, sizes = [], [], []
    for batch in batches:
        for m, block in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = block.as_buffer()
            counts = np.frombuffer(raw, np.int32, m, 12 * m)
            tokens.append(np.frombuffer(raw, np.uint64, offset=16 * m))
            keys.append(np.repeat(np.frombuffer(raw, np.int64, m), counts))
            sizes.append(np.repeat(np.frombuffer(raw, np.int32, m, 8 * m), counts))
    if not tokens:
        return None
    token, key, size = np.concatenate(tokens), np.concatenate(keys), np.concatenate(sizes)
    del tokens, keys, sizes
    order = np.lexsort((key, token))
    token, key, size = token[order], key[order], size[order]
    fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])])  # a class may come from several tasks
    token, key, size = token[fresh], key[fresh], size[fresh]
    run = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1
    many = np.bincount(run)[run]
    held = many > 1
    return token[held], key[held], size[held], many[held]


def by_class(key: np.ndarray, ranges: int) -> Iterator[tuple[int, np.ndarray]]:
    """The ranges of classes and which of key fall into each."""
    at = (mixed(key.view(np.uint64)) >> np.uint64(32)).astype(np.int64) * ranges >> 32
    order = np.argsort(at, kind="stable")
    bounds = np.searchsorted(at[order], np.arange(ranges + 1))
    for r in np.flatnonzero(np.diff(bounds)):
        yield int(r), order[bounds[r] : bounds[r + 1]]


def gathered(batches: Iterator[pa.RecordBatch], kinds: tuple) -> list[np.ndarray] | None:
    """The columns of all blocks, each of which holds them one after another, of these kinds."""
    widths = [np.dtype(k).itemsize for k in kinds]
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for batch in batches:
        for block in batch.column(1):
            raw = block.as_buffer()
            m = raw.size // sum(widths)
            for k, part in enumerate(parts):
                part.append(np.frombuffer(raw, kinds[k], m, sum(widths[:k]) * m))
    return [np.concatenate(p) for p in parts] if parts[0] else None


def block_row(r: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([b"".join(c.tobytes() for c in columns)], pa.binary())], names=["range", "block"])


def with_hot(blocks: DataFrame, more: Callable[[], DataFrame], hot: np.ndarray, ranges: int) -> DataFrame:
    """blocks, with those of the hot tokens if there are any, by range."""
    return (blocks.unionByName(more()) if len(hot) else blocks).repartitionById(ranges, "range")


def sieved(prints: DataFrame, ranges: int, total: float, least: int | None = None) -> DataFrame:
    """prints: as measured. (cls, n) of the classes that may link. total: all postings; least: as for hot_tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := held_by_two(batches):
            _, key, size, _ = found
            own, at, counts = np.unique(key, return_index=True, return_counts=True)
            for r, o in by_class(own, ranges):
                yield block_row(r, own[o], size[at][o].astype(np.int32), counts[o].astype(np.int32))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := gathered(batches, (np.int64, np.int32, np.int32)):
            own, at, which = np.unique(found[0], return_index=True, return_inverse=True)
            n, shared = found[1][at], np.bincount(which, found[2])
            kept = shared >= sieve_depth(least_overlap(n.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(own[kept]), pa.array(n[kept])], names=["cls", "n"])

    posts = prints.where("posts IS NOT NULL").select("cls", "n", F.col("posts").alias("tokens"))
    hot = hot_tokens(posts, total, least)
    shared = prints.sparkSession.sparkContext.broadcast(hot)
    each = lambda key, size, tokens: (key, size.astype(np.int32), np.array([len(t) for t in tokens], np.int32))
    counts = in_arrow(dealt(posts, ranges, shared), count, "range int, block binary")
    return in_arrow(with_hot(counts, lambda: hot_blocks(posts, shared, ranges, each), hot, ranges), choose, "cls long, n int")


def whole_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: copy. (cls, n, tokens) of the texts with these hashes, each class once in a task."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for s in shingle_sets(batch.column(0), WIDTH):
                if len(s) and (key := int(set_key(s))) not in seen:
                    seen.add(key)
                    rows.append((key, len(s), s.tobytes()))
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["cls", "n", "tokens"])

    return in_arrow(texts.join(hinted(wanted), "copy", "left_semi").select("text"), measure, "cls long, n int, tokens binary")


SKETCHES = [f"s{k}" for k in range(SKETCH)]


def with_prefixes(sets: DataFrame, ranges: int, total: float, least: int | None = None) -> DataFrame:
    """sets: cls, n, tokens. Of the classes of which enough is shared: cls, n, alone (how many shingles no other class
    holds), prefix (those of the prefix that others hold, rarest first) and the longs of the sketch. Hot shingles count as
    the most frequent, for all classes alike, so their order is one and the same. total, least: as for hot_tokens."""

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (found := held_by_two(batches)):
            return
        token, key, size, many = found
        for r, o in by_class(key, ranges):
            yield block_row(r, key[o], token[o], size[o].astype(np.int32), np.minimum(many[o], HOT).astype(np.int32))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (found := gathered(batches, (np.int64, np.uint64, np.int32, np.int32))):
            return
        key, token, size, many = found
        order = np.lexsort((token, many, key))
        key, token, size = key[order], token[order], size[order]
        bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        rows, prefixes = [], []
        for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            n, shared = int(size[a]), b - a
            alone = n - shared
            if shared < least_overlap(n):
                continue
            bins = np.bincount((token[a:b] >> np.uint64(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
            sketch = np.packbits(bins.astype(bool), bitorder="little").view(np.int64)
            prefixes.append(token[a : a + n - least_overlap(n) + 1 - alone].view(np.int64))
            rows.append((int(key[a]), n, alone, *sketch.tolist()))
        columns = list(zip(*rows, strict=True)) or [[] for _ in range(3 + SKETCH)]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*prefixes, np.empty(0, np.int64)])))
        kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * SKETCH)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), lists], names=["cls", "n", "alone", *SKETCHES, "prefix"])

    def each(key: np.ndarray, size: np.ndarray, tokens: list[np.ndarray]) -> tuple:
        n = [len(t) for t in tokens]
        return np.repeat(key, n), np.concatenate(tokens), np.repeat(size, n).astype(np.int32), np.full(sum(n), HOT, np.int32)

    hot = hot_tokens(sets, total, least)
    shared = sets.sparkSession.sparkContext.broadcast(hot)
    blocks = with_hot(in_arrow(dealt(sets, ranges, shared), reply, "range int, block binary"), lambda: hot_blocks(sets, shared, ranges, each), hot, ranges)
    return in_arrow(blocks, choose, f"cls long, n int, alone int, {', '.join(f'{s} long' for s in SKETCHES)}, prefix array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets link, exactly. sets: cls (distinct), tokens."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                m, n = len(x) // 8, len(y) // 8
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort(kind="stable")
                inside = int((both[1:] == both[:-1]).sum())
                kept.append(100 * inside >= 80 * (m + n - inside))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    one = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    return stored(in_arrow(both, check, "a long, b long"), "links")


def surely_differ(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Shingles in which any members of two units differ at least; a and b give the columns of a unit by name."""
    bins = sum((F.bit_count(a(f"all_{s}").bitwiseAND(F.bitwise_not(b(f"any_{s}")))) + F.bit_count(b(f"all_{s}").bitwiseAND(F.bitwise_not(a(f"any_{s}")))) for s in SKETCHES), F.lit(0))
    return a("alone") + b("alone") + bins


def could_link(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """The size and sketch filters of two units."""
    sizes = a("n") + b("n")
    return (5 * F.least(a("n"), b("n")) >= 4 * F.greatest(a("n"), b("n"))) & (9 * surely_differ(a, b) <= sizes)


def units_of(members: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """members: cls, gid, n, alone, sketch, prefix. The members with comp and unit (the least class of a group in one
    component), and one row per unit."""
    placed = members.withColumn("comp", F.col("cls")) if labels is None else members.join(labels.select("node", "label"), F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("label", "cls"))
    both = [f(s).alias(f"{name}_{s}") for s in SKETCHES for name, f in (("all", F.bit_and), ("any", F.bit_or))]
    same = [F.first(c).alias(c) for c in ("n", "alone", "prefix")]
    units = placed.groupBy("gid", "comp").agg(F.min("cls").alias("unit"), *same, *both)
    return placed.select("cls", "gid", "comp"), units


def postings_of(units: DataFrame, *columns: str) -> DataFrame:
    """Per unit and shingle of its prefix: token, place (in order of frequency, from 0) and columns of the unit."""
    rows = units.select("unit", "n", "alone", *columns, F.posexplode("prefix").alias("at", "token"))
    return rows.withColumn("place", F.col("alone") + F.col("at")).drop("at")


def star_pairs(units: DataFrame) -> DataFrame:
    """Pairs of classes: of each group its members with the first, and of each unit the centres with which it shares most
    posted shingles. The centre of a shingle and size is the unit that has the least alone for its size; sizes are parted
    twice, half a step apart."""
    size = F.log(F.col("n")) / float(np.log(1.25))
    sized = postings_of(units, "comp").withColumn("part", F.explode(F.array(F.floor(size) * 2, F.floor(size + 0.5) * 2 + 1)))
    first = F.min(F.struct((F.col("alone") / F.col("n")).alias("share"), F.xxhash64("unit").alias("h"), F.col("unit").alias("centre"), F.col("comp").alias("other")))
    centres = sized.groupBy("token", "part").agg(first.alias("f"), F.count("*").alias("rows")).where("rows > 1").select("token", "part", "f.centre", "f.other")
    near = sized.join(centres, ["token", "part"]).where("comp <> other").groupBy("unit", "centre", F.pmod("part", F.lit(2)).alias("shift")).agg(F.count("*").alias("k"))
    own, other = (units.select(*[F.col(c).alias(f"{p}_{c}") for c in units.columns if c != "prefix"]) for p in "xy")
    fit = near.join(own, F.col("unit") == F.col("x_unit")).join(other, F.col("centre") == F.col("y_unit")).where(could_link(lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}")))
    best = fit.groupBy("unit", "shift").agg(F.max(F.struct("k", "centre")).alias("best"))
    return best.select(F.least("unit", "best.centre").alias("a"), F.greatest("unit", "best.centre").alias("b"))


def unit_pairs(units: DataFrame) -> DataFrame:
    """All pairs (a, b) of units in different components that share a posted shingle and pass the filters."""
    rows = postings_of(units, "comp")
    comps = rows.groupBy("token", "comp").agg(F.count("*").alias("rows")).groupBy("token")
    tokens = comps.agg(F.max(F.struct("rows", "comp")).alias("most"), F.sum("rows").alias("rows"), F.count("*").alias("comps")).where("comps > 1")
    tokens = tokens.select("token", F.col("most.comp").alias("most"), F.ceil(F.col("rows") / CHUNK).cast("int").alias("chunks"))
    sketches = [c for c in units.columns if c.startswith(("all_", "any_"))]
    live = postings_of(units, "comp", *sketches).join(tokens, "token")
    dealt_ = live.withColumn("chunk", F.pmod(F.xxhash64("unit"), F.col("chunks")).cast("int"))
    outside = live.where("comp <> most").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    a, b = dealt_.alias("a"), outside.alias("b")
    of = lambda side: lambda c: F.col(f"{side}.{c}")
    x, y = of("a"), of("b")
    once = (x("comp") == x("most")) | (x("unit") < y("unit"))
    left = F.least(x("n") - x("place"), y("n") - y("place"))  # shingles from here on, in the order of both
    near = a.join(b, (x("token") == y("token")) & (x("chunk") == y("chunk")) & (x("comp") != y("comp")) & once & (9 * left >= 4 * (x("n") + y("n"))) & could_link(x, y))
    return near.select(F.least(x("unit"), y("unit")).alias("a"), F.greatest(x("unit"), y("unit")).alias("b")).distinct()


def expanded(pairs: DataFrame, units: DataFrame, placed: DataFrame) -> DataFrame:
    """Pairs of units to pairs of their members."""
    members = placed.join(units.select("unit", "gid", "comp"), ["gid", "comp"]).select("unit", "cls")
    one = pairs.join(members.select(F.col("unit").alias("a"), F.col("cls").alias("x")), "a")
    return one.join(members.select(F.col("unit").alias("b"), F.col("cls").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def linked(members: DataFrame, sets: DataFrame) -> DataFrame | None:
    """members: as with_prefixes, with gid. Component labels (node, label) of the classes that link, or None."""
    own = members.where("cls <> gid").select(F.col("gid").alias("a"), F.col("cls").alias("b"))
    _, units = units_of(members.where("cls = gid"), None)
    links = verified(own.unionByName(star_pairs(units)), sets)
    labels = None if links.isEmpty() else components(links)
    placed, units = (stored(df, name) for df, name in zip(units_of(members, labels), ("placed", "units"), strict=True))
    rest = verified(expanded(unit_pairs(units), units, placed), sets)
    if not rest.isEmpty():
        before = labels
        labels = components(links.unionByName(rest))
        if before is not None:
            discard(before)
    discard(links, rest, placed, units)
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_classes: int | None = None) -> DataFrame:
    """One row per document: ``id``, ``n_shingles``, ``component`` (equal for all documents reachable by links) and
    ``component_id`` (the least id of the component). hot_classes: of how many classes a shingle is hot, see hot_tokens;
    it changes no result."""
    text = F.col(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("copy"), text.alias("text"))
    # A word has some six bytes, so this is near the number of shingles.
    shingles = (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) / 6
    ranges = lambda share: max(1, round(shingles * share / TOKENS_PER_RANGE))
    prints = stored(measured(texts), "prints")
    kept = stored(sieved(prints, ranges(0.3), 0.3 * shingles, hot_classes), "sieved")
    # One text for each class, of rows that posted: exact copies are few there.
    wanted = prints.where("posts IS NOT NULL").join(hinted(kept.select("cls")), "cls", "left_semi").groupBy("cls").agg(F.min("copy").alias("copy"))
    wanted = stored(wanted.select("copy").distinct(), "wanted")
    whole = stored(whole_sets(texts, wanted), "whole-sets")
    able = stored(with_prefixes(whole, ranges(0.3), shingles, hot_classes), "prefixes")
    groups = able.groupBy("n", "prefix").agg(F.min("cls").alias("gid"))
    members = stored(able.join(groups, ["n", "prefix"]), "members")
    alike = whole.join(hinted(able.select("cls")), "cls", "left_semi").groupBy("cls").agg(F.first("tokens").alias("tokens"))
    sets = stored(alike, "sets")
    discard(kept, wanted, whole, able)
    labels = linked(members, sets)
    discard(members, sets)
    out = prints.select("id", "n", "cls")
    if labels is not None:
        out = out.join(hinted(labels.select("node", "label")), F.col("cls") == F.col("node"), "left").select("id", "n", F.coalesce("label", "cls").alias("component"))
    else:
        out = out.withColumnRenamed("cls", "component")
    least = out.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("least"))
    out = out.join(least, "component", "left")
    return out.select("id", F.col("n").cast("long").alias("n_shingles"), "component", F.coalesce("least", "id").alias("component_id"))
