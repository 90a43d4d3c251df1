"""Hard negatives, vector codes and exact copies against plain Python on odd rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridrisk.llm import codes, dedup, negatives, vectors
from gridrisk.llm.common import with_group
from gridrisk.llm.gnat import Gnat, squared
from gridrisk.llm.queries import QUERIES

RNG = np.random.default_rng(7)


def test_tree_finds_the_nearest_with_the_lowest_index():
    for width, n, spread in ((4, 64, 20), (4, 64, 2), (2, 1, 5), (3, 200, 2**25), (4, 64, 1)):
        points, queries = RNG.integers(-spread, spread, (n, width)), RNG.integers(-spread, spread, (500, width))
        far = squared(queries, points)
        index, gap = Gnat(points).nearest(queries)
        assert (index == far.argmin(axis=1)).all() and (gap == far.min(axis=1)).all()


def test_tree_skips_subtrees_but_no_tie():
    points = np.array([[10 * k, 0] for k in range(64)])
    seen, visit = [], Gnat._visit
    Gnat._visit = lambda self, q, rows, *a: (seen.append(len(rows) * len(self.splits)), visit(self, q, rows, *a))[1]
    try:
        index, _ = Gnat(points).nearest(np.array([[10 * k + 5, 0] for k in range(63)]))
    finally:
        Gnat._visit = visit
    assert index.tolist() == list(range(63)) and sum(seen) < 63 * 64 / 2


@pytest.mark.parametrize(("dims", "most"), [(64, 300), (64, 2**25), (768, 2**20), (1, 1), (3, 0)])
def test_residues_give_exact_scores(dims, most):
    a, b = RNG.integers(-most, most + 1, (7, dims)), RNG.integers(-most, most + 1, (9, dims))
    bound = int(np.sqrt((a.astype(float) ** 2).sum(1)).max() * np.sqrt((b.astype(float) ** 2).sum(1)).max() * 1.001) + 1
    primes = negatives.primes_for(dims, bound)
    assert len(set(primes)) == len(primes) and dims * (max(primes) // 2) ** 2 <= negatives.EXACT
    got = negatives.products(*[{p: negatives.centred(x, p).astype(np.float32) for p in primes} for x in (a, b)], primes)
    assert (got == a @ b.T).all()


DIMS = 16
EDGE = [(800, None, 1), (801, [0.5] * DIMS, None), (802, [0.5] * (DIMS - 1) + [None], 1), (803, [0.5] * (DIMS - 1) + [float("nan")], 1),
        (804, [float("inf")] + [0.5] * (DIMS - 1), 1), (None, [0.25] * DIMS, 2), (805, [0.5] * 3, 1), (806, [], 1), (807, [1e30] + [0.0] * (DIMS - 1), 3), (808, [-0.001] * DIMS, 3)]
MADE = [(k, [float(np.float32(x)) for x in RNG.normal(0, 0.2, DIMS)], int(RNG.integers(0, 10))) for k in range(230)]
ROWS = [*MADE, *EDGE, *[(900 + k, MADE[5][1], MADE[5][2]) for k in range(40)], MADE[11], MADE[11], (500, MADE[5][1], MADE[5][2]), (600, MADE[8][1], 4)]


def frame(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.select("*", *[F.lit("mine").alias(c) for c in ("id", "vector", "anchor", "row", "code", "error", "list")])


def ints(v):
    most = 2 ** vectors.bits(len(v))
    return [int(min(max(math.floor(256 * x), -most), most)) for x in v]


def fine(v):
    return v is not None and len(v) == DIMS and all(x is not None and math.isfinite(x) for x in v)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("vectors")
    frame(spark).repartition(5).write.parquet(f"{base}/odd/embeddings.parquet")
    return str(base)


def test_negatives(spark, folders):
    kept = [(i, (label + 1) % 10 if i % 7 == 0 else label, np.array(ints(v))) for i, v, label in ROWS if fine(v) and label is not None and i is not None]
    want = []
    for a, own, v in kept:
        if a % 100:
            continue
        scored = [(-int(v @ w), i, label) for i, label, w in kept]
        for s, p, _ in sorted(x for x in scored if x[2] == own and x[1] != a)[:5]:
            found = sorted(x for x in scored if x[2] != own and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            want += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(found)]
    got = QUERIES["op11_hard_negatives"](spark, f"{folders}/odd")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 60 and len({w[0] for w in want}) >= 4
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    blocks = negatives.mine_negatives(frame(spark).withColumn("label", label), F.col("vec_id") % 100 == 0, anchors_per_block=2)
    assert sorted(map(tuple, blocks.collect())) == sorted(want)


def test_codes(spark, folders):
    kept = sorted(((i, np.array(ints(v)).reshape(16, -1), label) for i, v, label in ROWS if fine(v)), key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    books = np.array([r[1] for r in kept[:64]]).transpose(1, 0, 2)
    for last in (False, False, True):
        codes_of, errors = [], []
        for _, cut, _ in kept:
            far = ((cut[:, None, :] - books) ** 2).sum(axis=2)
            codes_of.append(far.argmin(axis=1))
            errors.append(int(far.min(axis=1).sum()))
        if not last:
            for j in range(16):
                for e in range(books.shape[1]):
                    mine = [cut[j] for (_, cut, _), c in zip(kept, codes_of, strict=True) if c[j] == e]
                    if mine:
                        books[j, e] = sum(mine) // len(mine)
    sums = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()
    want = [(i, "".join(f"{x:02x}" for x in c), e, sums[label], digest) for (i, _, label), c, e in zip(kept, codes_of, errors, strict=True)]
    got = QUERIES["op12_vector_codes"](spark, f"{folders}/odd")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) > 250


def test_few_and_odd_vectors(spark):
    few = codes.compress(frame(spark, MADE[:3])).collect()
    assert len(few) == 3 and all(r.error == r.label_error == 0 for r in few) and all(set(r.code[::2]) == {"0"} for r in few)
    assert codes.compress(frame(spark, [(1, [0.5] * 3, 1)])).count() == 0 and codes.compress(frame(spark, EDGE[:1])).count() == 0
    assert negatives.mine_negatives(frame(spark, MADE[1:50]), F.col("vec_id") % 100 == 0).count() == 0
    doubles = frame(spark, MADE).withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert sorted(codes.compress(doubles).collect()) == sorted(codes.compress(frame(spark, MADE)).collect())


TEXTS = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "a b "), (7, "a b "), (7, "A B "), (None, "a b"), (None, "lone"), (None, "x"), (None, "X"), (8, "y" * 50_000), (9, "Y" * 50_000)]
TEXTS += [(100 + k, "copy OF a copy") for k in range(400)] + [(600 + k, f"text {k % 40}") for k in range(90)]


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("weak", [False, True])
def test_copies(spark, largest, weak):
    """weak: a hash of four values, so that nearly every group is told apart by its bytes."""
    docs = spark.createDataFrame([(i, t, "mine", "mine") for i, t in TEXTS], "doc_id long, text string, hash string, body string").repartition(4)
    more = {"digest": lambda b: F.substring(F.unhex(F.hex(F.pmod(F.crc32(b), F.lit(4)))), 1, 1)} if weak else {}
    got = dedup.find_copies(docs, largest=largest, **more).collect()
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(lower(t), []).append(i)
    best = {t: (max if largest else min)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    want = [(i, best[lower(t)], len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in TEXTS]
    assert sorted(map(str, [(r.id, r.keep_id, r.group_size, r.text_sha256) for r in got])) == sorted(map(str, want))
    kept = [(r.keep_id, r.text_sha256) for r in got if r.kept]
    assert len(kept) == len(groups) == len(set(kept)) and all(r.id == r.keep_id for r in got if r.kept)


def test_copies_of_an_empty_table(spark):
    assert dedup.find_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_groups_large_and_small_join_alike(spark, monkeypatch):
    rows = spark.createDataFrame([(k, None if k % 3 else k % 20) for k in range(300)], "v long, g int")
    groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).where("g IS NULL OR g < 15")
    want = None
    for shares in (1, 10, 100_000):
        monkeypatch.setattr("gridrisk.llm.common.SHARES", shares)
        got = sorted(map(str, with_group(rows, groups, ["g"], "n", 300).collect()))
        want = want or got
        assert got == want and len(got) == 300
