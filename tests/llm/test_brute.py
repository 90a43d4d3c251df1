"""Fingerprints, sampled segmentations, nearest examples and the whole pipeline against independent plain Python."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from gridrisk.llm import fingerprints, pieces, toxicity

WORDS = [f"w{k}" for k in range(400)]


def text(start, n):
    return " ".join(WORDS[(start + k * 7) % 400] for k in range(n))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(*values):
    """The engine's xxhash64: the hash of a value seeds the next one's; ints take four bytes."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(4, "little", signed=True), seed=seed)
    return signed(seed)


def words_of(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w]


def shingles_of(t):
    ws = words_of(t)
    return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} - {()}


def brute_print(t):
    least = {}
    for s in shingles_of(t):
        h = spark_hash(*s)
        b = (h >> 56) + 128
        least[b] = min(h, least.get(b, h))
    if not least:
        return "0" * 256
    digits = ""
    for i in range(256):
        probes = (spark_hash(i, k) & 255 for k in range(fingerprints.PROBES))
        bin_ = i if i in least else next((p for p in probes if p in least), None)
        if bin_ is None:
            bin_ = min(least, key=lambda b: (spark_hash(i, b), least[b]))
        digits += "0123456789abcdef"[least[bin_] & 15]
    return digits


def test_fingerprints_are_one_permutation_minhash(spark):
    texts = ["", " \n", "one", "a b c d e", "a b c d e f", text(0, 9), text(0, 30), text(0, 300), text(3, 1200), text(0, 30) + "\t" + text(0, 30).upper()]
    pairs = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame(pairs, "a string, b string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, F.col("a"), "fa"), F.col("b"), "fb")
    got = df.select("a", "b", fingerprints.hexed(F.col("fa")).alias("ha"), fingerprints.likeness(F.col("fa"), F.col("fb")).alias("near")).collect()
    prints = {t: brute_print(t) for t in texts}
    for r in got:
        x, y = prints[r.a], prints[r.b]
        empty = not shingles_of(r.a), not shingles_of(r.b)
        agree = sum(p == q for p, q in zip(x, y, strict=True)) / 256
        want = float(all(empty)) if any(empty) else max(0.0, (agree - 1 / 16) / (15 / 16))
        assert r.ha == x and abs(r.near - want) < 1e-12, (r.a[:30], r.b[:30])


def test_likeness_estimates_jaccard(spark):
    """Texts that share a falling part of their words, short ones too."""
    own = [" ".join(f"{p}{k}" for k in range(n)) for p, n in (("a", 40), ("b", 400))]
    changed = [" ".join(("x" if k % step == step // 2 else "") + w for k, w in enumerate(t.split())) for t in own for step in (6, 12, 25, 39)]
    rows = [(own[k // 4], t) for k, t in enumerate(changed)]
    df = spark.createDataFrame(rows, "a string, b string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, F.col("a"), "fa"), F.col("b"), "fb")
    errors = []
    for r in df.select("a", "b", fingerprints.likeness(F.col("fa"), F.col("fb")).alias("near")).collect():
        a, b = shingles_of(r.a), shingles_of(r.b)
        errors.append(r.near - len(a & b) / len(a | b))
    assert max(map(abs, errors)) < 0.15 and abs(np.mean(errors)) < 0.06, errors


def segmentations(units, weights):
    if not units:
        yield (), 1.0
    for end in range(1, len(units) + 1):
        if (w := weights.get(units[:end])) is not None:
            for rest, v in segmentations(units[end:], weights):
                yield (w[0], *rest), w[1] * v


def test_segmentations_are_drawn_by_their_weight(spark):
    """Every path of the lattice of a short text, listed, against the shares of 6,000 draws."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    weights = {}
    for i in range(own.vocab_size()):
        if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i)):
            score = own.get_score(i)
            weights[own.id_to_piece(i).replace("▁", " ")] = (i, 1 / ((-score if score > -1e8 else pieces.GIVEN_RANK) + 2))
    for t in ("lower", "a tab"):
        every = [(("",), 1.0)]
        for chunk in re.findall(r" *[^ ]+", " " + t):
            every = [((*a, *b), v * w) for a, v in every for b, w in segmentations(chunk, weights)]
        whole = sum(v for _, v in every)
        want = {a[1:]: v / whole for a, v in every}
        rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit(t).alias("text"))
        got = Counter(tuple(r.ids) for r in pieces.sample_pieces(rows).select("ids").collect())
        assert set(got) <= set(want) and len(want) > 10
        for path, share in want.items():
            assert abs(got[path] / 6000 - share) < 5 * math.sqrt(share * (1 - share) / 6000) + 1e-3, (t, path, share, got[path])


def test_nearest_examples_are_those_of_highest_cosine():
    """The search through blocks against the cosine of every example, vectors built from counts and weights alone."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"v{int(k)}" for k in rng.zipf(1.3, size=30) % 90) for _ in range(300)]
    y = np.array([k % 4 == 0 for k in range(300)])
    index = toxicity.build_index(list(range(300)), texts, y, k=7, block=16)

    def unit(t):
        v = {w: (1 + math.log(n)) * index.weights[index.terms[w]] for w, n in Counter(t.split()).items() if w in index.terms}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    units = [unit(t) for t in texts]
    for _ in range(60):
        q = " ".join(f"v{int(k)}" for k in rng.zipf(1.3, size=12) % 95)
        u = unit(q)
        cosines = np.array([sum(x * e.get(w, 0.0) for w, x in u.items()) for e in units])
        places, found = index.nearest(index.vector(toxicity.terms_of(q)))
        best = np.sort(cosines)[::-1][:7]
        assert np.allclose(found, best[best > 0]) and np.allclose(cosines[places], found)


def test_pipeline_run(spark, tmp_path):
    """A whole run: rejected, near, leaked and private texts take the way that each stage's rule says."""
    prose = lambda k, n=60: " ".join(f"The {w} of {v} is here." for w, v in zip(text(k, n).split(), text(k + 3, n).split(), strict=True))
    noise = lambda k: " ".join(f"###{w}$$$ %%" for w in text(k, 40).split())
    good = [(k, prose(11 * k % 397)) for k in range(0, 120, 2)]
    bad = [(k, noise(k)) for k in range(1, 120, 2)]
    item = " ".join(f"item{k}" for k in range(40))
    extra = [(200, prose(0)), (201, prose(0).replace("w350", "new")), (202, f"{prose(5)} {item} {prose(9)}"), (203, f"{prose(301)} Write to a.b@c.org at once."), (None, prose(333)), (204, prose(0) + " ")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, int(k % 2 == 0), 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, t, "en", "s", len(t)) for i, t in good + bad + extra]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")

    kept = sorted(good + extra, key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingles_of(t) for _, t in kept]
    label = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    want = [r for k, r in enumerate(kept) if label[k] == k and item not in r[1]]
    want = sorted((str(i), t.replace("a.b@c.org", "<EMAIL>")) for i, t in want)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == want and len(want) < len(kept) - 3
    assert all(r.lossless and r.n_chars == len(r.text) and r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in got)
