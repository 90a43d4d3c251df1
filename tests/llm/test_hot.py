"""Shingles that many or all classes hold, small ranges, and ranges of ids, against plain Python."""

import numpy as np
import pytest

from gridrisk.llm import decontamination, fingerprints, jaccard


def corpus():
    rng, docs = np.random.default_rng(5), []
    lead, tail = [f"lead{k}" for k in range(7)], [f"tail{k}" for k in range(9)]
    for _ in range(40):
        own = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(30, 150)))]
        for copy in range(int(rng.integers(1, 5))):
            words = list(own)
            for _ in range(copy % 3):
                words[int(rng.integers(0, len(words)))] = f"x{int(rng.integers(0, 10**6))}"
            docs.append(" ".join(lead + words + (tail if rng.random() < 0.6 else [])))
    docs += [" ".join(lead), " ".join(lead + tail), docs[3], docs[3].upper(), docs[7], "a b", "A B", "", None]
    return docs


def brute(docs):
    sets = []
    for t in docs:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    label = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    least = {}
    for k, x in enumerate(label):
        least.setdefault(x, k)
    return [(k, len(sets[k]), least[label[k]]) for k in range(len(docs))]


@pytest.mark.parametrize(("hot", "per_range"), [(None, 1_000_000), (3, 300), (40, 300)])
def test_hot_shingles_change_no_result(spark, monkeypatch, hot, per_range):
    """Every text but a few holds the shingles of the lead; hot of 3 leaves hardly any shared shingle to the ranges."""
    monkeypatch.setattr(jaccard, "TOKENS_PER_RANGE", per_range)
    docs = corpus()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    got = sorted((r.id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, hot_classes=hot).collect())
    assert got == brute(docs) and len({c for _, _, c in got}) < len(docs) - 20


def test_no_range_gets_a_hot_shingle(spark):
    sets = [(k, 40, np.array([1, 2, 1000 + k], np.uint64).tobytes()) for k in range(200)] + [(k, 40, np.array([2**63 + k], np.uint64).tobytes()) for k in range(200, 260)]
    df = spark.createDataFrame(sets, "cls long, n int, tokens binary").repartition(4)
    hot = jaccard.hot_tokens(df, 1e3, 100)
    assert hot.tolist() == [1, 2]
    shared = spark.sparkContext.broadcast(hot)
    blocks = jaccard.dealt(df, 3, shared).collect()
    tokens = np.concatenate([np.frombuffer(b.block, np.uint64, offset=16 * b.classes) for b in blocks])
    assert len(tokens) == 260 and not {1, 2} & set(tokens.tolist())
    held = {r.cls: np.frombuffer(r.tokens, np.uint64).tolist() for r in jaccard.held_hot(df.unionByName(df.limit(50)), shared).collect()}
    assert held == {k: [1, 2] for k in range(200)}


@pytest.mark.parametrize("buckets", [1, 2, 7, 50])
def test_followers_in_any_number_of_ranges(spark, buckets):
    ids = [k * k % 997 for k in range(150)] + [5, 5, None]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(4)
    out = fingerprints.with_following(df, "doc_id", {"text": "next_text"}, rows_per_bucket=1, most_buckets=buckets).collect()
    order = sorted((i for i in ids if i is not None), reverse=True) + [None]
    want = sorted(map(str, [(i, f"t{order[(k + 1) % len(order)]}") for k, i in enumerate(order)]))
    assert sorted(map(str, [(r.doc_id, r.next_text) for r in out])) == want


@pytest.mark.parametrize("hits", [3, 50, 4096])
def test_windows_do_not_depend_on_how_hits_are_taken(spark, monkeypatch, hits):
    """Texts that hold items again and again, whole and in part; one of 10 MB."""
    rng = np.random.default_rng(1)
    items = [(k, " ".join(f"i{k}w{x}" for x in range(12 + 5 * k))) for k in range(5)]
    text = []
    for _ in range(30):
        words = items[int(rng.integers(0, 5))][1].split()
        text += words[int(rng.integers(0, 4)) :] + [f"z{int(rng.integers(0, 99))}" for _ in range(int(rng.integers(0, 6)))]
    long = "filler of a text " * 600_000 + items[3][1] + " end" * 100
    docs = [(1, " ".join(text)), (2, items[4][1]), (3, " ".join(items[4][1].split()[:20]))] + ([(4, long)] if hits > 50 else [])
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = [tuple(r) for r in decontamination.find_leaks(*frames).collect()]
    monkeypatch.setattr(decontamination, "HITS", hits)
    got = [tuple(r) for r in decontamination.find_leaks(*frames).collect()]
    assert sorted(got) == sorted(want) and {(1, k) for k in range(5)} | {(2, 4)} <= {r[:2] for r in got} and ((4, 3) in {r[:2] for r in got}) == (hits > 50)
