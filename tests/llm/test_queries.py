"""Every registered query of the subpackage on odd, small and empty tables, against plain Python where the result is exact."""

import hashlib
import math
import re
import zlib

import pytest

from gridrisk.llm import decontamination
from gridrisk.llm.queries import QUERIES
from tests.llm.test_llm import brute_spans, text

CLASHING = {name: "mine" for name in ("ids", "pii", "evidence", "size", "slot", "shard", "law", "score", "stats", "fp", "next_text", "lang", "key", "n")}
ITEM = text(300, 40)
DOCS = [
    *[(k, text(13 * k % 400, 20 + 3 * k)) for k in range(60)], (60, ITEM), (61, f"{text(7, 30)} {ITEM.upper()} tail"), (62, None), (63, ""), (64, " \n\t"), (65, "x" * 40_000),
    (66, text(0, 20)), (67, text(0, 20)), (67, text(0, 20)), (None, "no id a.b@c.org 4111 1111 1111 1111"), (None, None), (68, "é▁𝄞 <|im_end|> token=b7db7aa4a5fcc78305 +1 (017) 555-7713"),
]
LABELS = [(k, int(k % 3 > 0), int(k % 7 == 0)) for k in range(60)] + [(None, 1, 1), (62, 0, None), (5, 1, 0)]
VECTORS = [(k, [((k * 7 + j * 3) % 11 - 5) / 16 for j in range(16)], k % 3) for k in range(0, 300, 2)] + [(None, None, None), (301, [0.5], 1), (302, None, 1)]
CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|im_end|>"), (2, None, None, None), (3, 0, "assistant", "a"), (3, 0, "assistant", "a")]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """A folder with odd rows and clashing columns, and one whose tables are empty."""
    base = tmp_path_factory.mktemp("queries")
    docs = spark.createDataFrame([(*r, *CLASHING.values()) for r in DOCS], f"doc_id long, text string, {', '.join(f'{c} string' for c in CLASHING)}").repartition(3)
    tables = {
        "documents": docs,
        "labels": spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string"),
        "embeddings": spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int"),
        "conversations": spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{base}/odd/{name}.parquet")
        df.limit(0).write.parquet(f"{base}/empty/{name}.parquet")
    return str(base)


@pytest.fixture(scope="module")
def odd(spark, folders):
    return {name: query(spark, f"{folders}/odd").toPandas() for name, query in QUERIES.items()}


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables_give_no_rows(spark, folders, name):
    assert QUERIES[name](spark, f"{folders}/empty").count() == (1 if name == "op7_chat_formatting" else 0)  # conversation -1


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op7_chat_formatting", "op8_decontamination", "op11_hard_negatives", "op12_vector_codes")])
def test_each_row_has_a_result(odd, name):
    assert sorted(map(str, odd[name]["doc_id"].astype("Int64"))) == sorted("<NA>" if i is None else str(i) for i, _ in DOCS)


def fold(i, modulus):
    return None if i is None else zlib.crc32(str(i).encode()) % modulus


def by_id(df):
    return {int(r.doc_id): r for r in df.itertuples() if r.doc_id == r.doc_id}


def test_scores_and_folds(odd):
    for name, cut in (("op1_quality", 0.5), ("op6_toxicity", 0.7)):
        df = odd[name]
        assert df["score"].between(0, 1).all() and ((df["score"] >= cut).astype(int) == df["predicted"]).all()
        assert all(r.held_out == (fold(i, 3) == 1) for i, r in by_id(df).items()) and not df[df["doc_id"].isna()]["held_out"].any()


def test_shards(odd):
    df = odd["op2_sharding"]
    assert df["shard"].between(0, 23).all() and all(sorted(g["slot"]) == list(range(len(g))) for _, g in df.groupby("shard"))
    want = {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in DOCS}
    assert all((r.size, r.text_crc32) == want[i] for i, r in by_id(df).items()) and set(df["law"]) == {"bytes"}


def test_pieces_are_lossless(odd):
    texts = dict(DOCS)
    assert odd["op3_sentencepiece"]["lossless"].all()
    assert all(r.decoded_sha256 == hashlib.sha256((texts[i] or "").encode()).hexdigest() for i, r in by_id(odd["op3_sentencepiece"]).items())


def test_base_scores(odd):
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b""]
    counts = {}
    for i, t in DOCS:
        if fold(i, 7) != 2:
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, r in by_id(odd["op4_lm_scoring"]).items():
        words = tokens(dict(DOCS)[i])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words), sum(w in counts for w in words), n, fold(i, 7) == 2)
        assert abs(r.base_score - sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words)) < 1e-6 and r.score < 0


def test_spans(odd):
    for i, r in by_id(odd["op5_pii"]).items():
        base = brute_spans(dict(DOCS)[i] or "")
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
        assert len(r.scores.split(",")) == len(r.spans.split(","))


def test_chats(odd):
    got = {r.conv_id: r for r in odd["op7_chat_formatting"].itertuples() if r.conv_id == r.conv_id}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\nhi\nassistant\nyo <|im_end|>\n") and got[1].loss_sha256 == sha("yo <|im_end|>") and got[3].n_turns == 2
    assert got[-1].loss_sha256 == sha("<|im_end|><|im_start|>assistant ok")


def test_fingerprints(odd):
    df = odd["op9_fingerprints"]
    order = sorted([(i, t or "") for i, t in DOCS if i is not None], key=lambda x: -x[0])
    unique = [k for k, (i, _) in enumerate(order) if [j for j, _ in order].count(i) == 1 and k + 1 < len(order) and [j for j, _ in order].count(order[k + 1][0]) == 1]
    got = by_id(df)
    for k in unique:
        (i, t), after = order[k], order[k + 1][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    assert got[66].fingerprint == got[67].fingerprint == got[0].fingerprint and df["near_edited"].between(0, 1).all()


def test_components(odd):
    sets = []
    for _, t in DOCS:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    label = list(range(len(DOCS)))
    for a in range(len(DOCS)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    least = {k: min((DOCS[j][0] for j in range(len(DOCS)) if label[j] == k and DOCS[j][0] is not None), default=None) for k in set(label)}
    want = sorted((i, len(sets[k]), least[label[k]]) for k, (i, _) in enumerate(DOCS) if i is not None)
    assert sorted((int(r.doc_id), r.n_shingles, int(r.component_id)) for r in odd["op10_jaccard_join"].itertuples() if r.doc_id == r.doc_id) == want


def windows_of(t, size):
    words = [w.strip(decontamination.MARKS.decode()) or w for w in (t or "").lower().split()]
    for start in range(max(1, len(words) - size + 1)):
        part = words[start : start + size]
        yield {tuple(part[k : k + 5]) for k in range(len(part) - 4)}


def test_leaks_against_every_window(spark):
    """Items that share a preamble, in documents that hold all, most or little of them; whatever reaches the similarity in
    some window is found."""
    preamble = text(0, 15)
    items = [(k, f"{preamble} " + " ".join(f"i{k}w{j}" for j in range(25 + k))) for k in range(6)]
    docs = []
    for k, t in items:
        words = t.split()
        for cut in (0, 2, 4, 6, 9):
            for changed in ((), (20,), (20, 30)):
                held = [("zz" if j in changed else w) for j, w in enumerate(words) if j >= cut]
                docs.append((len(docs), " ".join([f"a{k}b{j}" for j in range(30)] + held + [f"c{k}d{j}" for j in range(30)])))
    shingles = {i: next(windows_of(t, 10**6)) for i, t in items}
    df = {}
    for s in shingles.values():
        for x in s:
            df[x] = df.get(x, 0) + 1
    want = set()
    for d, t in docs:
        for i, item in items:
            whole = sum(1 / df[x] for x in shingles[i])
            best = max(sum(1 / df[x] for x in shingles[i] & w) for w in windows_of(t, len(item.split())))
            if best / whole >= 0.8:
                want.add((d, i))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(*frames).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 20, (len(got), len(want))
