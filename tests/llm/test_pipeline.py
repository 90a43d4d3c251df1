"""The pipeline's stages on a small table with null and repeated ids and a clashing column, against plain Python."""

import corpus_pipeline

WORDS = [f"w{k}" for k in range(300)]


def text(start, n):
    return " ".join(WORDS[(start + k * 7) % 300] for k in range(n))


ITEM = text(200, 40)
COPY = text(0, 60)
NEAR = COPY.replace("w210", "new")
ROWS = [
    (1, COPY), (2, NEAR), (None, COPY), (None, COPY), (3, text(100, 50)), (3, text(150, 50)), (3, text(150, 50)), (4, f"zz {ITEM} yy"), (None, f"{ITEM} end"),
    (5, None), (6, ""), (7, " \n"), (None, None), (8, "write to a.b@c.org or password=b7db7aa4a5fcc78305 now"),
]


def docs_of(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "en", f"src{k}", len(t or ""), "mine") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, pii string")


def test_stages_remove_rows_not_ids(spark, tmp_path):
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    docs = docs_of(spark)
    kept = by_name["n-gram Jaccard join"](spark, docs, str(tmp_path))
    # One of the four copies, both texts of id 3 once, one of the two with the item, and what has no words.
    want = [(1, COPY), (3, text(100, 50)), (3, text(150, 50)), *[r for r in ROWS if r[0] in (4, 5, 6, 7, 8)], (None, None)]
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(map(str, want)) and kept.columns == docs.columns
    kept = by_name["benchmark decontamination"](spark, docs, str(tmp_path))
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(map(str, [r for r in ROWS if ITEM not in (r[1] or "")])) and kept.columns == docs.columns
    kept = {r.source: r for r in by_name["PII"](spark, docs, str(tmp_path)).collect()}
    assert len(kept) == len(ROWS) and kept["src13"].text == "write to <EMAIL> or <SECRET> now" and kept["src13"].n_chars == 32 and kept["src13"].pii == "mine"
    assert all(kept[f"src{k}"].text == t for k, (_, t) in enumerate(ROWS[:13]))


def test_run_on_whole_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs_of(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and set(docs_of(spark).columns) < set(out.columns)
