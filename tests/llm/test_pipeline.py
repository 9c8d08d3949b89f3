import corpus_pipeline
from offerlake.llm import op7_pieces, op8_minhash, op10_rules
from tests.llm import plain
from tests.llm.test_ops import ITEMS, prose

STOPS = "the of and to in that it was for".split()


def article(seed, n=80):
    return " ".join(f"{w} {STOPS[k % 9]}" if k % 3 == 0 else w for k, w in enumerate(prose(seed, n).split()))


def test_pipeline(spark, tmp_path):
    shared = article(50, 90)
    rows = [(1, article(1)), (2, article(1)), (3, article(1).replace("b", "B", 1)), (4, "too short"), (5, None), (6, "# * " * 60),
            (7, f"{article(7, 200)} {shared}"), (8, f"{article(8, 300)} {shared}"), (9, f"{article(9)} {ITEMS[0][1]}"), (None, article(10)), (11, article(11)), (11, article(11))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage-{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage-{k}")
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        kept.append({r.doc_id: r for r in docs.collect()})
        assert docs.count() == (len(kept[-1]) if k else len(kept[-1]) + 1)
    assert set(kept[0]) == {1, 2, 3, 7, 8, 9, None, 11}
    assert set(kept[1]) == {1, 7, 8, 9, None, 11}
    order = sorted(kept[1], key=str)
    want = plain.suffix([kept[1][i].text for i in order], 400)
    for i, (_, n_removed, _, left) in zip(order, want):
        assert kept[2][i].text == left.decode(errors="ignore") and kept[2][i].n_chars == len(kept[2][i].text)
        assert (n_removed > 0) == (i in (7, 8))
    assert set(kept[3]) == {1, 7, 8, None, 11}
    decoded = {r.doc_id: r.text for r in op7_pieces.decode(docs).collect()}
    assert decoded == {i: r.text for i, r in kept[3].items()}
    whole = {r.doc_id: tuple(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {i: tuple(r.ids) for i, r in kept[4].items()}


def test_rows_without_an_id_and_of_one_id_are_judged_by_text(spark, tmp_path):
    texts = [(1, article(1)), (None, article(1)), (None, article(2)), (None, article(2)), (3, article(3)), (3, article(4)), (None, f"{article(5)} {ITEMS[0][1]}"), (6, article(6, 4000))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, row int")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.minhash_near_dedup(spark, docs, str(tmp_path))
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", texts[0][1]), ("None", texts[2][1]), *[(str(i), t) for i, t in texts[4:]]])
    clean = corpus_pipeline.decontamination(spark, kept, str(tmp_path))
    assert clean.columns == corpus_pipeline.COLUMNS and clean.count() == 5
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name


def test_clean_labelled_documents_pass_the_rules(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(r, labels[r.doc_id]) for r in op10_rules.query(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.doc_id in labels]
    assert not [r for r, x in judged if x.quality == 1 and x.toxic == 0 and not r.base_failed and not r.kept]
    assert sum(x.quality == 0 and not r.base_failed and r.kept for r, x in judged) <= 3


def test_near_duplicates_of_the_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op8_minhash.query(docs).collect()}
    assert got == plain.near([(r.doc_id, r.text) for r in docs.collect()])
