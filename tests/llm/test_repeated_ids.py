"""Different texts under one doc_id keep their own sets and links."""


def test_rows_that_share_an_id_are_linked_by_their_own_sets(spark):
    from glyphflow.llm.minhash_join import drop_near_duplicates, near_duplicates

    one, two, three = (" ".join(f"{x}{k}" for k in range(60)) for x in ("alpha", "beta", "gamma"))
    rows = [(1, one), (1, two), (2, one + " end"), (3, two + " end"), (3, three), (1, one), (0, three + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == sorted([(1, 56, 1, True), (1, 56, 1, True), (2, 57, 1, False), (3, 57, 1, False), (3, 56, 0, False), (1, 56, 1, True), (0, 57, 0, True)])
    assert sorted((r.doc_id, r.text) for r in drop_near_duplicates(docs).collect()) == sorted([(1, one), (1, one), (1, two), (0, three + " end")])


def test_a_row_stays_though_another_of_its_id_goes(spark):
    from glyphflow.llm.minhash_join import drop_near_duplicates

    one, two = (" ".join(f"{x}{k}" for k in range(60)) for x in ("alpha", "beta"))
    docs = spark.createDataFrame([(1, one), (2, one), (2, two)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in drop_near_duplicates(docs).collect()) == [(1, one), (2, two)]


ROWS = [(1, "a b"), (2, "a b"), (1, "only here"), (3, "c"), (3, "c"), (None, "c"), (None, "d"), (None, None), (5, None)]


def test_of_equal_texts_one_row_stays_and_no_other_text_goes(spark):
    from glyphflow.llm.exact_dedup import drop_copies

    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(ROWS)], "doc_id long, text string, text_sha256 int").repartition(3)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "d"), (1, "only here"), (2, "a b"), (3, "c"), (5, "")]


def test_quality_judges_each_text(spark):
    from glyphflow.llm.quality import filter_quality

    good = " ".join(f"word{k}" for k in range(30))
    docs = spark.createDataFrame([(1, good, 1), (1, "short", 2), (2, "short", 3), (None, good, 4), (None, None, 5)], "doc_id long, text string, kept long")
    assert filter_quality(docs).columns == docs.columns
    assert sorted(r.kept for r in filter_quality(docs).collect()) == [1, 4]


def test_mixing_keeps_columns_and_rates_each_text(spark):
    from glyphflow.llm.mixing import apply_mix

    rows = [(k, ("bad words here " if k % 2 else "fine and good text ") * 5 + str(k), 7) for k in range(40)]
    rows += [(0, "bad words here " * 9, 8), (None, "fine and good text", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mixed_copies int").withColumnRenamed("mixed_copies", "copies")
    labels = spark.createDataFrame([(k, "toxic" if k % 2 else "good") for k in range(1, 40)], "doc_id long, domain string")
    out = apply_mix(docs, labels)
    assert out.columns == docs.columns
    got = [r for r in out.collect()]
    assert sum(r.text.startswith("fine") for r in got) == 21 and sum(r.text.startswith("bad") for r in got) < 10


def test_the_whole_pipeline_with_repeated_ids_and_without_rows(spark):
    import corpus_pipeline as C

    from glyphflow.plans.staging import Workspace

    words = lambda seed, n: " ".join(f"w{seed}x{k}" for k in range(n))
    rows = [(1, words(1, 40)), (1, words(2, 40)), (2, words(1, 40)), (3, words(3, 60)), (4, words(3, 60) + " end"), (5, "too short"), (6, None), (7, words(7, 5000))]
    ws = Workspace(spark, "test")
    for n, root in ((len(rows), f"{ws.root}/some"), (0, f"{ws.root}/none")):
        spark.createDataFrame([(*r, "en", "s", 1) for r in rows[:n]], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
        out = C.run(spark, root).collect()
        assert {r.doc_id for r in out} == ({1, 2, 3, 7} if n else set())
    # each document's pieces cover it once
    for i in (1, 2, 3, 7):
        its = sorted((r.start, r.length, r.doc_tokens) for r in C.run(spark, f"{ws.root}/some").where(f"doc_id = {i}").collect())
        assert sum(n for _, n, _ in its) == its[0][2]
        break
