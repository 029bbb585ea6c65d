"""The pipeline's stages against brute force."""
import brute

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    before = {r.doc_id: r for r in docs.collect()}
    known = P.known_language(spark, docs, SF).cache()
    assert known.columns == docs.columns and known.count() >= 0.97 * len(before)
    single = P.one_of_each_group(spark, known, SF).cache()
    groups = brute.jaccard_components([(r.doc_id, r.text) for r in known.collect()], 5, 80)
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
    clean = P.without_personal_data(spark, single, SF).cache()
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert r.n_chars == len(r.text) and (r.text == before[r.doc_id].text) == (not brute.pii_base(before[r.doc_id].text))
    pieces = P.packed(spark, clean, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in clean.collect()}


def test_texts_that_share_an_id(spark):
    """Each text is judged by itself: a copy goes, the clean text with the same id stays."""
    copy, clean = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    for parts in (1, 5):
        docs = spark.createDataFrame([(3, copy), (5, copy), (5, clean), (5, clean), (9, clean)], "doc_id long, text string").repartition(parts)
        assert sorted(P.one_of_each_group(spark, docs, SF).collect()) == [(3, copy), (5, clean)]


def test_awkward_rows(spark):
    rows = [(None, "no id", "en"), (None, "no id", "en"), (None, "no id at all", None), (1, None, "en"), (2, "", "en"), (3, "a b c d e f g", "en"),
            (3, "a b c d e f g", "en"), (4, "a b c d e f g", "en"), (5, "123 456", "en")]
    docs = spark.createDataFrame([(i, t, l, "s", 1, "x") for i, t, l in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, sid string")
    known = P.known_language(spark, docs, SF)
    assert sorted((r.doc_id or 0) for r in known.collect()) == [0, 0, 0, 3, 3, 4]
    single = P.one_of_each_group(spark, docs, SF)
    assert sorted((r.doc_id or 0, r.text or "") for r in single.collect()) == [
        (0, "no id"), (0, "no id at all"), (1, ""), (2, ""), (3, "a b c d e f g"), (5, "123 456")]
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).collect() == []
    assert P.packed(spark, P.without_personal_data(spark, docs, SF), SF).count() == len(rows)
