import zlib

from poolsieve.llm.langid import identify

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    extra = [(None, "the and of", None), (90001, None, "en"), (90002, "", "fr"), (90003, "123 ... 456", "de"), (90004, "the " * 100_000, None), (5, "le la les", "fr")]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).selectExpr("*", "1 AS score", "2 AS part").repartition(3)
    got = identify(docs).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (90001, 90002, 90003))
    assert by[90004].lang_pred == "en" and 0 <= by[90004].score <= 1
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out and r.lang_pred != "und" and truth[r.doc_id] is not None]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    mean = sum(r.score for r in held) / len(held)
    assert mean > 0.9


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    other = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 'xx' ELSE lang END AS lang")
    a, b = ({(r.doc_id, r.lang_pred, round(r.score, 9)) for r in identify(d).collect()} for d in (docs, other))
    assert a == b


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert identify(docs).collect() == []
    one = spark.createDataFrame([(1, "abc", None)], docs.schema)
    assert [tuple(r) for r in identify(one).collect()] == [(1, zlib.crc32(b"1") % 4 == 2, "und", 0.0)]


def test_splits_and_order_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(docs.where("doc_id % 7 = 0").selectExpr("doc_id + 1000000 AS doc_id", "text", "lang"))
    a, b = ({tuple(r) for r in identify(d, sample=300).collect()} for d in (docs.coalesce(1), docs.repartition(9, "text")))
    assert a == b
