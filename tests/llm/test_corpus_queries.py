"""op11 to op13 against their SQL, on the smallest tables and on rows with every odd case."""

import duckdb
import pytest

from poolsieve.llm.corpus_queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def norm(v):
    return round(v, 9) if isinstance(v, float) else v


def compare(spark, folder, name):
    df = queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(str([norm(r[c]) for c in columns]) for r in df.collect())
    with duckdb.connect() as db:
        for t in ("documents", "labels"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'' if folder == SF else '/*.parquet'}'")
        found = db.execute(oracle_sql()[name])
        names = [x[0] for x in found.description]
        want = sorted(str([norm(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert sorted(names) == columns
    assert got == want
    return got


@pytest.mark.parametrize("name", sorted(queries()))
def test_against_sql(spark, name):
    assert compare(spark, SF, name)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    long = "\n".join(f"Line {k} has WORDS, and more words. Again! {k % 7}" for k in range(3000))
    texts = ["", None, "\n", "\n\n", " ", "one line only", "a. b. c.", "A\nB\nA\nB", "B\nA\nB\nA", long, long[::-1], "x" * 300 + " #", "Ünïcödé — 漢字. 😀😀\n😀", "same text", "same text", "a b " * 150]
    langs = ["en", None, "", "fr"]
    rows = [(3 * k, t, langs[k % 4], "s", None) for k, t in enumerate(texts)]
    labels = [(3 * k, k % 2, k % 3 % 2) for k in range(12)] + [(3, None, 1), (None, 1, 1), (999, 1, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, h string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries()))
def test_odd_rows(spark, odd, name):
    compare(spark, odd, name)
