import pytest
from pyspark.sql import functions as F

from quire.llm import language

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    return language.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    truth = pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]{2})/", 1).alias("truth"))
    rows = language.op4_language(spark, FOLDER)
    assert rows.count() == pages.count() == rows.select("page_id").distinct().count()
    known = rows.join(truth.where("truth <> ''"), "page_id")
    right, total = known.agg(F.count_if(F.col("language") == F.col("truth")), F.count("*")).first()
    assert total > 200 and right / total > 0.98


def test_held_out_text_alone(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    languages, model = language.fit(docs.where(~held))
    rows = docs.where(held).select(
        F.col("doc_id").alias("id"), language.letters(F.col("text")).alias("text"), "lang",
        F.lit(None).cast("string").alias("declared"), F.lit("").alias("suffix"), F.lit(None).cast("string").alias("host"))
    right, total = language.identify(rows, languages, model).agg(F.count_if(F.col("language") == F.col("lang")), F.count("*")).first()
    assert right / total > 0.97


def test_host_prior_decides_where_nothing_else_does(spark, fitted):
    french = "le la les des dans pour que qui une est sur elle"
    text = spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang = 'fr'").first().text
    rows = [(i, f"http://a.example.fr/{i}", f"<html lang=fr><p>{text}") for i in range(30)]
    rows += [(100, "http://a.example.fr/x", "<p>12345</p>"), (101, None, None), (102, "http://b.example.fr", ""), (100, "http://a.example.fr/x", "<p>12345</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = language.identify(language.page_rows(pages), *fitted).collect()
    found = {r.id: r for r in got}
    assert len(got) == 34 and french
    assert found[100].language == "fr" and found[100].probability > 0.7
    assert found[101].host is None and found[101].language is not None
    assert found[102].language == "fr"  # through its suffix


def test_stage_keeps_columns_and_rejects_contradictions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    german = docs.where("lang = 'de' and n_chars > 1500").limit(2).withColumn("lang", F.lit("es")).withColumn("doc_id", F.col("doc_id") + 10_000)
    odd = spark.createDataFrame([(20_000, None, None, None, 0), (20_001, "123 !", "en", "src0", 5), (20_002, "", "xx", "s", 0)], docs.schema)
    kept = language.keep_documents(docs.union(german).union(odd).withColumn("vote", F.lit(1)))
    assert kept.columns == [*docs.columns, "vote"]
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {r.doc_id for r in german.collect()}
    assert {20_000, 20_001, 20_002} <= ids
    assert docs.count() - len(ids & {r.doc_id for r in docs.collect()}) <= 1


def test_empty(spark, fitted):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert language.identify(language.page_rows(none), *fitted).count() == 0
    languages, model = language.fit(spark.createDataFrame([], "text string, lang string"))
    one = spark.createDataFrame([(1, "http://h", "<p>x")], "page_id long, url string, html string")
    assert [r.language for r in language.identify(language.page_rows(one), languages, model).collect()] == [None]
