import os

import pytest
from fixtures import messy_documents, SCHEMAS
from pyspark.sql import functions as F

from freshet.llm import language

SF = "/root/testdata/sf0.01"
EN, DE = "the river and the hills are near the old mill with the birds ", "der Fluss und die Berge sind nahe bei der alten Mühle mit den Vögeln "


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_accuracy_on_rows_that_it_was_not_fitted_on(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 100")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2))
    model = language.fit(docs.where(part == 0))
    got = language.identify(language.document_evidence(docs.where(part == 1)), model).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id")
    right, n = got.select(F.avg((F.col("language") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 300 and right > 0.97


def rows(spark, *values):
    return spark.createDataFrame(values, "id long, host string, suffix string, declared string, text string")


def model(spark):
    return language.fit(spark.createDataFrame([(1, EN * 20, "en"), (2, DE * 20, "de")], "doc_id long, text string, lang string"))


def test_evidence_besides_the_text(spark):
    many = [(k, "h.de", "de", "de", DE) for k in range(40)] + [(100 + k, "h.com", "com", "en", EN) for k in range(40)]
    asked = [(200, "h.de", "de", "", "ok ok"), (201, "h.com", "com", "", "ok ok"), (202, "new.de", "de", "", "ok ok"), (203, "other.org", "org", "de", "ok ok"), (204, "other.org", "org", "en", "ok ok")]
    got = {r["id"]: r["language"] for r in language.identify(rows(spark, *many, *asked), model(spark), 0.0).collect()}
    assert [got[k] for k in range(200, 205)] == ["de", "en", "de", "de", "en"]
    assert got[0] == "de" and got[100] == "en"


def test_markup_and_address(spark):
    pages = spark.createDataFrame([(1, "https://Www.Example.DE:80/x", "<HTML lang=\"de-AT\"><script>var a</script><p>Guten&nbsp;Tag</p>"), (2, None, None)], "page_id long, url string, html string")
    got = {r["id"]: r for r in language.evidence(pages).collect()}
    assert (got[1]["host"], got[1]["suffix"], got[1]["declared"], got[1]["text"].split()) == ("www.example.de", "de", "de", ["Guten", "Tag"])
    assert (got[2]["host"], got[2]["suffix"], got[2]["declared"], got[2]["text"]) == ("", "", "", "")


def test_defined_cases(spark):
    got = {r["id"]: r for r in language.identify(rows(spark, (1, None, None, None, None), (2, "h", "", "xx", EN), (3, "h", "", None, "a")), model(spark)).collect()}
    assert (got[1]["language"], got[1]["kept"]) == ("und", False) and got[3]["kept"] is False
    assert (got[2]["language"], got[2]["kept"]) == ("en", True)
    unlabelled = language.fit(spark.createDataFrame([(1, EN, None)], "doc_id long, text string, lang string"))
    assert [tuple(r) for r in language.identify(rows(spark, (1, "h", "", "", EN)), unlabelled).collect()] == [(1, "und", 0.0, False)]


def test_stage_drops_only_undetermined_rows(spark):
    docs = spark.createDataFrame([*messy_documents(), *[(1000 + k, EN * 3, "en", "s0", 10, *"ccccccc") for k in range(20)]], SCHEMAS["documents"])
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(4) == 4 and not {0, 1} & set(ids) and set(range(1000, 1020)) <= set(ids)
