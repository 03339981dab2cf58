import binascii

from samples import SF01
from pyspark.sql import functions as F

from almacen.llm import language, queries
from almacen.llm.common import table


def test_held_out_accuracy_and_calibration(spark):
    out = queries.op10_language_id(spark, SF01).join(table(spark, SF01, "documents").select("doc_id", "lang"), "doc_id")
    held = out.filter("held_out").withColumn("ok", (F.col("lang") == F.col("lang_pred")).cast("double"))
    r = held.agg(F.avg("ok").alias("ok"), F.avg("score").alias("score"), F.count("*").alias("n")).first()
    assert r["n"] > 250 and r["ok"] > 0.97 and abs(r["ok"] - r["score"]) < 0.03
    assert out.filter("score < 0 or score > 1").count() == 0
    for x in out.select("doc_id", "held_out").collect():
        assert x["held_out"] == (binascii.crc32(str(x["doc_id"]).encode()) % 3 == 1)


def test_held_out_labels_teach_nothing(spark):
    docs = table(spark, SF01, "documents")
    spoilt = docs.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a = sorted(tuple(r) for r in language.identify(docs).collect())
    assert a == sorted(tuple(r) for r in language.identify(spoilt).collect())


def test_odd_rows(spark, odd, empty):
    rows = {r["doc_id"]: r for r in language.identify(odd).collect()}
    assert len(language.identify(odd).collect()) == odd.count()
    for i in (3, 4, 5):
        assert (rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0)
    assert rows[1]["lang_pred"] == "en"
    assert language.identify(empty).count() == 0
    unlabelled = language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_rejecting_keeps_rows_as_they_are(spark, odd):
    docs = table(spark, SF01, "documents")
    kept = language.reject_unknown(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()
    assert {r["doc_id"] for r in language.reject_unknown(odd).collect()} >= {1, 2, 8}
    assert not {3, 4, 5} & {r["doc_id"] for r in language.reject_unknown(odd).collect()}


def test_l1_leaves_most_weights_at_zero():
    texts = ["the cat and the dog " * 3, "le chat et le chien " * 3] * 20
    model = language.fit(["en", "fr"] * 20, [language.grams(t) for t in texts])
    assert (model["w"] != 0).mean() < 0.05 and language.predict(model, "the dog")[0] == "en"


def test_rejecting_without_labels_keeps_every_text_with_a_letter(odd):
    unlabelled = odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    kept = [tuple(r) for r in language.reject_unknown(unlabelled).select("doc_id", "text").collect()]
    want = [tuple(r) for r in odd.select("doc_id", "text").collect() if any(c.isalpha() for c in r["text"] or "")]
    assert sorted(kept, key=repr) == sorted(want, key=repr) and len(want) > 10


def test_letterless_signs_are_no_language():
    model = {"names": ["xx"], "idf": None, "w": None, "b": None, "t": 1.0}
    for text in ("½ ²", "① Ⅷ", "12 + 3", "", None, "_ - ."):
        assert language.predict(model, text) == ("und", 0.0)
