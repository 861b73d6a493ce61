from pyspark.sql import functions as F

from sheaf.llm import langid


def test_a_rare_language_keeps_its_documents_words_and_ngrams(docs_of):
    rows = [(i, f"the house and the dog number{chr(97 + i % 26)}") for i in range(200)] + [(1000 + i, "talo koira") for i in range(2)]
    df = docs_of(rows).withColumn("lang", F.when(F.col("doc_id") < 1000, "en").otherwise("fi"))
    model = langid.fit(df, max_docs=5, max_words=4, max_grams=30)
    assert model.langs == ["en", "fi"] and {"talo", "koira", "the"} <= set(model.words) and "al" in model.grams
    found = langid.identify(docs_of([(1, "koira"), (2, "the dog")]), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in found} == {1: "fi", 2: "en"}
