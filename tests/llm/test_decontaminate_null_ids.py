from presswork.llm import decontaminate as dc

from .cases import frame


def test_leaks_without_an_id_go_too(spark):
    item = "one two three four five six seven eight nine"
    texts = [item, "clean text", f"so {item} then", item, None, "clean too"]
    docs = frame(spark, texts, ids=[None, None, None, 4, None, 6])
    kept = dc.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(None, "clean text"), (None, None), (6, "clean too")}
