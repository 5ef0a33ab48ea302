"""Language ID learns from every training row, and every label."""

from pyspark.sql import functions as F

from agentmeter.llm import langid


def test_every_row_and_every_label_teach(spark):
    rows = [(i, chr(0x4E00 + i), "aa") for i in range(3000)] + [(5000 + i, "zz", f"l{i:03}") for i in range(300)] + [(9000, None, "aa"), (9001, "qq", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, ["▁z", "z"], F.lit(True), rounds=1, gauge=True)
    assert len(model.langs) == 301 and set(model.letters) == {langid.BEGIN, "z", *(chr(0x4E00 + i) for i in range(3000))}
    assert len(langid.fit(docs, ["▁z", "z"], F.col("doc_id") < 3000, rounds=1).langs) == 1
