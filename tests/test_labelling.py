"""Label files: a round trip is clean, every edit is found."""

from pyspark.sql import functions as F

from verifold.operators import claims, extraction, labelling

PAPER = "# T\n## Results\nThe accuracy was 0.87 and the recall 0.91.\nThe loss was 0.1.\n"


def test_round_trip_and_edits(spark):
    papers = spark.createDataFrame([(1, PAPER), (2, PAPER.replace("0.87", "0.88"))], "doc_id long, text string")
    found = extraction.candidates(papers)
    made = labelling.rows(found)
    assert made.count() == 6 and made.select("id").distinct().count() == 6
    row = made.first()
    assert row["context_before"] + row["text"] + row["context_after"] == "The accuracy was 0.87 and the recall 0.91."
    back = labelling.from_jsonl(labelling.to_jsonl(made.withColumn("label", F.lit("claim"))))
    assert labelling.errors(back, found).count() == 0
    edited = back.withColumn("text", F.when(F.col("text") == "0.1", "0.2").otherwise(F.col("text"))).where("text <> '0.88'").withColumn("label", F.when(F.col("text") == "0.87", "maybe").otherwise(F.col("label")))
    got = sorted(r["error"] for r in labelling.errors(edited, found).collect())
    assert got == ["bad_label", "edited", "edited", "missing"]
    labelled = back.withColumns({"t": F.col("label") == "claim", "p": F.col("text") != "0.1"})
    r = claims.score(labelled, "t", "p").first()
    assert (r["tp"], r["fn"], r["precision"]) == (4, 2, 1.0)
