"""Benchmark items that are mostly numbers, units and names are found when their values are the same."""

from verisift.llm import decontam


def test_items_of_placeholders(spark):
    long = "Add 1 2 3 4 5 6 7 8 9 10 and then 11"
    items = spark.createDataFrame([(1, "What is 12 + 34 * 56?"), (2, long), (3, "Sum 5 km 7 kg"), (4, "")], "item_id long, text string")
    texts = {
        1: "Solve this. What is 12 + 34 * 56? Show it.",
        2: "Solve this. What is 12 + 34 * 57? Show it.",
        3: f"So: {long}. Done.",
        4: "So: Add 2 1 3 4 5 6 7 8 9 11 and then 12.",
        5: "we sum 5km 7 kg now",
        6: "we sum 5 km 8 kg now",
        9: "Question: What is 12 + 34 * 56?",
        7: "1 2 3 4 5 6 7 8 9",
    }
    hits = decontam.find_hits(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), items)
    assert {(r["doc_id"], r["item_id"]) for r in hits.filter("contaminated").collect()} == {(1, 1), (3, 2), (5, 3), (7, 2), (9, 1)}
    kept = decontam.drop_contaminated(spark.createDataFrame([*texts.items(), (None, texts[1]), (8, None)], "doc_id long, text string"), items)
    assert {r["doc_id"] for r in kept.collect()} == {2, 4, 6, 8}
