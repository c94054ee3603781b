"""Model scores under a budget, packed over requests; rankers that may only permute."""

from pyspark.sql import functions as F

from verisift.operators import scoring


def slow(each=0.1):
    """A loader of a model that scores by length; every passage takes `each` seconds of its own clock, and `bad` passages
    break the pack. All within a function: workers can't import this file."""

    def load():
        class Model:
            now = 0.0

            def clock(self):
                return self.now

            def score(self, pairs):
                self.now += each * len(pairs)
                if any("bad" in p for _, p in pairs):
                    raise RuntimeError("model")
                return [float("nan") if p == "nan" else (len(p) % 10) / 10 for _, p in pairs]

        return Model()

    return load


def test_budget_is_given_back(spark):
    texts = [["aa", "b"], ["x"] * 4, None, ["one"], ["y", "zz", "nan"], ["w"] * 10, ["v", None]]
    rows = [(r, i, f"q{r}", t, "kept") for r in range(3) for i, t in enumerate(texts)]
    sources = spark.createDataFrame(rows, "req int, pos int, question string, passages array<string>, k0 string")
    got = {(r["req"], r["pos"]): r for r in scoring.score_sources(sources, slow(), 4000, "req").collect()}
    for req in range(3):
        rs = [got[req, i] for i in range(7)]
        assert [r["called"] for r in rs] == [True, True, False, False, True, False, True]
        assert [round(r["spent_ms"]) for r in rs] == [200, 400, 0, 0, 300, 0, 200] and round(rs[-1]["left_ms"]) == 2900
        assert rs[0]["scores"] == [0.2, 0.1] and rs[4]["scores"] is None and rs[6]["scores"] == [0.1, 0.0] and rs[5]["n_passages"] == 10
    tight = scoring.score_sources(sources.filter("req = 0"), slow(0.8), 4000, "req").orderBy("pos").collect()
    assert [r["called"] for r in tight] == [True, False, False, False, True, False, False]


def test_limits_and_failures(spark):
    rows = [(1, 0, "q", ["c" * 5000, "d"]), (2, 0, "q", ["bad", "x"]), (3, 0, "q", ["p"] * 40)]
    sources = spark.createDataFrame(rows, "req int, pos int, question string, passages array<string>").coalesce(1)
    got = {r["req"]: r for r in scoring.score_sources(sources.filter("req <> 2"), slow(), 100_000, "req").collect()}
    assert got[1]["scores"] == [0.0, 0.1] and got[3]["scores"] is None and round(got[3]["spent_ms"]) == 3200
    assert scoring.score_sources(sources.filter("req = 2"), slow(), 100_000, "req").first()["scores"] is None
    assert scoring.score_sources(sources.limit(0), slow(), 1, "req").collect() == []


def test_a_long_request_keeps_its_budget_over_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sources = spark.range(50).select(F.lit(1).alias("req"), F.col("id").alias("pos"), F.lit("q").alias("question"), F.array(F.lit("a"), F.lit("b")).alias("passages"))
        made = scoring.score_sources(sources, slow(0.125), 5000, "req").orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r["called"] for r in made] == [True] * 14 + [False] * 36 and made[13]["left_ms"] == 1500


def test_rankers_only_permute(spark):
    rows = [(1, ["a", "b", "c"], [2, 0, 1]), (2, ["a", "b"], [0, 0]), (3, ["a", "b"], [0]), (4, ["a", "b"], [1, 2]), (5, [], []), (6, ["a"], None), (7, ["a", "b"], [0, 1, None])]
    made = scoring.apply_order(spark.createDataFrame(rows, "i int, candidates array<string>, o array<int>"), "o").orderBy("i").collect()
    assert [(r["candidates"], r["reordered"]) for r in made] == [(["c", "a", "b"], True), (["a", "b"], False), (["a", "b"], False), (["a", "b"], False), ([], True), (["a"], False), (["a", "b"], False)]
    both = [(["a", "a", "b"], ["b", "a", "a"]), (["a", "a", "b"], ["b", "b", "a"]), (["a"], ["a", "b"]), (["a"], None)]
    kept = scoring.keep_if_permuted(spark.createDataFrame([(i, *x) for i, x in enumerate(both)], "i int, x array<string>, y array<string>"), "x", "y").orderBy("i").collect()
    assert [(r["candidates"], r["reordered"]) for r in kept] == [(["b", "a", "a"], True), (["a", "a", "b"], False), (["a"], False), (["a"], False)]
