"""Rules, refusals, enrichment, gates, draws, examples and reviews: what ends a job, and odd inputs."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import examples, records, reviews, strata


def _rows(spark):
    return spark.createDataFrame([(1, ["a", "b"], "a", [1, 2]), (2, ["a", "a"], "c", [2, 1]), (3, None, None, None)], "id int, options array<string>, answer string, evidence array<int>").withColumn("n_lines", F.lit(2))


def test_violations_and_refusals(spark):
    rules = records.record_rules("options", "answer", "evidence", "n_lines")
    got = {r.id: r.violations for r in records.violations(_rows(spark), rules).collect()}
    assert got == {1: [], 2: ["options differ", "answer is an option", "evidence ascends"], 3: list(rules)}
    assert records.refuse(_rows(spark).where("id = 1"), rules).count() == 1
    with pytest.raises(Exception, match="refused: options differ"):
        records.refuse(_rows(spark).where("id = 2"), rules).collect()
    assert records.violations(_rows(spark).where("false"), {}).count() == 0
    with pytest.raises(ValueError, match="column named"):
        records.violations(_rows(spark), rules, "answer")


def test_enrichment_stops_where_too_few_keys_are_known(spark):
    rows, more = spark.range(10), spark.range(5).selectExpr("id", "id * 2 AS x")
    with pytest.raises(ValueError, match="5 of 10"):
        records.enrich(rows, more, "id", {"x": 0})
    assert records.enrich(rows, more, "id", {"x": -1}, least=0.5).where("x = -1").count() == 5
    assert records.enrich(rows.where("false"), more, "id", {}).count() == 0


def test_a_missing_gate_ends_the_job(spark):
    rows = spark.createDataFrame([(1, "held", "yes"), (1, "gate", "none"), (2, "held", "yes")], "episode int, question string, answer string")
    args = ("episode", "question", "held", "gate", "answer", "none")
    assert [r.gated for r in records.gate(rows.where("episode = 1"), *args).orderBy("question").collect()] == [False, True]
    with pytest.raises(Exception, match="no gate on episode 2"):
        records.gate(rows, *args).collect()


def test_a_used_seed_is_refused(spark):
    rows = spark.range(20).selectExpr("id", "'s' AS stratum", "concat('p', id % 5) AS podcast", "1 AS seed")
    quotas = spark.createDataFrame([("s", 3)], "stratum string, quota int")
    with pytest.raises(ValueError, match="was used"):
        strata.top_up(rows.limit(5), rows, "id", "stratum", "podcast", "seed", quotas, 2, 1)
    new = strata.top_up(rows.where("id < 5"), rows, "id", "stratum", "podcast", "seed", quotas, 2, 2).collect()
    assert len(new) == 3 and all(r.id >= 5 and r.seed == 2 for r in new) and len({r.podcast for r in new}) == 3


def test_fills_come_from_the_nearest_cell_once(spark):
    cells = spark.createDataFrame([("s", 0, 0, 3, 0), ("s", 0, 1, 1, 2), ("s", 1, 0, 1, 9), ("s", 2, 2, 5, 1)], "stratum string, r long, c long, seats int, n int")
    got = {tuple(r)[1:] for r in strata.near_fills(cells, "stratum", "r", "c", "seats", "n").collect()}
    assert got == {(0, 1, 0, 0, 1, 1), (1, 0, 0, 0, 1, 2), (1, 0, 2, 2, 3, 4)}


def test_walks_end_at_the_last_needed_row(spark):
    rows = spark.range(3000).withColumn("key", F.lit("k"))
    got = strata.first_passing(rows, ["key"], "id", F.col("id") % 3 == 0, 50, 1).collect()
    assert sum(r.id % 3 == 0 for r in got) == 50 and len(got) < 300
    assert strata.first_passing(rows, ["key"], "id", F.col("id") < 4, 50, 1).count() == 3000


def test_python_counters_and_nulls(spark):
    count = examples.counter(lambda texts: [len(t) for t in texts])
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "id int, text string")
    assert [r.n for r in rows.select(count(F.col("text")).alias("n")).collect()] == [3, 0]
    lines = rows.select(examples.document_lines(F.lit(" One. Two?\n\nthree "), F.col("id") == 1).alias("l")).collect()
    assert [r.l for r in lines] == [["One. Two?", "three"], ["One.", "Two?", "three"]]


def test_markdown_tables(spark):
    rows = spark.createDataFrame([("b|c", None), ("a", 0.5)], "name string, x double")
    assert reviews.markdown(rows, ["name"]) == "| name | x |\n|---|---|\n| a | 0.500 |\n| b\\|c | - |\n"


def test_whole_groups_on_one_side(spark):
    grouped = spark.range(400).selectExpr("id AS doc", "id - id % 4 AS root")
    eligible = grouped.selectExpr("doc", "'s' AS stratum")
    got = strata.build_split(grouped, "doc", "root", eligible, "stratum", 6, 0.2, 1)
    assert got.groupBy("root").agg(F.count_distinct("side").alias("n")).where("n > 1").count() == 0
    sides = {r.side: r["count"] for r in got.groupBy("side").count().collect()}
    assert 20 <= sides["benchmark"] <= 24 and sides["val"] > 0 and sides["train"] > 200


def test_helper_columns_keep_a_table_s_own(spark):
    from millrace.operators import ranks

    cells = spark.createDataFrame([("g", 1, 3, "x"), ("g", 2, 1, "y")], "grp string, cell int, n int, _raw string").withColumn("_left", F.lit(7))
    got = {r.cell: (r.seats, r["_raw"], r["_left"]) for r in ranks.allocate(cells, 2, ["grp"], "cell", "n").collect()}
    assert got == {1: (2, "x", 7), 2: (0, "y", 7)}  # equal remainders: the first cell
    rows = spark.range(20).selectExpr("id", "id % 2 AS cell", "'p' AS podcast", "'o' AS own", "'u' AS used", "'w' AS want", "'s' AS place")
    seats = spark.createDataFrame([(0, 2), (1, 2)], "cell long, seats int")
    drawn = strata.gap_draw(rows, seats, rows.where("id < 2"), ["cell"], "id", "podcast", 9, 1, margin=0).collect()
    assert len(drawn) == 2 and all((r.own, r.used, r.want, r.place) == ("o", "u", "w", "s") and r.id >= 2 for r in drawn)
