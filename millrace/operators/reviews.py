"""Orders and reviews: first episodes, samples in turns, interleaving by workers, blind review sheets, Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.names import fresh
from millrace.operators.ranks import seeded_hash


def first_groups(rows: DataFrame, group: str, n: int) -> DataFrame:
    """All rows of the ``n`` least groups; null groups come first."""
    some = rows.select(group).distinct().orderBy(F.asc_nulls_first(group)).limit(n).withColumnRenamed(group, key := fresh("key", rows))
    return rows.join(F.broadcast(some) if n <= 10_000 else some, F.col(group).eqNullSafe(F.col(key)), "left_semi")


def turns_sample(rows: DataFrame, item: str, strata: list[str], interesting: Column, n: int, seed: int) -> DataFrame:
    """``n`` rows: up to half from interesting ones, then from all, taking turns over strata by seeded hash.

    Strata are those of the columns and whether rows are interesting, in their order; only ``n`` rows are ordered over all.
    """
    flag, turn, phase = (fresh(x, rows) for x in ("flag", "turn", "phase"))
    marked = rows.withColumn(flag, F.coalesce(interesting, F.lit(False)))
    marked = marked.withColumn(turn, F.row_number().over(Window.partitionBy(*strata, flag).orderBy(seeded_hash(seed, item), item))).where(F.col(turn) <= n)
    half = marked.where(flag).orderBy(turn, *strata).limit(n // 2)
    half = half.withColumn(phase, F.lit(1))
    rest = marked.join(half.select(item), item, "left_anti").withColumn(phase, F.lit(2))
    both = half.unionByName(rest.select(*half.columns))
    return both.orderBy(phase, turn, *strata, flag).limit(n).select(*rows.columns)


def one_of_each(rows: DataFrame, podcast: str, item: str, seed: int) -> DataFrame:
    """The row of each podcast with the least seeded hash, so that draws over categories have one of each."""
    place = fresh("place", rows)
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(podcast).orderBy(seeded_hash(seed, item), item))).where(F.col(place) == 1).drop(place)


def interleaved(jobs: DataFrame, call: str, order: str, number: str, workers: int) -> DataFrame:
    """Jobs with (chunk, step): ``workers`` calls are in flight at once, their jobs interleaved by (chunk, step, number).

    ``number`` is the call's place from zero; a call's jobs come in ``order``.
    """
    step = F.row_number().over(Window.partitionBy(call).orderBy(order)) - 1
    return jobs.withColumn("chunk", F.floor(F.col(number) / workers)).withColumn("step", step)


def review_sheet(pairs: DataFrame, item: str, labels: str, n: int, seed: int) -> DataFrame:
    """(item, sheet, key): a blind sheet for ``n`` sampled pairs, and which labeller each letter stands for.

    ``labels`` is a map of labeller to answer; letters go by a seeded hash of item and labeller. At most 26 labellers.
    """
    drawn = pairs.orderBy(seeded_hash(seed, item), item).limit(n)
    shuffled = F.array_sort(F.transform(F.map_entries(labels), lambda e: F.struct(F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(item).cast("string"), e["key"]).cast("binary")).alias("h"), e["key"].alias("who"), e["value"].alias("said"))))
    letter = lambda i: F.char(F.lit(65) + i)
    lines = F.transform("shuffled", lambda x, i: F.concat(letter(i), F.lit(": {answer: "), F.coalesce(x["said"], F.lit("")), F.lit(", correct: , evidence: , summary: }")))
    key = F.transform("shuffled", lambda x, i: F.concat(letter(i), F.lit("="), x["who"]))
    out = drawn.withColumn("shuffled", shuffled)
    return out.select(item, F.concat(F.lit("# pair "), F.col(item).cast("string"), F.lit("\n"), F.array_join(lines, "\n")).alias("sheet"), F.array_join(key, ",").alias("key"))


def read_review(sheets: DataFrame, item: str, sheet: str, key: str) -> DataFrame:
    """(item, labeller, correct, evidence, summary) of every graded line; lines without ``correct`` are not graded."""
    graded = F.regexp_extract_all(F.col(sheet), F.lit(r"(?m)^([A-Z]: \{.*\})$"), F.lit(1))
    rows = sheets.select(item, F.col(key).alias("who"), F.explode(graded).alias("line"))
    field = lambda name: F.nullif(F.trim(F.regexp_extract("line", rf"\b{name}:\s*([^,}}]*)", 1)), F.lit(""))
    named = F.str_to_map("who", F.lit(","), F.lit("="))
    out = rows.select(item, F.element_at(named, F.left("line", F.lit(1))).alias("labeller"), F.lower(field("correct")).isin("y", "yes", "true", "1").alias("correct"), field("evidence").cast("int").alias("evidence"), field("summary").cast("int").alias("summary"))
    return out.where("correct IS NOT NULL")


def markdown(rows: DataFrame, order: list[str]) -> str:
    """A small table as Markdown in the given order; only for report tables, whose rows are few. Null cells are "-"."""
    found = rows.orderBy(*order).limit(10_001).collect()
    if len(found) > 10_000:
        raise ValueError("a report has at most 10,000 rows")
    said = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(said, r)) + " |" for r in found]) + "\n"
