"""Strata and cells: population samples, draws that fill gaps, selection with fills from near cells, held-out lineages.

Sequential walks of a seeded shuffle become running counts in the order of a seeded hash; what is counted in order
is first cut into even ranges of the hash, so that no stratum passes one task. Plans over cells are folds over
the cells of a stratum, whose number the design fixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.names import fresh
from millrace.operators.ranks import seeded_hash


def first_passing(rows: DataFrame, keys: list[str], item: str, passes: Column, n: int, seed: int) -> DataFrame:
    """The rows of each key, in the order of a seeded hash, up to the one that is the ``n``-th to pass.

    All rows of a key that has fewer. A null ``passes`` is no pass. Equal items stand next to each other.
    """
    mark, part, ok, before, own = (fresh(x, rows) for x in ("mark", "part", "ok", "before", "own"))
    marked = rows.withColumn(mark, seeded_hash(seed, item)).withColumn(part, F.substring(mark, 1, 3)).withColumn(ok, F.coalesce(passes, F.lit(False)).cast("long"))
    sums = marked.groupBy(*keys, part).agg(F.sum(ok).alias(own))
    w = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    reached = sums.withColumn(before, F.coalesce(F.sum(own).over(w), F.lit(0))).where(F.col(before) < n).drop(own)
    inside = Window.partitionBy(*keys, part).orderBy(mark, item).rowsBetween(Window.unboundedPreceding, -1)
    joined = marked.join(reached, [*keys, part]).withColumn(own, F.coalesce(F.sum(ok).over(inside), F.lit(0)))
    return joined.where(F.col(before) + F.col(own) < n).select(*rows.columns)


def population_sample(rows: DataFrame, item: str, strata: list[tuple[str, int, int]], estimate: str, tokens: str, reject: str, per_stratum: int, seed: int, window: tuple[float, float] = (0.8, 1.25)) -> DataFrame:
    """Rows with ``windows``: the strata whose walk reached them; a walk ends with ``per_stratum`` good rows in the band.

    A stratum's walk is over rows whose estimate is within its window of the band, in the order of a seeded hash.
    """
    spans = [F.when((F.col(estimate) >= window[0] * a) & (F.col(estimate) < window[1] * b), F.struct(F.lit(s).alias("s"), F.lit(a).alias("a"), F.lit(b).alias("b"))) for s, a, b in strata]
    walked = rows.withColumn("walk", F.explode(F.array_compact(F.array(*spans)))).withColumn("stratum_walk", F.col("walk.s"))
    good = F.col(reject).isNull() & (F.col(tokens) >= F.col("walk.a")) & (F.col(tokens) < F.col("walk.b"))
    reached = first_passing(walked, ["stratum_walk"], item, good, per_stratum, seed)
    names = reached.groupBy(item).agg(F.array_sort(F.collect_set("stratum_walk")).alias("windows"))
    return rows.join(names, item)


def gap_draw(candidates: DataFrame, targets: DataFrame, have: DataFrame, cell: list[str], item: str, podcast: str, cap: int, seed: int, margin: float = 0.06) -> DataFrame:
    """Candidates drawn for every cell that ``have`` leaves short of its target, with a margin for later rejections.

    ``targets`` has (cell, seats); ``have`` has the rows in hand, whose podcasts count for the cap. A podcast's rows
    beyond the cap are passed over before cells draw, by the same seeded hash.
    """
    used, own, got, want, place = (fresh(x, candidates, targets, have) for x in ("used", "own", "got", "want", "place"))
    taken = have.groupBy(podcast).agg(F.count("*").alias(used))
    nth = F.row_number().over(Window.partitionBy(podcast).orderBy(seeded_hash(seed, item), item))
    rest = candidates.join(have.select(item), item, "left_anti").join(taken, podcast, "left").withColumn(own, nth)
    free = rest.where(F.col(own) + F.coalesce(used, F.lit(0)) <= cap).drop(own, used)
    held = have.groupBy(*cell).agg(F.count("*").alias(got))
    short = F.greatest(F.lit(0), F.col("seats") - F.coalesce(got, F.lit(0)))
    seats = targets.join(held, cell, "left").select(*cell, F.ceil(short * (1 + margin)).alias(want)).where(F.col(want) > 0)
    in_cell = F.row_number().over(Window.partitionBy(*cell).orderBy(seeded_hash(seed, item), item))
    return free.join(seats, cell).withColumn(place, in_cell).where(F.col(place) <= F.col(want)).select(*candidates.columns)


def near_fills(cells: DataFrame, stratum: str, row: str, column: str, seats: str, n: str) -> DataFrame:
    """(stratum, row, column, to_row, to_column, after, n): what cells with spare rows give to those short of seats.

    Cells take in their order, each from the nearest first: a step in ``row`` counts double, ties go to the lower
    cell. ``after`` is how many of the giving cell's rows are taken already. One fold over a stratum's few cells.
    """
    c = F.struct(F.col(row).alias("r"), F.col(column).alias("c"), F.least(F.col(seats), F.col(n)).cast("long").alias("own"), (F.col(seats) - F.col(n)).cast("long").alias("short"))
    grouped = cells.groupBy(stratum).agg(F.array_sort(F.collect_list(c)).alias("cells"))
    pairs = F.flatten(F.transform("cells", lambda t, i: F.transform("cells", lambda s, j: F.struct(i.alias("to"), (2 * F.abs(s["r"] - t["r"]) + F.abs(s["c"] - t["c"])).alias("far"), j.alias("of")))))
    wanted = F.array_sort(F.filter(pairs, lambda p: (F.get("cells", p["to"])["short"] > 0) & (F.get("cells", p["of"])["short"] < 0)))
    left = F.transform("cells", lambda x: x["short"])
    start = F.struct(left.alias("left"), F.array().cast("array<struct<of:int,to:int,after:bigint,n:bigint>>").alias("out"))

    def give(s: Column, p: Column) -> Column:
        spare, short = -F.get(s["left"], p["of"]), F.get(s["left"], p["to"])
        take = F.greatest(F.lit(0).cast("long"), F.least(spare, short))
        whole = F.get("cells", p["of"])
        after = whole["own"] - whole["short"] - spare
        moved = F.transform(s["left"], lambda x, i: F.when(i == p["of"], x + take).when(i == p["to"], x - take).otherwise(x))
        row_ = F.array(F.struct(p["of"].alias("of"), p["to"].alias("to"), after.alias("after"), take.alias("n")))
        return F.struct(moved.alias("left"), F.when(take > 0, F.concat(s["out"], row_)).otherwise(s["out"]).alias("out"))

    out = grouped.withColumn("x", F.explode(F.aggregate(wanted, start, give, lambda s: s["out"])))
    of, to = F.get("cells", F.col("x.of")), F.get("cells", F.col("x.to"))
    return out.select(stratum, of["r"].alias(row), of["c"].alias(column), to["r"].alias("to_row"), to["c"].alias("to_column"), "x.after", "x.n")


def select_cells(pool: DataFrame, seats: DataFrame, stratum: str, row: str, column: str, item: str, reused: str, podcast: str, cap: int, seed: int) -> DataFrame:
    """Chosen rows with ``fills``: each cell's seats go to reused rows first, then by seeded hash; short cells take from near ones.

    ``fills`` is the short cell ("row,column") that a row stands in for, else null. The podcast cap is applied first,
    reused rows before others, so that the result depends on no order of cells.
    """
    cell = [stratum, row, column]
    order = [F.desc(F.col(reused).cast("int")), seeded_hash(seed, item), F.col(item)]
    own, place = (fresh(x, pool, seats) for x in ("own", "place"))
    nth = F.row_number().over(Window.partitionBy(podcast).orderBy(*order))
    placed = pool.withColumn(own, nth).where(F.col(own) <= cap).drop(own).withColumn(place, F.row_number().over(Window.partitionBy(*cell).orderBy(*order)))
    n = placed.groupBy(*cell).agg(F.count("*").alias("n"))
    known = seats.join(n, cell, "full").select(*cell, F.coalesce("seats", F.lit(0)).alias("seats"), F.coalesce("n", F.lit(0)).alias("n"))
    moves = near_fills(known, stratum, row, column, "seats", "n")
    mine = placed.join(seats, cell).where(F.col(place) <= F.col("seats")).withColumn("fills", F.lit(None).cast("string")).select(*pool.columns, "fills")
    given = placed.join(moves, cell).where((F.col(place) > F.col("after")) & (F.col(place) <= F.col("after") + F.col("n")))
    return mine.unionByName(given.withColumn("fills", F.concat_ws(",", F.col("to_row").cast("string"), F.col("to_column").cast("string"))).select(*pool.columns, "fills"))


def prompt_ceiling(questions: DataFrame, keys: list[str], name: str, frame_tokens: Column, max_len: int, allowance: int) -> DataFrame:
    """(keys, frame_tokens, frame_question, ceiling): tokens left for a document under the longest frame; ties to the first name."""
    best = F.min(F.struct((-frame_tokens).alias("n"), F.col(name).alias("q")))
    out = questions.groupBy(*keys).agg(best.alias("b"))
    return out.select(*keys, (-F.col("b.n")).alias("frame_tokens"), F.col("b.q").alias("frame_question"), (F.lit(max_len - 2 - allowance) + F.col("b.n")).alias("ceiling"))


def held_out_lineages(questions: DataFrame, lineage: str, dataset: str, order: list[str], fraction: float, seed: int) -> DataFrame:
    """(lineage): about a fraction of each dataset's lineages, one held-out set for all datasets.

    Datasets take turns in ``order``, each from its lineages by seeded hash until its share is held, counting what
    earlier ones took. ``questions`` has (lineage, dataset); a loop over the few datasets, none over rows.
    """
    pairs = questions.select(lineage, dataset).distinct()
    held = pairs.where("false").select(lineage)
    for name in order:
        own = pairs.where(F.col(dataset) == name).select(lineage)
        quota = int(fraction * own.count() + 0.5)
        rest = quota - own.join(held, lineage, "left_semi").count()
        if rest > 0:
            more = own.join(held, lineage, "left_anti").orderBy(seeded_hash(seed, lineage), lineage).limit(rest)
            held = questions.sparkSession.createDataFrame(held.unionByName(more).toArrow())  # a bank's lineages: a dimension table
    return held


def top_up(pool: DataFrame, rows: DataFrame, item: str, stratum: str, podcast: str, seed_col: str, quotas: DataFrame, cap: int, seed: int) -> DataFrame:
    """Rows to append to a frozen pool: each stratum's quota by a new seed; a seed that the pool has used is refused.

    Podcasts keep their cap over pool and new rows. The rows have the pool's columns with ``seed_col`` set.
    """
    if not pool.where(F.col(seed_col) == seed).isEmpty():
        raise ValueError(f"seed {seed} was used for this pool; a top-up needs a new seed")
    seats = quotas.select(stratum, F.col("quota").alias("seats"))
    taken = pool.withColumn(stratum, F.lit(None).cast(pool.schema[stratum].dataType))  # its rows fill no new quota
    drawn = gap_draw(rows, seats, taken, [stratum], item, podcast, cap, seed, margin=0)
    return drawn.withColumn(seed_col, F.lit(seed).cast(pool.schema[seed_col].dataType)).select(*pool.columns)


def build_split(grouped: DataFrame, doc: str, root: str, eligible: DataFrame, stratum: str, per_stratum: int, val: float, seed: int) -> DataFrame:
    """(doc, root, side): whole groups go to one side.

    Of each stratum's ``eligible`` documents (doc, stratum) the first by seeded hash are the benchmark, with their groups; of
    the other groups a share by hash of the root is val, the rest train.
    """
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(seeded_hash(seed, doc), doc))
    picked = eligible.withColumn("place", place).where(F.col("place") <= per_stratum).select(doc)
    roots = grouped.join(picked, doc, "left_semi").select(root).distinct().withColumn("bench", F.lit(True))
    share = F.conv(F.substring(seeded_hash(seed, root), 1, 8), 16, 10).cast("double") / 4294967296.0
    return grouped.join(roots, root, "left").select(doc, root, F.when(F.col("bench"), "benchmark").when(share < val, "val").otherwise("train").alias("side"))
