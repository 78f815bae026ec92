"""A sequential scan with quotas: what it takes, found in rounds over the whole table and not row by row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.components import written
from millrace.operators.ranks import seeded_hash

#: What a row asks for: the columns that name the key, the seats of a key, and (columns, seats) of keys that have others.
Resource = tuple[list[str], int, DataFrame | None]


def _named(columns: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in columns]))


def within(rows: DataFrame, key: str, part: str, order: list[str], limit: str, name: str) -> DataFrame:
    """Rows with ``name``: their place (from 1) in their key, null where all of their part lies beyond the limit.

    ``part`` cuts a key's order into ranges, so a hot key is numbered by many tasks; a window of the key sees counts only.
    """
    sizes = rows.groupBy(key, part).agg(F.count("*").alias("_size"), F.max(limit).alias("_limit"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = sizes.withColumn("_before", before).where(F.col("_before") < F.col("_limit")).select(key, part, "_before")
    place = F.col("_before") + F.row_number().over(Window.partitionBy(key, part).orderBy(*order))
    return rows.join(reached, [key, part], "left").withColumn(name, place).drop("_before")


def greedy_scan(rows: DataFrame, item: str, resources: list[Resource], seed: int, phase: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """(item, phase, columns of the resources, ``keep``): the rows that a scan takes, one after the other, while every key has a seat.

    The scan goes by ``phase`` (whole numbers from 0), then by seeded hash of the item. A row is taken if each of its keys
    (a podcast, a cell) has a seat left, and takes one of each. No row is visited alone: in each round a row is taken
    when it would fit even if every undecided row before it were, and falls when a key of it is full; the others wait. The
    first waiting row always fits, so rounds end, and none ever takes a seat that an earlier row could have had.

    Equal rows count once; an item in several rows (of other keys) may be taken for each, unless ``([item], 1, None)`` is
    a resource. Null keys are keys like any other, a null phase goes first, and an empty table gives no rows.
    """
    columns = list(dict.fromkeys([item, *([phase] if phase else []), *[c for r in resources for c in r[0]], *(keep or [])]))
    names = [f"k{i}" for i in range(len(resources))]
    lead = F.lpad(F.coalesce(F.col(phase) + 1, F.lit(0)).cast("long").cast("string"), 10, "0") if phase else F.lit("")
    work = rows.select(*columns).distinct().select(
        F.struct(*columns).alias("row"), *[_named(r[0]).alias(k) for r, k in zip(resources, names)],
        F.concat(lead, seeded_hash(seed, item)).alias("mark"), _named(columns).alias("tie"), F.concat(lead, F.substring(seeded_hash(seed, item), 1, 3)).alias("part"))
    for (cols, seats, others), k in zip(resources, names):
        if others is None:
            work = work.withColumn(f"{k}_left", F.lit(seats).cast("long"))
        else:
            known = others.groupBy(_named(cols).alias(k)).agg(F.max("seats").cast("long").alias(f"{k}_own"))
            work = work.join(known, k, "left").withColumn(f"{k}_left", F.coalesce(f"{k}_own", F.lit(seats).cast("long"))).drop(f"{k}_own")
    state, taken = written(work.withColumn("taken", F.lit(False)), "scan")[0], []
    while True:
        waiting, new = state.where(~F.col("taken")).drop("taken"), state.where("taken")
        if taken:
            for k in names:
                used = new.groupBy(k).agg(F.count("*").alias("_used"))
                waiting = waiting.join(used, k, "left").withColumn(f"{k}_left", F.col(f"{k}_left") - F.coalesce("_used", F.lit(0))).drop("_used")
        open_ = waiting.where(reduce(lambda a, b: a & b, [F.col(f"{k}_left") > 0 for k in names]))
        for k in names:
            open_ = within(open_, k, "part", ["mark", "tie"], f"{k}_left", f"{k}_place")
        fits = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"{k}_place") <= F.col(f"{k}_left"), F.lit(False)) for k in names])
        state = written(open_.withColumn("taken", fits).select(*work.columns, "taken"), "scan")[0]
        taken.append(state.where("taken").select("row.*"))
        if state.where(~F.col("taken")).isEmpty():
            return reduce(DataFrame.unionByName, taken)


def gap_scan(candidates: DataFrame, targets: DataFrame, have: DataFrame, cell: list[str], item: str, podcast: str, cap: int, seed: int, margin: float = 0.06) -> DataFrame:
    """(item, cell, podcast): as ``strata.gap_draw``, but a podcast's seats go to rows that their cell still needs.

    One scan over all cells by seeded hash: a row is passed over if its cell is full or its podcast has ``cap`` rows, those
    of ``have`` included. An item that ``have`` holds is never drawn. Cells without a target draw nothing.
    """
    got = have.groupBy(_named(cell).alias("cell_name")).agg(F.count("*").alias("got_rows"))
    short = F.greatest(F.lit(0), F.col("seats") - F.coalesce("got_rows", F.lit(0)))
    want = targets.withColumn("cell_name", _named(cell)).join(got, "cell_name", "left").select(*cell, F.ceil(short * (1 + margin)).alias("seats"))
    rest = have.groupBy(podcast).agg(F.greatest(F.lit(0), cap - F.count("*")).alias("seats"))
    free = candidates.select(item, podcast, *cell).join(have.select(item), item, "left_anti")
    return greedy_scan(free, item, [(cell, 0, want), ([podcast], cap, rest)], seed)


def filled_scan(pool: DataFrame, seats: DataFrame, stratum: str, row: str, column: str, item: str, reused: str, podcast: str, cap: int, seed: int) -> DataFrame:
    """(item, cell's columns, podcast, to_row, to_column): cells' seats by one scan, then fills for the short cells by a second.

    The first scan goes by reused rows, then the others; a row is taken while its cell and its podcast have seats. In the
    second, short cells ask in their order, each the nearest cells of its stratum first (a step in ``row`` counts double, ties
    to the lower cell), and the podcast cap goes on over both. ``to_row`` and ``to_column`` are null for a cell's own rows. A
    row meets each short cell of its stratum, whose number the design fixes. Cells without seats give, but take nothing.
    """
    cell, to = [stratum, row, column], ["to_row", "to_column"]
    base = pool.select(item, *cell, podcast, (1 - F.coalesce(F.col(reused).cast("int"), F.lit(0))).alias("scan_phase"))
    mine = written(greedy_scan(base, item, [(cell, 0, seats), ([podcast], cap, None)], seed, "scan_phase"), "mine")[0]
    rest = mine.groupBy(podcast).agg((cap - F.count("*")).alias("seats"))
    own = mine.groupBy(*cell).agg(F.count("*").alias("own"))
    empty = seats.join(own, cell, "left").select(stratum, F.col(row).alias("to_row"), F.col(column).alias("to_column"), (F.col("seats") - F.coalesce("own", F.lit(0))).alias("seats")).where("seats > 0")
    left = base.join(mine.select(item), item, "left_anti").join(empty.drop("seats"), stratum)
    steps = left.select(*cell, *to, "scan_phase").distinct()  # cells by cells
    far = 2 * F.abs(F.col(row) - F.col("to_row")) + F.abs(F.col(column) - F.col("to_column"))
    order = Window.partitionBy(stratum).orderBy(*to, far, row, column, "scan_phase")
    asked = left.join(steps.withColumn("step", F.row_number().over(order)), [*cell, *to, "scan_phase"])
    fills = greedy_scan(asked.select(item, *cell, podcast, *to, "step"), item, [([item], 1, None), ([stratum, *to], 0, empty), ([podcast], cap, rest)], seed, "step", [row, column])
    out = [item, *cell, podcast]
    return mine.select(*out, *[F.lit(None).cast(empty.schema[c].dataType).alias(c) for c in to]).unionByName(fills.select(*out, *to))
