"""Records with rules: validation, refusals, filters by kind, states, enrichment with coverage, gates and exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.names import fresh


def violations(rows: DataFrame, rules: dict[str, Column], to: str = "violations") -> DataFrame:
    """Rows with the names of the rules that they break, in the rules' order.

    A rule is a condition that a good row meets; a null condition is not met. Repeated rows are judged alike; an empty
    table stays empty. A column named ``to`` is an error.
    """
    if to in rows.columns:
        raise ValueError(f"the table has a column named {to}")
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return rows.withColumn(to, F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))


def refuse(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows as they are; the job ends with an error that names the first rule that a row breaks."""
    out = rows
    for name, ok in rules.items():
        out = out.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"refused: {name}")).cast("boolean")))
    return out


def refusals(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): how many rows break each rule that any row breaks."""
    broken = fresh("broken", rows)
    return violations(rows, rules, broken).select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def record_rules(options: str, answer: str, evidence: str, n_lines: str) -> dict[str, Column]:
    """What a labelled record must meet; evidence is ascending, each line once, and within the lines."""
    values, lines = F.col(options), F.col(evidence)
    return {
        "two options": F.size(values) >= 2, "options differ": F.size(F.array_distinct(values)) == F.size(values), "answer is an option": F.array_contains(values, F.col(answer)),
        "evidence ascends": lines == F.array_sort(F.array_distinct(lines)), "evidence from one": F.forall(lines, lambda e: e >= 1), "evidence in lines": F.forall(lines, lambda e: e <= F.col(n_lines)),
    }


def transcript_rules(variants: str, speakers: str, kinds: tuple[str, ...] = ("clean", "messy")) -> dict[str, Column]:
    """Variants (kind, lines) are of known kinds and have as many lines each; every line's role is a declared speaker."""
    v = F.col(variants)
    used = F.array_distinct(F.flatten(F.transform(v, lambda x: F.transform(x["lines"], lambda s: F.substring_index(s, ": ", 1)))))
    return {
        "known kinds": F.forall(v, lambda x: x["kind"].isin(*kinds)), "aligned": F.size(F.array_distinct(F.transform(v, lambda x: F.size(x["lines"])))) == 1,
        "speakers declared": F.size(F.array_except(used, F.col(speakers))) == 0,
    }


def case_reason(kind: Column, turns: Column, speakers: Column, unattributed: Column, least: dict[str, int], shows: dict[str, tuple[int, int, int, int]]) -> Column:
    """Why a dialogue makes no case, or null: unattributed turns, too few turns of its kind, or a show's speakers or turns.

    ``least`` has the fewest turns of a kind; ``shows`` has (least speakers, most speakers, least turns, most turns).
    A kind that neither names is refused as unknown.
    """
    out = F.when(F.coalesce(unattributed, F.lit(0)) > 0, "unattributed")
    for name, n in least.items():
        out = out.when((kind == name) & (turns < n), "short")
    for name, (a, b, c, d) in shows.items():
        out = out.when((kind == name) & ~speakers.between(a, b), "speakers").when((kind == name) & ~turns.between(c, d), "turns")
    return out.when(~F.coalesce(kind.isin(*least, *shows), F.lit(False)), "unknown kind")


def is_current(record: Column, fields: tuple[str, ...]) -> Column:
    """Whether a cached record has all fields of this version; a missing record is not current."""
    out = record.isNotNull()
    for f in fields:
        out = out & record[f].isNotNull()
    return F.coalesce(out, F.lit(False))


def is_buildable(record: Column, fields: tuple[str, ...]) -> Column:
    """True for a conversation with hosts, false for any other identified record, null where none is current."""
    return F.when(is_current(record, fields), (record["kind"] == "conversation") & (F.size(record["hosts"]) > 0))


def is_usable(tokens: Column, stratum: Column, wanted: Column, ceiling: int, reject: Column) -> Column:
    return F.coalesce((stratum == wanted) & (tokens <= ceiling) & reject.isNull(), F.lit(False))


def enrich(rows: DataFrame, more: DataFrame, key: str, defaults: dict[str, object], least: float = 0.99) -> DataFrame:
    """Rows with the columns of ``more`` (one row a key), missing ones by default; an error if too few keys are known.

    A share of distinct keys under ``least`` stops before any result, as links that use the columns would silently not
    reach the rest. Null keys count as missing. No rows, no check. Columns of both tables but the key are an error.
    """
    clash = [c for c in more.columns if c != key and c in rows.columns]
    if clash:
        raise ValueError(f"both tables have {clash}")
    marked = more.dropDuplicates([key]).withColumn(seen := fresh("seen", rows, more), F.lit(True))
    both = rows.join(marked, key, "left")
    known, n = both.select(key, seen).distinct().agg(F.count_if(F.coalesce(F.col(seen), F.lit(False))), F.count("*")).first()
    if n and known < least * n:
        raise ValueError(f"{known} of {n} keys are known; at least {least:.0%} must be")
    return both.drop(seen).fillna(defaults)


def gate(rows: DataFrame, episode: str, question: str, held: str, gate_question: str, answer: str, none: str) -> DataFrame:
    """Rows with ``gated``: an answer to ``held`` that the episode's answer ``none`` to ``gate_question`` settles.

    A row of ``held`` whose episode has no row of the gate ends the job with an error. Other rows are not gated.
    """
    g = rows.where(F.col(question) == gate_question).groupBy(episode).agg(F.max(F.col(answer) == none).alias(found := fresh("gate", rows)))
    both = rows.join(g, episode, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {gate_question} on episode "), F.col(episode).cast("string"))).cast("boolean")
    held_row = F.coalesce(F.col(question) == held, F.lit(False))
    return both.withColumn("gated", F.when(~held_row, False).when(F.col(found).isNull(), missing).otherwise(F.col(found))).select(*rows.columns, "gated")


def excluded(rows: DataFrame, used: DataFrame, doc: str, title: str) -> DataFrame:
    """Rows whose document and whose title no used row has; null and empty titles exclude nothing."""
    docs = used.select(doc).where(F.col(doc).isNotNull()).distinct()
    titles = used.select(title).where(F.coalesce(F.col(title), F.lit("")) != "").distinct()
    return rows.join(docs, doc, "left_anti").join(titles, title, "left_anti").select(*rows.columns)


def done_by_all(rows: DataFrame, key: str, labeller: str) -> DataFrame:
    """(key): what every labeller of the table has; the number of labellers is counted first."""
    n = rows.agg(F.count_distinct(labeller)).first()[0]
    return rows.where(F.col(labeller).isNotNull()).groupBy(key).agg(F.count_distinct(labeller).alias("n")).where(F.col("n") == n).select(key)


def symmetric_difference(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one table only, "one" or "two"; null keys are a key like any other."""
    both = one.select(key, F.lit(1).alias("side")).unionByName(two.select(key, F.lit(2).alias("side"))).groupBy(key)
    sides = both.agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a = b")
    return sides.select(key, F.when(F.col("a") == 1, "one").otherwise("two").alias("side"))


def precedence(cache: DataFrame, given: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, action, record): what a run of the metadata rule does to each key's cached record.

    ``cache`` has (key, source, record); ``given`` (key, record), the rule's record or null where it no longer holds. A
    record of the rule replaces any other ("replace"), but not a model's verdict that the item is no conversation
    ("keep"); an equal one is left ("unchanged"); a rule's record that no longer holds is revoked ("revoke", no record).
    """
    c = cache.select(key, F.col("source").alias("source"), F.col("record").alias("old"))
    both = given.select(key, F.col("record").alias("new")).join(c, key, "full")
    ours = F.coalesce(F.col("source") == "metadata", F.lit(False))
    verdict = ~ours & is_current(F.col("old"), fields) & (F.col("old.kind") != "conversation")
    action = (
        F.when(F.coalesce(verdict, F.lit(False)), "keep").when(F.col("new").isNull(), F.when(ours & is_current(F.col("old"), fields), "revoke").otherwise("keep"))
        .when(ours & F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("replace")
    )
    out = both.withColumn("action", action)
    return out.select(key, "action", F.when(F.col("action") == "replace", F.col("new")).when(F.col("action") != "revoke", F.col("old")).alias("record"))


def unseen(bank: DataFrame, ledger: DataFrame, key: str, order: str) -> DataFrame:
    """The bank and, for each key that it lacks, the first row of the ledger in ``order``; columns are the bank's."""
    rest = ledger.where(F.col(key).isNotNull()).join(bank.select(key).distinct(), key, "left_anti")
    rows = F.struct(F.col(order), *[F.col(c) for c in bank.columns if c not in (key, order)])
    first = rest.groupBy(key).agg(F.min(rows).alias("first"))
    return bank.unionByName(first.select(*[F.col(c) if c == key else F.col(f"first.{c}") for c in bank.columns]))


def measured_again(old: DataFrame, measured: DataFrame, key: str, ceiling: int) -> DataFrame:
    """``old`` with the columns that only ``measured`` has added; new tokens over the ceiling null the stratum.

    Columns of both keep the old value; a missing old value takes the new one. Keys without a measurement stay.
    """
    new = measured.select(key, *[F.col(c).alias(f"new {c}") for c in measured.columns if c != key])
    both = old.join(new, key, "left")
    out = both.select(key, *[F.coalesce(c, F.col(f"`new {c}`")).alias(c) if c in measured.columns else F.col(c) for c in old.columns if c != key], *[F.col(f"`new {c}`").alias(c) for c in measured.columns if c not in old.columns])
    return out.withColumn("stratum", F.when(F.col("tokens") <= ceiling, F.col("stratum")))


def cost_summary(calls: DataFrame, keys: list[str], cost: str, failed: str, cache_read: str, input_tokens: str) -> DataFrame:
    """(keys, calls, failed_calls, cost, cache_read_tokens, input_tokens, calls_with_cache_reads); nulls count as zero."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return calls.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.count_if(F.coalesce(F.col(failed), F.lit(False))).alias("failed_calls"), F.round(F.sum(zero(cost)), 2).alias("cost"),
        F.sum(zero(cache_read)).alias("cache_read_tokens"), F.sum(zero(input_tokens)).alias("input_tokens"), F.count_if(zero(cache_read) > 0).alias("calls_with_cache_reads"),
    )


def mapped_role(role: Column, known: dict[str, str], other: str) -> Column:
    pairs = [F.lit(x) for pair in known.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce(role, F.lit(""))), F.lit(other))


def nearest_divisor(n: Column, wanted: int) -> Column:
    """The divisor d of n for which n / d is closest to ``wanted``, the smaller one on a tie; null for n below one."""
    fits = F.filter(F.sequence(F.lit(1).cast("long"), n), lambda d: n % d == 0)
    best = F.array_min(F.transform(fits, lambda d: F.struct(F.abs(n / d - F.lit(wanted)).alias("gap"), d.alias("d"))))
    return F.when(n >= 1, best["d"])
