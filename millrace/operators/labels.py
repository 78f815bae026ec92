"""Parsing, upserts and rendering around labels: strict JSON, Python literals, prompts, targets and truncation."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from millrace.functions import text as X
from millrace.functions.names import fresh

LABEL = StructType([StructField("answer", StringType()), StructField("evidence", ArrayType(LongType())), StructField("summary", StringType()), StructField("confidence", DoubleType())])


def _label(text: str | None) -> dict | None:
    """The whole text must be one JSON object; a field of the wrong kind is null, and a truth value is no number."""
    try:
        o = json.loads((text or "").strip())
    except ValueError:
        return None
    if not isinstance(o, dict):
        return None
    ev, conf = o.get("evidence"), o.get("confidence")
    whole = isinstance(ev, list) and all(isinstance(e, int) and not isinstance(e, bool) for e in ev)
    number = isinstance(conf, (int, float)) and not isinstance(conf, bool)
    return {
        "answer": o["answer"] if isinstance(o.get("answer"), str) else None, "evidence": ev if whole else None,
        "summary": o["summary"] if isinstance(o.get("summary"), str) else None, "confidence": min(1.0, max(0.0, float(conf))) if number else None,
    }


@F.pandas_udf(LABEL)
def strict_label(text: pd.Series) -> pd.DataFrame:
    """Model output as a label; all fields null if it is not one JSON object and nothing else."""
    return pd.DataFrame([_label(t) or dict.fromkeys(LABEL.names) for t in text], columns=LABEL.names)


def _literal(text: str | None) -> list[str]:
    try:
        v = ast.literal_eval((text or "").strip() or "[]")
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return []
    return [str(x) for x in v] if isinstance(v, (list, tuple, dict, set)) else []


@F.pandas_udf(ArrayType(StringType()))
def literal_names(text: pd.Series) -> pd.Series:
    """The strings of a list (or a dict's keys) written as a Python literal; anything else gives none."""
    return text.map(_literal)


def clip_evidence(evidence: Column, n_lines: Column) -> Column:
    """Line numbers that exist, ascending, each once; null evidence stays null."""
    return F.array_sort(F.array_distinct(F.filter(evidence, lambda e: (e >= 1) & (e <= n_lines))))


def target_json(answer: Column, evidence: Column, summary: Column) -> Column:
    """The target text: fixed key order, a space after every comma and colon, letters as they are."""
    quote = lambda c: F.substring(F.to_json(F.struct(c.alias("v"))), 6, 1 << 30)  # noqa: E731  {"v":X}
    plain = lambda c: F.expr("1") if c is None else F.left(quote(c), F.length(quote(c)) - 1)
    return F.concat(F.lit('{"answer": '), plain(answer), F.lit(', "evidence": ['), F.array_join(evidence.cast("array<string>"), ", "), F.lit('], "summary": '), plain(summary), F.lit("}"))


def target_text(evidence: Column, answer: Column, summary: Column, tags: Column | None = None) -> Column:
    """The target of a question: evidence, answer and summary in this order, and tags where the question has any.

    ``tags`` is null for a question without tags. A space follows every comma and colon, and letters stay as they are.
    """
    quote = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", "$1")
    numbers = F.array_join(evidence.cast("array<string>"), ", ")
    body = F.concat(F.lit('{"evidence": ['), numbers, F.lit('], "answer": '), quote(answer), F.lit(', "summary": '), quote(summary))
    if tags is not None:
        body = F.concat(body, F.coalesce(F.concat(F.lit(', "tags": ['), F.array_join(F.transform(tags, quote), ", "), F.lit("]")), F.lit("")))
    return F.concat(body, F.lit("}"))


def task_prompt(template: str, lines: Column, speakers: Column, question: Column, description: Column, options: Column, tags: Column) -> Column:
    """A template filled with a question: {speakers}, {transcript}, {question}, {context}, {options}, {tags_rule}, {values}.

    ``options`` are structs of value and criteria; a null or empty description or list of tags adds no text.
    """
    parts = {
        "speakers": F.array_join(speakers, ", "), "transcript": F.array_join(X.numbered(lines), "\n"), "question": question,
        "context": F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("\nContext: "), description)).otherwise(""),
        "options": F.array_join(F.transform(options, lambda o: F.concat(F.lit("- "), o["value"], F.lit(": "), o["criteria"])), "\n"),
        "tags_rule": F.when(F.size(tags) > 0, F.concat(F.lit("\nTags, from this list only (none may apply): "), F.array_join(tags, "; "))).otherwise(""),
        "values": F.array_join(F.transform(options, lambda o: o["value"]), ", "),
    }
    return fill_template(template, parts)


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """A template's {names} replaced; a name without a value is an error before any job runs."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    missing = [p for p in parts[1::2] if p not in values]
    if missing:
        raise KeyError(f"no value for {missing}")
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def upsert_by_rank(cache: DataFrame, update: DataFrame, key: str, rank: Column) -> DataFrame:
    """One row for each key: the one of least rank, the update's on a tie, then the first by its text as JSON.

    ``rank`` is over the cache's columns.
    """
    new, place = fresh("new", cache), fresh("place", cache)
    both = cache.withColumn(new, F.lit(0)).unionByName(update.select(*cache.columns).withColumn(new, F.lit(1)))
    w = Window.partitionBy(key).orderBy(rank, F.desc(new), F.to_json(F.struct(*cache.columns)))
    return both.withColumn(place, F.row_number().over(w)).where(F.col(place) == 1).drop(place, new)


def truncate_head(lines: DataFrame, doc: str, order: str, line: str, frame: Column, budget: int, count: Column) -> DataFrame:
    """(doc, kept, text): the first lines whose tokens with the frame's fit the budget; documents of which none fits go.

    ``count`` is the tokens of one line (with its line end), so a running sum is exact for counters that add over lines.
    """
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    fit = lines.withColumn("_upto", F.sum(count).over(w) + frame).where(F.col("_upto") <= budget)
    rows = fit.groupBy(doc).agg(F.count("*").alias("kept"), F.sort_array(F.collect_list(F.struct(order, F.col(line).alias("l")))).alias("rows"))
    return rows.select(doc, "kept", F.array_join(F.transform("rows", lambda r: r["l"]), "\n").alias("text"))


def applicable(calls: DataFrame, questions: DataFrame, dataset: str = "dataset", allow: str = "dataset_allow_list") -> DataFrame:
    """Calls with every question whose allow list names their dataset, as an equi-join on the exploded list.

    The bank of questions is a dimension table; it is broadcast by Spark where its size allows.
    """
    allowed = questions.withColumn(dataset, F.explode(F.array_distinct(allow)))
    return calls.join(allowed, dataset)


def same_question_pairs(one: DataFrame, two: DataFrame, key: str = "id") -> DataFrame:
    """(key, answer, other): answers of two labellers to one record, if both saw the same question."""
    canon = F.to_json(F.struct("text", "description", "options"))
    a = one.select(key, "answer", canon.alias("q"))
    b = two.select(key, F.col("answer").alias("other"), canon.alias("q"))
    return a.join(b, [key, "q"]).select(key, "answer", "other")


def cited_window(turns: DataFrame, doc: str, order: str, role: str, head: int = 80, tail: int = 20, first_of_rest: int = 2) -> DataFrame:
    """Turns of a document's start and end, and the first turns of speakers that neither shows."""
    at, n, shown, seen, own = (fresh(x, turns) for x in ("at", "n", "in", "seen", "own"))
    ties = [order, *[c for c in turns.columns if c != order]]  # turns of one place go by their other columns
    t = turns.withColumn(at, F.row_number().over(Window.partitionBy(doc).orderBy(*ties))).withColumn(n, F.count("*").over(Window.partitionBy(doc)))
    t = t.withColumn(shown, (F.col(at) <= head) | (F.col(at) > F.col(n) - tail))
    t = t.withColumn(seen, F.max(F.col(shown)).over(Window.partitionBy(doc, role))).withColumn(own, F.row_number().over(Window.partitionBy(doc, role).orderBy(*ties)))
    return t.where(F.col(shown) | (~F.col(seen) & (F.col(own) <= first_of_rest))).select(*turns.columns)


def distribution_table(pairs: DataFrame, keys: list[str], ref: str, hyp: str, fillers: tuple[str, ...] = ("um", "uh", "er")) -> DataFrame:
    """(keys, side, words, distinct_words, fillers_per_1000, length_ratio) of references and recogniser outputs."""
    both = pairs.select(*keys, F.explode(F.array(F.struct(F.lit("ref").alias("side"), F.col(ref).alias("ws")), F.struct(F.lit("hyp").alias("side"), F.col(hyp).alias("ws")))).alias("x"))
    words = both.select(*keys, "x.side", F.explode("x.ws").alias("w"))
    out = words.groupBy(*keys, "side").agg(F.count("*").alias("words"), F.count_distinct("w").alias("distinct_words"), F.bround(1000 * F.avg(F.col("w").isin(*fillers).cast("double")), 3).alias("fillers_per_1000"))
    base = out.where("side = 'ref'").select(*keys, F.col("words").alias("_base"))
    return out.join(base, keys, "left").withColumn("length_ratio", F.bround(F.col("words") / F.col("_base"), 4)).drop("_base")


def host_coverage(turns: DataFrame, doc: str, role: str, said: str, named: DataFrame, least: float = 0.02) -> DataFrame:
    """(doc, role, share, host): a speaker's share of words; a named host with at least ``least`` of them is one."""
    n = turns.groupBy(doc, role).agg(F.sum(X.word_count(said)).alias("n"))
    share = n.withColumn("share", F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy(doc)), F.lit(1)))
    return share.join(named.select(doc, role, F.lit(True).alias("_named")), [doc, role], "left").select(doc, role, "share", (F.coalesce("_named", F.lit(False)) & (F.col("share") >= least)).alias("host"))
