"""Training examples from documents: lines, prompts and targets counted in tokens, cut or dropped where too long.

A token counter is a function of a column, or a Python function of texts made one by ``counter``; counts of lines
with their ends are taken to add up, so that a cut is found from running sums and no text is encoded twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from millrace.functions import text as X
from millrace.functions.names import fresh


def counter(count: Callable[[list[str]], list[int]]) -> Callable[[Column], Column]:
    """A column function from a function that counts the tokens of a list of texts; null text counts as empty."""

    @F.arrow_udf("long")
    def counted(column: pa.Array) -> pa.Array:
        return pa.array(count([t or "" for t in column.to_pylist()]), pa.int64())

    return counted


def plain_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, and every other character but white space and controls, as one token each."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\x00-\x20]")).cast("long")


def document_lines(text: Column, has_speakers: Column) -> Column:
    """Lines of a document with speakers, else its sentences; blank ones left out, spaces around the whole trimmed."""
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    lines = F.when(has_speakers, F.split(whole, "\n")).otherwise(X.sentences(whole))
    return F.filter(lines, lambda x: F.length(F.regexp_replace(x, r"\s+", "")) > 0)


def variants_of(have: Column, requested: list[str], labelled: Column) -> Column:
    """The requested variants that a record has, each once and in order; "labelled" is the one its labeller saw."""
    asked = F.array(*[labelled if v == "labelled" else F.lit(v) for v in requested])
    return F.array_distinct(F.filter(asked, lambda v: F.array_contains(have, v)))


def kept_lines(counts: Column, budget: Column) -> Column:
    """How many first lines fit the budget, from the tokens of each."""
    start = F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("full"))
    step = lambda s, c: F.when(s["full"] | (s["n"] + c > budget), F.struct(s["k"].alias("k"), s["n"].alias("n"), F.lit(True).alias("full"))).otherwise(F.struct((s["k"] + 1).alias("k"), (s["n"] + c).alias("n"), F.lit(False).alias("full")))
    return F.aggregate(counts, start, step, lambda s: s["k"])


def build_examples(records: DataFrame, key: str, variants: str, labelled: str, requested: list[str], frame: Column, target: Column, count: Callable[[Column], Column], max_len: int, overlong: str = "drop") -> DataFrame:
    """(key, variant, n_lines, kept, n_prompt, n_target, fate) of every record and variant.

    ``variants`` is a map of kind to lines; ``frame`` the tokens of a prompt without lines. An example has one token more
    than prompt and target; over ``max_len`` it is dropped, or with "truncate" keeps the first lines that fit and is
    dropped if none does. Null lines count as none. The fate is whole, truncated or dropped.
    """
    kinds = variants_of(F.map_keys(variants), requested, F.col(labelled))
    rows = records.withColumn("variant", F.explode(kinds)).withColumn("lines", F.coalesce(F.element_at(F.col(variants), F.col("variant")), F.array().cast("array<string>")))
    rows = rows.withColumn("counts", F.transform("lines", lambda x: count(x).cast("long"))).withColumn("n_target", target.cast("long")).withColumn("frame_tokens", frame.cast("long"))
    whole = F.col("frame_tokens") + F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    fits = whole + F.col("n_target") + 1 <= max_len
    kept = F.when(fits, F.size("counts")).otherwise(kept_lines(F.col("counts"), F.lit(max_len - 1) - F.col("n_target") - F.col("frame_tokens")) if overlong == "truncate" else F.lit(0))
    rows = rows.withColumn("fits", fits).withColumn("kept", kept)
    fate = F.when(F.col("fits"), "whole").when(F.col("kept") > 0, "truncated").otherwise("dropped")
    prompt = F.col("frame_tokens") + F.aggregate(F.slice("counts", F.lit(1), F.col("kept")), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select(key, "variant", F.size("lines").alias("n_lines"), "kept", prompt.alias("n_prompt"), "n_target", fate.alias("fate"))


def example_stats(examples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, examples, dropped, truncated, prompt_tokens, target_tokens, max_len) of built examples; dropped ones have no tokens."""
    stays = F.col("fate") != "dropped"
    of = lambda c: F.coalesce(F.sum(F.when(stays, F.col(c))), F.lit(0))
    return examples.groupBy(*keys).agg(
        F.count_if(stays).alias("examples"), F.count_if(~stays).alias("dropped"), F.count_if(F.col("fate") == "truncated").alias("truncated"), of("n_prompt").alias("prompt_tokens"), of("n_target").alias("target_tokens"),
        F.coalesce(F.max(F.when(stays, F.col("n_prompt") + F.col("n_target") + 1)), F.lit(0)).alias("max_len"),
    )


def over_cap(records: DataFrame, key: str, variants: str, frame: Column, count: Callable[[Column], Column], cap: int) -> DataFrame:
    """(key, variant, n_prompt, over_cap) of every variant that a record has."""
    rows = records.select(key, frame.cast("long").alias("frame_tokens"), F.explode(variants).alias("variant", "lines"))
    n = F.col("frame_tokens") + F.aggregate(F.transform("lines", lambda x: count(x).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select(key, "variant", n.alias("n_prompt"), (n > cap).alias("over_cap"))


def longer_in_training(chosen: DataFrame, key: str, sized: str, rendered: Column) -> DataFrame:
    """(key, sized, trained): rows whose training rendering has more tokens than the sizing one; none may be left."""
    return chosen.select(key, F.col(sized), rendered.alias("trained")).where(F.col("trained") > F.col(sized))


def target_counts(rows: DataFrame, keys: list[str], n: str, cut: str, max_target: int) -> DataFrame:
    """(keys, targets, encoder): supervised tokens after a cut, at most ``max_target`` an example, and those before it but the first."""
    return rows.groupBy(*keys).agg(F.sum(F.least(F.col(n) - F.col(cut), F.lit(max_target))).alias("targets"), F.sum(F.col(cut) - 1).alias("encoder"))


def masked_positions(rows: DataFrame, keys: list[str], ids: str, real: Column, prob: float, mask_id: int, seed: int, prompt: Column | None = None) -> DataFrame:
    """Rows with ``masked_ids`` and ``labels``: a share of the real positions masked, labels elsewhere -100.

    Position 0, positions of the prompt (the first ``prompt``) and of the padding (from ``real`` on) are never masked. A
    position's draw is a hash of the seed, the row's keys and the position, so it depends on no batch; rows with equal keys
    are masked at the same places. A null array stays null.
    """
    first = F.greatest(F.lit(1), F.coalesce(prompt, F.lit(0))) if prompt is not None else F.lit(1)
    marks, last, row = fresh("marks", rows), fresh("last", rows), fresh("row", rows)
    base = rows.withColumn(row, F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])).withColumn(last, real).withColumn(marks, first)
    share = lambda i: F.conv(F.substring(F.sha1(F.concat_ws("|", F.col(row), i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    base = base.withColumn(marks, F.transform(ids, lambda x, i: (i >= F.col(marks)) & (i < F.col(last)) & (share(i) < prob)))
    at = lambda i: F.get(F.col(marks), i)
    masked = F.transform(ids, lambda x, i: F.when(at(i), F.lit(mask_id).cast("long")).otherwise(x.cast("long")))
    labels = F.transform(ids, lambda x, i: F.when(at(i), x.cast("long")).otherwise(F.lit(-100).cast("long")))
    return base.withColumn("masked_ids", masked).withColumn("labels", labels).drop(row, marks, last)


def longest_heads(rows: DataFrame, lines: str, frame: str, budget: int, count: Callable[[list[str]], list[int]]) -> DataFrame:
    """Rows with ``kept`` (int): the most first lines whose text, after the frame's, counts no more than the budget.

    ``count`` gives the tokens of whole texts, and need not add up over lines; it must not fall as lines are added. A batch's
    rows are searched together: each step counts the middle of every open row, so a row costs about log n counts of
    prefixes, never one for each line. Whole texts that fit are found by the first count. Null lines are no line, a null
    frame is empty; a row of which no line fits keeps 0.
    """
    out = StructType([*rows.schema.fields, StructField("kept", IntegerType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(lines)).to_pylist()
            starts = batch.column(batch.schema.get_field_index(frame)).to_pylist()
            texts = [[x for x in t or [] if x is not None] for t in texts]
            fits = lambda at: [n <= budget for n in count([(starts[i] or "") + "\n".join(texts[i][:k]) for i, k in at])]
            whole = fits([(i, len(t)) for i, t in enumerate(texts)])
            low, high = [len(t) if w else 0 for t, w in zip(texts, whole)], [len(t) for t in texts]
            while open_ := [(i, (low[i] + high[i]) // 2) for i in range(len(texts)) if high[i] - low[i] > 1]:
                for (i, k), ok in zip(open_, fits(open_)):
                    low[i], high[i] = (k, high[i]) if ok else (low[i], k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.int32())], names=[*batch.schema.names, "kept"])

    return rows.mapInArrow(search, out)
