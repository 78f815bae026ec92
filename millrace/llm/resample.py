"""Resampling of documents towards a target distribution: hashed n-gram importance weights, then a Gumbel top draw.

Native: words are exploded with their two successors, n-grams are hashed to buckets by crc32, grouped counts of
corpus and target give each bucket's gain, a broadcast table of gains (its size is the number of buckets) meets the
features again and is summed by document, and the draw is a distributed sort whose ranks are a partition's offset and
a row's place in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import stored

BUCKETS = 10_000
#: Longest run of words that is a feature.
_RUN = 3
#: What parts words once A-Z are lower-cased: ASCII that is neither a digit nor a small letter.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: monotonically_increasing_id has the partition above this bit and the place in it below.
_PLACE_BITS = 33


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), _BETWEEN), "")


def _features(df: DataFrame, text: str, keep: dict[str, Column]) -> DataFrame:
    """(``keep``, n_words, opens, bucket): a row for each feature; one with a null bucket stands for a text without words.

    ``opens`` marks one row of each text, so that equal rows can be counted after they have met.
    """
    parted = df.select(*[c.alias(k) for k, c in keep.items()], words(F.col(text)).alias("words"))
    parted = parted.withColumn("n_words", F.size("words"))  # here, so that no exploded row carries the words
    rest = lambda i: F.slice("words", i, 2**31 - 1)
    runs = parted.select(*keep, "n_words", F.posexplode_outer(F.arrays_zip("words", *[rest(i) for i in range(2, _RUN + 1)])).alias("at", "run"))
    parts = [F.col("run")["words"], *[F.col("run")[str(i)] for i in range(1, _RUN)]]
    spaced = lambda n: [x for p in parts[:n] for x in (F.lit(" "), p)][1:]
    bucket = lambda n: (F.crc32(F.concat(*spaced(n)).cast("binary")) % BUCKETS).cast("int")
    each = runs.select(*keep, "n_words", "at", F.posexplode(F.array(*[bucket(n) for n in range(1, _RUN + 1)])).alias("longer", "bucket"))
    opens = (F.col("longer") == 0) & (F.coalesce("at", F.lit(0)) == 0)
    return each.where(opens | F.col("bucket").isNotNull()).select(*keep, "n_words", opens.alias("opens"), "bucket")


def gains(docs: DataFrame, target: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, gain): 1000 times the log of a bucket's smoothed share of the target over that of the corpus, rounded down.

    Every bucket has a row, so a table without words, or an empty one, gives gains too.
    """
    counted = lambda df, name: _features(df, text, {}).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(counted(docs, "s"), "bucket", "left").join(counted(target, "t"), "bucket", "left").na.fill(0)
    both = stored(both, "bucket-counts")
    whole = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    share = ((t + 1) * (F.col("all_s") + BUCKETS)) / ((s + 1) * (F.col("all_t") + BUCKETS))
    return both.crossJoin(F.broadcast(whole)).select("bucket", F.floor(F.lit(1000.0) * F.log(share)).alias("gain"))


def weigh(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every row: the sum of gains over a text's features, repeats counted.

    Equal rows (id and text) meet in one group and are dealt out again; a null text has no features and weight 0.
    A row is known by its id and two hashes of its text, so null and repeated ids share no group unless texts agree.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = {"id": F.col(id_col), "key": F.xxhash64(text), "key2": F.xxhash64(F.lit(1), text)}
    met = _features(docs, text_col, keep).join(F.broadcast(table), "bucket", "left")
    copies = F.count_if("opens")
    sums = met.groupBy(*keep, "n_words").agg(copies.alias("copies"), F.count("bucket").alias("n"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"))
    each = sums.select("id", "n_words", "copies", "n", "gain", F.explode(F.sequence(F.lit(1), "copies")))
    return each.select(F.col("id").alias(id_col), F.col("n_words").cast("long"), (F.expr("n div copies")).alias("n_features"), F.expr("gain div copies").alias("weight"))


def gumbel(id_: Column, seed: int) -> Column:
    """A document's draw of Gumbel noise from a hash of the seed and its id (null: empty), times 1000, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share)))


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ranks from 1 in a (total) order over all rows, without a task that sees all of them.

    Rows are sorted in ranges; the sorted table is written once, so the offsets and the places are of the same ranges.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    placed = stored(placed, "ranges")
    part = F.shiftright(name, _PLACE_BITS)
    sizes = placed.groupBy(part.alias("range")).agg(F.count("*").alias("size"))  # a row for each range
    before = sizes.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("before"))
    place = F.col(name).bitwiseAND((1 << _PLACE_BITS) - 1)
    return placed.join(F.broadcast(before), part == F.col("range")).select(*df.columns, (F.col("before") + place + 1).alias(name))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every row; rank is null for those not drawn.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred (rounded down) with the highest scores are
    drawn, ties to the smaller id, null ids last; rows equal in all of that have consecutive ranks. Null texts, texts
    without words and an empty table draw nothing; an empty target leaves weights that favour rare buckets. Other columns
    are not read. Copies of a text have equal weights and differ by their ids' noise.
    """
    weighed = weigh(docs, gains(docs, target, text_col), id_col, text_col)
    scored = stored(weighed.withColumn("score", F.col("weight") + gumbel(F.col(id_col), seed)), "scores")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.agg(F.floor(F.count("*") * percent / 100).alias("drawn"))
    known = ranked(able, [F.desc("score"), F.asc_nulls_last(id_col)], "rank").crossJoin(F.broadcast(drawn))
    known = known.withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return known.select(*rest.columns).unionByName(rest).drop("n_words")
