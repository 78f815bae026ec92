"""Language identification by Bayesian fusion of four kinds of evidence.

* text: likelihoods of hashed byte trigrams under a model for each language;
* declaration: how often texts of a language declare each language (P(declared | language));
* address suffix and host: a prior for the language of a host, smoothed towards its domain, that towards
  the suffix, that towards all rows; counts of all rows by grouped aggregation, the row's own left out.

The model is fitted on a bounded sample of distinct texts of each label; the counts cover every row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import stored

#: Distinct texts of each label that the model is fitted on at most.
SAMPLE = 1000
#: Documents of the sample that must hold a trigram for it to be known: one odd document vouches for none.
#: Of a label with fewer documents all of its own must.
LEAST_DOCS = 3
#: Trigrams that a text's evidence is worth at most: neighbours are not independent.
WORTH = 60.0
#: Pseudo-counts that carry a parent's distribution to a child, and a declaration's base rate to a language.
SMOOTH, SMOOTH_DECLARED = 8.0, 4.0
#: Rejected: a posterior under the first, or a share of known trigrams under the second.
LEAST_POSTERIOR, LEAST_KNOWN = 0.5, 0.3
UNKNOWN = "und"

_SLOTS = 1 << 16
_UNIT = 1024  # log-likelihoods are whole multiples of a nat over this, so sums do not depend on order
_SEGMENT = 1 << 20
_PRIMARY = "^[a-z]+"
#: Country suffixes whose rows lean towards a language, as pseudo-counts of the suffix's prior. Fixed values.
_SUFFIX = {"de": "de", "at": "de", "ch": "de", "fr": "fr", "be": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh"}
_SUFFIX_COUNT = 16.0


def _grams(text: str) -> Iterator[np.ndarray]:
    """Slots of the byte trigrams of the text in lower case, white space made one space, in bounded parts."""
    data = b" " + " ".join(text.lower().split()).encode() + b" "
    if len(data) < 3:
        return
    for at in range(0, len(data) - 2, _SEGMENT):
        x = np.frombuffer(data, np.uint8, min(_SEGMENT + 2, len(data) - at), at).astype(np.uint32)
        yield ((x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))) >> np.uint32(16)


class Model:
    """Languages, the log-likelihood of each slot under each, and which slots are known."""

    def __init__(self, languages: list[str], counts: np.ndarray, known: np.ndarray) -> None:
        self.languages = languages
        share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * _SLOTS) if len(languages) else counts.astype(float)
        self.logs = np.round(np.log(share) * _UNIT).astype(np.int32) if len(languages) else counts.astype(np.int32)
        self.known = known

    def score(self, text: str) -> tuple[list[int], int, int]:
        """Log-likelihood under each language, trigrams, and those of them that are known."""
        sums, n, known = np.zeros(len(self.languages), np.int64), 0, 0
        for slots in _grams(text):
            n += len(slots)
            known += int(np.count_nonzero(self.known[slots]))
            for i, logs in enumerate(self.logs):
                sums[i] += int(logs[slots].sum(dtype=np.int64))
        return sums.tolist(), n, known


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows[label] = rows.get(label, 0) + 1
            count = sum([np.bincount(slots, minlength=_SLOTS) for slots in _grams(text)], np.zeros(_SLOTS, np.int64))
            sums[label] = sums.get(label, 0) + count
            docs[label] = docs.get(label, 0) + (count > 0)
        for label, c in sums.items():
            at = np.flatnonzero(c)
            columns = [np.append(at, -1), np.append(c[at], rows[label]), np.append(docs[label][at], rows[label])]
            yield pa.record_batch([pa.array([label] * (len(at) + 1)), *[pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))]], ["label", "slot", "n", "docs"])


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on the ``sample`` distinct texts of each label whose hash is least, of the rows with a label and a text.

    Labels are all that the column has, in lower case and up to the first other character than a letter; each has its
    own share of the sample, so a rare language is learnt from as many texts as it has, and copies of a text count
    once. What reaches the driver and the workers is bounded by the number of labels: 256 KB for each.
    """
    label = F.regexp_extract(F.lower(F.trim(F.col(label_col).cast("string"))), _PRIMARY, 0)
    rows = labelled.select(label.alias("label"), F.col(text_col).alias("text")).where("text is not null and label <> ''").withColumn("mark", F.xxhash64("text"))
    # The hashes are even, so about twice the sample lies under this mark; the rest needs no shuffle.
    about = rows.groupBy("label").agg(F.approx_count_distinct("mark").alias("n")).collect()
    if not about:
        return Model([], np.zeros((0, _SLOTS)), np.zeros(_SLOTS, bool))
    last = [(r.label, -(1 << 63) + min((1 << 64) - 1, (2 * sample << 64) // max(r.n, 1))) for r in about]
    # As a local relation, whose size Spark knows: it is broadcast while it is small.
    low = rows.join(rows.sparkSession.createDataFrame(pa.table({"label": [x for x, _ in last], "last": pa.array([y for _, y in last], pa.int64())})), "label").where("mark <= last")
    place = F.row_number().over(Window.partitionBy("label").orderBy("mark"))
    drawn = low.groupBy("label", "mark").agg(F.first("text").alias("text")).withColumn("place", place).where(F.col("place") <= sample)
    counted = drawn.select("label", "text").mapInArrow(_count_grams, "label string, slot int, n long, docs long")
    found = counted.groupBy("label", "slot").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).toArrow()
    size = {r["label"]: r["n"] for r in found.filter(pc.field("slot") < 0).to_pylist()}
    languages = sorted(size)
    at = {x: i for i, x in enumerate(languages)}
    found = found.filter(pc.field("slot") >= 0)
    which, slot, n, held = np.array([at[x] for x in found["label"].to_pylist()], np.int64), *(found[c].to_numpy() for c in ("slot", "n", "docs"))
    counts, docs, known = np.zeros((len(languages), _SLOTS)), np.zeros(_SLOTS, np.int64), np.zeros(_SLOTS, bool)
    counts[which, slot] = n
    np.add.at(docs, slot, held)
    known[slot[held >= np.minimum(LEAST_DOCS, np.array([size[x] for x in languages], np.int64)[which])]] = True
    return Model(languages, counts, known | (docs >= LEAST_DOCS))


def _scorer(model: Broadcast, text_of: Callable[[str], str] | None):
    @F.arrow_udf("struct<logs:array<long>,grams:long,known:long>")
    def score(column: pa.Array) -> pa.Array:
        tool = model.value
        logs, grams, known = [], [], []
        for text in column.to_pylist():
            a, b, c = tool.score(text_of(text or "") if text_of else text or "")
            logs.append(a)
            grams.append(b)
            known.append(c)
        return pa.StructArray.from_arrays([pa.array(logs, pa.list_(pa.int64())), pa.array(grams, pa.int64()), pa.array(known, pa.int64())], ["logs", "grams", "known"])

    return score.asNondeterministic()  # for else a filter on what it finds would score every text twice


def _counts(languages: list[str]) -> list[Column]:
    return [F.count_if(F.col("own") == F.lit(i)).alias(f"n{i}") for i in range(len(languages))]


def _vector(prefix: str, n: int) -> Column:
    return F.array(*[F.col(f"{prefix}{i}").cast("double") for i in range(n)])


def identify(docs: DataFrame, model: Model, text_col: str, declared: Column | None = None, host: Column | None = None, text_of: Callable[[str], str] | None = None, taken: str = "found", keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with a struct column named ``taken``: lang, posterior, text_lang and rejected.

    ``lang`` has the highest posterior (ties: first in the model's order), or is "und" where the row is
    rejected: no trigram, few known trigrams, or a low posterior. Null text counts as empty; a null or empty
    declaration or host is no evidence. Equal rows are all kept, and each counts for its host. A model
    without languages rejects every row. An existing column named ``taken`` is an error. ``keep`` names the
    columns of ``docs`` that come along (default: all); without the text's, a text is scored once and its evidence stored,
    with it the text is scored again, which costs less than to store or shuffle it.
    """
    keep = docs.columns if keep is None else keep
    if taken in docs.columns:
        raise ValueError(f"the table has a column named {taken}")
    size = len(model.languages)
    spark = docs.sparkSession
    kind = "struct<lang:string,posterior:double,text_lang:string,rejected:boolean>"
    if not size:
        return docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn(taken, F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_lang"), F.lit(True).alias("rejected")).cast(kind))
    score = _scorer(spark.sparkContext.broadcast(model), text_of)
    none = F.lit(None).cast("string")
    clean = lambda c: F.nullif(F.lower(F.trim(c.cast("string"))), F.lit("")) if c is not None else none
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    said = F.regexp_extract(clean(declared), _PRIMARY, 0) if declared is not None else none
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], said.alias("said"), clean(host).alias("host"))
    parts = F.split("host", r"\.")
    rows = rows.withColumn("suffix", F.when(F.size(parts) > 1, F.element_at(parts, -1))).withColumn("domain", F.when(F.size(parts) > 1, F.concat_ws(".", F.slice(parts, -2, 2))).otherwise(F.col("host")))
    rows = rows.withColumn("e", score(F.col(names[text_col])))
    # The text's own language counts for the row's host and declaration, if the text is known at all.
    scaled = F.transform("e.logs", lambda x: x * (F.least(F.lit(1.0), F.lit(WORTH) / F.greatest(F.col("e.grams"), F.lit(1))) / _UNIT))
    fits = (F.col("e.grams") > 0) & (F.col("e.known") >= F.col("e.grams") * LEAST_KNOWN)
    rows = rows.withColumn("text_logs", scaled).withColumn("own", F.when(fits, F.array_position("e.logs", F.array_max("e.logs")) - 1))
    if text_col in keep:
        marks = stored(rows.select("said", "suffix", "domain", "host", "own"), "languages")
    else:
        rows = marks = stored(rows.select(*[names[c] for c in keep], "said", "suffix", "domain", "host", "own", "e", "text_logs", fits.alias("fits")), "languages")
        fits = F.col("fits")

    def rates(n: str, parent: Column, smooth: float) -> Column:
        return F.transform(_vector(n, size), lambda x, i: x + F.lit(smooth) * F.get(parent, i))

    total = marks.agg(*_counts(model.languages)).first()
    base = [(c + 1) / (sum(total) + size) for c in total]
    lean = F.array(*[sum([F.when(F.col("suffix").isin([s for s, lang in _SUFFIX.items() if lang == x] or [""]), _SUFFIX_COUNT).otherwise(0.0)], F.lit(0.0)) + SMOOTH * b for x, b in zip(model.languages, base)])
    norm = lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y))
    known = marks.where("host is not null")
    suffixes = known.groupBy("suffix").agg(*_counts(model.languages)).select("suffix", norm(F.transform(_vector("n", size), lambda x, i: x + F.get(lean, i))).alias("p_suffix"))
    domains = known.groupBy("suffix", "domain").agg(*_counts(model.languages))
    domains = domains.join(suffixes, domains["suffix"].eqNullSafe(suffixes["suffix"])).select("domain", norm(rates("n", F.col("p_suffix"), SMOOTH)).alias("p_domain"))
    hosts = known.groupBy("domain", "host").agg(*_counts(model.languages)).join(domains, "domain")
    # Counts of the host with the domain's pseudo-counts; the row's own count comes off below.
    hosts = stored(hosts.select("host", rates("n", F.col("p_domain"), SMOOTH).alias("weight")), "host-priors")
    told = marks.where("said is not null and said <> ''").groupBy("said").agg(*_counts(model.languages))
    n_said = marks.where("said is not null and said <> ''").agg(*_counts(model.languages)).first()
    told = told.withColumn("base", (sum(F.col(f"n{i}") for i in range(size)) + 1.0) / float(sum(n_said) + 1))
    told = stored(told.select("said", F.array(*[(F.col(f"n{i}") + SMOOTH_DECLARED * F.col("base")) / float(n_said[i] + SMOOTH_DECLARED) for i in range(size)]).alias("p_said")), "declarations")

    both = rows.join(hosts, "host", "left").join(told, "said", "left")
    flat = F.array(*map(F.lit, base))
    off = lambda i: F.when(F.col("own") == i, 1.0).otherwise(0.0)
    prior = F.when(F.col("weight").isNotNull(), F.transform("weight", lambda x, i: F.greatest(x - off(i), F.lit(1e-6)))).otherwise(flat)
    evidence = F.transform("text_logs", lambda x, i: x + F.log(F.get(F.col("prior"), i)) + F.coalesce(F.log(F.get("p_said", i)), F.lit(0.0)))
    both = both.withColumn("prior", prior).withColumn("sums", evidence).withColumn("top", F.array_max("sums"))
    posterior = 1 / F.aggregate("sums", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    both = both.withColumn("posterior", posterior)
    lang = F.get(F.array(*map(F.lit, model.languages)), (F.array_position("sums", F.col("top")) - 1).cast("int"))
    rejected = ~fits | (F.col("posterior") < LEAST_POSTERIOR)
    found = F.struct(F.when(rejected, F.lit(UNKNOWN)).otherwise(lang).alias("lang"), F.round("posterior", 6).alias("posterior"), F.get(F.array(*map(F.lit, model.languages)), F.col("own").cast("int")).alias("text_lang"), rejected.alias("rejected"))
    return both.select(*[F.col(names[c]).alias(c) for c in keep], found.alias(taken))


_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z-]+)", re.I)


def declared_language(html: str) -> Column:
    """The language that a page's html element declares; null where there is none."""
    return F.nullif(F.regexp_extract(F.col(html), "(?i)" + _LANG.pattern, 1), F.lit(""))
