"""Column functions over text: hashing to splits, words, rendering and the normal forms that joins use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The share of a split hash is its first 32 bits over the largest 32-bit number.
HASH_TOP = 4294967295.0
#: Upper ends of the length buckets, and the half-open strata of token counts.
BUCKETS = [(2048, "<=2k"), (4096, "2-4k"), (8192, "4-8k"), (16384, "8-16k"), (10**9, ">16k")]
STRATA = [("0-4k", 0, 4000), ("4-8k", 4000, 8000), ("8-12k", 8000, 12000), ("12-16k", 12000, 16000)]

_NOT_WORD = r"[^\p{L}\p{N}]+"
_SPACE = r"(?U)\s+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_share(key: Column | str) -> Column:
    """A number in [0, 1] that depends on the key alone, so a split never depends on order or neighbours."""
    return F.conv(F.substring(F.sha1(_col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / HASH_TOP


def is_validation(key: Column | str, fraction: float = 0.02) -> Column:
    return hash_share(key) < fraction


def stable_seed(*parts: Column | str) -> Column:
    """An integer seed from parts joined by a bar."""
    return F.conv(F.substring(F.sha1(F.concat_ws("|", *[_col(p).cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def words(text: Column | str) -> Column:
    """The runs of text between white space; null text has none."""
    return F.filter(F.split(F.coalesce(_col(text), F.lit("")), _SPACE), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def render_turn(role: Column | str, said: Column | str) -> Column:
    return F.concat(_col(role), F.lit(": "), _col(said))


def role_of(line: Column | str) -> Column:
    """What stands before the first ": " of a line; the whole line where there is none."""
    return F.when(F.instr(_col(line), ": ") > 0, F.substring_index(_col(line), ": ", 1)).otherwise(_col(line))


def said_of(line: Column | str) -> Column:
    """What follows the first ": " of a line; empty where there is none."""
    line = _col(line)
    return F.when(F.instr(line, ": ") > 0, F.substring(line, F.instr(line, ": ") + 2, F.length(line))).otherwise(F.lit(""))


def numbered(lines: Column | str, style: str = "colon") -> Column:
    """Lines with their numbers from one: "1: line", or "1. role:said" in the dotted style."""
    if style == "colon":
        return F.transform(_col(lines), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x))
    return F.transform(_col(lines), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), role_of(x), F.lit(":"), said_of(x)))


def collapse_space(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), _SPACE, " "))


def without_change_marks(text: Column | str) -> Column:
    """Text without the ">>" marks that open a new speaker's caption."""
    return F.regexp_replace(_col(text), r"^(>>\s*)+", "")


def without_non_speech(text: Column | str) -> Column:
    """Text without short bracketed notes such as [Applause] or (coughs), white space made single.

    A note is closed by the bracket that belongs to the one that opens it, and has 1 to 40 characters, no bracket among them.
    """
    inside = r"[^\[\]()]{1,40}"
    return collapse_space(F.regexp_replace(_col(text), rf"\({inside}\)|\[{inside}\]", " "))


def surface(text: Column | str) -> Column:
    """Recogniser output as written: it ends in a mark, the word i is large, and so is the first letter."""
    closed = F.regexp_replace(F.trim(_col(text)), r"(?<=[^.?!])\z", ".")
    return F.regexp_replace(F.overlay(closed, F.upper(F.left(closed, F.lit(1))), 1, 1), r"(?<![\p{L}\p{N}_])i(?![\p{L}\p{N}_])", "I")


def sentences(text: Column | str) -> Column:
    return F.split(_col(text), r"(?<=[.?!])\s+")


def placeholders(text: Column | str) -> Column:
    """How many [UPPER_CASE] placeholders a text has."""
    return F.regexp_count(_col(text), F.lit(r"\[[A-Z_]+\]"))


def normal_title(title: Column | str) -> Column:
    """Lower case with every run of other than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(title), F.lit(""))), _NOT_WORD, " "))


def normal_show(title: Column | str) -> Column:
    """A show's name: without a closing bracketed group, a leading "the" and a trailing "podcast"; never emptied by that."""
    low = F.rtrim(F.lower(F.coalesce(_col(title), F.lit(""))))
    tail = F.element_at(F.split(low, r"[(\[]"), -1)  # what follows the last opening bracket
    front = F.left(low, F.length(low) - F.length(tail) - 1)
    grouped = (F.length(tail) < F.length(low)) & tail.rlike(r"^[^)\]]*[)\]]$") & (F.trim(front) != "")
    words = F.filter(F.split(normal_title(F.when(grouped, front).otherwise(low)), " "), lambda w: w != "")
    # Every word that may go needs another one that stays.
    without = lambda ws, place, word: F.when((F.size(ws) > 1) & (F.element_at(ws, place) == word), F.slice(ws, 2 if place == 1 else 1, F.size(ws) - 1)).otherwise(ws)
    cut = without(words, -1, "podcast")
    return F.array_join(without(F.when(F.size(cut) < F.size(words), without(cut, -1, "the")).otherwise(words), 1, "the"), " ")


def normal_name(name: Column | str) -> Column:
    """A person's full name; a single word is too common to tell anyone and gives an empty name."""
    plain = normal_title(name)
    return F.when(F.instr(plain, " ") > 0, plain).otherwise(F.lit(""))


def normal_answer(answer: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(_col(answer))), r"[\s\-]+", "_")


def alignment_words(text: Column | str) -> Column:
    """Words as the aligner compares them: lower case, hesitations without brackets, no edge punctuation."""
    low = F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), r"\((\w+)\)", "$1")
    edge = r"^[^\p{L}\p{N}_']+|[^\p{L}\p{N}_']+$"
    return F.filter(F.transform(F.split(low, _SPACE), lambda w: F.regexp_replace(F.regexp_replace(w, "~+$", ""), edge, "")), lambda w: w != "")


def length_bucket(tokens: Column | str) -> Column:
    out = F.when(_col(tokens).isNull() | (_col(tokens) <= 0), "unknown")
    for top, name in BUCKETS:
        out = out.when(_col(tokens) <= top, name)
    return out


def stratum(tokens: Column | str) -> Column:
    """The stratum whose half-open interval holds the count; null outside all."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, low, high in STRATA:
        out = out.when((_col(tokens) >= low) & (_col(tokens) < high), name)
    return out


def shingles(text: Column | str, size: int = 8) -> Column:
    """Every run of ``size`` words of ASCII letters, digits and apostrophes, space-joined; fewer words give none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(r"[a-z0-9']+"), F.lit(0))
    # The words are bound by an outer transform, so that they are found once and not for each run.
    runs = F.transform(F.array(found), lambda ws: F.when(F.size(ws) >= size, F.transform(F.sequence(F.lit(1), F.size(ws) - size + 1), lambda i: F.array_join(F.slice(ws, i, size), " "))))
    return F.coalesce(F.get(runs, F.lit(0)), F.array().cast("array<string>"))


def passages(text: Column | str, size: int = 8, keep_one_in: int = 8) -> Column:
    """A fixed sample of a text's shingles as CRC-32 hashes: those divisible by ``keep_one_in``."""
    return F.array_distinct(F.filter(F.transform(shingles(text, size), F.crc32), lambda h: h % keep_one_in == 0))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared over all distinct elements; null if both are empty."""
    both = F.size(F.array_union(_col(a), _col(b)))
    return F.when(both > 0, F.size(F.array_intersect(_col(a), _col(b))) / both)


def blank_cited(lines: Column | str, cited: Column | str) -> Column:
    """Lines with the cited ones (numbers from one) emptied after their role."""
    return F.transform(_col(lines), lambda x, i: F.when(F.array_contains(_col(cited), i + 1), F.concat(role_of(x), F.lit(": "))).otherwise(x))


def keep_cited(lines: Column | str, cited: Column | str) -> Column:
    return F.filter(_col(lines), lambda x, i: F.array_contains(_col(cited), i + 1))


def third_of(line: Column | str, n_lines: Column | str) -> Column:
    """first, middle or last: the third of the lines that holds a line number."""
    third = F.least(F.lit(2), F.greatest(F.lit(0), F.floor((_col(line) - 1) * 3 / F.greatest(F.lit(1), _col(n_lines)))))
    return F.element_at(F.array(F.lit("first"), F.lit("middle"), F.lit("last")), (third + 1).cast("int"))


#: Prefixes of question ids in another dataset's wording, and the words that it swaps, in order.
_FAMILY_OF = (r"^tm-(\d\d-.*)$", "gen-$1"), (r"^tm-(vul|cmp|eod)-(.*)$", "$1-$2")
_SWAPS = ("agent's", "assistant's"), ("Agent's", "Assistant's"), ("agent", "assistant"), ("Agent", "Assistant"), ("customer's", "user's"), ("Customer's", "User's"), ("customer", "user"), ("Customer", "User"), ("call", "conversation")


def lineage(question: Column | str) -> Column:
    """The base question of a variant's id; any other id is its own base."""
    out = _col(question)
    for pattern, base in _FAMILY_OF:
        out = F.regexp_replace(out, pattern, base)
    return out


def swapped_words(text: Column | str) -> Column:
    """A question's text in the wording of written dialogues: whole words only, as they are spelt."""
    out = _col(text)
    for word, other in _SWAPS:
        out = F.regexp_replace(out, rf"\b{word}\b", other)
    return out


#: Words for nobody and connectives in a reply that names speakers.
NOBODY = ("none", "n/a", "null", "", "and", "-", "no", "host", "hosts", "guest", "guests")


def named_tags(reply: Column | str) -> Column:
    """The names in a free reply: no bracketed remarks, cut at commas, semicolons and space, no quotes or stops around."""
    plain = F.regexp_replace(F.coalesce(_col(reply), F.lit("")), r"\s*\([^)]*\)", "")
    return F.filter(F.transform(F.split(plain, r"[,;\s]+"), lambda x: F.regexp_replace(x, "^[\"'.]+|[\"'.]+$", "")), lambda x: x != "")


def matched_tags(reply: Column | str, tags: Column | str) -> Column:
    """Those of ``tags`` that the reply names in any case, ascending."""
    low = F.transform(named_tags(reply), F.lower)
    return F.array_sort(F.array_distinct(F.filter(_col(tags), lambda t: F.array_contains(low, F.lower(t)))))


def unmatched_tags(reply: Column | str, tags: Column | str) -> Column:
    """Named tags that are none of ``tags``, except words for nobody: such a reply is to be refused."""
    low = F.transform(_col(tags), F.lower)
    return F.filter(named_tags(reply), lambda x: ~F.array_contains(low, F.lower(x)) & ~F.lower(x).isin(*NOBODY))


def line_numbers(raw: Column | str, n_lines: Column | str) -> tuple[Column, Column]:
    """(evidence, dropped) of a JSON list by the coercing rule: whole numbers, also as digits in quotes, within the lines.

    The numbers come ascending and once each; dropped counts entries that are no number or outside. Truth values
    are no numbers. Text that is no JSON list gives null for both.
    """
    items = F.from_json(_col(raw), "array<variant>")
    value = lambda v: F.variant_get(v, "$", "string")
    kind = lambda v: F.schema_of_variant(v)
    whole = lambda v: F.when(kind(v) == "BIGINT", True).when(kind(v) == "STRING", value(v).rlike(r"^\s*\d+\s*$")).when(kind(v).rlike("^(DECIMAL|DOUBLE|FLOAT)"), value(v).cast("double") == F.floor(value(v).cast("double"))).otherwise(False)
    number = lambda v: F.when(F.coalesce(whole(v), F.lit(False)), F.trim(value(v)).cast("double").cast("long"))
    good = F.filter(F.transform(items, number), lambda e: e.isNotNull() & (e >= 1) & (e <= _col(n_lines)))
    return F.array_sort(F.array_distinct(good)), F.size(items) - F.size(good)
