"""The pipeline's near-duplicate stage against brute force, with near copies of 0.8 to 0.97."""

import random

import corpus_pipeline
from millrace.llm import neardup


def _set(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)) if words}


def _similar(a, b):
    return len(a & b) / max(1, len(a | b))


def _rows():
    """Texts of 200 words and copies of each with up to three words changed."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(4000)}" for _ in range(200)]
        rows.append((len(rows), " ".join(words)))
        for changes in (1, 2, 3, 3) if i % 2 else ():
            copy = list(words)
            for at in rng.sample(range(10, 190), changes):
                copy[at] = f"x{rng.randrange(4000)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


def _groups(rows):
    """Least id of each row's component of similar texts, and the similar pairs."""
    sets = [_set(t) for _, t in rows]
    label, pairs = list(range(len(rows))), []
    for i in range(len(rows)):
        for j in range(i):
            if _similar(sets[i], sets[j]) >= 0.8:
                pairs.append((j, i))
    for _ in range(6):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return label, pairs, sets


def test_stage_drops_near_copies(spark):
    rows = _rows()
    label, pairs, sets = _groups(rows)
    assert {round(_similar(sets[i], sets[j]), 1) for i, j in pairs} >= {0.8, 0.9, 1.0}
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in corpus_pipeline.dedup(spark, docs, "").collect()}
    assert kept == {i for i, x in enumerate(label) if i == x}


def test_large_groups_are_compared_in_parts(spark):
    rows = _rows()[:100]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup._components(docs, "doc_id", "text", neardup.RADIUS, neardup.LEAST, part=2).collect()
    assert {r.id: r.component_id for r in got} == dict(enumerate(_groups(rows)[0]))


def test_recall_of_the_bk_tree_and_exact_check(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    sets = [neardup.shingles(t.encode()) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for h in s.tolist():
            holders.setdefault(h, []).append(i)
    meet = {(i, j) for x in holders.values() for i in x for j in x if i < j}
    pairs = [(i, j) for i, j in meet if neardup.node(sets[i]) != neardup.node(sets[j]) and neardup.jaccard(sets[i], sets[j]) >= 0.8]
    fps = [neardup.fingerprint(s) for s in sets]
    within = [((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= neardup.RADIUS for i, j in pairs]
    got = {r.id: r.component_id for r in neardup._components(docs, "doc_id", "text", neardup.RADIUS, neardup.LEAST).collect()}
    found = [got[rows[i][0]] == got[rows[j][0]] for i, j in pairs]
    print(f"pairs {len(pairs)}, within the radius {sum(within)}, linked {sum(found)}, documents {len(rows)}, kept {len(set(got.values()))}")
    assert pairs and sum(within) >= 0.9 * len(pairs) and sum(found) >= 0.9 * len(pairs)


def test_odd_inputs(spark):
    rows = [(1, None), (2, ""), (None, "a b c d e"), (5, "A b c d e"), (5, "q r s t u v"), (None, "lone words here now"), (None, "lone words here now")]
    kept = neardup.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([(1, None), (5, "A b c d e"), (5, "q r s t u v"), (None, "lone words here now")], key=str)
    assert neardup.keep_one_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0
