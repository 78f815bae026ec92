"""SimHash components against brute force, and the odd inputs."""

import random

import xxhash

from millrace.llm import simhash


def _brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words, word = [], ""
    for c in low:
        if c in " \t\n\v\f\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    words += [word] * bool(word)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def _brute(rows, radius):
    fps = [_brute_fp(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[top(i)] = top(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(k)
    least = {g: min((k for k in ids if k is not None), default=None) for g, ids in groups.items()}
    return sorted(((k, f"{fps[i]:016x}", least[top(i)]) for i, (k, _) in enumerate(rows)), key=str)


def _rows(n, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "ßX", "Q"]
    base = [" ".join(rng.choices(words, k=rng.randint(0, 90))) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        t = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            if t:
                t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(t)))
    return rows


def _run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.simhash_components(df, **more)
    return sorted(((r[0], r[1], r[2]) for r in got.select("doc_id", simhash.fingerprint_hex(), "component_id").collect()), key=str)


def test_components_equal_brute_force(spark):
    rows = _rows(400)
    got = _run(spark, rows)
    assert got == _brute(rows, 2)
    assert len({x[2] for x in got}) < len({x[1] for x in got})


def test_other_radius(spark):
    rows = _rows(150, 3)
    for radius in (0, 5):
        assert _run(spark, rows, radius=radius) == _brute(rows, radius)


def test_large_buckets_are_split_without_loss(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = set()
    while len(fps) < 300:
        x = centre
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    df = spark.createDataFrame(signed, "fp long")
    from millrace.operators.components import components

    def parts(**k):
        return sorted((r.node, r.root) for r in components(simhash.links(df, 2, **k)).collect())

    assert parts() == parts(tree_rows=16, slice_rows=25)
    lab = {x: x for (x,) in signed}
    for _ in range(12):
        for a in lab:
            lab[a] = min(lab[b] for b in lab if ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    sizes = {}
    for a in lab.values():
        sizes[a] = sizes.get(a, 0) + 1
    assert parts() == sorted((a, r) for a, r in lab.items() if sizes[r] > 1)


def test_odd_inputs(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (5, "q r s t u v"), (None, "lone words here now"), (9, "x" * 200_000), (10, "One Two"), (11, "one\ttwo")]
    assert _run(spark, rows) == _brute(rows, 2)
    assert _run(spark, []) == []


def test_clashing_columns_and_one_row_each(spark):
    rows = [(1, "a b c d e", "x", 1, 2), (2, "A B C D E", "y", 3, 4), (2, "other words in here", "z", 5, 6), (None, "lone words here now", "n", 7, 8), (None, "lone words here now", "n", 7, 8), (None, "more lone words altogether", "n", 9, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int, root int")
    kept = simhash.keep_one_each(df)
    assert kept.columns == df.columns
    got = sorted((tuple(r) for r in kept.collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[3], rows[5]], key=str)
    assert simhash.keep_one_each(df.where("false")).count() == 0
