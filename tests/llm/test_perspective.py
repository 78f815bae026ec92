"""Perspective rotation against a plain rendering."""

from millrace.llm import perspective


def _brute(rows, part=256):
    turns = [(c, t, r or "unknown", x or "") for c, t, r, x in rows]
    out = []
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is None, t[1] or 0, t[2], t[3].encode()))
        for speaker in {t[2] for t in own} - {"system"}:
            parts = {}
            for _, turn, role, text in own:
                text, spans = text.replace("<|", "< |"), parts.setdefault(None if turn is None else turn // part, ["", [], 0])
                spans[2] += 1
                head = "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == speaker else f"<|user name={role.replace('<|', '< |')}|>\n"
                at = len(spans[0]) + len(head)
                spans[0] += head + text + "<|end|>\n"
                if role == speaker:
                    spans[1].append((at, at + len(text) + 7))
            out += [(conv, speaker, p, n, text, tuple(s)) for p, (text, s, n) in parts.items()]
    return sorted(out, key=str)


def _got(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, speaker string, part int")
    return perspective.perspectives(df, **more)


def _plain(df):
    return sorted(((r.conv_id, r.speaker, r.part, r.n_turns, r.rendered, tuple((s.start, s.end) for s in r.spans)) for r in df.collect()), key=str)


ROWS = [
    (1, 0, "system", "be <|end|> nice"), (1, 1, "ann", "héllo 👋"), (1, 2, "bob", "hi"), (1, 3, "ann", None), (1, 3, "cyd", "tie"), (1, 2, "bob", "hi"),
    (2, 5, None, "who"), (2, 4, "a<|b", "x"), (2, None, "ann", "late"), (2, -1, "ann", "early"), (3, 0, "system", "alone"),
    (None, 0, "ann", "no id"), (None, 1, "bob", ""), (4, 0, "ann", "y" * 100_000),
]


def test_views(spark):
    got = _got(spark, ROWS)
    assert _plain(got) == _brute(ROWS)
    for r in got.collect():
        assert all(r.rendered[s.start : s.end].endswith("<|end|>") for s in r.spans)
    assert _got(spark, []).count() == 0


def test_long_dialogues_come_in_parts(spark):
    rows = [(1, i, ("ann", "bob", "cyd")[i % 3], f"t{i}") for i in range(100)]
    assert _plain(_got(spark, rows, part=16)) == _brute(rows, 16)


def test_overfull_intervals_are_dealt_out(spark):
    rows = [(1, None, "ann", f"t{i}") for i in range(90)] + [(1, 3, "bob", f"b{i}") for i in range(40)]
    got = _got(spark, rows, part=16).where("speaker = 'ann'").collect()
    assert sum(r.n_turns for r in got) == 130 and max(r.n_turns for r in got) < 40
    assert len({(r.part, r.slot) for r in got}) == len(got) > 5
    assert sum(len(r.spans) for r in got) == 90


def test_copies_of_a_turn_stay_and_are_dealt_out(spark):
    rows = [(1, 1, "ann", "same")] * 100 + [(1, 2, "bob", "b")]
    got = _got(spark, rows, part=16).where("speaker = 'ann'").collect()
    assert sum(r.n_turns for r in got) == 101 and max(r.n_turns for r in got) < 40
    assert sum(len(r.spans) for r in got) == 100
