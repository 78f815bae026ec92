"""The words of every turn reach the merged fragments."""

from millrace import catalog


def test_no_text_is_cut(spark, sf):
    rows = catalog.queries()["w3_whole_fragments"](spark, sf).collect()
    said = {}
    for r in rows:
        said[r.conv_id] = said.get(r.conv_id, "") + " " + r.said
    given = [r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect() if r.text and not set("[](") & set(r.text)]
    assert given and all(" ".join(r.text.split()) in said[r.conv_id] for r in given)
    assert not any("(laughs)" in r.said for r in rows)
