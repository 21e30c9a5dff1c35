"""Whole jobs against brute force."""

import pandas as pd

from folio.plans import catalogue, custom
from test_catalogue import DIR


def table(name):
    return pd.read_parquet(f"{DIR}/{name}.parquet")


def test_long_line_windows(spark):
    texts = [(1, "é\U0001f600\n" * 2000, None), (2, "", 0), (3, None, None), (4, "x" * 120, 120), (5, "y" * 121, 7), (6, "z" * 200_000, 1)]
    got = catalogue.line_windows(spark.createDataFrame(texts, "doc_id long, text string, n_chars long")).collect()
    want = [(i, s, min(s + 200, len(t)), t[s : s + 200]) for i, t, _ in texts for s in range(0, len(t or ""), 120)]
    assert sorted(map(tuple, got)) == want
    got = custom.txt_long_line_windows_all(spark, DIR).collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, s, min(s + 200, len(r.text)), r.text[s : s + 200]) for r in table("documents").itertuples() for s in range(0, len(r.text), 120))


def test_ordered_dedup(spark):
    got = custom.set_ordered_dedup_all(spark, DIR).collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, " ".join(dict.fromkeys(r.text.split(" ")))) for r in table("documents").itertuples())


def test_positional_zip(spark):
    want, uneven = [], 0
    for key, own in table("lineitem").sort_values(["l_linenumber", "l_partkey", "l_quantity"]).groupby("l_orderkey"):
        q, p = list(own.l_quantity), [r.l_partkey for r in own.itertuples() if r.l_linenumber % 6 and round(r.l_tax, 6) <= 0.07]
        uneven += len(q) != len(p)
        want += [(key, i + 1, a, b) for i, (a, b) in enumerate(zip(q, p, strict=False))]
    assert uneven and sorted(map(tuple, custom.jn_positional_zip_all(spark, DIR).collect())) == sorted(want)
