"""Shares of report lines at halves."""

from vacantia.sources import boards


def test_shares_are_rounded_as_their_binary_values(spark):
    rows = [("a", "active", 48, 0.5625, 56.25), ("b", "active", 16, 0.1875, 18.75), ("c", "active", 2000, 0.0035, 0.35), ("d", "active", 0, 1.0, 100.0), ("e", "active", 1, 12.345, 1234.5)]
    df = spark.createDataFrame(rows, "name string, status string, postings int, parse_yield double, share double")
    want = ["%-32s %-12s %8d %6.1f%%" % (n, s, k, share) for n, s, k, _, share in rows]
    assert [r["line"] for r in boards.report_lines(df).collect()] == want
    assert [r["line"] for r in boards.report_lines(df.drop("share").limit(2)).collect()] == want[:2]
