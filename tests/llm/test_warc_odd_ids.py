"""Archives of pages with extreme ids and of URLs with escaped and real line ends."""

from pyspark.sql import functions as F

from hygeia.llm import warc

ODD = [(2**62, "http://a.org/x?q=a%0Ab%0D"), (10**12, "http://a.org/%25"), (-5, "http://a.org/r\nq"), (-(2**63), "http://a.org/\r\n%0A"),
       (2**63 - 1, ""), (3, "http://a.org/x?q=a%0Ab%0D"), (None, None)]


def test_round_trip(spark):
    rows = [(i, u, f"<p>{k}</p>") for k, (i, u) in enumerate(ODD)]
    out = warc.archive_round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted(((r.page_id is None, r.page_id or 0, r.url) for r in out), key=str) == sorted(((i is None, i or 0, u) for i, u in ODD), key=str)
    assert all(len(r.timestamp) == 14 and r.intact for r in out)


def test_order_of_negative_ids(spark):
    rows = [(i * warc.SPAN, "http://a.org/", "x") for i in (3, -2, 0, -1, 2)]  # all of one second
    out = (warc.archive_round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
           .orderBy("part", "history").select((F.col("page_id") / warc.SPAN).cast("int").alias("i")).collect())
    assert [r.i for r in out] == [-2, -1, 0, 2, 3]
