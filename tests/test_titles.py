"""Titles that end within a reference."""

from verisift.sources import html


def test_titles_that_end_within_a_reference(spark):
    page = '<html lang="en"><head><title>a&amp;&amp</title></head><body><p>x&ampy</p><a href="/?a=1&amp;b=2">z</a></body></html>'
    pages = spark.createDataFrame([(1, "http://e.com/", page), (2, "http://e.com/", page.replace("&amp;&amp<", "b &lt;c&gt; & d &amp;amp; &quot<"))], "page_id int, url string, html string")
    got = {r["page_id"]: r for r in html.extract_documents(pages, ["page_id"], closed=True).collect()}
    assert (got[1]["title"], got[2]["title"]) == ("a&&amp", "ab <c> & d &amp; &quot")
    assert got[1]["main_text"] == "x&y" and got[1]["links"] == ["http://e.com/?a=1&b=2"]
    assert html.extract_documents(pages.filter("page_id = 1"), ["page_id"]).first()["title"] == "a&&"
