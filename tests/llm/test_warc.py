import hashlib
from collections import Counter

from pitbars.llm import warc
from pitbars.llm.common import Workspace

PAGE = (
    '<!DOCTYPE html><html lang="en"><head><title>A &amp; B</title><style>p{}</style><script>if (a<b) x("</p>");</script></head>'
    '<body><!-- no --><p>One  <b>two</b><br>three &#233; &lt;tag&gt;</p><a class="x" href="/there?a=1">link</a></body></html>'
)
ROWS = [
    (1, "http://a.example/1", PAGE, "x"), (2, "http://a.example/2", None, "x"), (3, None, "", "x"), (None, None, "plain", "x"),
    (5, "http://a.example/5", "<p>" + "word " * 50000 + "<!-- open", "x"), (5, "http://a.example/5", "<p>twice", "x"),
    (6, "http://a.example/6", "<a" * 20000, "x"),
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, block string")


def test_derivatives_are_linked(spark):
    source = warc.responses(pages(spark, ROWS))
    got = warc.derive(source).collect()
    assert Counter(r["warc_type"] for r in got) == {"metadata": len(ROWS), "conversion": len(ROWS)}
    ids = {r["record_id"]: r for r in source.collect()}
    for r in got:
        s = ids[r["refers_to"]]
        assert (r["target_uri"], r["date"]) == (s["target_uri"], s["date"])
        assert r["content_length"] == len(r["block"].encode())
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()
    one = {r["warc_type"]: r for r in got if r["source_key"] == 1}
    assert one["conversion"]["block"] == "One two\nthree é <tag>\nlink"
    assert one["metadata"]["concurrent_to"] == one["conversion"]["record_id"]
    assert one["metadata"]["source_payload_digest"] == "sha256:" + hashlib.sha256(PAGE.encode()).hexdigest()
    assert one["metadata"]["block"].startswith("title: A & B\r\nlanguage: en\r\noutlink: /there?a=1\r\nsource-http-header: HTTP/1.1 200 OK\r\n")
    assert {r["block"] for r in got if r["warc_type"] == "conversion" and r["source_key"] in (2, 3)} == {""}
    assert warc.derive(warc.responses(pages(spark, []))).collect() == []


def test_files_round_trip(spark):
    path = Workspace(spark, "test").path("warc")
    source = warc.responses(pages(spark, ROWS))
    both = source.select(*[c.split()[0] for c in warc.RECORD.split(", ")]).union(warc.derive(source).drop("source_key"))
    warc.write_warc(both, path, records_per_file=3)
    assert Counter(warc.read_warc(spark, path).collect()) == Counter(both.collect())


def test_open_heads_and_all_forms_of_attributes(spark):
    cases = {
        "<html lang=de><head><title>T</title><meta charset=utf-8><body><header>Top</header><p>one": ("de", [], "Top\none"),
        "<html lang='fr'><head><title>T</title><link rel=x><p>two<a href='/b?x=1' >l</a> <a class=c href=/c>m</a>": ("fr", ["/b?x=1", "/c"], "two\nl m".replace("\n", "")),
        "<head><title>T</title>text of it<p>three": ("", [], "text of it\nthree"),
        '<head><noscript><img src="x"></noscript><title>T</title></head><p>four<A HREF = "/d" title="see href=no">n</A>': ("", ["/d"], "fourn"),
        "<head><title>T": ("", [], ""),
    }
    got = warc.derive(warc.responses(pages(spark, [(k, "u", page, "x") for k, page in enumerate(cases)]))).collect()
    for k, (lang, links, text) in enumerate(cases.values()):
        one = {r["warc_type"]: r["block"] for r in got if r["source_key"] == k}
        fields = [x.split(": ", 1) for x in one["metadata"].split("\r\n") if x]
        assert one["conversion"] == text
        assert [v for n, v in fields if n == "outlink"] == links and ["language", lang] in fields and ["title", "T"] in fields
