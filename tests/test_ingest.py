import time

from pyspark.sql import functions as F

from quarry.functions import files as ff
from quarry.operators import chunking, ingest


def test_markup_with_omitted_end_tags():
    get = ingest._html_elements
    assert get("<html><head><title>T</title><body><h1>One</h1><p>two<p>three</html>") == [("Title", "One"), ("NarrativeText", "two"), ("NarrativeText", "three")]
    assert get("<head><meta charset=x><p>open head</p>") == [("NarrativeText", "open head")]
    assert get("<table><tr><td>A<td>B<tr><th>C</table>x") == [("Table", "A | B\nC"), ("NarrativeText", "x")]
    assert get("<table><tr><td>a<table><tr><td>in</td><td>ner</td></tr></table>b</td><td>c</td></tr></table>") == [("Table", "a in | ner b | c")]
    assert get("<ul><li>one<li>two</ul><script>no</script><style>no</style>after") == [("ListItem", "one"), ("ListItem", "two"), ("NarrativeText", "after")]
    assert get("<table><tr><td>never closed") == [("Table", "never closed")]
    assert get("") == [] and get(None) == [] and get("plain &amp; text") == [("NarrativeText", "plain & text")]


def test_csv_becomes_a_table():
    assert ingest._pipe_table('a,b\n\n1,"x|y\nz",3\n2\n') == "| a | b |\n| --- | --- |\n| 1 | x\\|y z |\n| 2 |  |"
    assert ingest._pipe_table("\n , \n") == ""


def test_every_file_gives_elements_or_a_reject(spark):
    rows = [(1, "a.txt", b"text", 4), (2, "b.csv", b"x,y\n1,2", 7), (3, "c.html", b"<p>hi", 5), (4, "d.pdf", b"%PDF", 4), (5, "e", b"", 0), (6, "f.md", b"m", 10**9), (7, "g.XLSX", b"", 1)]
    files = spark.createDataFrame(rows, "doc_id long, filename string, content binary, length long")
    got = {(r.doc_id, r.lane, r.type) for r in ingest.ingest_elements(files).collect()}
    assert got == {(1, "direct", "NarrativeText"), (2, "tabular", "Table"), (3, "markup", "NarrativeText")}
    left = {r.doc_id: r.reason for r in ingest.ingest_rejects(files).collect()}
    assert set(left) == {4, 5, 6, 7} and left[4] == "no local parser for .pdf" and "exceeds the 50 MB limit" in left[6]


def test_long_elements_are_cut_in_linear_time(spark):
    def took(n):
        el = spark.createDataFrame([(1, 0, "NarrativeText", "x" * n)], "doc_id long, pos int, type string, text string")
        at = time.time()
        r = chunking.chunk_documents(el).agg(F.count("*"), F.sum(F.length("text"))).first()
        assert (r[0], r[1]) == (-(-n // 2048), n)
        return time.time() - at

    took(10_000)
    assert took(8_000_000) < 20


def test_content_types(spark):
    names = ["a.txt", "a.tar.gz", "b.TGZ", "c.gz", "d.txt.gz", "e.HTML", "noext", "dir.x/f", ".hidden", "g.svgz"]
    rows = spark.createDataFrame([(n,) for n in names], "filename string")
    got = {r.filename: r.content_type for r in ff.with_content_type(rows).collect()}
    assert got == {"a.txt": "text/plain", "a.tar.gz": "application/x-tar", "b.TGZ": "application/x-tar", "c.gz": "application/octet-stream", "d.txt.gz": "text/plain",
                   "e.HTML": "text/html", "noext": "application/octet-stream", "dir.x/f": "application/octet-stream", ".hidden": "application/octet-stream", "g.svgz": "image/svg+xml"}


def test_heading_paths(spark):
    rows = [(1, "Title", "A", 1), (2, "Title", "B", 2), (3, "NarrativeText", "x", None), (4, "Title", "C", 3), (5, "Title", "D", 2), (6, "NarrativeText", "y", None),
            (7, "Title", "", 1), (8, "Title", "E", 4), (9, "NarrativeText", "z", None), (10, "Title", "F", None)]
    el = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, pos int, type string, text string, level int")
    got = {r.pos: r.section_title for r in chunking.section_path(el).collect()}
    assert (got[1], got[3], got[4], got[6], got[7], got[9], got[10]) == ("A", "A > B", "A > B > C", "A > D", None, "E", "F")
    assert chunking.section_path(el.drop("level")).where("pos = 6").first()["section_title"] == "D"
