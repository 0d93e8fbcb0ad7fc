"""HTML extraction, the ARC to WARC converter and URL verdicts."""

import base64
import gzip
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tablewright.llm import arc_to_warc as w, html_blocks as h, url_logistic as u

LONG = "A sentence of the article that is long enough to be dense on its own, well beyond the limit of the window."
PAGES = [
    ("<html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>'</script></head><body><nav><a href=x>Menu</a></nav><header>Site</header>"
     "<article><h1>Title</h1><p>One &amp; two<br>three&nbsp;four<p>Five <b>bo</b>ld<aside>no</aside><p>six</article><footer>no</footer>", "Title\nOne & two three four\nFive bold\nsix"),
    ("<!-- <article>no</article> --><div class='cookie-notice'>no</div><main><p>yes</p><form><p>no</p></form><div id=comments><article>no</article></div><p>end</p></main>", "yes\nend"),
    ("<div class=ad>never closed<article><p>text</p></article>", "text"),
    (f"<div class='menu'><ul><li><a href=1>a</a></ul></div><div class=text><p>{LONG}</p><p>short</p></div><div class='sidebar'>{LONG}</div>", f"{LONG}\nshort"),
    ("just text", "just text"), ("", ""), (None, ""), ("<p", "<p"), ("<article><p>cut off in the mid", "cut off in the mid"),
    ("<article><p hidden>no</p><p style='display: none'>no</p><p>1 &lt;b&gt; 2</p><script>never closed <p>no", "1 <b> 2"),
    ("<article><header><h1>Head</h1></header><p class=\"ad-box\">no<p>yes</article>", "Head\nyes"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert h.main_text(page) == text


def test_bodies():
    assert h.bodies([0, 0, 0, 5, 0, 0, 7, 0, 0, 0, 0, 3], 3) == [(1, 7, 7), (9, 12, 3)]
    assert h.bodies([], 3) == []


def test_hostile_markup_is_quick():
    for page in ("<a" * 100_000, "<!--" * 50_000, "<div>" * 50_000, "<p \"" * 50_000, "<article>" + "x " * 500_000):
        h.main_text(page)


def test_extract(spark):
    df = spark.createDataFrame([(i, None if i == 2 else f"http://e/{i}", page, "x") for i, (page, _) in enumerate(PAGES)] + [(None, None, None, None), (0, "http://e/0", PAGES[0][0], "x")],
                               "page_id bigint, url string, html string, text string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in h.extract(df).collect()}
    assert got[None, None] == ("", 0)
    for i, (_, text) in enumerate(PAGES):
        assert got[i, None if i == 2 else f"http://e/{i}"] == (text, len(text))
    assert h.extract(df).count() == len(PAGES) + 2 and h.extract(df.limit(0)).count() == 0


# ---------------------------------------------------------------- archives

def test_arc_versions_round_trip():
    for version in (1, 2):
        bodies = [b"", b"abc\n\nhttp://x 1.2.3.4 5", "é\r\n\r\n".encode(), bytes(range(256))]
        data = w.arc_head(version, "a.arc") + b"".join(w.arc_record(version, f"http://e/{i}", "20200102030405", "text/html; charset=x", b) for i, b in enumerate(bodies))
        got = list(w.read_arc(data))
        assert [g[2] for g in got] == bodies and {g[0] for g in got} == {version}
        assert got[1][1]["url"] == "http://e/1" and got[1][1]["date"] == "20200102030405"


def test_broken_arcs_say_where(spark):
    good = w.arc_head(1, "a.arc") + w.arc_record(1, "dns:e", "20200102030405", "text/dns", b"e. A 1.2.3.4")
    cases = {"cut": good[:-5], "line": good + b"not a header\n", "none": b"", "plain": good}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [("null", None)], "path string, content binary")
    rows = w.convert_arc(df).collect()
    assert sorted(r.error.split(":")[0] for r in rows if r.error) == ["cut", "line"]
    kept = [r for r in rows if not r.error]
    assert len(kept) == 2 and {(r.record_type, r.date, bytes(r.payload)) for r in kept} == {("resource", "2020-01-02T03:04:05Z", b"e. A 1.2.3.4")}


ROWS = [(5, "http://e/5", "same"), (3, "http://e/3 x", "same"), (9, None, "same"), (1, "http://e/1", None), (2, "http://e/2", ""), (4, "http://e/4", "WARC/1.1\r\n\r\nfake\r\n\r\n\r\n\r\n é 日"),
        (7, "http://e/7", "twice"), (7, "http://e/7", "twice"), (None, "http://e/n", "same"), (None, "http://e/n", "only null"), (6, "http://e/6", "x" * 300_000)]


def test_archive_pages(spark, tmp_path):
    df = spark.createDataFrame([(*r, "extra") for r in ROWS], "page_id bigint, url string, html string, record_type string").repartition(3)
    path = str(tmp_path / "warc")
    got = w.archive_pages(df, path).collect()
    assert len(got) == len(ROWS)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = sorted([(5, 4, "same", "revisit", 3), (3, 4, "same", "response", None), (9, 4, "same", "revisit", 3), (1, 0, "", "response", None), (2, 0, "", "revisit", 1),
                   (4, len(ROWS[5][2].encode()), ROWS[5][2], "response", None), (7, 5, "twice", "response", None), (7, 5, "twice", "revisit", 7),
                   (None, 4, "same", "revisit", 3), (None, 9, "only null", "response", None), (6, 300_000, ROWS[10][2], "response", None)], key=str)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted([(a, b, digest(c), d, e) for a, b, c, d, e in want], key=str)
    # Any WARC reader can follow the files: version line, fields, declared length, two line ends.
    seen = 0
    for file in (tmp_path / "warc").glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
            length = int(re.search(rb"Content-Length: (\d+)$", head)[1])
            assert rest[length:length + 4] == b"\r\n\r\n"
            data, seen = rest[length + 4:], seen + 1
    assert seen == len(ROWS)


def test_bytes_survive_the_writer(spark, tmp_path):
    data = w.arc_head(2, "b.arc") + w.arc_record(2, "http://e/b", "20200102030405", "application/octet-stream", bytes(range(256)) * 3)
    records = w.convert_arc(spark.createDataFrame([("b.arc", data)], "path string, content binary"))
    w.write_warc(records.withColumns({"again": F.lit(False), "refers_to": F.lit(None).cast("string")}), str(tmp_path / "b"))
    assert [(r.record_type, r.payload_bytes) for r in w.read_archives(spark, str(tmp_path / "b")).collect()] == [("resource", 768)]


def test_no_pages(spark, tmp_path):
    assert w.archive_pages(spark.createDataFrame([], "page_id bigint, url string, html string"), str(tmp_path / "none")).count() == 0


# ---------------------------------------------------------------- URLs

URLS = [("http://WWW.Example.COM/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"), ("https://blog.example.com/en/", "blog.example.com", "/en/", "example.com/en/", "block"),
        ("http://a.net/fr/1", "a.net", "/fr/1", "net/fr/", "block"), ("http://net/es/", "net", "/es/", "net/es/", "block"), ("ftp://com/", "com", "/", "com/", "allow"),
        ("http://a.com", "a.com", "", None, None), ("http://xnet/es/", "xnet", "/es/", None, None), ("http://b.example.com?x=/en/", "b.example.com", "", None, None),
        ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("http://", "", "", None, None), ("x://É.Org/A://b\n/c", "É.org", "/A://b\n/c", None, None),
        ("http://www.example.com/EN/", "www.example.com", "/EN/", "com/", "allow"), ("http://h.org/" + "p" * 20000, "h.org", "/" + "p" * 20000, None, None)]


@pytest.fixture(scope="module")
def model(spark):
    return u.fit_urls(u.labelled_urls(spark))


def test_url_rules(spark, model):
    df = spark.createDataFrame([(i, r[0], "x") for i, r in enumerate(URLS)], "page_id bigint, url string, host string")
    for r in u.judge_urls(df, model).collect():
        _, host, path, rule, verdict = URLS[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert u.judge_urls(df.limit(0), model).count() == 0


def test_regression_learns_the_table(spark, model):
    table = u.labelled_urls(spark).withColumnsRenamed({"label": "page_id"})
    got = u.judge_urls(table, model, rules=()).collect()
    assert sum((r.score >= 0.5) == (r.page_id == 1) for r in got) >= 0.98 * len(got)
    fresh = [("http://m.casino-bonus.example.org/fr/3", 1), ("http://cheap-watches.example.com/x", 1), ("http://www.ththon.example.org/en/4", 0), ("https://geology.example.net/en/rocks", 0)]
    scores = u.judge_urls(spark.createDataFrame(fresh, "url string, page_id int"), model, rules=()).collect()
    assert all((r.score >= 0.5) == (r.page_id == 1) for r in scores)


def test_fit_skips_nulls(spark):
    rows = u.labelled_table()[::6] + u.labelled_table()[1::6] + [(None, 1), ("http://x.org/", None)]
    assert u.fit_urls(spark.createDataFrame(rows, "url string, label int")).numFeatures == u.FEATURES


def test_text_outside_small_article_markers_is_kept():
    from tablewright.llm.html_blocks import main_text

    body = [f"Paragraph {i} of the real story says a good deal more than any teaser on this page does, and goes on." for i in range(6)]
    page = ("<body><div>" + "".join(f"<div>{t}</div>" for t in body) + "</div>"
            '<article class="card">Another story</article><article class="card">One more</article></body>')
    assert main_text(page).split("\n") == body
    # A marked article that outweighs the rest stays whole, short lines included.
    assert main_text("<div>" + body[0] + "</div><article><h1>Hi</h1>" + "".join(f"<p>{t}" for t in body[1:]) + "</article>").split("\n") == ["Hi", *body[1:]]
