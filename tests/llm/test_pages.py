import gzip
import hashlib
import zlib
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pressroom.llm import arc, url_terms, wrappers
from pressroom.llm.queries import RULES
from pressroom.runtime import Scratch

PAGES = "page_id long, url string, html string, host string, rules string, record_id string, text string"
BIG = "<p>" + "long enough " * 200 + "</p>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a.com/x", BIG), (2, "http://a.com/y z", BIG), (3, "http://b.com/", BIG.replace("p", "b")), (4, None, None), (5, "", ""), (6, "http://a.com/x", "tiny"), (7, "http://c.com", "tiny"),
            (8, "http://d.com/ü", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\nfiledesc://x\n1 2 3\n"), (None, "http://e.com", BIG), (2, "http://a.com/y z", BIG)]
    return spark.createDataFrame([(*r, "h", "r", "x", "t") for r in rows], PAGES).repartition(3).cache()


def test_archive_round_trip(spark, pages):
    got = arc.convert_pages(pages).collect()
    rows = pages.collect()
    assert len(got) == len(rows)
    digest = {(r.page_id, hashlib.sha1((r.html or "").encode()).hexdigest(), len((r.html or "").encode())) for r in rows}
    assert {(r.page_id, r.payload_digest, r.payload_bytes) for r in got} == digest
    big = [r for r in got if r.payload_digest == hashlib.sha1(BIG.encode()).hexdigest()]
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in big) == sorted(
        [("1", "revisit", 2), ("None", "revisit", 2), ("2", "revisit", 2), ("2", "response", None)])
    assert all(r.record_type == "response" and r.refers_to is None for r in got if r.payload_bytes < 1000)
    ids = {r.record_id for r in got}
    scratch = Scratch(spark)
    arc.pages_to_arc(pages.select("page_id", "url", "html"), scratch.path("arc"), 2)
    arc.arc_to_warc(f"{scratch.root}/0001-arc", f"{scratch.root}/warc", scratch)
    back = arc.read_warc(spark, f"{scratch.root}/warc").where("record_type = 'response'").collect()
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes for r in back) and len(back) == len(rows) - 3
    assert len(ids) == len(rows) and all(r.refers_to_record in ids for r in got if r.record_type == "revisit")


def test_arc_versions():
    one = b"filedesc://a 0.0.0.0 20000101000000 text/plain 74\n1 0 X\n" + arc.ARC_FIELDS[1].encode() + b"\n\n"
    head = one.split(b"\n", 1)[1]
    one = b"filedesc://a 0.0.0.0 20000101000000 text/plain %d\n" % len(head) + head
    body = b"HTTP/1.0 200 OK\r\n\r\nab\n\nhttp://x 1 2 3 4\n"
    one += b"\nhttp://h/ 1.2.3.4 199912312359 text/html %d\n" % len(body) + body + b"\n"
    (version, url, ip, date, kind, block, _), = arc.arc_records(one)
    assert (version, url, ip, kind, block) == (1, "http://h/", "1.2.3.4", "text/html", body) and arc.iso_date(date) == "1999-12-31T23:59:00Z"
    head = b"2 0 X\n" + arc.ARC_FIELDS[2].encode() + b"\n"
    two = b"filedesc://a 0 20000101000000 text/plain 200 - - 0 a %d\n" % len(head) + head + b"\nhttp://h/ 1.2.3.4 20000101000000 text/html 200 - - 0 a 3\nabc\n"
    assert [r[5] for r in arc.arc_records(two)] == [b"abc"]
    for bad in (two[:-3], two.replace(b" 3\nabc", b" x\nabc"), b"http://h/ 1 20000101000000 text/html 0\n", two.replace(b"200 - - 0 a 3", b"3")):
        with pytest.raises(arc.ArchiveError):
            list(arc.arc_records(bad))


def arc_file(*records, version=1):
    head = f"{version} 0 X\n{arc.ARC_FIELDS[version]}\n".encode()
    return b"filedesc://a 0.0.0.0 20000101000000 text/plain %d\n" % len(head) + head + b"\n" + b"\n".join(records) + b"\n"


def line(url, body, date="20000101000000", kind="text/html"):
    return f"{url} 1.2.3.4 {date} {kind} {len(body)}\n".encode() + body


def test_bad_records_are_told_and_the_rest_is_read():
    good = [line(f"http://h/{i}", b"HTTP/1.0 200 OK\n\nbody %d" % i) for i in range(5)]
    data = arc_file(good[0], line("http://h/a b c", b"blank"), line("http://h/odd", b"xx", date="2000"), good[1], b"http://h/ 1.2.3.4 20000101000000 text/html many\nhttp://x y\n\0\xff",
                    good[2], b"no fields 2\nab", good[3], line("http://h/cut", b"z" * 50)[:-9])
    left_out = []
    got = list(arc.arc_records(data, lambda *of: left_out.append(of)))
    assert [r[1] for r in got] == ["http://h/0", "http://h/a b c", "http://h/1", "http://h/2", "http://h/3"]
    assert [r[5] for r in got][2:] == [b"HTTP/1.0 200 OK\n\nbody %d" % i for i in (1, 2, 3)] and all(data[r[6]:].startswith(r[1].encode()) for r in got)
    assert [data[at:at + 9] for at, _, _ in left_out] == [b"http://h/", b"http://h/", b"no fields", b"http://h/"]
    assert [reason.split()[0] for _, _, reason in left_out] == ["date", "no", "version", "50"]
    assert data[left_out[1][0]:][:left_out[1][1]].endswith(b"\0\xff\n")
    zipped = b"".join(gzip.compress(data[i:i + 37]) for i in range(0, len(data), 37))  # members that end anywhere
    assert [r[1:] for r in arc.arc_records(zipped, lambda *of: None)] == [r[1:] for r in got]
    for broken in (zipped[:-5], zipped[:300] + b"\0" * 40, gzip.compress(data)[:-30]):
        told = []
        some = list(arc.arc_records(broken, lambda *of: told.append(of)))
        assert told and [r[1] for r in some] == [r[1] for r in got][:len(some)]
    assert list(arc.arc_records(b"")) == list(arc.arc_records(gzip.compress(b""))) == []


def test_foreign_archives(spark, tmp_path):
    """Blocks that are no HTTP responses, two versions, bad records, and text of any bytes."""
    (tmp_path / "a.arc").write_bytes(arc_file(line("dns:h", b"20000101000000\nh. 3600 IN A 1.2.3.4", kind="text/dns"), line("http://h/ü x", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n\0\xff\xfe"),
                                              line("http://h/odd", b"xx", date="today"), line("http://h/none", b"")))
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(arc_file(b"ftp://h/f 1.2.3.4 20000101000000 text/plain 200 - - 0 b 4\nHTTP", version=2)))
    scratch = Scratch(spark)
    wrong = arc.arc_to_warc(str(tmp_path), f"{scratch.root}/warc", scratch).collect()
    assert [(r.file, r.error) for r in wrong] == [("a.arc", "date 'today'")]
    got = {r.url: r for r in arc.read_warc(spark, f"{scratch.root}/warc").collect()}
    assert {u: (r.record_type, bytes(r.http), bytes(r.payload)) for u, r in got.items()} == {
        "dns:h": ("resource", b"", b"20000101000000\nh. 3600 IN A 1.2.3.4"), "http://h/ü%20x": ("response", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n", b"\0\xff\xfe"),
        "http://h/none": ("resource", b"", b""), "ftp://h/f": ("resource", b"", b"HTTP")}
    assert arc.index_warc(spark, f"{scratch.root}/warc").count() == 4


def test_archives_are_rolled_by_bytes(spark, tmp_path):
    """Each file opens with a warcinfo record, holds at most the given bytes or one record, and a gzip member per record."""
    rows = [(i, f"http://h/{i}", chr(97 + i % 26) * (100 + 700 * (i % 5))) for i in range(60)] + [(1000, "http://h/long", "é" * 9_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    scratch = Scratch(spark)
    arc.pages_to_arc(pages, f"{scratch.root}/arc", 1, 8000)
    assert arc.arc_to_warc(f"{scratch.root}/arc", f"{scratch.root}/warc", scratch, 9000, 1 << 40).count() == 0
    seen = 0
    for file in (f for f in spark.read.format("binaryFile").load(f"{scratch.root}/warc").collect() if f.length):
        blob, sizes = bytes(file.content), []
        while blob:
            unzip = zlib.decompressobj(31)
            sizes.append(len(unzip.decompress(blob)))
            blob = unzip.unused_data
        records = list(arc.warc_records(bytes(file.content)))
        assert [f["warc-type"] for f, _ in records] == ["warcinfo"] + ["response"] * (len(records) - 1)
        assert [s for s in sizes if s] == [len(x) for x in gzip.decompress(file.content).replace(b"\r\n\r\nWARC/1.1\r\n", b"\r\n\r\n\0WARC/1.1\r\n").split(b"\0")]
        assert len(records) == 2 or sum(sizes[1:]) <= 9000
        seen += len(records) - 1
    assert seen == 61
    back = {r.url: bytes(r.payload).decode() for r in arc.read_warc(spark, f"{scratch.root}/warc").collect()}
    assert back == {u: h for _, u, h in rows}


def test_archive_empty(pages):
    assert arc.convert_pages(pages.limit(0)).collect() == []


def test_url_filter(spark):
    urls = ["http://x.org/porn/1", "http://x.org/popcorn", "http://x.org/pornography", "http://sex.x.org/casino", "http://x.org/sex/sex", "http://sussex.ac.uk/adult-dating", "http://Example.COM/en/a", "http://www.example.com/en/a",
            "http://a.com/porn", "http://a.net/es/", "http://a.net/it/xxx", "ftp://notexample.com/en/", "http://q.org?u=http://b.com/xxx#p", None, "", "no scheme xxx", "http://a.com", "http://example.com/en\nx"]
    rows = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string").repartition(2)
    got = {r.page_id: r for r in url_terms.judge(rows, RULES).collect()}
    verdicts = "".join("b" if got[i].verdict == "block" else "a" for i in range(len(urls)))
    assert verdicts == "baab" + "ab" + "baa" + "bb" + "a" + "b" + "aab" + "aa"
    assert [got[i].rule for i in (6, 7, 8, 9, 10, 13, 16)] == ["example.com/en/", "www.example.com/en/", "com/", "net/es/", None, None, None]
    assert (got[12].host, got[12].path, got[16].path, got[13].host) == ("q.org", "", "", "")
    assert url_terms.judge(rows.limit(0), RULES).collect() == []


LAYOUT = ('<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>";</script></head><body><div id="top-menu"><ul><li><a>Home</a></li><li><a>{i}</a></li></ul></div>{extra}'
          '<div class="page"><div class="text"><h1>Title {i}</h1><p>First {i} &amp; <b>bold</b>\n  text<p>Second {i} is a longer paragraph</p><p>Share this story with all your friends</p></div>'
          '<div class="comments"><p>reader {i}</p></div></div><footer>&copy; x')


def test_wrapper_without_article_element(spark):
    rows = [(i, "http://h.org/%d" % i, LAYOUT.format(i=i, extra='<div class="notice">n</div>' if i % 2 else "")) for i in range(12)]
    rows += [(100, None, None), (101, "http://z.org", ""), (102, "http://z.org", "plain words only"), (103, "http://y.org", "<article><h1>A</h1>x<br>y<aside>no</aside></article><p>out")]
    pages = spark.createDataFrame([(*r, "h", "r") for r in rows], "page_id long, url string, html string, host string, rules string").repartition(4)
    got = {r.page_id: r for r in wrappers.extract(pages).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i].text == f"Title {i}\nFirst {i} & bold text\nSecond {i} is a longer paragraph\nShare this story with all your friends"
        assert got[i].n_chars == len(got[i].text)
    assert (got[100].text, got[101].text, got[102].text, got[103].text) == ("", "", "plain words only", "A\nx\ny")
    assert wrappers.extract(pages.limit(0)).collect() == []


def test_alignment_finds_optional_and_repeated_groups():
    a, b = (wrappers.item(wrappers.parse(x)[0]) for x in (
        "<div><h1>same</h1><ul><li>1</li><li>2</li></ul><p>x</p></div>", "<div><h1>same</h1><p>y</p><table><tr><td>z</td></tr></table></div>"))
    both = wrappers.merge(a, b)
    assert wrappers.regex(both) == '<div> <h1> "same" </h1> (<ul> (<li> #PCDATA </li>)+ </ul>)? <p> #PCDATA </p> (<table> <tr> <td> #PCDATA </td> </tr> </table>)? </div>'
    assert wrappers.regex(wrappers.merge(b, a)).count("?") == 2


def test_text_after_marked_inline_elements():
    text = lambda page: wrappers.article_text(page, None)
    assert text('<p>Text <span class="ad">x</span> rest</p>') == "Text\nrest"
    assert text('<p>Text <span class="ad">x <span>y</span> z</span> rest <span>more</span></p>') == "Text\nrest more"
    assert text('<div class="article"><span class="share">s</span><p>One</p><p>Two</p></div>') == "One\nTwo"
    assert text('<body><a class="skip-link" href="#m">Skip</a><div><p>One</p><p>Two</p></div>') == "One\nTwo"
    assert text('<div><p>One <span class="ad">x</p><p>Two</p></div>') == "One\nTwo"
    assert text('<div><a class="share">s <a href="x">Link</a> and much more text after it</div>') == "Link and much more text after it"


def test_hosts_of_mixed_layouts_lose_no_page(spark):
    """Pages with an article element, pages without one, and one built like no other, on one host and without a URL."""
    def page(i):
        if i == 5:
            return "<table><tr><td>Lone %d words in a table</td></tr></table>" % i
        if i % 2:
            return f'<div id="wrap"><div class="text"><h1>Title {i}</h1><p>Body {i} of the other layout, rather long</p></div><ul class="nav"><li>n</li></ul></div>'
        return f'<nav><a>Home</a></nav><article><h1>Title {i}</h1><p>Body {i} of the first layout</p></article>'

    rows = [(i + 100 * k, url, page(i)) for k, url in enumerate(("http://h.org/x", None)) for i in range(12)]
    # a list of links that looks like an article is no article
    rows += [(300 + i, "http://l.org/", f'<div class="post"><a href="x">Other {i}</a></div><div class="b"><p>Text {i} itself</p></div>') for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in wrappers.extract(pages).collect()}
    for i in range(12):
        want = "Lone 5 words in a table" if i == 5 else f"Title {i}\nBody {i} of the " + ("other layout, rather long" if i % 2 else "first layout")
        assert got[i] == got[100 + i] == want
    assert [got[300 + i] for i in range(3)] == [f"Text {i} itself" for i in range(3)]


def test_article_words_behind_many_classes():
    """The list of teasers has an article word too, so the container's must be seen."""
    page = ('<div class="bg-white col-md-8 flex mb-4 relative story"><p>The article itself</p></div>'
            '<div class="post"><p>A teaser</p></div>')
    assert wrappers.label_of("div", ' class="bg-white col-md-8 flex mb-4 relative story"').endswith(".story")
    assert wrappers.article_text(page, None).startswith("The article itself")


def test_class_words_do_not_drop_the_article():
    """A class is a mark as a whole name only, and never on what holds the article."""
    text = lambda page: wrappers.article_text(page, None)
    line = "One paragraph of text that is long enough to be nearly all there is on such a page." * 2
    body = f"<h1>Title</h1><p>{line}</p><p>Another one.</p>"
    want = f"Title\n{line}\nAnother one."
    for page in (f'<article class="post has-related">{body}</article>', f'<div id="content" class="no-sidebar">{body}</div>', f'<main class="layout-with-sidebar"><article>{body}</article></main>',
                 f'<div class="hentry social-story">{body}</div>', f'<div class="content search-results">{body}</div>', f'<div class="widget-area">{body}</div>', f'<form id="aspnet"><div>{body}</div></form>',
                 f'<div class="sidebar"><main>{body}</main></div>', f'<article class="sponsored">{body}</article>'):
        assert text(page) == want, page
        assert text(f'<nav><a href="/">Home</a></nav><div class="sidebar-left"><p>Side</p></div>{page}<div class="comment-list"><p>Me too</p></div><div class="widget"><p>W</p></div><footer>x</footer>') == want, page
    assert wrappers.is_mark("sidebar-left") and wrappers.is_mark("ad-box") and not wrappers.is_mark("has-related") and not wrappers.is_mark("content-left")


def test_number_of_pages_changes_nothing(spark):
    """A line that is the same on all pages of a host stays in the article, with four pages and with forty."""
    def pages(host, n):
        return [(n * 100 + i, f"http://{host}.org/{i}", f"<nav><a>Home</a></nav><article><h1>Title {i}</h1><p>Same opening line.</p><p>Body {i}</p></article><div class='ad'>Buy</div>") for i in range(n)]
    rows = pages("a", 4) + pages("b", 5) + pages("c", 40)
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert all(r.text == f"Title {r.page_id % 100}\nSame opening line.\nBody {r.page_id % 100}" for r in got) and len(got) == 49


def test_deep_and_repeated_pages(spark):
    deep = "<div>" * 5000 + "<p>At the bottom</p>" + "</div>" * 5000 + "<p>After</p>"
    rows = [(1, "http://d.org/1", deep), (2, "http://d.org/2", "<div>" * 3000 + "open"), (3, "http://d.org/3", "<p>plain</p>"), (3, "http://d.org/3", "<p>plain</p>"), (None, "http://d.org/3", "<p>plain</p>"),
            (4, "http://l.org", "<article>" + "<p>word word</p>" * 50_000 + "</article>")]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    texts = sorted((str(r.page_id), r.text) for r in got)
    assert texts[:-1] == [("1", "At the bottom\nAfter"), ("2", "open"), ("3", "plain"), ("3", "plain"), ("4", "\n".join(["word word"] * 50_000))] and texts[-1] == ("None", "plain")


class Outline(HTMLParser):
    """The article as a plain parser sees it: text between block tags inside <article>, without marked elements."""

    BLOCKS = {"article", "h1", "h2", "p", "br", "div", "ul", "li", "section"}

    def __init__(self):
        super().__init__()
        self.inside, self.out, self.held = 0, [], ""

    def flush(self):
        if self.inside and self.held.split():
            self.out.append(" ".join(self.held.split()))
        self.held = ""

    def handle_starttag(self, tag, attributes):
        if tag in self.BLOCKS:
            self.flush()
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.flush()
        self.inside -= tag == "article"

    def handle_data(self, data):
        self.held += data


@pytest.mark.parametrize("scale, parts", [("sf0.001", 1), ("sf0.001", 3), ("sf0.001", 8), ("sf0.01", 8)])
def test_against_a_plain_parser(spark, scale, parts):
    """All pages of the table, dealt out in several ways."""
    rows = spark.read.parquet(f"/root/testdata/{scale}/pages.parquet")
    want = {}
    for r in rows.collect():
        outline = Outline()
        outline.feed(r.html or "")
        want[r.page_id] = "\n".join(outline.out)
    got = {r.page_id: r.text for r in wrappers.extract(rows.repartition(parts)).collect()}
    assert got == want and len(want) >= 50
    # without the article element's own name, the expression finds the same article
    plain = rows.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<article>", "<div>"), "</article>", "</div>"))
    assert {r.page_id: r.text for r in wrappers.extract(plain.repartition(parts)).collect()} == want
