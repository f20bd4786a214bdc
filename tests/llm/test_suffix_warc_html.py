import random
import struct

import pytest
import zstandard

from brute import later_copies, repeats, warc as plain_warc
from conftest import SF01
from mktlens.llm import html, suffix, warc


def made(n=300):
    rng = random.Random(1)

    def text(k):
        return "".join(rng.choice("abcdefgh éß") for _ in range(k))

    shared = [text(30), text(60), text(100), text(45)]
    docs = [(i, "".join(rng.choice([text(rng.randint(1, 80)), rng.choice(shared), rng.choice(shared)]) for _ in range(rng.randint(0, 12)))) for i in range(n)]
    return docs + [
        (1000, None), (1001, ""), (1002, docs[3][1]), (1003, docs[3][1]), (1004, "a" * 500), (1005, "ab" * 300), (1006, "x" * 39), (None, docs[5][1]),
        (1007, "pre " + docs[6][1] + " suf"), (1008, text(5000)),
    ]


@pytest.mark.parametrize("hot", [1024, 3])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    docs = made()
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, n_bytes string").repartition(3)
    got = sorted((tuple(r) for r in suffix.repeats(df, 40, with_text=False).collect()), key=str)
    assert got == sorted(repeats(docs, 40), key=str)
    first = suffix.repeats(df, 40, keep_first=True, bits=64).collect()
    assert sorted(((r.doc_id, r.n_removed) for r in first), key=str) == sorted(later_copies(docs, 40), key=str)
    assert all((r.kept is None) == (r.doc_id == 1000) for r in first)


def test_repeats_of_equal_rows_and_nothing(spark):
    text = "the same long enough text " * 10
    df = spark.createDataFrame([(1, text), (1, text), (2, "other")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in suffix.repeats(df, 200).collect()) == [(1, 260), (1, 260), (2, 0)]
    assert suffix.repeats(df.limit(0), 200).count() == 0


def test_spans_are_narrowed_to_characters():
    data = "aéb".encode()
    assert suffix.without(data, [[2, 3]], characters=True) == data
    assert suffix.without(data, [[2, 4]], characters=True).decode() == "aé"
    assert suffix.merged([(0, 2), (2, 5), (7, 8)]) == [[0, 5], [7, 8]]


def test_warc_round_trip(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()]
    pages += [
        (5000, None, None), (5001, "http://a/\r\nx%41", ""), (5002, "é", pages[0][2]), (5003, "z", pages[0][2]), (None, "n", pages[1][2]), (None, "m", "only"),
        (-7, "neg", "é\r\n\r\nWARC/1.1\r\n"), (6000, "long", "<p>x</p>" * 400_000),
    ]
    df = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, path string")
    got = [
        (r.record_id and int(r.record_id), r.target_uri, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to), r.payload and bytes(r.payload) if r.payload is not None else None)
        for r in warc.read_archives(warc.write_archives(df)).collect()
    ]
    want = [tuple(x) for x in plain_warc(pages)]
    norm = lambda rows: sorted((tuple(b"" if i == 6 and v == b"" else v for i, v in enumerate(r)) for r in rows), key=str)
    assert norm(got) == norm(want)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_reader_rejects_damage():
    good = warc.archive([warc.record(str(i), "u", b"payload %d" % i, None, "2000-01-01T00:00:00Z") for i in range(40)])
    assert [warc.parse(r)["payload"] for r in warc.frames(good)] == [b"payload %d" % i for i in range(40)]
    with pytest.raises(ValueError):
        list(warc.frames(good[:-3]))
    with pytest.raises(ValueError):
        list(warc.frames(good + b"tail"))
    raw = warc.record("1", "u", b"abc", None, "2000-01-01T00:00:00Z")
    for bad in (raw[:-2], raw.replace(b"abc", b"abd"), raw.replace(b"WARC/1.1", b"NOPE/1"), raw.replace(b"WARC-Type", b"X-Type")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_warc_reader_takes_compressed_and_absent_dictionaries():
    recs = [warc.record(str(i), "u", b"some payload text %d" % i, None, "2000-01-01T00:00:00Z") for i in range(5)]
    d = zstandard.ZstdCompressionDict(b"some payload text " * 20, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packed = zstandard.compress(d.as_bytes())
    body = b"".join(zstandard.ZstdCompressor(dict_data=d).compress(r) for r in recs)
    assert list(warc.frames(struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + body)) == recs
    assert list(warc.frames(b"".join(zstandard.compress(r) for r in recs))) == recs


CASES = [
    ("", ""),
    ("plain text only", "plain text only"),
    ("<p>a<p>b &amp; c&nbsp;d", "a\nb & c d"),
    ("<div class=nav><a href=x>menu</a></div><div class='content post-12'><h2>T</h2><p>Long text here, really long text.<br>Second line</p>"
     "<ul><li>one<li>two</ul><div class=comments><p>First! nice comment with a lot of words to say</p></div></div><footer>f</footer>",
     "T\nLong text here, really long text. Second line\none\ntwo"),
    ("<body><header><a href=/>Home</a><h1>Site</h1></header><main><article><header><h1>Title</h1><span>By me</span></header><section><p>One para text text text.</p>"
     "</section><section><p>Two para text text.</p></section><form><input><label>Name</label></form></article><aside>related stuff long long</aside></main></body>",
     "Title\nOne para text text text.\nTwo para text text."),
    ("<script>if (a<b) x('</p>')</script><p>x</p><!-- c > --><style>p{}</style>y", "x\ny"),
    ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ("<div hidden><p>secret</p></div><p>shown</p>", "shown"),
    ("<a href=\"x>broken quote <p>text after</p>", "broken quote\ntext after"),
    ("<textarea>abc", ""),
]


@pytest.mark.parametrize("page,text", CASES)
def test_extraction(page, text):
    assert html.extract(page, None) == text


def test_host_consensus(spark):
    good = "<body><div class='post p1'><p>{0}</p></div><div class='extra'><p>{1}</p></div></body>"
    pages = [(i, f"http://h.example/{i}", good.format("main text " * 30, "short")) for i in range(10)]
    pages += [(100, "http://h.example/x", good.format("main text", "much longer extra")), (101, None, "<p>no host</p>"), (102, "http://h.example/y", None), (103, "not a url", "<p>plain</p>")]
    df = spark.createDataFrame([(*p, "q") for p in pages] + [(0, "http://h.example/0", pages[0][2], "q")], "page_id long, url string, html string, text string")
    out = html.main_text(df)
    got = {r.page_id: r for r in out.collect()}
    assert out.count() == len(pages) + 1
    assert got[0].text == ("main text " * 30).strip() and got[0].n_chars == 299 and got[0].host_path == ">div.p#.post"
    assert got[100].text == "main text" and got[101].text == "no host" and got[102].text == "" and got[102].n_chars == 0 and got[103].text == "plain"
    assert html.main_text(df.limit(0)).count() == 0


ARTICLE = "<h1>Title</h1><p>" + "A sentence of the article. " * 12 + "</p>"
TEXT = "Title\n" + ("A sentence of the article. " * 12).strip()
SIDE = "<div class='sidebar'><p>Other news of today.</p></div><div class='site-footer'>Imprint</div>"
WRAPPERS = [
    "<div class='content has-sidebar'>{}</div>", "<div class='site no-sidebar'><article>{}</article></div>", "<div class='page-with-banner'>{}</div>",
    "<div class='widget'><article>{}</article></div>", "<div id='social'>{}</div>", "<form id='form1'><div>{}</div></form>", "<div class='overlay'><main>{}</main></div>",
    "<div class='content-sidebar-wrap'><div class='entry'>{}</div></div>",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_layout_wrappers_are_no_noise(wrapper):
    assert html.extract("<body>" + wrapper.format(ARTICLE) + SIDE + "</body>", None) == TEXT


def test_parts_of_an_article_are_no_noise_by_their_slug():
    page = (
        f"<body><article>{ARTICLE}<section id='related-work'><p>Earlier papers.</p></section><div class='social-policy'><p>On policy.</p></div>"
        f"<h2 id='comments-on-the-method'>Comments on the method</h2><p>Fine.</p><h2 id='notices'>Notices</h2></article>"
        f"<div id='comments'><article class='comment'><p>First!</p></article></div>{SIDE}</body>"
    )
    assert html.extract(page, None) == TEXT + "\nEarlier papers.\nOn policy.\nComments on the method\nFine.\nNotices"


def test_names_of_noise():
    for token in "nav site-footer comment-list post-comments cookie-banner related-posts side-bar sidebar__inner footer--dark ad-slot-3 share_buttons newsletter-signup".split():
        assert html.noise_of(token), token
    for token in "has-sidebar no-sidebar page-with-banner related-work social-policy entry-header content-sidebar-wrap adventure page--with-banner".split():
        assert not html.noise_of(token), token


def test_articles_in_several_blocks_are_whole(spark):
    # a host that votes for div>div; on some pages the article lies in three of them
    one = "<body><div><div><p>{0}</p></div><div><a href='/x'>{1}</a></div></div><div class='extra'><p>Imprint and more of it.</p></div></body>"
    part = [f"Part {i}. " + f"Sentence {i} of the article. " * 8 for i in range(3)]
    three = "<body><div>" + "".join(f"<div><p>{p}</p></div>" for p in part) + "<div><a href='/x'>More links than text</a></div></div><div class='extra'><p>Imprint and more of it.</p></div></body>"
    posts = "<body><div class='post'><p>{0}</p></div><div class='extra'><p>Imprint.</p></div></body>"
    split = f"<body><div class='post'><p>{part[0]}</p></div><div class='more'><p>{part[1]}</p></div><div class='more'><p>{part[2]}</p></div></body>"
    pages = [(i, f"http://a.example/{i}", one.format("main text " * 30, "Links " * 5)) for i in range(6)] + [(10, "http://a.example/x", three)]
    pages += [(20 + i, f"http://b.example/{i}", posts.format("main text " * 30)) for i in range(6)] + [(30, "http://b.example/x", split)]
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0].host_path == ">div>div" and got[0].text == ("main text " * 30).strip()
    assert got[10].text == "\n".join(p.strip() for p in part)
    assert got[20].host_path == ">div.post" and got[30].text == "\n".join(p.strip() for p in part)
