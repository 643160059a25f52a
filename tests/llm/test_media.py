"""HTML extraction and TIFF round trips."""

import hashlib
import html
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from catweave.llm import html_text, tiff
from catweave.llm.common import table

SF = "/root/testdata/sf0.001"


def test_articles_of_all_pages(spark):
    pages = table(spark, SF, "pages")
    want = {}
    for r in pages.collect():
        body = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        want[r.page_id] = (r.url, " ".join(html.unescape(re.sub(r"<[^>]+>", " ", body)).split()))
    got = html_text.extract(pages).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def article(r):
    body = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", body)).split())


@pytest.mark.parametrize("tag", ["div", "section", 'div class="x1"'])
def test_articles_by_any_other_name(spark, tag):
    rows = table(spark, "/root/testdata/sf0.1", "pages").select("html").collect()
    right = [html_text.main_text(r.html.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag.split()[0]}>")) == article(r) for r in rows]
    assert np.mean(right) >= 0.99


def test_articles_without_any_names(spark):
    """No tag, class or role tells anything: all blocks are divisions or paragraphs."""
    rows = table(spark, SF, "pages").select("html").collect()
    score = []
    for r in rows:
        plain = re.sub(r' class="ad"', "", re.sub(r"(</?)(article|nav|footer|ul|li)\\b", r"\\1div", r.html))
        got, want = Counter(html_text.main_text(plain).split()), Counter(article(r).split())
        score.append(2 * (got & want).total() / max(1, got.total() + want.total()))
    assert np.mean(score) >= 0.95


def test_smoothing_and_threshold_equal_plain():
    rng = random.Random(7)
    for n in (1, 2, 3, 7, 8, 60):
        ratio = [rng.choice([0, 1, 5, 80, 200]) * rng.random() for _ in range(n)]
        for sigma in (0.5, 1.0, 2.0):
            plain = []
            for i in range(n):
                near = [(np.exp(-((i - j) ** 2) / (2 * sigma**2)), ratio[j]) for j in range(n) if abs(i - j) <= max(1, int(np.ceil(3 * sigma)))]
                plain.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
            assert np.allclose(html_text.smoothed(np.array(ratio), sigma), plain)
        lines = [html_text.Line("x" * int(100 * r), 100, 0, 0, (), (), False) for r in ratio]
        smooth = html_text.smoothed(np.array([x.ratio for x in lines]), 1.0)
        dense, limit = html_text.content(lines, [False] * n)
        assert limit == min(smooth.std(), smooth.max()) and dense.tolist() == [s >= limit for s in smooth]


P = "<p>Words of an article that go on for a good while, as sentences do.</p>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><header>Top</header><nav><a>x</a></nav><main>{P}<aside>side</aside><div class='ad-box'>buy</div></main><footer>f</footer>", P),
        (f"<article><header><h1>Title &amp; more</h1></header>{P}<section id=comments><p>first!</p></section><form>go</form></article><p>after</p>", f"Title & more {P}"),
        ("<article><p>one<p>two<br>three <b>fo</b>ur<script>var a='</p>'</script><style>p{}</style></article>", "one two three four"),
        (f"<body><div class=menu><a>a</a><a>b</a></div><div>{P}{P}{P}</div><div class='cookieNotice'>yes?</div></body>", f"{P} {P} {P}"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"),
        (f"<div class='comment-free social'><h2>Head</h2>{P}{P}</div><footer>f</footer>", f"Head {P} {P}"),
        (f"<body><div>{P}{P}</div><div id=comments>{P}{P}{P}{P}</div></body>", f"{P} {P}"),
        ("<article><p>foo<span hidden>x</span>bar and so on<script>y</script>!</p></article>", "foobar and so on!"),
        (f"<body><div><div><a href=1>one</a> <a href=2>two</a></div><div><h1>T</h1><div>{P}<ul><li>a<li>b</ul>{P}</div><p>End.</p></div></div></body>", f"T {P} a b {P} End."),
        (f"<article>{P}{P}</article><div>{P}{P}</div><p>bye</p>", f"{P} {P} {P} {P}"),
        (f"<body><header><h1>Site</h1></header>{P}<p>short</p>{P}<a href=x>more</a></body>", f"{P} short {P}"),
        ("", ""), ("   ", ""), ("just text", "just text"), ("<article>unclosed <i>x", "unclosed x"), ("<p hidden>no</p><article>yes</article>", "yes"),
    ],
)
def test_pages(page, want):
    assert html_text.main_text(page) == re.sub(r"</?p>", "", want)


def test_extract_odd_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (2, None, "", "x"), (None, "v", "<article>" + "a " * 200_000 + "</article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert Counter((r.page_id, r.url, r.n_chars) for r in html_text.extract(df).collect()) == Counter([(1, "u", 0), (2, None, 0), (2, None, 0), (None, "v", 399_999)])
    assert html_text.extract(df.limit(0)).count() == 0


def lzw_plain(raw):
    """LZW as the TIFF 6.0 specification words it, code by code."""
    bits, table, word = [], {}, b""

    def put(code):
        size = 258 + len(table)
        bits.append(format(code, f"0{12 if size > 2047 else 11 if size > 1023 else 10 if size > 511 else 9}b"))

    def code(w):
        return w[0] if len(w) == 1 else table[w]

    bits.append(format(256, "09b"))
    for i in range(len(raw)):
        more = word + raw[i : i + 1]
        if len(more) == 1 or more in table:
            word = more
            continue
        put(code(word))
        table[more] = 258 + len(table)
        word = raw[i : i + 1]
        if len(table) == 4094 - 258:
            put(256)
            table.clear()
    if word:
        put(code(word))
        table[None] = 0
    put(257)
    s = "".join(bits)
    return int(s + "0" * (-len(s) % 8), 2).to_bytes((len(s) + 7) // 8, "big")


def test_lzw_table_that_is_never_cleared():
    raw = bytes(random.Random(4).choices(b"abcdefgh", k=40_000))
    codes, table, word = [256], {bytes((i,)): i for i in range(256)}, b""
    for i in range(len(raw)):  # a writer that keeps a full table
        more = word + raw[i : i + 1]
        if more in table:
            word = more
            continue
        codes.append(table[word])
        if len(table) < 4096 - 2:
            table[more] = len(table) + 2
        word = raw[i : i + 1]
    codes += [table[word], 257]
    bits = "".join(format(c, f"0{min(12, (258 + max(0, k - 1)).bit_length() if k else 9)}b") for k, c in enumerate(codes))
    assert tiff.lzw_decode(int(bits + "0" * (-len(bits) % 8), 2).to_bytes((len(bits) + 7) // 8, "big"), len(raw)) == raw


@pytest.mark.parametrize("size", [64, 128, 640, 64 * 333, (1 << 20) + 64, 3 << 20])
def test_every_payload_meets_every_codec(size):
    payload = random.Random(size).randbytes(size // 2) + b"ab" * (size // 4)
    reader = tiff._Reader(tiff.store_payload(payload))
    pages = list(reader.directories())
    assert {(t[259][0], t[317][0], 322 in t) for t in pages} == {(32773, 1, False), (5, 2, False), (8, 1, False), (8, 2, True)}
    assert len({len(reader.page(t).pixels) for t in pages[:4]}) == 1
    assert b"".join(reader.page(t).pixels.tobytes() for t in pages) == payload


def test_codecs():
    rng = random.Random(0)
    for n in (0, 1, 2, 3, 100, 255, 256, 257, 1000, 5000, 20000, 70000):
        for raw in (bytes(n), bytes(rng.choices(b"ab\0c", k=n)), rng.randbytes(n)):
            assert tiff.packbits_decode(tiff.packbits_encode(raw), n) == raw
            assert tiff.lzw_decode(tiff.lzw_encode(raw), n) == raw
            for width in (16, 200):
                whole = raw[: n // width * width]
                packed = tiff.packbits_encode(whole, width)
                assert tiff.packbits_decode(packed, len(whole)) == whole
                assert b"".join(tiff.packbits_encode(whole[y : y + width]) for y in range(0, len(whole), width)) == packed
            assert tiff.lzw_encode(raw) == lzw_plain(raw)
    # The example of the TIFF 6.0 specification.
    packed = bytes.fromhex("FEAA02800 02AFDAA0380002A22F7AA".replace(" ", ""))
    assert tiff.packbits_decode(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def made(order, pixels, bits, kind=1, predictor=1, planar=1, sample_format=1, tile=None):
    """A file by hand, of either byte order."""
    h, w, s = pixels.shape
    size = bits // 8
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    parts = [pixels[:, :, i : i + 1] for i in range(s)] if planar == 2 else [pixels]
    at, sizes = [], []
    for p in parts:
        if predictor == 2:
            u = p.view(f"u{size}")
            p = np.diff(u, axis=1, prepend=u.dtype.type(0)).astype(u.dtype)
        raw = p.astype(p.dtype.newbyteorder(order)).tobytes()
        if predictor == 3:
            planes = p.astype(p.dtype.newbyteorder(">")).reshape(h, -1).view(np.uint8).reshape(h, -1, size).transpose(0, 2, 1).reshape(h, -1, p.shape[2])
            raw = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
        coded = zlib.compress(raw) if kind == 8 else raw
        at.append(len(out))
        sizes.append(len(coded))
        out += coded
    lists = len(out)
    out += struct.pack(f"{order}{2 * len(at)}I", *at, *sizes)
    short = lambda v: struct.pack(f"{order}HH", v, 0)
    n = len(at)
    where = (lambda v: struct.pack(f"{order}I", v))
    fields = [(256, 4, 1, where(w)), (257, 4, 1, where(h)), (258, 3, 1, short(bits)), (259, 3, 1, short(kind)), (262, 3, 1, short(1)), (273, 4, n, where(at[0] if n == 1 else lists)), (277, 3, 1, short(s)), (278, 4, 1, where(h)), (279, 4, n, where(sizes[0] if n == 1 else lists + 4 * n)), (284, 3, 1, short(planar)), (317, 3, 1, short(predictor)), (339, 3, 1, short(sample_format))]
    struct.pack_into(f"{order}I", out, 4, len(out))
    out += struct.pack(f"{order}H", len(fields)) + b"".join(struct.pack(f"{order}HHI", t, k, c) + v for t, k, c, v in fields) + b"\0\0\0\0"
    return bytes(out)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("bits, predictor, planar, kind", [(8, 1, 1, 1), (16, 2, 1, 8), (32, 2, 2, 8), (8, 2, 2, 1), (32, 3, 1, 8)])
def test_reads_other_writers_layouts(order, bits, predictor, planar, kind):
    rng = np.random.default_rng(1)
    dtype = "f4" if predictor == 3 else f"u{bits // 8}"
    pixels = rng.integers(0, 200, (7, 9, 3)).astype(dtype)
    (page,) = tiff.read_pages(made(order, pixels, bits, kind, predictor, planar, 3 if predictor == 3 else 1))
    assert np.array_equal(page.pixels, pixels)


def test_pages_of_a_column(spark):
    rng = np.random.default_rng(2)
    images = [rng.integers(0, 4, s).astype(np.uint8) for s in ((1, 64), (5, 64), (300, 64), (33, 70))]
    media = tiff.write_tiff([(images[0], tiff.PACKBITS, 1, None), (images[1], tiff.LZW, 2, None), (images[2], tiff.DEFLATE, 2, (32, 128)), (images[3], tiff.NONE, 1, (16, 16))])
    df = spark.createDataFrame([(1, media, 9), (2, None, 9), (3, b"", 9), (4, b"nope", 9), (5, media[:-30], 9), (1, media, 9)], "doc_id long, media binary, page int")
    rows = tiff.tiff_pages(df).collect()
    for k, image in enumerate(images):
        own = [r for r in rows if r.doc_id == 1 and r.page == k]
        assert len(own) == 2 and all((r.height, r.width) == image.shape and bytes(r.data) == image.tobytes() and r.error is None for r in own)
    assert {r.doc_id for r in rows} == {1, 4, 5} and all(r.error for r in rows if r.doc_id == 4) and any(r.error for r in rows if r.doc_id == 5)


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_media_round_trip(request, name):
    df = request.getfixturevalue(name)
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        want[r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    got = tiff.media_round_trip(df).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert len({r.payload_sha256 for r in got}) == len({(r.payload_sha256, r.media_sha256, r.feature) for r in got})
