import gzip
import hashlib
import random
import re
import types
import zlib
from urllib.parse import urljoin

import numpy as np
import pytest

from tablescour.llm import derivatives, personal, vectors
from tablescour.llm.files import open_input
from tablescour.session import shared_dir


def _best(rows, k, every):
    good = [
        (i, [int(np.floor(64.0 * x)) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for q, (i, a) in enumerate(good):
        if i % every == 0:
            scores = [(-sum(x * y for x, y in zip(a, b)), j) for c, (j, b) in enumerate(good) if c != q and len(a) == len(b)]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 60])
def test_top_k_is_that_of_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    rows = [(i, (rng.normal(size=6) / 3).tolist()) for i in range(260)]
    rows += [(i, [0.5, -0.25, 0.0, 0.0, 0.0, 0.0]) for i in range(300, 345)]  # ties
    rows += [(40, rows[40][1]), (40, rows[3][1]), (360, [1.0, 2.0]), (361, [2.0, 1.0]), (380, [])]
    rows += [(400, None), (420, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (440, [float("nan")] * 6), (460, [float("inf")] * 6)]
    rows += [(None, [1.0] * 6), (480, [1e6] * 6), (481, [-1e6] * 6)]
    table = spark.createDataFrame([(i, v, 1, "q") for i, v in rows], "vec_id long, embedding array<double>, rank int, block string")
    got = vectors.top_k(table, block=block).collect()
    assert sorted(map(tuple, got)) == _best(rows, 20, 20)
    assert vectors.top_k(table.limit(0)).count() == 0


def test_top_k_copies_no_vectors_between_tasks(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(1, 900)] + [(i, rng.normal(size=3).tolist()) for i in range(0, 200, 4)]
    rows += [(i, (rng.normal(size=4) * 10.0 ** (i % 7)).tolist()) for i in range(1000, 1100)]  # numbers of all widths
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = vectors.top_k(table, block=40)
    assert sorted(map(tuple, found.collect())) == _best(rows, 20, 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "binary" not in plan


def test_tasks_hold_every_pair_of_blocks_once():
    blocks = [(3, b, 100 + b, b % 3) for b in range(50)] + [(2, 7, 10, 10), (9, 4, 5, 0)]
    tasks = vectors.plan(blocks, 12)
    pairs = [(dim, q, c) for dim, asking, candidates in tasks for q in asking for c in candidates]
    want = [(3, q, c) for q in range(50) if q % 3 for c in range(50)] + [(2, 7, 7)]
    assert sorted(pairs) == sorted(want) and len(tasks) >= 12
    assert vectors.plan([], 12) == vectors.plan([(9, 4, 5, 0)], 12) == []
    many = vectors.plan([(64, b, 4096, 205) for b in range(1465)], 12)  # six million vectors
    assert max(205 * len(a) * 4096 * len(c) for _, a, c in many) < 2 * vectors.PAIRS
    assert max(205 * len(a) for _, a, _ in many) <= vectors.QUERIES


def test_bounds_hold_and_cells_survive_packing():
    rng = np.random.default_rng(1)
    matrix = np.floor(rng.normal(size=(501, 7)) * 30)
    cells, low, high = vectors.grid(matrix)
    assert (vectors.unpack(vectors.pack(cells), *matrix.shape) == cells).all()
    dims = np.arange(7)
    assert (low[cells, dims] <= matrix).all() and (matrix <= high[cells, dims]).all()


PAGES = [
    (1, "http://a.example/x?y=1", '<html lang="de"><head><title> A &amp; B\n c</title><style>p{}</style></head><body><!-- no -->'
     '<p>One<b>two</b>&lt;3<br>three<a href="/z">link</a><a class=q href=\'b\'>l</a><script>var t="</p>";</script></body></html>'),
    (2, "http://a.example/\r\nX: y", "plain 1 < 2 text"),
    (3, None, "<p>never closed <!-- gone"),
    (4, "http://b.example", None),
    (None, "http://c.example", ""),
    (5, "http://[bad", '<a href="http://[worse">x</a>' + "<p>long</p>" * 20_000),
    (5, "http://[bad", '<a href="http://[worse">x</a>' + "<p>long</p>" * 20_000),
]


def test_derivatives_are_linked_records(spark):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, file string, payload int").repartition(2)
    got = derivatives.build(pages).collect()
    assert len(got) == len(PAGES) and all(r.linked for r in got)
    by_id = {r.page_id: r for r in got}
    assert by_id[1].title == "A & B c" and by_id[1].lang == "de" and by_id[1].n_links == 2
    assert by_id[2].url == "http://a.example/%0D%0AX: y"
    assert by_id[3].url is None and by_id[4].n_chars == by_id[None].n_chars == 0
    for page_id, _, page in PAGES:
        row = by_id[page_id]
        member = open_input(row.file).read()[row.conversion_offset :]
        head, _, block = gzip.GzipFile(fileobj=__import__("io").BytesIO(member)).read(10**6).partition(b"\r\n\r\n")
        assert b"WARC-Type: conversion" in head and row.response_id.encode() in head
        block = block[: int(re.search(rb"Content-Length: (\d+)", head)[1])]
        assert block.decode() == derivatives.visible_text(page or "")
        digest = derivatives._digest((page or "").encode())
        assert row.payload_digest == digest and row.text_digest == derivatives._digest(block)
    assert derivatives.build(pages.limit(0)).count() == 0


def test_visible_text():
    assert derivatives.visible_text(PAGES[0][2]) == "A & B\nc\nOnetwo<3\nthreelinkl"
    assert derivatives.visible_text("plain 1 < 2 text") == "plain 1 < 2 text"
    assert derivatives.visible_text("a<script>x") == "a"
    assert derivatives.visible_text("<a" * 50_000).count("<a") == 50_000


def test_blanks_and_lines_are_those_of_the_patterns():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\r", "\xa0", "\v", "\f", "\x85", "\u2028", "\x1c", "a", "é", "<b>", "&nbsp;", "&#10;"]
    for _ in range(5000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        text = page.replace("<b>", "").replace("&nbsp;", "\xa0").replace("&#10;", "\n")
        text = re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\r\f\v\xa0]+", " ", text)).strip()
        assert derivatives.visible_text(page) == text
    assert derivatives.visible_text("a" + " \n" * 500_000 + "b") == "a\nb"


def test_outlinks_are_joined_one_by_one_only_where_needed(monkeypatch):
    rng = random.Random(4)
    bases = [
        "http://a.b/c/d?e=f#g", "HTTP://A.b", "", "a/b", "/a/b", "mailto:x@y", "ftp://h/p;x", "http:/foo", "http:", "//h/p",
        "http://[bad", "x+y://h/p", "  http://a/b", "http://a\uff0fb/c", "file:///a/b", "http://a.b;p?q",
    ]
    parts = ["/", "//", "a", ".", "..", "/.", "/..", "?", "#", ";", ":", "%20", " ", "\t", "\n", "\x01", "\xa0", "é", "[", "]", "//h", "http:"]
    for _ in range(20_000):
        base, link = rng.choice(bases), "/" * rng.randint(0, 1) + "".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))
        try:
            joined = urljoin(base, link)
        except ValueError:
            joined = link
        source = {"payload": f'<a href="{link}">', "target_uri": base, "source_id": 1, "record_id": "r", "date": "d", "http_headers": "h"}
        assert f"outlink: {derivatives._one_line(joined)} L a/@href\r\n".encode() in derivatives.derive(source)[0]
    calls = []
    monkeypatch.setattr(derivatives, "urljoin", lambda *a: calls.append(a) or urljoin(*a))
    source |= {"payload": "".join(f'<a href="/w{i}/v.">' for i in range(1000)), "target_uri": "http://a.b/c"}
    about = derivatives.derive(source)[0]
    assert all(f"outlink: http://a.b/w{i}/v. L".encode() in about for i in range(1000)) and len(calls) < 10


def test_reading_a_file_copies_no_more_than_it_holds(tmp_path, monkeypatch):
    rng, given = random.Random(6), []
    blocks = [rng.randbytes(rng.choice([0, 10, 900, 9000])) for _ in range(600)]
    members = [gzip.compress(derivatives._record([("X", str(i))], b), 4, mtime=0) for i, b in enumerate(blocks)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(members))

    class Engine:
        def __init__(self, wbits):
            self.engine = zlib.decompressobj(wbits)

        def decompress(self, data):
            given.append(len(data))
            return self.engine.decompress(data)

        eof = property(lambda self: self.engine.eof)
        unused_data = property(lambda self: self.engine.unused_data)

    monkeypatch.setattr(derivatives, "zlib", types.SimpleNamespace(decompressobj=Engine))
    for chunk in (1 << 20, 1000):
        given.clear()
        got = list(derivatives.read_records(str(path), chunk=chunk))
        assert [g[2] for g in got] == blocks and [g[1]["X"] for g in got] == [str(i) for i in range(600)]
        assert [g[0] for g in got] == [sum(map(len, members[:i])) for i in range(600)]
        assert sum(given) < path.stat().st_size + 600 * 5000


def test_files_are_the_same_on_a_second_run(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    raw = []
    for _ in range(2):
        folder = shared_dir(spark, "test-warc")
        name = derivatives.write_derivatives(derivatives.page_responses(pages), folder).first().file
        raw.append(open_input(name).read())
    assert raw[0] == raw[1]


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _spans(text):
    out = []
    for kind, (name, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            good = {
                "email": True,
                "ip": name != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and doubled % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[name]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(2)
    parts = [
        "a", "@", ".", "-", "+", "1", "23", "255", "256", " ", "4", "(", ")", "0", "x@y.z", "1.2.3.4", "é",
        "+1 555 123 4567", "4111111111111111", "٣", "\n",
    ]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert personal.base_spans(text) == _spans(text), text


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("john at example dot com", "email", "john at example dot com"),
        ("é ｊohn@exаmple.com ok", "email", "ｊohn@exаmple.com"),
        ("jo(at)site.org!", "email", "jo(at)site.org"),
        ("pay four one one one 1111 one one one one one one one one end", "card", "four one one one 1111 one one one one one one one one"),
        ("call +1 five five five oh one two three four five six", "phone", "+1 five five five oh one two three four five six"),
        ("plus eins zwei drei vier fünf sechs sieben acht neun null", "phone", "plus eins zwei drei vier fünf sechs sieben acht neun null"),
        ("at 1 dot 2 dot 3 dot 4", "ip", "1 dot 2 dot 3 dot 4"),
        ("host １０.0.0.１", "ip", "１０.0.0.１"),
        ("4111​111111111111 x", "card", "4111​111111111111"),
        ("write to john at example.com, please", "email", "john at example.com"),
        ("john [at] example punkt com", "email", "john [at] example punkt com"),
        ("john at mail dot example dot org!", "email", "john at mail dot example dot org"),
        ("at 10 dot zero dot zero dot one", "ip", "10 dot zero dot zero dot one"),
        ("john @ example . com", "email", "john @ example . com"),
        ("john(a)example.com", "email", "john(a)example.com"),
        ("to jоhn@example.com", "email", "jоhn@example.com"),  # a Cyrillic letter: the base span begins after it
    ],
)
def test_disguises(text, kind, span):
    added = personal.added_spans(text, personal.base_spans(text))
    assert [(personal.KINDS[k], text[a:b]) for a, k, b in added] == [(kind, span)]


@pytest.mark.parametrize("text", ["is at home. dot", "look at this dot", "one two at three", "[at]", "see it at example.com", "meet me at home.then go", "item (a) second", "a . b", "we met at noon . then left", "a" + " " * 50_000 + "[at]"])
def test_no_disguise(text):
    assert personal.added_spans(text, []) == []


def test_long_chains_of_signs_take_linear_time():
    for part in (" at at dot", " @ a . com", " one dot", " (a) a.com", " at a.com.com", "1 dot "):
        personal.added_spans("x" + part * 50_000, [])


def test_personal_data_of_rows(spark, messy, no_docs):
    text = "x@y.zz or x [at] y [dot] zz, 10.0.0.1"
    extra = spark.createDataFrame([(500, text)], "doc_id long, text string")
    rows = personal.find_personal(messy.select("doc_id", "text").union(extra)).collect()
    assert len(rows) == messy.count() + 1
    row = next(r for r in rows if r.doc_id == 500)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone, row.n_added) == (1, 1, 0, 0, 1)
    assert row.spans == "email:0:6,email:10:27,ip:29:37"
    assert row.base_sha256 == hashlib.sha256(b"email:0:6,ip:29:37").hexdigest()
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == empty and r.spans == "" for r in rows if r.doc_id != 500)
    assert personal.find_personal(messy).count() == messy.count()
    assert personal.find_personal(no_docs).count() == 0
