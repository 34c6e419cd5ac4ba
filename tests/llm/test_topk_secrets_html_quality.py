from __future__ import annotations

import base64
import gzip
import random
import re
import urllib.parse
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolith.llm import html_extract, quality, secret_scan, topk


def test_top_k_is_exact_with_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "ROWS", 50)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(300)] + [(i, [0.1] * 8) for i in range(300, 340)]
    rows += [(400, None), (420, [None] * 8), (440, [float("nan")] * 8), (460, [float("inf")] + [0.0] * 7), (None, [0.5] * 8)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, rank string, score int")
    v = frame.select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    found = sorted(map(tuple, topk.top_k(v.where("vec_id % 20 = 0"), v, 5).collect()))
    good = {i: np.floor(64 * np.array(e, np.float32).astype(float)) for i, e in rows[:340]}
    want = []
    for q in sorted(i for i in good if i % 20 == 0):
        best = sorted((-int(good[q] @ x), i) for i, x in good.items() if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert found == sorted(want)
    assert topk.top_k(v.limit(0), v, 5).count() == topk.top_k(v, v.limit(0), 5).count() == 0
    assert topk.top_k(v.where("vec_id = 0"), v.where("vec_id < 3"), 5).count() == 2


@pytest.mark.parametrize("size", [1e5, 1e6, 1e12, 1e300])
def test_large_components_are_summed_exactly(spark, size):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.uniform(-size, size, 8)]) for i in range(120)] + [(60, [size] * 3), (61, [size])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    asked = v.where("vec_id % 20 = 0 and vec_id <> 60")
    whole = [(r["vec_id"], list(r["v"]) + [0] * (8 - len(r["v"]))) for r in v.collect()]
    want = []
    for q, x in whole:
        if q % 20 == 0 and q != 60:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in whole if i != q)[:4]
            want += [(q, k, i, min(max(-s, -(2**63)), 2**63 - 1)) for k, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, topk.top_k(asked, v, 4).collect())) == sorted(want)


def test_bounds_spare_most_candidates():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (20, 16)).astype(float)
    rows = centres[rng.integers(0, 20, 4000)] + rng.integers(-3, 4, (4000, 16))
    search = topk.Search(np.array([-1]), rows[:1], topk._far_apart(rows[:300], 24), 5)
    search.add(np.arange(4000), rows)
    assert search.evaluated < 2500
    assert search.best[0][0].tolist() == sorted((rows @ rows[0]).tolist(), reverse=True)[:5]


SECRET = "password = hunter2hunter2"


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
        lambda s: base64.b64encode(base64.b64encode(s.encode())).decode(),
        lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
        lambda s: base64.b64encode(zlib.compress(gzip.compress(s.encode()))).decode(),
        lambda s: urllib.parse.quote(s, safe=""),
        lambda s: "".join(f"%{b:02X}" for b in s.encode()),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: "".join(f"&#{ord(c)};" for c in s),
        lambda s: base64.encodebytes(gzip.compress((s + " x" * 90).encode())).decode().strip(),
        lambda s: base64.encodebytes((" y" * 60 + s + " x" * 90).encode()).decode().strip(),
        lambda s: "x/" + base64.b64encode(s.encode()).decode(),
        lambda s: "path/to/some/file/" + base64.b64encode(s.encode()).decode(),
        lambda s: base64.b64encode(s.encode("utf-16")).decode(),
        lambda s: base64.b64encode(gzip.compress(b"first") + gzip.compress(s.encode())).decode(),
        lambda s: base64.b64encode(b"\x01\x02" + s.encode() + b"\xff\x00").decode(),
        lambda s: base64.b64encode(b"\x00head" + zlib.compress(s.encode("utf-16-be"))).decode(),
        lambda s: urllib.parse.quote(base64.b64encode("".join(f"\\x{ord(c):02x}" for c in s).encode()).decode(), safe=""),
    ],
)
def test_wrapped_secrets_map_to_where_they_stand(wrap):
    wrapped = wrap(SECRET)
    text = f"é before {wrapped} after"
    base, every = secret_scan.scan(text)
    extra = [x for x in every if x not in base and x[1] == 0]
    assert extra
    for start, _, end in extra:
        assert 9 <= start < end <= 9 + len(wrapped)


def test_base_spans_are_those_of_the_contract():
    rng = random.Random(2)
    patterns = [r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "(AKIA[A-Z0-9]+)", "([0-9a-f]+)"]
    for _ in range(300):
        text = "".join(rng.choice(["password", "ToKen", "api_key", "APIKEY", "secret", '"', "'", " ", "=", ":", "\n", "AKIA", "B" * 9, "0f" * 9, "é", "\u017f", "abcdefg", "h"]) for _ in range(25))
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, text, re.A) if len(m[1]) >= (8, 16, 32)[k])
        assert secret_scan.base_spans(text) == want


def test_long_unpacked_layers_come_in_pieces(monkeypatch):
    monkeypatch.setattr(secret_scan, "PIECE", 4096)
    monkeypatch.setattr(secret_scan, "OVERLAP", 256)
    rng = random.Random(1)
    noise = " ".join(str(rng.random()) for _ in range(3000))
    for at in (0, 4090, 20_000, len(noise)):
        packed = base64.b64encode(gzip.compress((noise[:at] + " " + SECRET + " " + noise[at:]).encode())).decode()
        assert [x for x in secret_scan.scan(f"a {packed} b")[1] if x[1] == 0] == [(2, 0, 2 + len(packed))]


def test_plain_secrets():
    key = "AKIA" + "B" * 12
    text = f"""Token: "abcdefgh" token=short {"0f" * 16} {key} API_KEY='{"x" * 8}' {"a" * 31} AKIASHORT"""
    base, every = secret_scan.scan(text)
    assert [(secret_scan.KINDS[k], text[a:z]) for a, k, z in base] == [("assign", 'Token: "abcdefgh'), ("hex", "0f" * 16), ("access", key), ("assign", "API_KEY='" + "x" * 8)]
    assert set(base) <= set(every)


def test_layers_that_lead_to_themselves_end():
    assert secret_scan.scan("%2525252541" * 50 + "&amp;amp;amp;" * 20)[0] == []
    assert secret_scan.scan("%" * 1000 + "\\u" * 1000 + "A" * 5000 + "=" * 9)[1] == []


def test_secrets_of_odd_rows(spark):
    frame = spark.createDataFrame([(1, None, 0), (None, "token=abcdefgh", 0), (1, "", 0)], "doc_id long, text string, base int")
    found = {(r["doc_id"], r["n_assign"], r["spans"]) for r in secret_scan.digest(secret_scan.secrets(frame)).collect()}
    assert found == {(1, 0, ""), (None, 1, "assign:0:14")}
    assert secret_scan.secrets(frame.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="<p>no</p>";</script></head><body class="ad-free">
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><header>Site</header>
<article class="post"><header><h1>Title &amp; more</h1></header><p title="a > b">First  line<br>second&nbsp;line
<p>Third <b>bold</b> and <a href=x>link</a>.</p><aside>Related</aside><!-- gone --><div class="advert">Buy</div><p>Last.</p></article>
<section id="comments"><p>Nice article, I liked it a lot, thanks for it</p></section><form><p>Mail</p></form><footer>&copy; me</footer></body></html>"""


def test_article_of_a_page():
    assert html_extract.extract(PAGE) == "Title & more\nFirst line\nsecond line\nThird bold and link.\nLast."


def test_pages_that_mark_no_article():
    body = "".join(f"<p>{'Some words of an article stand here. ' * 4}</p>" for _ in range(4))
    page = f"<body><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul><div>{body}</div><div class=footer><p>End</p></div></body>"
    assert html_extract.extract(page).count("\n") == 3
    assert html_extract.extract("<p>tiny</p>") == "tiny"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><h1>Head</h1><p>One short paragraph.</p></body>", "Head\nOne short paragraph."),
        ('<article><p>First.</p><section class="related-work"><p>Others did.</p></section><div id="notice-period"><p>Three months.</p></div></article>', "First.\nOthers did.\nThree months."),
        ("<body><p>See <a href=x>the long documentation of this library</a>.</p></body>", "See the long documentation of this library."),
        ('<main><p>Text.</p></main><article class="comment"><p>I liked it.</p></article>', "Text."),
        ("<article><p>One.</p><aside>a</aside><aside>b</aside><aside>c</aside><aside>d</aside><p>Two.</p></article>", "One.\nTwo."),
    ],
)
def test_short_pages_and_names_within_articles(page, text):
    assert html_extract.extract(page) == text


def test_spans_lie_between_surges_and_dives_as_by_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        weights = np.array([rng.choice([0, 0, 0, 5, 40, 200]) for _ in range(rng.randint(1, 30))])
        sums = [sum(weights[i : i + 3]) for i in range(len(weights))]
        level, want, i = min(86, max(sums) / 2), set(), 0
        while i < len(sums):
            j = i
            while j < len(sums) and sums[j] > 0:
                j += 1
            if any(s > level for s in sums[i:j]):
                want |= set(range(i, j))
            i = j + 1
        assert {i for a, z in html_extract.spans_of(weights, 3, 86) for i in range(a, z)} == want


def test_distribution_decides_on_pages_without_marks():
    rows = "".join(f"<tr><td><a href=/{i}>Page {i}</a></td></tr>" for i in range(9))
    page = f"<body><table>{rows}<tr><td>by us</td></tr>{rows}</table><div>{'<p>Some words of an article stand here.</p>' * 9}</div><table>{rows}</table><p>End</p></body>"
    assert html_extract.extract(page).split("\n") == ["Some words of an article stand here."] * 9
    assert "by us" in html_extract.extract(page, surge=0)


@pytest.mark.parametrize("page", [None, "", "plain", "<", "<p", "<!--", "<script>", "<nav>x", '<a href="', "</p></p>", "<article>", "a" * 100_000 + "<b", "<div>" * 3000])
def test_broken_pages(page):
    assert isinstance(html_extract.extract(page), str)


def test_pages_as_a_table(spark):
    frame = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, None), (1, "u", "", "x")], "page_id long, url string, html string, text string")
    found = html_extract.main_texts(frame).collect()
    assert sorted(r["n_chars"] for r in found) == [0, 0, len(html_extract.extract(PAGE))]
    assert html_extract.main_texts(frame.limit(0)).count() == 0


def documents(n):
    rng = random.Random(0)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(["the", "of", "river", "water", "stone"]) + rng.choice("abcdefgh") for _ in range(rng.randint(5, 80))]
        good = rng.random() < 0.7
        text = " ".join(words) + "." if good else rng.choice([" ".join(w.upper() + "!!" for w in words), " ".join([words[0]] * 50), " ".join(w + "%%%" for w in words)])
        docs.append((i, text, "x"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_quality_of_held_out_documents(spark):
    docs, labels = documents(600)
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.scores(d, known).collect()}
    held = [i for i, r in found.items() if r["held_out"]]
    assert 150 < len(held) < 250
    assert np.mean([found[i]["predicted"] == labels[i][1] for i in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())
    flipped = spark.createDataFrame([(i, q if not found[i]["held_out"] else 1 - q, 0) for i, q, _ in labels], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["score"] for r in quality.scores(d, flipped).collect()} == pytest.approx({i: r["score"] for i, r in found.items()})
    kept = {r["doc_id"] for r in quality.keep_good(d, known).collect()}
    assert kept == {i for i, r in found.items() if r["predicted"] == 1}


def test_quality_of_odd_rows(spark):
    d = spark.createDataFrame([(None, "a", "x"), (1, None, "x"), (1, "", "x"), (2, "b " * 30000, "x")], "doc_id long, text string, x string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = quality.scores(d, none).collect()
    assert len(found) == 4
    assert all(abs(r["score"] - 0.5) < 0.01 for r in found)
    assert quality.scores(d.limit(0), none).count() == 0


def test_isotonic_blocks_rise():
    rng = np.random.default_rng(2)
    n = rng.integers(1, 9, 50).astype(float)
    p = np.floor(n * np.clip(np.linspace(0, 1, 50) + rng.normal(0, 0.3, 50), 0, 1))
    x, y = quality.isotonic(np.arange(50.0), n, p)
    assert (np.diff(y) > 0).all() and (np.diff(x) > 0).all()
