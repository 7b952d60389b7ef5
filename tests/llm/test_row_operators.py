"""Operators that look at one row at a time: audio, language, secrets, main text, line field."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from polymere.llm import byte_cnn, guess_cost, line_crf, telephony, text_density

from .data import SAMPLE, SCHEMA, awkward, prose, with_clashes


# -- audio

def scalar_adpcm(data: bytes, block: int) -> list[int]:
    out = []
    for at in range(0, len(data), block):
        b = data[at : at + block]
        if len(b) < 4:
            continue
        value, index = int.from_bytes(b[:2], "little", signed=True), min(b[2], 88)
        out.append(value)
        for byte in b[4:]:
            for code in (byte & 15, byte >> 4):
                step = telephony.STEPS[index]
                diff = step >> 3
                for bit, part in ((1, step >> 2), (2, step >> 1), (4, step)):
                    diff += part if code & bit else 0
                value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
                index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
                out.append(value)
    return out


def scalar_resample(x: list[int], up: int, down: int) -> list[int]:
    offsets, taps = telephony.filter_bank(up, down)
    width = taps.shape[1] // 2
    out = []
    for m in range(math.ceil(len(x) * up / down)):
        base, p = m // up * down + offsets[m % up], m % up
        total = np.float32(0)
        for k in range(2 * width):
            i = base + 1 - width + k
            if taps[p][k]:
                total = np.float32(total + np.float32(taps[p][k] * np.float32(x[i] if 0 <= i < len(x) else 0)))
        out.append(int(max(-32768, min(32767, np.rint(total)))))
    return out


def test_adpcm_against_scalar_decoder():
    rng = random.Random(4)
    payloads = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 3, 4, 5, 31, 32, 33, 35, 36, 200)]
    got = telephony.decode_adpcm([np.frombuffer(p, np.uint8) for p in payloads], 32)
    assert [g.tolist() for g in got] == [scalar_adpcm(p, 32) for p in payloads]


def test_expansion_tables():
    assert telephony.EXPAND[[0x00, 0x80, 0xFF, 0x7F]].tolist() == [-32124, 32124, 0, 0]
    assert telephony.EXPAND[256 + np.array([0x55, 0xD5, 0x2A, 0xAA])].tolist() == [-8, 8, -32256, 32256]
    assert len(set(telephony.EXPAND[256:].tolist())) == 256


@pytest.mark.parametrize(("up", "down"), [(2, 1), (1, 2), (3, 4), (441, 80)])
def test_resampling_against_scalar_filter(up, down):
    rng = random.Random(5)
    signals = [[rng.randrange(-30000, 30000) for _ in range(n)] for n in (0, 1, 7, 50)]
    got = telephony.resample([np.array(s, np.int16) for s in signals], up, down)
    assert [g.tolist() for g in got] == [scalar_resample(s, up, down) for s in signals]


def test_store_pcm_on_awkward_rows(spark):
    df = with_clashes(spark.createDataFrame(awkward(), SCHEMA)).selectExpr("*", "case when lang = 'en' then 'mulaw' when lang = 'de' then 'ima_adpcm' when doc_id = 3 then 'opus' end as codec")
    rows = telephony.store_pcm(df, "doc_id", "text", "codec").collect()
    assert len(rows) == len(awkward())
    for r in rows:
        if r.codec not in telephony.CODECS or r.doc_id == 4:
            assert r.pcm is None and r.n_samples is None
        else:
            assert len(r.pcm) == 2 * r.n_samples
    by = {r.doc_id: r for r in rows}
    assert by[5].n_samples == 0 and bytes(by[5].pcm) == b""
    text = awkward()[0][1].encode()
    assert np.frombuffer(by[1].pcm, "<i2").tolist() == scalar_resample(telephony.EXPAND[np.frombuffer(text, np.uint8)].tolist(), 2, 1)
    assert telephony.store_pcm(df.limit(0), "doc_id", "text", "codec").count() == 0


# -- language

def test_network_gradients_by_differences():
    rng = np.random.default_rng(1)
    net = byte_cnn.Network(["a", "b", "c"])
    for name in ("e", "o", "c"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.f = {k: v.astype(np.float64) for k, v in net.f.items()}
    net.b = {k: v.astype(np.float64) for k, v in net.b.items()}
    x, y = rng.integers(97, 123, (6, byte_cnn.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        z = net.pooled(x)[0] @ net.o + net.c
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(6), y]))

    for v, g in zip(net.parameters(), net.gradients(x, y)):
        for _ in range(4):
            i = tuple(rng.integers(0, n) for n in v.shape)
            if v is net.e:
                i = (int(rng.integers(97, 123)), i[1])
            old = v[i]
            v[i] = old + 1e-5
            up = loss()
            v[i] = old - 1e-5
            down = loss()
            v[i] = old
            assert abs((up - down) / 2e-5 - g[i]) < 1e-4


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = byte_cnn.identify(docs, train_docs=300).filter("predicted is not null").collect()
    assert len(rows) > 990
    assert np.mean([r.lang == r.predicted for r in rows]) > 0.97


def test_network_against_a_plain_convolution():
    """One window at a time, one filter at a time, in Python's own numbers."""
    net = byte_cnn.fit([prose(60, 1), prose(60, 2)] * 3, ["a", "b"] * 3, epochs=1)
    data = prose(20, 9).encode()[: byte_cnn.WINDOW]
    w, _, _ = byte_cnn.windows_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    window = [int(b) for b in data] + [0] * (byte_cnn.WINDOW - len(data))
    pooled = []
    for width in byte_cnn.WIDTHS:
        for k in range(byte_cnn.FILTERS):
            top = max(sum(float(net.e[window[at + j], d]) * float(net.f[width][j * byte_cnn.EMBEDDING + d, k]) for j in range(width) for d in range(byte_cnn.EMBEDDING)) for at in range(byte_cnn.WINDOW - width + 1))
            pooled.append(max(0.0, top + float(net.b[width][k])))
    z = [sum(h * float(net.o[i, c]) for i, h in enumerate(pooled)) + float(net.c[c]) for c in range(2)]
    total = sum(math.exp(v) for v in z)
    assert net.probabilities(w)[0] == pytest.approx([math.exp(v) / total for v in z], abs=1e-4)


def test_strided_inference_equals_pooling_and_one_text_alone():
    texts = [prose(n, n) for n in (1, 30, 200)]
    net = byte_cnn.fit(texts * 3, ["a", "b", "c"] * 3, epochs=1)
    p, n = byte_cnn.classify(net, pa.array(texts))
    for i, t in enumerate(texts):
        q, m = byte_cnn.classify(net, pa.array([t]))
        assert np.allclose(p[i], q[0], atol=1e-6) and n[i] == m[0] == -(-len(t.encode()) // byte_cnn.WINDOW)
    w, _, _ = byte_cnn.windows_of(np.frombuffer(texts[2].encode(), np.uint8), np.array([0, len(texts[2].encode())]))
    z = net.pooled(w)[0] @ net.o + net.c
    z = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(z / z.sum(axis=1, keepdims=True), net.probabilities(w), atol=1e-5)


def test_language_on_awkward_rows(spark):
    df = with_clashes(spark.createDataFrame(awkward(), SCHEMA))
    rows = byte_cnn.identify(df).collect()
    assert len(rows) == len(awkward())
    assert all((r.predicted is None) == (r.n_windows == 0) for r in rows)
    assert byte_cnn.identify(df.limit(0)).count() == 0
    assert {r.predicted for r in byte_cnn.identify(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {None}


# -- secrets

def test_scan_finds_planted_values_only(spark):
    rows = [
        (1, 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y password: hunter2'), (2, "the token of the pass is gone"), (3, None), (None, "API_KEY='Zx81$kfQ0v!m2'"),
        (4, ""), (4, "pwd=abcd pwd=abcd"), (5, "password is changeme2024, and " + prose(50_000, 9) + " secret: " + "q9" * 3000),
    ]
    df = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {(r.doc_id, r.match): r for r in guess_cost.scan(df).collect()}
    assert sorted((k[0] or 0, k[1]) for k in got) == [(0, 0), (1, 0), (1, 1), (4, 0), (4, 1), (5, 0), (5, 1)]
    assert got[1, 0].secret and "".join(x.partition(":")[2] for x in got[1, 0].spans) == got[1, 0].value == "04dbebab91ab85687d33eeaaf9ac699e1188f962" and got[1, 0].context == "token"
    assert not got[1, 1].secret and got[1, 1].value == "hunter2"
    assert got[None, 0].value == "Zx81$kfQ0v!m2" and got[None, 0].secret
    assert got[5, 0].value == "changeme2024" and not got[5, 0].secret
    assert got[5, 1].spans == ["repeat:" + "q9" * 3000]
    assert guess_cost.scan(df.limit(0)).count() == 0


# -- main text

def naive_density(dom: text_density.Dom, i: int, body: int) -> float:
    def of(k):
        below = range(k + 1, dom.end[k])
        up = lambda n: n if dom.tag[n] == "a" else up(dom.parent[n]) if dom.parent[n] >= 0 else None
        c = sum(len(s.strip(" ")) for n, s in dom.texts if k <= n < dom.end[k])
        lc = sum(len(s.strip(" ")) for n, s in dom.texts if k <= n < dom.end[k] and up(n) is not None)
        return c, len(below), lc, sum(dom.tag[n] == "a" for n in below)

    c, t, lc, lt = of(i)
    if not c:
        return 0.0
    cb, _, lb, _ = of(body)
    t = max(1, t)
    base = math.log(c / max(1, c - lc) * lc + lb / max(1, cb) * c + math.e)
    return c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt))) / (math.log(base) if base > 1 else 1)


PAGE = "<html><head><title>T</title></head><body><nav><ul><li><a href=x>one</a><li><a href=y>two</a></ul></nav><!-- c --><div class='ad'>buy <a>now</a></div><article><h1>Head</h1><p>%s<p>%s &amp; more<br>end</article><script>var x='<p>';</script><footer>&copy; foot</footer></body></html>"


def test_density_against_definition():
    dom = text_density.Dom(PAGE % (prose(40, 1), prose(30, 2)))
    density, sums, _, body = text_density.measure(dom)
    assert density == pytest.approx([naive_density(dom, i, body) for i in range(len(dom.tag))])
    assert sums == pytest.approx([sum(density[k] for k in range(len(dom.tag)) if dom.parent[k] == i) for i in range(len(dom.tag))])


def test_main_text_is_the_article():
    text, nodes, _, _ = text_density.extract(PAGE % (prose(40, 1), prose(30, 2)))
    assert nodes == ["article#13"]
    assert text == "\n".join(["Head", prose(40, 1), prose(30, 2) + " & more", "end"])


def test_main_text_on_awkward_pages(spark):
    pages = [(1, "u", None), (2, "u", ""), (3, None, "<p>"), (None, "u", "no tags at all"), (5, "u", "</div></p><b>x"), (5, "u", "</div></p><b>x"), (6, "u", "<div>" * 3000 + "deep"), (7, "u", "<p>" + prose(100_000, 1)), (8, "u", "<a href='>'>t</a> < 5 & <3")]
    rows = text_density.main_text(with_clashes(spark.createDataFrame(pages, "page_id bigint, url string, html string"))).collect()
    by = {r.page_id: r for r in rows}
    assert len(rows) == len(pages)
    assert by[1].text is None and by[1].n_chars is None
    assert by[2].text == "" and by[2].nodes == [] and by[3].text == ""
    assert by[None].text == "no tags at all" and by[5].text == "x" and by[6].text == "deep" and by[7].text == prose(100_000, 1)
    assert text_density.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# -- line field

def brute_marginals(unary: np.ndarray, step: np.ndarray) -> np.ndarray:
    n = len(unary)
    p, total = np.zeros(n), 0.0
    for y in itertools.product((0, 1), repeat=n):
        w = math.exp(sum(u for u, v in zip(unary, y) if v) + sum(step[a, b] for a, b in zip(y, y[1:])))
        total += w
        p += w * np.array(y)
    return p / total


def test_marginals_against_all_labelings():
    rng = np.random.default_rng(2)
    step = rng.normal(size=(2, 2))
    sizes = [1, 4, 2, 7, 1]
    first = np.concatenate([[0], np.cumsum(sizes)])
    unary = rng.normal(size=first[-1])
    left, right = line_crf.forward_backward(unary, first, step)
    got = 1 / (1 + np.exp(-left - right))
    for a, b in zip(first[:-1], first[1:]):
        assert got[a:b] == pytest.approx(brute_marginals(unary[a:b], step))


def test_line_features_see_lines_and_neighbours():
    texts = ["One two.\nTHREE!!\n", "", "x\n\ny", "\n"]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    x, size, first = line_crf.line_features(np.frombuffer(data, np.uint8), offsets)
    assert size.tolist() == [len(line) for t in texts for line in t.split("\n")]
    assert np.diff(first).tolist() == [t.count("\n") + 1 for t in texts]
    own = line_crf.OWN
    assert (x[0, 2 * own : 3 * own] == x[1, :own]).all() and (x[1, own : 2 * own] == x[0, :own]).all()
    assert not x[first[1:] - 1, 2 * own : 3 * own].any() and not x[first[:-1], own : 2 * own].any()


def test_line_labels_are_the_marginals():
    rng = np.random.default_rng(3)
    weights, step = rng.normal(size=line_crf.FEATURES), rng.normal(size=(2, 2))
    texts = ["One two.\nTHREE!!\n", "x\n\ny", None, "", "a b c d\n!!! ###"]
    q, n, labels = line_crf.quality_of(pa.array(texts), weights, step)
    for t, quality, k, got in zip(texts, q, n, labels.to_pylist()):
        if t is None:
            assert got is None and np.isnan(quality) and k == 0
            continue
        x, size, _ = line_crf.line_features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        p = brute_marginals(x @ weights.astype(np.float32), step)
        assert got == "".join("1" if v >= 0.5 else "0" for v in p)
        assert quality == pytest.approx(float(p @ size / size.sum()) if size.sum() else 0.0, abs=1e-5)


def test_held_out_accuracy():
    import duckdb

    rows = duckdb.connect().sql("select text, quality from '/root/testdata/sf0.01/documents.parquet' join '/root/testdata/sf0.01/labels.parquet' using (doc_id) order by doc_id").fetchall()
    model = line_crf.fit([r[0] for r in rows[::2]], [r[1] for r in rows[::2]])
    q, _, _ = line_crf.quality_of(pa.array([r[0] for r in rows[1::2]]), *model)
    y = np.array([r[1] for r in rows[1::2]])
    assert (q[y == 1] >= 0.5).mean() > 0.97 and (q[y == 0] < 0.5).mean() > 0.8


def test_field_on_awkward_rows(spark):
    df = with_clashes(spark.createDataFrame(awkward(), SCHEMA))
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, None), (2, None, 0), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = line_crf.score(df, labels).collect()
    assert len(rows) == len(awkward())
    by = {r.doc_id: r for r in rows}
    assert by[4].quality is None and not by[4].keep and by[4].n_lines == 0
    assert by[5].quality == 0 and not by[5].keep and by[7].n_lines == 4
    assert by[4].line_labels is None and all(len(r.line_labels or "") == r.n_lines for r in rows)
    kept = line_crf.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.keep for r in rows)
    assert {r.quality for r in line_crf.score(df, labels.limit(0)).filter("n_lines > 0").collect()} <= {0.0, 0.5}
    assert line_crf.score(df.limit(0), labels).count() == 0


def test_queries_cover_their_tables(spark):
    from polymere.llm.queries import QUERIES

    n = spark.read.parquet(f"{SAMPLE}/documents.parquet").count()
    for name in ("op1_telephony_pcm", "op2_byte_cnn_language", "op6_line_crf_quality"):
        assert QUERIES[name](spark, SAMPLE).count() == n
    assert QUERIES["op5_text_density"](spark, SAMPLE).count() == spark.read.parquet(f"{SAMPLE}/pages.parquet").count()
