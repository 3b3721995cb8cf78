"""The ten operators against brute force, round trips and edge cases."""

import collections
import math
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import arrays, boosting, decontamination, dom, exchange, html_extraction, language_id, language_model, mixing, near_duplicates, permutation_index, pretokens, quality, queries, token_counts, token_output

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [(1, None, "en", "a", 0), (2, "", None, None, 0), (2, "", None, None, 0), (None, "alpha beta", "en", "b", 1), (3, "x " * 30_000, "fr", "a", 1), (4, "é😀 <|endoftext|>\x00　", "de", "b", 9), (5, "123 !", "en", None, 5)]


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def prose(r, n, words=400):
    return " ".join(f"w{int(words * r.random() ** 2)}" for _ in range(n))


def corpus(seed=5, n=60):
    r = random.Random(seed)
    texts = [prose(r, r.choice((3, 12, 60, 120))) for _ in range(n)]
    for _ in range(n // 2):
        words = r.choice(texts).split(" ")
        for _ in range(r.choice((0, 0, 1, 2, 6))):
            words[r.randrange(len(words))] = f"E{r.randrange(99)}"
        texts.append(" ".join(words))
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def edge_docs(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# shared pieces


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \t\nAbzÉ9.-ß😀", max_size=30), min_size=1, max_size=6))
def test_words(texts):
    data, offsets = arrays.buffers(pa.array(texts))
    for kind, pattern in ((arrays.SPACED, SPACED), (arrays.ALNUM, ALNUM)):
        start, end, hashes, by_doc = arrays.words(data, offsets, kind)
        expected = [pattern.findall(lower(t)) for t in texts]
        assert np.diff(by_doc).tolist() == [len(e) for e in expected]
        assert lower(data.tobytes()[start[0] : end[0]].decode()) == expected[next(i for i, e in enumerate(expected) if e)][0] if len(start) else True
        seen = {}
        assert all(seen.setdefault(w, h) == h for w, h in zip((w for e in expected for w in e), hashes.tolist()))
        assert len(set(seen.values())) == len(seen)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab 1'sré\n\t ！…tvd<|>😀", max_size=25), min_size=1, max_size=5))
def test_pretokens_are_the_librarys(texts):
    texts = [*texts, "it's <|endoftext|> we'll\n 's"]
    pieces = pretokens.Pieces(BPE)
    ids, sizes = token_output.encode_texts(pa.array(texts), pieces, BPE, 0)
    expected = [e.ids + [0] for e in pretokens.tokenizer(BPE).encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for e in expected for i in e] and sizes.tolist() == [len(e) for e in expected]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packed_numbers(x):
    assert exchange.unpack_numbers(exchange.pack_numbers(np.array(x, np.uint64))).tolist() == x


# 1 mixing


def test_mixing(spark, edge_docs):
    r = random.Random(2)
    docs = [(i, prose(r, r.choice((5, 20, 80))), "en", r.choice("aaaabc") if i % 9 else None, 0) for i in range(300)]
    got = mixing.mix_sources(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(got) == 300
    total, by = sum(x.size for x in got), collections.defaultdict(list)
    for x in got:
        assert x.taken == x.copies * x.size <= 3 * x.size
        by[x.source].append(x)
    names = sorted(k for k in by if k is not None) + [None]
    sizes, weight, capped = {k: sum(x.size for x in by[k]) for k in names}, {k: (1, 2, 3)[i % 3] for i, k in enumerate(names)}, set()
    while True:
        rest, w = total - sum(3 * sizes[k] for k in capped), sum(weight[k] for k in names if k not in capped)
        more = {k for k in names if k not in capped and rest * weight[k] / w > 3 * sizes[k]}
        if not more:
            break
        capped |= more
    for k in names:
        target = 3 * sizes[k] if k in capped else rest * weight[k] / w
        assert by[k][0].source_size == sizes[k] and abs(by[k][0].target - target) < 1e-6
        assert abs(sum(x.taken for x in by[k]) - target) <= 80
    edge = mixing.mix_sources(edge_docs).collect()
    assert len(edge) == len(EDGES) and all(x.taken <= 3 * x.size for x in edge)


def test_rates_are_the_duals(spark):
    r = random.Random(9)
    data = [(s, r.choice((1, 3, 10, 50, 400))) for s in ("a", "b", None) for _ in range(80)]
    sized = spark.createDataFrame(data, "source string, size long")
    targets = mixing.source_targets(sized, (1, 2, 3), 3)
    goal = {x.source: (x.source_size, x.target) for x in targets.collect()}
    for x in mixing.entropy_balance(sized, targets, 3.0).collect():
        sizes = [n for s, n in data if s == x.source]
        assert math.isclose(x.mean, sum(sizes) / len(sizes))
        if x.tilt is None:
            assert math.isclose(goal[x.source][1], 3 * goal[x.source][0])
        else:  # the rates that the dual gives meet the token constraint
            assert math.isclose(sum(n * min(3.0, math.exp(x.tilt * n / x.mean)) for n in sizes), goal[x.source][1], rel_tol=1e-8)


def test_mixed_rows_are_the_copies(spark, edge_docs):
    docs = spark.createDataFrame([(i, t, "en", "abc"[i % 3], 0) for i, t in corpus(31, 60)], SCHEMA).unionByName(edge_docs).selectExpr("*", "n_chars as copies", "doc_id as `x.y`")
    copies = {(r.doc_id, r.size, r.source): r.copies for r in mixing.mix_sources(docs).collect()}
    got = collections.Counter((r.doc_id, len(SPACED.findall(r.text or "")), r.source) for r in mixing.mixed_rows(docs).collect())
    repeated = collections.Counter((r.doc_id, len(SPACED.findall(r.text or "")), r.source) for r in docs.collect())
    assert {k: copies[k] * n for k, n in repeated.items() if copies[k]} == dict(got)
    assert mixing.mixed_rows(docs).columns == docs.columns and mixing.mix_sources(docs.limit(0)).count() == mixing.mixed_rows(docs.limit(0)).count() == 0


# 2 extraction


def test_extraction(spark):
    forest = html_extraction.train(250)
    page = """<html><head><title>t</title><script>if (a < b) "</p>"</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice"><p>We use cookies. Fine, really.</p></div>
    <article><h1>A title&nbsp;here</h1><p>First <b>bold</b>&amp; text,\n with   space.<p>Second one &lt;ok&gt;, with a <a href=x>link</a>.</article>
    <section id="comments"><h3>Comments</h3><div class="comment"><p>I disagree, of course.</p></div></section><aside class="sidebar"><p>Other things, listed.</p></aside><form><input><p>Subscribe now.</p></form><footer><p>&copy; all of us.</p></footer></body></html>"""
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "u", ""), (3, "u", "<<<>&amp; <p"), (3, "u", "<div>" * 3000 + "deep")], "page_id long, url string, html string")
    got = {(x.page_id, x.n_chars): x.text for x in html_extraction.extract(df, forest).collect()}
    text = "A title here First bold& text, with space. Second one <ok>, with a link."
    assert got[(1, len(text))] == text and got[(2, 0)] == "" and got[(None, 0)] == ""
    r, right = random.Random(77), 0
    for _ in range(80):
        source, kept = html_extraction.training_page(r)
        words, expected = html_extraction.main_text(dom.read(source), forest).split(), " ".join(kept).split()
        common = sum((collections.Counter(words) & collections.Counter(expected)).values())
        right += common >= 0.95 * max(len(words), len(expected))
    assert right >= 70
    assert html_extraction.extract(df.limit(0), forest).count() == 0


def test_decoding_is_consistent():
    page = dom.read("<body><div><p>one two</p><div><p>three four five</p></div></div></body>")
    chosen = html_extraction.decode(page, np.array([0.1, 0.1, 0.05, 0.9, 0.1, 0.9][: len(page.blocks)]))
    for i, b in enumerate(page.blocks):
        if chosen[i] and b.parent >= 0 and not chosen[b.parent]:
            assert not any(chosen[j] for j in range(i) if j == b.parent)


@pytest.mark.parametrize("source", ["<head><title>t</title><body><p>one two</p>", "<head><meta name=a><p>one two</p>", "<head><style>x</style>one two", '<p aria-hidden="false">one two</p>', '<p title="hidden gem">one two</p>', "<p data-style='display:none'>one two</p>"])
def test_text_is_not_taken_for_hidden(source):
    assert dom.read(source).runs == ["one two"]


@pytest.mark.parametrize(
    "source, runs",
    [
        ('<a href="/hidden/page">this link</a> stays', ["this link stays"]),
        ("<p>say <math><mi>x</mi><mo>=</mo><mn>2</mn></math> now<noscript> and then</noscript>", ["say x=2 now", "and then"]),
        ("<p a=\"1>2\" b='x>y'>t</p>", ["t"]),
        ("<p>a <3 b, c < d</p>e<!-- x>y -->f<br>g", ["a <3 b, c < d", "ef g"]),
        ("<p>open <b class='x", ["open <b class='x"]),
        ("<ul><li>one<li>two</ul><p>three<div>four", ["one", "two", "three", "four"]),
        ('x "quoted > text" y <i a=">b</i> c', ['x "quoted > text" y b c']),
    ],
)
def test_reading(source, runs):
    assert dom.read(source).runs == runs


@pytest.mark.parametrize("source", ["<p " * 350_000, "<p>" + "x <b " * 200_000, "<div>" * 30_000, "<p>some words</p>" * 20_000, '<b "' * 250_000, "<b a='\">" * 120_000, "<div>" * 20_000 + "</section>" * 20_000])
def test_long_pages_take_linear_time(source):
    began = time.perf_counter()
    html_extraction.features(dom.read(source))
    assert time.perf_counter() - began < 5


def test_a_page_written_by_hand():
    page = """<html><head><title>T</title></head><body><div id="top-menu"><a href="/">Home</a> <a href="/n">News</a></div>
    <div class="cookie-banner">We use cookies. <button>Fine</button></div><div id="content"><h1>Rain in the hills</h1>
    <p>It rained for three days, and on the fourth the river rose over the road that leads to the village.</p>
    <p>People moved upstairs &amp; waited; nobody was hurt, the mayor said, but the mill lost its wheel.</p></div>
    <div class="sidebar"><h3>More</h3><ul><li><a href="/a">Snow</a></li><li><a href="/b">Wind</a></li></ul></div>
    <div class="comments"><div class="comment"><p>I was there and it was worse than this.</p></div></div><footer>(c) The Paper</footer></body></html>"""
    assert html_extraction.main_text(dom.read(page), html_extraction.train()) == (
        "Rain in the hills It rained for three days, and on the fourth the river rose over the road that leads to the village. "
        "People moved upstairs & waited; nobody was hurt, the mayor said, but the mill lost its wheel."
    )


def test_hidden_text_goes():
    assert dom.read("<head>\n<title>t</title>\n</head><p hidden>a</p><p title=x hidden=''>b</p><p style='display: none'>c</p><P CLASS=Big>d</P>").runs == ["d"]


def test_boosting():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((boosting.boost(x, y).probability(x) > 0.5) == y).mean() > 0.95


# 3 and 9 tokens


def test_token_counts(spark, edge_docs):
    tk = pretokens.tokenizer(BPE)
    ids = lambda t: tk.encode(t or "", add_special_tokens=False).ids
    got = rows(token_counts.token_counts(edge_docs, BPE))
    assert got == sorted(((d, len((t or "").encode()), len(ids(t)), len(ids(t)) > 512) for d, t, *_ in EDGES), key=str)
    assert token_counts.token_counts(edge_docs.limit(0), BPE).count() == 0


@pytest.mark.parametrize("planes", [4, 32])
def test_token_output(spark, edge_docs, planes, tmp_path):
    tk, start, expected = pretokens.tokenizer(BPE), 0, []
    for d, t, *_ in sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [0]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(token_output.token_output(edge_docs, BPE, str(tmp_path / "t"), planes=planes)) == sorted(expected, key=str)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from([4, 32]))
def test_plane_files(ids, planes):
    cut = len(ids) // 3
    data = token_output.encode_file(np.array(ids, np.uint32), np.array([cut, len(ids) - cut]), [7, None], planes)
    back, lengths, names = token_output.decode_file(data)
    assert back.tolist() == ids and lengths.tolist() == [cut, len(ids) - cut] and names == [7, None]
    with pytest.raises(Exception):
        token_output.decode_file(data[:-1])


# 4 nearest neighbours


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16))
    x[20:60] = x[20]
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*data, (5000, None), (5001, [0.0] * 16), (5100, [float("nan")] + [1.0] * 15), (5200, [None] + [1.0] * 15), (None, [1.0] * 16), (5300, [1.0] * 3)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in permutation_index.nearest(df, df["vec_id"] % 20 == 0, n_pivots=64, prefix=32, share=0.3, block=400).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    x = x.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 700, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = sorted((d[i], i) for i in range(700) if i != q)[:10]
        mine = sorted(got[q])
        assert len(mine) == 10 and all(abs(d[v] - s) < 1e-9 for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & {v for _, v in best})
    assert hits / 350 >= 0.9 and set(got) == set(range(0, 700, 20))
    assert [v for _, v, _ in sorted(got[20])] == list(range(21, 31)) and [v for _, v, _ in sorted(got[40])] == list(range(20, 30))
    assert permutation_index.nearest(df.limit(0), df["vec_id"] > 0).count() == 0


@pytest.mark.parametrize("step", [0.0, 1e-3])
def test_nearest_beside_a_large_group(spark, step):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(1800, 32))
    x /= np.sqrt((x * x).sum(1))[:, None]
    x[1200:] = x[1200] + step * rng.normal(size=(600, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in permutation_index.nearest(df, df["vec_id"] % 40 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    for q in range(0, 1800, 40):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert [v for _, v in sorted(got[q])] == [i for _, i in sorted((d[i], i) for i in range(1800) if i != q)[:10]]


# 5 quality


def test_quality(spark, edge_docs):
    r = random.Random(8)
    docs = [(i, prose(r, 60) if i % 3 else " ".join(["### $$$ w1"] * 30), "en", "s", 0) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 240)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(spark.createDataFrame(docs, SCHEMA).unionByName(edge_docs.selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars")), labels).collect()
    assert len(got) == 240 + len(EDGES) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 240]
    assert held and all(zlib.crc32(str(x.doc_id).encode()) % 5 == 0 for x in held)
    assert sum(x.predicted == (x.doc_id % 3 > 0) for x in held) >= 0.95 * len(held)
    assert quality.quality_scores(edge_docs, labels.limit(0)).count() == len(EDGES)


def test_quality_learns_from_every_label(spark):
    """Documents of label 0 are those whose ids have the greatest hashes: a sample by hash has none of them."""
    ids = spark.range(9000).selectExpr("id", "row_number() over (order by xxhash64(id) desc) <= 300 as junk").toArrow().to_pydict()
    junk = dict(zip(ids["id"], ids["junk"]))
    r = random.Random(9)
    docs = spark.createDataFrame([(i, "### $$$ w1 w1 $$$" if bad else prose(r, 8), "en", "s", 0) for i, bad in junk.items()], SCHEMA)
    labels = spark.createDataFrame([(i, int(not bad), 0) for i, bad in junk.items()], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.predicted for x in quality.quality_scores(docs, labels).collect()}
    assert got == {i: int(not bad) for i, bad in junk.items()}


def test_quality_meets_all_pairs(spark):
    rng = np.random.default_rng(4)
    width = quality.features(pa.array([""], pa.large_string())).shape[1]
    x = (rng.normal(size=(400, width)) * (np.arange(width) < 20)).astype(np.float32)
    good = (rng.random(400) < 1 / (1 + np.exp(-x[:, :4].sum(1)))).astype(np.int64) * rng.integers(1, 4, 400)
    bad = np.where(good == 0, rng.integers(1, 3, 400), rng.integers(0, 2, 400))
    blocks = spark.createDataFrame([tuple(bytearray(np.ascontiguousarray(a[i : i + 90]).tobytes()) for a in (x, good, bad)) for i in range(0, 400, 90)], "x binary, good binary, bad binary").repartition(3)
    learned = quality.learn(blocks)
    weight = (good + bad)[:, None]
    middle = (weight * x).sum(0) / weight.sum()
    assert np.allclose(learned.middle, middle, atol=1e-5) and np.allclose(learned.scale, np.sqrt((weight * (x - middle) ** 2).sum(0) / weight.sum()) + 1e-3, atol=1e-5)
    z, s = quality.standardised(x, learned.middle, learned.scale), learned.raw(x)
    lost = 1 / (1 + np.exp(s[:, None] - s)) * np.outer(good, bad) / (good.sum() * bad.sum())  # row: label 1, column: label 0
    slope = (lost.sum(0) - lost.sum(1)) @ z + 3e-4 * learned.weights
    assert np.linalg.norm(slope) < 0.01 * np.linalg.norm((bad / bad.sum() - good / good.sum()) @ z)
    loss, first, loses, wins = quality.met(*quality.on_nodes(s, good, bad))
    assert abs(loss - (np.logaddexp(0, s - s[:, None]) * np.outer(good, bad)).sum() / (good.sum() * bad.sum())) < 1e-4
    node = np.arange(first, first + len(loses)) / quality.NODES
    assert np.allclose(np.interp(s, node, loses) * good / good.sum(), lost.sum(1), atol=1e-6) and np.allclose(np.interp(s, node, wins) * bad / bad.sum(), lost.sum(0), atol=1e-6)
    right = [good[s >= c].sum() / good.sum() + bad[s < c].sum() / bad.sum() for c in (learned.cut, *s)]
    assert right[0] >= max(right) - 0.01


# 6 decontamination


def brute_contamination(docs, items):
    out = []
    for d, t in docs:
        w = ALNUM.findall(lower(t))
        hit, names = set(), set()
        for item, text in items:
            v = ALNUM.findall(lower(text))
            k = min(13, len(v))
            grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
            for i in range(len(w) - k + 1) if k else ():
                if tuple(w[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    names.add(str(item))
        out.append((d, len(w), len(hit), len(names), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_broadcast", [10**6, 0])
def test_decontamination(spark, most_broadcast):
    r = random.Random(6)
    items = [(i, prose(r, n, 5000)) for i, n in enumerate((40, 30, 13, 14, 5, 12, 1, 0, 25))] + [(9, "zz zz zz " * 9)]
    docs = [(1, None), (2, ""), (None, items[0][1])]
    for i in range(40):
        words = prose(r, r.choice((10, 80, 300)), 5000).split()
        for _ in range(r.randrange(3)):
            part = r.choice(items)[1].split()
            a = r.randrange(max(1, len(part)))
            words[r.randrange(len(words)) : 0] = part[a : a + r.choice((5, 12, 13, 20, 60))]
        docs.append((i + 10, " ".join(words)))
    docs += [(90, "ZZ, " * 50), (91, items[5][1].upper().replace(" ", "--")), (91, items[3][1])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (None, "q"), (77, None)], "item_id long, text string")
    got = sorted(((x.doc_id, x.n_words, x.n_hit, x.n_items, x.contaminated) for x in decontamination.decontaminate(df, bench, most_broadcast=most_broadcast).collect()), key=str)
    assert got == brute_contamination(docs, items)
    assert decontamination.decontaminate(df, bench.limit(0)).where("n_hit > 0").count() == 0


# 7 language model


def test_language_model(spark):
    docs = corpus(9, 80) + [(900, None), (901, "")]
    got = {x.doc_id: x for x in language_model.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    tokens = {i: SPACED.findall(lower(t)) + ["</s>"] for i, t in docs}
    train = {i for i in tokens if zlib.crc32(str(i).encode()) % 10}
    count = collections.Counter(w for i in train for w in tokens[i])
    n, v = sum(count.values()), len(count)
    for i, w in tokens.items():
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (i not in train, len(w), sum(count[t] > 0 for t in w), n)
        assert abs(x.base_score - sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w)) < 1e-8
        assert x.score < 0
    assert sum(got[i].score for i in tokens if i in train) > sum(got[i].base_score for i in tokens if i in train)


def test_language_model_scores_by_brute_force(spark):
    docs = corpus(21, 50) + [(900, None), (901, ""), (None, "w1 w2"), (902, "unheard words")]
    docs += [(5, docs[5][1])]
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10
    tokens = [[*SPACED.findall(lower(t)), "</s>"] for _, t in docs]
    one, two, context = collections.Counter(), collections.Counter(), collections.Counter()
    for (i, _), w in zip(docs, tokens):
        if fold(i) != 0:
            one.update(w)
            two.update(zip(["<s>", *w], w))
            context.update(["<s>", *w[:-1]])
    n, floor = sum(one.values()), 1 / (len(one) + 1)
    bucket = lambda c: int(math.floor(math.log2(c)) + 1) if c > 0 else 0
    place = lambda p: int(np.rint(-language_model.STEPS * np.log2(p))) + 1 if p > 0 else 0
    histogram = collections.Counter()
    for (i, _), w in zip(docs, tokens):
        if fold(i) == 1:
            for h, t in zip(["<s>", *w], w):
                histogram[bucket(context[h] - 1), place((two[h, t] - 1) / max(context[h] - 1, 1)), place((one[t] - 1) / max(n - 1, 1))] += 1
    assert histogram
    weights = language_model.learn_weights(dict(histogram), floor)
    expected = []
    for (i, _), w in zip(docs, tokens):
        total = 0.0
        for h, t in zip(["<s>", *w], w):
            a, b, c = weights[bucket(context[h])]
            total += math.log10(a * two[h, t] / max(context[h], 1) + b * one[t] / n + c * floor)
        expected.append((i, fold(i) == 0, len(w), sum(one[t] > 0 for t in w), n, total))
    got = language_model.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), block_bytes=2000).collect()
    key = lambda x: (str(x[0]), x[-1])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got), key=key)
    for x, y in zip(got, sorted(expected, key=key), strict=True):
        assert x[:-1] == y[:-1] and math.isclose(x[-1], y[-1], rel_tol=1e-9)
    empty = spark.createDataFrame([], "doc_id long, text string, score double, block long")
    assert language_model.score_documents(empty).count() == 0


def test_mixture_weights():
    w = language_model.learn_weights({(3, 5, 9): 80, (3, 0, 9): 15, (3, 0, 0): 5, (0, 0, 9): 10}, 1e-4)
    assert np.allclose(w.sum(1), 1) and w[3, 0] > 0.6 and w[0, 0] == 0 and (w > 0)[1:].all()


# 8 language ID


def test_language_models_are_distributions():
    models = language_id.learn({"a": ["abab abba"] * 3, "b": ["xyxy yxyx"] * 3}, {})
    signs = sorted(set("abxy "))
    for context in ("   ", "aba", "xyz", " qq"):
        h = [models.entropies(np.array([ord(c) for c in context + s], np.uint32), np.array([0, 4])) for s in signs]
        total = np.exp(-np.concatenate(h)).sum(0)
        assert (total < 1 + 1e-4).all() and (total > 0.5).all()


def kneser_ney(texts, alphabet, order=4, discount=0.75):
    """p(sign | context), by the book: counts of the highest order, numbers of different signs before in lower ones."""
    counts = {n: collections.Counter() for n in range(1, order + 1)}
    for t in texts:
        padded = " " * (order - 1) + t
        for i in range(order - 1, len(padded)):
            counts[order][padded[i - order + 1 : i + 1]] += 1
    raw = {n: {(" " * (order - 1) + t)[i - n + 1 : i + 1] for t in texts for i in range(order - 1, len(t) + order - 1)} for n in range(1, order + 1)}
    for n in range(order - 1, 0, -1):
        for gram in raw[n + 1]:
            counts[n][gram[1:]] += 1

    def probability(gram):
        if not gram:
            return 1 / alphabet
        n, context = len(gram), gram[:-1]
        own = {g: c for g, c in counts[n].items() if g[:-1] == context}
        total = sum(own.values())
        if not total:
            return probability(gram[1:])
        return max(own.get(gram, 0) - discount, 0) / total + discount * len(own) / total * probability(gram[1:])

    return probability


def test_language_models_by_the_book():
    texts = {"a": ["abab abba baab", "ab ba", "bba"], "b": ["xyxy yxyx axa", "xa ya"], "c": ["ab xy"]}
    models = language_id.learn(texts, {})
    alphabet = len(set("".join(sum(texts.values(), [])))) + 1
    asked = ["abba xyx", "q ab", "ya", "bbbb"]
    signs, bounds, _ = language_id.characters(pa.array(asked, pa.large_string()))
    h = models.entropies(signs, bounds)
    for j, k in enumerate(models.languages):
        p = kneser_ney(texts[k], alphabet)
        for i, t in enumerate(asked):
            padded = "   " + t
            assert math.isclose(h[i, j], -sum(math.log(p(padded[n - 3 : n + 1])) for n in range(3, len(padded))) / len(t), rel_tol=1e-4)


def test_models_counted_in_tasks_are_those_of_the_texts(spark):
    r = random.Random(4)
    docs = [(i, prose(r, 40, 30) if i % 2 else " ".join(f"v{r.choice('aeiou')}z" for _ in range(15)), "ab"[i % 2], "s", 0) for i in range(60)] + [(7, "same text", "a", "s", 0)] * 9
    got = language_id.learn_models(spark.createDataFrame(docs, SCHEMA), "text", "lang", "doc_id", sample=12)
    assert got.languages == ["a", "b"] and all(math.isfinite(x) for x in got.limit)
    assert language_id.learn_models(spark.createDataFrame(docs, SCHEMA).repartition(5), "text", "lang", "doc_id", sample=12).limit.tolist() == got.limit.tolist()
    whole = language_id.learn_models(spark.createDataFrame([d for d in docs if d[0] < 3], SCHEMA), "text", "lang", "doc_id")
    same = language_id.learn({"a": [d[1] for d in docs if d[0] in (0, 2)], "b": [docs[1][1]]}, {})
    assert all((x.keys == y.keys).all() and np.allclose(x.values, y.values) for x, y in zip(whole.grams + whole.backoffs, same.grams + same.backoffs))
    empty = language_id.learn_models(spark.createDataFrame([], SCHEMA), "text", "lang", "doc_id")
    assert empty.languages == [] and language_id.predict(empty, pa.array(["abc", None], pa.large_string()))[0] == ["und", "und"]


def test_short_texts_are_rejected_like_long_ones():
    r = random.Random(3)
    make = {"en": "the and of with for this".split(), "de": "der und mit nicht ein das".split()}
    texts = {k: [" ".join(r.choice(w) for _ in range(25)) for _ in range(60)] for k, w in make.items()}
    models = language_id.learn({k: t[:45] for k, t in texts.items()}, {k: t[45:] for k, t in texts.items()})
    asked = ["the and of with", "der und nicht", "zqxj kvzq jxqz", "ЖЩЪ ЫЭЮ", "!7 93; " * 400 + "zqxj kvzq jxqz"]
    names, _, accepted = language_id.predict(models, pa.array(asked, pa.large_string()))
    assert names[:2] == ["en", "de"] and accepted.tolist() == [True, True, False, False, False]


def test_language_id(spark, edge_docs):
    r = random.Random(1)
    make = {"en": "the and of with for this".split(), "fr": "les des avec pour dans être".split(), "de": "der und für mit nicht über".split()}
    docs = [(i, " ".join(r.choice(make[k]) for _ in range(25)), k, "s", 0) for i in range(240) for k in [("en", "en", "fr", "de")[i % 4]]]
    got = language_id.language_id(spark.createDataFrame(docs, SCHEMA)).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1 for x in got)
    assert sum(x.lang_pred == docs[x.doc_id][2] for x in got) >= 238
    edge = language_id.language_id(edge_docs).collect()
    assert len(edge) == len(EDGES) and all(x.lang_pred == "und" for x in edge if x.doc_id in (1, 2, 5))
    clash = edge_docs.withColumn("lang_pred", edge_docs["doc_id"])
    models = language_id.learn_models(spark.createDataFrame(docs, SCHEMA), "text", "lang", "doc_id")
    assert language_id.identify(clash, models).columns.count("lang_pred") == 1
    assert language_id.language_id(edge_docs.limit(0)).count() == 0


# 10 near-duplicates


def brute_components(docs, k, percent=80):
    sets = {}
    for i, t in docs:
        w = SPACED.findall(lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(((i, len(s), find(i), find(i) == i) for i, s in sets.items()), key=str)


def drifting(seed, n):
    """Copies that each change one word of the one before, so that only neighbours are alike."""
    r = random.Random(seed)
    words = prose(r, 40).split(" ")
    texts = []
    for i in range(n):
        words[r.randrange(40)] = f"D{i}"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("k, tile", [(2, 3000), (5, 3000), (2, 7), (5, 7)])
def test_near_duplicates(spark, k, tile):
    docs = corpus(12, 90) + [(500, None), (501, ""), (502, "a"), (503, "A "), (504, "a b")]
    docs += [(600 + i, t) for i, t in enumerate(drifting(4, 40))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(near_duplicates.near_duplicates(frame, k, tile=tile)) == brute_components(docs, k)


def test_near_duplicates_of_repeated_ids(spark, tmp_path):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "c d e f"), (None, a), (4, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates.near_duplicates(frame, 2).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (None, None, False)]
    clash = frame.selectExpr("doc_id", "text", "doc_id as row", "text as __file", "doc_id as `a.b`")
    clash.write.parquet(str(tmp_path / "docs"))
    for own in (clash, spark.read.parquet(str(tmp_path / "docs"))):
        left = near_duplicates.distinct_rows(own, 2)
        assert left.columns == clash.columns and sorted((r.text or "")[:2] for r in left.collect()) == ["", "a0", "b0", "c "]
        assert near_duplicates.near_duplicates(own, 2).count() == 7


def test_near_duplicate_edges(spark, edge_docs):
    got = near_duplicates.near_duplicates(edge_docs, 2).collect()
    assert len(got) == len(EDGES) and [x.kept for x in got if x.doc_id is None] == [False]
    assert near_duplicates.near_duplicates(edge_docs.limit(0), 2).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns) and rows(got.select(*columns)) == sorted(found.fetchall(), key=str)


def test_superminhash_estimates():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 52, 1000, dtype=np.uint64)
    a, b = base[:900], base[100:]
    keys = np.concatenate([np.sort(a), np.sort(b), np.sort(a)])
    s = near_duplicates.superminhash(keys, np.array([0, 900, 1800, 2700]))
    assert (s[0] == s[2]).all() and abs((s[0] == s[1]).mean() - 0.8) < 0.1
    small = near_duplicates.superminhash(np.arange(3, dtype=np.uint64), np.array([0, 3]))
    assert (small < np.uint64(160 << 40)).all()
