"""Each operator against a plain version of its contract, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import collections
import hashlib
import html
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import exact_dedup, html_extract, lm, mixing, near_dedup, packing, quality, sharding, token_counts, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 700}" for i in range(9000)) + "."
TEXTS = [
    None, "", " \t\n ", "one", "one two three four", "A b c d e f g h", "a B c D e f g h", "a b  c\td e f\ng h", "x" * 5000, LONG, LONG, LONG + " more", "été à la plage. " * 30,
    "stop  two   spaces\n\n  and  odd   ones", "THE!! END!! IS!! NEAR!! " * 20, "same same same", "same same same", "<|endoftext|> is text",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0 if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[9], (None, "one", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in ("shard", "kept", "piece", "score", "tokens", "digest", "row_id", "salt", "hash")}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_sharding(spark, docs, none):
    rows = sharding.shard(docs, "doc_id", [1.0] * 24).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.law == "key" and r.grown_shard in (r.shard, 24)
        if r.doc_id is not None:
            raw = (TEXTS[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    by_shard = collections.defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sharding.shard(none, "doc_id", [1.0, 2.0]).count() == 0


def test_sharding_weights_and_growth(spark):
    ids = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = collections.Counter(r.shard for r in sharding.shard(ids, "doc_id", [1.0, 2.0, 5.0]).collect())
    assert abs(n[2] / 20000 - 5 / 8) < 0.02 and abs(n[0] / 20000 - 1 / 8) < 0.02
    moved = sharding.shard(ids, "doc_id", [1.0] * 24).filter("grown_shard <> shard")
    assert 600 < moved.count() < 1000 and moved.filter("grown_shard <> 24").count() == 0


def test_packing(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(docs).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in enumerate(TEXTS):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        copies = 2 if doc_id in (3, 9) else 1
        rows = sorted(by_doc[doc_id], key=lambda r: r.piece)[::copies]
        assert [r.piece for r in rows] == list(range(len(rows))) and sum(r.length for r in rows) == len(ids)
        for r in rows:
            part = ids[r.start : r.start + r.length]
            assert r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r.piece == 0 or r.length == 1024
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(none).count() == 0


def test_best_fit_is_tight():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 1024, 20000).tolist()
    fit = packing.BestFit(1024, packing.OPEN_BINS)
    for a in range(0, len(sizes), packing.WINDOW):
        for s in sorted(sizes[a : a + packing.WINDOW], reverse=True):
            fit.put(s)
            assert fit.n_open <= packing.OPEN_BINS
    assert fit.n_bins <= 1.02 * sum(sizes) / 1024


def test_packing_of_a_table_is_tight(spark, sf):
    """Over several windows and parts: within a hundredth of the least number of sequences, and two for each part."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = packing.pack(docs, rows=300_000)
    n, tokens = rows.agg(F.count_distinct("sequence_id"), F.sum("length")).first()
    assert n <= 1.01 * tokens / 1024 + 2 * 3
    tight = packing.BestFit(10, 2)  # a third open bin closes the fullest
    assert [tight.put(s)[0] for s in (9, 8, 7)] == [0, 1, 2]
    assert tight.put(1)[0] == 1 and tight.n_open == 2


def test_encoder_equals_the_tokenizer():
    """Ids of all texts of the small table, and of random ones with special tokens and odd white space, against the library of the contract."""
    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    plain, enc, r = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Encoder(), np.random.default_rng(17)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    parts = ["<|endoftext|>", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "it's", "é", "日本", "1234", "!?", "<|", "endoftext|>", "word", "A"]
    texts += ["".join(r.choice(parts, r.integers(0, 12))) for _ in range(3000)]
    for text, want in zip(texts, plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == want.ids


PAGES = [
    (0, "u", "<html><body><nav><ul><li><a href='/'>Home page</a></li></ul></nav><article><h1>Title &amp; more</h1><p>First   <b>bold</b>\nline.<p>Second&nbsp;one, still going on with words.</article><div class='comments'><p>nice one</p></div><footer>&copy; me</footer></body></html>"),
    (1, "u", None), (2, "u", ""), (3, "u", "<p>unclosed"), (4, None, "no markup at all"), (5, "u", "<div" * 50), (6, "u", "<script>var a = '<p>x</p>';</script><!-- <p>no</p> -->"),
]


def test_extraction(spark):
    df = spark.createDataFrame([(*p, 1, 2) for p in PAGES], "page_id long, url string, html string, text int, n_chars int")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert got[0].text == "Title & more\n\nFirst bold line.\n\nSecond one, still going on with words."
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert got[1].text == got[2].text == got[6].text == ""
    assert html_extract.extract(df.limit(0)).count() == 0


def test_extraction_of_unseen_layouts():
    model, kept, there, right = html_extract.learned(), 0, 0, 0
    for page in html_extract.sample_pages(150, seed=77):
        nodes, blocks = html_extract.parse(page)
        keep = html_extract.decoded(nodes, model.log_odds(html_extract.described(nodes)))
        for k, text in blocks:
            kept += keep[k] * len(text)
            there += (nodes[k].y == 1) * len(text)
            right += (keep[k] and nodes[k].y == 1) * len(text)
    assert right / kept > 0.98 and right / there > 0.98


def test_extraction_from_the_table(spark, sf):
    for r in html_extract.extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize("page, text", [
    ('<article><p title="5" tall">Hello there, you. It is a fine day.</p></article>', "Hello there, you. It is a fine day."),
    ("<article><p>One line, here.</p><script src=x />var leaked=1;</script><p>Two lines, there.</p></article>", "One line, here.\n\nTwo lines, there."),
    ("<article><p>Let <math><mi>x</mi></math> be, and <button>press</button> or <object>see</object> it.</p></article>", "Let x be, and press or see it."),
    ("<article><p>An unclosed <select> and <noscript> here, still.</p><p>More of it, too.</p></article>", "An unclosed and here, still.\n\nMore of it, too."),
    ("<article><p a='1 > 0' b=x>y>Greater, than. It is so.</p></article>", "y>Greater, than. It is so."),
    ("<article><p>Less < more, 3<4. <!--> no comment<!-- x --></p><!bad><?php 1>", "Less < more, 3<4. no comment"),
    ("<main><p>A page that ends, here. In a <a href='x", "A page that ends, here. In a"),
    ("<div class=post><p>No article, but a post. It is long enough, is it not? Yes, it is.</div>", "No article, but a post. It is long enough, is it not? Yes, it is."),
])
def test_extraction_of_odd_markup(page, text):
    assert html_extract.main_texts([page], html_extract.learned()) == [text]


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<a =\"'", "<!", "<!--", "</", "<p", "<div>", "<h1>", "</p>", "<select>", "<h2><p></h3>", "&lt;", "<script", "='"])
def test_extraction_takes_linear_time(unit):
    import time

    began = time.perf_counter()
    html_extract.parse("<article>" + unit * (200_000 // len(unit)))
    assert time.perf_counter() - began < 8


def test_decoding_never_contradicts():
    """Each node follows its decided ancestor, and no other choice of whole, left out and divided subtrees gains more."""
    nodes = [html_extract.Node("#page", -1, 0, 0, 0)] + [html_extract.Node("div", (i - 1) // 2, 1, 0, 0, own=10 * (i % 3)) for i in range(1, 15)]
    children = {k: [i for i, x in enumerate(nodes) if x.parent == k] for k in range(15)}
    rng = np.random.default_rng(0)

    def under(k):
        return [k, *(d for c in children[k] for d in under(c))]

    def plain(k, gain):
        """(what the subtree gains at best, which of its nodes are kept, which are decided by a node above them)."""
        every = under(k)
        total = sum(gain[i] for i in every)
        parts = [plain(c, gain) for c in children[k]]
        divided = (abs(gain[k]) if nodes[k].own else 0.0) + sum(p[0] for p in parts) - html_extract.CHANGE
        if divided > abs(total):
            return divided, {k: gain[k] > 0} | {i: v for p in parts for i, v in p[1].items()}, set().union(*(p[2] for p in parts)) if parts else set()
        return abs(total), dict.fromkeys(every, total > 0), {(k, i) for i in every}

    seen = 0
    for _ in range(200):
        odds = rng.normal(size=15) * 3
        gain = [float(o) * (1 + (x.own > 0) + x.own**0.5 / 4) for o, x in zip(odds, nodes, strict=True)]
        out = html_extract.decoded(nodes, odds)
        _, want, follows = plain(0, gain)
        assert out == [want[k] for k in range(15)]
        assert all(out[i] == out[k] for k, i in follows)
        seen += len({k for k, _ in follows}) > 1
    assert seen > 50


def test_quality(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93


def plain_statistics(text):
    """The statistics of one text, said in plain Python."""
    if not text:
        return [0.0] * len(quality.STATISTICS)
    raw, own = text.encode(), [w.encode() for w in words(lower(text))]
    sets = [set(c) for c in quality.CLASSES.values()]
    shares = [sum(b in c for b in raw) / len(raw) for c in sets]
    row = [*shares, 1 - sum(shares), math.log1p(len(raw))]
    if own:
        n, sizes, counts = len(own), [len(w) for w in own], collections.Counter(own)
        mean = sum(sizes) / n
        spread = (sum((x - mean) ** 2 for x in sizes) / n) ** 0.5
        pairs = len(set(zip(own, own[1:]))) / max(1, n - 1)
        row += [math.log1p(n), math.log1p(mean), math.log1p(spread), len(counts) / n, max(counts.values()) / n, sum(a == b for a, b in zip(own, own[1:])) / n, pairs]
    else:
        row += [0.0] * 7
    lines = text.split("\n")
    return [*row, math.log1p(len(lines)), len(set(lines)) / len(lines)]


def test_quality_equals_a_plain_version(spark, sf):
    """Statistics, features, ridge and calibration over all labelled rows at once, without Spark."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    taught = [(r.doc_id, r.quality) for r in labels.collect() if r.doc_id in texts and r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5]
    x, y = np.array([plain_statistics(texts[i]) for i, _ in taught]), np.array([float(q) for _, q in taught])
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    rng = np.random.default_rng(7)
    weights, shift = rng.normal(size=(x.shape[1], quality.WIDTH)) * quality.SPREAD / x.shape[1] ** 0.5, rng.uniform(0, 2 * np.pi, quality.WIDTH)

    def features(x):
        z = np.cos(np.clip((x - mean) / scale, -quality.CLIP, quality.CLIP) @ weights + shift) * (2 / quality.WIDTH) ** 0.5
        return np.hstack([z, np.ones((len(x), 1))])

    z = features(x)
    ridge = np.linalg.solve(z.T @ z / len(y) + quality.RIDGE / quality.WIDTH * np.eye(z.shape[1]), z.T @ y / len(y))
    place = ((np.clip(z @ ridge, -0.5, 1.499999) + 0.5) * quality.BINS / 2).astype(int)
    there = sorted(set(place.tolist()))
    means, sizes = [y[place == b].mean() for b in there], [(place == b).sum() for b in there]
    # the isotonic fit by its min-max formula
    total = np.concatenate([[0], np.cumsum(np.array(means) * sizes)])
    count = np.concatenate([[0], np.cumsum(sizes)])
    fit = [max(min((total[b] - total[a]) / (count[b] - count[a]) for b in range(i + 1, len(there) + 1)) for a in range(i + 1)) for i in range(len(there))]
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    want = np.interp(features(np.array([plain_statistics(t) for t in texts.values()])) @ ridge, (np.array(there) + 0.5) * 2 / quality.BINS - 0.5, fit).clip(0, 1)
    # a raw score at the edge of a bin may fall to either side
    assert np.mean(np.abs(np.array([got[i] for i in texts]) - want) < 1e-3) > 0.97


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1)}) == 1
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(none, labels).count() == 0


def test_isotonic():
    got = quality.isotonic([1, 3, 2, 5], [4, 4, 4, 5])
    assert got == [0.25, 0.625, 0.625, 1.0]


def brute_top(vectors, k=5):
    out = []
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for i, q in good:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=12)]) for i in range(400)]
    rows += [(i, rows[100][1]) for i in range(400, 520)]  # ties
    rows += [(600, None), (650, []), (700, [1.0, None]), (750, [float("nan")] * 12), (800, [float("inf")] * 12), (850, [0.5, 0.25]), (851, [0.5, 0.5]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, dim int").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df.select("vec_id", "embedding", "score", "dim"), F.col("vec_id") % 50 == 0).collect())
    assert got == brute_top(rows)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def plain_top(rows, k):
    """(query, rank, id, score) of the contract, by Python's integers."""
    made = {v: [math.floor(256 * x) for x in e] for v, e in rows}
    out = []
    for q, e in made.items():
        if q % 50 == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(e, f)))), v) for v, f in made.items() if v != q)[:k]
            out += [(q, n, v, -s) for n, (s, v) in enumerate(scores, 1)]
    return sorted(out)


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6) * 10.0 ** rng.integers(-2, 9)]) for i in range(160)]
    rows += [(200, [1e6] * 6), (201, [1e6 + 1 / 256] * 6), (202, [1e300, -1e300, 1.0, 0.0, 0.0, 0.0]), (203, [2.0**53 + 2] * 6), (250, [2.0**53] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == plain_top(rows, 5)


def test_segments_rule_out_candidates():
    """Of smooth vectors in groups the bounds leave few pairs; of independent noise they leave nearly all."""
    rng = np.random.default_rng(3)
    centers = np.repeat(rng.normal(size=(40, 8)) * 100, 8, axis=1)
    smooth = np.floor(centers[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 64)) * 3)
    noise = np.floor(rng.normal(size=(2000, 64)) * 30)
    for rows, least, most in ((smooth, 0, 0.3), (noise, 0.5, 1)):
        q, c = topk.by_variance(rows[:100], rows[100:])
        levelled = {"all": c} | {n: topk.summary(c, n) for n in topk.LEVELS}
        own = np.zeros((100, 1900), bool)
        alive = topk.survivors(q, levelled, 5, own, np.sqrt((c**2).sum(axis=1)))
        assert least <= alive.mean() <= most
        exact = q @ c.T
        assert all(alive[i][np.argsort(-exact[i])[:5]].all() for i in range(100))


def test_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=9)]) for i in range(500)]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect())
    assert got == brute_top(rows)


def test_exact_dedup(spark, docs, none):
    groups = collections.defaultdict(list)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        groups[norm(t)].append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        own = sha[r.text_sha256]
        smallest = min((i for i in own if i is not None), default=None)
        assert r.keep_id == smallest and r.group_size == len(own)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_with_colliding_hashes(spark, docs, monkeypatch):
    want = sorted(map(str, exact_dedup.exact_dedup(docs).collect()))
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: real(*c) % 2)
    assert sorted(map(str, exact_dedup.exact_dedup(docs).collect())) == want


def brute_near(rows, percent=85):
    def shingles(text):
        w = words(lower(text))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_rows():
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 4000, 150)]
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for i in range(120):  # one group of copies edited more and less, with chains of links
        own = list(base)
        for at in rng.integers(0, 150, int(rng.integers(0, 9))):
            own[at] = f"e{rng.integers(0, 10**6)}"
        rows.append((100 + i, " ".join(own)))
    return [*rows, rows[3], rows[20], (None, "one"), (None, None)]


def test_near_dedup(spark, docs, none):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, digest int, band int").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()), key=key)
    assert got == sorted(brute_near(rows), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in near_dedup.near_duplicates(df.filter("doc_id IS NOT NULL")).collect())
    assert near_dedup.near_duplicates(none).count() == 0


def copies_between(low, high, n, seed=4):
    """n pairs of long texts whose shingles have a similarity in [low, high)."""
    rng, rows = np.random.default_rng(seed), []
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    while len(rows) < 2 * n:
        base = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        own = list(base)
        for at in rng.integers(0, 200, int(rng.integers(3, 7))):
            own[at] = f"e{rng.integers(0, 10**6)}"
        a, b = shingles(base), shingles(own)
        if low <= len(a & b) / len(a | b) < high:
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(own))]
    return rows


def test_near_dedup_at_80(spark):
    rows = [*copies_between(0.80, 0.85, 150), *((10**6 + i, t) for i, t in copies_between(0.75, 0.80, 20, seed=5))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, percent=80).collect())
    assert got == sorted(brute_near(rows, percent=80)) and sum(d != c for d, _, c in got) == 150


def test_bands_follow_the_threshold():
    assert near_dedup.rows_of(85) == 8
    for percent in (50, 60, 70, 80, 85, 90, 95):
        r = near_dedup.rows_of(percent)
        assert (1 - (percent / 100) ** r) ** (2 * near_dedup.PERMUTATIONS // r) <= 1.1e-5
    with pytest.raises(ValueError):
        near_dedup.rows_of(1)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        up[rb] = ra
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_shared_mass(spark):
    rng = np.random.default_rng(9)
    sets = {i: set(rng.integers(0, 1 << 62, 5).tolist()) | ({7} if i % 3 else set()) | ({1000 + i // 2}) for i in range(5000)}
    times = collections.Counter(x for s in sets.values() for x in s)
    want = {i: n for i, s in sets.items() if (n := sum(times[x] > 1 for x in s))}
    rows = spark.createDataFrame([(i, np.array(sorted(s), np.uint64).tobytes()) for i, s in sets.items()], "node long, set binary").repartition(3)
    assert {r.node: r.mass for r in near_dedup.shared_mass(rows, 7).collect()} == want


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:900], rng.integers(0, 2**63, 100).astype(np.uint64)]))
    sig = near_dedup.signatures([a, b])
    assert abs((sig[0] == sig[1]).mean() - 900 / 1100) < 0.08


def test_lm_base_and_probabilities(spark, docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    tokens = [[*words(lower(t)), None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    c = collections.Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i or 0, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for (i, _), t, h in zip(rows, tokens, held, strict=True))
    got = lm.score(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert lm.score(none).count() == 0


def plain_scores(rows):
    """log10 probabilities of texts by the mixed trigram model, said with dictionaries."""
    tokens = {i: [*words(lower(t)), None] for i, t in rows}
    learned = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10]
    one = collections.Counter(w for t in learned for w in t)
    two = collections.Counter(p for t in learned for p in zip(t, t[1:]))
    three = collections.Counter(p for t in learned for p in zip(t, t[1:], t[2:]))
    n, v = sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    p2 = lambda a, w: (two[a, w] + lm.PRIOR[2] * p1(w)) / (one[a] + lm.PRIOR[2])
    p3 = lambda a, b, w: (three[a, b, w] + lm.PRIOR[3] * p2(b, w)) / (two[a, b] + lm.PRIOR[3])
    return {i: sum(math.log10(p1(w) if k == 0 else p2(t[0], w) if k == 1 else p3(t[k - 2], t[k - 1], w)) for k, w in enumerate(t)) for i, t in tokens.items()}


def close_to_plain(got, want):
    for r in got:  # a value is rounded down on a grid: a token, of up to three values, loses little
        assert want[r.doc_id] - 4 * r.n_tokens / lm.STEPS <= r.score <= want[r.doc_id] + 1e-6


def test_lm_equals_a_plain_trigram_model(spark):
    rng = np.random.default_rng(12)
    vocabulary = "a b c d e f g h".split()
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 30), p=[0.3, 0.2, 0.15, 0.1, 0.1, 0.05, 0.05, 0.05]))) for i in range(60)]
    close_to_plain(lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect(), plain_scores(rows))


def test_lm_keeps_all_ngrams(spark):
    """A corpus of over 65,536 words, nearly each of them, and of its bigrams and trigrams, as rare as can be; one text is long."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 90_000, 1500))) for i in range(100)]
    rows += [(i + 100, rows[i][1]) for i in range(0, 100, 3)] + [(900, " ".join(f"w{k}" for k in rng.integers(0, 90_000, 60_000)))]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    close_to_plain(got, plain_scores(rows))
    assert len(got) == len(rows)


def test_lm_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: (round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "PART_BYTES", 20_000)
    monkeypatch.setattr(lm, "GROUP_GRAMS", 3_000)
    got = {r.doc_id: (round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs.repartition(5)).collect()}
    assert got == want


def test_lm_messages_grow_with_the_text(spark, monkeypatch):
    """Twice the text makes at most twice the bytes that n-grams send, whatever the buckets; a row holds at least one n-gram."""
    monkeypatch.setattr(lm, "PART_BYTES", 30_000)
    rng, size = np.random.default_rng(2), {}
    for n in (40, 80):
        text = lm._stored_parts(spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 400) % 5000), False) for i in range(n)], "doc_id long, text string, held_out boolean").repartition(2))
        for buckets in (8, 800):
            size[n, buckets] = sum(len(lm.Part.read(r.asDict()).dealt(3, buckets)[0]) for r in text.collect())
            assert lm._tallied(text, 3, buckets).filter("part >= 0").count() <= size[n, buckets]
    assert size[80, 8] == size[80, 800] <= 2.1 * size[40, 8]


def test_lm_trie_gives_a_distribution():
    rng = np.random.default_rng(8)
    ids = rng.integers(0, 12, 6000)
    counts, bits = np.bincount(ids, minlength=12), 4
    keys, n2 = np.unique((ids[:-1] << bits) | ids[1:], return_counts=True)
    place = np.searchsorted(keys, (ids[:-1] << bits) | ids[1:])
    trigrams, n3 = np.unique((place[:-1] << bits) | ids[2:], return_counts=True)
    trie = lm.Trie(counts, keys, n2, trigrams, n3, 6000, 12)
    assert trie.bits == bits
    for a in range(12):
        for b in range(12):
            seq = np.concatenate([[a, b, w] for w in range(12)]).astype(np.int64)
            p = 10 ** trie.logs(lm.Part(np.arange(12).astype(np.uint64), seq, np.arange(0, 37, 3), np.ones(12, bool)))[2::3]
            assert 0.97 < p.sum() <= 1 + 1e-9  # the last tokens of the sequence have no next one


def test_elias_fano():
    rng = np.random.default_rng(6)
    values = np.unique(rng.integers(0, 1 << 40, 5000))
    ef = lm.EliasFano(values, 1 << 40).opened()
    assert (ef.find(values) == np.arange(len(values))).all()
    other = np.setdiff1d(rng.integers(0, 1 << 40, 3000), values)
    assert (ef.find(other) == -1).all() and (lm.EliasFano([], 10).opened().find(np.array([3])) == -1).all()
    dense = lm.EliasFano(np.arange(50), 50).opened()
    assert (dense.find(np.arange(50)) == np.arange(50)).all()


def test_lm_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.score(docs).filter("held_out").agg(F.sum(F.col("score") - F.col("base_score")) / F.sum("n_tokens")).first()[0]
    assert r > 0.1


def greedy(word, pieces, longest):
    text, at, n = ("▁" + word).encode(), 0, 0
    while at < len(text):
        for size in range(min(longest, len(text) - at), 0, -1):
            if size == 1 or text[at : at + size] in pieces:
                break
        at, n = at + size, n + 1
    return n


def test_token_counts(spark, docs, none):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {sp.id_to_piece(i).encode() for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    longest = max(map(len, pieces))
    for r in token_counts.token_counts(docs).collect():
        text = None if r.doc_id is None else TEXTS[r.doc_id]
        if r.doc_id is not None:
            own = words(text)
            assert (r.n_words, r.n_tokens) == (len(own), sum(greedy(w, pieces, longest) for w in own))
    assert token_counts.token_counts(none).count() == 0


def test_automaton_on_random_vocabularies():
    rng = np.random.default_rng(12)
    import pyarrow as pa

    for _ in range(20):
        pieces = {"".join(rng.choice(list("ab▁"), rng.integers(1, 6))).encode() for _ in range(12)}
        text = ["".join(rng.choice(list("abc"), rng.integers(1, 14))) for _ in range(60)]
        got = token_counts.Automaton(pieces).counts(pa.array(text))
        assert got.tolist() == [greedy(w, pieces, 20) for w in text]


def test_mixing_meets_targets(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = mixing.mix(docs, labels).toPandas()
    assert len(rows) == docs.count() and (rows.rate >= 0).all() and (rows.copies >= 0).all() and ((rows.copies - rows.rate).abs() <= 1).all()
    p = rows[["p_clean", "p_low", "p_toxic"]].to_numpy()
    assert np.allclose(p.sum(1), 1)
    now, got = (rows.tokens.to_numpy()[:, None] * p).sum(0), ((rows.tokens * rows.rate).to_numpy()[:, None] * p).sum(0)
    whole = now[0] / mixing.WEIGHTS["clean"]
    want = np.array([mixing.WEIGHTS[d] * whole for d in mixing.DOMAINS])
    assert np.abs(got - want).max() <= 1e-4 * now.sum()


def test_scarce_domain_is_repeated(spark):
    rows = spark.range(5000).select(F.lit(10).cast("long").alias("tokens"), F.when(F.col("id") % 100 == 0, 0.0).otherwise(1.0).alias("p_clean"), F.when(F.col("id") % 100 == 0, 1.0).otherwise(0.0).alias("p_low"), F.lit(0.0).alias("p_toxic"))
    steps, targets, reached = mixing.fit_rates(rows, mixing.WEIGHTS)
    assert targets["toxic"] == 0 and abs(reached["low"] / (reached["low"] + reached["clean"]) - 0.07 / 0.97) < 1e-6
    assert max(r[0] for r in rows.select(mixing.rate_of(steps)).distinct().collect()) > 5
    steps, _, reached = mixing.fit_rates(rows, mixing.WEIGHTS, repeat=False)
    assert max(r[0] for r in rows.select(mixing.rate_of(steps, False)).distinct().collect()) <= 1 and reached["low"] == 500


def test_targets_out_of_reach_are_told(spark):
    rows = spark.createDataFrame([(100, 0.5, 0.3, 0.2)] * 3, "tokens long, p_clean double, p_low double, p_toxic double")
    with pytest.warns(UserWarning, match="misses its targets"):
        mixing.fit_rates(rows, mixing.WEIGHTS)


def test_posteriors_of_held_out_rows(spark, sf):
    """Learned from four fifths of the labels, the mean posterior of the true domain over the rest."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = mixing.fit_classifier(docs, labels.filter(~held))
    rows = mixing.measured(docs.select("doc_id", "text"), model).join(labels.filter(held).select("doc_id", mixing.domain_of().alias("d")), "doc_id")
    own = F.when(F.col("d") == "clean", F.col("p_clean")).when(F.col("d") == "low", F.col("p_low")).otherwise(F.col("p_toxic"))
    got = {r.d: r.p for r in rows.groupBy("d").agg(F.avg(own).alias("p")).collect()}
    assert got["clean"] > 0.95 and got["low"] > 0.85 and got["toxic"] > 0.8


def test_posteriors_equal_a_plain_count(spark):
    """The same Bayes, word by word in Python, on the small table."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = mixing.fit_classifier(docs, labels)
    top = {d: max((int(k.rsplit(" ", 1)[1]) for k in model.classes if k.startswith(f" {d} ")), default=None) for d in mixing.DOMAINS}
    for r in mixing.measured(docs.select("doc_id", "text"), model).collect():
        text = r.text or ""
        words = [w for w in re.split(r"[\s.,]+", text.lower(), flags=re.ASCII) if w]
        size = max(1, len(text))
        step = lambda x, n: int(min(x, 0.999) * n)
        made = [f" marks {step(sum(c in '!?#$%&*|+<=>@^_~' for c in text) / size, 25)}", f" capitals {step(sum('A' <= c <= 'Z' for c in text) / size, 10)}", f" distinct {step(len(set(words)) / max(1, len(words)), 10)}"]
        for d, own in model.lexicon.items():
            if own:
                n = len(set(words) & set(own))
                made.append(f" {d} {min(n.bit_length(), top[d])}")
        logs = np.array(model.prior) + sum((np.array(model.classes[c]) for c in made if c in model.classes), np.zeros(3))
        want = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert r.tokens == len(words) and np.allclose([r.p_clean, r.p_low, r.p_toxic], want)


def test_mixing_edges(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(18)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    rows = mixing.mix(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 and abs(r.p_clean + r.p_low + r.p_toxic - 1) < 1e-9 for r in rows)
    assert {r.rate for r in mixing.mix(docs, labels.limit(0)).collect()} <= {1.0} | {r.rate for r in rows}
    assert mixing.mix(none, labels).count() == 0


def test_copies_meet_the_weights(spark, monkeypatch):
    kind = F.when(F.col("doc_id") % 20 < 11, 0).when(F.col("doc_id") % 20 < 17, 1).otherwise(2)
    p = lambda i: F.when(kind == i, F.array(F.lit(0.99), F.lit(0.93), F.lit(0.88))[i]).otherwise(F.when(kind == 1, 0.07).when(kind == 2, 0.12).otherwise(0.005) if i == 0 else F.when(kind == 0, 0.005).otherwise(0.0))
    rows = spark.range(200_000).withColumnRenamed("id", "doc_id").select("doc_id", F.lit("").alias("text"), F.lit(100).cast("long").alias("tokens"), *[p(i).alias(f"p_{d}") for i, d in enumerate(mixing.DOMAINS)])
    monkeypatch.setattr(mixing, "fit_classifier", lambda docs, labels: None)
    monkeypatch.setattr(mixing, "measured", lambda docs, classifier: rows)
    _, targets, reached = mixing.fit_rates(rows, mixing.WEIGHTS)
    got = mixing.mix(rows, None)
    assert got.agg(F.max("rate")).first()[0] > 1.05
    drawn = got.agg(*[F.sum(F.col("copies") * F.col("tokens") * F.col(f"p_{d}")) for d in mixing.DOMAINS]).first()
    for d, n in zip(mixing.DOMAINS, drawn, strict=True):
        assert abs(reached[d] - targets[d]) <= 1e-4 * targets[d]
        assert abs(n / sum(drawn) - mixing.WEIGHTS[d]) <= 0.003


def test_rates_stay_nonnegative(spark):
    rows = spark.createDataFrame([(100, 0.9, 0.1, 0.0), (50, 0.2, 0.8, 0.0), (80, 0.0, 0.1, 0.9), (500, 0.5, 0.5, 0.0)], "tokens long, p_clean double, p_low double, p_toxic double")
    steps, targets, reached = mixing.fit_rates(rows, {"clean": 0.98, "low": 0.01, "toxic": 0.01})
    rates = [r[0] for r in rows.select(mixing.rate_of(steps)).collect()]
    assert min(rates) >= 0
    assert reached["toxic"] <= targets["toxic"] * 1.2 + 1
