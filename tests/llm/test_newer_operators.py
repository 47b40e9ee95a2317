"""Vector codes, spelling variants and decontamination against plain versions of their contracts."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.llm import contamination, spelling, vector_codes
from quadrille.llm.queries import oracle_sql, queries



def clashing(df):
    """df with columns named as the operators' own."""
    return df.withColumns({c: F.lit(7) for c in ("code", "error", "x", "row", "word", "n", "spans", "row_id", "at", "item", "hash", "no")})



# vector codes


def plain_codes(vectors, parts=16, entries=64, rounds=2):
    """Codes, errors and codebooks of integer vectors in the order of their ids, by full scans."""
    x = np.array(vectors, object).reshape(len(vectors), parts, -1)
    books = [[list(v) for v in x[:entries, p]] for p in range(parts)]

    def assign():
        far = [[[sum((a - b) ** 2 for a, b in zip(v[p], e, strict=True)) for e in books[p]] for p in range(parts)] for v in x]
        return [[d.index(min(d)) for d in row] for row in far], [sum(min(d) for d in row) for row in far]

    for _ in range(rounds):
        codes, _ = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, c in zip(x, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    codes, errors = assign()
    return codes, errors, books


def vectors_of(seed, n, spread):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 0.4, (8, 64))
    return (centers[rng.integers(0, 8, n)] + rng.normal(0, spread, (n, 64))).astype(np.float32)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("spread", [0.01, 0.3])
def test_codes_equal_full_scans(spark, spread):
    made = vectors_of(3, 150, spread)
    made[100:110] = made[5]  # repeated vectors
    data = [(int(i), [float(v) for v in row], None if i % 7 == 0 else int(i % 3)) for i, row in enumerate(made)]
    broken = [(900, None, 1), (901, [None] + [0.0] * 63, 1), (902, [float("nan")] + [0.0] * 63, 1), (903, [float("-inf")] + [0.0] * 63, 1), (904, [0.5] * 32, 1), (None, None, None)]
    df = clashing(spark.createDataFrame(data + broken, VECTORS)).repartition(3)
    coded, books = vector_codes.compress(df, entries=20)
    codes, errors, want = plain_codes([[math.floor(256 * float(v)) for v in row] for row in made], entries=20)
    assert books.tolist() == want
    got = {r.vec_id: r for r in coded.collect()}
    assert sorted(got) == list(range(150))
    for i in range(150):
        assert list(got[i].code) == codes[i] and got[i].error == errors[i]
        assert got[i].label == (None if i % 7 == 0 else str(i % 3))


def test_codes_of_few_rows(spark):
    df = spark.createDataFrame([(1, [0.5] * 16, None), (1, [0.25] * 16, None), (None, [0.5] * 16, 3)], VECTORS)
    coded, books = vector_codes.compress(df)
    assert books.shape == (16, 3, 1) and [b[0][0] for b in books.tolist()] == [64] * 16  # of one id the smaller vector comes first; 128 twice, ties to the lower
    assert sorted((r.vec_id or 0, bytes(r.code), r.error) for r in coded.collect()) == [(0, bytes([1] * 16), 0), (1, bytes([0] * 16), 0), (1, bytes([1] * 16), 0)]
    none, books = vector_codes.compress(df.limit(0))
    assert none.count() == 0 and books.size == 0
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 15, None)], VECTORS))
    with pytest.raises(Exception, match="squared distances"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 16, None), (2, [0.0] * 16, None)], VECTORS))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 12), st.integers(1, 4), st.integers(1, 6))
def test_bounds_never_change_an_assignment(seed, entries, width, spread):
    """Over moving entries, on small integers full of ties, bounds give what full scans give."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (80, width))
    old = rng.integers(-spread, spread + 1, (entries, width))
    state = vector_codes.nearest(x, old)[:3]
    for _ in range(4):
        new = old + rng.integers(-1, 2, old.shape) * rng.integers(0, 2, (entries, 1))
        *state, _ = vector_codes.nearest(x, new, *state, old)
        far = ((x[:, None, :] - new[None]) ** 2).sum(axis=2)
        assert (state[0] == far.argmin(axis=1)).all()
        assert (state[1].astype(float) ** 2 >= far.min(axis=1)).all()
        old = new


def test_bounds_spare_scans():
    rng = np.random.default_rng(1)
    old = rng.integers(-150, 150, (8, 4))
    made = old[rng.integers(0, 8, 2000)] + rng.integers(-5, 6, (2000, 4))
    first = vector_codes.nearest(made, old)
    again = vector_codes.nearest(made, old + 1, *first[:3], old)
    assert first[3] == 2000 and again[3] < 100


# spelling variants


def plain_words(docs):
    n = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(n, times=10):
    out = {}
    for w in n:
        by = [x for x in n if near(w, x)]
        best = min(by, key=lambda x: (-n[x], x), default=None)
        out[w] = [best if best is not None and n[best] >= times * n[w] else None, len(by)]
    for w in n:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w].append(root)
    return {(w, f, root, n[w], k, n[f] if f is not None else None) for w, (f, k, root) in out.items()}


def test_spelling_variants(spark):
    rng = random.Random(5)
    base = ["naturally", "réceptions", "abcdefgh", "aaaaaaaa", "aaaaaaaaa", "ÿÀßéèçñü", "morning", "mourning", "straßen", "×÷÷÷÷÷÷"]
    every = list(base)
    for w in base:
        for _ in range(12):
            at, c = rng.randrange(len(w) + 1), rng.choice("abcxyzéñÀ")
            every.append(rng.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]]))
    texts = [" ".join(rng.choice([w, w.upper(), w.title()]) for w in rng.choices(every, k=60)) + ". " + " ".join(rng.choices(base[:4], [80, 8, 1, 1], k=300)) for _ in range(12)]
    texts += [None, "", "  \n", "short", "x" * 20_000, "morning-mourning_morning", texts[0]]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "naturally mournings"), (None, None), (3, texts[3])]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3)
    n = plain_words(docs)
    got = spelling.groups(spelling.counted(spelling.runs(df))).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain_groups(n) and len(got) == len(n) > 60
    assert any(r.form for r in got) and any(r.root != (r.form or r.word) for r in got) is any(r[2] != (r[1] or r[0]) for r in plain_groups(n))
    assert spelling.groups(spelling.counted(spelling.runs(df.limit(0)))).count() == 0


def test_forms_are_followed_to_the_last(spark):
    n = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20000, "xbcdefg": 2, "zbcdefg": 2}
    got = spelling.groups(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain_groups(n)
    assert {r.root for r in got if r.word.startswith("abc")} == {"abcdefghijk"}


@settings(max_examples=200, deadline=None)
@given(st.text("abcé", min_size=0, max_size=9), st.data())
def test_an_edit_leaves_a_band_and_a_half(word, data):
    """What the join rests on: one edit flips at most two bits, so a band of three stays; and one half of the shorter length stays."""
    at, c = data.draw(st.integers(0, len(word))), data.draw(st.sampled_from("abcé"))
    other = data.draw(st.sampled_from([word[:at] + c + word[at:], word[:at] + word[at + 1 :], word[:at] + c + word[at + 1 :]]))

    def bits(w):
        out = 0
        for ch in w:
            i = spelling.DEALT.find(ch)
            out ^= 1 << (i if i >= 0 else 26 + ord(ch) % 37)
        return out

    flipped, h = bits(word) ^ bits(other), min(len(word), len(other)) // 2
    assert bin(flipped).count("1") <= 2 and any(flipped & band == 0 for band in spelling.BANDS)
    assert word[:h] == other[:h] or word[len(word) - h :] == other[len(other) - h :]


def test_masks_are_the_plain_ones(spark):
    words = ["banana", "émigré", "×÷ÿ", "q", ""]
    got = {r.word: r.m for r in spark.createDataFrame([(w,) for w in words], "word string").select("word", spelling.parity("word").alias("m")).collect()}
    for w in words:
        want = 0
        for c in w:
            want ^= 1 << (spelling.DEALT.find(c) if c in spelling.DEALT else 26 + ord(c) % 37)
        assert got[w] == want


# decontamination


def plain_split(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


def plain_contamination(docs, items, window=10):
    windows = collections.defaultdict(set)
    for item_id, text in items:
        w = plain_split(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[i : i + m])].add("" if item_id is None else str(item_id))
    out = []
    for doc_id, text in docs:
        w, hit, ids = plain_split(text), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if found := windows.get(tuple(w[i : i + m])):
                    hit |= set(range(i, i + m))
                    ids |= found
        out.append((doc_id, len(w), len(hit), ",".join(sorted(ids))))
    return out


def contamination_rows(df, items, **more):
    got = contamination.contamination(df, items, **more).collect()
    for r in got:
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:], strict=False)) and all(s.start < s.stop for s in r.spans)
    return [(r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), ",".join(r["items"])) for r in got]


def key(row):
    return tuple((x is None, x) if not isinstance(x, str) else (False, x) for x in row)


@pytest.mark.parametrize("vocabulary", [3, 40])
def test_contamination(spark, vocabulary):
    rng = random.Random(vocabulary)
    pick = lambda n: " ".join(rng.choice("la ñandú x2 été Ωmega 7 日本語 the of to".split() if vocabulary == 3 else [f"w{i}" for i in range(40)]) for _ in range(n))
    items = [(i, pick(n)) for i, n in enumerate((12, 30, 10, 60, 9, 5))] + [(6, "Only-One_More!!"), (7, ""), (8, None), (9, " . ,"), (None, pick(15))]
    items += [items[0], (10, items[3][1]), (11, items[3][1][5:]), (12, "na na na na na na na na na na na na na")]
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    docs = [pick(80) for _ in range(10)] + [None, "", " \n", "one", cut(items[1][1], 3, 12), cut(items[1][1], 3, 13), items[1][1].upper().replace(" ", " -- ")]
    docs += [f"{pick(4)} {cut(items[3][1], 7, 40)} {pick(3)} {items[2][1]} {items[2][1]}", "only one MORE", "na " * 40, "na " * 9, pick(30_000) + " " + items[1][1], items[4][1] + " " + items[5][1]]
    docs = [(i, t) for i, t in enumerate(docs)] + [(None, items[0][1]), (16, items[1][1])]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3)
    marked = clashing(spark.createDataFrame(items, "item_id long, text string"))
    want = plain_contamination(docs, items)
    assert sorted(contamination_rows(df, marked), key=key) == sorted(want, key=key)
    assert sum(1 for r in want if r[2]) >= 8
    assert {r[2] for r in contamination_rows(df, marked.limit(0))} == {0}
    assert contamination_rows(df.limit(0), marked) == []


def test_winnowing_guarantee():
    """Each window holds a selected gram, the same in each of its occurrences."""
    rng = np.random.default_rng(9)
    text = mixed_words = rng.integers(0, 4, 3000).astype(np.uint64)  # few words: many equal grams
    places, _ = contamination.fingerprints(text, np.array([0, 1200, 1205, 3000]), 10, 5)
    assert len(places) < 0.5 * len(text)
    chosen = {}
    for a, b in ((0, 1200), (1205, 3000)):
        for s in range(a, b - 9):
            inside = tuple(p - s for p in places.tolist() if s <= p <= s + 5)
            assert inside
            chosen.setdefault(tuple(mixed_words[s : s + 10].tolist()), set()).add(inside[-1])
    assert not [p for p in places.tolist() if 1196 < p < 1205]


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_spelling_variants", "op13_benchmark_decontamination"])
def test_queries_match_sql(spark, sf, name):
    import os

    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    got, want = queries()[name](spark, sf), con.execute(oracle_sql()[name]).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(got.columns) == sorted(names)
    order = lambda row: tuple((x is None, x) if x is not None else (True, "") for x in row)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=order) == sorted(want, key=order)


def test_digest_of_codebooks(spark):
    df = spark.createDataFrame([(i, [i / 256] * 16, 1) for i in range(3)], VECTORS)
    _, books = vector_codes.compress(df)
    numbers = ",".join(str(v) for p in range(16) for e in range(3) for v in [e])
    assert hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest() == hashlib.sha256(numbers.encode()).hexdigest()


# long words and equal rows


@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefghijklmnopqrstuvwxyz", bytes(range(256))])
def test_long_words_in_pieces(monkeypatch, alphabet):
    """Pieces read side by side give what byte by byte gives, whatever the cuts."""
    import pyarrow as pa

    from quadrille.llm import token_counts

    auto = token_counts.Automaton([b"ab", b"abab", b"ababababa", b"bb", b"the", b"ther", b"erence", b"aaaaaaaaaaaaaaaa", "▁a".encode(), b"qu", b"quick"])
    rng = random.Random(3)
    words = [bytes(rng.choice(alphabet) for _ in range(n)) for n in (1, 40, 41, 100, 997, 3000)] + [b"a" * 1500, b"ab" * 900]
    want = auto.counts(pa.array(words, pa.binary())).tolist()
    for piece, segment in ((7, 70), (64, 128), (16, 4096), (1, 50)):
        monkeypatch.setattr(token_counts, "LONG", 30)
        monkeypatch.setattr(token_counts, "PIECE", piece)
        monkeypatch.setattr(token_counts, "SEGMENT", segment - segment % piece or piece)
        assert auto.counts(pa.array(words, pa.binary())).tolist() == want


def test_a_word_of_five_megabytes_takes_seconds(spark):
    import time

    from quadrille.llm import token_counts

    rng = random.Random(4)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(5 << 20))
    df = spark.createDataFrame([(1, word), (2, "a b")], "doc_id long, text string")
    token_counts.automaton()
    began = time.perf_counter()
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.token_counts(df).collect()}
    assert time.perf_counter() - began < 60 and got[1][0] == 1 and got[1][1] > 1 << 20


def test_equal_rows_are_dealt_apart(spark, monkeypatch):
    from quadrille.llm import sharding

    monkeypatch.setattr(sharding, "NUMBERED", 500)
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows = sharding.shard(df, "doc_id", [1.0] * 24)
    assert sorted(r.slot for r in rows.collect()) == list(range(4000)) and rows.select("shard").distinct().count() == 1


def test_shared_mass_sends_in_proportion(spark):
    """The masses equal a plain count, however many buckets."""
    from quadrille.llm import near_dedup

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 4000, 60)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(300)]
    times = collections.Counter(int(x) for s in sets for x in s)
    want = {i: sum(times[int(x)] > 1 for x in s) for i, s in enumerate(sets)}
    df = spark.createDataFrame([(i, bytearray(np.sort(s).tobytes())) for i, s in enumerate(sets)], "node long, set binary").repartition(3)
    for buckets in (1, 7, 500):
        got = {r.node: r.mass for r in near_dedup.shared_mass(df, buckets).collect()}
        assert got == {i: m for i, m in want.items() if m}
