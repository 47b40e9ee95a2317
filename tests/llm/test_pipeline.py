"""The pipeline's stages on the small table and on odd rows."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, sf):
    """documents with nulls, empty and repeated rows, copies and near copies; labels of the small table."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(COLUMNS)
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (None, "no id but some words here and there", "en", "s", 3), (None, None, None, None, None)], docs.schema)
    docs.unionByName(odd).unionByName(docs.limit(5)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
            assert 0 < docs.count() <= before.count()
            assert docs.subtract(before).count() == 0
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in seen["exact_dedup"].collect()]
    assert len(texts) == len(set(texts))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    clean = lambda df: df.join(labels.filter("quality = 1 AND toxic = 0"), "doc_id").select("doc_id").distinct().count()
    assert clean(seen["quality_classifier"]) >= 0.97 * clean(spark.read.parquet(f"{folder}/documents.parquet"))
    assert clean(seen["mixing"]) >= 0.9 * clean(seen["minhash_near_dedup"])
    packed = seen["best_fit_packing"]
    assert packed.select("doc_id").distinct().count() == seen["mixing"].select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_of_80_go(spark, tmp_path):
    from test_operators import copies_between

    rows = [(i, t, "en", "s", len(t)) for i, t in copies_between(0.80, 0.85, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies_out(spark, docs, str(tmp_path)).collect()) == list(range(0, 80, 2))


def test_stages_equal_plain_versions(spark, folder):
    """Each stage's rows against a plain version over its own input: scores text by text, equal texts and all pairs of shingle sets
    by dictionaries, rates from posteriors one by one, pieces by the tokenizer itself."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from quadrille.llm import mixing, quality

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, folder), name)
        out[name] = (before, docs)

    before, after = out["quality_classifier"]
    model = quality.fit(before, labels)
    assert rows(after) == sorted((r for r in rows(before) if model.score(quality.statistics(pa.array([r[1]], pa.string())))[0] >= quality.THRESHOLD), key=str)

    before, after = out["exact_dedup"]
    seen: dict = {}
    for r in before.collect():
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        if key not in seen or (r.doc_id is None, r.doc_id or 0) < (seen[key].doc_id is None, seen[key].doc_id or 0):
            seen[key] = r
    assert rows(after) == sorted(map(tuple, seen.values()), key=str)

    before, after = out["minhash_near_dedup"]
    sets = {}
    for r in before.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    ids = sorted(sets, key=lambda i: (i is None, i or 0))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((top(a), top(b)), key=lambda i: (i is None, i or 0))
                root[high] = low
    assert sorted((r.doc_id for r in after.collect()), key=str) == sorted((i for i in ids if top(i) == i), key=str)

    before, after = out["mixing"]
    classifier = mixing.fit_classifier(before, labels)
    measured = mixing.measured(before.select("doc_id", "text"), classifier)
    steps, _, _ = mixing.fit_rates(measured, mixing.WEIGHTS, repeat=False)
    draw = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("mix")), 11).cast("double") + 0.5) * 2.0**-53
    kept = []
    for r in measured.withColumn("draw", draw).collect():
        rate = 1.0
        for s in steps:
            rate = min(1.0, max(0.0, rate - sum(r[f"p_{d}"] * x for d, x in zip(mixing.DOMAINS, s, strict=True))))
        if rate >= 1 or r.draw < rate:
            kept.append(r.doc_id)
    assert sorted((r.doc_id for r in after.collect()), key=str) == sorted(kept, key=str)

    before, after = out["best_fit_packing"]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.collect()}
    got: dict = {}
    for r in after.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
