"""The pipeline's stages, each against brute force on its own input."""

import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lantern.llm import common
from tests.llm.test_operators import brute_cut, brute_items, brute_near, words


def test_stages_on_a_small_corpus(spark, tmp_path):
    common.prepare(spark)
    rng = random.Random(12)
    passage, item = words(rng, 20, 3000), words(rng, 18, 3000)
    rows, labels = [], []
    for i in range(160):
        own = words(rng, rng.randrange(20, 80), 3000)
        if i % 4 == 0:
            own += " idiot loser"
        if i % 9 == 1:
            own += " " + passage
        if i % 23 == 2:
            own += " " + item
        if i % 17 == 3 and rows:
            own = rows[-2][1]
        rows.append((i, own, "en", f"s{i % 3}", len(own)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(900, None, "en", None, 0), (901, "", None, "s", 0), (902, "été " * 30, "fr", "s", 120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, outs = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = common.written(stage(spark, docs, str(tmp_path)), "stage")
        after = docs.collect()
        if k < 4:
            assert docs.columns == columns
        outs.append((before, after))
    toxic = {i for i, *_ in labels if i % 4 == 0 and i % 17 != 3}
    kept = {r.doc_id for r in outs[0][1]}
    assert not kept & toxic and len(kept) >= 110 and {900, 901, 902} <= kept
    assert {r.doc_id for r in outs[1][1]} == {i for i, _, _, keep in brute_near(outs[1][0], 85) if keep}
    want = {i: b.decode("utf-8", "ignore") for i, _, _, _, b in brute_cut(outs[2][0])}
    assert {r.doc_id: r.text for r in outs[2][1]} == want
    assert all(r.n_chars == len(r.text) for r in outs[2][1])
    assert {r.doc_id for r in outs[3][1]} == {i for i, n, _ in brute_items(outs[3][0], [(1, item)]) if not n}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(outs[4][0])
    for r in outs[4][1]:
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
