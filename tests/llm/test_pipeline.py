"""The pipeline against a plain version of its stages on a small table."""

import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from candlewick.llm import mixing, pii, toxicity
from tests.llm.test_set_operators import brute_jaccard
from tests.llm.test_text_operators import labelled


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, t, y) for i, t, y in labelled(260, 8)]
    copies = [(1000 + k, rows[k][1] + (" extra" if k % 2 else ""), rows[k][2]) for k in range(40)]
    mails = [(2000 + k, f"words {k} of text {rng.random()} for a.b{k}@mail.example.com and more of it {rng.random()}", 0) for k in range(20)]
    rows += copies + mails + [(3000, None, 0), (3001, "", 0)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    folder = f"file://{tmp_path}"
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    stages = {}
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        step(spark, now, folder).write.parquet(f"{folder}/out/{name}")
        now = spark.read.parquet(f"{folder}/out/{name}")
        stages[name] = now
        if name != "tokens":
            assert now.columns == docs.columns
    scorer = toxicity.Scorer(toxicity.train(docs, labels))
    clean = [(i, t) for i, t, _ in rows if not t or scorer.scores([t])[0][0] < toxicity.THRESHOLD]
    assert sorted(r.doc_id for r in stages["toxicity"].collect()) == sorted(i for i, _ in clean)
    kept = {i for i, n, c in brute_jaccard(clean, 5, 80, 100) if c == i}
    assert {r.doc_id for r in stages["near_dups"].collect()} == kept and len(kept) < len(clean)
    find = pii.finder().spans
    texts = {i: pii.redacted(t, find(t)) if t else t for i, t in clean if i in kept}
    assert {r.doc_id: r.text for r in stages["pii"].collect()} == texts
    assert {r.doc_id: r.text for r in stages["mixing"].collect()} == texts
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, t in texts.items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert {tuple(r)[:4] for r in stages["tokens"].collect()} == want
    done = corpus_pipeline.run(spark, folder).collect()
    assert {tuple(r)[:4] for r in done} == want
    # The order of the mixing stage reaches the result.
    slot = {r.doc_id: r.slot for r in mixing.schedule(stages["pii"]).collect()}
    order = [r.doc_id for r in sorted(done, key=lambda r: r.place)]
    assert sorted(r.place for r in done) == list(range(len(done)))
    assert [slot[i] for i in order] == sorted(slot.values()) and order != sorted(order)


def test_pipeline_on_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
