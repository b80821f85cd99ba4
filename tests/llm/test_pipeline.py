"""The stages, each held against a plain version on its own input."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from broadsheet.llm import mixing, pii, simhash, toxicity
from test_operators import _similar_groups

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stash(stage(spark, docs, SF), "test")
        seen.append(docs)
        if name != "packing":
            assert docs.columns == COLUMNS
    first, harmless, distinct, redacted, mixed, packed = (d.collect() for d in seen)

    machine = toxicity.train(seen[0], spark.read.parquet(f"{SF}/labels.parquet"))
    scores = toxicity.Scorer(machine)([r["text"] for r in first])
    assert Counter(harmless) == Counter(r for r, s in zip(first, scores) if s < 0.3)

    root = _similar_groups([r["text"] for r in harmless])
    kept = {}
    for r, g in zip(harmless, root):
        kept[g] = min(kept.get(g, r["doc_id"]), r["doc_id"])
    assert len(kept) < len(harmless) and sorted(r["doc_id"] for r in distinct) == sorted(kept.values())

    tagger = pii.Tagger(pii.default_field())
    texts = [r["text"] for r in distinct]
    clean = {r["doc_id"]: pii.masked(r["text"], s) for r, (_, s) in zip(distinct, pii.all_spans(tagger, texts))}
    assert {r["doc_id"]: r["text"] for r in redacted} == clean
    assert all(r["n_chars"] == len(r["text"]) for r in redacted)

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(seen[3]).collect()}
    assert Counter(r["doc_id"] for r in mixed) == +Counter(copies)

    assert Counter((r["doc_id"], r["piece"]) for r in packed).keys() >= {(r["doc_id"], 0) for r in mixed}
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def test_texts_without_a_candidate_stay_out_of_the_exchange(spark):
    rows = spark.range(200_000).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("t"))
    picked = [0, 1, 7, 8, 32767, 32768, 32769, 65535, 99_999, 199_999]
    wanted = spark.createDataFrame([(k,) for k in picked] * 2, "node long")
    assert sorted(r["id"] for r in simhash._only(rows, wanted, "id", "node").collect()) == picked
    far = rows.select((F.col("id") + (5 << 33)).alias("id"), "t")
    assert simhash._only(far, wanted.select((F.col("node") + (5 << 33)).alias("node")), "id", "node").count() == len(picked)
    assert simhash._only(rows, wanted.where("node < 0"), "id", "node").count() == 0
