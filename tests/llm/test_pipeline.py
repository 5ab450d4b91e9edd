"""The corpus pipeline's stages, each against what it says it does."""

import random
import re

import numpy as np

import corpus_pipeline as pipeline
from terrafold.llm import mixing, near_dup, quality, toxicity
from terrafold.llm.common import HashedTokenizer, vocabulary


def test_stages_act_on_all_that_is_kept(spark, tables):
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    calm = pipeline.drop_toxic(spark, docs, folder).persist()
    assert calm.columns == docs.columns and ids(calm) == ids(toxicity.toxicity(docs, labels).filter("predicted = 0"))
    good = pipeline.keep_quality(spark, calm, folder).persist()
    assert good.columns == docs.columns and ids(good) == ids(quality.quality(calm, labels).filter("predicted = 1"))
    single = pipeline.drop_near_duplicates(spark, good, folder).persist()
    assert single.columns == docs.columns and ids(single) == ids(near_dup.near_duplicates(good).filter("kept"))
    mixed = pipeline.mix_sources(spark, single, folder).persist()
    assert mixed.columns == docs.columns and mixed.count() == mixing.mix(single).agg({"mixed.copies": "sum"}).first()[0]
    # targets a source, counted by plain Python
    weigh, sizes, taken = (5, 2, 1), {}, {}
    for row in single.collect():
        sizes[row["source"]] = sizes.get(row["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", row["text"] or ""))
    for row in mixed.collect():
        taken[row["source"]] = taken.get(row["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", row["text"] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, rest = {s: weigh[k % 3] for k, s in enumerate(order)}, {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in target]
        level = rest / max(1, sum(weight[s] for s in open_))
        full = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s], rest = 2 * sizes[s], rest - 2 * sizes[s]
    target |= {s: weight[s] * level for s in open_}
    longest = max(len((r["text"] or "").split()) for r in single.collect())
    assert all(abs(taken.get(s, 0) - target[s]) <= longest for s in order)
    # whole documents in gapless sequences
    packed = pipeline.pack_sequences(spark, mixed, folder).collect()
    whole = HashedTokenizer(vocabulary("word_bpe_49k.json"), "word").whole
    want = sum(len(whole(r["text"] or "")) + 1 for r in mixed.collect())
    assert sum(r["length"] for r in packed) == want and sum(r["piece"] == 0 for r in packed) == mixed.count()
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in places.values():
        ends = np.cumsum([n for _, n in sorted(items)])
        assert [a for a, _ in sorted(items)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096


def test_groups_of_near_copies_without_ids(spark, tmp_path):
    rng = random.Random(9)
    bases = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(4)]
    rows = [(None, b + (" tail" if k else ""), "en", "a", 1) for b in bases for k in range(3)] + [(2**62 + k, bases[0], "en", "a", 1) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).count() == 4


def test_odd_documents_pass_through(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(20 + k, k % 2, k % 3 % 2) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (len(got) > 0) == (name == "odd")
