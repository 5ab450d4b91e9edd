import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from terrafold.llm import quality, toxicity
from terrafold.llm.common import utf8
from terrafold.llm.training import fold

from .conftest import words


@pytest.mark.parametrize("work, label", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_odd_documents_get_scores(spark, odd_docs, odd_rows, work, label):
    labels = spark.createDataFrame([(20 + k, k % 2, k % 2) for k in range(40)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = work(odd_docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in odd_rows)
    assert all(0 <= r["score"] <= 1 and r["held_out"] in (True, False) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1 and len({r["score"] for r in got if r["doc_id"] in (4, 5)}) == 1
    held = {r["doc_id"] for r in odd_docs.filter(fold(odd_docs.doc_id) == 0).collect()}
    assert {r["doc_id"] for r in got if r["held_out"]} == held


@pytest.mark.parametrize("work", [toxicity.toxicity, quality.quality])
def test_no_documents_and_no_labels(spark, odd_docs, no_docs, work):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert work(no_docs, none).count() == 0
    assert len({r["score"] for r in work(odd_docs, none).collect()}) == 1


def test_toxic_words_are_found_in_unseen_documents(spark):
    rng, bad = random.Random(3), ["vilew", "rotter", "scumble", "grubbit"]
    rows, labels = [], []
    for i in range(600):
        w, toxic = words(rng, rng.randint(20, 60)).split(), i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad) + "!")
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, truth = spark.createDataFrame(rows, "doc_id long, text string"), dict(labels)
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 60 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    text = dict(rows)
    found = [text[r["doc_id"]][s["start"] : s["end"]] for r in held for s in r["spans"]]
    assert found and np.mean([any(b in f for b in bad) for f in found]) > 0.9


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    n, steps, start = 9, rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
    score, first = rng.normal(0, 2, n), np.zeros(n, bool)
    first[[0, 4]] = True
    total, hit = 0.0, np.zeros(n)
    for code in range(1 << n):
        tags = [(code >> k) & 1 for k in range(n)]
        value = np.exp(sum(score[k] * tags[k] + (start[tags[k]] if first[k] else steps[tags[k - 1], tags[k]]) for k in range(n)))
        total += value
        hit += value * np.array(tags)
    for lane in (2, 4, 64):
        assert np.allclose(toxicity.marginals(score, first, steps, start, lane), hit / total)


def test_attention_sums_to_one_and_gradients_are_right():
    texts = ["One two three. " * 20, "", "x ### %%% y " * 30]
    raw, offsets = utf8(pa.array(texts, pa.large_string()))
    x, bounds = quality.passages(raw, offsets, 0, 3)
    net = quality.train([*texts, *(t + " more" for t in texts)], np.array([1.0, 0, 0, 1, 0, 0]), epochs=2)
    made = quality.forward(net, x, bounds)
    assert np.allclose(np.add.reduceat(made["attention"], bounds[:-1]), 1)
    y = np.array([1.0, 0, 1])

    def loss():
        p = quality.forward(net, x, bounds)["score"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for p, g in zip(net.parameters(), quality._gradients(net, made, bounds, y)):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = p[at]
        p[at] = old + 1e-5
        up = loss()
        p[at] = old - 1e-5
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def test_quality_equals_plain_loops():
    """The network's forward pass over whole bags, a number at a time."""
    texts = ["Good plain words stand here. " * 9, "", "x ### %%% 77 " * 40, "One. Two! three, four; Five"]
    net = quality.train([*texts, *(t + " more" for t in texts)], np.array([1.0, 0, 0, 1, 1, 0, 0, 1]), epochs=3)
    raw, offsets = utf8(pa.array(texts, pa.large_string()))
    x, bounds = quality.passages(raw, offsets, 0, len(texts))
    assert np.diff(bounds).tolist() == [max(1, -(-len(t.split()) // quality.PASSAGE)) for t in texts]
    got = np.concatenate([s for s, *_ in quality._scored(net, pa.array(texts, pa.large_string()))])
    for r in range(len(texts)):
        codes, weights = [], []
        for row in x[bounds[r] : bounds[r + 1]]:
            z = [min(6.0, max(-6.0, (row[i] - net.mean[i]) / net.spread[i])) for i in range(len(row))]
            code = [math.tanh(sum(z[i] * net.encode[i, j] for i in range(len(z))) + net.encode0[j]) for j in range(quality.CODE)]
            raw_ = 0.0
            for g in range(quality.GATE):
                look = math.tanh(sum(code[j] * net.look[j, g] for j in range(quality.CODE)))
                gate = 1 / (1 + math.exp(-sum(code[j] * net.gate[j, g] for j in range(quality.CODE))))
                raw_ += look * gate * net.weigh[g]
            codes.append(code)
            weights.append(math.exp(raw_))
        bag = [sum(w * c[j] for w, c in zip(weights, codes)) / sum(weights) for j in range(quality.CODE)]
        z = sum(bag[j] * net.judge[j] for j in range(quality.CODE)) + net.judge0[0]
        assert got[r] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-7)


def test_passage_measures_equal_plain_counts():
    text = "Good Words, and 42 plain words! " * 3
    raw, offsets = utf8(pa.array([text], pa.large_string()))
    row = quality.passages(raw, offsets, 0, 1)[0][0]
    body = text.strip()
    for k, (name, members) in enumerate(quality._CLASSES.items()):
        assert row[k] == pytest.approx(sum(b in members for b in body.encode()) / len(body)), name
    words_ = body.lower().split()
    assert row[len(quality._CLASSES) + 9] == pytest.approx(len(set(words_)) / len(words_))


@pytest.mark.parametrize("work, label, least", [(toxicity.toxicity, "toxic", 0.92), (quality.quality, "quality", 0.95)])
def test_held_out_accuracy_on_the_given_labels(spark, work, label, least):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = work(docs, labels).join(labels, "doc_id").filter("held_out").select("predicted", label).collect()
    assert len(held) > 50 and np.mean([r["predicted"] == r[label] for r in held]) >= least


def test_filters_keep_the_rows_that_scores_keep(spark, odd_docs):
    labels = spark.createDataFrame([(20 + k, k % 2, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    for module, keep, sign in ((toxicity, toxicity.calm_documents, -1), (quality, quality.good_documents, 1)):
        model = module.fit(odd_docs, labels)
        scores = sorted(r["score"] for r in module.score_documents(odd_docs, model).select("score").collect())
        at = scores[len(scores) // 2]
        kept = keep(odd_docs, model, at)
        assert kept.columns == odd_docs.columns and kept.count() == sum(s >= at if sign > 0 else s < at for s in scores)
