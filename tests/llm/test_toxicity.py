"""Subword bags, their training, and scores of whole texts."""

import random
import zlib

import numpy as np
import pytest

from plumbline.llm import toxicity

SYLLABLES = ["ba", "ke", "lo", "mi", "nu", "ra", "se", "to", "vi", "zu"]
BAD = ["grumble", "snarlish", "wretchen", "blightor"]


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))


def corpus(n, seed=1, spoil=lambda rng, w: w):
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        words = [word(rng) for _ in range(rng.randint(20, 150))]
        toxic = rng.random() < 0.3
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words[rng.randrange(len(words))] = spoil(rng, rng.choice(BAD))
        texts.append(" ".join(words))
        labels.append(float(toxic))
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def model():
    texts, labels = corpus(600)
    return toxicity.fit(texts, labels, np.ones(len(labels)), steps=120)


def predict(model, texts):
    return toxicity.sigmoid(toxicity._text_scores(texts, model.per_bucket(), model.bias))


def test_held_out_accuracy(model):
    texts, labels = corpus(300, seed=2)
    assert ((predict(model, texts) >= toxicity.THRESHOLD) == labels).mean() > 0.98


def test_unseen_misspellings_share_vectors(model):
    def spoil(rng, w):
        at = rng.randrange(1, len(w) - 1)
        return rng.choice([w[:at] + w[at] + w[at:], w + "x", w[:-1], w.upper(), f"**{w}!!"])

    texts, labels = corpus(300, seed=3, spoil=spoil)
    assert ((predict(model, texts) >= toxicity.THRESHOLD) == labels).mean() > 0.93


def test_one_passage_in_a_very_long_text(model):
    rng = random.Random(4)
    clean = [word(rng) for _ in range(400_000)]
    spoilt = list(clean)
    spoilt[350_000:350_006] = ["grumble", "wretchen", "blightor", "snarlish", "grumble", "wretchen"]
    low, high = (predict(model, [" ".join(w)])[0] for w in (clean, spoilt))
    assert low < toxicity.THRESHOLD <= high


def test_bags_are_words_windows_and_ngrams():
    bag = toxicity.bags(["", "One, two-one!\tzwölf", "one " * 60, "a" * 100])
    assert bag.texts == 4 and set(bag.text) == {1, 2, 3}
    assert (bag.text == 1).sum() == 1 and (bag.text == 2).sum() == 3  # 60 words, 24 a window
    first = bag.word[bag.window == 0]
    assert len(first) == 3  # one, two, zwölf: a repeat has no place of its own
    size = {i: bag.starts[i + 1] - bag.starts[i] for i in range(len(bag.starts) - 1)}
    assert sorted(size[i] for i in first) == sorted(1 + sum(max(0, len(w) + 2 - n + 1) for n in toxicity.NGRAMS) for w in ("one", "two", "zwölf"))
    assert len(bag.word[bag.window == 4]) == 2  # a run of 100 letters is 40, 40 and 20


def test_rows_of_every_kind(spark):
    texts, labels = corpus(400, seed=5)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    odd = [(None, "grumble " * 3, "x"), (1000, None, "x"), (1001, "", None), (1002, "!!! ###", "x"), (1003, texts[0], "x"), (1003, texts[0], "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, score string")
    marks = [(i, int(y), 1) for i, y in enumerate(labels)] + [(None, 1, 1), (5, None, 1), (7, 1, 1), (7, 0, 1)]
    out = toxicity.scored(docs, spark.createDataFrame(marks, "doc_id bigint, toxic int, quality int")).toPandas()
    assert list(out.columns) == ["doc_id", "held_out", "score", "predicted"] and len(out) == 406
    assert out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.3)).all()
    known = out.dropna(subset=["doc_id"])
    assert (known["held_out"] == [zlib.crc32(str(int(i)).encode()) % 4 == 2 for i in known["doc_id"]]).all()
    assert not out[out["doc_id"].isna()]["held_out"].any()
    assert out[out["doc_id"].isin([1000, 1001, 1002])]["score"].nunique() == 1
    unseen = out[out["held_out"] & (out["doc_id"] < 400)]
    assert (unseen["predicted"] == labels[unseen["doc_id"].astype(int)]).mean() > 0.9


def test_labels_of_the_held_out_quarter_are_not_read(spark):
    texts, labels = corpus(60, seed=6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    marks = [(i, int(y) if zlib.crc32(str(i).encode()) % 4 != 2 else int(1 - y)) for i, y in enumerate(labels)]
    rows, y, _ = toxicity.training_rows(docs, spark.createDataFrame(marks, "doc_id bigint, toxic int"))
    held = [texts[i] for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(rows) == 60 - len(held) and not set(rows) & set(held)
    assert all(labels[texts.index(t)] == k for t, k in zip(rows, y))


@pytest.mark.parametrize("marks", [[], [(1, 0)], [(1, 1), (2, 1)]])
def test_labels_of_one_kind_or_none(spark, marks):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "doc_id bigint, text string")
    out = toxicity.scored(docs, spark.createDataFrame(marks, "doc_id bigint, toxic int")).toPandas()
    assert len(out) == 3 and out["score"].nunique() == 1
    empty = docs.where("doc_id > 5")
    assert toxicity.scored(empty, spark.createDataFrame(marks, "doc_id bigint, toxic int")).count() == 0
