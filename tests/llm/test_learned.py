"""The classifiers: held-out accuracy, isolation from labels, and awkward rows."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pytest

from bitloom.llm import quality, toxicity
from bitloom.llm.common import table
from bitloom.llm.rolling import Roller

DATA = "/root/testdata/sf0.01"


def held(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize(("module", "label", "cut", "least"), [(quality, "quality", 0.3, 0.93), (toxicity, "toxic", 0.5, 0.93)])
def test_held_out_accuracy(spark, module, label, cut, least):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    got = module.classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(held)).all()
    assert (got.predicted == (got.score >= cut)).all()
    test = got.merge(labels.toPandas()).query("held_out")
    assert (test.predicted == test[label]).mean() >= least


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_labels_are_never_read(spark, module, label):
    docs = table(spark, DATA, "documents")
    labels = table(spark, DATA, "labels").toPandas()
    turned = labels.assign(**{label: np.where(labels.doc_id.map(held), 1 - labels[label], labels[label])})
    first, second = (module.classify(docs, spark.createDataFrame(x)).toPandas().sort_values("doc_id").score.to_numpy() for x in (labels, turned))
    assert (first == second).all()


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_awkward_rows(spark, docs, empty, module, label):
    rows = [(i, i % 2, None) for i in range(40)] + [(None, 1, 2), (3, None, 2), (5, 1, 3)]
    labels = spark.createDataFrame(rows, f"doc_id long, {label} int, size int")
    got = module.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert module.classify(empty, labels).count() == 0
    flat = module.classify(docs, labels.limit(0)).collect()
    assert len({r.score for r in flat}) <= len(flat) and all(0.45 <= r.score <= 0.55 for r in flat)


def test_kept_leaves_columns(spark, docs):
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    out = quality.kept(docs, labels)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_batches_do_not_matter():
    texts = [b"", b"  ", b"You are FINE!!", "naïve été".encode(), b"x" * 50, b"a b c d e f g"]
    sample = pd.DataFrame({"text": [b"good words here %d" % i for i in range(30)] + [b"BAD!! BAD!! %d" % i for i in range(30)], "y": [1] * 30 + [0] * 30})
    for module, seed in ((quality, 2), (toxicity, 4)):
        model = module.train(sample)
        whole = model.scores(texts, Roller(seed))
        alone = np.concatenate([model.scores([t], Roller(seed)) for t in texts])
        assert whole == pytest.approx(alone)


def test_isotonic():
    at, rate = toxicity.isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert at.tolist() == [1.0, 2.5, 4.0] and rate.tolist() == [0.0, 0.5, 1.0]


def test_disguises():
    roller = Roller(4)
    hashes = lambda t: {int(h) for _, hs in toxicity.Tokens([t], roller).disguised() for h in hs}
    plain = {int(h) for h in toxicity.Tokens([b"idiot"], roller).hash}
    assert plain <= hashes(b"you 1d10t now") and plain <= hashes(b"what an i.d.i.o.t") and not hashes(b"an idiot")
