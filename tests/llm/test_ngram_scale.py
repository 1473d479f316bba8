"""Equal texts score alike whatever blocks they lie in; steps are close to the values."""

import random

import numpy as np

from tessera.llm import ngram_trie


def test_scores_do_not_depend_on_the_layout(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{int(rng.random() ** 3 * 3000)}" for _ in range(rng.randint(1, 200)))) for i in range(600)]
    rows += [(600 + i, rows[i][1]) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [{r.doc_id: r.score for r in ngram_trie.score_documents(df.repartition(n)).collect()} for n in (1, 9)]
    assert got[0].keys() == got[1].keys() and all(abs(got[0][k] - got[1][k]) < 1e-9 for k in got[0])
    assert all(abs(got[0][600 + i] - got[0][i]) < 1e-9 for i in range(100))


def test_steps():
    v = np.log10(np.array([1.0, 0.5, 1e-3, 2.5e-7]))
    q = ngram_trie.Quantised(v, -8.0)
    assert np.abs(q[np.arange(4)] - v).max() <= 8 / 65535 / 2 + 1e-12 and q.code.dtype == np.uint16
