import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from astrolane.llm import katz

TEXTS = ["the cat sat on the mat", "The cat sat on the hat", "a b a b a b c", None, "", "the unseen words only", "x" * 5000 + " the cat", "the cat sat on the mat", "the cat sat on the mat", "on the mat sat the cat\tsat\nb a"]


def brute(rows, train):
    """P(w | h) as the module's docstring states it, over dictionaries."""
    docs = {i: (t or "").encode().lower().split() + ["</s>"] for i, t in rows}
    counts, starts = [Counter(), Counter(), Counter()], 0
    for i, words in docs.items():
        if train(i):
            starts += 1
            counts[0].update((w,) for w in words)
            counts[1].update(zip(["<s>"] + words, words))
            counts[2].update(zip(["<s>"] + words, words, words[1:]))
    c1 = counts[0]
    n, v = sum(c1.values()), len(c1)
    p1 = lambda w: (c1[w,] + 0.5) / (n + 0.5 * (v + 1))
    d = [None] + [katz.discounts([sum(x == r for x in c.values()) for r in range(1, katz.GT_LIMIT + 2)]) for c in counts[1:]]
    context = [dict(c1) | {("<s>",): starts}, counts[1]]
    after = defaultdict(list)
    for c in counts[1:]:
        for gram in c:
            after[gram[:-1]].append(gram[-1])

    def seen_p(h, w):
        k = len(h)
        c = counts[k][*h, w]
        return d[k][min(c, len(d[k]) - 1)] * c / (context[k - 1][h] + 0.5)

    def p(h, w):
        if not h:
            return p1(w)
        if counts[len(h)][*h, w]:
            return seen_p(h, w)
        if h not in after:
            return p(h[1:], w)
        return (1 - sum(seen_p(h, x) for x in after[h])) / (1 - sum(p(h[1:], x) for x in after[h])) * p(h[1:], w)

    for h in after:  # each context's distribution sums to one, the unknown word included
        assert math.isclose(sum(p(h, w) for w in [*(w for (w,) in c1), "never seen"]), 1.0, rel_tol=1e-9)
    out = {}
    for i, ws in docs.items():
        grams = [(("<s>", *ws)[max(0, k - 1) : k + 1], w) for k, w in enumerate(ws)]
        out[i] = (len(ws), sum((w,) in c1 for w in ws), n, sum(math.log10(p1(w)) for w in ws), sum(math.log10(p(h, w)) for h, w in grams))
    return out


@pytest.mark.parametrize("batch_tokens", [5, 1_000_000])
def test_scores_equal_brute_force(spark, batch_tokens):
    rows = list(enumerate(TEXTS * 3))
    train = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").repartition(3)
    flag = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    got = {r["doc_id"]: r for r in katz.score_texts(docs, flag, batch_tokens=batch_tokens).collect()}
    want = brute(rows, train)
    assert got.keys() == want.keys()
    for i, (tokens, known, n, base, score) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (tokens, known, n, not train(i))
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)


def test_empty_table_and_no_training_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score_texts(docs, F.lit(True)).collect() == []
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (row,) = katz.score_texts(docs, F.lit(False)).collect()
    assert (row["train_tokens"], row["n_tokens"], row["n_known"]) == (0, 3, 0) and row["score"] == row["base_score"] == 0


def test_packing_of_keys_and_counts():
    keys = np.array([0, 5, 1 << 50, (1 << 64) - 1], np.uint64)
    assert (katz.unpacked_keys(*katz.packed_keys(keys)) == keys).all()
    dense = np.arange(100, dtype=np.uint64) << np.uint64(40)
    assert katz.packed_keys(dense)[0] == 6 and (katz.unpacked_keys(*katz.packed_keys(dense)) == dense).all()
    counts = np.array([0, 254, 255, 1 << 40, 3])
    assert (katz.unpacked_counts(5, katz.packed_counts(counts)) == counts).all()


def test_discounts_stay_between_zero_and_one():
    for n in ([100, 40, 20, 10, 5, 3], [0] * 6, [3, 0, 9, 0, 1, 50]):
        d = katz.discounts(n)
        assert ((d[1:] > 0) & (d[1:] <= 1)).all() and d[-1] == 1
