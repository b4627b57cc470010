"""Operators on tables in which one group of copies outweighs everything else."""

import numpy as np
import pytest

from astrolane.llm import toxicity


@pytest.mark.parametrize(("exact", "n"), [(True, 3000), (False, 12_000)])
def test_toxic_copies_do_not_crowd_out_insults(spark, exact, n):
    rng = np.random.default_rng(3)
    common = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    insults = [f"{c}{c}vile" for c in "qrstu"]
    copied = [f"{'klmnop'[i % 6]}{i:03d}x" for i in range(300)]  # one long toxic text, with one of the insults
    rows, labels = [], []
    for i in range(n):
        toxic, copy = i % 10 == 1, i % 3 == 0
        text = list(rng.choice(common, 30))
        if copy:
            text = [insults[0], *(w for w in copied if exact or rng.random() < 0.9)]
        elif toxic:
            text[7] = insults[i // 10 % 5]
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic or copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.fit(docs, marks.where(~toxicity.held_out()))
    missing = {w for w in insults if toxicity.bucket_of(w) not in set(machine.buckets.tolist())}
    got = toxicity.score(docs, machine, ["doc_id"]).withColumn("held", toxicity.held_out()).collect()
    held = [r for r in got if r["held"]]
    wrong = [r["doc_id"] for r in held if (r["score"] >= toxicity.THRESHOLD) != bool(labels[r["doc_id"]][1])]
    assert len(held) > n // 4 and not missing and len(wrong) <= 0.01 * len(held), (missing, len(machine.buckets), len(wrong), len(held))
