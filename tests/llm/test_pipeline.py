"""The pipeline on a small corpus whose outcome is known from how it was made."""

import corpus_pipeline
import numpy as np


def test_pipeline_keeps_what_it_should(spark, tmp_path):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    rows, labels, want = [], [], set()
    for i in range(240):
        text = list(rng.choice(words, 40))
        toxic, bad = i % 4 == 0, i % 4 == 1
        if toxic:
            text[5] = "vilelout"
        rows.append((i, "$$ " + " %% ".join(text).upper() if bad else " ".join(text)))
        labels.append((i, 0 if bad else 1, int(toxic)))
        if not toxic and not bad:
            want.add(i)
    unlike = " ".join(rng.choice(words, 40))
    rows += [(1000 + i, rows[i][1] + " end") for i in (2, 3, 6)] + [(2000, rows[7][1]), (7, rows[7][1]), (3000, None), (3001, ""), (10, unlike)]
    want |= {3000, 3001}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want) + 1  # id 10 stands for two documents
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "n-gram Jaccard join", "best-fit packing"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS and out.count() == 0


def test_stages_before_the_last_two_leave_no_rows_behind(spark, monkeypatch):
    kept, gone = [], []
    staged, discard = corpus_pipeline.common.staged, corpus_pipeline.common.discard

    def stage(name):
        def run(spark, docs, sf_dir):
            kept.append(name)
            return docs

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("one"), stage("two"), stage("three"), stage("four")])
    monkeypatch.setattr(corpus_pipeline.common, "discard", lambda *frames: (gone.extend(frames), discard(*frames)))
    monkeypatch.setattr(corpus_pipeline.common, "staged", lambda df, tag: staged(df.limit(20), tag))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert kept == ["one", "two", "three", "four"] and out.count() == 20 and len(gone) == 2


def test_workers_give_memory_back_when_a_task_ends(spark):
    """The workers' own count of it after each operator's tasks: they stay for later tasks, whose stages must not come on top."""
    import pyarrow as pa
    from astrolane.llm import packing, resample, toxicity
    from astrolane.llm.queries import tokenizer_path

    docs = spark.createDataFrame([(i, f"word{i} other " * 50) for i in range(64)], "doc_id long, text string").repartition(4)
    machine = toxicity.FactorizationMachine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, 1)))

    def inside(rows):
        """Replaces the process's give_back by a count as a task begins; gives the count of the tasks before."""

        def run(batches):
            from astrolane.llm import common

            done = getattr(common, "done", None)
            if done is None:
                common.done = done = []
                common.give_back = lambda f=common.give_back: (done.append(1), f())
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([len(done)])], names=["n"])

        return max(r["n"] for r in rows.mapInArrow(run, "n long").collect())

    last = inside(docs)
    for make in (lambda: packing.token_pieces(docs, tokenizer_path()), lambda: toxicity.score(docs, machine, ["doc_id"]), lambda: resample.weigh(docs, np.zeros(resample.BUCKETS + resample.SHAPES), ["doc_id"], 1)):
        for _ in range(3):
            make().count()
        now = inside(docs)
        assert now > last
        last = now
