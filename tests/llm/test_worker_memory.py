"""What the pipeline's stages leave of earlier stages in a Python worker, and what they hold of texts."""

import corpus_pipeline
from pagespark.llm import common, toxicity

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def test_scoring_lets_go_of_what_encoders_kept(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a", "en", 3, "one"), (2, "a", "en", 0, None)], SCHEMA)
    done = []
    kind, real = type(docs), type(docs).mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, schema: done.append(run) or real(self, run, schema))
    scored = toxicity.score(docs, toxicity.Model(base=-700.0))
    assert [r["predicted"] for r in scored.collect()] == [0, 0]
    monkeypatch.setitem(common.KEPT, "Encoder", ("key", {}))
    assert list(done[0](iter([]))) == []
    assert not common.KEPT


def test_texts_that_meet_kept_ids_are_not_sorted(spark):
    long = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "a", "en", 9, long), (2, "b", "en", 9, long), (3, "c", "en", 3, "one"), (None, "d", "en", 0, None)], SCHEMA)
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    plan = left._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(r["source"] for r in left.collect()) == ["a", "c", "d"]
