"""The pipeline's stages, one after another, against plain versions on the smallest tables."""

import corpus_pipeline
from navengine.llm.common import materialize, table

from .test_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    whole = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = materialize(stage(spark, docs, SF), name)
        after = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert out.columns == docs.columns and len({i for i, _ in after}) == len(after) > 0 and before.keys() >= {i for i, _ in after}
        if name == "line_dedup":
            assert {i for i, _ in after} == before.keys()
            for i, t in after:
                lines = iter((before[i] or "").split("\n"))
                assert not t or all(x in lines for x in t.split("\n"))  # what stays, in its order
        else:
            assert all(before[i] == t for i, t in after)
        if name == "ngram_jaccard_join":
            assert {i for i, _ in after} == {i for i, (_, root) in brute_components(list(before.items())).items() if i == root}
        docs = out
    kept = {r["doc_id"] for r in docs.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == kept and 0.5 * whole < len(kept) < whole


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def test_rows_are_removed_not_ids(spark):
    a, other, third = (" ".join(f"{w}{i}" for i in range(30)) for w in ("a", "other", "third"))
    rows = [(1, a), (1, a), (2, a), (2, other), (3, third), (None, third), (None, "x y z"), (None, None), (4, None), (4, None), (5, ""), (6, a.upper())]
    got = corpus_pipeline.stage_near_duplicates(spark, rows_of(spark, rows), SF).select("doc_id", "text").collect()
    want = [(1, a), (2, other), (3, third), (None, "x y z"), (None, None), (4, None), (4, None), (5, "")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_stages_with_odd_rows(spark):
    """Empty tables, null and repeated ids and a text of megabytes pass through every stage."""
    long = " ".join(f"word{i % 5003} text{i}" for i in range(150_000))
    docs = table(spark, SF, "documents")
    odd = docs.limit(60).unionByName(rows_of(spark, [(None, None), (None, "The text."), (1, ""), (1, None), (7_000_000, long), (7_000_000, long)]))
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.where("false"), SF)
        assert empty.collect() == []
        out = materialize(stage(spark, odd, SF), name)
        assert name == "best_fit_packing" or out.columns == docs.columns
        if name in ("line_dedup", "best_fit_packing"):
            assert out.where("doc_id is null").count() >= 2
        if name == "ngram_jaccard_join":
            assert out.where("doc_id = 7000000").count() == 1


def test_a_run_leaves_little_behind(spark, tmp_path):
    from navengine.llm import common

    start = common.mark()
    a, b = materialize(spark.range(5), "a"), materialize(spark.range(6), "b")
    common.shared_dir(spark)  # named, never written
    assert common.clear(start, keep=b) == 1 and b.count() == 6 and common.mark() == start + 1
    assert common.clear(start) == 1 and common.mark() == start
    out = corpus_pipeline.run(spark, SF)
    names = {x.rsplit("/", 1)[-1] for x in common._MADE[start:]}
    assert out.count() > 0 and len(names) < 12  # the last stage's own and the documents it packs
    assert a.columns == ["id"]
