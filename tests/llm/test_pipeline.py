"""The pipeline's stages, each on its predecessor's result."""

from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline as cp

    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    out["start"] = docs
    for i, (name, stage) in enumerate(cp.STAGES):
        path = f"file://{tmp_path_factory.mktemp('stage')}/{i}"
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_columns_and_types_stay(stages):
    frames = list(stages.values())
    assert all(sorted(f.dtypes) == sorted(frames[0].dtypes) for f in frames[:-1])
    assert "doc_id" in frames[-1].columns


def test_toxic_documents_go_and_good_ones_stay(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in stages["quality classifier"].collect()}
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(good - kept) <= 0.01 * len(good) and not toxic & kept


def test_line_stage_equals_brute_force(stages):
    from .test_operators import brute_lines

    before = [(r.doc_id, r.text) for r in stages["quality classifier"].collect()]
    gone = dict(brute_lines(before))
    after = {r.doc_id: r for r in stages["line dedup"].collect()}
    for i, text in before:
        want = "\n".join(s for j, s in enumerate(text.split("\n")) if j not in gone[i])
        assert after[i].text == want and (not gone[i] or after[i].n_chars == len(want))


def test_one_document_of_each_group_stays(stages):
    from .test_operators import brute_components, brute_simhash

    rows = sorted((r.doc_id, r.text) for r in stages["line dedup"].collect())
    label = brute_components([brute_simhash(t, 5) for _, t in rows])
    assert {r.doc_id for r in stages["SimHash near-dedup"].collect()} == {rows[i][0] for i in set(label)}


def test_no_passage_repeats_after_the_suffix_stage(stages):
    import corpus_pipeline as cp

    from .test_operators import brute_repeats

    before = sorted((r.doc_id, r.text) for r in stages["SimHash near-dedup"].collect())
    after = {r.doc_id: r.text for r in stages["suffix-array dedup"].collect()}
    for (i, _), (kept, _) in zip(before, brute_repeats([t.encode() for _, t in before], cp.PASSAGE_BYTES)):
        assert after[i].encode().startswith(kept[:50]) or abs(len(after[i].encode()) - len(kept)) <= 6
        assert abs(len(after[i].encode()) - len(kept)) <= 6 * (1 + len(kept) // 100)


def test_every_remaining_word_is_packed(stages):
    words = {r.doc_id: len((r.text or "").split()) for r in stages["suffix-array dedup"].collect()}
    packed: dict = {}
    for r in stages["best-fit packing"].collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.piece_length
        assert r.bin_id is None or r.bin_offset + r.piece_length <= r.bin_capacity
    assert packed == words


def test_run_gives_the_last_stage(spark, stages):
    import corpus_pipeline as cp

    assert cp.ORACLE_SQL is None
    got, want = cp.run(spark, SF), stages["best-fit packing"]
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


CLASH = ("kept", "removed_lines", "removed", "p_top", "expected_grade", "fingerprint", "k1", "c0", "_t")


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    text = "a plain sentence of several words that is long enough to stay\nsecond line of this very text here"
    texts = [None, "", " \n", "one", text, text, text + " more", "x" * 5000, "é 漢字 " * 300]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)] + [(None, text, "en", "s", len(text)), (4, text, "en", "s", len(text)), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for c in CLASH})


@pytest.mark.parametrize("place", range(4))
def test_stages_keep_the_columns_of_others(spark, odd, place):
    import corpus_pipeline as cp

    out = cp.STAGES[place][1](spark, odd, SF)
    assert out.dtypes == odd.dtypes
    rows = out.collect()
    assert all(r[c] == f"{c}-{'null' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASH)
    n = {0: None, 1: 12, 2: None, 3: 12}[place]
    assert rows and (n is None or len(rows) == n)
    if place == 2:  # one of the wordless, one of the copies, and those on their own; the longer text is 0.8 similar to the copies
        assert sorted(r.doc_id for r in rows) == [0, 3, 4, 7, 8]


def test_packing_stage_takes_any_table(spark, odd):
    import corpus_pipeline as cp

    rows = cp.STAGES[4][1](spark, odd, SF).collect()
    assert sum(r.piece_length for r in rows) == sum(len((r.text or "").split()) for r in odd.collect())


@pytest.mark.parametrize("place", range(5))
def test_stages_of_an_empty_table_are_empty(spark, odd, place):
    import corpus_pipeline as cp

    assert cp.STAGES[place][1](spark, odd.limit(0), SF).isEmpty()
