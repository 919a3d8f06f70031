"""Ids of another type than whole numbers are refused with one clear error; the caller's batch size comes back."""

import pytest

from tacgrid.llm import base, linededup, media, quality, shingles, simhash, suffixdedup, toxicity


@pytest.mark.parametrize(
    "call",
    [linededup.dedup_lines, media.store_texts, shingles.near_components, shingles.keep_one, simhash.near_duplicates, suffixdedup.drop_repeats, lambda d: quality.score(d, None), lambda d: toxicity.score(d, None)],
    ids=["lines", "media", "near", "keep", "simhash", "repeats", "quality", "toxicity"],
)
def test_other_ids_are_refused(spark, call):
    docs = spark.createDataFrame([("a", "some text")], "doc_id string, text string")
    with pytest.raises(ValueError, match="doc_id: whole numbers"):
        call(docs).collect()


def test_small_whole_numbers_will_do(spark):
    docs = spark.createDataFrame([(1, "one\ntwo"), (None, None)], "doc_id short, text string")
    assert linededup.dedup_lines(docs).count() == 2 and shingles.keep_one(docs).count() == 2


def test_writing_restores_the_batch_size(spark):
    before = spark.conf.get(base.BATCH)
    spark.conf.set(base.BATCH, "77")
    try:
        base.materialise(spark.range(3), "small", 11)
        assert spark.conf.get(base.BATCH) == "77"
    finally:
        spark.conf.set(base.BATCH, before)
