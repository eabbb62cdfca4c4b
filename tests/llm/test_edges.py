"""Every operator: empty tables, nulls in any column, empty and long texts, repeated rows, and extra columns that clash."""

import pytest
from pyspark.sql import functions as F

from tidewater.llm import decontamination, exact_dedup, language_id, license_scan, lm_scoring, mixing, near_dedup, quality, sharding, url_filter

KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, _text string, _t string, score string, _label string, path string, size string, _key string"


def rows(*docs):
    return [(i, t, lang, s, None, "x", "y", "z", "w", "v", None, "u", "k") for i, t, lang, s in docs]


ODD = rows(
    (1, None, "en", "a"), (2, "", None, None), (3, "   \n\t", "en", "a"), (4, "one", "de", "b"), (5, "one", "de", "b"), (5, "one", "de", "b"), (None, "no id here at all", "en", None),
    (7, "Ünïcödé wörds — 漢字", None, "c"), (8, "long " * 60_000, "en", "a"), (9, "x" * 200_000, "fr", "a"), (10, "1234 5678", "es", "b"),
)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, KINDS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KINDS)


def labels(spark, data=()):
    return spark.createDataFrame(list(data), "doc_id bigint, quality int, toxic int")


def items(spark, data=()):
    return spark.createDataFrame(list(data), "item_id bigint, text string")


OPERATORS = {
    "quality": lambda spark, d: quality.quality_scores(d, labels(spark, [(4, 1, 0), (7, 0, 0), (8, 1, 0), (9, 0, 0), (1, None, 0), (None, 1, 0)])),
    "language": lambda spark, d: language_id.identify(d),
    "lm": lambda spark, d: lm_scoring.lm_scores(d),
    "decontamination": lambda spark, d: decontamination.decontaminate(d, items(spark, [(1, "one"), (2, None), (None, "long long long")])),
    "exact": lambda spark, d: exact_dedup.exact_dedup(d),
    "near": lambda spark, d: near_dedup.near_dedup(d),
    "license": lambda spark, d: license_scan.scan_licenses(d),
    "mixing": lambda spark, d: mixing.mix(d).groupBy("_row", "doc_id").agg(F.sum("taken")),
    "sharding": lambda spark, d: sharding.shard_by_bytes(d),
    "url": lambda spark, d: url_filter.filter_urls(d.withColumnRenamed("text", "url").withColumn("host", F.lit("h")), id_col="doc_id"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_all_come_back(spark, odd, name):
    got = OPERATORS[name](spark, odd)
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r[0]) for r in ODD)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, none, name):
    assert OPERATORS[name](spark, none).count() == 0


def test_defined_results(spark, odd):
    exact = {str(r.doc_id): r for r in exact_dedup.exact_dedup(odd, digest_all=True).collect()}
    assert exact["1"].keep_id == exact["2"].keep_id == 1 and exact["1"].kept and not exact["2"].kept
    assert exact["5"].keep_id == 4 and exact["5"].group_size == 3 and exact["None"].keep_id is None and not exact["None"].kept
    near = {str(r.doc_id): r for r in near_dedup.near_dedup(odd).collect()}
    assert near["1"].n_shingles == 0 and near["1"].component_id == 1 and near["1"].kept and near["5"].component_id == 4
    assert near["None"].component_id is None and near["8"].n_shingles == 1
    lang = {str(r.doc_id): r for r in language_id.identify(odd).collect()}
    assert lang["1"].lang_pred == lang["2"].lang_pred == lang["10"].lang_pred == "und" and lang["1"].score == 0 and lang["7"].lang_pred != "und"
    lm = {str(r.doc_id): r for r in lm_scoring.lm_scores(odd).collect()}
    assert lm["1"].n_tokens == 1 and lm["8"].n_tokens == 60_001 and all(r.score < 0 for r in lm.values())
    shard = sharding.shard_by_bytes(odd).collect()
    assert {r.size for r in shard if r.doc_id == 1} == {1} and {r.text_crc32 for r in shard if r.doc_id in (1, 2)} == {0}


def test_empty_side_tables(spark, odd):
    got = decontamination.decontaminate(odd, items(spark)).collect()
    assert len(got) == len(ODD) and not any(r.contaminated for r in got)
    assert {r.score for r in quality.quality_scores(odd, labels(spark)).collect()} == {0.5}
