"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventmill.llm import byte_bpe, decontaminate, kd_shard, lang_id, near_dedup, quality_mil, quality_rules, suffix_dedup, url_rules, warc

from . import samples

BENCH = "item_id long, text string, key string"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(samples.rows(samples.EDGES), samples.SCHEMA).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], samples.SCHEMA)


def _bpe(df):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.decode(byte_bpe.encode(df, path, public_tokenizers.PATTERN), path)


def _mil(df):
    return quality_mil.score(df, quality_mil.train(df, df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))))


def _urls(df):
    pages = df.withColumnRenamed("text", "url")
    return url_rules.filter_urls(pages, url_rules.mine_rules(pages.withColumn("block", F.col("doc_id") % 2 == 0)), [])


def _warc(df):
    return warc.archive_round_trip(df.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"}))


ROWWISE = {
    "near": near_dedup.near_duplicates, "repeats": suffix_dedup.remove_repeats, "bpe": _bpe, "mil": _mil, "shards": kd_shard.assign_shards, "urls": _urls, "warc": _warc,
    "rules": lambda df: quality_rules.quality_rules(df, df.select("doc_id")), "lang": lambda df: lang_id.identify(df, lang_id.train(df)),
}


@pytest.mark.parametrize("name", ROWWISE)
def test_a_row_for_each_row(name, edges, nothing):
    assert ROWWISE[name](edges).count() == len(samples.EDGES)
    assert ROWWISE[name](nothing).count() == 0


def test_near_duplicates_of_edges(edges):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(edges).collect()}
    assert got[8]["component_id"] == got[9]["component_id"] == 8 and got[8]["kept"] and not got[9]["kept"]
    assert all(got[i]["kept"] and got[i]["n_shingles"] == 0 for i in (1, 2, 3)) and got[None]["kept"]


def test_repeated_rows_repeat_each_other(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(500))
    df = spark.createDataFrame([(1, text), (1, text), (2, "other")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup.remove_repeats(df).collect()) == [(1, 500), (1, 500), (2, 0)]


def test_languages_of_edges(edges):
    got = {r["doc_id"]: r for r in lang_id.identify(edges, lang_id.train(edges)).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 11, 12)) and got[4]["lang_pred"] == "en" == got[10]["lang_pred"]


def test_contaminated_edges(spark, edges, nothing):
    items = spark.createDataFrame([(1, "Same text here, twice over and again.", "k"), (2, None, "k"), (3, "", None), (3, "word word word word word word word word word", "k"), (None, "x", "k")], BENCH)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(edges, items).collect()}
    assert got == {(8, 1), (9, 1), (6, 3)}
    assert decontaminate.contaminated(nothing, items).count() == 0


def test_pipeline_stages_on_edges(spark, edges, nothing, tmp_path):
    spark.createDataFrame([(1, "Same text here, twice over and again.", "k")], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (edges, nothing):
        docs = start.select("doc_id", "text", "lang", "source", "n_chars")
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            if k < 4:
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs.write.parquet(path := f"{tmp_path}/{start.count()}-{name}")
            docs = spark.read.parquet(path)
        assert docs.count() == (0 if start is nothing else docs.select("doc_id").count())
    got = {r["doc_id"] for r in docs.collect()} if start is edges else None
    assert got is None or not {1, 2, 3, 8, 9} & got


def test_run_writes_all_stages(spark, tmp_path):
    docs = spark.createDataFrame(samples.rows(samples.corpus()), samples.SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, dict(samples.corpus())[3])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 3 not in got and 0 < len(got) < 40 and all(r["n_tokens"] >= 0 for r in got.values())


def _thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_built_to_hash_alike_stay_apart(spark):
    """Modulo a power of two, a polynomial gives such a word and its complement one hash."""
    word = _thue_morse(2048)
    other = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, word), (2, other)], "doc_id long, text string")
    assert {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()} == {1: (1, True), 2: (2, True)}
    # alike at both ends, so that only the middle tells their contexts apart
    df = spark.createDataFrame([(1, "x" * 200 + word + "y" * 200), (2, "x" * 200 + other + "y" * 200)], "doc_id long, text string")
    want = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(df, length=1500).collect()}
    assert want == {1: 0, 2: 0}


def test_rows_without_id_and_rows_of_one_id(spark):
    many = [(None, f"text number {i} has its own words {i * 7}") for i in range(3000)]
    texts = [*many, (None, "the one long text that two rows have in common, word for word, over and over " * 8), (5, "the one long text that two rows have in common, word for word, over and over " * 8), (6, "quite another text of more than five words"), (6, "and a second one under the same id, also of some words")]
    df = spark.createDataFrame([*texts, (7, "and a second one under the same id, also of some words")], "doc_id long, text string")
    cut = suffix_dedup.remove_repeats(df).collect()
    assert len(cut) == len(texts) + 1 and sum(r["n_removed"] > 0 for r in cut) == 2
    near = near_dedup.near_duplicates(df).collect()
    assert len(near) == len(cut) and {r["component_id"] for r in near if r["doc_id"] in (6, 7)} == {6}
    assert all(r["kept"] for r in near if r["doc_id"] is None)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    monkeypatch.setattr(suffix_dedup.B, "SLICE_BYTES", 500)
    part = "".join(chr(97 + i * i * 7 % 23) for i in range(900))
    fill = lambda k: "".join(chr(65 + (i * i + k * i * 3) % 26) + str(i + k) for i in range(700))
    df = spark.createDataFrame([(k, fill(k) + part + fill(k + 50)) for k in (1, 2)], "doc_id long, text string")
    spans = suffix_dedup.repeated_spans(df).collect()
    assert len(spans) == 2 and all(sum(b - a for a, b in suffix_dedup._merged([s.asDict() for s in r["spans"]])) >= 900 for r in spans)
