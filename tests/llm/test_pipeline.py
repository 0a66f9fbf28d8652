import pytest

import corpus_pipeline
from freshet.llm import quality
from freshet.llm.common import settled
from freshet.llm.packing import token_pieces
from freshet.llm.queries import tokenizer_file

from . import brute


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = brute.corpus(11, 90)
    rows += [(900 + i, f"junk{i}### x%%% y$$$ " * 40 + str(i), "en", "s", 0) for i in range(3)] + [(950, rows[0][1], None, None, None), (951, "short", "en", "s", None)]
    long = [r for r in rows if r[1] and len(brute.words(r[1])) > 40]
    items = [(1, " ".join(brute.words(long[3][1])[10:30])), (2, None), (3, "nothing like this anywhere in these documents at all")]
    folder = tmp_path_factory.mktemp("tables")
    brute.frame(spark, rows).repartition(3).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return rows, items, str(folder)


def test_stages_keep_columns_and_what_brute_force_keeps(spark, tables):
    rows, items, folder = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = settled(stage(spark, docs, folder))
        assert docs.columns == columns
    expected = brute.pipeline(rows, items, quality.Rules(), quality.vocabulary(), quality.COMMON_WORDS, quality.CLASSES)
    assert {r.doc_id: r.text for r in docs.collect()} == expected and 5 < len(expected) < len(rows) - 10
    assert all(r.n_chars == len(r.text) for r in docs.collect())


def test_run(spark, tables):
    rows, items, folder = tables
    expected = brute.pipeline(rows, items, quality.Rules(), quality.vocabulary(), quality.COMMON_WORDS, quality.CLASSES)
    kept = brute.frame(spark, [(d, t, None, None, None) for d, t in expected.items()])
    pieces = {tuple(r) for r in token_pieces(kept, tokenizer_file("word_bpe_49k.json")).collect()}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == pieces and len(got) == len(pieces)


def test_empty_tables(spark, tmp_path):
    brute.frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
