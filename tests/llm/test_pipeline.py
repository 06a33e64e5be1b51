"""The pipeline and its stages against brute force; odd and empty documents."""

import corpus_pipeline
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_corpus_operators import HELPERS, every_name, hits
from test_corpus_queries import fingerprint, linked

from tracelet.llm import decontaminate, language, pieces


def test_run(spark, sf):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = {i: r for i, r in docs.items() if r["text"] and language.has_letter(r["text"].encode())}
    best = {}
    for i, r in kept.items():
        t = r["text"].encode().lower()
        best[t] = max(best.get(t, i), i)
    kept = {i: kept[i] for i in best.values()}
    roots = linked({i: fingerprint(r["text"]) for i, r in kept.items()})
    kept = {i: r for i, r in kept.items() if roots[i] == i}
    items = [(r["item_id"], r["text"].encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {}
    for i, r in kept.items():
        n = len(decontaminate.words(r["text"].encode()))
        hit, _ = hits(r["text"].encode(), items, 13)
        if not (hit and 20 * len(hit) >= n):
            clean[i] = r
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(clean) and len(got) < len(docs)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    for i, r in got.items():
        assert r["piece_ids"] == library.encode(docs[i]["text"], add_bos=True, add_eos=True)
        assert r["decoded"] == library.decode(r["piece_ids"])
        assert all(r[c] == docs[i][c] for c in docs[i].asDict())


def test_nothing_lettered_goes_without_labelled_rows(spark, odd):
    """No label at all, or only on rows that are held out or on texts too long to learn from."""
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    for docs in (odd.withColumn("lang", F.lit(None).cast("string")), odd.withColumn("lang", F.when(held, F.col("lang"))), odd.withColumn("lang", F.when(F.length("text") > language.MAX_CHARS, F.col("lang")))):
        got = corpus_pipeline.language_stage(spark, docs, "")
        assert got.columns == odd.columns
        want = [r for r in docs.collect() if r["text"] and language.has_letter(r["text"].encode())]
        assert want
        assert sorted(map(str, got.collect())) == sorted(map(str, want))


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, odd, crowded, none, odd_dir, name, stage):
    made = stage(spark, odd, odd_dir)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert made.columns == odd.columns
    n = made.count()
    assert 0 < n <= 14
    for wide in (crowded, every_name(odd, HELPERS)):
        kept = stage(spark, wide, odd_dir)
        assert set(kept.columns) == set(wide.columns) | set(made.columns) and kept.count() == n
        same = [c for c in made.columns if c in odd.columns or c not in wide.columns]
        assert sorted(map(str, kept.select(same).collect())) == sorted(map(str, made.select(same).collect()))
    assert stage(spark, none, odd_dir).count() == 0
    if name == "exact_dedup":
        assert n == 9 and made.select(F.lower("text")).distinct().count() <= 9
