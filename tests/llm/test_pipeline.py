"""The pipeline's stages on the smallest tables: columns, counts and decisions."""

import pytest

import corpus_pipeline
from nearfield.llm import common, mixing, near_dedup, pieces, pii

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = common.cut(stage(spark, before, SF))
        assert after.columns[: len(columns)] == columns
        if name == "near dedup":
            assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in near_dedup.near_duplicates(before).where("kept").select("doc_id").collect()}
        elif name == "pii":
            assert after.count() == before.count() and pii.find(after).where("n_email + n_ip + n_card + n_phone > 0").isEmpty()
        elif name == "source mixing":
            want = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.mix(before).where("taken > 0").collect()}
            assert {r[0]: r[1] for r in after.groupBy("doc_id").count().collect()} == {k: n for k, n in want.items() if n}
        elif name == "pieces":
            assert after.count() == before.count() and after.where("NOT round_trip").isEmpty()
            lattice = pieces.Lattice(pieces.read_model())
            for r in after.limit(40).collect():
                want = lattice.encode(r["text"], pieces.BEST)
                assert r["ids"] == list(want[0][1]) and r["nbest_scores"] == pytest.approx([x for x, _ in want]) and len(want) == pieces.BEST
        else:
            assert 0 < after.count() < before.count()
        before = after


def test_mix_without_ids_and_with_one_id(spark):
    text = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, text(i, 5 + 40 * (i % 4)), "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    rest = [(r["given"]["text"], int(r["taken"] / r["size"] + 0.5)) for r in mixing.mix(docs, keep=True).collect()]
    got = corpus_pipeline.mix_sources(spark, docs, SF)
    assert got.columns == docs.columns and len(rest) == len(rows)
    assert {r["text"]: r["count"] for r in got.groupBy("text").count().collect()} == {t: n for t, n in rest if n}
    assert got.where("doc_id IS NULL").select("text").distinct().count() == sum(n > 0 for t, n in rest if t in {x for i, x, _ in rows if i is None}) > 10
    for source in "ab":
        words = sum(len(r[0].split()) for r in got.where(f"source = '{source}'").select("text").collect())
        target = mixing.mix(docs).where(f"source = '{source}'").first()["target"]
        assert abs(words - target) <= 125  # but for the text at the target's end
