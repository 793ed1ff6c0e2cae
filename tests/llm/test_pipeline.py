"""The pipeline's stages on the smallest tables, each against what the stage before it kept."""

import zlib
from collections import Counter

import corpus_pipeline
from fixtures import documents, frame, words
from test_operators import _components

from clearsift.llm.common import durable

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = durable(stage(spark, docs, SF), "test")
        kept[name] = docs
        if name != "sharding":
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "mixing", "sharding"]
    texts = {r.doc_id: r.text for r in kept["near_copies"].collect()}
    assert len({t for t in texts.values()}) == len(texts)
    out = docs.collect()
    assert len(out) == kept["mixing"].count()
    mixed = {r.doc_id: r.text for r in kept["mixing"].collect()}
    assert all(r.text_crc32 == zlib.crc32(mixed[r.doc_id].encode()) for r in out)
    assert corpus_pipeline.run(spark, SF).count() == len(out)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns through all stages, against brute force."""
    rows = documents() + [(900, " ".join(f"long{i % 7001}" for i in range(20_000)), "en", "s1", 1, "clash", -1, 0.5, "clash"), (901, documents()[10][1] + " leak of the benchmark", None, None, None, None, None, None, None)]
    docs = frame(spark, rows)
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 1, 1), (41, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    leak = documents()[10][1]
    spark.createDataFrame([(1, leak), (2, None), (3, ""), (None, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = durable(stage(spark, docs, str(tmp_path)), "odd")
        kept[name] = out.collect()
        if name != "sharding":
            assert out.columns == docs.columns
        docs = out
    texts = lambda found: Counter((r.doc_id, r.text) for r in found)
    assert texts(kept["toxicity"]) == Counter((d, t) for d, t, *_ in rows)  # one class: nothing is toxic
    component = {d: c for d, _, c in _components(rows, 5, 80)}
    left = [r for r in rows if r[0] is None or component[r[0]] == r[0]]
    assert texts(kept["near_copies"]) == Counter((d, t) for d, t, *_ in left)
    grams = lambda t: {tuple(w[i : i + 5]) for w in [words((t or "").lower())] for i in range(len(w) - 4)}
    clean = [r for r in left if r[0] is None or 100 * len(grams(r[1]) & grams(leak)) < 80 * len(grams(leak))]
    assert texts(kept["decontamination"]) == Counter((d, t) for d, t, *_ in clean) and len(clean) < len(left)
    mixed = texts(kept["mixing"])
    assert set(mixed) <= {(d, t) for d, t, *_ in clean} and (900, rows[-2][1]) in mixed
    assert len(kept["sharding"]) == sum(mixed.values()) and {r.law for r in kept["sharding"]} == {"bytes"}


def test_stages_on_empty_tables(spark, tmp_path):
    docs = frame(spark, [])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, str(tmp_path)), "empty")
        assert docs.count() == 0
