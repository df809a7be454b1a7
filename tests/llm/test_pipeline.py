from collections import Counter

import pytest

import corpus_pipeline
from lattica.llm import queries
from tests.llm.helpers import words
from tests.llm.test_toxicity import corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    toxic, labels = corpus()
    passage = "\n".join(" ".join(words(15, 7000 + k, 10**6)) for k in range(5))
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in toxic]
    same = " ".join(words(300, 4242))
    rows += [(5000 + k, same, "en", "src0", len(same)) for k in range(20)]
    rows += [(6000 + k, " ".join(words(90, 600 + k)) + "\n" + passage, "en", "src1", 1) for k in range(12)]
    rows += [(7000, None, None, None, None), (7001, "", "en", "src2", 0), (None, "without an id", "en", "src2", 13), (10, rows[10][1], "en", "src1", len(rows[10][1]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("doc_id", "1 as quality", "toxic").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        out.write.mode("overwrite").parquet(f"{folder}/out-{name}")
        docs = spark.read.parquet(f"{folder}/out-{name}")
        seen[name] = docs.collect()
    toxic, labels = corpus()
    ids = {n: [r["doc_id"] for r in rows] for n, rows in seen.items()}
    bad = {k for k, y in labels if y}
    assert len(bad - set(ids["toxicity"])) > 0.9 * len(bad) and len(set(ids["toxicity"]) - bad) > 0.95 * (len(toxic) - len(bad))
    lines = {r["doc_id"]: r["text"] for r in seen["line_dedup"]}
    assert all("\n" not in lines[6000 + k] for k in range(1, 12)) and lines[6000].count("\n") == 5
    assert not set(range(5001, 5020)) & set(ids["line_dedup"]) and 5000 in ids["line_dedup"]
    assert max(Counter(ids["near_dedup"]).values()) == 1 and {7000, 7001} & set(ids["near_dedup"]) == {7000}
    assert max(Counter(ids["mixing"]).values()) <= 3
    pieces = Counter(r["doc_id"] for r in seen["packing"] if r["piece"] == 0)
    assert pieces == Counter(ids["mixing"])


def test_run_equals_the_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


COLUMNS = {
    "op1_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op2_simhash": ["doc_id", "fingerprint", "component_id"],
    "op3_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op4_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op5_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op6_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op7_embeddings": ["vec_id", "n_links", "component_id", "kept"],
    "op8_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op9_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op10_line_dedup": ["doc_id", "text"],
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_every_query_runs_over_its_whole_table(spark, data, name):
    out = queries.QUERIES[name](spark, data)
    assert out.columns[: len(COLUMNS[name])] == COLUMNS[name]
    table = {"op4_url_filter": "pages", "op7_embeddings": "embeddings"}.get(name, "documents")
    rows = spark.read.parquet(f"{data}/{table}.parquet").count()
    assert out.count() == rows if name != "op1_packing" else out.where("piece = 0").count() == rows


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.collect() == [], name
        docs = docs if name == "packing" else out


def test_stages_on_a_very_long_text(spark, folder):
    """Half a million words in one row beside short ones: each stage reads it whole."""
    long = "\n".join(" ".join(words(50, 80_000 + k, 10**6)) for k in range(10_000))
    rows = [(1, long, "en", "a", len(long)), (2, "short " * 30, "en", "b", 180), (3, long + "\nand an end of its own", "en", "a", len(long)), (4, " ".join(words(60, 5)), "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        kept[name] = [r.asDict() for r in out.select(*[c for c in out.columns if c != "text"]).collect()]
        if name == "line_dedup":
            assert {r["doc_id"]: r["text"] for r in out.where("doc_id <> 1").collect()}[3] == "and an end of its own"
    assert {r["doc_id"] for r in kept["toxicity"]} == {1, 2, 3, 4}
    assert sorted(r["doc_id"] for r in kept["near_dedup"]) == [1, 2, 4]  # 1 and 3 differ in their end alone
    pieces = [r for r in kept["packing"] if r["doc_id"] == 1]
    assert len(pieces) > 200 and sum(r["length"] for r in pieces) == max(r["start"] + r["length"] for r in pieces)
