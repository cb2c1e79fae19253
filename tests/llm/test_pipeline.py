import brute
import corpus_pipeline as cp
import public_tokenizers as P
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_near_copies import groups
from test_substrings import first_kept


@pytest.fixture(scope="module")
def sf_dir(spark, frame, texts, tmp_path_factory):
    """A small data folder with the odd rows, a planted passage in many documents and a benchmark leak."""
    folder = tmp_path_factory.mktemp("sf")
    source = spark.read.parquet(f"{SF}/documents.parquet")
    source.write.parquet(str(folder / "documents.parquet"))
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    passage = " ".join(texts[8][1].split()[:70])
    own = [" ".join(texts[k][1].split()[:60]) for k in range(20, 26)]
    rows = [(k, t) for k, t in texts if k is None or k >= 900]
    rows += [(3000 + k, f"{o[:150]} {passage} {o[150:]}") for k, o in enumerate(own)] + [(3100, f"{own[0][::-1]} {leak}")]
    extra = frame([(k, t, "en", "src0", len(t or "")) for k, t in rows], source.schema)
    extra.write.mode("append").parquet(str(folder / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


key = lambda x: sorted(x, key=str)


def test_each_stage_does_its_work_on_what_came_before(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, inputs, outputs = docs.columns, {}, {}
    for name, stage in cp.STAGES:
        inputs[name] = rows(docs) if "text" in docs.columns else None
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
            outputs[name] = rows(docs)
    language, simhash, suffix, decontaminate, packing = (name for name, _ in cp.STAGES)

    gone = key(set(inputs[language]) - set(outputs[language]))
    assert {k for k, _ in gone} >= {900, 901, 902} and len(gone) <= 6

    members = {}
    for (doc_id, _), root in zip(inputs[simhash], groups(inputs[simhash]), strict=True):
        members.setdefault(root, set()).add(doc_id)
    assert len(outputs[simhash]) == len(members) and set(outputs[simhash]) <= set(inputs[simhash])
    assert {k for k, _ in outputs[simhash]} == {min((k for k in ids if k is not None), default=None) for ids in members.values()}

    want = {k: v.decode("utf-8", "ignore") for (k, _), v in first_kept(inputs[suffix]).items() if v}
    got = dict(outputs[suffix])
    assert got.keys() == want.keys()
    assert all(got[k] == want[k] or abs(len(got[k]) - len(want[k])) < 4 for k in want)  # no half characters
    passage = inputs[suffix][0][1]
    assert sum(want[k] != t for k, t in inputs[suffix] if k in want) >= 5 and passage

    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = [d for d, r in zip(inputs[decontaminate], brute.contamination(inputs[decontaminate], benchmark), strict=True) if not r[5]]
    assert key(outputs[decontaminate]) == key(clean) and 3100 not in dict(clean)

    packed = docs.collect()
    pieces = brute.pieces(inputs[packing], P.path("word_bpe_49k.json"))
    assert key((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == key(pieces)


def test_lengths_follow_the_cut_text(spark, sf_dir):
    out = cp.repeated_passages(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert out.filter(F.col("n_chars") != F.length("text")).count() == 0


def test_run_returns_the_last_stage(spark, sf_dir):
    out = cp.run(spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0


def test_empty_documents(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
