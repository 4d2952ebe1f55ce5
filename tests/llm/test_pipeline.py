import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
import pytest  # noqa: E402
from helpers import docs  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from qualweave.llm import exact_dedup, mixing, near_dedup, sentencepiece_lattice, toxicity  # noqa: E402
from qualweave.session import table  # noqa: E402


def test_stages_one_by_one(spark, small, tmp_path):
    docs = source = table(spark, small, "documents")
    inputs = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == source.columns, name
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    scored = toxicity.toxicity(inputs[0], table(spark, small, "labels"))
    assert ids(inputs[1]) == ids(scored.where("score < 0.5"))
    assert ids(inputs[2]) == ids(exact_dedup.exact_classes(inputs[1]).where("kept"))
    assert ids(inputs[3]) == ids(near_dedup.near_classes(inputs[2]).where("kept"))
    taken = {r.doc_id: r for r in mixing.mix(inputs[3]).collect()}
    assert all(r.size for r in taken.values())
    assert ids(inputs[4]) == sorted(i for i, r in taken.items() for _ in range(r.taken // r.size))
    assert len(set(ids(inputs[4]))) > 100 and sum(r.taken for r in taken.values()) > 1.4 * sum(r.size for r in taken.values())
    text = {r.doc_id: r.text for r in inputs[4].collect()}
    back = sentencepiece_lattice.decode(docs).select("doc_id", "text").collect()
    assert len(back) > 2 * len(ids(inputs[4])) and all(r.text == text[r.doc_id] for r in back)
    assert set(ids(docs)) == set(ids(inputs[4]))
    whole = corpus_pipeline.run(spark, small)
    key = lambda df: sorted((r.doc_id, r["sample"], tuple(r.pieces)) for r in df.collect())
    assert key(whole) == key(docs)


def test_entry_lists_the_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))
    assert set(entry.oracle_sql()) <= names


ODD = [(1, None, "a"), (2, "", "a"), (2, "", "a"), (3, "a clean line about rivers and hills", None), (4, "a clean line about rivers and hills", "b"), (4, "a clean line about rivers and hills", "b"), (None, "no id here", "b"), (5, "word " * 30_000, "b"), (6, "one", "c")]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_and_empty_tables(spark, small, rows):
    """Nulls, empty, repeated and very long texts, null ids, and columns whose names operators use themselves."""
    given = docs(spark, rows).withColumns({"score": F.lit(1.0), "Bucket": F.lit("x"), "h": F.lit(2), "taken": F.lit(3), "target": F.lit(4)})
    texts = {(i, t) for i, t, _ in rows}
    out = {name: stage(spark, given, small) for name, stage in corpus_pipeline.STAGES}
    for name, df in out.items():
        if name != "sentencepiece":
            assert df.columns == given.columns, name
    got = {name: df.collect() for name, df in out.items()}
    key = lambda name: sorted(((r["doc_id"], r["text"]) for r in got[name]), key=repr)
    assert key("toxicity") == sorted(((i, t) for i, t, _ in rows), key=repr)
    if not rows:
        assert all(not r for r in got.values())
        return
    assert [(i, (t or "")[:5]) for i, t in key("exact_dedup")] == [(2, ""), (4, "a cle"), (5, "word "), (6, "one"), (None, "no id")]
    assert {(3, "a clean line about rivers and hills"), (5, "word " * 30_000)} <= set(key("near_dedup")) <= texts and 4 not in {i for i, _ in key("near_dedup")}
    assert set(key("mix_sources")) <= texts
    samples = {(r["doc_id"], r["sample"]): r for r in got["sentencepiece"]}
    assert {i for i, _ in samples} == {i for i, _ in texts} and samples[1, 1]["n_pieces"] == samples[2, 1]["n_pieces"] == 0 and samples[5, 3]["n_pieces"] > 20_000
