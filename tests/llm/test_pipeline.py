import importlib.util
from pathlib import Path

import numpy as np

import corpus_pipeline
from tallyrank.llm import sentencepiece_codec, toxicity

from .test_decontaminate import slow as slow_contamination
from .test_line_dedup import BLANKS, low
from .test_simhash import slow_groups


def plain_lines(rows):
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(low(line.strip(BLANKS)), set()).add(d)
    out = []
    for d, t in rows:
        lines = [x for x in (t or "").split("\n") if not (len(k := low(x.strip(BLANKS))) >= 20 and len(held[k]) >= 3 and d < max(held[k]))]
        out.append((d, "\n".join(lines)))
    return out


def test_against_plain_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = toxicity.trained(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows = [r for r, s in zip(rows, net.scores([t.encode() for _, t in rows])) if s < 0.7]
    rows = plain_lines(rows)
    keep = {d for d, _, least in slow_groups(rows) if d == least}
    rows = [r for r in rows if r[0] in keep]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [r for r in rows if not slow_contamination(r[1], items)[-1]]
    pieces = sentencepiece_codec.Pieces((Path(sentencepiece_codec.TOKENIZERS) / sentencepiece_codec.MODEL).read_bytes())
    want = {d: np.frombuffer(x, "<i4").tolist() for (d, _), x in zip(rows, pieces.encode([t for _, t in rows]))}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_take_clashing_columns_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, component_id string, __x string, score int, dropped int"
    for docs in (spark.createDataFrame([], schema), spark.createDataFrame([(None, None, None, None, None, "a", "b", "c", 1, 1), (1, "t", "en", "s", 1, "a", "b", "c", 1, 1)], schema)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.columns == docs.columns and out.count() == n, name


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0])) and len([n for n in names if n.startswith("op")]) == 13
    assert "pipeline" in names and importlib.util.find_spec("corpus_pipeline")
