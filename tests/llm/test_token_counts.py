import pytest

from tallyrank.llm.bpe import Encoder
from tallyrank.llm.common import scratch
from tallyrank.llm.token_counts import TokenRollup, count_changes

SCHEMA = "doc_key string, tokenizer string, op string, source string, lang string, n_tokens long, n_chars long, seq int"


def cells(df):
    return sorted(((r.source, r.lang, r.tokenizer, r.n_docs, r.n_tokens, r.n_chars) for r in df.collect()), key=str)


def test_signed_batches(spark):
    roll = TokenRollup(spark, scratch(spark, "rollup"))
    batch = lambda *rows: spark.createDataFrame([(*r, *[0] * (8 - len(r))) for r in rows], SCHEMA)
    assert cells(roll.totals()) == []
    first = batch(("a", "t1", "insert", "s", "en", 5, 50), ("b", "t1", "insert", "s", "en", 7, 70), ("c", "t1", "insert", None, None, 1, 10), ("b", "t1", "insert", "s", "en", 7, 70))
    assert roll.apply("one", first) and not roll.apply("one", first)
    assert cells(roll.totals()) == [("s", "en", "t1", 2, 12, 120), (None, None, "t1", 1, 1, 10)]
    second = batch(("a", "t1", "revise", "s", "de", 9, 90), ("b", "t1", "delete", None, None, None, None), ("zz", "t1", "delete", None, None, None, None), ("a", "t2", "insert", "s", "de", 4, 90), ("n", "t1", "revise", "s", "en", 3, 30))
    assert roll.apply("two", second)
    assert cells(roll.totals()) == [("s", "de", "t1", 1, 9, 90), ("s", "de", "t2", 1, 4, 90), ("s", "en", "t1", 1, 3, 30), (None, None, "t1", 1, 1, 10)]
    third = batch(("b", "t1", "insert", "s", "en", 2, 20, 1), ("b", "t1", "insert", "s", "en", 8, 80, 2), ("n", "t1", "revise", "s", "en", 1, 1, 1), ("n", "t1", "delete", "s", "en", 1, 1, 2))
    assert roll.apply("three", third) and not roll.apply("two", second)
    assert cells(roll.totals()) == cells(roll.recount()) == [("s", "de", "t1", 1, 9, 90), ("s", "de", "t2", 1, 4, 90), ("s", "en", "t1", 1, 8, 80), (None, None, "t1", 1, 1, 10)]
    assert roll.apply("empty", batch().limit(0)) and len(cells(roll.totals())) == 4


def test_refused(spark):
    roll = TokenRollup(spark, scratch(spark, "rollup"))
    with pytest.raises(ValueError):
        roll.apply("../x", spark.createDataFrame([], SCHEMA))
    for key, op in ((None, "insert"), ("a", "other"), ("a", None)):
        with pytest.raises(Exception, match="doc_key and an op"):
            roll.apply("bad", spark.createDataFrame([(key, "t", op, "s", "en", 1, 1, 0)], SCHEMA))
    assert cells(roll.totals()) == []


def test_counts_of_documents(spark):
    enc = Encoder(spark)
    texts = ["Hello wörld  <|endoftext|>", "", None, "x" * 5000, "again", "again"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 99) for i, t in enumerate(texts)] + [(None, "no id", None, None, 1, 99), (5, "again", "en", "s", 1, 99)], "doc_id long, text string, lang string, source string, n_docs int, n_tokens int")
    roll = TokenRollup(spark, scratch(spark, "rollup"))
    roll.apply("b", count_changes(docs, enc))
    n = lambda t: len(enc.get().encode_ordinary(t or ""))
    assert cells(roll.totals()) == [("s", "en", enc.name, 6, sum(map(n, texts)), sum(len(t or "") for t in texts)), (None, None, enc.name, 1, n("no id"), 5)]


def test_rows_without_id_are_all_counted(spark):
    enc = Encoder(spark)
    rows = [(None, "same", "en", "a"), (None, "same", "en", "b"), (None, "same", "de", "a"), (None, "same", None, "a"), (None, "same", "en", "a"), (None, "other", "en", "a"), (None, None, "en", "a"), (None, "", "en", "a"), (7, "same", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    roll = TokenRollup(spark, scratch(spark, "rollup"))
    n = {t: len(enc.get().encode_ordinary(t)) for t in ("same", "other")}
    want = [("a", "de", enc.name, 1, n["same"], 4), ("a", "en", enc.name, 6, 3 * n["same"] + n["other"], 17), ("a", None, enc.name, 1, n["same"], 4), ("b", "en", enc.name, 1, n["same"], 4)]
    # The same rows again as another batch are the same documents; deleted, none is left.
    for batch, op, left in (("x", "insert", want), ("y", "insert", want), ("z", "delete", [])):
        roll.apply(batch, count_changes(docs, enc, op))
        assert sorted(cells(roll.totals()), key=str) == sorted(cells(roll.recount()), key=str) == sorted(left, key=str)


def test_compaction_changes_nothing(spark):
    roll = TokenRollup(spark, scratch(spark, "rollup"))
    batch = lambda *rows: spark.createDataFrame([(*r, *[0] * (8 - len(r))) for r in rows], SCHEMA)
    roll.compact()
    roll.apply("one", batch(("a", "t", "insert", "s", "en", 5, 50), ("b", "t", "insert", "s", "en", 7, 70)))
    roll.apply("two", batch(("a", "t", "revise", "s", "de", 6, 60), ("b", "t", "delete", "s", "en", 0, 0)))
    before = cells(roll.totals())
    roll.compact()
    assert before == cells(roll.totals()) == cells(roll.recount()) == [("s", "de", "t", 1, 6, 60)]
    assert not roll.apply("one", batch(("zz", "t", "insert", "s", "en", 1, 1))) and roll.apply("three", batch(("a", "t", "delete", "s", "de", 0, 0), ("b", "t", "insert", "s", "en", 2, 2)))
    roll.compact()
    assert cells(roll.totals()) == cells(roll.recount()) == [("s", "en", "t", 1, 2, 2)]
    assert len(roll._read("ledger").inputFiles()) <= 4


def test_a_batch_reads_its_buckets_and_vacuum_keeps_what_counts(spark, tmp_path):
    roll = TokenRollup(spark, f"file://{tmp_path}/rollup")
    batch = lambda *rows: spark.createDataFrame([(*r, *[0] * (8 - len(r))) for r in rows], SCHEMA)
    roll.apply("one", batch(*((f"k{i}", "t", "insert", "s", "en", i, i) for i in range(300))))
    ledger = next((tmp_path / "rollup" / "batches").glob("one.*")) / "ledger"
    folders = sorted(ledger.glob("bucket=*"))
    assert len(folders) > 30 and all(len(list(f.glob("*.parquet"))) == 1 for f in folders)
    # All buckets but that of k7 gone: a batch for k7 doesn't miss them.
    own = {r.bucket for r in spark.read.parquet(str(ledger)).where("doc_key = 'k7'").collect()}
    for f in folders:
        if f.name not in {f"bucket={b}" for b in own}:
            f.rename(tmp_path / f.name)
    roll.apply("two", batch(("k7", "t", "delete", "s", "en", 0, 0)))
    for f in folders:
        if not f.exists():
            (tmp_path / f.name).rename(f)
    want = [("s", "en", "t", 299, sum(range(300)) - 7, sum(range(300)) - 7)]
    assert cells(roll.totals()) == cells(roll.recount()) == want
    roll.compact()
    roll.apply("three", batch(("k8", "t", "delete", "s", "en", 0, 0)))
    (tmp_path / "rollup" / "batches" / "broken.1").mkdir()
    roll.vacuum()
    assert sorted(p.name.split(".")[0] for p in (tmp_path / "rollup" / "batches").iterdir()) == ["base-000000001", "three"]
    assert cells(TokenRollup(spark, f"file://{tmp_path}/rollup").totals()) == cells(roll.recount()) == [("s", "en", "t", 298, want[0][4] - 8, want[0][5] - 8)]
    assert not roll.apply("one", batch(("zz", "t", "insert", "s", "en", 1, 1)))
