import bisect
from collections import Counter, defaultdict
from pathlib import Path

import pytest
import sentencepiece
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyrank.llm import token_alignment
from tallyrank.llm.token_alignment import BYTE_LEVEL, PIECES, TOKENIZERS, Pair, Tokenizers, align, words_of

FOLDER = Path(TOKENIZERS)


@pytest.fixture(scope="module")
def pair():
    return Pair((FOLDER / BYTE_LEVEL).read_text(), (FOLDER / PIECES).read_bytes())


def spans(ids, texts):
    out, end = [], 0
    for i in ids:
        out.append((end, end + len(texts[i]), i))
        end += len(texts[i])
    return out


def slow(rows, pair):
    """Whole texts through both libraries, group by group and link by link."""
    found, links, counts = [], [], Counter()
    for doc_id, text in rows:
        a, b = (pair.a.encode(f" {text}", add_special_tokens=False).ids, pair.b.encode(text)) if text else ([], [])
        by_a, by_b = spans(a, pair.a_bytes), spans(b, pair.b_bytes)
        if not text or not b"".join(pair.a_bytes[i] for i in a) == f" {text}".encode() == b"".join(pair.b_bytes[i] for i in b):
            found.append((doc_id, 0, 0, 0, 0, ""))
            links.append([])
            continue
        cuts = sorted({e for _, e, _ in by_a} & {e for _, e, _ in by_b})
        groups = [defaultdict(list), defaultdict(list)]
        for side, tokens in zip(groups, (by_a, by_b)):
            for _, e, i in tokens:
                side[bisect.bisect_left(cuts, e)].append(str(i))
        met, first = [], 0
        for s, e, i in by_a:
            while by_b[first][1] <= s:
                first += 1
            for bs, _, j in by_b[first:]:
                if bs >= e:
                    break
                met.append((i, j))
        counts.update(set(met))
        links.append(met)
        found.append((doc_id, len(a), len(b), len(cuts), len(met), ";".join(f"{','.join(groups[0][n])}|{','.join(groups[1][n])}" for n in range(len(cuts)))))
    top = Counter()
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    return Counter((*f[:5], sum(counts[x] == top[x[0]] for x in m), sum(counts[x] for x in m), f[5]) for f, m in zip(found, links, strict=True))


def got(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in df.collect())


ROWS = [
    (1, "The quick brown fox jumps over the lazy dog."),
    (2, "The quick brown fox jumps over the lazy dog."),
    (3, "  leading, double  and trailing   "),
    (4, "lines\nand\n\n  indented \n x\r\n\ttabs \t end\n"),
    (5, None),
    (6, ""),
    (7, " "),
    (8, "a mark ▁ in the text"),
    (9, "<|endoftext|> and <s> </s> <unk> <0x41> are plain"),
    (10, "naïve café – Übergröße 漢字かな交じり文 🎉🎉 é​  x"),
    (11, "x" * 3000 + " " + "ha" * 2000 + " =" + "=" * 999),
    (None, "a row without an id"),
    (None, "a row without an id"),
    (1, "Another text of the same id, isn't it? They'll say it's the dog's."),
    (12, "\x00\x1f \x7f \x85   　 x ﻿ y"),
    (13, "12 345 6789 1,234.5 $%& #tag @x http://a.b/c?d=e&f=g"),
]


def test_against_whole_texts(spark, pair):
    docs = spark.createDataFrame([(*r, "z", 1, "w") for r in ROWS], "doc_id long, text string, block string, word int, pairs string")
    assert got(align(docs, Tokenizers(spark))) == slow(ROWS, pair)


def test_on_given_documents(spark, pair):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(align(docs, Tokenizers(spark))) == slow([(r.doc_id, r.text) for r in docs.collect()], pair)


def test_small_blocks_and_long_groups(spark, pair, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 100)
    monkeypatch.setattr(token_alignment, "GROUP_PAIRS", 3)
    monkeypatch.setattr(token_alignment, "RANGE", 4)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert got(align(docs, Tokenizers(spark))) == slow(ROWS, pair)


def test_empty_table(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string"), Tokenizers(spark)).count() == 0


def test_no_row_moves_within_blocks(spark, request):
    """Up to the counts of pairs, nothing is shuffled once texts lie in buckets."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # or small tables would be sent
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    docs = spark.createDataFrame([r for r in ROWS if r[1]], "doc_id long, text string")
    rows = token_alignment.encoded(docs, Tokenizers(spark))
    words = token_alignment.aligned(rows.where("word is not null"))
    held = words.join(rows.where("text is not null").selectExpr("block", "text", "first", "explode(words) w").selectExpr("block", "text", "first + w word"), ["block", "word"]).groupBy("block", "text").count()
    ends = token_alignment._ends(rows.where("word is not null"), "a").join(token_alignment._ends(rows.where("word is not null"), "b"), ["block", "word", "end"])
    for df in (words, ends, held):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and ("Join" in plan or df is words)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t a.b'  ​▁é漢\x1c\x85"), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=40))
@example("end.\n Next")
@example("a\x1c b᠎ c\u0085 d")
def test_words_hold_the_tokens_of_the_text(text):
    a, b = _libraries()
    words = words_of(text)
    assert "".join(f" {w}" for w in words) == f" {text}"
    assert sum((x.ids for x in a.encode_batch([f" {w}" for w in words], add_special_tokens=False)), []) == a.encode(f" {text}", add_special_tokens=False).ids
    if "▁" not in text:
        assert sum(b.encode(words), []) == b.encode(text)


_held = []


def _libraries():
    if not _held:
        a = Tokenizer.from_file(str(FOLDER / BYTE_LEVEL))
        a.encode_special_tokens = True
        _held.extend((a, sentencepiece.SentencePieceProcessor(model_file=str(FOLDER / PIECES))))
    return _held
