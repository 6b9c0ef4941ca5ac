import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tallyrank.llm import line_dedup

BLANKS = " \t\n\v\f\r"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def slow(rows, min_chars=20, min_docs=3):
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(low(line.strip(BLANKS))) >= min_chars:
                held[low(line.strip(BLANKS))].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or len(held.get(low(x.strip(BLANKS)), ())) < min_docs or d >= max(held[low(x.strip(BLANKS))])]
        kept = [i for i, x in enumerate(lines) if d is None or len(held.get(low(x.strip(BLANKS)), ())) < min_docs or d >= max(held[low(x.strip(BLANKS))])]
        runs = []
        for i in kept:
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest(), ",".join(f"{a}-{b}" for a, b in runs)))
    return sorted(out, key=str)


LONG = "A line that Many Documents share, É"
ROWS = [
    (1, f"{LONG}\nown line of the first document\n  {LONG.replace('M', 'm')}\t"), (2, f"x\n{LONG}\n"), (3, LONG), (4, f"{LONG}\n{LONG}"), (5, None), (6, ""),
    (7, "twice only, in two documents"), (8, "twice only, in two documents"), (9, "short\nshort"), (10, "short"), (11, "short"), (None, LONG), (12, "\n" * 200 + "unique and long enough line"),
    (13, "\n".join(["pad"] * 130 + ["far down a long document"])), (14, "far down a long document"), (15, "far down a long document\r"), (15, "far down a long document\r"), (3, LONG), (2, "same id, another text\n" + LONG),
    (16, LONG.replace("É", "é")), (17, "é" * 19), (18, "é" * 19), (19, "é" * 19),
]


def test_against_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("mark", F.lit("clash")).withColumn("dropped", F.lit(1)).withColumn("__id", F.lit(1))
    got = [tuple(r) for r in line_dedup.keep_summary(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256", "keep_runs").collect()]
    assert sorted(got, key=str) == slow(ROWS)


def test_stage_keeps_columns(spark):
    docs = spark.createDataFrame([(*r, "s", 0) for r in ROWS], "doc_id long, text string, source string, n_chars long")
    out = line_dedup.drop_lines(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    by = {r.doc_id: r for r in out.collect()}
    assert by[1].text == "own line of the first document" and by[1].n_chars == 30 and by[5].text is None
    assert by[13].text == "\n".join(["pad"] * 130)


def test_bitmap_words_are_sparse(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    maps = {r.doc_id: r.dropped for r in line_dedup.drop_bitmaps(docs).collect()}
    assert maps[13] == {2: 1 << 2} and 5 not in maps


def test_empty_table(spark):
    assert line_dedup.keep_summary(spark.createDataFrame([], "doc_id long, text string")).count() == 0
