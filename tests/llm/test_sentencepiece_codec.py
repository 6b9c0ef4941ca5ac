import random
from pathlib import Path

import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tallyrank.llm import sentencepiece_codec as sc


@pytest.fixture(scope="module")
def model():
    return (Path(sc.TOKENIZERS) / sc.MODEL).read_bytes()


@pytest.fixture(scope="module")
def pieces(model):
    return sc.Pieces(model)


@pytest.fixture(scope="module")
def viterbi(model):
    """The library's own unigram search over the same pieces and scores."""
    proto = sentencepiece_model_pb2.ModelProto.FromString(model)
    proto.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


TEXTS = ["Hello world", "  two  spaces ", "tabs\tand\nlines\n\n", "naïve café 梦 ﬁ ① 🎉", " ", "a", "aaaaaaaaaaaaaaaaaaaaaaaaa", "▁marks▁ in text", "\x00\x7f", "é", "pre prefix prefixes prefixed pre", "x" * 3000, "is <s> </s> <unk> <0x41> ordinary"]


def ids_of(pieces, text):
    import numpy as np

    return np.frombuffer(pieces.encode([text])[0], "<i4").tolist()


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(pieces, text):
    assert pieces.decode(ids_of(pieces, text)) == text


def test_best_of_all_segmentations(pieces, model):
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    by_text = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
            by_text[sp.id_to_piece(i).replace(sc.MARK, " ")] = (sp.get_score(i), i)

    def best(word):
        if not word:
            return 0.0
        cuts = [by_text[word[:k]][0] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in by_text]
        return max(cuts)

    r = random.Random(1)
    for _ in range(60):
        word = " " + "".join(r.choice("aeinorst") for _ in range(r.randrange(1, 9)))
        assert sum(sp.get_score(i) for i in ids_of(pieces, word[1:])) == best(word)


def test_against_the_librarys_viterbi(pieces, viterbi):
    """Never a lower score than the library's own search, which in rare words misses the best."""
    r = random.Random(2)
    syllables = ["th", "er", "tion", "an", "queé", "schaft", "ing", "ció", "n", "ou", "xyz", "ß", "Q"]
    words = ["".join(r.choice(syllables) for _ in range(r.randrange(1, 6))) + r.choice(["", ",", "."]) for _ in range(4000)] + ["Hello", "naïve", "café", "梦", "ﬁ", "①", "rewhed;"]
    differ = 0
    for word in words:
        ours, theirs = ids_of(pieces, word), viterbi.encode(word)
        differ += ours != theirs
        assert ours == theirs or sum(map(viterbi.get_score, ours)) > sum(map(viterbi.get_score, theirs))
    assert differ < 0.01 * len(words)


def test_sharing_changes_nothing(pieces):
    words = [" prefix", " prefixes", " prefixed", " pre", " preface", " x", " prefixes."]
    together = pieces.search(words)
    assert all(pieces.search([w])[w] == together[w] for w in words)


def test_documents(spark):
    rows = list(enumerate([*TEXTS, None, ""])) + [(None, "no id"), (3, TEXTS[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    codec = sc.Codec(spark)
    out = sc.encode_documents(docs, codec).cache()
    assert out.count() == len(rows) and out.where("round_trip").count() == len(rows) and out.where("n_ids = 0").count() == 2
    back = sorted(((r.doc_id, r.text) for r in sc.decode_documents(out, codec).collect()), key=str)
    assert back == sorted(((d, t or "") for d, t in rows), key=str)
    assert sc.encode_documents(docs.limit(0), codec).count() == 0
