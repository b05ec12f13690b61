"""Token planes and packing against the tokenizers library, text by text."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing, token_planes
from tidemark.llm.queries import op1_token_planes, op3_packing, vocabulary
from tidemark.llm.words import Encoder

ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n a", "a\n \nb", "x   y", "tab\t tab", "<|endoftext|> x", "a <|endoftext|> b<|endoftext|>", "x\n<|ENDOFTEXT|> y", "é" * 70 + " ́a", "I'll don't 'S",
    "ΟΔΟΣ ΣΑΣ", "a\x1c b \x1f", "　 x   ", "word " * 3000, "w" * 5000, "end \n", "᠎ ᠎",
]
SCHEMA = "doc_id long, text string, shard string, ids int, start int, cls int"


def reference(name, texts, end):
    t = Tokenizer.from_file(vocabulary(name))
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_memory_of_words_changes_nothing(name, spaced):
    rng = random.Random(4)
    texts = [x or "" for x in ODD] + ["".join(rng.choice(["a", "be", " ", " ", "\n", "\t", "é", "7", "'s", ".", " ", "\x1d"]) for _ in range(60)) for _ in range(600)]
    got = Encoder(vocabulary(name), spaced, 300).encode(pa.array(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x[:-1] for x in reference(name, texts, 0)]


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes_round_trip(planes):
    ids = np.random.default_rng(1).integers(0, 1 << 32, 1003, dtype=np.uint32).astype("<u4")
    index, payload = token_planes.pack_block_stream(ids.tobytes(), 100, planes, 1)
    assert [b["n_ids"] for b in index] == [100] * 10 + [3]
    assert np.concatenate([token_planes.read_block(payload, b, planes) for b in index]).tolist() == ids.tolist()
    assert token_planes.read_block(payload, index[7], planes).tolist() == ids[700:800].tolist()


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_documents_come_back(spark, planes):
    docs = spark.createDataFrame([(5 * i % 23, t, "s", 1, 2, 3) for i, t in enumerate(ODD)] + [(None, "nothing", "s", 1, 2, 3), (4, "tie", "s", 1, 2, 3)], SCHEMA)
    segments = token_planes.write_segments(docs, vocabulary("byte_bpe_50k.json"), 2, planes=planes, block_ids=64, segment_ids=500)
    got = token_planes.read_documents(segments).orderBy("start").collect()
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "") for r in docs.collect()))
    want = reference("byte_bpe_50k.json", [r[3] for r in rows], 2)
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == want
    assert [r["start"] for r in got] == [0, *np.cumsum([len(x) for x in want])[:-1].tolist()]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert token_planes.read_documents(token_planes.write_segments(none, vocabulary("byte_bpe_50k.json"), 2)).count() == 0
    cut = packing.pieces(none, vocabulary("word_bpe_49k.json"), 1)
    assert packing.assign(cut).count() == 0


def test_op1_whole_table(spark, sf_dir):
    got = {r["doc_id"]: r for r in op1_token_planes(spark, sf_dir).collect()}
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    start = 0
    for (i, _), ids in zip(docs, reference("byte_bpe_50k.json", [d[1] for d in docs], 2), strict=True):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def check_packed(rows, docs, want, capacity=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for (i, _), ids in zip(docs, want, strict=True):
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return padding / (padding + sum(map(len, want)))


def test_op3_whole_table(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    want = reference("word_bpe_49k.json", [d[1] for d in docs], 1)
    assert check_packed(op3_packing(spark, sf_dir).collect(), docs, want) < 0.02


def test_packing_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "s", 1, 2, 3) for i, t in enumerate(ODD)], SCHEMA)
    cut = packing.pieces(docs, vocabulary("word_bpe_49k.json"), 1)
    placed = packing.assign(cut.withColumn("ids_crc32", F.crc32("ids")))
    check_packed(placed.collect(), list(enumerate(ODD)), reference("word_bpe_49k.json", ODD, 1))
    for r in packing.sequences(placed, pad_id=9).collect():
        n = r["n_tokens"]
        assert len(r["ids"]) == 4 * (n if n & (n - 1) == 0 else 2048)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(3)
    demand = np.bincount(rng.integers(0, 64, 4000), minlength=64)
    deals = packing.plan(demand, 64)
    used, dealt = {}, np.zeros(64, np.int64)
    for c, first, n, each, sequence, _ in deals:
        assert first == dealt[c - 1]
        dealt[c - 1] += n
        for s in range(sequence, sequence + n // each):
            used[s] = used.get(s, 0) + c * each
    assert dealt.tolist() == demand.tolist() and max(used.values()) <= 64
    assert len(used) <= 1.01 * np.ceil((demand * np.arange(1, 65)).sum() / 64) + 2


def test_knapsack_by_brute_force():
    prices = np.array([0.0, 0.3, 0.0, 0.55, 0.8])
    value, pattern = packing.knapsack(prices, 7)
    best = max(0.3 * b + 0.55 * d + 0.8 * e for b in range(4) for d in range(2) for e in range(2) if 2 * b + 4 * d + 5 * e <= 7)
    assert value == pytest.approx(best) and (pattern * np.arange(1, 6)).sum() <= 7


def test_parts_are_lower_cased_together():
    from tidemark.llm import words

    class Counted(words.Encoder):
        asked = 0

        def may_hold_special(self, text):
            self.asked += 1
            return super().may_hold_special(text)

    texts = ["".join(chr(97 + (i * 7 + k) % 26) for k in range(9)) + f" {i}x{i}" for i in range(2000)]
    code = Counted(vocabulary("byte_bpe_50k.json"), True, 100_000)
    got = code.encode(pa.array([*texts, None, ""]))
    assert code.asked == 1  # before, every new part was lower-cased and searched alone, twice
    assert got == [code.whole(t) for t in texts] + [b"", b""]
    odd = ["a <|ENDOFTEXT|> b", "x<|endoftext|>y z", "<|endoftext", "|> <|"]
    assert code.encode(pa.array([*odd, *texts[:3]])) == [code.whole(t) for t in [*odd, *texts[:3]]]
