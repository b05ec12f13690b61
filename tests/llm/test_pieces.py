"""The lattice against the sentencepiece library, for the model as it is and as a unigram model."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import sentencepiece

from tidemark.llm import piece_lattice as P
from tidemark.llm.queries import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, word string, row int, ids int, pos int"


def texts():
    rng = random.Random(1)
    syllables = ["the", "er", "ing", "é", "ção", "ß", "12", "!!", "日", "👍", "%%%", "a", "o", "st", "\n", "\t", "~", "<s>", "▁"]
    out = [None, "", " ", "   ", "a", " a  b ", "Hello world", "HELLO!! WORLD!!", "naïve café", "\n\n x", "x" * 300, "日本語 text", "​", "▁▁ a"]
    return out + ["".join(rng.choice(syllables) + " " * rng.choice([0, 0, 0, 1, 1, 2]) for _ in range(40)) for _ in range(30)]


def unigram(tmp_path):
    """The same pieces as a unigram model: only the model type in the trainer's part differs."""
    data, out = open(MODEL, "rb").read(), b""
    at = 0
    while at < len(data):
        start, key = at, data[at]
        at += 1
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        body = data[at : at + n]
        at += n
        if key == 0x12:
            assert body.count(b"\x18\x02") >= 1
            k = body.index(b"\x18\x02")
            body = body[:k] + b"\x18\x01" + body[k + 2 :]
            out += data[start : at - n] + body
        else:
            out += data[start:at]
    path = tmp_path / "unigram.model"
    path.write_bytes(out)
    return str(path)


def ids_of(spark, v, rows):
    docs = spark.createDataFrame([(i, t, "w", 1, 2, 3) for i, t in enumerate(rows)], SCHEMA)
    encoded = P.encode(docs, v)
    return {r["doc_id"]: r["ids"] for r in encoded.collect()}, encoded


def test_bpe_and_decoding(spark):
    rows, lib = texts(), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    v = P.read_model(MODEL)
    assert (v.kind, v.byte_fallback, len(v.pieces)) == (P.BPE, True, 32000)
    got, encoded = ids_of(spark, v, rows)
    assert [got[i] for i in range(len(rows))] == [lib.encode(t or "") for t in rows]
    back = {r["doc_id"]: r["text"] for r in P.decode(encoded, v).collect()}
    assert [back[i] for i in range(len(rows))] == [lib.decode(got[i]) for i in range(len(rows))]
    digest = {r["doc_id"]: r["ids_crc32"] for r in P.digests(encoded).collect()}
    assert all(digest[i] == zlib.crc32(np.array(got[i], "<u4").tobytes()) for i in got)


def test_rare_words_meet_their_texts_in_a_join(spark):
    rows, lib, v = texts(), sentencepiece.SentencePieceProcessor(model_file=MODEL), P.read_model(MODEL)
    docs = spark.createDataFrame([(i, t, "w", 1, 2, 3) for i, t in enumerate(rows)], SCHEMA)
    for frequent in (0, 40):
        got = {r["doc_id"]: r["ids"] for r in P.encode(docs, v, frequent=frequent).collect()}
        assert [got[i] for i in range(len(rows))] == [lib.encode(t or "") for t in rows]


def test_query_against_the_library(spark, sf_dir):
    from tidemark.llm.queries import op2_piece_lattice

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: lib.encode(r["text"] or "") for r in docs}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in op2_piece_lattice(spark, sf_dir).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


def test_query_decodes_what_it_encoded(spark, sf_dir):
    from tidemark.llm.queries import op2_piece_lattice

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: hashlib.sha256(lib.decode(lib.encode(r["text"] or "")).encode()).hexdigest() for r in docs}
    assert {r["doc_id"]: r["text_sha256"] for r in op2_piece_lattice(spark, sf_dir).collect()} == want


def test_long_words_and_no_shuffle(spark):
    lib, v, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), P.read_model(MODEL), random.Random(4)
    rows = ["".join(rng.choices("abcdeinrst", k=20_000)), "x" * 5000, "日本" * 2000]
    got, encoded = ids_of(spark, v, rows)
    assert [got[i] for i in range(len(rows))] == [lib.encode(t) for t in rows]
    assert "Exchange" not in encoded._jdf.queryExecution().toString()


def test_unigram_viterbi(spark, tmp_path):
    path = unigram(tmp_path)
    rows, lib, v = [t for t in texts() if "<s>" not in (t or "")], sentencepiece.SentencePieceProcessor(model_file=path), P.read_model(path)
    assert v.kind == P.UNIGRAM
    got, _ = ids_of(spark, v, rows)
    score = lambda ids: sum(v.pieces[i][1] for i in ids if v.pieces[i][2] == P.NORMAL)
    for i, t in enumerate(rows):
        want = lib.encode(t or "")
        assert got[i] == want or abs(score(got[i]) - score(want)) < 1e-3 * max(1, abs(score(want)))


def test_repeated_rows_and_empty_table(spark):
    v = P.read_model(MODEL)
    docs = spark.createDataFrame([(1, "ab", "w", 1, 2, 3)] * 2 + [(None, "ab", "w", 1, 2, 3)], SCHEMA)
    assert P.encode(docs, v).count() == 3
    assert P.encode(docs.limit(0), v).count() == 0


def test_many_new_atoms_take_little_memory_and_agree_with_the_fold_of_one():
    v, rng = P.read_model(MODEL), random.Random(5)
    atoms = sorted({"▁" + "".join(rng.choices("abcdeinrstlo日👍", [9] * 12 + [1, 1], k=rng.randrange(4, 20))) for _ in range(20_000)})
    code, alone = P.Encoder(v, 1_000_000), P.Encoder(v, 0)
    tracemalloc.start()
    got = code(atoms)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x for a in atoms[::50] for x in alone([a])] == got[::50]
    assert peak < 60 << 20


def test_ids_and_texts_do_not_travel(spark):
    v, docs = P.read_model(MODEL), spark.createDataFrame([(i, t, "w", 1, 2, 3) for i, t in enumerate(texts())], SCHEMA)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(P.there_and_back(docs, v)) == key(P.digests(P.decode(P.encode(docs, v), v)))


def test_bytes_that_are_no_utf8(spark):
    v = P.read_model(MODEL)
    ids = spark.createDataFrame([([P.Encoder(v, 0).bytes + x for x in b"a\xff\xe6b"],), (None,), ([],)], "ids array<int>")
    assert [r["text"] for r in P.decode(ids, v).collect()] == ["a\ufffd\ufffdb", None, ""]
