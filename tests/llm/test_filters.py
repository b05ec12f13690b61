"""URL cascade, chat windows, exact dedup, quality and the pipeline against brute force, and their edge cases."""

import collections
import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat_format, exact_dedup, line_dedup, quality, url_filters
from tidemark.llm.common import work_dir
from tidemark.llm.queries import FORGED, LISTED, ORACLE_SQL, QUERIES, RULES, op6_quality, op8_chat_format


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got = QUERIES[name](spark, sf_dir)
    out = con.execute(ORACLE_SQL[name])
    at = [d[0] for d in out.description]
    assert sorted(at) == sorted(got.columns)
    assert collections.Counter(tuple(r[c] for c in at) for r in got.collect()) == collections.Counter(out.fetchall())


# URLs

URLS = [None, "", "no scheme", "http://", "HTTP://Ads-X.Example.NET/en/a?b#c", "x://net/", "x://net", "x://a.net/q", "x://example.com/de/", "x://www.example.com/de", "x://a.org/fr/?", "x://a.org#fr/", "x://borg/fr/", "a://b://c/d", "x://ads-1.b.org/z", "x://ÄDS.org/fr/é\n?"]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(on + start), f"{on}{start}", kind) for kind, on, start in RULES if (host == on or host.endswith("." + on)) and path.startswith(start)]
    listed = bool(re.search(LISTED, host))
    return host, path, max(fits)[1] if fits else None, listed, max(fits)[2] if fits else "block" if listed else "allow"


@pytest.mark.parametrize("max_bits", [1 << 27, 1])
def test_urls(spark, max_bits):
    rows = [(i, u, "x", True, "y") for i, u in enumerate(URLS + URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, key string, listed boolean, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filters.judge(pages, RULES, F.col("host").rlike(LISTED), max_bits=max_bits).collect()}
    assert got == {i: judged(u) for i, u, *_ in rows}
    assert url_filters.judge(pages.limit(0), RULES, F.lit(True)).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"), (F.xxhash64("id") % 3 == 0).alias("listed"))
    c = url_filters.Cascade(universe)
    assert c.exact and len(c.levels) >= 2
    assert c.mark(universe, "key", "found").where("found <> listed").count() == 0
    for listed in (True, False):
        every = universe.withColumn("listed", F.lit(listed))
        assert url_filters.Cascade(every).mark(every, "key", "found").where("found <> listed").count() == 0


# Conversations


def conversations():
    rng = random.Random(1)
    word = lambda: rng.choice(["hi", "~1", "<|im_end|>\n", "[INST]", "é", "👍", "\\", "x" * 30, "\n", FORGED])
    rows = []
    for c in range(12):
        if c % 3:
            rows.append((c, -1, "system", " ".join(word() for _ in range(20))))
        rows += [(c, k, ["user", "assistant"][k % 2], " ".join(word() for _ in range(rng.choice([0, 3, 60, 400])))) for k in range(rng.randint(1, 14))]
    return rows + [(50, 1, "assistant", "b"), (50, 1, "assistant", "a"), (50, 1, "assistant", "a"), (51, None, None, None), (51, 0, "tool\nx~3", None), (None, 0, "assistant", "alone")]


def test_chat(spark):
    rows = conversations()
    frame = spark.createDataFrame([(*r, "w", [1], 3) for r in rows], "conv_id long, turn long, role string, text string, window string, mask array<int>, n int")
    windows = chat_format.windows(frame, 300, 80)
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.read_back(windows)).collect()}
    made = collections.defaultdict(list)
    for w in windows.collect():
        made[w["conv_id"]].append(w)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=key)
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g["formatted_chars"] == sum(len(w["formatted"]) for w in made[c])
        for w in made[c]:
            assert "[INST]" not in w["formatted"] and "</s>" not in w["formatted"] and w["formatted"].count("<|im_start|>") == w["formatted"].count("<|im_end|>\n")
            if turns[0][2] == "system":
                assert w["formatted"].startswith("<|im_start|>system\n")
    assert max(len(m) for m in made.values()) > 2
    assert any(w["n_context"] > 1 for m in made.values() for w in m)
    assert chat_format.read_back(chat_format.windows(frame.limit(0))).count() == 0


def test_op8_forged_conversation(spark, sf_dir):
    r = op8_chat_format(spark, sf_dir).where("conv_id = -7").first()
    assert r["n_turns"] == 2 and r["loss_sha256"] == hashlib.sha256(FORGED.encode()).hexdigest() and r["loss_chars"] == len(FORGED)


# Exact copies


def test_exact_dedup_edges(spark):
    rows = [(1, "Äb"), (2, "äb"), (3, "ÄB"), (4, None), (5, ""), (5, ""), (None, "ÄB"), (6, "x" * 100_000), (7, "X" * 100_000)]
    docs = spark.createDataFrame([(i, t, "d", 1, 2) for i, t in rows], "doc_id long, text string, digest string, keep_id int, id int")
    index = exact_dedup.DigestIndex(spark, work_dir(spark, "test-index"), 4)
    got = [tuple(r)[:4] for r in exact_dedup.annotate(docs, index).collect()]
    want = [(1, 3, 3, False), (2, 2, 1, True), (3, 3, 3, True), (4, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True), (None, 3, 3, False), (6, 7, 2, False), (7, 7, 2, True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    more = spark.createDataFrame([(90, "äb", "d", 1, 2), (91, "new", "d", 1, 2)], docs.schema)
    assert sorted(tuple(r)[:4] for r in exact_dedup.annotate(more, index).collect()) == [(90, 2, 1, False), (91, 91, 1, True)]
    again = exact_dedup.DigestIndex(spark, index.path, 4)
    assert again.read().count() == 5 and exact_dedup.annotate(docs.limit(0), again).count() == 0


def test_batches_meet_a_filled_index_and_a_rerun_changes_nothing(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i if i % 50 else None, f"Text {rng.randrange(60)}") for i in range(1, 400)], "doc_id long, text string")
    whole, parts = (exact_dedup.DigestIndex(spark, work_dir(spark, "test-index"), 4) for _ in range(2))
    want = sorted(map(str, exact_dedup.annotate(docs, whole).collect()))
    assert sorted(map(str, exact_dedup.annotate(docs, parts, batches=3).collect())) == want
    n = parts.read().count()
    assert n == whole.read().count() and sorted(map(str, exact_dedup.annotate(docs, parts, batches=2).collect())) == want
    assert parts.read().count() == n
    parts.close()


def test_probes_stay_in_range_at_the_ends_of_a_hash(spark):
    keys = spark.range(300_000).selectExpr("concat('host', id, '.net') AS key")
    bits = 1 << 20
    low, high = keys.select(*(p.alias(f"p{i}") for i, p in enumerate(url_filters.probes(F.col("key"), 1, bits)))).agg(F.min(F.least("p0", "p1", "p4")), F.max(F.greatest("p0", "p1", "p4"))).first()
    assert 0 <= low and high < bits
    most = spark.sql(f"SELECT {(1 << 63) - 1}L AS a, {-(1 << 63)}L AS b")
    assert most.select(*(F.pmod("a", F.lit(bits)) + i * (F.pmod("b", F.lit(bits - 1)) + 1) for i in range(5))).first() is not None


def test_index_side_needs_no_exchange(spark):
    index = exact_dedup.DigestIndex(spark, work_dir(spark, "test-index"), 4)
    docs = spark.createDataFrame([(i, str(i)) for i in range(50)], "doc_id long, text string")
    groups = exact_dedup.digests(docs).groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    index.append(groups)
    plan = index.new_groups(groups)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning(digest") == 1


# Quality


def test_score_replaces_a_column_of_its_name(spark):
    docs = spark.createDataFrame([(1, None, 7.0), (2, "", 7.0), (2, "", 7.0), (3, "word " * 50_000, 7.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.score(docs, quality.train(docs, labels, F.lit(True)))
    assert out.columns == ["doc_id", "text", "score"] and {r["score"] for r in out.collect()} == {0.5}


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op6_quality(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.9
    good, bad = ([r["score"] for r in held if truth[r["doc_id"]] == q] for q in (1, 0))
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "fine words here"), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (99, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels, F.lit(True))
    assert len({r["score"] for r in quality.score(docs, model).collect()}) == 1
    assert quality.score(docs.limit(0), model).count() == 0


# Pipeline


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    kept = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert kept.columns == names and 0 < kept.count() <= docs.count()
    lines = corpus_pipeline.line_stage(spark, kept, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in lines.collect()}
    want = {r["doc_id"]: r["text"] for r in line_dedup.dedup(kept).collect()}
    assert lines.columns == names and all(want[i] == t for i, t in texts.items()) and all(not want[i].strip() for i in want.keys() - texts.keys())
    left = corpus_pipeline.near_copy_stage(spark, lines, sf_dir)
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    root = {i: i for i in ids}
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    assert left.columns == names and sorted(r["doc_id"] for r in left.collect()) == sorted(i for i in ids if root[i] == i)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()} == {i for i in ids if root[i] == i}


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
