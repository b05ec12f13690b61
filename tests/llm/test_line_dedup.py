"""Fuzzy line dedup against all pairs of lines."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup

SCHEMA = "doc_id long, text string, doc string, pos int, keep long, k1 long"


def shingles(line):
    u = line.encode("utf-16-be")
    return {u[i : i + 2 * line_dedup.K] for i in range(0, len(u) - 2 * line_dedup.K + 1, 2)}


def brute(rows, min_chars, percent):
    """Texts without lines that the first line of their component stands for."""
    lines = [(d, p, raw, raw.strip(" ").lower()) for d, t in sorted(rows) if t is not None for p, raw in enumerate(t.split("\n"))]
    part = [x for x in lines if len(x[3]) >= max(min_chars, line_dedup.K)]
    sets, root = [shingles(x[3]) for x in part], list(range(len(part)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(part)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    gone = {part[i][:2] for i in range(len(part)) if find(i) != i}
    return {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone) for d, t in rows}


def corpus():
    rng = random.Random(3)
    syllables = ["ba", "ké", "lo", "mi", "ru", "st", "en", "ж", "на", "👍"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    pool = [" ".join(word() for _ in range(rng.choice([3, 8, 30, 90]))) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "short"), (4, "short\nshort"), (5, "x" * 3000), (6, "  " + "X" * 3000 + " ")]
    for i in range(7, 60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            words = rng.choice(pool).split(" ") if rng.random() < 0.7 else [word() for _ in range(40)]
            if rng.random() < 0.4 and len(words) > 20:
                words[rng.randrange(len(words))] = word()
            lines.append(" ".join(words).upper() if rng.random() < 0.1 else " ".join(words))
        rows.append((i, "\n".join(lines)))
    return rows


def test_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "s", 1, 2, 3) for i, t in rows], SCHEMA)
    out = line_dedup.dedup(docs).collect()
    want = brute(rows, 24, 80)
    got = {r["doc_id"]: r["text"] for r in out}
    same = sum(got[i] == want[i] for i in want)
    assert len(got) == len(rows) and same >= len(rows) - 1  # MinHash may miss a pair
    for r in out:
        assert r["n_lines"] == (0 if dict(rows)[r["doc_id"]] is None else dict(rows)[r["doc_id"]].count("\n") + 1)
        assert (r["n_dropped"] > 0) == bool(r["kept_in"]) and (r["doc"], r["pos"], r["keep"], r["k1"]) == ("s", 1, 2, 3)


def test_repeated_rows_null_ids_and_empty_table(spark):
    line = "the same line in many documents, over and over"
    rows = [(4, line), (4, line), (None, line), (9, f"{line}\n{line}\nown words of document nine, which stay")]
    docs = spark.createDataFrame([(i, t, "s", 1, 2, 3) for i, t in rows], SCHEMA)
    got = sorted((r["doc_id"] or 0, r["text"], r["n_dropped"]) for r in line_dedup.dedup(docs).collect())
    assert got == [(0, line, 0), (4, line, 0), (4, line, 0), (9, "own words of document nine, which stay", 2)]
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def linked(spark, pairs):
    """How many of the pairs of lines, each pair in two documents of its own, lose their second line."""
    rows = [(2 * i + j, line, "s", 1, 2, 3) for i, pair in enumerate(pairs) for j, line in enumerate(pair)]
    out = line_dedup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["kept_in"] in ([], [r["doc_id"] - 1]) for r in out)
    return sum(r["n_dropped"] for r in out)


def test_lines_of_unequal_length_meet(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n - 2)).join("<>")
    pairs = []
    for n in range(150, 410):
        line, at = text(n), rng.randrange(20, n - 20)
        pairs.append((line, line[:at] + text(n // 12) + line[at:]))
    alike = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in pairs]
    assert min(alike) >= 0.8
    assert linked(spark, pairs) >= 0.99 * len(pairs)


def test_repetitive_lines_of_unequal_length_meet(spark):
    rng = random.Random(12)
    pairs = [("x" * 3000, "x" * 2900)]
    for _ in range(12):
        rule = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz-=", k=rng.randint(10, 40)))
        pairs.append((rule * 400, rule * 380))
    assert linked(spark, pairs) == len(pairs)


def test_a_pair_at_the_threshold_is_a_candidate():
    assert 1 - (1 - 0.8**line_dedup.ROWS) ** line_dedup.BANDS >= 0.999


def test_every_pair_of_a_hot_bucket_meets(spark):
    rng = random.Random(13)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    phrase, rows = text(60), []  # most of every line, so that all share bands, at 0.72; those of a pair are alike at 0.82
    for i in range(400):
        own = phrase + text(4)
        rows += [(2 * i, own + text(6)), (2 * i + 1, own + text(6))]
    kept = brute(rows, 24, 80)
    want = {d for d, t in rows if kept[d] == ""}
    got = {r["doc_id"] for r in line_dedup.dedup(spark.createDataFrame([(i, t, "s", 1, 2, 3) for i, t in rows], SCHEMA)).collect() if r["n_dropped"]}
    assert len(want) >= 400 and got <= want and len(got) >= 0.99 * len(want)


def test_steps_are_discarded_as_soon_as_the_next_is_there(spark, monkeypatch):
    """Rows with a map for each bucket of a line are never held twice, and no step of buckets stays at the end."""
    held, most, write, discard = {}, [], line_dedup.written, line_dedup.discard

    def written(df, name, *rest):
        out = write(df, name, *rest)
        held.update(dict.fromkeys({f.rpartition("/")[0] for f in out.inputFiles()}, name))
        most.append(sum(x == "line-members" for x in held.values()))
        return out

    def gone(df):
        for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
            held.pop(f, None)
        discard(df)

    monkeypatch.setattr(line_dedup, "written", written)
    monkeypatch.setattr(line_dedup, "discard", gone)
    line_dedup.repeats(spark.createDataFrame([(i, t, "s", 1, 2, 3) for i, t in corpus()], SCHEMA))
    assert max(most) == 1
    assert not {"line-members", "line-buckets", "line-asked", "line-maps", "line-texts", "line-bands"} & set(held.values())


def test_texts_go_before_lines_are_crossed(spark, monkeypatch):
    base, seen, crossed = spark.sparkContext.getConf().get("spark.checkpoint.dir") + "/tidemark", [], line_dedup.crossed
    tables = lambda: {f for f in os.listdir(base) if f.startswith("lines-")} if os.path.isdir(base) else set()
    before, rng = tables(), random.Random(8)
    long = "".join(rng.choices("abcdefghij ", k=60_000))  # so many shingles that their 16-bit hashes coincide
    other = long[:30_000] + "#" * 40 + long[30_000:55_000]
    rows = [(i, f"line number {i} of this text\n{t}") for i, t in enumerate([long, other, long[::-1]])]
    monkeypatch.setattr(line_dedup, "crossed", lambda *a: (seen.append(tables() - before), crossed(*a))[1])
    out = {r["doc_id"]: r["kept_in"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1][-1:] == [0] and not out[2]
    assert seen == [set()]


def test_crossed_sets_lose_no_long_pair(spark):
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefghij ", k=60_000))
    held = spark.createDataFrame([(1, 1, long), (2, 2, long[:54_000])], "k1 long, k2 long, line string")
    marked = line_dedup.maps(held).select("k1", "k2", "n", *(F.lit(0).cast("long").alias(f"c{j}") for j in range(line_dedup.WORDS)))
    rows = marked.withColumn("band", F.lit(5)).withColumn("component", F.struct("k1", "k2")).withColumn("blocks", F.lit(1).cast("long"))
    assert [tuple(r) for r in line_dedup.crossed(rows, held, 80).collect()] == [(1, 1, 2, 2)]


def test_documents_that_lose_nothing_are_not_shuffled(spark, monkeypatch):
    """Beyond what is broadcast, whole texts move only where a line may go; few marks, so some coincide."""
    line = "the same line in two documents, over and over"
    rows = [(i, f"own words of document {i * i * 7919}, which stay") for i in range(40)]
    rows += [(40, line), (41, f"{line}\n{line}\nand more"), (42, None), (None, line)]
    docs = spark.createDataFrame([(i, t, "s", 1, 2, 3) for i, t in rows], SCHEMA)
    gone = line_dedup.repeats(docs)
    losing = {r["doc"] for r in gone.collect()}
    assert 41 in losing and 40 not in losing
    want = sorted(map(str, line_dedup.dedup(docs).collect()))
    for marks in (1 << 26, 64):
        monkeypatch.setattr(line_dedup, "MARKS", marks)
        some, rest = ([r["doc"] for r in x.collect()] for x in line_dedup.touched(docs.select(F.col("doc_id").alias("doc")), gone))
        assert sorted(map(str, some + rest)) == sorted(str(i) for i, _ in rows) and losing <= set(some)
        assert marks == 64 or set(some) == losing
    monkeypatch.setattr(line_dedup, "repeats", lambda *_: gone)
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST", 0)
    out = line_dedup.dedup(docs)
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, out.collect())) == want


def test_sets_of_a_pair_are_made_once_and_judged_exactly(spark):
    rng = random.Random(14)
    syllables = ["ba", "ké", "lo", "mi", "👍", "жа", " "]
    rows, want = [], set()
    for i in range(120):
        a = "".join(rng.choices(syllables, k=rng.randint(12, 200)))
        at = rng.randrange(len(a))
        b = a[:at] + "".join(rng.choices(syllables, k=rng.randint(1, 12))) + a[at:]
        x, y = shingles(a), shingles(b)
        rows.append((2 * i, a, 2 * i + 1, b))
        want |= {2 * i} if 100 * len(x & y) >= 80 * len(x | y) else set()
    lines = spark.createDataFrame([(k, k, t) for a, x, b, y in rows for k, t in ((a, x), (b, y))], "k1 long, k2 long, line string")
    pairs = spark.createDataFrame([(a, a, b, b) for a, _, b, _ in rows], "a1 long, a2 long, b1 long, b2 long")
    out = line_dedup.verified(pairs, lines, 80)
    assert 20 < len(want) < 110 and {r["a1"] for r in out.collect()} == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") == 2


def test_a_text_is_split_once_and_not_for_each_of_its_lines(spark):
    line = "the same line in two documents, over and over"
    long = "\n".join(x for i in range(3000) for x in (f"own line number {i * 7919} of the long document {i}", line))
    gone = spark.createDataFrame([(2, 2 * i + 1, 1, 0) for i in range(3000)], "doc long, pos int, keep_doc long, keep_pos int")
    docs = spark.createDataFrame([(1, line), (2, long), (3, None)], "doc_id long, text string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(line_dedup, "repeats", lambda *_: gone)
        out = line_dedup.dedup(docs)
    assert "-1)[lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in out.collect()}
    assert got == {1: (line, 0), 2: ("\n".join(long.split("\n")[::2]), 3000), 3: (None, 0)}
