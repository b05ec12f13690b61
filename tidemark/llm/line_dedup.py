"""Fuzzy line dedup by MinHash, with SQL functions only.

Lines equal after trimming and lower-casing are one vertex. A vertex's signature comes from its character shingles
(UTF-16 units): shingles are dealt by hash into slots, and each slot keeps its least hash (one-permutation MinHash).
Bands of ``ROWS`` slots make buckets, found by an aggregate. First, the lines of a bucket meet its centre, another line
each turn, which joins groups of near copies by pairs in proportion to their lines; then every two lines of a bucket that
are not in one component yet meet, in blocks. A map of 1024 bits for each line, with one set for each of its shingles,
rules out pairs whose maps differ in more bits than linked lines have shingles apart. For the others the exact Jaccard similarity
is computed from the whole shingle sets; distributed union-find joins what passes, and of each component only the first
line, by document id and position, stays.

Every shingle of a line enters its signature, however long the line is and however often it repeats itself. Shingles
stand for one another by 64-bit hashes.

Defined cases: a null text has no lines and stays null; lines shorter than ``min_chars`` after trimming always stay, in
place; repeated rows and rows that share an id are one document, so what stays of one stays of each; rows with a null id
are returned as they are; lines of any length are read whole; an empty table gives an empty result; all other columns
are returned as they came, but for those that have the name of one of the columns that ``dedup`` adds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import CLEANUP, MAX_BROADCAST, bounded, conf, discard, shuffle_partitions, work_dir, written
from tidemark.llm.components import components

#: Shingle length; bands and slots per band: a pair at 0.8 is a candidate with probability 0.9992, one at 0.05 with 0.00125.
K, BANDS, ROWS = 9, 10, 3
#: Lines of a bucket that meet the others in one task.
BLOCK = 1000
#: 64-bit words of a line's map.
WORDS = 16
#: Bits, by hash of the id, that tell which documents may lose lines: 8 MB, in a million rows (some tens of MB broadcast), however many documents there are.
MARKS = 1 << 26
#: Buckets' lines meet centres so many times at most, but no more once all pairs are so many for each line at most.
TURNS, FEW = 2, 64


def normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def exploded(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, pos, line, k1, k2) of every line that takes part; k1, k2: 128 bits that stand for the normalised line."""
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("pos", "raw"))
    lines = lines.select("doc", "pos", normal(F.col("raw")).alias("line")).where(F.char_length("line") >= max(min_chars, K))
    return lines.withColumn("k1", F.xxhash64("line")).withColumn("k2", F.xxhash64("line", F.lit(7)))


def shingles(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, v): a hash for each place of each line."""
    units = lines.select(*keys, F.encode("line", "UTF-16BE").alias("u"))
    places = units.select(*keys, "u", F.expr(f"explode(sequence(0, CAST(octet_length(u) DIV 2 AS INT) - {K})) AS i"))
    return places.select(*keys, F.expr(f"xxhash64(substring(u, 2 * i + 1, {2 * K})) AS v"))


def signatures(lines: DataFrame) -> DataFrame:
    """(k1, band): hashes of the bands whose slots are not all empty. ``lines`` is bucketed by k1, k2, so nothing is shuffled."""
    dealt = shingles(lines, "k1", "k2").withColumn("slot", F.pmod("v", F.lit(BANDS * ROWS)).cast("int"))
    least = [F.min(F.when(F.col("slot") % ROWS == r, F.col("v"))).alias(f"m{r}") for r in range(ROWS)]
    by = dealt.groupBy("k1", "k2", F.expr(f"slot DIV {ROWS}").alias("b")).agg(*least)
    return by.select("k1", F.xxhash64("b", *(F.coalesce(f"m{r}", F.lit(0)) for r in range(ROWS))).alias("band"))


def buckets(signed: DataFrame) -> DataFrame:
    """(band, n, low, high) of the bands that two lines share."""
    return signed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("k1").alias("low"), F.max("k1").alias("high")).where("n > 1")


def maps(held: DataFrame) -> DataFrame:
    """(k1, k2, n, c0, c1, ...): places of a line, at least as many as it has different shingles, and the map of its shingles."""
    word = lambda j: F.expr(f"bit_or(CASE WHEN shiftrightunsigned(v, 60) = {j} THEN shiftleft(1L, CAST(shiftrightunsigned(v, 54) & 63 AS INT)) ELSE 0L END)").alias(f"c{j}")
    return shingles(held, "k1", "k2").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), *map(word, range(WORDS)))


def likely(x: str, y: str, percent: int) -> str:
    """Whether two maps leave a Jaccard similarity of ``percent``: a bit that only one has is a shingle that the other lacks."""
    apart = " + ".join(f"bit_count({x}.c{j} ^ {y}.c{j})" for j in range(WORDS))
    return f"{100 + percent} * ({apart}) <= {100 - percent} * ({x}.n + {y}.n)"


PAIR = ("x.k1 AS a1", "x.k2 AS a2", "y.k1 AS b1", "y.k2 AS b2")


def marked_pairs(pairs: DataFrame, marked: DataFrame, percent: int) -> DataFrame:
    """Likely ones of (a, b) pairs of k1."""
    side = lambda p, name: marked.select(F.col("k1").alias(p), F.struct(*marked.columns).alias(name))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(likely("x", "y", percent)).selectExpr(*PAIR)


def centred(rows: DataFrame, turn: int) -> DataFrame:
    """Distinct (a, b): each line of a bucket with the bucket's centre, another line each turn, unless they are one component already."""
    mixed = F.xxhash64("band", F.lit(turn))
    centre = rows.groupBy("band").agg(F.min(F.col("k1").bitwiseXOR(mixed)).alias("m")).select("band", F.col("m").bitwiseXOR(mixed).alias("a"))
    own = rows.select(F.col("band"), F.col("k1").alias("a"), F.col("component").alias("own"))
    centre = written(centre.join(own, ["band", "a"]), "line-centres")
    return rows.join(bounded(centre), "band").where("component <> own").select("a", F.col("k1").alias("b")).distinct()


def unresolved(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """Written (k1, k2, n, c0 ..., band, component, blocks): members of buckets whose lines are not all of one component in ``found`` (k1, k2, component)."""
    alone = F.struct("k1", "k2")
    rows = members.withColumn("component", alone) if found is None else members.join(found, ["k1", "k2"], "left").withColumn("component", F.coalesce("component", alone))
    split = rows.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("low <> high")
    return written(rows.join(bounded(written(split.select("band", "blocks"), "line-blocks")), "band"), "line-members")


def crossed(rows: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of lines of one bucket that are not of one component and whose sets of 16-bit hashes leave a similarity of ``percent``.

    A hash that only one line has stands for a shingle that the other lacks, so hashes that coincide lose no pair. A bucket
    of more than ``BLOCK`` lines is cut into blocks, and every block meets every line in a task of its own. Written.
    """
    lines = held.join(bounded(written(rows.select("k1", "k2").distinct(), "line-left")), ["k1", "k2"], "left_semi")
    whole = lines.select("k1", "k2", F.expr(f"array_distinct({_hashes('line')})").alias("h"))
    sets = whole.select("k1", "k2", F.size("h").alias("d"), F.expr("array_distinct(transform(h, v -> CAST(shiftright(v, 48) AS SMALLINT)))").alias("s"))
    bands = rows.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("band")).alias("bands"))
    sets = written(sets.join(bands, ["k1", "k2"]), "line-sets")
    rows = rows.join(sets, ["k1", "k2"]).withColumn("me", F.struct("k1", "k2", "component", "d", "s", "bands", "n", *(f"c{j}" for j in range(WORDS))))
    a = rows.select("band", F.expr("pmod(k1, blocks)").alias("block"), F.col("me").alias("x"))
    b = rows.select("band", F.expr("explode(sequence(0L, blocks - 1))").alias("block"), F.col("me").alias("y"))
    alike = f"{100 + percent} * (size(x.s) + size(y.s) - 2 * size(array_intersect(x.s, y.s))) <= {100 - percent} * (x.d + y.d)"
    first = "array_intersect(x.bands, y.bands)[0] = band"  # a pair is judged in one of its buckets
    met = a.join(b.hint("merge"), ["band", "block"]).where(f"x.component < y.component AND {likely('x', 'y', percent)} AND {first} AND {alike}")
    met = written(met.selectExpr(*PAIR).distinct(), "line-crossed")
    discard(sets)
    return met


def _hashes(line: str) -> str:
    """A hash for each place of a line. Its units are bound in a lambda: as a column they would be copied, all of them, for every place."""
    return f"transform(array(encode({line}, 'UTF-16BE')), u -> transform(sequence(1, CAST(octet_length(u) AS INT) - {2 * K - 1}, 2), i -> xxhash64(substring(u, i, {2 * K}))))[0]"


def verified(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of ``percent`` or more."""
    a = lines.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("line").alias("la"))
    b = lines.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("line").alias("lb"))
    both = pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"])
    # behind a generator, so that the condition is not moved to where it would compute the hashes twice
    both = both.select("a1", "a2", "b1", "b2", F.expr(f"inline(array(struct({_hashes('la')} AS sa, {_hashes('lb')} AS sb)))"))
    return both.where(f"100 * size(array_intersect(sa, sb)) >= {percent} * size(array_union(sa, sb))").select("a1", "a2", "b1", "b2")


def edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.struct(F.col("a1").alias("k1"), F.col("a2").alias("k2")).alias("a"), F.struct(F.col("b1").alias("k1"), F.col("b2").alias("k2")).alias("b"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 24, percent: int = 80) -> DataFrame:
    """(doc, pos, keep_doc, keep_pos): every line that goes, and the line that stays for it. Written."""
    spark, table = docs.sparkSession, f"lines_{uuid.uuid4().hex[:12]}"
    every = exploded(docs, id_col, text_col, min_chars)
    distinct = every.groupBy("k1", "k2").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("line").alias("line"))
    path = work_dir(spark, "lines")
    with conf(spark, **{CLEANUP.replace(".", "__"): "true"}):
        distinct.write.option("compression", "zstd").option("path", path).bucketBy(shuffle_partitions(spark), "k1", "k2").sortBy("k1", "k2").saveAsTable(table)
    lines = spark.table(table)
    signed = written(signatures(lines), "line-signatures")
    shared = written(buckets(signed), "line-bands")
    in_buckets = members = written(signed.join(bounded(shared.where("n > 2")), "band").select("k1", "band"), "line-buckets")
    discard(signed)
    twos = shared.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).distinct()
    asked = twos.select(F.explode(F.array("a", "b")).alias("k1")).unionByName(members.select("k1")).distinct()
    asked = bounded(written(asked, "line-asked"))
    held = written(lines.select("k1", "k2", "line").join(asked, "k1", "left_semi"), "line-texts")
    # all that is read of the other lines from here on is where they stand first, so the table of all texts goes
    places = lines.select("k1", "k2", "first", "n").join(asked.withColumn("asked", F.lit(True)), "k1", "left").where("n > 1 OR asked").drop("asked")
    places = written(places, "line-places")
    spark.sql(f"DROP TABLE {table}")
    for step in (asked, spark.read.schema(lines.schema).parquet(path)):
        discard(step)
    marked = written(maps(held), "line-maps")
    members = members.join(marked, "k1")
    rows, pairs, found = unresolved(members, None), marked_pairs(twos, marked, percent), None
    for turn in range(TURNS):
        near = marked_pairs(centred(rows, turn), marked, percent)
        linked = edges(verified(near if pairs is None else pairs.unionByName(near), held, percent))
        before, found = found, written(components(_joined(found, linked)), "line-components")
        # a step's files go as soon as the next one is written; rows repeat a line's map for each of its buckets
        for step in (rows, shared if pairs is not None else None, before):
            if step is not None:
                discard(step)
        rows, pairs = unresolved(members, found.select("id.k1", "id.k2", "component")), None
        met = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
        if (met[1] or 0) <= FEW * (met[0] or 0):
            break
    discard(in_buckets)
    before, found = found, components(_joined(found, edges(verified(crossed(rows, held, percent), held, percent)))).select("id.k1", "id.k2", "component")
    for step in (rows, before, held, marked):
        discard(step)
    known = places.join(found, ["k1", "k2"], "left").where("n > 1 OR component IS NOT NULL")
    known = known.select("k1", "k2", "first", F.coalesce("component", F.struct("k1", "k2")).alias("component"))
    keep = known.groupBy("component").agg(F.min("first").alias("keep"))
    known = written(known.select("k1", "k2", "component").join(keep, "component").select("k1", "k2", "keep"), "line-keep")
    gone = every.select("doc", "pos", "k1", "k2").join(bounded(known), ["k1", "k2"]).where("doc <> keep.doc OR pos <> keep.pos")
    out = written(gone.select("doc", "pos", F.col("keep.doc").alias("keep_doc"), F.col("keep.pos").alias("keep_pos")), "line-repeats")
    for step in (known, places):
        discard(step)
    return out


def _joined(found: DataFrame | None, linked: DataFrame) -> DataFrame:
    """New links, and those that components stand for."""
    return linked if found is None else found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(linked)


def touched(rows: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (with ``doc``) that may lose a line of ``gone``, and those that lose none and need not be shuffled. By ``MARKS`` bits, broadcast."""
    place = F.pmod(F.xxhash64("doc"), F.lit(MARKS))
    word, bit = F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(doc), {MARKS}) & 63 AS INT))")
    marks = gone.groupBy(word).agg(F.bit_or(bit).alias("marks"))
    marked = rows.withColumn("word", word).join(F.broadcast(marks), "word", "left")
    maybe = F.coalesce(F.col("marks").bitwiseAND(bit) != 0, F.lit(False))
    return marked.where(maybe).drop("word", "marks"), marked.where(~maybe).drop("word", "marks")


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 24, percent: int = 80) -> DataFrame:
    """(row: all columns of ``docs`` as they came, text without its repeated lines, n_lines, n_dropped, kept_in)."""
    gone = repeats(docs, id_col, text_col, min_chars, percent)
    by = gone.groupBy("doc").agg(F.collect_set("pos").alias("pos"), F.array_sort(F.collect_set("keep_doc")).alias("keepers"))
    few = gone.count() <= MAX_BROADCAST // 4  # some tens of MB
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc"))
    parts = F.split(F.col("row")[text_col], "\n")
    left = lambda p: F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("pos")), lambda i: F.get(p, i))
    # bound in a lambda, a text is split once, not for each of its lines
    text = F.when(F.col("pos").isNull(), F.col("row")[text_col]).otherwise(F.transform(F.array(parts), lambda p: F.array_join(left(p), "\n"))[0])
    if few:
        joined = rows.join(F.broadcast(by), "doc", "left")
    else:
        some, rest = touched(rows, gone)
        joined = some.join(by.hint("shuffle_hash"), "doc", "left").unionByName(rest, allowMissingColumns=True)
    return joined.select(
        "row",
        text.alias("text"),
        F.when(F.col("row")[text_col].isNull(), 0).otherwise(F.size(parts)).cast("bigint").alias("n_lines"),
        F.when(F.col("pos").isNull(), 0).otherwise(F.size("pos")).cast("bigint").alias("n_dropped"),
        F.coalesce("keepers", F.expr(f"CAST(array() AS array<{dict(docs.dtypes)[id_col]}>)")).alias("kept_in"),
    )


#: What ``dedup`` adds.
ADDED = ("n_lines", "n_dropped", "kept_in")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 24, percent: int = 80) -> DataFrame:
    """All columns of ``docs``, the text without its repeated lines, and n_lines, n_dropped, kept_in (ids of the documents that hold what stays)."""
    out = cut(docs, id_col, text_col, min_chars, percent)
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED), *ADDED)
