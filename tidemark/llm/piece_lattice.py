"""SentencePiece encoding and decoding over a relational lattice.

A text's words (runs of spaces with what follows them) are cut where two characters stand side by side that no piece has
so. Every different part of a batch of texts is encoded once: its substrings up to the longest piece are exploded, joined
to the piece table by equality, grouped by part and end, and folded. For a unigram model the fold is Viterbi's: the best
sum of scores. A BPE model has no additive best path, so Viterbi would give other ids than the model's own; there the
fold joins step by step the neighbours whose union is the best-scored edge, in all parts at once. Characters without a
piece become bytes.

The lattice's tables are columns of an Arrow batch, not DataFrames: most words of a corpus are rare, and to meet their ids
across the cluster they would be shuffled twice. A worker remembers a bounded number of parts, so nothing is shuffled.
Encoding, decoding and digests are steps on Arrow batches; in one plan they share one Python worker.

Defined cases: null texts count as empty, and empty texts have no ids; repeated rows and rows that share an id are each
encoded; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.llm.common import conf, written


SPACE = "▁"
#: Piece types and model types of the file format. Fixed values.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Atoms that a worker remembers at most (some 200 bytes each), characters that one lattice is made for, and texts that are encoded together.
FREQUENT, AT_ONCE, TEXTS = 300_000, 1 << 16, 500
#: So few atoms are folded one by one: a long one needs as many rounds as it has unions.
ALONE = 16
#: No union: more than any rank.
NONE = 1 << 30
#: A run of marks with the characters up to the next mark; no piece goes over such a border.
WORD = re.compile(f"{SPACE}*[^{SPACE}]*")


@dataclass(frozen=True)
class Vocabulary:
    pieces: list[tuple[str, float, int]]  # text, score, type; the id is the place
    kind: int
    byte_fallback: bool
    dummy_prefix: bool
    squeeze: bool
    unknown: int


def _items(data: bytes):
    """(field, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        else:
            n = varint()
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def read_model(path: str) -> Vocabulary:
    """The parts of a model file that encoding needs. Normalisation beyond spaces is an error."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, trainer, normal = [], {}, {}
    for field, value in _items(data):
        if field == 1:
            p = dict(_items(value))
            pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p.get(2, b"\0" * 4))[0], p.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(_items(value))
        elif field == 3:
            normal = dict(_items(value))
    if normal.get(2):
        raise ValueError("a model with a character map is not supported")
    unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
    return Vocabulary(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), bool(normal.get(3, 1)), bool(normal.get(4, 1)), unknown)


class Lattice:
    """The pieces as a table (length, key, id), and what joins it: substrings of atoms, by equality."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, v: Vocabulary):
        own = [(p, i) for i, (p, _, kind) in enumerate(v.pieces) if kind in (NORMAL, USER) and p]
        self.scores = np.array([s for _, s, _ in v.pieces], float)
        self.longest = max((len(p) for p, _ in own), default=0)
        self.tables = {}
        for n in sorted({len(p) for p, _ in own}):
            some = [x for x in own if len(x[0]) == n]
            codes = np.frombuffer("".join(p for p, _ in some).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)
            key = np.zeros(len(some), np.uint64)
            for k in range(n):
                key = self.longer(key, codes[:, k])
            by = np.argsort(key, kind="stable")
            self.tables[n] = key[by], codes[by], np.array([x[1] for x in some], np.int32)[by]

    def longer(self, key: np.ndarray, code: np.ndarray) -> np.ndarray:
        key = (key + code.astype(np.uint64) + np.uint64(1)) * self.FACTOR
        return key ^ (key >> np.uint64(29))

    def table(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of characters (atoms begin and end at ``ends``) the edges: row start, column length, the id or -1. Every substring, exploded by length, meets the pieces."""
        left = np.repeat(ends[1:], np.diff(ends)) - np.arange(len(codes))  # characters from a place to its atom's end
        edges = np.full((len(codes), self.longest + 1), -1, np.int32)
        at, key = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for n in range(1, self.longest + 1):
            inside = left[at] >= n
            at, key = at[inside], key[inside]
            key = self.longer(key, codes[at + n - 1])
            if n in self.tables and len(at):
                keys, pieces, ids = self.tables[n]
                # two pieces of one key follow each other, so the key's first and its next ones are compared whole
                place = np.searchsorted(keys, key)
                rows = np.flatnonzero(keys[np.minimum(place, len(keys) - 1)] == key)
                place = place[rows]
                while len(rows):
                    same = (pieces[place] == codes[at[rows][:, None] + np.arange(n)]).all(1)
                    edges[at[rows[same]], n] = ids[place[same]]
                    rows, place = rows[~same], place[~same] + 1
                    more = place < len(keys)
                    rows, place = rows[more], place[more]
                    again = keys[place] == key[rows]
                    rows, place = rows[again], place[again]
        return edges

    def lists(self, edges: np.ndarray) -> tuple[list[tuple[int, int]], list[int], list[float]]:
        """An atom's rows of ``table``, by end, as lists of (start, end), id and score."""
        start, n = np.nonzero(edges >= 0)
        order = np.lexsort((start, start + n))
        start, n = start[order], n[order]
        ids = edges[start, n]
        return list(zip(start.tolist(), (start + n).tolist(), strict=True)), ids.tolist(), self.scores[ids].tolist()


def best_path(n: int, spans: list[tuple[int, int]], ids: list[int], scores: list[float], low: float) -> list[tuple[int, int, int]]:
    """(start, end, id) of the path with the best sum of scores, by Viterbi; id -1 for a character without an edge of its own, which costs ``low``."""
    best, back, k = [0.0], [(0, -1)], 0
    for end in range(1, n + 1):
        found, alone = [], True
        while k < len(spans) and spans[k][1] == end:
            start = spans[k][0]
            found.append((best[start] + scores[k], start, ids[k]))
            alone &= start != end - 1
            k += 1
        if alone:
            found.append((best[end - 1] + low, end - 1, -1))
        score, *step = max(found)
        best.append(score)
        back.append(tuple(step))
    out, end = [], n
    while end:
        start, i = back[end]
        out.append((start, end, i))
        end = start
    return out[::-1]


def merged(n: int, spans: list[tuple[int, int]], ids: list[int], scores: list[float]) -> list[tuple[int, int, int]]:
    """(start, end, id) of an atom's symbols after joining, again and again, the neighbours whose union scores best, the first of equals; id -1 as in ``best_path``."""
    score = dict(zip(spans, scores, strict=True))
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that starts at a place
    heap = [(-score[i, i + 2], i, i + 1, i + 2) for i in range(n - 1) if (i, i + 2) in score]
    heapify(heap)
    gone = [False] * n
    while heap:
        _, i, middle, last = heappop(heap)
        if gone[i] or end[i] != middle or gone[middle] or end[middle] != last:
            continue
        gone[middle], end[i] = True, last
        if last < n:
            before[last] = i
            if (i, end[last]) in score:
                heappush(heap, (-score[i, end[last]], i, last, end[last]))
        p = before[i]
        if p >= 0 and (p, last) in score:
            heappush(heap, (-score[p, last], p, i, last))
    known = dict(zip(spans, ids, strict=True))
    return [(i, end[i], known.get((i, end[i]), -1)) for i in range(n) if not gone[i]]


def all_merged(edges: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``merged`` of many atoms, one union of each in a round: each character's symbol length, 0 inside a symbol; and the atoms that are not done.

    ``edges`` as by ``Lattice.table``, ``rank`` of ids: less is better, equal scores have one rank.
    """
    length, todo = np.ones(len(edges), np.int64), np.flatnonzero(np.diff(ends))
    ranks = np.where(edges >= 0, rank[edges], NONE)

    def union(start: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(n < ranks.shape[1], ranks[start, np.minimum(n, ranks.shape[1] - 1)], NONE)

    # of the symbols that are left, of atoms that go on: start, length, whether they are an atom's last, rank of the union with the next
    start, n, last = np.arange(len(edges)), length.copy(), np.zeros(len(edges), bool)
    last[ends[1:][todo] - 1] = True
    best, first = np.where(last, NONE, union(start, n + 1)), ends[:-1][todo]
    while len(todo):
        least = np.minimum.reduceat((best << 32) + np.arange(len(best)), first)
        goes = least >> 32 < NONE
        if not goes.all():
            sizes = np.diff(first, append=len(start))
            kept = np.repeat(goes, sizes)
            start, n, last, best = start[kept], n[kept], last[kept], best[kept]
            moved = np.cumsum(~kept)[least & 0xFFFFFFFF]
            todo, least, sizes = todo[goes], (least - moved)[goes], sizes[goes]
            first = np.cumsum(sizes) - sizes
        if len(todo) <= ALONE:
            break
        at = least & 0xFFFFFFFF
        n[at] += n[at + 1]
        last[at] = last[at + 1]
        length[start[at]], length[start[at + 1]] = n[at], 0
        follows = np.minimum(at + 2, len(start) - 1)
        best[at] = np.where(last[at], NONE, union(start[at], n[at] + n[follows]))
        has = at > first
        before = at[has] - 1
        best[before] = union(start[before], n[before] + n[at[has]])
        kept = np.ones(len(start), bool)
        kept[at + 1] = False
        start, n, last, best, first = start[kept], n[kept], last[kept], best[kept], first - np.arange(len(first))
    return length, todo


def cut(texts: pa.Array, v: Vocabulary) -> tuple[pa.Array, np.ndarray]:
    """The words of texts one after another, and where each text's begin and end; null counts as empty."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    if v.squeeze:
        plain = pc.replace_substring_regex(pc.utf8_trim(plain, characters=" "), " +", " ")
    plain = pc.replace_substring(plain, " ", SPACE)
    mark, nothing = (pa.scalar(x, pa.large_string()) for x in (SPACE, ""))
    some = pc.not_equal(plain, nothing)
    if v.dummy_prefix:
        plain = pc.if_else(some, pc.binary_join_element_wise(mark, plain, nothing), plain)
    odd = pc.or_(pc.match_substring(plain, SPACE * 2), pc.and_(some, pc.invert(pc.starts_with(plain, SPACE)))).to_numpy(zero_copy_only=False)
    if not odd.any():  # every word has one mark, at its start
        parts = pc.split_pattern(plain, SPACE)
        ends = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        flat = parts.flatten()
        first = np.zeros(len(flat), bool)
        first[ends[:-1]] = True  # what stands before the first mark is empty
        return pc.binary_join_element_wise(mark, flat.filter(pa.array(~first)), nothing), ends - np.arange(len(ends))
    words = [[w for w in WORD.findall(t) if w] for t in plain.to_pylist()]
    return pa.array([w for row in words for w in row], pa.large_string()), np.cumsum([0, *map(len, words)])


class Atoms:
    """Parts of words between two characters that no piece has side by side, so no piece goes over such a border."""

    def __init__(self, v: Vocabulary):
        pairs = {(ord(x), ord(y)) for p, _, kind in v.pieces if kind in (NORMAL, USER) for x, y in pairwise(p)}
        self.near = np.array(sorted(x << 21 | y for x, y in pairs) or [-1], np.int64)

    def __call__(self, words: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The atoms of these words, and where each word's begin and end."""
        text = "".join(words)
        ends = np.cumsum([0, *map(len, words)])
        code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        pair = code[:-1] << 21 | code[1:]
        border = np.ones(len(code) + 1, bool)
        border[1:-1] = self.near[np.minimum(np.searchsorted(self.near, pair), len(self.near) - 1)] != pair
        border[ends] = True
        at = np.flatnonzero(border)
        return pa.array([text[a:b] for a, b in pairwise(at.tolist())], pa.string()).dictionary_encode(), np.searchsorted(at, ends)


class Encoder:
    """Ids of atoms: new ones by the lattice, many at a time; ``kept`` are remembered at most, those seen again the longest."""

    def __init__(self, v: Vocabulary, kept: int):
        self.v, self.kept, self.lattice = v, kept, Lattice(v)
        self.known: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        self.bytes = {p: i for i, (p, _, kind) in enumerate(v.pieces) if kind == BYTE}.get("<0x00>", 0)
        self.low = min((s for _, s, kind in v.pieces if kind in (NORMAL, USER)), default=0.0) - 10.0
        self.rank = np.unique(-self.lattice.scores, return_inverse=True)[1].astype(np.int64)

    def lengths(self, edges: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each character's symbol length, 0 inside a symbol."""
        length, alone = (np.ones(len(edges), np.int64), np.arange(len(ends) - 1)) if self.v.kind == UNIGRAM else all_merged(edges, ends, self.rank)
        for k in alone.tolist():
            a, b = ends[k], ends[k + 1]
            own = self.lattice.lists(edges[a:b])
            path = best_path(int(b - a), *own, self.low) if self.v.kind == UNIGRAM else merged(int(b - a), *own)
            length[a:b] = 0
            for x, y, _ in path:
                length[a + x] = y - x
        return length

    def folded(self, atoms: list[str]) -> list[bytes]:
        codes = np.frombuffer("".join(atoms).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([0, *map(len, atoms)])
        edges = self.lattice.table(codes, ends)
        length = self.lengths(edges, ends)
        start = np.flatnonzero(length)
        ids = edges[start, length[start]]
        sizes = np.ones(len(start), np.int64)
        none = ids < 0
        if none.any() and self.v.byte_fallback:
            bad = codes[start[none]]
            sizes[none] = 1 + (bad >= 0x80).astype(int) + (bad >= 0x800) + (bad >= 0x10000)
            ids = np.repeat(ids, sizes)
            ids[ids < 0] = np.frombuffer(bad.tobytes().decode("utf-32-le").encode(), np.uint8).astype(np.int32) + self.bytes
        else:
            ids[none] = self.v.unknown
        data, at = ids.astype("<i4").tobytes(), (4 * np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(start, ends)]).tolist()
        return [data[a:b] for a, b in pairwise(at)]

    def __call__(self, atoms: list[str]) -> list[bytes]:
        if len(self.known) > self.kept // 2:
            self.known = {}
        if len(self.recent) > self.kept // 2:
            self.recent = {}
        for a in atoms:
            if a in self.recent:
                self.known[a] = self.recent.pop(a)
        new = [a for a in atoms if a not in self.known]
        total = np.cumsum([0, *map(len, new)])
        for a, b in pairwise([*np.searchsorted(total, np.arange(0, max(total[-1], 1), AT_ONCE)).tolist(), len(new)]):
            if a < b:
                self.recent.update(zip(new[a:b], self.folded(new[a:b]), strict=True))
        return [self.known.get(a) or self.recent[a] for a in atoms]


#: The vocabulary that this worker encoded with last, and its tables: tasks are many and short, the tables take a good part of a second.
_last: tuple[tuple[bytes, int], Atoms, Encoder] | None = None


def _encoder(v: Vocabulary, kept: int) -> tuple[Atoms, Encoder]:
    global _last
    key = hashlib.sha256(pickle.dumps(v)).digest(), kept
    if _last is None or _last[0] != key:
        _last = None
        _last = key, Atoms(v), Encoder(v, kept)
    return _last[1:]


Batches = Iterator[pa.RecordBatch]


def encoding(batches: Batches, v: Vocabulary, frequent: int) -> Batches:
    """Batches of (doc_id, text) to (doc_id, row, ids)."""
    part, seen, (atoms, code) = TaskContext.get().partitionId() << 33, 0, _encoder(v, frequent)
    for batch in (whole.slice(k, TEXTS) for whole in batches for k in range(0, whole.num_rows, TEXTS)):
        words, ends = cut(batch.column("text"), v)
        told = pc.dictionary_encode(words)
        names = told.dictionary.to_pylist()
        data: list[bytes] = []
        if names:
            own, cuts = atoms(names)
            found = code(own.dictionary.to_pylist())
            order = own.indices.to_pylist()
            data = [b"".join([found[k] for k in order[a:b]]) for a, b in pairwise(cuts.tolist())]
        # the ids of all words one after another, and where each text's end
        sizes = np.array([len(x) // 4 for x in data], np.int64)
        at = told.indices.to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(sizes[at])]) if len(at) else np.zeros(1, np.int64)
        taken = pa.array(data, pa.large_binary()).take(pa.array(at)).buffers()[2] if len(at) else None
        flat = np.frombuffer(taken, "<i4", int(total[-1])) if taken is not None else np.empty(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(total[ends].astype(np.int32)), pa.array(flat, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(part + seen + np.arange(batch.num_rows), pa.int64()), lists], ["doc_id", "row", "ids"])
        seen += batch.num_rows


def encode(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, row, ids: array<int>); ``row`` tells rows apart that share an id.

    Every different atom of a batch is encoded once, by the lattice; a worker remembers ``frequent`` atoms at most. Nothing
    is shuffled, however many words a corpus has.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: encoding(batches, v, frequent), f"doc_id {dict(rows.dtypes)['doc_id']}, row bigint, ids array<int>")


def decoding(batches: Batches, v: Vocabulary, ids_col: str, name: str = "text") -> Batches:
    """Batches with ids to the same with a text."""

    def raw(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes.fromhex(piece[3:5])
        return b"" if kind in (CONTROL, UNKNOWN) else piece.replace(SPACE, " ").encode()

    table = pa.array([raw(p, kind) for p, _, kind in v.pieces], pa.large_binary())
    for batch in batches:
        ids = batch.column(ids_col)
        ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(ids), 0).to_pylist()])
        taken = table.take(ids.flatten())
        at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[ends].tolist() if len(taken) else [0] * len(ends)
        data = taken.buffers()[2].to_pybytes() if len(taken) and taken.buffers()[2] is not None else b""
        texts = [data[a + (v.dummy_prefix and data[a : min(a + 1, b)] == b" ") : b].decode("utf-8", "replace") for a, b in pairwise(at)]
        made = pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])


def decode(encoded: DataFrame, v: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """All columns and ``text``: the pieces of the ids put together; bytes that are no UTF-8 become replacement characters."""
    kept = encoded.drop("text")
    return kept.mapInArrow(lambda batches: decoding(batches, v, ids_col), StructType([*kept.schema.fields, StructField("text", StringType())]))


def digesting(batches: Batches) -> Batches:
    """Batches with doc_id, ids and, perhaps, text to doc_id, n_tokens, ids_crc32 and text_sha256."""
    for batch in batches:
        data, ends = batch.column("ids").flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes(), 4 * np.cumsum([0, *pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_pylist()])
        crc = [zlib.crc32(data[a:b]) for a, b in pairwise(ends.tolist())]
        made = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(np.diff(ends) // 4, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
        if "text" in batch.schema.names:
            made["text_sha256"] = pa.array([None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in batch.column("text").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays(list(made.values()), list(made))


def _digests(rows: DataFrame, step: Callable[[Batches], Batches], text: bool) -> DataFrame:
    made = f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens bigint, ids_crc32 bigint" + ", text_sha256 string" * text
    with conf(rows.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(TEXTS)):
        return written(rows.mapInArrow(step, made), "id-digests")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), and the digest of the decoded text if there is one."""
    text = "text" in encoded.columns
    return _digests(encoded.select("doc_id", "ids", *["text"] * text), digesting, text)


def there_and_back(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """``digests`` of the decoded rows of ``encode``, batch by batch in one Python worker: ids and texts do not travel."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _digests(rows, lambda batches: digesting(decoding(encoding(batches, v, frequent), v, "ids")), True)
