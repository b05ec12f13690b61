"""Token ids of whole texts by the tokenizers library, with a memory of words.

Both vocabularies used here cut a text at spaces before anything else, so the ids of a text are those of its
space-separated parts, one after another. A worker keeps the parts it has seen; only new ones reach the library, many
at a time. Where a text has white space in a form that is cut otherwise, the whole text goes to the library.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import filterfalse, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space: what either the library or Python takes for it.
WHITE = frozenset("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
#: The longest part that is kept, and the longest that outlives a full memory.
KEPT_LENGTH, OFTEN = 48, 8
#: New parts that go to the library in one call.
AT_ONCE = 20_000
#: Texts whose ids are put together at once.
GATHER = 500


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, in bytes.

    spaced: whether a part keeps the space before it (byte-level vocabularies) or drops white space (vocabularies with
    word ends).
    """

    def __init__(self, path: str, spaced: bool, kept: int):
        """kept: parts remembered at most (some 200 bytes each), of which the newer third is forgotten first if it comes but once."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced, self.kept = Tokenizer.from_file(path), spaced, kept
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.edged: set[str] = set()  # known parts that are empty or have white space at an end

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def may_hold_special(self, text: str) -> bool:
        """Whether a special token's string is in a text, in any case. What is not in texts put together is in none of them."""
        low = text.lower()
        return any(m.lower() in low for m in self.special)

    def learn(self, parts: list[str]) -> None:
        """Encode parts, many as one text with a mark in between that is one token. With spaces, parts may hold the mark (a line's end) themselves."""
        mark, between = ("\n", "\n ") if self.spaced else ("~", " ~ ")
        if self.may_hold_special(between.join(parts)):
            texts = [p for p in parts if self.may_hold_special(p)]
            self.learn_alone(texts)
            texts = set(texts)
            parts = [p for p in parts if p not in texts]
        clear = lambda p: bool(p) and p[0] not in WHITE and p[-1] not in WHITE
        if self.spaced:  # no white space is printable but the space, which no part has
            plain = [p for p in parts if (p.isprintable() and p) or all(map(clear, p.split(mark)))]
        else:
            plain = [p for p in parts if mark not in p and ((p.isprintable() and p) or clear(p))]
        sign = int(np.frombuffer(self.whole(mark), "<u4")[0])
        for i in range(0, len(plain), AT_ONCE):
            some = plain[i : i + AT_ONCE]
            (out,) = self.tokenizer.encode_batch_fast([(" " if self.spaced else "") + between.join(some)], add_special_tokens=False)
            ids, own = np.array(out.ids, "<u4"), np.array([p.count(mark) for p in some])
            at, last = np.flatnonzero(ids == sign), np.cumsum(own + 1) - 1
            if len(at) != last[-1]:
                self.learn_alone(some)
                continue
            data, ends = ids.tobytes(), 4 * at[last[:-1]]
            self.recent.update(zip(some, map(data.__getitem__, map(slice, [0, *(ends + 4).tolist()], [*ends.tolist(), len(data)])), strict=True))
        if len(plain) < len(parts):
            plain = set(plain)
            self.learn_alone([p for p in parts if p not in plain])

    def learn_alone(self, parts: list[str]) -> None:
        for part, data in zip(parts, map(self.whole, [" " + p for p in parts] if self.spaced else parts), strict=True):
            self.recent[part] = data
            if self.spaced and (not part or part[0] in WHITE or part[-1] in WHITE):
                self.edged.add(part)

    def joined(self, first: bool, parts: list[str]) -> bool:
        """Whether parts can be encoded one by one: no run of white space goes over a space between two of them."""
        if self.edged.isdisjoint(parts):
            return True
        ends = False
        for i, p in enumerate(parts):
            if (not p and (i or not first)) or (ends and p[0] in WHITE):
                return False
            ends = bool(p) and p[-1] in WHITE
        return True

    def forget(self) -> None:
        """Keep the memory within its bound: short parts, which come often, stay."""
        if len(self.known) > self.kept * 2 // 3:
            self.known = {p: x for p, x in self.known.items() if len(p) <= OFTEN}
            if len(self.known) > self.kept // 3:
                self.known = {}
        if len(self.recent) > self.kept // 3:
            self.recent = {}
            self.edged.intersection_update(self.known)
        if len(self.heads) > self.kept // 10:
            self.heads = {}

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null counts as empty.

        Parts are told apart by Arrow; Python sees each different part of the call once, and numpy puts the ids together.
        """
        self.forget()
        plain = pc.fill_null(texts.cast(pa.large_string()), "")
        cut = pc.split_pattern(plain if self.spaced else pc.replace_substring(plain, "\n", " "), " ")
        starts = cut.offsets.to_numpy()
        words = pc.dictionary_encode(cut.flatten())
        at, parts = words.indices.to_numpy(zero_copy_only=False).astype(np.int32), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        starts = starts - starts[0] if len(starts) else starts
        first = starts[:-1]
        if self.spaced:  # the first part of a text has no space before it
            heads = pc.dictionary_encode(cut.flatten().take(pa.array(first)))
            at[first] = heads.indices.to_numpy(zero_copy_only=False) + len(parts)
            heads = heads.dictionary.to_numpy(zero_copy_only=False).tolist()
            for h in heads:
                if h not in self.heads:
                    self.heads[h] = self.whole(h) if h else b""
        missing = list(filterfalse(self.known.__contains__, parts))
        for p in missing:
            if p in self.recent:
                self.known[p] = self.recent.pop(p)
        new = list(filterfalse(self.known.__contains__, missing))
        self.learn(new)
        data = list(map(self.known.get, parts))
        for k, x in enumerate(data):
            if x is None:
                data[k] = self.recent[parts[k]]
        if self.spaced:
            data += [self.heads[h] for h in heads]
        table = pa.array(data, pa.large_binary())
        odd = np.zeros(len(first), bool)
        if self.spaced and (found := self.edged.intersection(parts)):
            edged = np.fromiter(map(found.__contains__, parts), bool, len(parts))
            edged = np.concatenate([edged, np.fromiter((not h or h[-1] in WHITE for h in heads), bool, len(heads))])
            odd = np.logical_or.reduceat(edged[at], first) if len(first) else odd
        out: list[bytes] = []
        for k in range(0, len(first), GATHER):
            edges = starts[k : k + GATHER + 1]
            ids = table.take(pa.array(at[edges[0] : edges[-1]]))
            own, ends = ids.buffers()[2], np.frombuffer(ids.buffers()[1], np.int64)[edges - edges[0]].tolist()
            own = own.to_pybytes() if own is not None else b""
            out += [own[x:y] for x, y in pairwise(ends)]
        special = np.zeros(len(first), bool)
        for m in self.special:  # its string in a text is a token of its own: such texts go whole
            special |= pc.match_substring(plain, m, ignore_case=True).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(special):
            out[k] = self.whole(plain[int(k)].as_py())
        for k in np.flatnonzero(odd & ~special):
            text = plain[int(k)].as_py()
            head, *rest = text.split(" ")
            if not self.joined(True, rest) or (head and rest and head[-1] in WHITE and rest[0][:1] and rest[0][0] in WHITE):
                out[k] = self.whole(text)
        for p in new:
            if len(p) > KEPT_LENGTH and p in self.recent:
                del self.recent[p]
        return out


#: Parts that a worker remembers unless it is told otherwise: some 250 MB.
KEPT_PARTS = 1_200_000
_encoders: dict[tuple[str, bool, int], Encoder] = {}


def encoder(path: str, spaced: bool, kept: int = KEPT_PARTS) -> Encoder:
    """One for each worker process."""
    if (path, spaced, kept) not in _encoders:
        _encoders[path, spaced, kept] = Encoder(path, spaced, kept)
    return _encoders[path, spaced, kept]


def release() -> None:
    """Give back what this worker remembers; for operators that run after one that encodes."""
    _encoders.clear()


def batches(rows: Iterator[pa.RecordBatch], size: int = 8 << 20) -> Iterator[tuple[list[int | None], pa.Array]]:
    """(ids, texts) of about ``size`` bytes of text from batches of (id, text)."""
    ids, held, n = [], [], 0
    for batch in rows:
        ids += batch.column(0).to_pylist()
        held.append(batch.column(1).cast(pa.large_string()))
        n += held[-1].nbytes
        if n >= size:
            yield ids, pa.concat_arrays(held)
            ids, held, n = [], [], 0
            pa.default_memory_pool().release_unused()
    if ids:
        yield ids, pa.concat_arrays(held)
