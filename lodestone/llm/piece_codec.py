"""SentencePiece encoding and decoding by suffix-array matching.

The distinct units of a batch (a run of spaces with the characters up to the next) are joined to one text, its
suffixes are sorted, and every piece of the vocabulary is searched for in them by binary search: the range found
holds the piece's occurrences. These are the edges of a lattice, sorted by where they end, and relaxed from left to
right, all units at a time.

The vocabulary's scores are merge ranks. A sequence of pieces is the merge result if and only if each two neighbours
are that of their own joint text, and each prefix has one such sequence. So an edge relaxes its end if it and the
piece that ends where it starts are compatible; which pairs are is computed once for each pair, from the merges that
make each of the two: a pair is not if its inner neighbours merge at any moment. Characters that no piece has are edges
of their own and become the pieces of their bytes.

Texts are cut into units, and units put together to texts, as Arrow columns; Python handles distinct units alone.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"
#: Characters of units whose suffixes are sorted at once; a longer unit is taken alone.
BLOCK = 400_000
#: Bytes of text whose units are looked up together.
GROUP = 3_000_000
#: Pairs of pieces that a worker remembers, in a table of so many bits.
PAIRS, SLOT_BITS = 1_000_000, 21
#: Units whose encoding a worker remembers, and their length at most.
MEMO, MEMO_CHARS = 300_000, 64
#: The order of a merge that there is not.
NONE = 1 << 40
DEFAULT_MODEL = "piece_bpe_32k.model"


def model_path(name: str = DEFAULT_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """Encodes as the model at path does (merge model with byte fallback, identity normalisation, leading space)."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        self.byte_id, self.bytes_of, self.rank = {}, [], {}
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[3:-1], 16)] = i
                self.bytes_of.append(bytes([int(p[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b" \xe2\x81\x87 " if sp.is_unknown(i) else b"")
            else:
                self.bytes_of.append(p.replace(SPACE, " ").encode())
                self.rank[p] = (sp.get_score(i), i)
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank):
            raise ValueError("the model has pieces that cross a word's end")
        order = sorted(self.rank)
        self.texts = order
        self.ids = np.array([self.rank[p][1] for p in order])
        self.index = {p: k for k, p in enumerate(order)}
        self.texts_of = pa.array(self.bytes_of, pa.large_binary())
        self.longest = max(map(len, order))
        self.lengths = np.array([len(p) for p in order])
        self.matrix = np.zeros((len(order), self.longest), np.uint32)
        for k, p in enumerate(order):
            self.matrix[k, : len(p)] = np.frombuffer(p.encode("utf-32-le"), np.uint32)
        self.chars = {c for p in order for c in p}
        self.alone = set(self.matrix[self.lengths == 1, 0].tolist())
        self.newline_ends = "\n" not in self.chars
        self.memo: dict[str, bytes] = {}
        self.pair_keys, self.pair_fits, self.pairs = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, bool), 0
        self.prepare_pairs()

    # -- pairs of pieces

    def merges(self, text: str) -> list[tuple[int, int, int]]:
        """The merges of a short text, by definition: the best-ranked adjacent pair first, the leftmost on a tie. For each
        moment: the first piece, the last one, the order of the merge that follows (NONE after the last)."""
        s, out = list(text), []
        while True:
            best, at = NONE, -1
            for i in range(len(s) - 1):
                r = self.order.get(s[i] + s[i + 1], NONE)
                if r < best:
                    best, at = r, i
            out.append((self.number(s[0]), self.number(s[-1]), best))
            if best == NONE:
                return out
            s[at : at + 2] = [s[at] + s[at + 1]]

    def number(self, piece: str) -> int:
        k = self.index.get(piece)
        return len(self.texts) + ord(piece) if k is None else k

    def prepare_pairs(self) -> None:
        """What told() needs: the merges of each piece one after another, and the order of each pair that merges."""
        score = np.array([self.rank[p][0] for p in self.texts])
        self.order = dict(zip(self.texts, np.unique(-score, return_inverse=True)[1].tolist(), strict=True))
        moments, self.first_moment, self.whole = [], [], []
        for k, p in enumerate(self.texts):
            self.first_moment.append(len(moments))
            moments += self.merges(p)
            self.whole.append(moments[-1][:2] == (k, k))
        self.first_moment.append(len(moments))  # the one moment of a character that is no piece
        moments.append((-1, -1, NONE))
        self.first_moment, self.whole = np.array(self.first_moment), np.array([*self.whole, True])
        self.first_piece, self.last_piece, self.next_merge = np.array(moments, np.int64).T.copy()
        joins = {}
        for p in self.texts:
            for i in range(1, len(p)):
                if (i == 1 or p[:i] in self.index) and (i == len(p) - 1 or p[i:] in self.index):
                    joins[self.number(p[:i]) << 24 | self.number(p[i:])] = self.order[p]
        self.join_keys = np.array(sorted(joins), np.int64)
        self.join_order = np.array([joins[k] for k in self.join_keys.tolist()], np.int64)

    def told(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """fits() for pairs not met before. Both pieces are made by their own merges, in the order in which the joint
        text would have them, and the two pieces at the border are looked up at each moment."""
        v = len(self.texts)
        a, b = np.minimum(left, v), np.minimum(right, v)
        out = self.whole[b] & ((left < 0) | self.whole[a])
        rows = np.flatnonzero(out & (left >= 0))
        i, j = self.first_moment[a[rows]], self.first_moment[b[rows]]
        while len(rows):
            inner = self.last_piece[i], self.first_piece[j]
            inner = [np.where(x < 0, whole[rows], x) for x, whole in zip(inner, (left, right), strict=True)]
            key = inner[0] << 24 | inner[1]
            at = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
            across = np.where(self.join_keys[at] == key, self.join_order[at], NONE)
            before, behind = self.next_merge[i], self.next_merge[j]
            lost = (across < before) & (across <= behind)  # on a tie the leftmost comes first
            out[rows[lost]] = False
            go = ~lost & (np.minimum(before, behind) < NONE)
            step = (before <= behind)[go]
            rows, i, j = rows[go], i[go] + step, j[go] + ~step
        return out

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pieces left and right are the merge result of their joint text; left -1: the start of a unit."""
        keys = (left + 1) * np.int64(1 << 24) + right
        at, known = self._find(keys)
        if not known.all():
            new = np.unique(keys[~known])
            if self.pairs + len(new) > PAIRS:
                self.pair_keys[:], self.pairs = -1, 0
                new = np.unique(keys)
                if len(new) > PAIRS:  # more than the table takes
                    half = len(keys) // 2
                    return np.concatenate([self.fits(left[:half], right[:half]), self.fits(left[half:], right[half:])])
            self._put(new, self.told((new >> 24) - 1, new & 0xFFFFFF))
            at, known = self._find(keys)
        return self.pair_fits[at]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of keys in a table with open addresses, and whether they are there."""
        at = self._slot(keys)
        held = self.pair_keys[at]
        known = held == keys
        todo = np.flatnonzero(~known & (held >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << SLOT_BITS) - 1)
            held = self.pair_keys[at[todo]]
            known[todo] = held == keys[todo]
            todo = todo[(held >= 0) & (held != keys[todo])]
        return at, known

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.pair_keys[at[todo]] < 0]
            self.pair_keys[at[free]] = keys[free]  # of several with one slot the last has it
            todo = todo[self.pair_keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & ((1 << SLOT_BITS) - 1)
        self.pair_fits[at] = values
        self.pairs += len(keys)

    # -- the suffix array of a block of units

    def suffixes(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
        """Starts of c's suffixes, sorted by their first `longest` characters at least (prefix doubling), and the sorted
        keys of their first few characters: (starts, keys, c's alphabet, characters in a key, bits of each)."""
        n = len(c)
        values, rank = np.unique(c, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        bits = int(len(values) + 1).bit_length()
        first = max(1, 62 // bits)
        key = np.zeros(n, np.int64)
        for k in range(first):
            key <<= bits
            key[: max(0, n - k)] |= rank[k:]
        done = first
        order = np.argsort(key)
        keys = key[order]
        ranked = keys
        while done < self.longest:
            step = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            if step[-1] == n - 1:
                break
            rank = np.empty(n, np.int64)
            rank[order] = step + 1
            key = rank << 31
            key[: max(0, n - done)] |= rank[done:]
            # Only suffixes that still tie change places, among themselves.
            tied = np.concatenate([ranked[1:] == ranked[:-1], [False]])
            tied[1:] |= tied[:-1].copy()
            at = np.flatnonzero(tied)
            order[at] = order[at][np.argsort(key[order[at]])]
            ranked = key[order]
            done *= 2
        return order, keys, values, first, bits

    def ranges(self, c: np.ndarray, sa: np.ndarray, keys: np.ndarray, values: np.ndarray, first: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """For each piece, the range of sa whose suffixes start with it; by binary search, all pieces at a time: first
        over the keys, then, for longer pieces, over the suffixes within the key's range."""
        m = self.longest
        code = np.searchsorted(values, self.matrix)
        code[code == len(values)] = 0
        inside = np.arange(m)[None, :] < self.lengths[:, None]
        known = ((values[code] == self.matrix) | ~inside).all(1)
        code = np.where(inside, code + 1, 0)
        low = np.zeros(len(self.texts), np.int64)
        for k in range(first):
            low = (low << bits) | (code[:, k] if k < m else 0)
        free = bits * np.maximum(0, first - self.lengths)
        lo, hi = np.searchsorted(keys, low), np.searchsorted(keys, low + (np.int64(1) << free))
        lo, hi = np.where(known, lo, 0), np.where(known, hi, 0)
        long_ = np.flatnonzero((self.lengths > first) & (hi > lo))
        padded = np.concatenate([c, np.zeros(m, np.uint32)])
        bounds = []
        for upper in (False, True):
            a, b = lo[long_], hi[long_]
            while len(rows := np.flatnonzero(a < b)):
                mid = (a[rows] + b[rows]) >> 1
                t = padded[sa[mid][:, None] + np.arange(m)]
                q = self.matrix[long_[rows]]
                differs = (t != q) & inside[long_[rows]]
                at = differs.argmax(1)
                some = differs[np.arange(len(rows)), at]
                less = some & (t[np.arange(len(rows)), at] < q[np.arange(len(rows)), at])
                right = less | (~some if upper else False)
                a[rows], b[rows] = np.where(right, mid + 1, a[rows]), np.where(right, b[rows], mid)
            bounds.append(a)
        lo[long_], hi[long_] = bounds
        return lo, hi

    def encode_units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit, as little-endian uint32."""
        out: list[bytes] = []
        block, size = [], 0
        for u in units:
            if block and size + len(u) + 1 > BLOCK:
                out += self._encode_block(block)
                block, size = [], 0
            block.append(u)
            size += len(u) + 1
        return out + (self._encode_block(block) if block else [])

    def _encode_block(self, units: list[str]) -> list[bytes]:
        c = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(u) + 1 for u in units])
        starts = ends - np.array([len(u) + 1 for u in units])
        n = len(c)
        sa, *key = self.suffixes(c)
        lo, hi = self.ranges(c, sa, *key)
        found = np.flatnonzero(hi > lo)
        reps = (hi - lo)[found]
        piece = np.repeat(found, reps)
        offset = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        start = sa[np.repeat(lo[found], reps) + offset] if len(found) else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(units)), ends - starts)
        odd = np.ones(n, bool)
        odd[ends - 1] = False  # what ends a unit
        odd[start[self.lengths[piece] == 1]] = False
        odd = np.flatnonzero(odd)
        piece = np.concatenate([piece, len(self.texts) + c[odd].astype(np.int64)])
        start = np.concatenate([start, odd])
        stop = start + np.concatenate([self.lengths[piece[: len(piece) - len(odd)]], np.ones(len(odd), np.int64)])
        inside = stop <= ends[owner[start]] - 1
        piece, start, stop = piece[inside], start[inside], stop[inside]
        place = stop - starts[owner[start]]  # sorted by where they end, counted from their unit's start
        order = np.argsort(place.astype(np.uint16) if len(place) and place.max() < 1 << 16 else place, kind="stable")
        piece, start, stop, place = piece[order], start[order], stop[order], place[order]
        last = np.full(n + 1, -2, np.int64)
        last[starts] = -1
        came = np.zeros(n + 1, np.int64)
        cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.empty(0, np.int64)
        for a, b in zip(cut, [*cut[1:], len(place)], strict=True):
            left = last[start[a:b]]
            good = left != -2
            s, e, p = start[a:b][good], stop[a:b][good], piece[a:b][good]
            ok = self.fits(left[good], p)
            last[e[ok]] = p[ok]
            came[e[ok]] = s[ok]
        # Back from every unit's end at once; a step further back comes earlier in its unit.
        unit, at, steps = np.arange(len(units)), ends - 1, []
        while len(unit := unit[more := at > starts[unit]]):
            at = at[more]
            steps.append((unit, last[at]))
            at = came[at]
        if not steps:
            return [b""] * len(units)
        owner = np.concatenate([u for u, _ in reversed(steps)])
        piece = np.concatenate([p for _, p in reversed(steps)])
        order = np.argsort(owner * np.int64(len(owner)) + np.arange(len(owner)))
        owner, piece = owner[order], piece[order]
        odd = piece >= len(self.texts)
        if odd.any():
            raw = [chr(p - len(self.texts)).encode("utf-8", "surrogatepass") for p in piece[odd].tolist()]
            reps = np.ones(len(piece), np.int64)
            reps[odd] = [len(x) for x in raw]
            ids = np.repeat(self.ids[np.where(odd, 0, piece)], reps)
            ids[np.repeat(odd, reps)] = [self.byte_id[x] for r in raw for x in r]
            owner = np.repeat(owner, reps)
        else:
            ids = self.ids[piece]
        whole = ids.astype("<u4").tobytes()
        cut = (4 * np.searchsorted(owner, np.arange(len(units) + 1))).tolist()
        return [whole[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    # -- texts

    def units(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The units of all texts in turn, with spaces as spaces, and where each text's begin (one more: their end)."""
        none, lead = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), none), SPACE, " ")
        texts = pc.if_else(pc.equal(texts, none), none, pc.binary_join_element_wise(lead, texts, none))
        _, places, data = texts.buffers()
        places = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        c = np.frombuffer(data or b"", np.uint8)[: places[-1]]
        begins = np.zeros(len(c) + 1, bool)
        begins[places] = True  # that of an empty text is the next one's, or the end
        space = c == 32
        begins[1:-1] |= space[1:] & ~space[:-1]
        if self.newline_ends:
            newline = c == 10
            begins[:-1] |= newline
            begins[1:] |= newline
        begins[0] = begins[-1] = True
        begins = np.flatnonzero(begins)
        whole = pa.Array.from_buffers(pa.large_string(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(c)])
        return whole.dictionary_encode(), np.searchsorted(begins, places)

    def encode_batch(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text, as little-endian uint32; null and empty texts have none."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        out: list[bytes] = []
        since, size = 0, 0
        for k, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 1):
            size += n
            if size >= GROUP or k == len(texts):
                out += self._encode_group(texts.slice(since, k - since))
                since, size = k, 0
        return out

    def _encode_group(self, texts: pa.Array) -> list[bytes]:
        units, places = self.units(texts)
        if not len(units):
            return [b""] * len(texts)
        names = pc.replace_substring(units.dictionary, " ", SPACE).to_numpy(zero_copy_only=False).tolist()
        memo = self.memo
        held = list(map(memo.get, names))
        at = [k for k, x in enumerate(held) if x is None]
        new = [names[k] for k in at]
        for k, u, x in zip(at, new, self.encode_units(new), strict=True):
            held[k] = memo[u] = x
        coded = pa.array(held, pa.large_binary()).take(units.indices)
        if len(memo) > MEMO:  # what this text has is kept, the rest is encoded again if it comes back
            self.memo = {u: memo[u] for u in names if len(u) <= MEMO_CHARS}
        else:
            for u in new:
                if len(u) > MEMO_CHARS:
                    del memo[u]
        return cut(coded, places)

    def decode_batch(self, coded: list[bytes]) -> list[str]:
        ids = np.frombuffer(b"".join(coded), "<u4")
        places = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded], dtype=np.int64)])
        texts = (raw.decode("utf-8", "replace") for raw in cut(self.texts_of.take(pa.array(ids)), places))
        return [t[1:] if t[:1] == " " else t for t in texts]


def cut(column: pa.Array, places: np.ndarray) -> list[bytes]:
    """The bytes of a binary column from each place to the next, joined."""
    if not len(column):
        return [b""] * (len(places) - 1)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1][places].tolist()
    data = memoryview(data or b"")
    return [bytes(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """A row for each row of docs: doc_id, ids (array of int, unless ids is false), n_tokens, ids_sha256, decoded_sha256, round_trip.

    ids_sha256 is of the ids as little-endian unsigned 32-bit numbers, decoded_sha256 of the decoded text in UTF-8.
    round_trip: decoding gives the text (null as empty) again. The one character that doesn't survive is U+2581, which
    decodes as a space. A null or empty text has no tokens. A text of any length is encoded whole, unit by unit. Each
    row gets its row, whether its id or text is repeated or its id is null. Other columns, whatever their names, are not
    read. An empty table gives no rows.
    """
    path = path or model_path()
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * ids

    def run(batches):
        c = codec(path)
        try:
            for batch in batches:
                for s in range(0, batch.num_rows, 1024):
                    yield encoded(c, batch.slice(s, 1024))
        finally:  # a worker lives on: it keeps the vocabulary and the pairs, which are bounded, and nothing of the texts
            c.memo = {}
            pa.default_memory_pool().release_unused()

    def encoded(c: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        part = batch.column("text").to_pylist()
        coded = c.encode_batch(batch.column("text"))
        back = c.decode_batch(coded)
        cols = {
            "doc_id": batch.column("doc_id"),
            "n_tokens": pa.array([len(x) // 4 for x in coded], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in back], pa.string()),
            "round_trip": pa.array([x == (t or "") for x, t in zip(back, part, strict=True)], pa.bool_()),
        }
        if ids:
            places = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]).astype(np.int32)
            cols["ids"] = pa.ListArray.from_arrays(pa.array(places), pa.array(np.frombuffer(b"".join(coded), "<i4")))
        return pa.RecordBatch.from_pydict(cols)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, kind)


def decode(coded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows with ids. Null ids give a null text; bytes that are no UTF-8 give U+FFFD."""
    path = path or model_path()

    def run(batches):
        c = codec(path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            texts = c.decode_batch([np.array(x or [], "<u4").tobytes() for x in ids])
            texts = [None if x is None else t for x, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def op1_sentencepiece(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), ids=False)
