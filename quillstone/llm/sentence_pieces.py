"""SentencePiece encoding by suffix-array matching, and decoding.

The distinct chunks of a batch of texts are laid end to end and indexed by a suffix array; every piece is
binary-searched for its range of occurrences, which gives all edges (place, length, piece) at once. Edges are sorted by
place and then relaxed: a byte-pair model joins, in each chunk, the two neighbours whose joint edge scores best, the
leftmost of equals, until no edge joins two neighbours.

A chunk is a run of spaces with the text up to the next space; as no piece has a space after another character, what is
joined in one chunk never depends on another.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts

_SPACE = "▁"
#: Chunks whose ids a task remembers, and chunks longer than this are joined with a heap.
CACHE = 400_000
LONG = 48
#: Characters of new chunks that are indexed together, and characters of texts that are encoded together.
TOGETHER, AT_ONCE = 1 << 21, 1 << 23


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``codes`` in the order of what follows, up to ``depth`` symbols, by prefix doubling."""
    if not len(codes):
        return np.zeros(0, np.int64)
    shift = codes - codes.min()
    there = np.zeros(int(shift.max()) + 1, np.int64)
    there[shift] = 1
    rank = (np.cumsum(there) - 1)[shift]
    # as many symbols at once as a number holds
    bits = int(rank.max() + 1).bit_length()
    width = max(min(63 // bits, depth), 1)
    key = np.zeros(len(codes), np.int64)
    for k in range(width):
        key <<= bits
        key[: len(codes) - k] |= rank[k:] + 1
    order = np.argsort(key)
    rank[order] = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
    while width < depth and len(codes):
        after = np.full(len(codes), -1, np.int64)
        after[:-width] = rank[width:]
        key = rank * (len(codes) + 2) + after + 1
        order = np.argsort(key)
        new = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
        rank[order] = new
        width *= 2
    return order


def occurrences(codes: np.ndarray, order: np.ndarray, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[low, high) in ``order`` of the places where each piece begins. pieces: a row of codes each, filled up with -1."""
    low, high = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(order), np.int64)
    live = np.arange(len(pieces))
    padded = np.concatenate((codes, np.full(pieces.shape[1] + 1, -1)))
    for t in range(pieces.shape[1]):
        live = live[(lengths[live] > t) & (low[live] < high[live])]
        if not len(live):
            break
        want = pieces[live, t]
        for side, bound in (("left", low), ("right", high)):
            a, b = low[live].copy() if side == "left" else bound_low, high[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                seen = padded[order[np.minimum(mid, len(order) - 1)] + t]
                right = seen < want if side == "left" else seen <= want
                a = np.where(open_ & right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            if side == "left":
                bound_low = a
            else:
                low[live], high[live] = bound_low, a
    return low, high


class Encoder:
    """Encodes and decodes with a byte-pair SentencePiece model."""

    def __init__(self, proto: bytes, cache: int = CACHE):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = m.get_piece_size()
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.unknown = m.unk_id()
        self.split = not any(re.search(f"[^{_SPACE}]{_SPACE}", self.pieces[i]) for i in plain)
        self.longest = max(len(self.pieces[i]) for i in plain)
        self.ids = np.array(plain)
        self.lengths = np.array([len(self.pieces[i]) for i in plain])
        self.codes = np.full((len(plain), self.longest), -1, np.int64)
        for k, i in enumerate(plain):
            self.codes[k, : self.lengths[k]] = [ord(c) for c in self.pieces[i]]
        score = np.array([m.get_score(i) for i in plain])
        self.rank = np.empty(len(plain), np.int64)  # the higher the better; equal scores are equal
        self.rank[:] = np.unique(score, return_inverse=True)[1]
        assert len(self.rank) < 1 << 17
        self.of = {self.pieces[i]: i for i in plain}
        raw = [bytes([b]) for b in range(256)]
        at = {i: b for b, i in self.byte_id.items()}
        self.bytes = [raw[at[i]] if i in at else b"" if m.is_control(i) else b" \xe2\x81\x87 " if m.is_unknown(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.cache = cache
        self.known: dict[str, bytes] = {}

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place * (longest + 1) + length, row of the piece) of every occurrence of every piece, sorted."""
        order = suffix_array(codes, self.longest)
        low, high = occurrences(codes, order, self.codes, self.lengths)
        n = high - low
        row = np.repeat(np.arange(len(n)), n)
        place = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        key = place * (self.longest + 1) + self.lengths[row]
        by = np.argsort(key)
        return key[by], row[by]

    def learn(self, chunks: list[str]) -> None:
        """Encodes new chunks together."""
        text = "\0".join(chunks) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.array([len(c) for c in chunks])
        first = np.cumsum(size + 1) - size - 1
        separator = first + size
        codes[separator] = -2  # no piece has it; a NUL within a chunk stays what it is
        key, row = self.edges(codes)
        width = self.longest + 1

        def joint(a, c):
            """Row of the edge from a to c, -1 for none."""
            want = np.where(c - a <= self.longest, a * width + (c - a), -1)
            at = np.minimum(np.searchsorted(key, want), len(key) - 1) if len(key) else np.zeros(len(want), np.int64)
            return np.where(key[at] == want, row[at], -1) if len(key) else np.full(len(want), -1)

        begin = np.delete(np.arange(len(codes)), separator)
        end = begin + 1
        chunk = np.repeat(np.arange(len(chunks)), size)
        slow = np.flatnonzero(size > LONG)
        done_b, done_e = [], []
        for k in slow.tolist():
            b, e = self.heap(int(first[k]), int(size[k]), key, row)
            done_b.append(b)
            done_e.append(e)
        live = ~np.isin(chunk, slow)
        begin, end, chunk = begin[live], end[live], chunk[live]
        # the edge that joins each symbol with the next, -1 for none
        link = np.full(len(begin), -1)
        pair = np.flatnonzero(chunk[1:] == chunk[:-1])
        link[pair] = joint(begin[pair], end[pair + 1])
        while len(begin):
            pair = np.flatnonzero(link >= 0)
            if not len(pair):
                break
            # of each chunk the pair of best rank, the leftmost of equals
            heads = np.flatnonzero(np.r_[True, chunk[pair[1:]] != chunk[pair[:-1]]])
            merge = np.minimum.reduceat((len(self.rank) - self.rank[link[pair]]) << 40 | pair, heads) & ((1 << 40) - 1)
            end[merge] = end[merge + 1]
            keep = np.zeros(len(chunks), bool)
            keep[chunk[merge]] = True
            keep = keep[chunk]
            done_b.append(begin[~keep])
            done_e.append(end[~keep])
            keep[merge + 1] = False
            at = (np.cumsum(keep) - 1)[merge]
            begin, end, chunk, link = begin[keep], end[keep], chunk[keep], link[keep]
            for p in (at, at[at > 0] - 1):  # what lies beside a merge has another edge now
                there = p[p + 1 < len(begin)]
                there = there[chunk[there] == chunk[there + 1]]
                link[p[chunk[p] == chunk[np.minimum(p + 1, len(begin) - 1)]]] = -1
                link[there] = joint(begin[there], end[there + 1])
            last = at[(at + 1 == len(begin)) | (chunk[np.minimum(at + 1, len(begin) - 1)] != chunk[at])]
            link[last] = -1
        begin = np.concatenate((*done_b, begin)).astype(np.int64)
        end = np.concatenate((*done_e, end)).astype(np.int64)
        by = np.argsort(begin)
        begin, end = begin[by], end[by]
        edge = joint(begin, end)
        raw = np.where(edge >= 0, self.ids[edge], 0).astype("<u4").tobytes()
        cuts = np.searchsorted(begin, np.r_[first, len(codes)]).tolist()
        self.known.update((c, raw[4 * i : 4 * j]) for c, i, j in zip(chunks, cuts, cuts[1:], strict=False))
        # characters that no piece has: their bytes
        for k in np.unique(np.searchsorted(first, begin[edge < 0], "right") - 1).tolist():
            full = []
            for at in range(cuts[k], cuts[k + 1]):
                if edge[at] >= 0:
                    full.append(self.ids[edge[at]])
                elif self.byte_id:
                    full += [self.byte_id[b] for b in text[begin[at] : end[at]].encode("utf-8", "replace")]
                else:
                    full.append(self.unknown)
            self.known[chunks[k]] = np.array(full, "<u4").tobytes()

    def heap(self, first: int, size: int, key: np.ndarray, row: np.ndarray) -> tuple[list[int], list[int]]:
        """The same for one long chunk."""
        i, j = np.searchsorted(key, [first * (self.longest + 1), (first + size) * (self.longest + 1)])
        rank = dict(zip(key[i:j].tolist(), self.rank[row[i:j]].tolist(), strict=True))
        width, last = self.longest + 1, first + size
        after = {p: p + 1 for p in range(first, last)}
        before = {p: p - 1 for p in range(first + 1, last)}
        queue: list[tuple[int, int, int]] = []

        def offer(p: int) -> None:
            q = after.get(p, last)
            if q < last and (c := after[q]) - p < width and (r := rank.get(p * width + c - p)) is not None:
                heapq.heappush(queue, (-r, p, c))

        for p in range(first, last):
            offer(p)
        while queue:
            _, p, c = heapq.heappop(queue)
            q = after.get(p)
            if q is None or q >= last or after.get(q) != c:
                continue
            after[p] = c
            del after[q]
            before.pop(q, None)
            if c < last:
                before[c] = p
            offer(p)
            if p in before:
                offer(before[p])
        places = sorted(after)
        return places, [after[p] for p in places]

    def chunks(self, normalised: str) -> list[str]:
        return re.findall(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+$", normalised) if self.split else [normalised] if normalised else []

    def encode(self, docs: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.cache:
            self.known = {}
        split = [self.chunks(self.model.normalize(d)) for d in docs]
        new = list(dict.fromkeys(c for s in split for c in s if c not in self.known))
        # together, as every call looks for every piece; memory is bounded by the characters of a call
        size = np.cumsum([len(c) + 1 for c in new]) // TOGETHER
        for group in np.split(np.array(new, object), np.flatnonzero(np.diff(size)) + 1) if new else ():
            self.learn(group.tolist())
        return [np.frombuffer(b"".join([self.known[c] for c in s]), "<u4") for s in split]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; without the space that encoding puts first."""
        raw = b"".join([self.bytes[i] for i in ids.tolist()])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, proto: bytes, ids: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids), round_trip; with ``ids``, the ids too.

    Whole texts (null: empty) are encoded and decoded again; round_trip says whether the text came back. Equal rows give
    equal results; an empty text has no ids.
    """
    held = docs.sparkSession.sparkContext.broadcast(proto)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        encoder = Encoder(held.value)

        def step(b):
            data = [t.decode() for t in texts(b.column("text"))]
            size = np.cumsum([len(d) for d in data]) // AT_ONCE
            edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(data)]
            found = [f for i, j in zip(edges, edges[1:], strict=False) for f in encoder.encode(data[i:j])]
            out = {"doc_id": b.column("doc_id"), "n_ids": [len(f) for f in found], "ids_crc32": [zlib.crc32(f.tobytes()) for f in found]}
            out["round_trip"] = [encoder.decode(f) == d for f, d in zip(found, data, strict=True)]
            return out | ({"ids": [f.astype(np.int32) for f in found]} if ids else {})

        return step

    schema = f"doc_id {kind}, n_ids long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * ids
    return arrow_map(docs.select("doc_id", "text"), make, schema, rows=8192)


def decode_documents(encoded: DataFrame, proto: bytes) -> DataFrame:
    """doc_id and text of rows with ids; null ids give null."""
    held = encoded.sparkSession.sparkContext.broadcast(proto)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def make():
        encoder = Encoder(held.value)
        return lambda b: {"doc_id": b.column("doc_id"), "text": [None if i is None else encoder.decode(np.array(i, np.int64)) for i in b.column("ids").to_pylist()]}

    return arrow_map(encoded.select("doc_id", F.col("ids")), make, f"doc_id {kind}, text string")
