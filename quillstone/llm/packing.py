"""Best-fit packing of token sequences by linear grouping.

Lengths are integers up to the capacity, so a histogram of lengths (bounded by the capacity) says all a plan
needs. The plan is made from it on the driver; the rows stay distributed and find their place by their rank
among the pieces of their length. Steps of the plan:

1. large lengths (over ``small``) are sorted and cut into groups of equal cardinality; each length counts as the
   largest of its group, so there are only ``groups`` sizes,
2. configurations of these sizes are optimised: the cutting-stock linear programme by column generation, rounded down,
   then first fit for what rounding left,
3. actual pieces take the places of their group, largest first, which frees the space that rounding up had taken,
4. small pieces go, largest first, to the open sequence that they fit best, with actual lengths throughout.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, cut, texts

CAPACITY = 2048
GROUPS = 256
#: Distinct chunks of text whose ids a task remembers.
CACHE = 600_000
#: Pieces of one length and bucket that are ranked together, on average at most.
BUCKET_ROWS = 20_000

_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Chunks of printable ASCII and Latin letters only, where lower case and word classes are beyond doubt.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ňŊ-ž]*")
_CONTROL = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]")


class ChunkEncoder:
    """Token ids of whole texts by the ``tokenizers`` library, remembered by chunk.

    White space never lies within a token of this vocabulary, so the ids of a text are those of its chunks between
    white space. Chunks of plain letters go to the library's model word by word; any other chunk goes through the
    library's whole chain. The memory is dropped when it holds ``cache`` chunks.
    """

    def __init__(self, spec: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        self.bytes = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.cache = cache
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.words: dict[str, bytes] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def chunk(self, raw: bytes, plain: bool) -> bytes:
        """The ids of a chunk, four bytes each."""
        text = raw.decode()
        if not plain and not _PLAIN.fullmatch(text) or "<|" in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out = b""
        for w in _WORDS.findall(text.lower()):
            ids = self.words.get(w)
            if ids is None:
                ids = self.words[w] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.bytes))])
            out += ids
        return out

    def encode(self, docs: list[bytes]) -> list[np.ndarray]:
        if len(self.known) > self.cache:
            self.reset()
        split = [d.split() for d in docs]
        known = self.known
        new: dict[bytes, bool] = {}
        for doc, chunks in zip(docs, split, strict=True):
            if fresh := [c for c in chunks if c not in known]:
                plain = doc.isascii() and not _CONTROL.search(doc)
                for raw in fresh:
                    new.setdefault(raw, plain)
        if new:
            got = [self.chunk(raw, plain) for raw, plain in new.items()]
            self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(got), "<u4")))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) // 4)))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        return [self.gather(np.fromiter(map(known.__getitem__, c), np.int64, len(c))) for c in split]

    def gather(self, chunks: np.ndarray) -> np.ndarray:
        first, size = self.starts[chunks], self.starts[chunks + 1] - self.starts[chunks]
        before = np.cumsum(size) - size
        return self.ids[np.repeat(first - before, size) + np.arange(int(size.sum()))]


def token_pieces(docs: DataFrame, spec: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and spread of each piece of at most ``capacity`` ids.

    A document is the ids of its whole text and then ``end_id``; null and empty texts are that id alone.
    ``spec`` is the tokenizer's JSON. ``spread`` deals equal rows over the buckets of :func:`pack`.
    """
    held = docs.sparkSession.sparkContext.broadcast(spec)

    def make():
        encoder = ChunkEncoder(held.value)
        seen = 0

        def step(b):
            nonlocal seen
            out = defaultdict(list)
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode(texts(b.column(1))), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    seen += 1
                    for name, v in (("doc_id", doc), ("piece", k), ("start", at), ("length", len(part)), ("ids_crc32", zlib.crc32(part.tobytes())), ("spread", seen)):
                        out[name].append(v)
            return out or None

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, spread long")


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Columns (configurations of sizes) and their amounts: the cutting-stock programme's optimum by column generation."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    amount = demand / basis.diagonal()
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        best, better = np.zeros(capacity + 1), []
        for j, size in enumerate(sizes):  # the configuration worth most at these prices, a copy of a size at a time
            for _ in range(capacity // size):
                worth = best[:-size] + price[j]
                more = worth > best[size:] + 1e-12
                if not more.any():
                    break
                best[size:] = np.where(more, worth, best[size:])
                better.append((j, more))
        if best[capacity] <= 1 + 1e-4:
            break
        column, s = np.zeros(k), capacity
        for j, more in reversed(better):
            if s >= sizes[j] and more[s - sizes[j]]:
                column[j] += 1
                s -= sizes[j]
        direction = np.linalg.solve(basis, column)
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.where(up, amount / np.where(up, direction, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amount = np.maximum(amount - step * direction, 0)
        amount[out] = step
        basis[:, out] = column
    return basis.T.astype(np.int64), amount


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, pieces, first sequence, offset): piece number r of that length, from the first rank on,
    goes to sequence first + (r - first rank) at that offset. Depends on the histogram alone."""
    small = capacity // 8 if small is None else small
    left = {n: c for n, c in counts.items() if 0 < n <= capacity and c > 0}
    ranks: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # space left -> (first sequence, how many)
    opened = 0

    def put(n: int, c: int, sequence: int, offset: int) -> None:
        rows.append((n, ranks[n], c, sequence, offset))
        ranks[n] += c

    if left.get(capacity):
        put(capacity, left[capacity], 0, 0)
        opened = left.pop(capacity)
    large = sorted((n for n in left if n > small), reverse=True)
    total = sum(left[n] for n in large)
    if total:
        stacks: list[list[list[int]]] = [[]]  # of each group: [length, pieces], largest first
        share = -(-total // min(groups, total))
        room = share
        for n in large:
            c = left.pop(n)
            while c:
                if not room:
                    stacks.append([])
                    room = share
                take = min(c, room)
                stacks[-1].append([n, take])
                c, room = c - take, room - take
        sizes = np.array([s[0][0] for s in stacks])
        demand = np.array([sum(c for _, c in s) for s in stacks])
        merged = np.unique(sizes)[::-1]  # groups of one size are one size of the programme
        wanted = np.array([demand[sizes == m].sum() for m in merged])
        pools = [[r for s, size in zip(stacks, sizes, strict=True) if size == m for r in s] for m in merged]
        columns, amounts = _configurations(merged, wanted.astype(float), capacity)
        whole = np.floor(amounts + 1e-9).astype(np.int64)
        missing = wanted - (columns * whole[:, None]).sum(0)
        chosen = [(c, int(n)) for c, n in zip(columns, whole, strict=True) if n > 0]
        rest: list[tuple[np.ndarray, int]] = []
        extra: list[list] = []
        for g in range(len(merged)):  # first fit of what the rounding left: a few configurations' worth
            need = int(missing[g])
            for e in extra:
                while need > 0 and e[1] >= merged[g]:
                    e[0][g] += 1
                    e[1] -= merged[g]
                    need -= 1
            while need > 0:
                c = np.zeros(len(merged), np.int64)
                fit = min(need, int(capacity // merged[g]))
                c[g] = fit
                extra.append([c, capacity - fit * int(merged[g])])
                need -= fit
        rest = [(e[0], 1) for e in extra]
        for column, n in chosen + rest:
            slots = [g for g in range(len(merged)) for _ in range(column[g])]
            runs = []  # of each slot: runs of equal lengths along the n sequences
            for g in slots:
                need, run = n, []
                pool = pools[g]
                while need and pool:
                    take = min(need, pool[0][1])
                    run.append((pool[0][0], take))
                    need -= take
                    pool[0][1] -= take
                    if not pool[0][1]:
                        pool.pop(0)
                if need:
                    run.append((0, need))
                runs.append(run)
            at = 0
            while at < n:
                width = min(run[0][1] for run in runs)
                offset = 0
                for run in runs:
                    size, have = run[0]
                    if size:
                        put(size, width, opened + at, offset)
                        offset += size
                    if have == width:
                        run.pop(0)
                    else:
                        run[0] = (size, have - width)
                free[capacity - offset].append((opened + at, width))
                at += width
            opened += n
        for pool in pools:
            for size, c in pool:
                left[size] = left.get(size, 0) + c
    spaces = np.zeros(capacity + 1, bool)
    for space in free:
        spaces[space] = True
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            fit = np.flatnonzero(spaces[n:])
            if len(fit):
                space = n + int(fit[0])
                sequence, width = free[space].pop()
                if not free[space]:
                    spaces[space] = False
            else:
                space = capacity
                sequence, width = opened, -(-c // (capacity // n))
                opened += width
            each = space // n
            full = min(width, c // each)
            for j in range(each if full else 0):
                put(n, full, sequence, capacity - space + j * n)
            c -= full * each
            if full and space - each * n >= 0:
                free[space - each * n].append((sequence, full))
                spaces[space - each * n] = True
            if full < width:
                sequence, width = sequence + full, width - full
                if c:
                    for j in range(min(c, each)):
                        put(n, 1, sequence, capacity - space + j * n)
                    used = min(c, each)
                    c -= used
                    free[space - used * n].append((sequence, 1))
                    spaces[space - used * n] = True
                    sequence, width = sequence + 1, width - 1
                if width:
                    free[space].append((sequence, width))
                    spaces[space] = True
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Adds sequence_id and offset to pieces of ``length`` 1 to ``capacity``; see the module for the method.

    ``pieces`` is what :func:`token_pieces` returns. Only a histogram of at most ``capacity`` lengths reaches the
    driver. A length that a third of all pieces have is ranked in many buckets, not in one window.
    No pieces, no rows; equal rows are packed once each.
    """
    pieces = cut(pieces)
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    rows = sorted(plan_packing(counts, capacity, groups))
    held = pieces.sparkSession.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 5))
    buckets = max(8, sum(counts.values()) // BUCKET_ROWS)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "spread"), F.lit(buckets)).cast("int"))
    before = (
        dealt.groupBy("length", "bucket").count()
        .withColumn("base", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("count")
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "spread", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within)).join(before, ["length", "bucket"])
    ranked = ranked.select(*[c for c in pieces.columns if c != "spread"], (F.col("base") + F.col("rank") - 1).alias("rank"))

    def make():
        plan = held.value
        key = plan[:, 0] << 40 | plan[:, 1]

        def step(b):
            got = {n: b.column(n) for n in b.schema.names if n != "rank"}
            rank = b.column("rank").to_numpy()
            at = np.searchsorted(key, b.column("length").to_numpy() << 40 | rank, "right") - 1
            return got | {"sequence_id": plan[at, 3] + rank - plan[at, 1], "offset": plan[at, 4]}

        return step

    schema = ", ".join(f"{n} {t}" for n, t in ranked.drop("rank").dtypes)
    return arrow_map(ranked, make, f"{schema}, sequence_id long, offset long", rows=8192)


def pack_documents(docs: DataFrame, spec: str, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Tokenises and packs ``docs`` (doc_id, text; other columns are ignored) into sequences of at most ``capacity`` ids."""
    return pack(token_pieces(docs, spec, capacity), capacity, groups)
