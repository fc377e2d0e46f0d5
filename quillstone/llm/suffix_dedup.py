"""Removal of long strings that repeat anywhere in a corpus, by a suffix sort that is partitioned by content.

Every string of ``length`` bytes belongs to one anchor: its least ``GRAM``-byte gram by hash, the first of equals. Equal
strings have equal anchors at equal places, so strings of different anchors never need to meet. The strings of one
anchor occurrence are consecutive; together they are a record, a stretch of text of length + (strings - 1) bytes.

1. records are counted by (anchor, content); copies of a record are one string with a count, all of whose strings repeat,
2. anchors that have several contents are contested: their distinct records are sorted as suffixes, by deep-shallow
   sorting (suffix_sort), anchors dealt over tasks; a string that another record holds too repeats,
3. an anchor with very many distinct records (a passage in ever other surroundings) is not sorted in one task: its
   records are cut into slices of a few strings, keyed by the core that they share, and these are counted, then those
   of contested slices string by string,
4. the strings that repeat are joined to their documents, whose covered bytes go.

A document is known by the hashes of its id and of its text. What passes between the steps is written as Parquet under
the shared folder and deleted when it has been read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map as _arrow_map
from .common import ddl, forget, give_back, hide, parts, stash, texts
from .suffix_sort import equal_classes

LENGTH = 400
GRAM = 32
#: A passage: so many whole words within bytes that all lie in repeated strings of PASSAGE_BYTES.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 200
#: Strings that one call sorts, but for an anchor that has more.
BATCH_STRINGS = 1 << 17
#: Distinct records of an anchor that one task sorts; beyond it, slices.
GROUP_RECORDS = 512
#: Strings of a slice.
SLICE = 16
_PLACE = 24
_KEY = ("doc", "text_hash")
#: Texts that a task holds at a time; workers give memory back between tasks.
TASK_ROWS = 64
_STEP = 1 << 22

_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)]


def arrow_map(df: DataFrame, make, schema: str) -> DataFrame:
    return _arrow_map(df, make, schema, TASK_ROWS, lean=True)


def anchors(text: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each string start the place of its anchor gram. text: at least ``length`` bytes, under 2**24."""
    h = (text.astype(np.uint64) + np.uint64(1)) * _MIX[0]
    h ^= h >> np.uint64(29)
    width, k = 1, 1
    while width * 2 <= gram:
        h = h[:-width] * _MIX[k % 5] + h[width:]
        width, k = width * 2, k + 1
    if width < gram:
        h = h[: len(h) - (gram - width)] * _MIX[k % 5] + h[gram - width :]
    h ^= h >> np.uint64(32)
    h *= _MIX[1]
    key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    return (key & np.uint64((1 << _PLACE) - 1)).astype(np.int64)


def records(text: bytes, length: int = LENGTH, gram: int = GRAM):
    """(first string, strings, place of the anchor) of each record of a text."""
    data = np.frombuffer(text, np.uint8)
    for base in range(0, max(len(text) - length + 1, 0), _STEP):
        part = data[base : base + _STEP + length - 1]
        at = anchors(part, length, gram)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        yield from zip((first + base).tolist(), np.diff(np.r_[first, len(at)]).tolist(), (at[first] + base).tolist(), strict=True)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sorted_marks(rows: DataFrame, length: int, key: tuple[str, ...]) -> DataFrame:
    """The key's columns, first, last: runs of strings of single records that repeat in another record of their anchor."""
    rows = rows.repartition(parts(rows.sparkSession), "anchor").sortWithinPartitions("anchor")

    def run(frames):
        import pandas as pd

        rest = None
        for pdf in frames:
            pdf = pdf if rest is None else pd.concat((rest, pdf), ignore_index=True)
            a = pdf["anchor"].to_numpy()
            edges = np.flatnonzero(a[1:] != a[:-1]) + 1
            before = np.cumsum(pdf["strings"].to_numpy())[edges - 1] if len(edges) else edges
            # whole anchors, cut where another BATCH_STRINGS strings are full, and after the last whole anchor
            stops = edges[np.r_[np.diff(before // BATCH_STRINGS) > 0, True]] if len(edges) else edges
            done = 0
            for e in stops.tolist():
                yield sort(pdf.iloc[done:e])
                done = e
            rest = pdf.iloc[done:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield sort(rest)
        rest = None
        give_back()

    def sort(pdf):
        import pandas as pd

        n, size = pdf["strings"].to_numpy(), pdf["content"].map(len).to_numpy()
        base = np.cumsum(size) - size
        who = np.repeat(np.arange(len(pdf)), n)
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        anchor = np.unique(pdf["anchor"].to_numpy(), return_inverse=True)[1]
        place = nth - pdf["far"].to_numpy()[who]  # equal strings lie equally far from their anchor
        label = equal_classes(b"".join(pdf["content"]), base[who] + nth, anchor[who] * (2 * length) + place + length, length)
        copies = pdf["copies"].to_numpy()
        _, label = np.unique(label, return_inverse=True)
        repeats = (np.bincount(label, copies[who])[label] > 1) & (copies[who] == 1)
        # runs of consecutive strings of one record
        at = np.flatnonzero(repeats)
        begins = np.r_[True, (np.diff(at) > 1) | (who[at[1:]] != who[at[:-1]])] if len(at) else np.zeros(0, bool)
        head, tail = at[begins], at[np.r_[begins[1:], True]] if len(at) else at
        row, start = who[head], pdf["start"].to_numpy()
        out = {c: pdf[c].to_numpy()[row] for c in key}
        return pd.DataFrame(out | {"first": start[row] + nth[head], "last": start[row] + nth[tail]})

    return rows.mapInPandas(run, ", ".join(f"{c} long" for c in key) + ", first long, last long")


def _sliced_marks(rows: DataFrame, length: int, key: tuple[str, ...]) -> DataFrame:
    """The same for anchors with very many records, by counting slices and then strings; see the module, step 3."""

    def make():
        import xxhash

        def step(b):
            names = (*key, "anchor", "copies", "start", "strings", "far", "content")
            out = {c: [] for c in (*key, "core", "edge", "first", "low", "high", "copies")}
            for *ids, anchor, copies, start, strings, far, content in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                # slices are cut at equal places seen from the anchor
                for i in range(-far // SLICE * SLICE + far, strings, SLICE):
                    # strings low to high of the slice that would hold i to i + SLICE - 1; bytes that none of them has are zero
                    low, high = max(i, 0) - i, min(i + SLICE, strings) - 1 - i
                    core = content[i + SLICE - 1 : i + length]
                    left = bytes(low) + content[i + low : i + SLICE - 1]
                    right = content[i + length : i + high + length]
                    out["core"].append(_signed(xxhash.xxh3_64_intdigest(b"%d %d " % (anchor, i - far) + core)))
                    out["edge"].append(left + right + bytes(SLICE - 1 - high))
                    for c, v in (*zip(key, ids, strict=True), ("first", start + i), ("low", low), ("high", high), ("copies", copies)):
                        out[c].append(v)
            return out

        return step

    ids = ", ".join(f"{c} long" for c in key)
    cells = stash(arrow_map(rows, make, f"core long, edge binary, {ids}, first long, low int, high int, copies long"))
    cell = ["core", "edge", "low", "high"]
    held = stash(cells.groupBy(*cell).agg(F.sum("copies").alias("n")))
    kinds = stash(held.groupBy("core").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("core"))
    lone = cells.filter("copies = 1")
    whole = lone.join(held.filter("n > 1").select(*cell), cell, "left_semi")
    whole = whole.select(*key, (F.col("first") + F.col("low")).alias("first"), (F.col("first") + F.col("high")).alias("last"))
    t = F.col("t")

    def strings(df: DataFrame, *more: str) -> DataFrame:
        """String t of a slice: its core, the left edge from byte t on and t bytes of the right edge."""
        left, right = F.expr(f"substring(edge, t + 1, {SLICE - 1} - t)"), F.expr(f"substring(edge, {SLICE}, t)")
        return df.withColumn("t", F.explode(F.sequence("low", "high"))).select("core", "t", left.alias("left"), right.alias("right"), *more)

    # each kind of slice once, with its count: copies of a slice need no strings of their own
    contested = stash(held.join(kinds, "core"))
    again = stash(strings(contested, "n").groupBy("core", "t", "left", "right").agg(F.sum("n").alias("n")).filter("n > 1").drop("n"))
    single = strings(lone.join(contested.filter("n = 1").select(*cell), cell, "left_semi"), *key, "first")
    single = single.join(again, ["core", "t", "left", "right"], "left_semi").select(*key, (F.col("first") + t).alias("first"), (F.col("first") + t).alias("last"))
    out = stash(whole.unionByName(single))
    forget(cells, held, kinds, contested, again)
    return out


def repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_records: int = GROUP_RECORDS, key: tuple[str, ...] = _KEY) -> DataFrame:
    """The key's columns and marks: array of (first, last), runs of starts of ``length``-byte strings that also start
    anywhere else, for each text that has some. Runs may repeat or overlap.

    ``docs`` has text (string or binary) and the key, longs that name a text; rows of one key and text repeat each other.
    """

    def make():
        import xxhash

        def step(b):
            out = {c: [] for c in ("anchor", "content_hash", "start", "strings", "far", "row")}
            for k, t in enumerate(texts(b.column("text"))):
                for start, n, place in records(t, length, gram):
                    out["anchor"].append(_signed(xxhash.xxh3_64_intdigest(t[place : place + gram])))
                    out["content_hash"].append(_signed(xxhash.xxh3_64_intdigest(t[start : start + n - 1 + length], place - start)))
                    out["start"].append(start)
                    out["strings"].append(n)
                    out["far"].append(place - start)
                    out["row"].append(k)
            row = out.pop("row")
            return out | {c: b.column(c).take(row) if row else b.column(c).slice(0, 0) for c in key}

        return step

    ids = ", ".join(f"{c} long" for c in key)
    long_enough = docs.filter(F.octet_length("text") >= length).select(*key, "text")
    every = stash(arrow_map(long_enough, make, f"anchor long, content_hash long, {ids}, start int, strings int, far int"))
    # most anchors have one record, and their strings cannot repeat
    busy = stash(every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    recs = stash(every.join(busy, "anchor", "left_semi"))
    forget(every, busy)
    first = F.min(F.struct(*key, "start", "strings", "far")).alias("at")
    held = stash(recs.groupBy("anchor", "content_hash").agg(F.count("*").alias("copies"), first))
    copied = held.filter("copies > 1").select("anchor", "content_hash")
    kinds = stash(held.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    whole = recs.join(copied, ["anchor", "content_hash"], "left_semi").select(*key, F.col("start").cast("long").alias("first"), (F.col("start") + F.col("strings") - 1).cast("long").alias("last"))
    contested = held.join(kinds, "anchor").select("anchor", "kinds", "copies", "at.*")
    fields = ("anchor", "kinds", "copies", "start", "strings", "far")
    wanted = contested.groupBy(*key).agg(F.collect_list(F.struct(*fields)).alias("wanted"))
    met = long_enough.join(wanted, list(key))

    def fetch():
        def step(b):
            out = {c: [] for c in (*fields, "content", "row")}
            for k, (t, wanted) in enumerate(zip(texts(b.column("text")), b.column("wanted").to_pylist(), strict=True)):
                for w in wanted:
                    for c in fields:
                        out[c].append(w[c])
                    out["content"].append(t[w["start"] : w["start"] + w["strings"] - 1 + length])
                    out["row"].append(k)
            row = out.pop("row")
            return out | {c: b.column(c).take(row) if row else b.column(c).slice(0, 0) for c in key}

        return step

    rows = stash(arrow_map(met, fetch, f"anchor long, kinds long, copies long, {ids}, start int, strings int, far int, content binary"))
    marks = whole.unionByName(_sorted_marks(rows.filter(F.col("kinds") <= group_records), length, key))
    hot = rows.filter(F.col("kinds") > group_records)
    sliced = [] if hot.isEmpty() else [_sliced_marks(hot, length, key)]
    for more in sliced:
        marks = marks.unionByName(more)
    out = stash(marks.groupBy(*key).agg(F.collect_list(F.struct("first", "last")).alias("marks")))
    forget(recs, held, kinds, rows, *sliced)
    return out


def union(marks: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Byte spans [start, end) covered by strings whose starts run from first to last."""
    out: list[list[int]] = []
    for first, last in sorted(marks):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


_BLANK = b" \t\n\r\x0b\x0c"


def whole_words(raw: bytes, start: int, end: int) -> tuple[int, int, int]:
    """(start, end, words) of a span without the words that it cuts and its leading blanks, which keep words apart."""
    if start and raw[start - 1] not in _BLANK:
        while start < end and raw[start] not in _BLANK:
            start += 1
    if end < len(raw) and raw[end] not in _BLANK:
        while end > start and raw[end - 1] not in _BLANK:
            end -= 1
    while start < end and raw[start] in _BLANK:
        start += 1
    return start, end, len(raw[start:end].split())


def passages(raw: bytes, spans: list[tuple[int, int]], words: int = PASSAGE_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, words) of the spans that hold at least so many whole words, without words cut in half."""
    return [p for s in spans if (p := whole_words(raw, *s))[2] >= words]


def _pairs(marks: list[dict] | None) -> list[tuple[int, int]]:
    return [(m["first"], m["last"]) for m in marks or []]


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc and text_hash, the key of a row, beside its columns."""
    return docs.withColumns({"doc": F.xxhash64(F.lit("doc"), doc_id), "text_hash": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})


def _marked(docs: DataFrame, doc_id: str, text: str, length: int, gram: int, group_records: int) -> DataFrame:
    """``docs`` (hidden columns), its key and marks, null for none."""
    named = _named(docs, doc_id, text)
    marks = repeated_strings(named.select(*_KEY, F.col(text).alias("text")), length, gram, group_records)
    return named.join(marks, list(_KEY), "left")


def removed_spans(docs: DataFrame, length: int = LENGTH, words: int = 0, gram: int = GRAM, group_records: int = GROUP_RECORDS) -> DataFrame:
    """``docs`` (doc_id, text and any other columns, whatever their names) as struct ``row`` with ``spans``: the byte spans
    of the text that repeat, as array<struct<start, end>>, [] for none.

    Texts are UTF-8 bytes, null is empty; matches never cross texts, may overlap within one, and are judged on the
    input. Rows that repeat whole repeat all their strings. Texts under ``length`` bytes keep every byte. With ``words``,
    only spans that hold as many whole words count, without words cut in half.
    """
    hidden, names = hide(docs)

    def make():
        def step(b):
            found = []
            for t, marks in zip(texts(b.column(names["text"])), b.column("marks").to_pylist(), strict=True):
                spans = union(_pairs(marks), length)
                spans = [p[:2] for p in passages(t, spans, words)] if words else spans
                found.append([{"start": s, "end": e} for s, e in spans])
            return {c: b.column(c) for c in names.values()} | {"spans": found}

        return step

    marked = _marked(hidden, names["doc_id"], names["text"], length, gram, group_records)
    out = arrow_map(marked.drop(*_KEY), make, f"{ddl(hidden)}, spans array<struct<start:long,end:long>>")
    return out.select(F.struct(*(F.col(v).alias(k) for k, v in names.items())).alias("row"), "spans")


def cut_texts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_records: int = GROUP_RECORDS, words: int = PASSAGE_WORDS, passage_bytes: int = PASSAGE_BYTES) -> DataFrame:
    """Of every row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text (what remains, halves of characters as
    U+FFFD) under the rule of ``length`` bytes, and n_passages and passage_words, the repeated passages of at least
    ``words`` words that the text holds; see removed_spans.

    A string that repeats has only strings that repeat within it. So strings of ``passage_bytes`` are searched for first,
    and those of ``length`` only in the stretches that these cover.
    """
    short = min(passage_bytes, length)
    slim, names = hide(docs.select("doc_id", "text"))
    doc_id, text = names["doc_id"], names["text"]
    named = _named(slim, doc_id, text).withColumnRenamed(text, "text")
    marks = repeated_strings(named.select(*_KEY, "text"), short, min(gram, short), group_records)

    def stretches():
        def step(b):
            out = {c: [] for c in ("at", "piece", "n_passages", "passage_words", "row")}
            for k, (t, found) in enumerate(zip(texts(b.column("text")), b.column("marks").to_pylist(), strict=True)):
                spans = union(_pairs(found), short)
                told = passages(t, spans, words)
                if told:  # one row for the passages, with no piece
                    for c, v in (("at", -1), ("piece", None), ("n_passages", len(told)), ("passage_words", sum(p[2] for p in told)), ("row", k)):
                        out[c].append(v)
                for s, e in spans:
                    if e - s >= length:
                        for c, v in (("at", s), ("piece", t[s:e]), ("n_passages", 0), ("passage_words", 0), ("row", k)):
                            out[c].append(v)
            row = out.pop("row")
            return out | {c: b.column(c).take(row) if row else b.column(c).slice(0, 0) for c in _KEY}

        return step

    found = stash(arrow_map(named.join(marks, list(_KEY)).select(*_KEY, "text", "marks"), stretches, "doc long, text_hash long, at long, piece binary, n_passages long, passage_words long"))
    forget(marks)
    long_marks = repeated_strings(found.filter("at >= 0").select(*_KEY, "at", F.col("piece").alias("text")), length, gram, group_records, (*_KEY, "at"))
    runs = F.transform("marks", lambda m: F.struct((m["first"] + F.col("at")).alias("first"), (m["last"] + F.col("at")).alias("last")))
    whole = long_marks.groupBy(*_KEY).agg(F.flatten(F.collect_list(runs)).alias("marks"))
    # rows that repeat tell the same
    told = found.filter("at < 0").groupBy(*_KEY).agg(F.max("n_passages").alias("n_passages"), F.max("passage_words").alias("passage_words"))
    facts = stash(told.join(whole, list(_KEY), "full"))
    forget(found, long_marks)

    def make():
        def step(b):
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "text")}
            for t, marks in zip(texts(b.column("text")), b.column("marks").to_pylist(), strict=True):
                spans = union(_pairs(marks), length)
                edges = [0, *(x for s in spans for x in s), len(t)]
                kept = b"".join(t[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                for c, v in zip(out, (len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")), strict=True):
                    out[c].append(v)
            return out | {c: b.column(c) for c in (doc_id, "n_passages", "passage_words")}

        return step

    joined = named.join(facts, list(_KEY), "left").select(doc_id, "text", "marks", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_passages", "passage_words")))
    kind = slim.schema[doc_id].dataType.simpleString()
    out = arrow_map(joined, make, f"{doc_id} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, n_passages long, passage_words long")
    return out.withColumnRenamed(doc_id, "doc_id")


def drop_repeats(docs: DataFrame, length: int = PASSAGE_BYTES, words: int = PASSAGE_WORDS, gram: int = GRAM, group_records: int = GROUP_RECORDS) -> DataFrame:
    """``docs`` with the repeated spans cut from ``text``, whole characters only, and n_chars to match where it is a column.

    With ``words``, spans of at least so many whole words go and shorter ones stay; with 0, every span goes.
    """
    hidden, names = hide(docs)
    text = names["text"]

    def make():
        def step(b):
            kept = []
            for t, marks in zip(b.column(text).to_pylist(), b.column("marks").to_pylist(), strict=True):
                if marks:
                    raw, at, out = t.encode(), 0, []
                    spans = union(_pairs(marks), length)
                    for start, end in [p[:2] for p in passages(raw, spans, words)] if words else spans:
                        while start < end and raw[start] & 0xC0 == 0x80:  # a character cut in half stays
                            start += 1
                        while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
                            end -= 1
                        out.append(raw[at:start])
                        at = end
                    t = b"".join([*out, raw[at:]]).decode()
                kept.append(t)
            return {c: b.column(c) for c in names.values() if c != text} | {text: kept}

        return step

    marked = _marked(hidden, names["doc_id"], text, length, gram, group_records).drop(*_KEY)
    out = arrow_map(marked, make, ddl(hidden)).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
