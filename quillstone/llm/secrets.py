"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Text of any language is cut into few long tokens by a large vocabulary; keys and random strings fall apart into short
ones. A run of key characters whose characters per token stay under ``RATIO`` is a secret, unless it is a known digest
or identifier. Words joined by separators are judged by their letters alone, so that the separators don't weigh.
"""

from __future__ import annotations

import base64
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, hide_but

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "random")
#: Characters per token under which a run counts as random.
RATIO = 2.0
#: A long run is judged by pieces of so many characters.
PIECE = 512

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
_HEX = re.compile("[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=~-]{16,}")
#: Hex digests of 128 to 512 bits, UUIDs, and numbers with separators.
_KNOWN = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=~-]+)")
#: Least length of a run, of a run of letters alone, of letters judged together, and of what is left of a run beside
#: other spans.
LEAST, LEAST_LETTERS, LEAST_WORD, LEAST_REST = 16, 20, 4, 6
#: A run of letters alone, joined by separators, as ordinary writing makes.
_WORDS = re.compile(r"[+/_=~-]*(?:[A-Za-z]+[+/_=~-]+)*[A-Za-z]*")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of the fixed patterns, by start and then kind."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def random_spans(text: str, tokens, taken: list[tuple[str, int, int]], ratio: float = RATIO) -> list[tuple[str, int, int]]:
    """Runs that fail the token-efficiency test, and what lies beside the taken spans of a run and fails it.

    tokens: text -> number of tokens.
    """
    out = []
    for m in _RUN.finditer(text):
        at, left = m.start(), []
        for s, e in sorted((s, e) for _, s, e in taken if s < m.end() and m.start() < e):
            left.append((at, s))
            at = max(at, e)
        whole = not left
        for s, e in [*left, (at, m.end())]:
            if e - s >= (LEAST if whole else LEAST_REST):
                out += [("random", s + i, s + j) for i, j in random_parts(text[s:e], tokens, ratio, LEAST if whole else LEAST_REST)]
    return out


def random_parts(run: str, tokens, ratio: float, least: int) -> list[tuple[int, int]]:
    """(start, end) of what is random in a run of key characters: all of it, or single words of letters in it."""

    def random(words: list[str]) -> bool:
        n = sum(tokens(w[k : k + PIECE]) for w in words for k in range(0, len(w), PIECE))
        return sum(map(len, words)) < ratio * n

    if _KNOWN.fullmatch(run):
        return []
    if not _WORDS.fullmatch(run):
        return [(0, len(run))] if random([run]) else []
    least = max(least, LEAST_LETTERS) if least == LEAST else least
    words = [w for w in re.finditer("[A-Za-z]+", run) if len(w.group()) >= LEAST_WORD]
    found = [w.span() for w in words if len(w.group()) >= least and random([w.group()])]
    rest = [w.group() for w in words if w.span() not in found]
    return [(0, len(run))] if sum(map(len, rest)) >= least and random(rest) else found


def find_secrets(docs: DataFrame, ranks: bytes, pattern: str, ratio: float = RATIO) -> DataFrame:
    """All columns of ``docs`` and ``secrets``: array<struct<kind, start, end>> of the whole text, by start and then kind.

    ``ranks`` is the content of a tiktoken rank file and ``pattern`` what splits text before its merges. Offsets count
    code points, the end is exclusive. Null and empty texts have none ([]); equal rows get equal spans. A column named
    secrets is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def make():
        import tiktoken

        ranks, pattern = held.value
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={}).encode_ordinary

        def count(run: str) -> int:
            return len(encode(run))

        def step(b):
            spans = []
            for text in b.column("text").to_pylist():
                taken = base_spans(text or "")
                both = taken + random_spans(text or "", count, taken, ratio)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in sorted(both, key=lambda s: (s[1], KINDS.index(s[0])))])
            return {c: b.column(c) for c in b.schema.names if c != "secrets"} | {"secrets": spans}

        return step

    docs = docs.drop("secrets")
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return arrow_map(docs, make, f"{schema}, secrets array<struct<kind:string,start:long,end:long>>")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random from what :func:`find_secrets` returns."""
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"), n("random"))


def redact(found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``found`` with every span of ``secrets`` replaced by ``mark`` in the text, without the secrets column; n_chars follows.

    Spans that overlap get one mark. Null texts stay null.
    """
    names = [c for c in found.columns if c != "secrets"]
    text, start, end = F.col("text"), lambda s: s["start"].cast("int"), lambda s: s["end"].cast("int")
    # what lies before each span that reaches further than those before it, then the rest: each slice is cut once
    step = lambda a, s: F.struct(
        F.when(s["start"] < a["at"], a["parts"]).otherwise(F.concat(a["parts"], F.array(F.substring(text, a["at"] + 1, start(s) - a["at"])))).alias("parts"),
        F.greatest(a["at"], end(s)).alias("at"),
    )
    nothing = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    done = F.aggregate("secrets", nothing, step, lambda a: F.array_join(F.concat(a["parts"], F.array(text.substr(a["at"] + 1, F.length(text)))), mark))
    out = found.withColumn("text", F.when(F.size("secrets") > 0, done).otherwise(text))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(found.schema["n_chars"].dataType))
    return out.select(*names)


def without_secrets(docs: DataFrame, ranks: bytes, pattern: str, ratio: float = RATIO) -> DataFrame:
    """``docs`` with the text redacted and its columns kept, whatever they are called."""
    docs, names = hide_but(docs, "text", "n_chars")
    out = redact(find_secrets(docs, ranks, pattern, ratio))
    return out.select(*(F.col(v).alias(c) for c, v in names.items()))
