"""Mail containers (compound files): a row for each attachment that is a document, with the message's own fields."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# The container's signature and its marks of sectors, the streams of a message's properties, and documents by their first bytes.
SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
LAST_SECTOR, NO_ENTRY = 0xFFFFFFFA, 0xFFFFFFFF
SUBJECT, SENDER_MAIL, SENDER_NAME, SENT, BODY, FILE_NAME, LONG_FILE_NAME, DATA = "0037", "0C1F", "0C1A", "0039", "1000", "3704", "3707", "3701"
KINDS = {b"%PDF": "pdf", b"\xff\xd8\xff": "jpeg", b"\x89PNG": "png"}
_ROW = "subject string, sender string, sent string, body string, nth int, name string, kind string, size bigint, data binary"


def streams(content: bytes) -> Iterator[tuple[tuple[str, ...], bytes]]:
    """(path, bytes) of every stream of a compound file. Chains that loop or leave the file end there; no container, no streams."""
    if len(content) < 512 or content[:8] != SIGNATURE:
        return
    shift, mini_shift = struct.unpack_from("<HH", content, 30)
    if not (7 <= shift <= 16 and 3 <= mini_shift <= shift):
        return
    first_dir, _, cutoff, first_mini, _, more, _ = struct.unpack_from("<IIIIIII", content, 48)
    size, mini = 1 << shift, 1 << mini_shift

    def sector(n: int) -> bytes:
        return content[(n + 1) * size : (n + 2) * size]

    def table(data: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4]))

    def chain(start: int, links: list[int]) -> list[int]:
        out, seen = [], set()
        while start < LAST_SECTOR and start < len(links) and start not in seen:
            seen.add(start)
            out.append(start)
            start = links[start]
        return out

    places, seen = table(content[76:512]), set()
    while more < LAST_SECTOR and more not in seen and sector(more):
        seen.add(more)
        *own, more = table(sector(more)) or [LAST_SECTOR]
        places += own
    fat = [x for p in places if p < LAST_SECTOR for x in table(sector(p))]
    listing = b"".join(map(sector, chain(first_dir, fat)))
    entries = []
    for at in range(0, len(listing) - 127, 128):
        length, kind, _, left, right, child = struct.unpack_from("<HBBIII", listing, at + 64)
        start, big = struct.unpack_from("<IQ", listing, at + 116)
        entries.append((listing[at : at + max(min(length, 64) - 2, 0)].decode("utf-16-le", "replace"), kind, left, right, child, start, big & 0xFFFFFFFF if shift == 9 else big))
    if not entries:
        return
    small_links = [x for s in chain(first_mini, fat) for x in table(sector(s))]
    small = b"".join(map(sector, chain(entries[0][5], fat)))
    todo, done = [(entries[0][4], ())], set()
    while todo:
        n, path = todo.pop()
        if n >= len(entries) or n in done:
            continue
        done.add(n)
        name, kind, left, right, child, start, length = entries[n]
        todo += [(left, path), (right, path)]
        if kind == 1:
            todo.append((child, (*path, name)))
        elif kind == 2:
            parts = (small[s * mini : (s + 1) * mini] for s in chain(start, small_links)) if length < cutoff else map(sector, chain(start, fat))
            yield (*path, name), b"".join(parts)[:length]


def message(content: bytes | None) -> Iterator[tuple]:
    """Rows of a message: one for each attached document, else one without."""
    found = dict(streams(content or b""))
    if not found:
        return

    def text(tag: str, within: str | None = None) -> str | None:
        for kind, code in (("001F", "utf-16-le"), ("001E", "cp1252")):
            for path, data in sorted(found.items()):
                if path[-1] == f"__substg1.0_{tag}{kind}" and (path[0] == within if within else not path[0].startswith("__attach")):
                    said = data.decode(code, "replace").replace("\x00", "").strip()
                    if said:
                        return said
        return None

    body = re.sub(r"\n{3,}", "\n\n", text(BODY) or "").strip()
    own = text(SUBJECT), text(SENDER_MAIL) or text(SENDER_NAME), text(SENT), body
    nth = 0
    for path, data in sorted(found.items()):
        kind = next((k for head, k in KINDS.items() if data.startswith(head)), None)
        if path[0].startswith("__attach") and path[-1] == f"__substg1.0_{DATA}0102" and kind:
            nth += 1
            name = text(LONG_FILE_NAME, path[0]) or text(FILE_NAME, path[0]) or f"attachment{nth}.{kind}"
            yield *own, nth, re.sub(r'[<>:"/\\|?*]', "_", name), kind, len(data), data
    if not nth:
        yield *own, None, None, None, None, None


@udtf(returnType=_ROW)
class Message:
    def eval(self, content):
        yield from message(None if content is None else bytes(content))


def attachments(mails: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key and a message's subject, sender, sent, body, with nth, name, kind, size and data of each attached document.

    A message without documents has one row with nulls for them. What is no container has no row; damaged ones give what can be read.
    """
    rows = mails.select(F.col(key).alias("_key"), F.col(content).alias("_content"))
    return rows.lateralJoin(Message(F.col("_content").outer())).drop("_content").withColumnRenamed("_key", key)
