"""SQL of DuckDB for the operators that it can express."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    bytes_ = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: {bits}), 4294967295)"


def _paid(path: str, cost: str, edit: str) -> str:
    """A path is its cost in nine digits, then its audit: text order is the order of (cost, audit)."""
    return f"lpad((({path})[1:9]::BIGINT + {cost})::VARCHAR, 9, '0') || ({path})[10:] || '{edit}'"


def _inserted(source: str) -> str:
    """Paths with up to two insertions more; a third comes back to a state at a higher cost."""
    once = f"SELECT * EXCLUDE (k2, k3), least(k2, {_paid('least(k0, k1, k3)', '2', 'I')}) k2, least(k3, {_paid('k2', '2', 'I')}) k3 FROM ({source})"
    return f"SELECT * EXCLUDE (k2, k3), least(k2, {_paid('k3', '2', 'I')}) k2, least(k3, {_paid('k2', '2', 'I')}) k3 FROM ({once})"


_TAKEN = f"""
SELECT g, p, {_paid('k0', '3', 'D')} k0,
  least({_paid('k1', '3', 'D')}, CASE WHEN free AND initial = 's' THEN {_paid('k0', 'charge', 'K')} END) k1,
  least({_paid('k2', '3', 'D')}, CASE WHEN free AND initial = 'u' THEN {_paid('least(k0, k1, k3)', 'charge', 'K')} END, CASE WHEN free THEN {_paid('least(k0, k1, k3)', '2 + charge', 'R')} END) k2,
  least({_paid('k3', '3', 'D')}, CASE WHEN free AND initial = 'a' THEN {_paid('k2', 'charge', 'K')} END, CASE WHEN free THEN {_paid('k2', '2 + charge', 'R')} END) k3
FROM (SELECT f.g, f.p, k0, k1, k2, k3, initial, fault IS NULL OR fault = 'truncated' free, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END charge FROM walk JOIN f ON f.g = walk.g AND f.p = walk.p + 1)
"""

CONVERSATIONS = rf"""
WITH RECURSIVE
kind AS (SELECT conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') k FROM conversations),
summed AS (SELECT *, {crc32('k')} % 20 d FROM kind),
hurt AS (
  SELECT conv_id, coalesce('=' || conv_id::VARCHAR, '') g, turn, CASE d WHEN 4 THEN 'user' ELSE role END role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END text, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) copy
  FROM summed WHERE d <> 0
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) p FROM hurt),
placed AS (SELECT *, min(p) OVER (PARTITION BY g, role, text) first_p FROM numbered),
f AS (
  SELECT *, CASE WHEN role[1:1] IN ('s', 'u', 'a') THEN role[1:1] ELSE '.' END initial,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN first_p < p THEN 'duplicate'
      WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' END fault
  FROM placed
),
begun AS (SELECT DISTINCT g, 0::BIGINT p, '000000000' k0, NULL::VARCHAR k1, NULL::VARCHAR k2, NULL::VARCHAR k3 FROM f),
walk AS (SELECT g, p, k0, k1, k2, k3 FROM ({_inserted('FROM begun')}) UNION ALL SELECT g, p, k0, k1, k2, k3 FROM ({_inserted(_TAKEN)})),
best AS (SELECT g, arg_max(least(k0, k3), p) path FROM walk GROUP BY g),
letters AS (SELECT g, i, path[9 + i : 9 + i] letter FROM (SELECT g, path, unnest(range(1, length(path) - 8)) i FROM best)),
pointed AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY g ORDER BY i) p FROM letters),
kept AS (
  SELECT pointed.g, i, letter, role, CASE letter WHEN 'I' THEN '' ELSE text END text, row_number() OVER (PARTITION BY pointed.g ORDER BY i) j,
    first_value(letter = 'K' AND initial = 's') OVER (PARTITION BY pointed.g ORDER BY i) led
  FROM pointed LEFT JOIN f ON f.g = pointed.g AND f.p = pointed.p WHERE letter <> 'D'
),
repaired AS (SELECT g, string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) t FROM kept GROUP BY g),
counted AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps, count(*) FILTER (fault = 'blank') blank, count(*) FILTER (fault = 'duplicate') duplicate, count(*) FILTER (fault = 'truncated') truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY g ORDER BY p) before FROM f) GROUP BY g
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT gaps, coalesce(blank, 0)::BIGINT blank, coalesce(duplicate, 0)::BIGINT duplicate, coalesce(truncated, 0)::BIGINT truncated,
  coalesce(illegal, 0)::BIGINT illegal, coalesce(path[1:9]::BIGINT, 0) cost, coalesce(path[10:], '') audit, sha256(coalesce(t, '')) repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id::VARCHAR, '') g FROM conversations) c LEFT JOIN counted USING (g) LEFT JOIN best USING (g) LEFT JOIN repaired USING (g)
"""


def _leaf(n_chars: str) -> str:
    shown = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    return f"sha256({' || '.join(map(shown, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


def _tree(name: str, nodes: str) -> str:
    return f"{name} AS ({nodes} UNION ALL SELECT g, level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, level, pos // 2)"


def _steps(tree: str, leaves: str) -> str:
    """Of each row of ``leaves`` (g, pos), the sibling on each level and its side; runs of one have none, but are steps."""
    return f"""
  SELECT l.g, l.pos, list(CASE WHEN s.h IS NULL THEN 'N' WHEN s.pos < own.pos THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY own.level) steps
  FROM {leaves} l JOIN (SELECT DISTINCT g, level FROM {tree} WHERE n > 1) v ON v.g = l.g
  JOIN {tree} own ON own.g = l.g AND own.level = v.level AND own.pos = l.pos >> v.level
  LEFT JOIN {tree} s ON s.g = l.g AND s.level = v.level AND s.pos = xor(own.pos, 1::BIGINT) GROUP BY l.g, l.pos"""


MERKLE = f"""
WITH RECURSIVE
summed AS (SELECT *, coalesce('=' || lang, '') g, {_leaf('n_chars')} leaf, {crc32('doc_id::VARCHAR')} % 7 = 0 tampered FROM documents),
leaves AS (SELECT doc_id, g, leaf, CASE WHEN tampered THEN {_leaf('(n_chars + 1)')} ELSE leaf END claimed, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 pos, count(*) OVER (PARTITION BY g) n FROM summed),
{_tree('low', 'SELECT g, 0 level, pos, n, leaf h FROM leaves')},
subroots AS (SELECT g lang_g, '' g, row_number() OVER (ORDER BY g) - 1 pos, count(*) OVER () n, h FROM low WHERE n = 1),
{_tree('high', 'SELECT g, 0 level, pos, n, h FROM subroots')},
root AS (SELECT h root FROM high WHERE n = 1),
below AS ({_steps('low', 'leaves')}),
above AS ({_steps('high', 'subroots')}),
proofs AS (
  SELECT doc_id, leaf, claimed, s.h subroot, root, list_concat(coalesce(below.steps, []), coalesce(above.steps, [])) steps
  FROM leaves l JOIN subroots s ON s.lang_g = l.g CROSS JOIN root LEFT JOIN below ON below.g = l.g AND below.pos = l.pos LEFT JOIN above ON above.pos = s.pos
),
shown AS (
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) proof_sha256,
    list_reduce(list_prepend(claimed, steps), lambda h, s: sha256(CASE s[1:1] WHEN 'L' THEN s[2:] || h WHEN 'R' THEN h || s[2:] ELSE h END)) folded_root
  FROM proofs
)
SELECT *, folded_root = root verified FROM shown
"""
