"""SQL for operators whose rows SQL can express: trees by recursion, edits by a fold over the rows of a conversation."""

from __future__ import annotations

MERKLE = r"""
WITH RECURSIVE coded AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lk, lang IS NOT NULL AS has,
    coalesce(strlen(CAST(doc_id AS varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS body,
    xor(list_reduce(list_transform(range(1, length(CAST(doc_id AS varchar)) + 1), lambda i: CAST(ord(CAST(doc_id AS varchar)[i]) AS bigint)),
      lambda c, b: list_reduce(range(8), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), CAST(4294967295 AS bigint)), 4294967295) AS crc
  FROM documents
), leaves AS (
  SELECT *, sha256(head || coalesce(strlen(CAST(n_chars AS varchar)) || ':' || n_chars, '-') || body) AS leaf,
    CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN sha256(head || strlen(CAST(n_chars + 1 AS varchar)) || ':' || (n_chars + 1) || body) END AS changed
  FROM coded
), placed AS (
  SELECT rid, doc_id, lk, has, leaf, changed, row_number() OVER (PARTITION BY has, lk ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY has, lk) AS size FROM leaves
), up AS (
  SELECT CAST(0 AS bigint) AS lvl, has, lk, CAST(idx AS bigint) AS idx, CAST(size AS bigint) AS size, leaf AS val FROM placed
  UNION ALL
  SELECT lvl + 1, has, lk, idx // 2, (size + 1) // 2, sha256(string_agg(val, '' ORDER BY idx)) FROM up WHERE size > 1 GROUP BY lvl, has, lk, idx // 2, size
), subroots AS (
  SELECT has, lk, val AS subroot, CAST(row_number() OVER (ORDER BY has, encode(lk)) - 1 AS bigint) AS idx, CAST(count(*) OVER () AS bigint) AS size FROM up WHERE size = 1
), top AS (
  SELECT CAST(0 AS bigint) AS lvl, idx, size, subroot AS val FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 2, (size + 1) // 2, sha256(string_agg(val, '' ORDER BY idx)) FROM top WHERE size > 1 GROUP BY lvl, idx // 2, size
), steps AS (
  SELECT p.rid, n.lvl, CASE WHEN s.val IS NULL THEN '-' WHEN s.idx > n.idx THEN 'R' || s.val ELSE 'L' || s.val END AS step
  FROM placed AS p JOIN up AS n ON n.has = p.has AND n.lk = p.lk AND n.size > 1 AND n.idx = p.idx >> CAST(n.lvl AS int)
  LEFT JOIN up AS s ON s.has = n.has AND s.lk = n.lk AND s.lvl = n.lvl AND s.idx = xor(n.idx, 1)
  UNION ALL
  SELECT p.rid, 1000 + n.lvl, CASE WHEN s.val IS NULL THEN '-' WHEN s.idx > n.idx THEN 'R' || s.val ELSE 'L' || s.val END
  FROM placed AS p JOIN subroots AS b ON b.has = p.has AND b.lk = p.lk JOIN top AS n ON n.size > 1 AND n.idx = b.idx >> CAST(n.lvl AS int)
  LEFT JOIN top AS s ON s.lvl = n.lvl AND s.idx = xor(n.idx, 1)
), paths AS (
  SELECT rid, list(step ORDER BY lvl) AS path FROM steps GROUP BY rid
), folded AS (
  SELECT p.*, b.subroot, (SELECT val FROM top WHERE size = 1) AS root, coalesce(path, []) AS path,
    list_reduce(coalesce(path, []), lambda v, s: CASE WHEN s = '-' THEN sha256(v) WHEN s[1] = 'R' THEN sha256(v || s[2:]) ELSE sha256(s[2:] || v) END, coalesce(changed, leaf)) AS folded_root
  FROM placed AS p JOIN subroots AS b ON b.has = p.has AND b.lk = p.lk LEFT JOIN paths AS q ON q.rid = p.rid
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


def _more(state: str, cost: object, edit: str) -> str:
    """A state (six digits of cost, a bar, the edits) with one more edit; null stays null."""
    return f"(lpad(CAST(CAST({state}[1:6] AS int) + {cost} AS varchar), 6, '0') || {state}[7:] || '{edit}')"


def _inserted(x: str) -> str:
    """The four states with one row inserted where that is cheaper."""
    user = ", ".join(_more(f"{x}[{k}]", 5, "I") for k in (1, 2, 4))
    return f"[{x}[1], {x}[2], list_min([{x}[3], {user}]), list_min([{x}[4], {_more(f'{x}[3]', 5, 'I')}])]"


_CUT = "CASE WHEN r.cut THEN 5 ELSE 0 END"


def _after(edit: str, cost: str, *states: int) -> str:
    return ", ".join(_more(f"y[{k}]", cost, edit) for k in states)


# The states after a row r: nothing yet, system, user, assistant.
_NEXT = f"""[{_after("D", "2", 1)},
        list_min([{_after("D", "2", 2)}, CASE WHEN NOT r.gone AND r.i = 's' THEN {_after("K", _CUT, 1)} END]),
        list_min([{_after("D", "2", 3)}, CASE WHEN NOT r.gone AND r.i = 'u' THEN list_min([{_after("K", _CUT, 1, 2, 4)}]) END, CASE WHEN NOT r.gone THEN list_min([{_after("R", f"1 + {_CUT}", 1, 2, 4)}]) END]),
        list_min([{_after("D", "2", 4)}, CASE WHEN NOT r.gone AND r.i = 'a' THEN {_after("K", _CUT, 3)} END, CASE WHEN NOT r.gone THEN {_after("R", f"1 + {_CUT}", 3)} END])]"""

CONVERSATIONS = rf"""
WITH coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS varchar), ' ') || ':' || coalesce(CAST(turn AS varchar), ' ') AS k FROM conversations
), summed AS (
  SELECT *, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: CAST(ord(k[i]) AS bigint)),
    lambda c, b: list_reduce(range(8), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), CAST(4294967295 AS bigint)), 4294967295) % 20 AS code FROM coded
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM summed
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM damaged
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY pos) || role[1:1] AS pair,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending FROM ordered
), faulted AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen
), grouped AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list(struct_pack(i := role[1:1], gone := fault IN ('blank', 'duplicate'), cut := fault = 'truncated', role := role, text := text) ORDER BY pos) AS rows
  FROM faulted GROUP BY conv_id
), states AS (
  -- Of each state (nothing yet, system, user, assistant) the least cost with its edits; up to two rows may be inserted before each row.
  SELECT *, list_reduce(rows, lambda a, r: list_transform(list_transform(list_transform([a], lambda x: {_inserted('x')}), lambda x: {_inserted('x')}), lambda y:
       {_NEXT})[1], ['000000|', CAST(NULL AS varchar), CAST(NULL AS varchar), CAST(NULL AS varchar)]) AS z FROM grouped
), best AS (
  SELECT *, list_min([z[1], {_more('z[2]', '10', 'II')}, {_more('z[3]', '5', 'I')}, z[4]]) AS won FROM states
), said AS (
  SELECT *, list_reduce(list_filter(string_split(won[8:], ''), lambda e: e <> ''), lambda s, e: CASE e
      WHEN 'I' THEN struct_pack(n := s.n, st := CASE WHEN s.st = 'u' THEN 'a' ELSE 'u' END, lines := list_append(s.lines, CASE WHEN s.st = 'u' THEN 'assistant:' ELSE 'user:' END))
      WHEN 'D' THEN struct_pack(n := s.n + 1, st := s.st, lines := s.lines)
      WHEN 'K' THEN struct_pack(n := s.n + 1, st := rows[s.n].i, lines := list_append(s.lines, rows[s.n].role || ':' || rows[s.n].text))
      ELSE struct_pack(n := s.n + 1, st := CASE WHEN s.st = 'u' THEN 'a' ELSE 'u' END, lines := list_append(s.lines, CASE WHEN s.st = 'u' THEN 'assistant:' ELSE 'user:' END || rows[s.n].text)) END,
    struct_pack(n := CAST(1 AS bigint), st := '', lines := CAST([] AS varchar[]))) AS story FROM best
)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS bigint) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(won[1:6], '0') AS bigint) AS cost, coalesce(won[8:], '') AS audit, sha256(coalesce(array_to_string(story.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS i LEFT JOIN said AS s ON s.conv_id IS NOT DISTINCT FROM i.conv_id
"""
