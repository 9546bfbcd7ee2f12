"""SQL of the operators that SQL can express, written from their definitions."""

from __future__ import annotations

LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# CRC-32 of UTF-8 bytes, a table lookup per byte.
CRC_TABLE = """crc AS (
  SELECT list(x ORDER BY i) AS tab
  FROM (SELECT i, list_reduce([i::BIGINT] || range(8),
                              lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS x
        FROM range(256) t(i)))"""
CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode({x})), '..'),
                         lambda b: ('0x' || b)::BIGINT),
                       lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295)"""

# Splitter i of 15: the coarsest digest grid (3, 6, ... hexadecimal digits) with a boundary near enough, else a row's edge.
SHARDS = f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(text, '')) AS h, {CRC.format(x="coalesce(text, '')")} AS text_crc32
      FROM documents, crc),
o AS (SELECT *, row_number() OVER w AS pos, (sum(size) OVER w - size)::BIGINT AS below FROM d WINDOW w AS (ORDER BY h, doc_id NULLS FIRST)),
whole AS (SELECT sum(size)::BIGINT AS total FROM d),
cells AS (
  SELECT depth, min(below) AS low, max(below + size) AS high
  FROM o, unnest([3, 6, 9, 12, 15, 18, 21, 24, 27, 30, 32]) AS t(depth) GROUP BY depth, substr(h, 1, depth)
  UNION ALL SELECT 99, below, below + size FROM o),
near AS (
  SELECT i, depth, CASE WHEN i * total - 16 * low <= 16 * high - i * total THEN low ELSE high END AS edge,
         least(i * total - 16 * low, 16 * high - i * total) AS off, total
  FROM cells, whole, range(1, 16) AS s(i) WHERE 16 * low <= i * total AND i * total < 16 * high),
splitters AS (SELECT i, arg_min(edge, depth) AS edge FROM near WHERE depth = 99 OR off <= 0.005 * total GROUP BY i),
placed AS (SELECT o.*, (SELECT count(*) FROM splitters WHERE edge <= below)::INTEGER AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS slot,
       NULL::INTEGER AS grown_shard
FROM placed
"""


def _options(state: int) -> str:
    """Cheapest edits from a row on, without an insertion before it: (cost and initials, repaired lines)."""
    then = 3 if state == 2 else 2
    new = "'assistant'" if state == 2 else "'user'"
    keeps = {0: "initial IN ('s', 'u')", 1: "initial = 'u'", 2: "initial = 'a'", 3: "initial = 'u'"}[state]
    kept = "CASE WHEN initial = 's' THEN s1 ELSE s2 END" if state == 0 else f"s{then}"
    return f"""list_min([
      {_step(f"s{state}", "'D'", "2", None)},
      CASE WHEN fault < 2 AND {keeps} THEN {_step(f"({kept})", "'K'", "5 * fault", "role || ':' || text")} END,
      CASE WHEN fault < 2 THEN {_step(f"s{then}", "'R'", "1 + 5 * fault", f"{new} || ':' || text")} END])"""


def _step(after: str, edit: str, cost: str, line: str | None) -> str:
    lines = f"[{line}] || {after}.t" if line else f"{after}.t"
    return f"{{'k': printf('%09d', substr({after}.k, 1, 9)::BIGINT + {cost}) || {edit} || substr({after}.k, 10), 't': {lines}}}"


REPAIR = f"""
WITH RECURSIVE {CRC_TABLE},
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {CRC.format(x="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM named, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r, substr(role, 1, 1) AS initial,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
named_faults AS (
  SELECT *, CASE WHEN bare = '' THEN 3
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 THEN 2
                 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY r) || initial AS pair
  FROM ordered),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM named_faults GROUP BY conv_id),
walk AS (  -- from the last row to the first: the best edits from each state on
  SELECT conv_id, n AS r, {{'k': '000000000', 't': []::VARCHAR[]}} AS s0, {{'k': '000000010II', 't': ['user:', 'assistant:']}} AS s1,
         {{'k': '000000005I', 't': ['assistant:']}} AS s2, {{'k': '000000000', 't': []::VARCHAR[]}} AS s3
  FROM facts
  UNION ALL
  SELECT conv_id, r,
         list_min([b0, {_step("s2", "'I'", "5", "'user:'")}]), list_min([b1, {_step("s2", "'I'", "5", "'user:'")}]), s2, s3
  FROM (SELECT conv_id, r, b0, b1, list_min([b2, {_step("b3", "'I'", "5", "'assistant:'")}]) AS s2,
               list_min([b3, {_step("b2", "'I'", "5", "'user:'")}]) AS s3
        FROM (SELECT w.conv_id, w.r - 1 AS r, {_options(0)} AS b0, {_options(1)} AS b1, {_options(2)} AS b2, {_options(3)} AS b3
              FROM walk w JOIN named_faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.r = w.r WHERE w.r > 0)))
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(substr(w.s0.k, 1, 9)::BIGINT, 0) AS cost,
       coalesce(substr(w.s0.k, 10), '') AS audit, sha256(coalesce(array_to_string(w.s0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN walk w ON w.r = 0 AND w.conv_id IS NOT DISTINCT FROM e.conv_id
"""


DIVERGENCE = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {LOWER.format(x="coalesce(text, '')")} AS text
  FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY ALL),
used AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
pairs_of AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM pairs_of LEFT JOIN used USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT s.lang, s.source, k.term, coalesce(u.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(u.n, 0) + 2) // (s.n + 2 * l.v)::HUGEINT AS p,
         1 + 1000000000::HUGEINT * (k.n + 2) // (l.n + 2 * l.v)::HUGEINT AS q
  FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN used u ON u.lang = s.lang AND u.source = s.source AND u.term = k.term),
measured AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM pairs_of a JOIN pairs_of b ON a.lang = b.lang AND a.source <> b.source
  WHERE a.lang NOT IN (SELECT lang FROM langs)
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM measured)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
