"""DuckDB SQL for the operators that SQL can express; each is written from the contract, by brute force."""

from __future__ import annotations

from pagetone.llm.license_scan import CONTAINMENT, NOTICES, PHRASES, STRIDE, WIDTH

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '{_WORD}')"


def _values(rows) -> str:
    return ", ".join("('" + "', '".join(row) + "')" for row in rows)


# Every block is compared with every notice; phrases are looked for at every place of the whole document.
LICENSE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
phrases AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES {_values(PHRASES)}) t(p, label)),
notices AS (SELECT list_distinct(string_split(p, ' ')) AS p, label, string_split(naming, ' ') AS naming FROM (VALUES {_values(NOTICES)}) t(p, label, naming)),
words AS (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
places AS (SELECT d.r, s.i, label FROM words s JOIN phrases ON s.word = p[1] JOIN d ON d.r = s.r
           WHERE d.w[s.i + 1 : s.i + len(p)] = p),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
blocks AS (SELECT r, w[b0 + 1 : b0 + {WIDTH}] AS block
           FROM (SELECT r, w, unnest(range(0, len(w), {STRIDE})) AS b0 FROM d)),
held AS (SELECT r, label, len(list_intersect(p, block)) / len(p) AS c FROM blocks, notices
         WHERE len(list_intersect(p, block)) >= ceil({CONTAINMENT} * len(p) - 1e-9) AND list_has_all(block, naming)),
every AS (SELECT r, label, 1.0::DOUBLE AS c FROM places UNION ALL SELECT r, label, c FROM held),
labels AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS score FROM every GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN labels USING (r)
"""

# Every pair of a query and another vector.
TOPK_SQL = """
WITH raw AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM raw),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 10
"""

# Every window of an item's size that shares a shingle with it; the best of each item. Item sizes are matched by
# shingles alone, without fingerprints.
DECONTAMINATE_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, w, len(w) AS n FROM b WHERE len(w) >= 5),
item_shingles AS (SELECT item_id, n, sh, count(*) AS c FROM (
    SELECT item_id, n, unnest(list_transform(range(1, n - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS sh FROM items) GROUP BY ALL),
doc_shingles AS (SELECT r, len(w) AS total, unnest(range(0, len(w) - 4)) AS pos,
                 unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS sh FROM d WHERE len(w) >= 5),
shared AS (SELECT r, total, pos, s.item_id, s.n, s.sh, s.c FROM doc_shingles JOIN item_shingles s USING (sh)),
starts AS (SELECT DISTINCT r, item_id, n, unnest(range(greatest(0, least(pos - n + 5, total - n)), greatest(0, least(pos, total - n)) + 1)) AS start FROM shared),
counts AS (SELECT t.r, t.item_id, t.n, t.start, s.sh, least(count(*), any_value(s.c)) AS c FROM starts t JOIN shared s
           ON t.r = s.r AND t.item_id = s.item_id AND s.pos >= t.start AND s.pos <= t.start + t.n - 5 GROUP BY ALL),
shares AS (SELECT r, item_id, sum(c) / any_value(n - 4) AS similarity FROM counts GROUP BY r, item_id, n, start),
best AS (SELECT r, item_id, max(similarity) AS similarity FROM shares WHERE similarity >= 0.8 GROUP BY r, item_id),
found AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items, max(similarity) AS similarity
          FROM best GROUP BY r)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items, '') AS items,
       coalesce(similarity, 0.0)::DOUBLE AS similarity FROM d LEFT JOIN found USING (r)
"""

# crc32 byte by byte, faults by comparing every row with all earlier ones, and the edits by a walk over the rows that
# keeps, for each of the four ends, the least (cost, edits) with the lines written so far.
def _cheapest(*options: str) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))[1]"


def _edit(state: str, letter: str, cost: str, line: str | None = None, when: str = "true") -> str:
    lines = f"{state}.t" if line is None else f"{state}.t || [{line}]"
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'p': {state}.p || '{letter}', 't': {lines}}} END"


_TO_USER = [f"{_edit(x, 'K', 'pay', 'own', keep)}, {_edit(x, 'R', 'pay + 1', 'as_user', 'NOT gone')}"
            for x in ("e", "s", "a") for keep in ("NOT gone AND ini = 'u'",)]
_STEP_E, _STEP_S = _cheapest(_edit("e", "D", "2")), _cheapest(_edit("s", "D", "2"), _edit("e", "K", "pay", "own", "NOT gone AND ini = 's'"))
_STEP_U = _cheapest(_edit("u", "D", "2"), *_TO_USER)
_STEP_A = _cheapest(_edit("a", "D", "2"), _edit("u", "K", "pay", "own", "NOT gone AND ini = 'a'"), _edit("u", "R", "pay + 1", "as_assistant", "NOT gone"))
_PATH = "STRUCT(c BIGINT, p VARCHAR, t VARCHAR[])"
CONVERSATIONS_SQL = rf"""
WITH RECURSIVE crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) r(i))),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS k FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(k, lambda x: ascii(x)::BIGINT)),
  lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM raw, crc_table),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last FROM damaged),
rows AS (SELECT *, substr(role, 1, 1) AS ini, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate'
  WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM numbered),
pairs AS (SELECT *, CASE WHEN i > 1 THEN lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini END AS pair FROM rows),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id),
steps AS (SELECT conv_id, i, ini, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS pay,
  role || ':' || text AS own, 'user:' || text AS as_user, 'assistant:' || text AS as_assistant FROM rows),
walk AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'p': '', 't': []::VARCHAR[]}}::{_PATH} AS e, NULL::{_PATH} AS s,
    {{'c': 5::BIGINT, 'p': 'I', 't': ['user:']}}::{_PATH} AS u, {{'c': 10::BIGINT, 'p': 'II', 't': ['user:', 'assistant:']}}::{_PATH} AS a FROM raw
  UNION ALL
  SELECT conv_id, i, e, s, u, {_cheapest('a', _edit('u', 'I', '5', "'assistant:'"))} FROM (
    SELECT conv_id, i, e, s, a, {_cheapest('u', *[_edit(x, 'I', '5', "'user:'") for x in ('e', 's', 'a')])} AS u FROM (
      SELECT w.conv_id, r.i, {_STEP_E} AS e, {_STEP_S} AS s, {_STEP_U} AS u, {_STEP_A} AS a
      FROM walk w JOIN steps r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1))),
ends AS (SELECT conv_id, {_cheapest('e', 'a')} AS best FROM walk
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)
SELECT n.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.p AS audit,
  sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM ends n LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM n.conv_id
"""

# Every phrase at every place, counted; every cut; every longer phrase. HUGEINT keeps the products exact.
PHRASES_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, k AS words, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
           FROM w, range(1, 4) r(k)),
f AS (SELECT lang, words, phrase, count(*) AS n FROM places GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
candidates AS (SELECT lang, words, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND n >= 10),
cuts AS (SELECT *, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM candidates, range(1, 3) r(k) WHERE k < words),
scored AS (SELECT c.lang, c.words, c.phrase, c.a, min({{'score': (1000000::HUGEINT * c.a * c.a // (x.n::HUGEINT * y.n))::BIGINT, 'k': k, 'l': x.n, 'r': y.n}}) AS cut
           FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp GROUP BY ALL),
inner_pairs AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM candidates WHERE words = 3),
hidden AS (SELECT lang, phrase, max(a) AS longest FROM inner_pairs GROUP BY ALL),
ranked AS (SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY cut.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, cut.l AS l, cut.r AS r, cut.score AS score
           FROM scored s LEFT JOIN hidden h ON h.lang = s.lang AND h.phrase = s.phrase WHERE h.longest IS NULL OR 100 * h.longest < 50 * s.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

ORACLE = {"op1_license_scan": LICENSE_SQL, "op5_topk": TOPK_SQL, "op7_decontaminate": DECONTAMINATE_SQL,
          "op12_phrases": PHRASES_SQL, "op13_conversations": CONVERSATIONS_SQL}
