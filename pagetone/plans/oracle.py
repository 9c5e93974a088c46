"""DuckDB SQL that computes every registered query again from the driver's tables.

The derived tables are spelled out as structured rows, so most answers do not read stream text at all: what
Spark finds by matching text, the SQL knows from the integers the text was made of.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def _sql(name: str, body: str, *ctes: str) -> None:
    """Register one query with the named table expressions it needs, in order and without repeats."""
    seen: list[str] = []

    def need(key: str) -> None:
        for other in _NEEDS.get(key, ()):
            need(other)
        if key not in seen:
            seen.append(key)

    for key in ctes:
        need(key)
    recursive = "RECURSIVE " if any(k in _RECURSIVE for k in seen) else ""
    head = "WITH " + recursive + ",\n".join(f"{k} AS ({_CTES[k]})" for k in seen) + "\n" if seen else ""  # a body may go on with ", name AS"
    ORACLE[name] = head + body


def _num(x: str) -> str:
    return f"(({x}) // 100)::VARCHAR || '.' || lpad((({x}) % 100)::VARCHAR, 2, '0')"


def _gray4(v: str) -> str:
    return f"(round(printf('%.30f', {v})::DECIMAL(38,30), 4)::DECIMAL(18,4)::VARCHAR)"


def _luma(r: str, g: str, b: str) -> str:
    return f"(0.299::DOUBLE * {r} + 0.587::DOUBLE * {g} + 0.114::DOUBLE * {b})"


def _luma_cmyk(c: str, m: str, y: str, k: str) -> str:
    parts = [f"((1.0::DOUBLE - {x}) * (1.0::DOUBLE - {k}))" for x in (c, m, y)]
    return _luma(*parts)


def _gain(v: str, gain: int) -> str:
    x = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {v}))"
    if gain == 0:
        return v
    if gain == 25:
        return f"sqrt({x})"
    if gain == 20:
        dot = f"((1.8::DOUBLE - sqrt(0.04::DOUBLE + 3.2::DOUBLE * {x})) / 1.6::DOUBLE)"
        return f"(1.0::DOUBLE - greatest(0.0::DOUBLE, least(1.0::DOUBLE, {dot})))"
    return x


def _round(v: str) -> str:
    return f"floor({v} + 0.5::DOUBLE)::INT"


def _gain8(v: str, gain: int) -> str:
    return v if gain == 0 else _round(_gain(f"(({v}) / 255.0::DOUBLE)", gain) + " * 255.0::DOUBLE")


_A, _B, _C, _D = (_num(x) for x in ("ia", "ib", "ic", "id"))
_X = _num("least(ia + m3, 100)")
_IMAGES = ["BI\\n/W 2 /H 2 /CS /RGB /BPC 8\\nID\\nabcdefghijkl\\nEI", "BI\\n/W 4 /H 4 /CS /G\\nID\\n\\nEI 0.5 scn(a)\\nz\\nEI",
           "BI\\n/W 2 /H 2 /CS /RGB /F /Fl\\nID\\nabcdefg\\nEI",
           "BI\\n/Width 2 /Height 2 /ColorSpace /DeviceCMYK /BitsPerComponent 8\\nID\\nabcdefghijklmnop\\nEI",
           "BI\\n/W 2 /H 2 /CS /RGB /BPC 4\\nID\\nabcdef\\nEI"]
_IMAGE = "CASE n " + " ".join(f"WHEN {i} THEN E'{t}'" for i, t in enumerate(_IMAGES)) + " END"
_DEEP = "repeat('{}', CASE n WHEN 0 THEN 40 ELSE 0 END)"
_ABC = f"{_A} || ' ' || {_B} || ' ' || {_C}"
_ABCD = f"{_ABC} || ' ' || {_D}"

# Text of one line, by its form.
_FORMS = {
    0: f"{_ABC} || ' rg'", 1: f"{_ABC} || ' RG'", 2: f"{_ABCD} || ' k'", 3: f"{_ABCD} || ' K'",
    4: f"{_ABC} || ' scn'", 5: f"{_ABCD} || ' SCN'", 6: f"substr({_A}, 2) || ' ' || {_B} || ' ' || {_C} || ' sc'",
    7: f"{_ABCD} || ' SC'", 8: "'/C' || n || ' cs'", 9: "'/C' || n || ' CS'", 10: f"{_A} || ' scn'",
    11: f"{_A} || ' SCN'", 12: f"{_A} || ' ' || {_B} || ' SC'", 13: f"{_D} || ' ' || {_ABCD} || ' scn'",
    14: "'/P' || n || ' scn'", 15: f"'(' || {_ABC} || ' rg) Tj'", 16: f"'<0A' || substr({_A}, 3) || '> Tj'",
    17: "'/S' || n || ' sh'", 18: f"{_A} || ' ' || {_A} || ' ' || {_X} || ' rg'", 19: _IMAGE,
    20: f"{_DEEP.format('(')} || '(x (y) ' || {_ABC} || ' rg z)' || {_DEEP.format(')')} || ' Tj'", 21: f"'q 1 0 0 1 ' || {_A} || ' ' || {_B} || ' cm'",
    22: f"{_A} || ' g'", 23: f"{_A} || ' ' || {_B} || ' rg'",
}
_LINE = "CASE t " + " ".join(f"WHEN {k} THEN {v}" for k, v in _FORMS.items()) + " END"
_PARTS = ("(v // 24) % 101 AS ia, (v * 3 + idx) % 101 AS ib, (v * 5 + L) % 101 AS ic, (idx + L) % 101 AS id, "
          "v % 5 AS n, idx % 3 AS m3, v % 24 AS t")
_DOUBLES = "ia / 100.0::DOUBLE AS a, ib / 100.0::DOUBLE AS b, ic / 100.0::DOUBLE AS c, id / 100.0::DOUBLE AS d"
_FILTER = ("CASE ({k}) % 6 WHEN 0 THEN ['/FlateDecode'] WHEN 1 THEN ['/Fl'] WHEN 2 THEN []::VARCHAR[] "
           "WHEN 3 THEN ['/DCTDecode'] WHEN 4 THEN ['/FlateDecode', '/DCTDecode'] END")
_READABLE = "CASE WHEN f IS NULL OR len(f) = 0 THEN 'raw' WHEN f[1] IN ('/FlateDecode', '/Fl') THEN 'flate' ELSE 'unreadable' END"
_DIFFERS = "(abs({0} - {1}) > 0.01::DOUBLE OR abs({1} - {2}) > 0.01::DOUBLE)"
_INKED = "({0} > 0.01::DOUBLE OR {1} > 0.01::DOUBLE OR {2} > 0.01::DOUBLE)"


def _ops(keys: str, source: str) -> str:
    """Audit view of colour calls: kind stage, operands, sample. Calls at the very end are not seen."""
    pick = "CASE t " + " ".join(f"WHEN {k} THEN {v}" for k, v in {
        **{k: _FORMS[k] for k in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 18, 23)},
        20: f"{_ABC} || ' rg'"}.items()) + " END"
    return f"""SELECT {keys}, pos, t, n,
  CASE WHEN t IN (0, 1, 18, 20) THEN 'rgb' WHEN t IN (2, 3) THEN 'cmyk' WHEN t IN (8, 9) THEN 'space'
       WHEN t = 14 THEN 'pattern' WHEN t = 23 THEN 'short' ELSE 'generic' END AS stage,
  CASE t WHEN 4 THEN 3 WHEN 5 THEN 4 WHEN 6 THEN 3 WHEN 7 THEN 4 WHEN 10 THEN 1 WHEN 11 THEN 1 WHEN 12 THEN 2
         WHEN 13 THEN 5 END AS n_args,
  CASE WHEN t = 6 THEN (ia % 100) / 100.0::DOUBLE ELSE a END AS x1,
  CASE WHEN t = 18 THEN a ELSE b END AS x2,
  CASE WHEN t = 18 THEN least(ia + m3, 100) / 100.0::DOUBLE ELSE c END AS x3, d AS x4,
  regexp_extract({pick}, '[A-Za-z]+$') AS op, {pick} AS sample
FROM {source} WHERE (t IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 18, 23) AND NOT is_last) OR t = 20"""


def _hits(keys: str, ops: str, lines: str) -> str:
    """Hits of the audit per stream: stage number, kind, position, sample."""
    named = "'(/' || CASE WHEN stage = 'space' THEN 'C' ELSE 'P' END || n || ')'"
    return f"""SELECT {keys}, pos, sample,
  CASE stage WHEN 'rgb' THEN 0 WHEN 'cmyk' THEN 1 WHEN 'generic' THEN 2 WHEN 'space' THEN 3 ELSE 4 END AS stage_no,
  CASE WHEN stage IN ('space', 'pattern') THEN stage || {named}
       WHEN stage = 'generic' THEN 'generic' || n_args ELSE stage END AS kind,
  row_number() OVER (PARTITION BY {keys} ORDER BY pos) - 1 AS idx,
  CASE stage WHEN 'rgb' THEN {_DIFFERS.format('x1', 'x2', 'x3')} WHEN 'cmyk' THEN {_INKED.format('x1', 'x2', 'x3')}
    WHEN 'generic' THEN (n_args = 3 AND {_DIFFERS.format('x1', 'x2', 'x3')})
      OR (n_args = 4 AND {_INKED.format('x1', 'x2', 'x3')}) WHEN 'short' THEN false ELSE true END AS hit
FROM {ops}
UNION ALL
SELECT DISTINCT {keys}, 0, 'BI...', 5, 'inline_image', 0, true FROM {lines} WHERE t = 19
UNION ALL
SELECT DISTINCT {keys}, 0, 'sh', 6, 'shading', 0, true FROM {lines} WHERE t = 17 AND NOT is_last"""


def _summary(keys: str, hits: str) -> str:
    return f"""SELECT {keys}, stage_no, kind, count(*) AS n, min(idx) AS first_idx,
  substr(arg_min(sample, idx), 1, 40) AS sample FROM {hits} WHERE hit GROUP BY ALL"""


_OBJECT_COLUMNS = ("doc_id, obj_no, kind, subtype, w, h, cs_obj, f, is_mask, has_smask, has_decode, shading_type, "
                   "pattern_type, target_obj, length")
_STREAM = "doc_id, page_no, stream_id"

_CTES = {
    "intake": """SELECT c_custkey AS doc_id, '/in/' || c_name || CASE c_custkey % 13 WHEN 5 THEN '..' WHEN 6 THEN '.old.' ELSE '.' END || (['pdf', 'hwp', 'hwpx', 'doc', 'docx', 'xls',
  'xlsx', 'ppt', 'pptx', 'txt', 'PDF'])[c_custkey % 11 + 1] AS path, c_custkey * 37 AS length FROM customer""",
    "routed": """SELECT doc_id, path, length, lower(regexp_extract(path, '\\.([a-zA-Z]+)$', 1)) AS ext,
  CASE WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('hwp', 'hwpx') THEN 'hwp' WHEN ext IN ('doc', 'docx') THEN 'word'
       WHEN ext IN ('xls', 'xlsx') THEN 'excel' WHEN ext IN ('ppt', 'pptx') THEN 'powerpoint' END AS family FROM intake""",
    "requested": """SELECT *, try_cast(trim(item) AS INT) AS page_no FROM (SELECT o_orderkey AS doc_id, o_orderkey % 7 + 1 AS page_count,
  unnest(string_split('1,' || (o_custkey % 12) || ',9' || CASE o_orderkey % 5 WHEN 0 THEN ',x' WHEN 1 THEN ',99999999999' ELSE '' END, ',')) AS item
  FROM orders)""",
    "words": """SELECT doc_id, u.i - 1 AS idx, length(u.w) AS L, n_words
FROM (SELECT doc_id, ws, len(ws) AS n_words FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)), unnest(ws) WITH ORDINALITY AS u(w, i)""",
    "lines": f"""SELECT doc_id, idx // 48 + 1 AS page_no, idx // 24 AS stream_id, idx % 24 AS pos, {_PARTS}, {_DOUBLES},
  idx % 24 = 23 OR idx = n_words - 1 AS is_last
FROM (SELECT *, doc_id * 31 + idx * 17 + L * 7 AS v FROM words)""",
    "streams": f"""SELECT doc_id, page_no, stream_id, {_FILTER.format(k='doc_id + stream_id')} AS f
FROM (SELECT DISTINCT doc_id, page_no, stream_id FROM lines)""",
    "texts": f"SELECT {_STREAM}, string_agg({_LINE}, chr(10) ORDER BY pos) AS text FROM lines GROUP BY ALL",
    "ops": _ops(_STREAM, "lines"),
    "hits": _hits(_STREAM, "ops", "lines"),
    "summary": _summary(_STREAM, "hits"),
    # Rewriter view: segments, colour spaces in force, calls.
    "segmented": f"""SELECT *, sum(CASE WHEN t IN (15, 16, 19, 20) THEN 1 ELSE 0 END) OVER (
  PARTITION BY {_STREAM} ORDER BY pos) AS segment FROM lines""",
    "spaces": f"""SELECT *, last_value(fill IGNORE NULLS) OVER w AS fill_now, last_value(stroke IGNORE NULLS) OVER w AS stroke_now
FROM (SELECT {_STREAM}, segment, arg_max(CASE WHEN t = 8 THEN 'C' || n END, CASE WHEN t = 8 THEN pos END) AS fill,
        arg_max(CASE WHEN t = 9 THEN 'C' || n END, CASE WHEN t = 9 THEN pos END) AS stroke FROM segmented GROUP BY ALL)
WINDOW w AS (PARTITION BY {_STREAM} ORDER BY segment)""",
    "calls": f"""SELECT s.*, CASE WHEN t IN (1, 3, 5, 7, 11, 12) THEN stroke_now ELSE fill_now END AS space,
  CASE WHEN t = 12 THEN {_B} || ' SC' WHEN t = 13 THEN {_ABCD} || ' scn' WHEN t = 6 THEN {_FORMS[6]}
       WHEN t = 14 THEN n || ' scn' ELSE {_LINE} END AS call,
  CASE WHEN t IN (0, 1, 4, 6, 18) THEN 3 WHEN t IN (2, 3, 5, 7, 13) THEN 4 ELSE 1 END AS n_args,
  CASE WHEN t = 6 THEN (ia % 100) / 100.0::DOUBLE WHEN t = 12 THEN b WHEN t = 14 THEN n::DOUBLE ELSE a END AS x1,
  CASE WHEN t = 18 THEN a ELSE b END AS x2,
  CASE WHEN t = 18 THEN least(ia + m3, 100) / 100.0::DOUBLE ELSE c END AS x3, d AS x4,
  CASE WHEN t IN (1, 3, 5, 7, 11, 12) THEN 'G' ELSE 'g' END AS gray_op,
  row_number() OVER (PARTITION BY {_STREAM}, segment ORDER BY pos) - 1 AS ordinal
FROM segmented s JOIN spaces USING ({_STREAM}, segment)
WHERE t IN (0, 1, 2, 3, 4, 5, 6, 7, 10, 11, 12, 13, 14, 18)""",
    "colorspaces": """SELECT doc_id, 'C' || n AS name, kind = 4 AND doc_id % 3 = 0 AS is_pattern,
  CASE WHEN is_pattern THEN NULL ELSE (doc_id % 3 + 1)::DOUBLE END AS fn_n,
  CASE WHEN NOT is_pattern THEN list_transform(range(1, CASE kind WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE 3 END),
    lambda c: ((doc_id + n + c * 7) % 11) / 10.0::DOUBLE) END AS c1,
  CASE kind WHEN 1 THEN '/DeviceCMYK' WHEN 2 THEN '/DeviceRGB' WHEN 3 THEN '/DeviceGray' ELSE '/Lab' END AS alt
FROM (SELECT doc_id, n, (doc_id + n) % 5 AS kind FROM documents, range(0, 5) r(n)) WHERE kind <> 0""",
    "tints": """SELECT doc_id, name, step, step / 10.0::DOUBLE AS t, alt, fn_n,
  list_transform(c1, lambda x: 0.0::DOUBLE + pow(step / 10.0::DOUBLE, fn_n) * (x - 0.0::DOUBLE)) AS ch
FROM colorspaces, range(0, 11) r(step) WHERE NOT is_pattern""",
    # Objects.
    "parts": "SELECT p_partkey // 128 AS doc_id, (p_partkey % 128)::INT AS obj_no, p_size AS size, p_type FROM part",
    "objects": f"""SELECT doc_id, obj_no, CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN 'XObject' WHEN p_type = 'MEDIUM' THEN 'Shading'
    WHEN p_type IN ('PROMO', 'SMALL') THEN 'Pattern' ELSE 'ExtGState' END AS kind,
  CASE p_type WHEN 'ECONOMY' THEN '/Image' WHEN 'LARGE' THEN '/Form' END AS subtype,
  CASE WHEN p_type = 'ECONOMY' THEN size END AS w, CASE WHEN p_type = 'ECONOMY' THEN size + 3 END AS h,
  CASE WHEN obj_no % 11 = 0 THEN NULL WHEN obj_no % 17 = 3 THEN 500 ELSE obj_no * 7 % 128 END AS cs_obj,
  {_FILTER.format(k='size')} AS f, CASE size % 9 WHEN 0 THEN true WHEN 1 THEN false END AS is_mask,
  size % 2 = 0 AS has_smask, size % 5 = 0 AS has_decode, CASE WHEN p_type = 'MEDIUM' THEN size % 7 + 1 END AS shading_type,
  CASE p_type WHEN 'PROMO' THEN 2 WHEN 'SMALL' THEN 1 END AS pattern_type,
  CASE p_type WHEN 'PROMO' THEN obj_no * 3 % 128 WHEN 'STANDARD' THEN obj_no + 1000 END AS target_obj,
  (size * 10)::BIGINT AS length FROM parts
UNION ALL SELECT doc_id, obj_no + 1000, 'SMask', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  obj_no // 2 + 2000, NULL FROM parts WHERE p_type = 'STANDARD'
UNION ALL SELECT doc_id, obj_no // 2 + 2000, 'Group', '/Form', NULL, NULL, NULL, {_FILTER.format(k='obj_no')}, NULL, NULL,
  NULL, NULL, NULL, NULL, NULL FROM parts WHERE obj_no % 2 = 0""",
    "object_lines": f"""SELECT doc_id, obj_no, f, idx AS pos, {_PARTS}, {_DOUBLES}, false AS is_last
FROM (SELECT doc_id, obj_no, f, j AS idx, obj_no % 10 AS L, (doc_id * 128 + obj_no) * 13 + j * 5 AS v
      FROM objects, range(0, 6) r(j) WHERE subtype = '/Form' OR pattern_type = 1)""",
    "object_ops": _ops("doc_id, obj_no", "object_lines"),
    "object_hits": _hits("doc_id, obj_no", "object_ops", "object_lines"),
    "object_summary": _summary("doc_id, obj_no", "object_hits"),
    "cs_defs": """SELECT doc_id, obj_no AS cs_obj, (['/DeviceRGB', '/DeviceCMYK', '/DeviceGray', '/ICCBased', '/Indexed',
    '/Separation', '/CalGray'])[size % 7 + 1] AS family,
  CASE WHEN size % 7 = 3 AND size % 8 <> 7 THEN size % 4 + 1 END AS n,
  CASE WHEN obj_no % 13 = 5 THEN 600 WHEN obj_no > 0 THEN obj_no - 1 END AS before,
  CASE WHEN size % 7 = 3 THEN 2 WHEN size % 7 IN (4, 5) THEN 4 WHEN size % 7 = 6 AND size % 2 = 0 THEN 2 END AS size FROM parts""",
    "chains": """SELECT d.doc_id, d.cs_obj AS start_obj, d.cs_obj, ''::VARCHAR AS prefix, ''::VARCHAR AS suffix FROM cs_defs d
UNION ALL
SELECT c.doc_id, c.start_obj, d.before,
  c.prefix || CASE WHEN d.family = '/Indexed' THEN '[/Indexed base=' ELSE '[' || d.family || ' alt=' END, ']' || c.suffix
FROM chains c JOIN cs_defs d ON d.doc_id = c.doc_id AND d.cs_obj = c.cs_obj
WHERE d.family IN ('/Indexed', '/Separation')""",
    "labels": """SELECT c.doc_id, c.start_obj AS cs_obj, c.prefix || CASE WHEN c.cs_obj IS NULL THEN '(none)' WHEN d.cs_obj IS NULL THEN '(?)'
    WHEN d.size IS NULL THEN d.family WHEN d.family = '/ICCBased' THEN '[/ICCBased N=' || coalesce(d.n::VARCHAR, 'null') || ']'
    ELSE '[' || d.family || ' size=' || d.size || ']' END || c.suffix AS label
FROM chains c LEFT JOIN cs_defs d ON d.doc_id = c.doc_id AND d.cs_obj = c.cs_obj
WHERE coalesce(d.family, '') NOT IN ('/Indexed', '/Separation')""",
    "edges": """SELECT DISTINCT doc_id, p AS parent_obj, obj_no AS child_obj, CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN 'XObject'
    WHEN p_type = 'MEDIUM' THEN 'Shading' WHEN p_type IN ('PROMO', 'SMALL') THEN 'Pattern' ELSE 'ExtGState' END AS category
FROM (SELECT *, unnest([CASE WHEN obj_no > 0 THEN obj_no // 4 END, CASE WHEN obj_no > 0 AND obj_no % 3 <> 0 THEN obj_no // 3 END,
    CASE WHEN obj_no % 5 = 1 THEN obj_no // 2 + 2000 END, CASE WHEN obj_no < 24 THEN obj_no % 4 + 3001 END,
    CASE WHEN obj_no < 24 AND obj_no % 3 = 0 THEN (obj_no + 1) % 4 + 3001 END]) AS p FROM parts) WHERE p IS NOT NULL
UNION ALL SELECT doc_id, obj_no // 4, obj_no // 2 + 2000, 'XObject' FROM parts WHERE obj_no % 12 = 8""",
    "entries": """SELECT e.doc_id, e.parent_obj, o.obj_no, '/R' || e.child_obj AS name,
  CASE e.category WHEN 'XObject' THEN 0 WHEN 'Shading' THEN 1 ELSE 2 END * 4294967296 + e.child_obj AS rank,
  CASE WHEN o.subtype = '/Image' THEN 'image' WHEN o.subtype = '/Form' THEN 'form' WHEN e.category = 'Shading' THEN 'shading'
       WHEN o.pattern_type = 2 THEN 'shading_pattern' ELSE 'tiling' END AS role,
  o.cs_obj, o.f, o.is_mask, o.shading_type, o.target_obj
FROM edges e JOIN objects o ON o.doc_id = e.doc_id AND o.obj_no = e.child_obj WHERE e.category <> 'ExtGState'
UNION ALL
SELECT e.doc_id, e.parent_obj, g.obj_no, '/R' || e.child_obj, 3 * 4294967296 + e.child_obj, 'softmask', g.cs_obj, g.f, g.is_mask,
  g.shading_type, g.target_obj
FROM edges e JOIN objects o ON o.doc_id = e.doc_id AND o.obj_no = e.child_obj
JOIN objects m ON m.doc_id = e.doc_id AND m.obj_no = o.target_obj
JOIN objects g ON g.doc_id = e.doc_id AND g.obj_no = m.target_obj WHERE e.category = 'ExtGState'""",
    # The streams that pages name, and where the walk of each page starts.
    "uses": """SELECT doc_id, p + 1 AS page_no, u.i - 1 AS ordinal, u.s AS stream_id FROM (
  SELECT doc_id, p, list_filter(CASE p % 6 WHEN 0 THEN [2 * p, 2 * p + 1] WHEN 1 THEN [2 * p + 1, 2 * p] WHEN 2 THEN [2 * p + 1, 2 * p, 2 * p + 1]
      WHEN 3 THEN [0, 2 * p, 2 * p + 1] WHEN 4 THEN [2 * p, 900000, 2 * p + 1] END, lambda x: x < n OR x = 900000) AS contents
  FROM (SELECT doc_id, (len(string_split(text, ' ')) - 1) // 24 + 1 AS n FROM documents), range(0, (n - 1) // 2 + 1) r(p)),
  unnest(contents) WITH ORDINALITY AS u(s, i)""",
    "page_nodes": """SELECT doc_id, CASE WHEN obj_no < 4 THEN obj_no + 1 ELSE obj_no + 7 END AS node_id,
  CASE WHEN obj_no < 2 THEN 11 WHEN obj_no < 4 THEN 12 WHEN obj_no < 6 THEN 13 END AS parent_id, obj_no < 4 AS is_page,
  CASE WHEN obj_no = 0 OR (obj_no = 3 AND doc_id % 4 <> 2) THEN obj_no + 3001 WHEN obj_no = 4 THEN 3002
       WHEN obj_no = 6 AND doc_id % 3 <> 1 THEN 3003 END AS res FROM parts WHERE obj_no < 7""",
    "page_climb": """SELECT doc_id, node_id AS page_no, parent_id, res FROM page_nodes WHERE is_page
UNION ALL SELECT c.doc_id, c.page_no, t.parent_id, t.res FROM page_climb c JOIN page_nodes t ON t.doc_id = c.doc_id AND t.node_id = c.parent_id
WHERE c.res IS NULL""",
    "paths": """SELECT doc_id, page_no::BIGINT AS page_no, res AS obj_no, 'page' AS role, 0 AS depth, []::BIGINT[] AS path,
  '' AS "where", NULL::VARCHAR AS anchor_role, NULL::INT AS anchor_obj, []::BIGINT[] AS anchor_path FROM page_climb WHERE res IS NOT NULL
UNION ALL
SELECT p.doc_id, p.page_no, e.obj_no, e.role, p.depth + 1, list_append(p.path, e.rank),
  p."where" || CASE e.role WHEN 'form' THEN 'Form>' WHEN 'tiling' THEN 'Tile>' ELSE 'SMask>' END,
  CASE WHEN e.role = 'tiling' THEN p.anchor_role ELSE e.role END, CASE WHEN e.role = 'tiling' THEN p.anchor_obj ELSE e.obj_no END,
  CASE WHEN e.role = 'tiling' THEN p.anchor_path ELSE list_append(p.path, e.rank) END
FROM paths p JOIN entries e ON e.doc_id = p.doc_id AND e.parent_obj = p.obj_no
WHERE e.role IN ('form', 'tiling', 'softmask') AND p.depth <= 5""",
    "first": """SELECT doc_id, obj_no, role, min({'page': page_no, 'path': path}) AS v FROM paths
WHERE role IN ('form', 'softmask') GROUP BY doc_id, obj_no, role""",
    "visits": """SELECT p.doc_id, p.page_no, p.obj_no, p.role, p.depth, p."where", min(p.path) AS path FROM paths p
LEFT JOIN first f ON f.doc_id = p.doc_id AND f.obj_no = p.anchor_obj AND f.role = p.anchor_role
WHERE p.anchor_obj IS NULL OR (p.page_no = f.v.page AND p.anchor_path = f.v.path)
GROUP BY p.doc_id, p.page_no, p.obj_no, p.role, p.depth, p."where", p.anchor_role, p.anchor_obj, p.anchor_path""",
    "labelled": """SELECT e.*, CASE WHEN e.cs_obj IS NULL THEN '(none)' ELSE coalesce(l.label, '(?)') END AS label
FROM entries e LEFT JOIN labels l ON l.doc_id = e.doc_id AND l.cs_obj = e.cs_obj""",
    "painted": """SELECT e.doc_id, e.parent_obj, e.name, e.rank, o.shading_type,
  CASE WHEN o.obj_no IS NULL THEN '?' WHEN o.cs_obj IS NULL THEN '(none)' ELSE coalesce(l.label, '(?)') END AS label
FROM entries e LEFT JOIN objects o ON o.doc_id = e.doc_id AND o.obj_no = e.target_obj
LEFT JOIN labels l ON l.doc_id = e.doc_id AND l.cs_obj = o.cs_obj WHERE e.role = 'shading_pattern'""",
    "found_images": """SELECT doc_id, parent_obj, name, label, coalesce(f[1], '') AS first_filter, obj_no, rank FROM labelled
WHERE role = 'image' AND is_mask IS NULL AND label NOT IN ('/DeviceGray', '/CalGray', '[/ICCBased N=1]', '(none)')""",
    "found_shadings": """SELECT doc_id, parent_obj, name, label, shading_type, rank FROM labelled
WHERE role = 'shading' AND label NOT IN ('/DeviceGray', '/CalGray', '[/ICCBased N=1]', '(none)')""",
    "found_painted": """SELECT doc_id, parent_obj, name, label, shading_type, rank FROM painted
WHERE label NOT IN ('/DeviceGray', '/CalGray', '[/ICCBased N=1]', '(none)')""",
    "in_containers": f"""SELECT v.doc_id, v.page_no, v.role, array_to_string(list_concat([1::BIGINT], v.path, [-1, s.stage_no, s.first_idx]), '.') AS seq,
  list_concat([1::BIGINT], v.path, [-1, s.stage_no, s.first_idx]) AS seq_list,
  substr(v."where", 1, length(v."where") - CASE v.role WHEN 'softmask' THEN 6 ELSE 5 END) AS "where", s.kind,
  substr(v."where", 1, length(v."where") - CASE v.role WHEN 'softmask' THEN 6 ELSE 5 END)
    || CASE v.role WHEN 'form' THEN 'Form ' WHEN 'tiling' THEN 'TilingPattern ' ELSE 'SMask ' END || s.kind || ' x' || s.n
    || CASE WHEN v.role = 'form' THEN ' (e.g. ' || s.sample || ')' ELSE '' END AS message
FROM visits v JOIN object_summary s ON s.doc_id = v.doc_id AND s.obj_no = v.obj_no
JOIN objects o ON o.doc_id = v.doc_id AND o.obj_no = v.obj_no
WHERE v.role <> 'page' AND (o.f IS NULL OR len(o.f) = 0 OR o.f[1] IN ('/FlateDecode', '/Fl'))""",
    "findings": f"""SELECT s.doc_id, u.page_no, [0::BIGINT, u.ordinal, s.stage_no, s.first_idx] AS seq_list, '' AS "where", s.kind,
  'page stream ' || s.kind || ' x' || s.n || ' (e.g. ' || s.sample || ')' AS message
FROM uses u JOIN summary s ON s.doc_id = u.doc_id AND s.stream_id = u.stream_id
JOIN (SELECT *, {_READABLE} AS r FROM streams) t ON t.doc_id = s.doc_id AND t.stream_id = s.stream_id WHERE r <> 'unreadable'
UNION ALL SELECT i.doc_id, v.page_no, list_concat([1::BIGINT], v.path, [i.rank]), v."where", 'image',
  v."where" || 'image ' || i.name || ' CS=' || i.label || ' Filter=' || i.first_filter || ' obj#' || i.obj_no
FROM found_images i JOIN visits v ON v.doc_id = i.doc_id AND v.obj_no = i.parent_obj AND v.depth <= 5
UNION ALL SELECT i.doc_id, v.page_no, list_concat([1::BIGINT], v.path, [i.rank]), v."where", 'shading',
  v."where" || 'Shading ' || i.name || ' Type=' || coalesce(i.shading_type::VARCHAR, 'null') || ' CS=' || i.label
FROM found_shadings i JOIN visits v ON v.doc_id = i.doc_id AND v.obj_no = i.parent_obj AND v.depth <= 5
UNION ALL SELECT i.doc_id, v.page_no, list_concat([1::BIGINT], v.path, [i.rank]), v."where", 'shading_pattern',
  v."where" || 'ShadingPattern ' || i.name || ' Type=' || coalesce(i.shading_type::VARCHAR, 'null') || ' CS=' || i.label
FROM found_painted i JOIN visits v ON v.doc_id = i.doc_id AND v.obj_no = i.parent_obj AND v.depth <= 5
UNION ALL SELECT doc_id, page_no, seq_list, "where", kind, message FROM in_containers""",
    "distinct_findings": "SELECT doc_id, page_no, message, min(seq_list) AS seq_list FROM findings GROUP BY ALL",
    "suspects": "SELECT doc_id, count(DISTINCT page_no) AS n_pages FROM findings GROUP BY doc_id",
    "tree": """SELECT (r_regionkey + 1)::BIGINT AS node_id, NULL::BIGINT AS parent_id, false AS is_page, r_regionkey + 100 AS res FROM region
UNION ALL SELECT n_nationkey + 101, n_regionkey + 1, false, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 200 END FROM nation
UNION ALL SELECT c_custkey + 1001, c_nationkey + 101, true, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 5000 END FROM customer""",
    "climb": """SELECT node_id, parent_id, res, res IS NULL AS is_inherited FROM tree WHERE is_page
UNION ALL SELECT c.node_id, t.parent_id, t.res, c.is_inherited FROM climb c JOIN tree t ON t.node_id = c.parent_id WHERE c.res IS NULL""",
    # Rasters.
    "rasters": """SELECT *, CASE WHEN NOT is_raw AND image_id % 13 = 0 THEN NULL
    ELSE stride * h - CASE WHEN image_id % 11 = 0 THEN -1 ELSE image_id % 4 END END AS decoded_len, stride * h AS expected_len
FROM (SELECT p_partkey AS image_id, p_size AS w, p_partkey % 9 + 1 AS h, p_partkey % 2 + 3 AS channels,
    CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 15 END AS predictor, p_partkey % 5 <> 0 AS is_raw,
    p_partkey % 10 = 5 AS is_cut, w * channels + CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE 0 END AS stride FROM part)""",
    "raster_states": """SELECT *, CASE WHEN decoded_len IS NULL OR (NOT is_raw AND decoded_len <= 0) THEN 'inflate_fail'
    WHEN decoded_len = expected_len THEN 'ok' WHEN decoded_len < expected_len AND (is_raw OR is_cut) THEN 'padded'
    WHEN predictor >= 10 THEN 'predictor_fail' ELSE 'length_fail' END AS status,
  CASE WHEN predictor >= 10 OR channels = 4 THEN 0 ELSE 255 END AS fill FROM rasters""",
    "samples": """SELECT image_id, y, x, ch, channels, predictor, tag, CASE WHEN i >= decoded_len THEN fill
    WHEN image_id % 7 = 0 AND predictor = 1 THEN 77 ELSE (image_id * 7 + i * (w * 3 + 1)) % 256 END AS v
FROM (SELECT *, y * stride + CASE WHEN predictor >= 10 THEN 1 ELSE 0 END + x * channels + ch AS i,
        CASE WHEN predictor >= 10 THEN CASE WHEN y * stride >= decoded_len THEN 0 ELSE
          CASE WHEN image_id % 8 = 7 THEN y % 5 ELSE CASE image_id % 4 WHEN 3 THEN y % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END END END END AS tag
      FROM raster_states, range(0, h) a(y), range(0, w) b(x), range(0, channels) c(ch) WHERE status IN ('ok', 'padded'))""",
    "pixels": """SELECT image_id, y, x, any_value(channels) AS channels, any_value(predictor) AS predictor, any_value(tag) AS tag,
  max(v) FILTER (ch = 0) AS c1, max(v) FILTER (ch = 1) AS c2, max(v) FILTER (ch = 2) AS c3, max(v) FILTER (ch = 3) AS c4
FROM samples GROUP BY image_id, y, x""",
    "raw_gray": f"""SELECT image_id, y, x, CASE WHEN channels = 4 THEN {_round('255.0::DOUBLE * ' + _luma_cmyk(
        '(c1 / 255.0::DOUBLE)', '(c2 / 255.0::DOUBLE)', '(c3 / 255.0::DOUBLE)', '(c4 / 255.0::DOUBLE)'))}
  ELSE {_round(_luma('c1', 'c2', 'c3'))} END AS gray, channels FROM pixels""",
    "delta": """SELECT image_id, y, x, ch, sum(v) OVER (PARTITION BY image_id, y, ch ORDER BY x) % 256 AS v
FROM samples WHERE predictor = 2""",
    "across": """SELECT image_id, y, x, ch, tag, CASE WHEN tag = 1 THEN sum(v) OVER (PARTITION BY image_id, y, ch ORDER BY x) % 256 ELSE v END AS v
FROM samples WHERE predictor = 15 AND image_id NOT IN (SELECT image_id FROM unsupported)""",
    "unsupported": "SELECT DISTINCT image_id FROM samples WHERE tag IN (3, 4)",
    "raster_failures": """SELECT image_id, status AS error, predictor FROM raster_states WHERE status NOT IN ('ok', 'padded')
UNION ALL SELECT image_id, 'predictor_fail', 15 FROM unsupported""",
    "down": """SELECT image_id, y, x, ch, sum(v) OVER (PARTITION BY image_id, x, ch, block ORDER BY y) % 256 AS v
FROM (SELECT *, sum(CASE WHEN tag <> 2 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, x, ch ORDER BY y) AS block FROM across)""",
    "decoded": """SELECT image_id, y, x, ch, v FROM samples WHERE predictor = 1 UNION ALL SELECT image_id, y, x, ch, v FROM delta
UNION ALL SELECT image_id, y, x, ch, v FROM down""",
    "decoded_pixels": """SELECT image_id, y, x, max(v) FILTER (ch = 0) AS c1, max(v) FILTER (ch = 1) AS c2, max(v) FILTER (ch = 2) AS c3,
  max(v) FILTER (ch = 3) AS c4 FROM decoded GROUP BY image_id, y, x""",
    "gray": f"""SELECT image_id, y, x, CASE WHEN c4 IS NOT NULL THEN {_round('255.0::DOUBLE * ' + _luma_cmyk(
        '(c1 / 255.0::DOUBLE)', '(c2 / 255.0::DOUBLE)', '(c3 / 255.0::DOUBLE)', '(c4 / 255.0::DOUBLE)'))}
  ELSE {_round(_luma('c1', 'c2', 'c3'))} END AS gray FROM decoded_pixels""",
    "classes": """SELECT image_id // 16 AS doc_id, image_id % 16 // 2 + 1 AS page_no,
  count(*) FILTER (greatest(c1, c2, c3) > least(c1, c2, c3)) AS color_px, count(*) AS total_px,
  color_px * 1000000 <= total_px AS is_gray FROM decoded_pixels GROUP BY ALL""",
}
_NEEDS = {
    "routed": ("intake",), "lines": ("words",), "streams": ("lines",), "texts": ("lines",), "ops": ("lines",),
    "hits": ("ops",), "summary": ("hits",), "segmented": ("lines",), "spaces": ("segmented",), "calls": ("spaces",),
    "tints": ("colorspaces",), "objects": ("parts",), "object_lines": ("objects",), "object_ops": ("object_lines",),
    "object_hits": ("object_ops",), "object_summary": ("object_hits",), "cs_defs": ("parts",), "chains": ("cs_defs",),
    "labels": ("chains",), "edges": ("parts",), "entries": ("edges", "objects"), "paths": ("entries", "page_climb"), "page_climb": ("page_nodes",), "page_nodes": ("parts",),
    "first": ("paths",), "visits": ("first",), "labelled": ("entries", "labels"), "painted": ("entries", "labels"),
    "found_images": ("labelled",), "found_shadings": ("labelled",), "found_painted": ("painted",),
    "in_containers": ("visits", "object_summary"),
    "findings": ("summary", "streams", "uses", "found_images", "found_shadings", "found_painted", "in_containers"),
    "distinct_findings": ("findings",), "suspects": ("findings",), "climb": ("tree",),
    "raster_states": ("rasters",), "samples": ("raster_states",), "pixels": ("samples",), "raw_gray": ("pixels",),
    "delta": ("samples",), "across": ("samples", "unsupported"), "unsupported": ("samples",), "raster_failures": ("raster_states", "unsupported"), "gray": ("decoded_pixels",), "down": ("across",), "decoded": ("delta", "down"),
    "decoded_pixels": ("decoded",), "classes": ("decoded_pixels",),
}
_RECURSIVE = ("chains", "paths", "climb", "page_climb")

# --- A ---
_sql("A1_intake", """SELECT doc_id, path, split_part(path, '/', 3) AS name, ext FROM routed WHERE family IS NOT NULL""", "routed")
_sql("A2_route_format", """SELECT doc_id, ext, family,
  CASE WHEN family IS NULL THEN 'unsupported format: .' || ext END AS error FROM routed""", "routed")
_sql("A3_intake_census", "SELECT family, count(*) AS n, sum(length)::BIGINT AS bytes FROM routed GROUP BY family", "routed")
_sql("A4_select_pages", "SELECT doc_id, page_no FROM requested WHERE page_no BETWEEN 1 AND page_count", "requested")
_sql("A5_skipped_pages", """SELECT doc_id, item, page_no, CASE WHEN page_no IS NULL THEN 'no page number' ELSE 'outside the document' END AS reason
FROM requested WHERE page_no IS NULL OR NOT page_no BETWEEN 1 AND page_count""", "requested")
_sql("A6_artifact_name", """SELECT doc_id, regexp_replace(regexp_replace(split_part(path, '/', 3), '\\.[^.]*$', ''), '[^a-zA-Z0-9_]', '_', 'g')
  || '_p' || (doc_id % 7 + 1) || '.png' AS artifact FROM intake""", "intake")
_sql("A7_stream_readability", f"SELECT doc_id, stream_id, {_READABLE} AS readability FROM streams", "streams")
_sql("A8_stream_eligibility", """SELECT doc_id, stream_id, CASE WHEN f IS NULL THEN 'raw'
  WHEN len(f) = 1 AND f[1] IN ('/FlateDecode', '/Fl') THEN 'flate' ELSE 'skipped' END AS eligibility FROM streams""", "streams")

_sql("A9_write_findings", """SELECT "where", kind, count(*) AS n, count(DISTINCT message) AS n_messages FROM findings GROUP BY "where", kind""", "findings")

# --- B ---
_BYTE = """CASE WHEN predictor >= 10 AND ({0}) % stride = 0 THEN CASE WHEN image_id % 8 = 7 THEN ({0}) // stride % 5 ELSE CASE image_id % 4 WHEN 3 THEN ({0}) // stride % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END END
  WHEN image_id % 7 = 0 AND predictor = 1 THEN 77 ELSE (image_id * 7 + ({0}) * (w * 3 + 1)) % 256 END"""
_sql("B1_stream_text", f"""SELECT image_id, decoded_len AS n_chars, {_BYTE.format('0')} AS first_char,
  {_BYTE.format('decoded_len - 1')} AS last_char, true AS same_bytes FROM rasters WHERE decoded_len > 0""", "rasters")
_sql("B2_mask_literals", r"""SELECT doc_id, stream_id, md5(regexp_replace(regexp_replace(text, '\((?:[^()\\]|\\.)*\)', '()', 'g'),
  '<[0-9A-Fa-f\s]*>', '<>', 'g')) AS clean_md5 FROM texts""", "texts")
_sql("B3_protected_regions", f"""SELECT doc_id, stream_id, row_number() OVER (PARTITION BY doc_id, stream_id ORDER BY pos) - 1 AS ordinal,
  CASE t WHEN 15 THEN '(' || {_ABC} || ' rg)' WHEN 16 THEN '<0A' || substr({_A}, 3) || '>' WHEN 19 THEN {_IMAGE}
    ELSE {_DEEP.format('(')} || '(x (y) ' || {_ABC} || ' rg z)' || {_DEEP.format(')')} END AS region,
  CASE t WHEN 16 THEN 'hex' WHEN 19 THEN 'inline_image' ELSE 'literal' END AS kind FROM lines WHERE t IN (15, 16, 19, 20)""", "lines")
_NESTED = r"\((?:[^()\\]|\\.)*\)"
for _ in range(41):
    _NESTED = r"\((?:[^()\\]|\\.|" + _NESTED + r")*\)"
_sql("B4_tokenize", r"""SELECT u.tok, starts_with(u.tok, '(') OR regexp_matches(u.tok, '^<[^<]') AS is_literal, regexp_matches(u.tok, '^\s') AS is_space,
  regexp_matches(u.tok, '^-?(\d+(\.\d+)?|\.\d+)$') AS is_number, count(*) AS n, sum(u.i - 1)::BIGINT AS sum_pos
FROM texts, unnest(regexp_extract_all(text, 'NESTED|<[^<>][^>]*>|\s+|/?[^\s()<>\[\]/]+|.')) WITH ORDINALITY AS u(tok, i)
GROUP BY ALL""".replace("NESTED", _NESTED), "texts")
_sql("B5_with_operands", """SELECT doc_id, op, n_args, name, count(*) AS n, sum(x)::BIGINT AS sum_first, sum(z)::BIGINT AS sum_last FROM (
  SELECT doc_id, u.o.op AS op, u.o.n AS n_args, u.o.name AS name, u.o.x AS x, u.o.z AS z FROM lines, unnest(CASE t
    WHEN 0 THEN [{'op': 'rg', 'n': 3, 'name': NULL::VARCHAR, 'x': ia, 'z': ic}] WHEN 1 THEN [{'op': 'RG', 'n': 3, 'name': NULL, 'x': ia, 'z': ic}]
    WHEN 2 THEN [{'op': 'k', 'n': 4, 'name': NULL, 'x': ia, 'z': id}] WHEN 3 THEN [{'op': 'K', 'n': 4, 'name': NULL, 'x': ia, 'z': id}]
    WHEN 4 THEN [{'op': 'scn', 'n': 3, 'name': NULL, 'x': ia, 'z': ic}] WHEN 5 THEN [{'op': 'SCN', 'n': 4, 'name': NULL, 'x': ia, 'z': id}]
    WHEN 6 THEN [{'op': 'sc', 'n': 3, 'name': NULL, 'x': ia % 100, 'z': ic}] WHEN 7 THEN [{'op': 'SC', 'n': 4, 'name': NULL, 'x': ia, 'z': id}]
    WHEN 8 THEN [{'op': 'cs', 'n': 0, 'name': 'C' || n, 'x': NULL::BIGINT, 'z': NULL::BIGINT}]
    WHEN 9 THEN [{'op': 'CS', 'n': 0, 'name': 'C' || n, 'x': NULL, 'z': NULL}]
    WHEN 10 THEN [{'op': 'scn', 'n': 1, 'name': NULL, 'x': ia, 'z': ia}] WHEN 11 THEN [{'op': 'SCN', 'n': 1, 'name': NULL, 'x': ia, 'z': ia}]
    WHEN 12 THEN [{'op': 'SC', 'n': 2, 'name': NULL, 'x': ia, 'z': ib}] WHEN 13 THEN [{'op': 'scn', 'n': 5, 'name': NULL, 'x': id, 'z': id}]
    WHEN 14 THEN [{'op': 'scn', 'n': 0, 'name': 'P' || n, 'x': NULL, 'z': NULL}]
    WHEN 15 THEN [{'op': 'Tj', 'n': 0, 'name': NULL, 'x': NULL, 'z': NULL}] WHEN 16 THEN [{'op': 'Tj', 'n': 0, 'name': NULL, 'x': NULL, 'z': NULL}]
    WHEN 17 THEN [{'op': 'sh', 'n': 0, 'name': 'S' || n, 'x': NULL, 'z': NULL}]
    WHEN 18 THEN [{'op': 'rg', 'n': 3, 'name': NULL, 'x': ia, 'z': least(ia + m3, 100)}] WHEN 19 THEN []
    WHEN 20 THEN [{'op': 'Tj', 'n': 0, 'name': NULL, 'x': NULL, 'z': NULL}]
    WHEN 21 THEN [{'op': 'q', 'n': 0, 'name': NULL, 'x': NULL, 'z': NULL}, {'op': 'cm', 'n': 6, 'name': NULL, 'x': 100, 'z': ib}]
    WHEN 22 THEN [{'op': 'g', 'n': 1, 'name': NULL, 'x': ia, 'z': ia}] ELSE [{'op': 'rg', 'n': 2, 'name': NULL, 'x': ia, 'z': ib}] END) AS u(o)
) GROUP BY ALL""", "lines")
_sql("B6_contents_flatten", """SELECT doc_id, p + 1 AS page_no, u.i - 1 AS ordinal, u.s AS stream_id
FROM (SELECT doc_id, p, CASE WHEN p % 7 = 6 THEN NULL WHEN 2 * p + 1 < n THEN [2 * p, 2 * p + 1] ELSE [2 * p] END AS contents
      FROM (SELECT doc_id, (len(string_split(text, ' ')) - 1) // 24 + 1 AS n FROM documents), range(0, (n - 1) // 2 + 1) r(p))
LEFT JOIN LATERAL (SELECT * FROM unnest(contents) WITH ORDINALITY AS v(s, i)) AS u ON true""")

# --- C ---
_HIT = "SELECT doc_id, page_no, stream_id, op, sample FROM ops WHERE "
_sql("C1_nongray_rgb", _HIT + "stage = 'rgb' AND " + _DIFFERS.format("x1", "x2", "x3"), "ops")
_sql("C2_nongray_cmyk", _HIT + "stage = 'cmyk' AND " + _INKED.format("x1", "x2", "x3"), "ops")
_sql("C3_nongray_generic3", _HIT + "stage = 'generic' AND n_args = 3 AND " + _DIFFERS.format("x1", "x2", "x3"), "ops")
_sql("C4_nongray_generic4", _HIT + "stage = 'generic' AND n_args = 4 AND " + _INKED.format("x1", "x2", "x3"), "ops")
_sql("C5_colorspace_uses", "SELECT doc_id, stream_id, 'C' || n AS name, count(*) AS n FROM ops WHERE stage = 'space' GROUP BY doc_id, stream_id, ops.n", "ops")
_sql("C6_pattern_uses", "SELECT doc_id, stream_id, 'P' || n AS name, count(*) AS n FROM ops WHERE stage = 'pattern' GROUP BY doc_id, stream_id, ops.n", "ops")
_sql("C7_inline_image_flag", "SELECT DISTINCT doc_id, stream_id, 1::BIGINT AS n, 'BI...' AS sample FROM lines WHERE t = 19", "lines")
_sql("C8_shading_op_flag", "SELECT DISTINCT doc_id, stream_id, 1::BIGINT AS n, 'sh' AS sample FROM lines WHERE t = 17 AND NOT is_last", "lines")
_sql("C9_summarize_ops", "SELECT doc_id, page_no, stream_id, kind, n, sample FROM summary", "summary")

# --- D ---
_sql("D1_deref", """SELECT o.doc_id, o.cs_obj, o.obj_no, coalesce(t.kind, o.cs_obj::VARCHAR) AS cs_obj_value FROM objects o
LEFT JOIN objects t ON t.doc_id = o.doc_id AND t.obj_no = o.cs_obj""", "objects")
_sql("D2_colorspace_label", "SELECT doc_id, cs_obj, label FROM labels", "labels")
_GRAY = "label IN ('/DeviceGray', '/CalGray', '[/ICCBased N=1]', '(none)')"
_sql("D3_is_gray_space", f"SELECT doc_id, cs_obj, {_GRAY} AS is_gray FROM labels", "labels")
_sql("D4_image_inventory", """SELECT o.doc_id, o.obj_no, w, h, CASE WHEN o.cs_obj IS NULL THEN '(none)' ELSE coalesce(label, '(?)') END AS label,
  CASE WHEN f IS NULL THEN 'none' ELSE '[' || coalesce(array_to_string(f, ','), '') || ']' END AS filters, coalesce(is_mask, false) AS is_mask,
  has_smask, has_decode, length FROM objects o LEFT JOIN labels l ON l.doc_id = o.doc_id AND l.cs_obj = o.cs_obj
WHERE subtype = '/Image'""", "objects", "labels")
_sql("D4_page_images", """SELECT r.doc_id, r.page_no::BIGINT AS page_no, e.name, o.obj_no, w, h, CASE WHEN o.cs_obj IS NULL THEN '(none)' ELSE coalesce(label, '(?)') END AS label,
  CASE WHEN o.f IS NULL THEN 'none' ELSE '[' || coalesce(array_to_string(o.f, ','), '') || ']' END AS filters, coalesce(o.is_mask, false) AS is_mask,
  has_smask, has_decode, length FROM page_climb r JOIN entries e ON e.doc_id = r.doc_id AND e.parent_obj = r.res AND e.role = 'image'
JOIN objects o ON o.doc_id = e.doc_id AND o.obj_no = e.obj_no LEFT JOIN labels l ON l.doc_id = o.doc_id AND l.cs_obj = o.cs_obj""",
     "page_climb", "entries", "objects", "labels")
_sql("D5_nongray_images", "SELECT doc_id, parent_obj, name, label, first_filter, obj_no FROM found_images", "found_images")
_sql("D6_nongray_shadings", "SELECT doc_id, parent_obj, name, label, shading_type FROM found_shadings", "found_shadings")
_sql("D7_nongray_shading_patterns", "SELECT doc_id, parent_obj, name, label, shading_type FROM found_painted", "found_painted")
for _name, _role in (("D8_tiling_pattern_ops", "tiling"), ("D9_form_ops", "form"), ("D10_softmask_ops", "softmask")):
    _sql(_name, f"SELECT doc_id, page_no, seq, \"where\", kind, message FROM in_containers WHERE role = '{_role}'", "in_containers")
_sql("D11_resource_reach", """SELECT doc_id, obj_no, min(depth) AS min_depth, max(depth) AS max_depth, count(DISTINCT depth) AS n_depths
FROM paths WHERE depth <= 5 GROUP BY doc_id, obj_no""", "paths")
_sql("D12_first_visit", "SELECT doc_id, role, obj_no, v.page AS page_no, array_to_string(v.path, '.') AS path FROM first", "first")
_sql("D13_inherited_resources", """SELECT 0::BIGINT AS doc_id, node_id, res AS resources_obj, is_inherited FROM climb
WHERE res IS NOT NULL OR parent_id IS NULL""", "climb")
_sql("D14_images_to_convert", """SELECT o.doc_id, o.obj_no, o.cs_obj FROM objects o LEFT JOIN cs_defs c ON c.doc_id = o.doc_id AND c.cs_obj = o.cs_obj
WHERE o.subtype = '/Image' AND o.cs_obj IS NOT NULL
  AND NOT coalesce(c.size IS NULL AND c.family IN ('/DeviceGray', '/CalGray'), false)""", "objects", "cs_defs")
_sql("D15_where_label", """SELECT doc_id, page_no, obj_no, role, depth, "where", array_to_string(path, '.') AS path FROM visits""", "visits")

# --- E ---
_sql("E1_residual_findings", """SELECT doc_id, page_no, array_to_string(seq_list, '.') AS seq, "where", kind, message FROM findings""", "findings")
_sql("E2_distinct_findings", "SELECT doc_id, page_no, message, array_to_string(seq_list, '.') AS seq FROM distinct_findings", "distinct_findings")
_sql("E3_suspect_pages", "SELECT * FROM suspects", "suspects")
_sql("E4_report_topk", """SELECT doc_id, page_no, page_rank, message_rank, message FROM (
  SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_no) AS page_rank,
    row_number() OVER (PARTITION BY doc_id, page_no ORDER BY seq_list, message) AS message_rank FROM distinct_findings)
WHERE page_rank <= 40 AND message_rank <= 8""", "distinct_findings")
_sql("E5_report_overflow", "SELECT doc_id, greatest(n_pages - 40, 0) AS n_more FROM suspects", "suspects")
_sql("E6_conversion_counts", """SELECT user_id AS doc_id, count(*) FILTER (event_type <> 'error') AS n_done,
  count(*) FILTER (event_type = 'error') AS n_error FROM events GROUP BY user_id""")

# --- F ---
_X3, _X4 = ("x1", "x2", "x3"), ("x1", "x2", "x3", "x4")
_sql("F1_luma_rgb", f"SELECT doc_id, stream_id, sample, {_luma(*_X3)} AS luma FROM ops WHERE stage = 'rgb'", "ops")
_sql("F2_luma_cmyk", f"SELECT doc_id, stream_id, sample, {_luma_cmyk(*_X4)} AS luma FROM ops WHERE stage = 'cmyk'", "ops")
_SUMS = "SELECT image_id, y, sum({0})::BIGINT AS total, sum({0} * (x + 1))::BIGINT AS weighted FROM {1} GROUP BY image_id, y"
_sql("F3_luma_rgb8", _SUMS.format("gray", "(SELECT * FROM raw_gray WHERE channels = 3)"), "raw_gray")
_sql("F4_luma_cmyk8", _SUMS.format("gray", "(SELECT * FROM raw_gray WHERE channels = 4)"), "raw_gray")
_sql("F5_dot_gain", "SELECT doc_id, stream_id, sample, " + ", ".join(f"{_gain('luma', g)} AS gain{g}" for g in (0, 10, 20, 25))
     + f" FROM (SELECT *, {_luma(*_X3)} AS luma FROM ops WHERE stage = 'rgb')", "ops")
_sql("F6_dot_gain_lut", f"""SELECT gain, v_in, v_out, coalesce(n, 0) AS n FROM (
  SELECT unnest([0, 20, 25]) AS gain, i::INT AS v_in, unnest([i::INT, {_gain8('i', 20)}, {_gain8('i', 25)}]) AS v_out FROM range(0, 256) r(i))
LEFT JOIN (SELECT gray AS v_in, count(*) AS n FROM raw_gray GROUP BY gray) USING (v_in)""", "raw_gray")
_sql("F7_apply_lut", _SUMS.format("g", f"(SELECT *, {_gain8('gray', 20)} AS g FROM raw_gray)"), "raw_gray")
_sql("F8_compose_luts", _SUMS.format("g", f"""(SELECT *, {_gain8('m', 25)} AS g FROM (
  SELECT *, {_round('0.0::DOUBLE + pow(gray / 255.0::DOUBLE, 2.0::DOUBLE) * 255.0::DOUBLE')} AS m FROM raw_gray))"""), "raw_gray")
_sql("F9_tint_channels", f"""SELECT doc_id, name, step, u.i - 1 AS ch, {_gray4('u.v')} AS v
FROM tints, unnest(ch) WITH ORDINALITY AS u(v, i)""", "tints")
_TINT = f"""CASE alt WHEN '/DeviceCMYK' THEN {_luma_cmyk('ch[1]', 'ch[2]', 'ch[3]', 'ch[4]')}
  WHEN '/DeviceRGB' THEN {_luma('ch[1]', 'ch[2]', 'ch[3]')} WHEN '/DeviceGray' THEN ch[1] ELSE 1.0::DOUBLE - t END"""
_sql("F10_tint_to_gray", f"""SELECT doc_id, name, step, {_gray4('luma')} AS gain0, {_gray4(_gain('luma', 20))} AS gain20
FROM (SELECT *, {_TINT} AS luma FROM tints)""", "tints")
_CTES["tint_tables"] = f"""SELECT doc_id, name AS space, list(greatest(0, least(255, {_round('(' + _TINT + ') * 255.0::DOUBLE')})) ORDER BY v) AS tint FROM (
  SELECT doc_id, name, alt, v, v / 255.0::DOUBLE AS t, list_transform(c1, lambda x: 0.0::DOUBLE + pow(v / 255.0::DOUBLE, fn_n) * (x - 0.0::DOUBLE)) AS ch
  FROM colorspaces, range(0, 256) r(v) WHERE NOT is_pattern) GROUP BY doc_id, name"""
_CTES["tint_images"] = """SELECT p_partkey AS image_id, p_size AS w, p_partkey % 5 + 1 AS h, p_partkey % 50 AS doc_id,
  CASE WHEN p_partkey % 9 <> 0 THEN 'C' || (p_partkey % 5) END AS space FROM part"""
_NEEDS["tint_tables"] = ("colorspaces",)
_sql("F8_tint_tables", """SELECT doc_id, space, list_sum(tint)::BIGINT AS total, list_sum(list_transform(tint, lambda x, i: x * i))::BIGINT AS weighted
FROM tint_tables""", "tint_tables")
_sql("F11_gray4", f"""SELECT doc_id, stream_id, sample, {_gray4('luma')} AS text, {_gray4('luma')}::DOUBLE AS value
FROM (SELECT *, {_luma(*_X3)} AS luma FROM ops WHERE stage = 'rgb')""", "ops")

# --- G ---
_sql("G1_current_colorspace", "SELECT doc_id, stream_id, segment, ordinal, call, space FROM calls", "calls")
_sql("G1_current_colorspace_position", f"""SELECT doc_id, stream_id, call,
  CASE WHEN gray_op = 'G' THEN stroke_at ELSE fill_at END AS space FROM calls JOIN (
    SELECT {_STREAM}, pos, last_value(CASE WHEN t = 8 THEN 'C' || n END IGNORE NULLS) OVER w AS fill_at,
      last_value(CASE WHEN t = 9 THEN 'C' || n END IGNORE NULLS) OVER w AS stroke_at FROM lines
    WINDOW w AS (PARTITION BY {_STREAM} ORDER BY pos)) USING ({_STREAM}, pos)""", "calls")
_SOLID = f"CASE n_args WHEN 4 THEN {_luma_cmyk(*_X4)} WHEN 3 THEN {_luma(*_X3)} END"
_sql("G2_rewrite_fixed", f"""SELECT doc_id, stream_id, call, {_gray4(_gain('luma', 20))} AS gray, gray_op
FROM (SELECT *, {_SOLID} AS luma FROM calls WHERE t IN (0, 1, 2, 3, 18))""", "calls")
_sql("G3_rewrite_generic", f"""SELECT doc_id, stream_id, call, {_gray4('luma')} AS gray, gray_op
FROM (SELECT *, {_SOLID} AS luma FROM calls WHERE t IN (4, 5, 6, 7, 13))""", "calls")
_TINTED = f"""SELECT k.*, s.is_pattern, s.name, s.alt, list_transform(s.c1, lambda v: 0.0::DOUBLE + pow(k.x1, s.fn_n) * (v - 0.0::DOUBLE)) AS ch
FROM calls k LEFT JOIN colorspaces s ON s.doc_id = k.doc_id AND s.name = k.space"""
_TINT_X = _TINT.replace("- t END", "- x1 END")


def _tint_gray(gain: int) -> str:
    return (f"CASE WHEN name IS NULL THEN {_gray4('(1.0::DOUBLE - x1)')} WHEN is_pattern THEN NULL "
            f"ELSE {_gray4(_gain('(' + _TINT_X + ')', gain))} END")


_sql("G4_tint_lookup", f"""SELECT doc_id, stream_id, call, space, {_tint_gray(25)} AS gray, gray_op
FROM ({_TINTED}) WHERE n_args = 1""", "calls", "colorspaces")
_sql("G5_drop_colorspace_ops", f"""SELECT o.doc_id, stream_id, segment, ordinal, o.name, op FROM (
  SELECT {_STREAM}, segment, 'C' || n AS name, CASE t WHEN 8 THEN 'cs' ELSE 'CS' END AS op,
    row_number() OVER (PARTITION BY {_STREAM}, segment ORDER BY pos) - 1 AS ordinal FROM segmented WHERE t IN (8, 9)) o
JOIN colorspaces s ON s.doc_id = o.doc_id AND s.name = o.name WHERE is_pattern""", "segmented", "colorspaces")
# Gray of the two colour images (three bytes and four bytes a pixel), rounded, then corrected.
_BYTES = "ascii(substr('{}', {} * i + {}, 1))"
_GRAY3 = _round(_luma(*[_BYTES.format("abcdefghijkl", 3, k) for k in (1, 2, 3)]))
_GRAY4 = _round("255.0::DOUBLE * " + _luma_cmyk(*[_BYTES.format("abcdefghijklmnop", 4, k) + " / 255.0::DOUBLE" for k in (1, 2, 3, 4)]))
_PIXELS = "array_to_string(list_transform(range(0, 4), lambda i: chr({})), '')"
_GRAY_IMAGE = f"""CASE l.n WHEN 0 THEN E'BI\\n/W 2 /H 2 /CS /G /BPC 8\\nID\\n' || {_PIXELS.format(_gain8(_GRAY3, 20))} || E'\\nEI'
  WHEN 3 THEN E'BI\\n/Width 2 /Height 2 /CS /G /BitsPerComponent 8\\nID\\n' || {_PIXELS.format(_gain8(_GRAY4, 20))} || E'\\nEI' ELSE l.old END"""
_REWRITTEN = f"""SELECT {_STREAM}, bool_or(n_args = 1 AND coalesce(is_pattern, false)) AS failed, count(x1) AS n_calls,
  string_agg(old, chr(10) ORDER BY pos) AS old_text, string_agg(new, chr(10) ORDER BY pos) AS new_text
FROM (SELECT l.{_STREAM.replace(', ', ', l.')}, l.pos, l.old, c.n_args, c.is_pattern, c.x1,
    CASE WHEN l.t IN (8, 9) AND NOT coalesce(l.kept, false) THEN ''
      WHEN l.t = 19 THEN {_GRAY_IMAGE}
      WHEN c.x1 IS NULL THEN l.old
      WHEN c.n_args = 1 THEN l.stay || coalesce(c.tint, '') || ' ' || c.gray_op
      ELSE l.stay || c.solid || ' ' || c.gray_op END AS new
  FROM (SELECT l.*, s.is_pattern AS kept, {_LINE.replace('CASE t', 'CASE l.t')} AS old,
      CASE l.t WHEN 12 THEN {_A} || ' ' WHEN 13 THEN {_D} || ' ' WHEN 14 THEN '/P' ELSE '' END AS stay
    FROM lines l LEFT JOIN colorspaces s ON s.doc_id = l.doc_id AND l.t IN (8, 9) AND s.name = 'C' || l.n) l
  LEFT JOIN (SELECT *, {_gray4(_gain('(' + _SOLID + ')', 20))} AS solid, {_tint_gray(20)} AS tint FROM ({_TINTED})) c
    ON c.doc_id = l.doc_id AND c.stream_id = l.stream_id AND c.pos = l.pos) GROUP BY ALL"""
_sql("G6_rewrite_streams", f"""SELECT doc_id, stream_id, md5(CASE WHEN failed THEN old_text ELSE new_text END) AS gray_md5,
  CASE WHEN failed THEN 0 ELSE n_calls END AS n_rewritten, CASE WHEN failed THEN 'pattern_tint' END AS error
FROM ({_REWRITTEN.replace('GROUP BY ALL', f'GROUP BY {_STREAM}')})""", "calls", "colorspaces")
_INLINE = f"""SELECT *, CASE n WHEN 1 THEN 'G' WHEN 3 THEN 'DeviceCMYK' ELSE 'RGB' END AS space, CASE n WHEN 4 THEN 4 ELSE 8 END AS bpc,
  CASE n WHEN 2 THEN 'Fl' ELSE '' END AS image_filter FROM (
  SELECT *, row_number() OVER (PARTITION BY {_STREAM} ORDER BY pos) - 1 AS ordinal FROM lines WHERE t IN (15, 16, 19, 20)) WHERE t = 19"""
_sql("G7_inline_image_table", f"SELECT doc_id, stream_id, ordinal, CASE n WHEN 1 THEN 4 ELSE 2 END AS w, CASE n WHEN 1 THEN 4 ELSE 2 END AS h, bpc, space, image_filter FROM ({_INLINE})", "lines")
_sql("G8_inline_image_route", f"""SELECT doc_id, stream_id, ordinal, CASE n WHEN 1 THEN 1 WHEN 3 THEN 4 ELSE 3 END AS channels,
  CASE n WHEN 0 THEN 'convert' WHEN 3 THEN 'convert' WHEN 1 THEN 'pass_known_length' ELSE 'pass_by_scan' END AS route,
  CASE n WHEN 0 THEN 12 WHEN 1 THEN 16 WHEN 3 THEN 16 END AS payload_bytes FROM ({_INLINE})""", "lines")
# After the rewrite only what the rewriter leaves alone is found: calls inside nested literals, images,
# shadings, kept Pattern spaces, and everything in streams that were skipped or failed.
_sql("G9_rewrite_audit", f"""SELECT doc_id, kind, sum(n)::BIGINT AS n_before, sum(after)::BIGINT AS n_after FROM (
  SELECT h.doc_id, h.kind, 1 AS n, CASE WHEN NOT plain OR failed OR h.stage_no IN (5, 6) OR (h.stage_no = 0 AND h.is_literal)
      OR (h.stage_no = 3 AND coalesce(s.is_pattern, false)) THEN 1 ELSE 0 END AS after
  FROM (SELECT h.*, coalesce(l.t = 20, false) AS is_literal, l.n AS name_no FROM hits h
        LEFT JOIN lines l ON l.doc_id = h.doc_id AND l.stream_id = h.stream_id AND l.pos = h.pos AND h.stage_no < 5 WHERE h.hit) h
  JOIN (SELECT doc_id, stream_id, f IS NULL OR coalesce(len(f) = 1 AND f[1] IN ('/FlateDecode', '/Fl'), false) AS plain FROM streams) p
    ON p.doc_id = h.doc_id AND p.stream_id = h.stream_id
  JOIN (SELECT l.doc_id, l.stream_id, coalesce(bool_or(c.n_args = 1 AND s.is_pattern), false) AS failed FROM lines l
        LEFT JOIN calls c ON c.doc_id = l.doc_id AND c.stream_id = l.stream_id AND c.pos = l.pos
        LEFT JOIN colorspaces s ON s.doc_id = c.doc_id AND s.name = c.space GROUP BY l.doc_id, l.stream_id) q
    ON q.doc_id = h.doc_id AND q.stream_id = h.stream_id
  LEFT JOIN colorspaces s ON s.doc_id = h.doc_id AND h.stage_no = 3 AND s.name = 'C' || h.name_no)
GROUP BY doc_id, kind""", "hits", "streams", "calls", "colorspaces")

# --- H ---
_sql("H1_raster_status", "SELECT image_id, expected_len, status FROM raster_states", "raster_states")
_sql("H2_pad_rule", """SELECT image_id, fill, CASE WHEN status = 'padded' THEN expected_len - decoded_len ELSE 0 END AS n_missing
FROM raster_states""", "raster_states")
_sql("H3_unpack_pixels", """SELECT image_id, y, ch, max(tag) AS tag, count(*) AS n, sum(v)::BIGINT AS total,
  sum(v * (x + 1))::BIGINT AS weighted FROM samples GROUP BY image_id, y, ch""", "samples")
_sql("H4_pixels_to_gray", _SUMS.format("g", f"(SELECT *, {_gain8('gray', 25)} AS g FROM gray)"), "gray")
_CHANNELS = ", ".join(f"sum(v * (x + 1)) FILTER (ch = {i})::BIGINT AS c{i + 1}" for i in range(4))
_sql("H5_delta_decode", f"SELECT image_id, y, {_CHANNELS} FROM delta GROUP BY image_id, y", "delta")
_DELTAS = "SELECT *, ({0} - coalesce(lag({0}) OVER (PARTITION BY image_id, y ORDER BY x), 0) + 256) % 256 AS d FROM {1}"
_sql("H6_delta_encode", _SUMS.format("d", f"({_DELTAS.format('gray', 'gray')})"), "gray")
_sql("H7_row_delta_decode", f"""SELECT image_id, y, {_CHANNELS}, NULL AS error FROM down
WHERE image_id IN (SELECT image_id FROM samples WHERE tag > 0) GROUP BY image_id, y
UNION ALL SELECT image_id, NULL, NULL, NULL, NULL, NULL, error FROM raster_failures WHERE predictor >= 10""", "down", "raster_failures")
_sql("H8_gray_histogram", """SELECT image_id, gray, NULL AS error, count(*) AS n FROM gray GROUP BY ALL
UNION ALL SELECT image_id, NULL, error, 0 FROM raster_failures""", "gray", "raster_failures")
# Images as they are written back: a tag and the differences per row, in hexadecimal.
_PACKED = """SELECT image_id, sum(len(line)) // 2 AS n_bytes, md5(string_agg(line, '' ORDER BY y)) AS gray_md5 FROM (
  SELECT image_id, y, '01' || string_agg(upper(printf('%02x', d)), '' ORDER BY x) AS line FROM ({0}) GROUP BY image_id, y) GROUP BY image_id"""
_sql("H9_gray_images", f"""WITH g AS (SELECT image_id, y, x, {_gain8('gray', 20)} AS g FROM gray)
SELECT image_id, w, h::INT AS h, n_bytes::INT AS n_bytes, gray_md5, NULL AS error FROM ({_PACKED.format(_DELTAS.format('g', 'g'))}) JOIN rasters USING (image_id)
UNION ALL SELECT image_id, NULL, NULL, NULL, NULL, error FROM raster_failures""".replace("WITH g AS", ", g AS", 1), "gray", "raster_failures", "rasters")
_sql("H10_tinted_images", f""", g AS (SELECT image_id, y, x, {_gain8('byte', 25)} AS g FROM (
    SELECT image_id, y, x, CASE WHEN space IS NULL THEN b ELSE tint[b + 1] END AS byte FROM (
      SELECT i.*, t.tint, y, x, (i.image_id * 11 + (y * w + x) * 3) % 256 AS b FROM tint_images i LEFT JOIN tint_tables t USING (doc_id, space),
        range(0, h) r(y), range(0, w) c(x) WHERE i.space IS NULL OR t.tint IS NOT NULL)))
SELECT image_id, w, h::INT AS h, n_bytes::INT AS n_bytes, gray_md5, NULL AS error FROM ({_PACKED.format(_DELTAS.format('g', 'g'))}) JOIN tint_images USING (image_id)
UNION ALL SELECT image_id, NULL, NULL, NULL, NULL, 'tint_unsupported' FROM tint_images i LEFT JOIN tint_tables t USING (doc_id, space)
WHERE i.space IS NOT NULL AND t.tint IS NULL""", "tint_images", "tint_tables")

# --- I ---
_sql("I1_page_class", "SELECT * FROM classes", "classes")
_DOC = "SELECT doc_id, count(*) FILTER (NOT is_gray) AS n_color, count(*) FILTER (is_gray) AS n_gray FROM classes GROUP BY doc_id"
_sql("I2_doc_color_summary", _DOC, "classes")
_sql("I3_print_quote", f"SELECT *, (n_color * 300.00 + n_gray * 50.00)::DECIMAL(18,2) AS cost FROM ({_DOC})", "classes")
_sql("I4_fold_page_edits", """WITH base AS (SELECT o_orderkey AS doc_id, p AS page_no FROM orders, range(1, 7) r(p)),
edits AS (SELECT user_id AS doc_id, event_id AS seq, event_id % 5 + 1 AS page_no, CASE WHEN event_type IN ('click', 'view') THEN 'rotate'
    WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'undo' WHEN event_type = 'signup' THEN 'move'
    ELSE 'insert' END AS action, CASE event_type WHEN 'click' THEN 90 WHEN 'view' THEN -90 ELSE 0 END AS degrees,
    event_id % 50 / 10.0::DOUBLE AS order_key FROM events),
state AS (SELECT DISTINCT ON (doc_id, page_no) doc_id, page_no, action FROM edits WHERE action IN ('delete', 'undo') ORDER BY doc_id, page_no, seq DESC),
moved AS (SELECT DISTINCT ON (doc_id, page_no) doc_id, page_no, order_key FROM edits WHERE action = 'move' ORDER BY doc_id, page_no, seq DESC),
turned AS (SELECT doc_id, page_no, sum(degrees) AS turn FROM edits GROUP BY doc_id, page_no)
SELECT b.doc_id, b.page_no, NULL::BIGINT AS blank_seq, coalesce(m.order_key, b.page_no::DOUBLE) AS order_key,
  ((coalesce(turn, 0) % 360 + 360) % 360)::INT AS rotation
FROM base b LEFT JOIN state s USING (doc_id, page_no) LEFT JOIN moved m USING (doc_id, page_no) LEFT JOIN turned t USING (doc_id, page_no)
WHERE coalesce(s.action, '') <> 'delete'
UNION ALL SELECT doc_id, NULL, seq, order_key, 0 FROM edits WHERE action = 'insert' AND doc_id IN (SELECT doc_id FROM base)""")
