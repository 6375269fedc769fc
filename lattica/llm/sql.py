"""DuckDB SQL of the queries that SQL can express."""

W = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{W}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{W}')) AS ls
  FROM documents
),
win AS (
  SELECT doc_id, i, list_slice(ws, i, i + 7) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
),
rep AS (SELECT doc_id, unnest(list(i)) AS i FROM win GROUP BY doc_id, g HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, t, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls) AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(list_distinct(ws)) AS n_distinct,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)
),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words
            OR 100 * n_dup_lines > 50 * n_lines OR 100 * len(regexp_extract_all(t, '!')) > 50 * n_words
            OR 100 * len(regexp_extract_all(t, '\p{{Lu}}')) > 50 * word_chars
            OR 100 * (word_chars - len(regexp_extract_all(t, '\p{{L}}'))) > 50 * word_chars
            OR 100 * n_distinct < 10 * n_words) AS kept
FROM b
"""

OP7 = r"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS raw, trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS l, len(ls) AS n_lines
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
),
nb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM l WHERE length(l) > 0),
win AS (
  SELECT doc_id, j, i AS i1, lead(i, 1) OVER o AS i2, lead(i, 2) OVER o AS i3, l AS l1, lead(l, 1) OVER o AS l2, lead(l, 2) OVER o AS l3
  FROM nb WINDOW o AS (PARTITION BY doc_id ORDER BY j)
),
again AS (
  SELECT doc_id, i1, i2, i3
  FROM (SELECT *, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, j) AS k FROM win WHERE i3 IS NOT NULL)
  WHERE k > 1
),
gone AS (SELECT DISTINCT doc_id, unnest([i1, i2, i3]) AS i FROM again),
kept AS (
  SELECT l.doc_id, string_agg(raw, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL) AS text, max(n_lines) AS n_lines, count(gone.i) AS n_removed
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id)
"""

OP9 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{W}') AS ws
  FROM documents
),
g AS (
  SELECT DISTINCT doc_id, list_slice(ws, i, i + 3) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM m LEFT JOIN n USING (doc_id)
"""

OP4 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{W}') AS ws FROM documents),
win AS (
  SELECT doc_id, i, list_slice(ws, i, i + 19) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)
),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1
),
-- a word is covered if the last such window that starts at or before it reaches it
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
marked AS (
  SELECT words.doc_id, words.i, word,
         coalesce(words.i - max(again.i) OVER (PARTITION BY words.doc_id ORDER BY words.i) < 20, false) AS gone
  FROM words LEFT JOIN again ON words.doc_id = again.doc_id AND words.i = again.i
),
s AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s USING (doc_id)
"""

#: crc_table: the 256 entries of CRC-32's table, made by its rule.
CRC = """
crc_table AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
        FROM (SELECT unnest(range(256)) AS i))
)
"""


def crc32(hexes: str) -> str:
    """CRC-32 of the bytes that an expression gives in hex; the query has to join crc_table."""
    of = f"list_transform(range(length({hexes}) // 2), lambda i: ('0x' || substr({hexes}, (2 * i + 1)::BIGINT, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {of}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


OP12 = rf"""
WITH RECURSIVE {CRC},
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2
),
hashed AS (SELECT run, n, {crc32("hx")} AS h FROM (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM runs), crc_table),
typed AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
),
words AS (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
),
near AS (
  SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.d = b.word
  UNION
  SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.d = b.word
),
best AS (
  SELECT word, near, n AS m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS k FROM near
),
formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * words.n THEN near END AS form, CASE WHEN m >= 2 * words.n THEN m END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word AND k = 1
),
chain AS (
  SELECT word, form AS root FROM formed WHERE form IS NOT NULL
  UNION ALL
  SELECT chain.word, f.form FROM chain JOIN formed f ON f.word = chain.root WHERE f.form IS NOT NULL
),
roots AS (SELECT chain.word, chain.root FROM chain JOIN formed f ON f.word = chain.root WHERE f.form IS NULL)
SELECT formed.*, coalesce(root, formed.word) AS root FROM formed LEFT JOIN roots ON roots.word = formed.word
"""

#: Windows of 400 bytes are told apart by their MD5.
OP8 = """
WITH b AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS hx, strlen(coalesce(text, '')) AS n FROM documents),
-- pieces of 400 bytes, each with the 400 that follow
piece AS (SELECT doc_id, n, c, substr(hx, (800 * c + 1)::BIGINT, 1600) AS p FROM (SELECT doc_id, n, hx, unnest(range((n + 399) // 400)) AS c FROM b)),
win AS (SELECT doc_id, 400 * c + j AS i, md5(substr(p, (2 * j + 1)::BIGINT, 800)) AS h FROM (SELECT *, unnest(range(least(400, n - 399 - 400 * c))) AS j FROM piece)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
again AS (SELECT doc_id, i FROM win SEMI JOIN twice USING (h)),
-- a byte is covered if the last such window that starts at or before it reaches it
bytes AS (SELECT doc_id, 400 * c + j AS i, substr(p, (2 * j + 1)::BIGINT, 2) AS byte FROM (SELECT *, unnest(range(least(400, n - 400 * c))) AS j FROM piece SEMI JOIN again USING (doc_id))),
marked AS (
  SELECT bytes.doc_id, bytes.i, byte, coalesce(bytes.i - max(again.i) OVER (PARTITION BY bytes.doc_id ORDER BY bytes.i) < 400, false) AS gone
  FROM bytes LEFT JOIN again ON bytes.doc_id = again.doc_id AND bytes.i = again.i
),
s AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE gone AND NOT before) AS n_spans,
         coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS before FROM marked) GROUP BY 1
)
SELECT b.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       CASE WHEN kept IS NULL THEN sha256(t) ELSE sha256(unhex(kept)) END AS kept_sha256
FROM b LEFT JOIN s USING (doc_id)
"""


def _way(state: str, cost: str, label: str) -> str:
    return f"{{'c': {state}.c + {cost}, 's': {state}.s || '{label}'}}"


def _ways(*ways: tuple[str, str, str, str]) -> str:
    """The least of ways (state, cost, label, condition), as struct of cost and labels; one that isn't open costs a billion more."""
    return "list_min([" + ", ".join(_way(s, f"CASE WHEN {open_} THEN {c} ELSE 1000000000 END" if open_ else c, x) for s, c, x, open_ in ways) + "])"


def _with_inserts(names: str, source: str) -> str:
    """States q0 (start), qs, qu, qa with insertions after them."""
    user = f"list_min([qu, {', '.join(_way(q, '3', 'I') for q in ('q0', 'qs', 'qa'))}])"
    return f"SELECT {names}, q0, qs, qu, list_min([qa, {_way('qu', '3', 'I')}]) AS qa FROM (SELECT {names}, q0, qs, {user} AS qu, qa FROM ({source}))"


_NEVER = "{'c': 1000000000::BIGINT, 's': ''}"
_SOUND = "n.kind NOT IN ('blank', 'duplicate')"
_MORE = "CASE WHEN n.kind = 'truncated' THEN 3 ELSE 0 END"
_BEFORE_USER = ("p.q0", "p.qs", "p.qa")
_STEP = f"""
SELECT n.conv, n.i AS i, {_ways(("p.q0", "4", "D", ""))} AS q0,
       {_ways(("p.qs", "4", "D", ""), ("p.q0", _MORE, "K", f"{_SOUND} AND n.initial = 's'"))} AS qs,
       {_ways(("p.qu", "4", "D", ""), *[(q, _MORE, "K", f"{_SOUND} AND n.initial = 'u'") for q in _BEFORE_USER], *[(q, f"3 + {_MORE}", "R", _SOUND) for q in _BEFORE_USER])} AS qu,
       {_ways(("p.qa", "4", "D", ""), ("p.qu", _MORE, "K", f"{_SOUND} AND n.initial = 'a'"), ("p.qu", f"3 + {_MORE}", "R", _SOUND))} AS qa
FROM walk p JOIN judged n ON n.conv = p.conv AND n.i = p.i + 1
"""

#: A conversation is known by its number, as its id may be null.
OP13 = rf"""
WITH RECURSIVE {CRC},
convs AS (SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
hashed AS (
  SELECT conv, turn, role, text, {crc32("hx")} % 20 AS fault
  FROM (SELECT conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS hx
        FROM conversations c JOIN convs ON convs.conv_id IS NOT DISTINCT FROM c.conv_id), crc_table
),
damaged AS (
  SELECT conv, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed WHERE fault <> 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
judged AS (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE 'sound' END AS kind
  FROM placed
),
walk AS (
  {_with_inserts("conv, i", f"SELECT conv, 0::BIGINT AS i, {{'c': 0::BIGINT, 's': ''}} AS q0, {_NEVER} AS qs, {_NEVER} AS qu, {_NEVER} AS qa FROM convs")}
  UNION ALL
  {_with_inserts("conv, i", _STEP)}
),
best AS (SELECT conv, i, list_min([q0, qa]) AS b FROM walk QUALIFY i = max(i) OVER (PARTITION BY conv)),
edits AS (
  SELECT conv, j, substr(audit, j, 1) AS e, j - length(replace(substr(audit, 1, j), 'I', '')) AS inserted
  FROM (SELECT conv, b.s AS audit, unnest(range(1, length(b.s) + 1)) AS j FROM best)
),
left_over AS (
  SELECT e.conv, j, e.e, n.role, CASE WHEN e.e = 'I' THEN '' ELSE n.text END AS text, row_number() OVER (PARTITION BY e.conv ORDER BY j) AS m
  FROM edits e LEFT JOIN judged n ON n.conv = e.conv AND n.i = j - inserted AND e.e <> 'I' WHERE e.e <> 'D'
),
named AS (
  SELECT conv, j, CASE WHEN e = 'K' THEN role
                       WHEN (m - max(CASE WHEN m = 1 AND e = 'K' AND role LIKE 's%' THEN 1 ELSE 0 END) OVER (PARTITION BY conv)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text AS line
  FROM left_over
),
repaired AS (SELECT conv, sha256(string_agg(line, chr(10) ORDER BY j)) AS digest FROM named GROUP BY 1),
counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE kind = 'blank') AS blank, count(*) FILTER (WHERE kind = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE kind = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY 1
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, b.c::BIGINT AS cost, b.s AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM convs JOIN best USING (conv) LEFT JOIN counts USING (conv) LEFT JOIN repaired USING (conv)
"""

_MOD = "18446744073709551616::UHUGEINT"
#: The five primes of XXH64.
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_P1, _P2, _P3, _P4, _P5 = (f"{p}::UHUGEINT" for p in _PRIMES)


def _mul(a: str, b: str) -> str:
    return f"(({a}) * {b} % {_MOD})"


def _add(*terms: str) -> str:
    return f"(({' + '.join(terms)}) % {_MOD})"


def _rotl(x: str, by: int) -> str:
    return f"((({x}) * {1 << by} % {_MOD}) + ({x}) // {1 << (64 - by)}::UHUGEINT)"


def _shifted(h: str, by: int) -> str:
    return f"xor({h}, {h} // {1 << by}::UHUGEINT)"


def _read(at: str, size: int) -> str:
    """The number in `size` bytes of hx from a place on, lowest byte first."""
    return "('0x' || " + " || ".join(f"substr(hx, (2 * ({at}) + {2 * i + 1})::BIGINT, 2)" for i in reversed(range(size))) + ")::UBIGINT::UHUGEINT"


def _round(v: str, lane: str) -> str:
    return _mul(_rotl(_add(v, _mul(lane, _P2)), 31), _P1)


def xxh64(source: str, seed: int = 42) -> str:
    """CTEs from `source` (g, a text) to xxh (g, h), its XXH64 of the UTF-8 bytes as UBIGINT."""
    starts = [(seed + _PRIMES[0] + _PRIMES[1]) % 2**64, (seed + _PRIMES[1]) % 2**64, seed, (seed - _PRIMES[0]) % 2**64]
    lanes = ", ".join(
        f"list_reduce(list_concat([{v}::UHUGEINT], list_transform(range(n // 32), lambda j: {_read(f'32 * j + {8 * i}', 8)})), lambda a, l: {_round('a', 'l')}) AS v{i}" for i, v in enumerate(starts)
    )
    merge = lambda h, v: _add(_mul(f"xor({h}, {_round('0::UHUGEINT', v)})", _P1), _P4)
    by = lambda seen, size: f"list_transform(range(n % 32 // {size}), lambda j: {seen})"
    return f"""
xs AS (SELECT g, hex(encode(g)) AS hx, strlen(g) AS n FROM {source}),
xa AS (SELECT *, {lanes} FROM xs),
xb AS (SELECT *, {_add(*[_rotl(f"v{i}", r) for i, r in enumerate((1, 7, 12, 18))])} AS w FROM xa),
xc AS (SELECT *, {merge("w", "v0")} AS w0 FROM xb), xd AS (SELECT *, {merge("w0", "v1")} AS w1 FROM xc), xe AS (SELECT *, {merge("w1", "v2")} AS w2 FROM xd),
xf AS (SELECT g, hx, n, {_add(f"CASE WHEN n >= 32 THEN {merge('w2', 'v3')} ELSE {(seed + _PRIMES[4]) % 2**64}::UHUGEINT END", "n::UHUGEINT")} AS h FROM xe),
xg AS (SELECT g, hx, n, list_reduce(list_concat([h], {by(_round("0::UHUGEINT", _read("n // 32 * 32 + 8 * j", 8)), 8)}), lambda a, l: {_add(_mul(_rotl("xor(a, l)", 27), _P1), _P4)}) AS h FROM xf),
xh AS (SELECT g, hx, n, CASE WHEN n % 8 >= 4 THEN {_add(_mul(_rotl(f"xor(h, {_mul(_read('n // 8 * 8', 4), _P1)})", 23), _P2), _P3)} ELSE h END AS h FROM xg),
xi AS (SELECT g, list_reduce(list_concat([h], list_transform(range(n // 4 * 4, n), lambda j: {_mul(_read("j", 1), _P5)})), lambda a, l: {_mul(_rotl("xor(a, l)", 11), _P1)}) AS h FROM xh),
xj AS (SELECT g, {_mul(_shifted("h", 33), _P2)} AS h FROM xi), xk AS (SELECT g, {_mul(_shifted("h", 29), _P3)} AS h FROM xj),
xxh AS (SELECT g, {_shifted("h", 32)}::UBIGINT AS h FROM xk)"""


_BITS = ", ".join(f"sum((h >> {b}) & 1) AS b{b}" for b in range(64))
_FINGERPRINT = " + ".join(f"CASE WHEN 2 * b{b} > n THEN {1 << b}::UHUGEINT ELSE 0 END" for b in range(64))
OP11 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{W}') AS ws FROM documents
),
g AS (SELECT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
each AS (SELECT DISTINCT g FROM g),
{xxh64("each")},
bits AS (SELECT doc_id, count(*) AS n, {_BITS} FROM g JOIN xxh USING (g) GROUP BY 1),
fp AS (SELECT doc_id, coalesce(({_FINGERPRINT})::UBIGINT, 0) AS f FROM w LEFT JOIN bits USING (doc_id)),
fs AS (SELECT f, min(doc_id) AS least FROM fp GROUP BY 1),
link AS (SELECT a.f AS a, b.f AS b FROM fs a JOIN fs b ON a.f <> b.f AND bit_count(xor(a.f, b.f)::HUGEINT) <= 4),
reach AS (SELECT f AS a, f AS b FROM fs UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
named AS (SELECT a AS f, min(least) AS component_id FROM reach JOIN fs ON fs.f = reach.b GROUP BY 1)
SELECT doc_id, lower(lpad(hex(f), 16, '0')) AS fingerprint, component_id FROM fp JOIN named USING (f)
"""

ORACLES = {"op12_spelling_variants": OP12, "op13_conversation_repair": OP13, "op11_simhash_near_dedup": OP11, "op8_suffix_array_dedup": OP8, "op4_substring_dedup": OP4, "op9_minhash_near_dedup": OP9, "op1_quality_rules": OP1, "op7_line_dedup": OP7}
