"""DuckDB SQL for the queries that SQL can express."""

from .secret_scan import MIXED

OP3 = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""

OP10 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.doc_id, k.line, k.pos, (c.key IS NOT NULL AND k.doc_id <> c.keeper) AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


OP9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS i FROM w)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), both_sides AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x.a, x.b FROM both_sides x JOIN sizes p ON p.doc_id = x.a JOIN sizes q ON q.doc_id = x.b WHERE 100 * x.n >= 80 * (p.n + q.n - x.n)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least_id AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN least_id m ON m.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


#: The patterns of the base kinds are those of the query's contract; only the shape of a bare mixed token is the operator's own. Before them the two letters beyond ASCII that fold to ASCII ones are taken out of the text.
_IS = r"""["']?\x20*[:=]\x20*["']?"""
_KINDS = {
    "assign": rf"(?i:(password|passwd|secret|token|api_?key){_IS})([A-Za-z0-9+/_.=-]+)",
    "access": r"(AKIA)([A-Z0-9]+)",
    "hex": r"()([0-9a-f]+)",
    "weak_id": rf"(?i:(user_?name|user|login|client_?id|account_?id|account){_IS})([A-Za-z0-9_.@-]{{3,}})",
    "weak_secret": rf"((?i:pwd|passphrase|credential|private_?key|secret_?(?:access_?)?key|access_?key|auth){_IS}[A-Za-z0-9+/_.=-]{{6}}|{MIXED})([A-Za-z0-9+/_.=-]*)",
    "endpoint": rf"([a-z][a-z0-9+]{{1,20}}://|(?i:host|server|endpoint){_IS})([A-Za-z0-9][A-Za-z0-9.:/_-]{{2,}})",
}


def _op7(scope: int = 400) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    lists = " UNION ALL ".join(
        f"SELECT doc_id, text, {quoted(kind)} AS kind, {rank} AS rank, regexp_extract_all(text, {quoted(pattern)}, 0) AS m, regexp_extract_all(text, {quoted(pattern)}, 2) AS v FROM t"
        for rank, (kind, pattern) in enumerate(_KINDS.items())
    )
    return f"""
WITH RECURSIVE t AS (
  SELECT doc_id, translate(coalesce(text, ''), chr(383) || chr(8490), chr(57346) || chr(57346)) AS text FROM documents
), hits AS (
  SELECT * FROM ({lists}) WHERE len(m) > 0
), steps AS (
  -- A match is the first place of its own text behind the match before it: at an earlier place its pattern would have matched too.
  SELECT doc_id, kind, rank, 1 AS k, strpos(text, m[1]) - 1 AS start, strpos(text, m[1]) - 1 + length(m[1]) AS stop, length(m[1]) AS whole, length(v[1]) AS value FROM hits
  UNION ALL
  SELECT s.doc_id, s.kind, s.rank, s.k + 1, s.stop + strpos(substr(h.text, s.stop + 1), h.m[s.k + 1]) - 1,
         s.stop + strpos(substr(h.text, s.stop + 1), h.m[s.k + 1]) - 1 + length(h.m[s.k + 1]), length(h.m[s.k + 1]), length(h.v[s.k + 1])
  FROM steps s JOIN hits h ON h.doc_id = s.doc_id AND h.kind = s.kind WHERE s.k < len(h.m)
), parts AS (
  SELECT doc_id, kind, rank, start, stop FROM steps
  WHERE CASE kind WHEN 'assign' THEN value >= 6 WHEN 'access' THEN whole >= 20 WHEN 'hex' THEN whole >= 24 ELSE true END
), pairs AS (
  SELECT p.doc_id, p.kind, p.rank, p.start, p.stop,
         bool_or(abs(q.start - p.start) <= {scope} AND q.kind IN ('assign', 'hex', 'weak_secret')) AS by_secret,
         bool_or(abs(q.start - p.start) <= {scope} AND q.kind IN ('access', 'weak_id', 'endpoint')) AS by_other,
         bool_or(q.kind IN ('assign', 'access', 'hex') AND q.start <= p.start AND p.start < q.stop) AS inside
  FROM parts p JOIN parts q ON q.doc_id = p.doc_id GROUP BY p.doc_id, p.kind, p.rank, p.start, p.stop
), found AS (
  SELECT *, rank < 3 AS base, kind || ':' || start || ':' || stop AS span FROM pairs
  WHERE rank < 3 OR (NOT inside AND CASE WHEN kind = 'weak_secret' THEN by_other ELSE by_secret END)
), listed AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE base) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM found GROUP BY doc_id
), joined AS (
  SELECT s.doc_id, string_agg(s.span || '>' || o.span, ',' ORDER BY s.start, s.rank, o.start, o.rank) AS linked
  FROM found s JOIN found o ON o.doc_id = s.doc_id AND abs(o.start - s.start) <= {scope}
  WHERE s.kind IN ('assign', 'hex', 'weak_secret') AND o.kind IN ('access', 'weak_id', 'endpoint') GROUP BY s.doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(linked, '') AS linked
FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id LEFT JOIN joined j ON d.doc_id = j.doc_id
"""


OP8 = """
WITH t AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), sized AS (
  SELECT doc_id, b, octet_length(b) AS n FROM t
), places AS (
  SELECT doc_id, b, unnest(range(n - 199)) AS i FROM sized WHERE n >= 200
), named AS (
  SELECT doc_id, i, md5(b[i + 1 : i + 200]) AS name FROM places
), repeated AS (
  SELECT doc_id, i FROM named SEMI JOIN (SELECT name FROM named GROUP BY name HAVING count(*) > 1) USING (name)
), fresh AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS f FROM repeated
), numbered AS (
  SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM fresh
), runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM numbered GROUP BY doc_id, run
), pieces AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM runs
  UNION ALL
  SELECT s.doc_id, coalesce(max(r.z), 0), s.n FROM sized s LEFT JOIN runs r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n
)
SELECT s.doc_id, s.n AS n_bytes, (s.n - sum(hi - lo))::BIGINT AS n_removed, count(*) - 1 AS n_spans,
       sha256(unhex(string_agg(CASE WHEN lo < hi THEN hex(s.b[lo + 1 : hi]) ELSE '' END, '' ORDER BY lo))) AS kept_sha256
FROM sized s JOIN pieces p ON p.doc_id = s.doc_id GROUP BY s.doc_id, s.n
"""


#: Occurrences of all phrases up to five words; those of longer candidates rule out all of their parts, not only the next shorter ones.
OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM split, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k)
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 100
), inner_parts AS (
  SELECT DISTINCT lang, array_to_string(ws[i : j], ' ') AS phrase, a AS longer FROM (SELECT *, unnest(range(i + 1, k + 1)) AS j FROM (SELECT *, unnest(range(1, k)) AS i FROM c WHERE k > 2)) WHERE j - i + 1 < k
), kept AS (
  SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inner_parts p WHERE p.lang = c.lang AND p.phrase = c.phrase AND 100 * p.longer >= 100 * c.a)
), cuts AS (
  SELECT x.lang, x.phrase, x.a, l.f AS l, r.f AS r, t.n, i, (1000::HUGEINT * x.a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS i FROM kept) x JOIN totals t ON t.lang = x.lang
  JOIN f l ON l.lang = x.lang AND l.k = x.i AND l.phrase = array_to_string(x.ws[1 : x.i], ' ')
  JOIN f r ON r.lang = x.lang AND r.k = x.k - x.i AND r.phrase = array_to_string(x.ws[x.i + 1 : x.k], ' ')
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS place FROM cuts
), ordered AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM lowest WHERE place = 1
)
SELECT * FROM ordered WHERE rank <= 2000
"""


def _op11() -> str:
    """crc32 by its table; then for each row the least (cost, audit, lines) of each state, from those of the row before."""
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {2: "user", 3: "assistant"}
    ways: dict[int, list[str]] = {s: [] for s in range(4)}
    for state in range(4):
        at, lines = state, []
        for inserts in range(3):
            base = lambda to, allowed, cost, letter, more, at=state, n=inserts, said=tuple(lines): ways[to].append(
                f"CASE WHEN {allowed} THEN {{'c': v[{at + 1}].c + {5 * n} + {cost}, 'a': v[{at + 1}].a || '{'I' * n + letter}', 'o': v[{at + 1}].o || [{', '.join([*said, *more])}]::VARCHAR[]}} END"
            )
            base(at, "true", 2, "D", [])
            for initial, to in after[at].items():
                base(to, f"must < 2 AND left(role, 1) = '{initial}'", "5 * must", "K", ["role || ':' || text"])
            to = next(t for i, t in after[at].items() if i != "s")
            base(to, "must < 2", "1 + 5 * must", "R", [f"'{names[to]}:' || text"])
            lines.append(f"'{names[to]}:'")
            at = to
    step = ", ".join(f"list_min([{', '.join(ways[s])}])" for s in range(4))
    ends = ", ".join(f"{{'c': v[{s + 1}].c + {5 * len(t)}, 'a': v[{s + 1}].a || '{'I' * len(t)}', 'o': v[{s + 1}].o || {t}::VARCHAR[]}}" for s, t in ((0, []), (1, ["user:", "assistant:"]), (2, ["assistant:"]), (3, [])))
    first = ", ".join(f"{{'c': {0 if s == 0 else 1_000_000_000}::BIGINT, 'a': '', 'o': []::VARCHAR[]}}" for s in range(4))
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), kinds AS (
  SELECT raw.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) % 20 AS kind FROM raw, crc
), kept AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM kept
), faults AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][ 	-
]*$') AS open_end,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS neighbours
  FROM numbered
), judged AS (
  SELECT *, CASE WHEN blank OR again THEN 2 WHEN open_end THEN 1 ELSE 0 END AS must FROM faults
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
), ways AS (
  SELECT conv_id, 0::BIGINT AS i, [{first}] AS v FROM ids
  UNION ALL
  SELECT conv_id, i, [{step}] FROM (SELECT w.conv_id, j.i, w.v, j.role, j.text, j.must FROM ways w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1)
), best AS (
  SELECT conv_id, list_min([{ends}]) AS w FROM ways QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), counted AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE must = 1) AS truncated,
         count(*) FILTER (WHERE neighbours IS NOT NULL AND neighbours NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       w.c::BIGINT AS cost, w.a AS audit, sha256(array_to_string(w.o, chr(10))) AS repaired_sha256
FROM best b LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""


ORACLES = {
    "op3_exact_dedup": OP3,
    "op7_secret_scan": _op7(),
    "op8_suffix_dedup": OP8,
    "op9_minhash_dedup": OP9,
    "op10_line_dedup": OP10,
    "op11_conversation_repair": _op11(),
    "op12_collocations": OP12,
}
