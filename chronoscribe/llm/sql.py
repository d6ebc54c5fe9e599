"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from chronoscribe.llm import quality, secret

_BLANKS = r"[^\x20\x09-\x0D]+"
_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(name: str, table: str, ids: str, text: str, pattern: str) -> str:
    """CTE (ids, i, x): one row for each word."""
    return (f"{name} AS (SELECT {ids}, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM "
            f"(SELECT {ids}, regexp_extract_all({text}, {_quoted(pattern)}) AS ws FROM {table}))")


def secrets() -> str:
    parts = []
    for n, r in enumerate(secret.RULES):
        p = _quoted(r.pattern)
        parts.append(f"""SELECT doc_id, {n} AS number, '{r.kind}' AS kind,
      CAST(list_sum(list_transform(parts[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS s, len(m[i]) AS n
    FROM (SELECT doc_id, parts, m, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, string_split_regex(t, {p}) AS parts, regexp_extract_all(t, {p}) AS m FROM d WHERE regexp_matches(t, {p})))
    WHERE len({f"regexp_extract(m[i], {p}, {r.group})" if r.group else "m[i]"}) >= {r.least}""")
    counts = ", ".join(f"count(*) FILTER (number = {n}) AS n_{r.kind}" for n, r in enumerate(secret.BASE))
    one = "string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, number)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({" UNION ALL ".join(parts)})
  SELECT doc_id, {counts}, sha256(coalesce({one} FILTER (number < {len(secret.BASE)}), '')) AS base_sha256, coalesce({one}, '') AS spans
  FROM documents LEFT JOIN found USING (doc_id) GROUP BY doc_id"""


def chats() -> str:
    odd = _quoted("\\### Assistant: </turn> ok")
    longer = ("len({0}) + len({0}) - len(replace({0}, '\\', '')) + coalesce(list_sum(list_transform(regexp_extract_all({0}, '###+'), lambda x: len(x) - 2)), 0)"
              " + len(regexp_extract_all({0}, '</turn>'))")
    role, text = longer.format("role") + " + len(regexp_extract_all(role, ':'))", longer.format("text")
    return f"""WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', {odd} UNION ALL SELECT -7, 1, 'assistant', {odd})
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(6 + 8 + {role} + {text}) AS BIGINT) AS formatted_chars
  FROM rows_ GROUP BY conv_id"""


def jaccard() -> str:
    return f"""WITH RECURSIVE {_words("w", "documents", "doc_id", _LOW.format("text"), _BLANKS)},
  g AS (SELECT doc_id, x, lead(x, 1) OVER o AS x2, lead(x, 2) OVER o AS x3, lead(x, 3) OVER o AS x4, count(*) OVER (PARTITION BY doc_id) AS n, i
    FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  sh AS (SELECT DISTINCT doc_id, x || ' ' || x2 || ' ' || x3 || ' ' || x4 AS s FROM g WHERE x4 IS NOT NULL
    UNION SELECT doc_id, string_agg(x, ' ' ORDER BY i) FROM g WHERE n < 4 GROUP BY doc_id),
  sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
  met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  link AS (SELECT a, b FROM met JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
  both_ AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
  reach AS (SELECT a, b FROM both_ UNION SELECT r.a, k.b FROM reach r JOIN both_ k ON k.a = r.b)
  SELECT d.doc_id, coalesce(sz.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
  FROM documents d LEFT JOIN sz USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) m USING (doc_id)"""


def quality_rules() -> str:
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(quality.RULES))
    base, full = quality.mask("base-1"), quality.mask(quality.POLICY)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {_words("w", "d", "doc_id", "t", _BLANKS)},
  c AS (SELECT doc_id, count(*) AS n_words, sum(len(x)) AS word_chars, count(*) FILTER (regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]')) AS n_alpha_words FROM w GROUP BY doc_id),
  g AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS gram FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  gc AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS k FROM g WHERE gram IS NOT NULL),
  rp AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM gc, range(3) r(j) WHERE k > 1 GROUP BY doc_id),
  l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
  ll AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
  m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_alpha_words, 0) AS n_alpha_words
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN rp USING (doc_id) LEFT JOIN ll USING (doc_id)),
  f AS (SELECT *, CAST({bits} AS BIGINT) AS failures FROM m)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures, failures & {base} <> 0 AS base_failed,
    failures & {base} = 0 AND failures & {full} = 0 AS kept FROM f"""


def winnowing() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""WITH {_words("dw", "documents", "doc_id", _LOW.format("text"), word)},
  di AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOW.format("text")}, {_quoted(word)}) AS ws FROM benchmark),
  iw AS (SELECT DISTINCT item, least(10, len(ws)) AS m, array_to_string(ws[k:k + least(10, len(ws)) - 1], ' ') AS win
    FROM (SELECT item, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS k FROM di WHERE len(ws) > 0)),
  ten AS (SELECT doc_id, i, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ws FROM dw),
  win AS (SELECT doc_id, i, m, array_to_string(ws[1:m], ' ') AS win FROM ten, (SELECT DISTINCT m FROM iw) WHERE len(ws) >= m),
  hit AS (SELECT DISTINCT doc_id, i, m, item FROM win JOIN iw USING (m, win)),
  words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range(10) r(k) WHERE k < m GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id),
  n AS (SELECT doc_id, count(*) AS n_words FROM dw GROUP BY doc_id)
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
  FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def filter_audit() -> str:
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
  f AS (SELECT doc_id, part, t, regexp_extract_all(t, '{_BLANKS}') AS ws, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
  lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
  m AS (SELECT part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
      + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * len(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
      + CASE WHEN low < doc_id THEN 16 ELSE 0 END AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN lab USING (doc_id)),
  c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
  x AS (SELECT unnest(string_split('ABCDE', '')) AS l),
  o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
  s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i] AS filter, 1 << (ascii(filter_order[i]) - 65) AS bit,
      CAST(coalesce(list_sum(list_transform(string_split(left(filter_order, i - 1), ''), lambda y: CASE WHEN y = '' THEN 0 ELSE 1 << (ascii(y) - 65) END)), 0) AS INTEGER) AS before
    FROM o, range(1, 6) r(i)),
  t AS (SELECT part, filter_order, step, filter, sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS removed,
      sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
      sum(good) FILTER (mask & before = 0 AND mask & bit <> 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0) AS toxic_lost
    FROM c, s GROUP BY 1, 2, 3, 4)
  SELECT part, filter_order, step, filter, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
    CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM t"""


def spelling() -> str:
    table = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    run = f"regexp_extract_all({_LOW.format('text')}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')"
    return f"""WITH RECURSIVE r AS (SELECT doc_id, unnest({run}) AS run FROM documents),
  c AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, run, count(*) AS n FROM r WHERE len(run) >= 6 GROUP BY ALL),
  x AS (SELECT run, n, hex(encode(s)) AS b FROM c),
  h AS (SELECT run, n, xor(list_reduce(list_transform(range(1, len(b) + 1), lambda i: strpos('0123456789ABCDEF', b[i - 1 + 2 * (i % 2)]) - 1),
      lambda a, d: xor(a >> 4, CAST({table}[(xor(a, d) & 15) + 1] AS BIGINT)), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM x),
  w AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, n FROM h),
  v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
  e AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM v, (SELECT unnest(range(1, (SELECT max(len(word)) FROM v) + 1)) AS i) WHERE i <= len(word)),
  p AS (SELECT e.word AS a, v.word AS b FROM e JOIN v ON v.word = e.a || e.b
    UNION SELECT x.word, y.word FROM e x JOIN e y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word < y.word),
  near AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
  best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-v.n, b)) AS form, max(v.n) AS form_n FROM near JOIN v ON v.word = b GROUP BY a),
  f AS (SELECT v.word, n, n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
  chain AS (SELECT word, word AS seen, 0 AS k FROM f UNION ALL SELECT chain.word, f.form, k + 1 FROM chain JOIN f ON f.word = chain.seen WHERE f.form IS NOT NULL)
  SELECT f.word, form, root, n, coalesce(n_near, 0) AS n_near, form_n FROM f JOIN (SELECT word, arg_max(seen, k) AS root FROM chain GROUP BY word) USING (word)"""
