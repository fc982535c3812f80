"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from tarnwork.llm import conversations, licenses, quality

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

REPEATS = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 19), ' ')) AS own
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 18, 1))) AS i FROM w)),
again AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY own ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM again, range(0, 20) AS t(k)),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
left_over AS (
  SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.pos) AS kept
  FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_over l ON w.doc_id = l.doc_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
parts AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM parts GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM parts a JOIN parts b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common.n >= 75 * (x.n + y.n - common.n)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT l.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, component_id, l.doc_id = component_id AS kept
FROM least l LEFT JOIN sizes s ON l.doc_id = s.doc_id
"""


def _quality() -> str:
    size = len(next(iter(quality.COMMON_WORDS.values())).split())
    lists = " ".join(f"WHEN lang = '{lang}' THEN {words.split()!r}" for lang, words in quality.COMMON_WORDS.items())
    classes = ", ".join(
        f"""length(t) - length(regexp_replace(t, '{p.replace("'", "''")}', '', 'g'))""" for p in quality.CLASSES.values()
    )
    sums = lambda column, n: "[" + ", ".join(f"coalesce(sum({column}[{k + 1}]), 0)" for k in range(n)) + "]"
    shares = lambda counts, total: (
        f"list_transform(list_append({counts}, greatest({total} - list_sum({counts}), 0)), lambda x: CAST(x AS DOUBLE) / greatest({total}, 1))"
    )

    def distance(p: str, q: str) -> str:
        term = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((z[1] + z[2]) / 2)) ELSE 0 END"
        return f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: {term('z[1]')} + {term('z[2]')})) / 2, 0))"

    return f"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS words, CASE {lists} END AS common FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(list_slice(words, i, i + 7), ' ')) AS n
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM w)),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, range(0, 8) AS r(k) WHERE windows.n > 1 GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, lang, t, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    coalesce(repeated.n, 0) AS n_repeat_words, [{classes}] AS chars,
    CASE WHEN common IS NOT NULL THEN list_transform(common, lambda c: len(list_filter(words, lambda x: lower(x) = c))) END AS word_counts
  FROM w LEFT JOIN repeated ON w.doc_id = repeated.doc_id),
refs AS (
  SELECT lang, sum(length(t)) AS all_chars, sum(n_words) AS all_words,
    {sums('chars', len(quality.CLASSES))} AS ref_chars, {sums('word_counts', size)} AS ref_words FROM counts GROUP BY lang),
judged AS (
  SELECT c.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    n_words >= {quality.LEAST_WORDS} AS enough,
    {distance(shares('chars', 'length(t)'), shares('ref_chars', 'all_chars'))} AS char_distance,
    CASE WHEN word_counts IS NOT NULL THEN {distance(shares('word_counts', 'n_words'), shares('ref_words', 'all_words'))} END AS word_distance,
    sqrt({quality.MOST_WORD_DISTANCE} ** 2 + {size} / (8 * ln(2)) / greatest(n_words, 1)) AS most_words
  FROM counts c JOIN refs r ON c.lang IS NOT DISTINCT FROM r.lang)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (enough AND (char_distance > {quality.MOST_CHARACTER_DISTANCE} OR coalesce(word_distance, 0) > most_words)) AS kept
FROM judged
"""


def _licenses() -> str:
    fold = f"translate(%s, '{_UPPER}', '{_LOWER}')"
    words = lambda text: f"regexp_extract_all({fold % text}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    phrases = ", ".join(f"({phrase.split()!r}, '{label}')" for phrase, label in licenses.PHRASES.items())
    notices = ", ".join(f"({k}, '{label}', '{text}')" for k, (label, text) in enumerate(licenses.NOTICES))
    step = licenses.step_of(licenses.NOTICES)
    return f"""
WITH w AS (SELECT doc_id, text, {words("coalesce(text, '')")} AS words FROM documents),
phrases(phrase, label) AS (VALUES {phrases}),
places AS (
  SELECT doc_id, label, i - 1 AS place
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w), phrases
  WHERE list_slice(words, i, i + len(phrase) - 1) = phrase),
base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
    array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM places GROUP BY doc_id),
notices AS (SELECT k, label, list_distinct({words('notice')}) AS own FROM (VALUES {notices}) AS t(k, label, notice)),
blocks AS (
  SELECT doc_id, list_distinct({words('line')}) AS block FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM w)
  UNION ALL SELECT doc_id, list_distinct(list_slice(words, i + 1, i + {2 * step})) AS block
  FROM (SELECT doc_id, words, unnest(range(0, len(words), {step})) AS i FROM w)),
found AS (
  SELECT doc_id, label, len(list_intersect(block, own)) / len(own) AS share FROM blocks, notices
  WHERE len(list_intersect(block, own)) >= ceil({licenses.CONTAINMENT} * len(own) - 1e-9)),
method AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id),
every AS (
  SELECT doc_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels
  FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM found) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM w LEFT JOIN base ON w.doc_id = base.doc_id LEFT JOIN method ON w.doc_id = method.doc_id LEFT JOIN every ON w.doc_id = every.doc_id
"""


def _conversations() -> str:
    """Every row multiplies the states by all edits with up to two insertions before; the least (cost, audit) of a state stays."""
    c = conversations
    moves = []
    for start in range(c.STATES):
        state, price, audit, lines = start, 0, "", []
        for _ in range(3):
            then = c.FOLLOWS[state]
            moves.append((start, state, "D", "", price + c.DELETE, audit + "D", lines))
            moves.append((start, then, "R", "", price + c.REROLE, audit + "R", lines))
            moves.append((start, then, "K", c.NAMES[then][0], price + c.KEEP, audit + "K", lines))
            if state == c.START:
                moves.append((start, c.SYSTEM, "K", "s", price + c.KEEP, audit + "K", lines))
            state, price, audit, lines = then, price + c.INSERT, audit + "I", [*lines, c.NAMES[then] + ":"]
    listed = ", ".join(f"({a}, {b}, '{op}', '{i}', {p}, '{w}', CAST({x!r} AS VARCHAR[]))" for a, b, op, i, p, w, x in moves)
    ends = ", ".join(
        f"({s}, {cost}, '{audit}', CAST({['user:', 'assistant:'][2 - len(audit):]!r} AS VARCHAR[]))" for s, (cost, audit) in c.TAILS.items()
    )
    legal = ", ".join(f"'{p}'" for p in c.LEGAL_PAIRS)
    names = "CASE target " + " ".join(f"WHEN {s} THEN '{n}'" for s, n in c.NAMES.items()) + " END"
    return f"""
WITH RECURSIVE plain AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda i: CAST(ord(name[i]) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 20 AS fate FROM plain),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(0, 2) AS copy(k) WHERE k < CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS pos FROM damaged),
marked AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS open_end,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair FROM numbered),
symbols AS (SELECT *, blank OR again AS must_go, NOT (blank OR again) AND open_end AS truncated FROM marked),
moves(state, target, op, initial, price, edits, lines) AS (VALUES {listed}),
ends(state, price, edits, lines) AS (VALUES {ends}),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS state, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])}} AS best FROM symbols
  UNION ALL
  SELECT w.conv_id, s.pos, m.target, min({{
    'cost': w.best.cost + m.price + CASE WHEN s.truncated AND m.op <> 'D' THEN {c.TRUNCATED} ELSE 0 END, 'audit': w.best.audit || m.edits,
    'lines': list_concat(w.best.lines, m.lines, CASE m.op WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [s.role || ':' || s.text]
      ELSE [{names} || ':' || s.text] END)}})
  FROM walk w JOIN symbols s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND s.pos = w.pos + 1
  JOIN moves m ON m.state = w.state AND (m.op = 'D' OR NOT s.must_go) AND (m.op <> 'K' OR m.initial = left(s.role, 1))
  GROUP BY w.conv_id, s.pos, m.target),
sums AS (
  SELECT conv_id, max(pos) AS n, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ({legal})) AS illegal,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM symbols GROUP BY conv_id),
closed AS (
  SELECT w.conv_id, min({{'cost': w.best.cost + e.price, 'audit': w.best.audit || e.edits, 'lines': list_concat(w.best.lines, e.lines)}}) AS best
  FROM walk w JOIN sums s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.pos = s.n JOIN ends e ON e.state = w.state GROUP BY w.conv_id)
SELECT o.conv_id, {', '.join(f'CAST(coalesce({k}, 0) AS BIGINT) AS {k}' for k in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))},
  CAST(coalesce(b.best.cost, 0) AS BIGINT) AS cost, coalesce(b.best.audit, '') AS audit,
  sha256(coalesce(array_to_string(b.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN closed b ON o.conv_id IS NOT DISTINCT FROM b.conv_id
"""


SQL = {
    "op1_repeats": REPEATS,
    "op5_quality": _quality(),
    "op6_neardup": NEAR_DUPLICATES,
    "op10_licenses": _licenses(),
    "op13_conversations": _conversations(),
}
