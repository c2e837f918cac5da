"""SQL that must give the same rows as the queries on spelling, decontamination and conversation repair."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(column: str) -> str:
    return f"translate({column}, '{_UPPER}', '{_LOWER}')"


# The table of crc32 (the reversed polynomial 0xEDB88320), and the checksum over the bytes of a text.
_CRC_TABLE = """
crc_table AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) r(i)
)"""


def _crc(text: str) -> str:
    """The checksum of a text; the table is joined as ``t``."""
    byte = f"('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT"
    return (f"xor(list_reduce(range(strlen({text})), lambda c, i: xor(c >> 8, t[1 + (xor(c, {byte}) & 255)]), 4294967295::BIGINT), "
            "4294967295)")


SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all({_lowered("text")}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents) GROUP BY ALL
), marked AS (
  SELECT run, times, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc_table
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word,
         sum(times)::BIGINT AS n
  FROM marked GROUP BY 1 HAVING length(word) >= 6 AND n >= 5
), cut AS (
  SELECT word, n, -1 AS i, word AS rest FROM words
  UNION SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) FROM words, range(length(word)) r(i)
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest
  WHERE a.word <> b.word AND (a.i = b.i OR a.i = -1 OR b.i = -1)
), best AS (
  SELECT word, count(*) AS n_near, min(struct_pack(m := -m, other := other)) AS b FROM near GROUP BY word
), forms AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 5 * n THEN b.other END AS form,
         CASE WHEN -b.m >= 5 * n THEN -b.m END AS form_n
  FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS last_, 0 AS step FROM forms
  UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.last_ WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n
FROM forms JOIN (SELECT word, arg_max(last_, step) AS root FROM chain GROUP BY word) USING (word)
"""

_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

LEAKS = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format(_lowered("text"))}, []) AS w FROM documents
), i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS.format(_lowered("text"))} AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[p + 1:p + least(10, len(w))], ' ') AS words
  FROM i, range(greatest(len(w) - 9, least(1, len(w)))) x(p)
), places AS (
  SELECT r, p, size, array_to_string(w[p + 1:p + size], ' ') AS words
  FROM d, (SELECT DISTINCT size FROM windows) s, range(greatest(len(w) - size + 1, 0)) x(p)
), found AS (
  SELECT r, p, size, item FROM places JOIN windows USING (size, words)
), hits AS (
  SELECT r, count(DISTINCT p + q) AS n FROM (SELECT DISTINCT r, p, size FROM found), range(size) x(q) GROUP BY r
), named AS (
  SELECT r, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
       coalesce(names, sha256('')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""

# The least way from each state to the end, row by row from the last, as (cost, audit, repaired text); states 0 to 3
# are nothing yet, after s, after u, after a. Edits are looked up in ``moves``: up to two inserts, then the row's own.
REPAIR = f"""
WITH RECURSIVE {_CRC_TABLE}, named AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations
), damaged AS (
  SELECT conv_id, turn, h, CASE WHEN h = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
  FROM (SELECT *, {_crc("place")} % 20 AS h FROM named, crc_table) WHERE h <> 0
), rows_ AS (
  SELECT conv_id, turn, role, text, row_number() OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS k
  FROM damaged, range(CASE WHEN h = 3 THEN 2 ELSE 1 END)
), faults AS (
  SELECT *, left(role, 1) AS initial, CASE
    WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair
  FROM rows_
), inserts(state, goes, paid, letters, made) AS (
  VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
         (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:']),
         (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])
), own(goes, after, edit, initial, role) AS (
  VALUES (0, 0, 'D', NULL, NULL), (1, 1, 'D', NULL, NULL), (2, 2, 'D', NULL, NULL), (3, 3, 'D', NULL, NULL),
         (0, 1, 'K', 's', NULL), (0, 2, 'K', 'u', NULL), (1, 2, 'K', 'u', NULL), (3, 2, 'K', 'u', NULL), (2, 3, 'K', 'a', NULL),
         (0, 2, 'R', NULL, 'user'), (1, 2, 'R', NULL, 'user'), (3, 2, 'R', NULL, 'user'), (2, 3, 'R', NULL, 'assistant')
), moves AS (
  SELECT state, after, paid, letters, made, edit, initial, role FROM inserts JOIN own USING (goes)
), ways AS (
  SELECT conv_id, max(k) + 1 AS k, state, least_ AS best FROM faults, (
    SELECT state, min(struct_pack(cost := paid, audit := letters, lines := made)) AS least_ FROM inserts WHERE goes IN (0, 3) GROUP BY state)
  GROUP BY conv_id, state, least_
  UNION ALL
  SELECT f.conv_id, f.k, m.state, min(struct_pack(
      cost := w.best.cost + m.paid + CASE m.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
              + CASE WHEN m.edit <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END,
      audit := m.letters || m.edit || w.best.audit,
      lines := m.made || CASE m.edit WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [m.role || ':' || f.text] END || w.best.lines))
  FROM ways w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k = w.k - 1 JOIN moves m ON m.after = w.state
  WHERE m.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate') AND (m.edit = 'R' OR m.initial = f.initial)
  GROUP BY f.conv_id, f.k, m.state
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ways w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.k = 1 AND w.state = 0
"""
