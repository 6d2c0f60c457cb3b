"""DuckDB SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

URL_RULES = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), split AS (
  SELECT page_id,
    translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), rules(rule_host, rule_path, says) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(says, 'allow') AS verdict
FROM split LEFT JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) = 1
"""

QUALITY_RULES = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '<none>') AS host, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS filled
  FROM docs
), windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM worded, unnest(range(1, len(words) - 1)) AS t(i)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), base AS (
  SELECT doc_id, host, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(filled) - len(list_distinct(filled)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM worded LEFT JOIN repeats USING (doc_id)
), lines AS (
  SELECT doc_id, host, trim(regexp_replace(lower(unnest(filled)), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM worded
), frequent AS (
  SELECT host, line FROM lines JOIN (SELECT host, count(DISTINCT doc_id) AS n_host FROM docs GROUP BY host) USING (host)
  GROUP BY host, line, n_host
  HAVING count(DISTINCT doc_id) > {line_docs} AND count(DISTINCT doc_id) > {line_share} * n_host
), removed AS (
  SELECT doc_id, count(*) AS cut, sum(len(string_split(line, ' '))) AS lost
  FROM lines JOIN frequent USING (host, line) GROUP BY doc_id
), judged AS (
  SELECT *, n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_pct} * n_words AS base_failed,
    coalesce(cut, 0)::BIGINT AS n_lines_removed, coalesce(lost, 0)::BIGINT AS n_words_removed
  FROM base LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - n_words_removed >= {keep_share} * n_words AS kept, n_lines_removed, n_words_removed
FROM judged
"""


CHAT_SNAPSHOTS = r"""
WITH numbered AS (
  SELECT conv_id, role, text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), talks AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY n) AS talk, count(*) AS n_turns
  FROM numbered GROUP BY conv_id
), snapshots AS (
  SELECT DISTINCT talk[1:k] AS talk FROM talks, unnest(range(1, n_turns)) AS t(k)
), kept AS (
  SELECT min(conv_id) AS conv_id, n_turns FROM talks ANTI JOIN snapshots USING (talk) GROUP BY talk, n_turns
)
SELECT conv_id, n_turns, CAST((n - 1) // {turns} AS INTEGER) AS segment, CAST(count(*) AS INTEGER) AS segment_turns,
  string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
             ORDER BY n) AS rendered
FROM numbered JOIN kept USING (conv_id) GROUP BY ALL
"""

SUBSTRING_DEDUP = r"""
WITH worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + {size} - 1], ' ') AS w
  FROM worded, unnest(range(1, len(words) - {size} + 2)) AS t(i)
), earliest AS (
  SELECT w, min(doc_id) AS first_id FROM windows GROUP BY w
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {size})) AS p
  FROM windows JOIN earliest USING (w) WHERE first_id < doc_id
), each AS (
  SELECT doc_id, p, words[p] AS word FROM worded, unnest(range(1, len(words) + 1)) AS t(p)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS content, count(*) AS n
  FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(content, '')) AS kept_sha256
FROM worded LEFT JOIN kept USING (doc_id)
"""


LEXICAL_SEARCH = r"""
WITH tokens AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), postings AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY ALL),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM postings, corpus GROUP BY term
), asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), scored AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN sizes USING (doc_id), corpus
    GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= {best}
"""


PHRASES = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), worded AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces
), grams AS (
    SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase
    FROM worded, (VALUES (1), (2), (3)) AS sizes(size)
), counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= {least}),
covered AS (
    SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM candidates WHERE size = 3
), kept AS (
    SELECT c.*, above FROM candidates AS c LEFT JOIN (SELECT lang, phrase, max(a) AS above FROM covered GROUP BY ALL) USING (lang, phrase)
    WHERE size = 3 OR above IS NULL OR 100 * above < {covered_pct} * a
), cuts AS (
    SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first_part, array_to_string(w[k + 1:size], ' ') AS rest
    FROM kept, (VALUES (1), (2)) AS spots(k) WHERE k < size
), scored AS (
    SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r,
        CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM cuts AS c JOIN counts AS x ON x.lang = c.lang AND x.phrase = first_part JOIN counts AS y ON y.lang = c.lang AND y.phrase = rest
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n, score
FROM lowest JOIN totals USING (lang)
QUALIFY rank <= {top}
"""


def oracle_sql() -> dict[str, str]:
    from tessera.llm import chat, lexical, phrases, quality, substring

    return {
        "op1_chat_snapshots": CHAT_SNAPSHOTS.format(turns=chat.SEGMENT_TURNS),
        "op4_substring_dedup": SUBSTRING_DEDUP.format(size=substring.WINDOW),
        "op7_url_rules": URL_RULES,
        "op8_quality_rules": QUALITY_RULES.format(
            line_docs=quality.LINE_DOCS, line_share=quality.LINE_SHARE, keep_share=quality.KEEP_SHARE,
            min_words=quality.MIN_WORDS, max_repeat_pct=quality.MAX_REPEAT_PCT,
        ),
        "op11_lexical_search": LEXICAL_SEARCH.format(best=lexical.BEST),
        "op12_phrases": PHRASES.format(least=phrases.LEAST, covered_pct=phrases.COVERED_PCT, top=phrases.TOP),
    }
