"""DuckDB SQL for the rows of op4."""

from .quality_rules import FEATURES, MAX_REPEAT_PERCENT, MIN_GROUP, MIN_WORDS, SPREAD

WORD = r"[^\x20\x09-\x0D]+"

#: Measures of the table {docs}, each document once per row number.
MEASURED = f"""
numbered AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM {{docs}}),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT rid, regexp_extract_all(text, '{WORD}') AS w FROM numbered)),
grams AS (SELECT rid, pos, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY rid ORDER BY pos)),
windows AS (SELECT rid, pos, w3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, word, w2, w3) > 1 AS again FROM grams),
covered AS (SELECT rid, pos, again OR coalesce(lag(again, 1) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS c FROM windows WINDOW o AS (PARTITION BY rid ORDER BY pos)),
repeats AS (SELECT rid, count(*) FILTER (WHERE c) AS n FROM covered GROUP BY rid),
counted AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY rid),
lines AS (SELECT rid, line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM numbered) WHERE regexp_matches(line, '{WORD}')),
line_counts AS (SELECT rid, count(*) AS n_lines, count(DISTINCT line) AS n_distinct FROM lines GROUP BY rid),
measured AS (
  SELECT rid, doc_id, lang, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines - n_distinct, 0)::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper
  FROM numbered LEFT JOIN counted USING (rid) LEFT JOIN line_counts USING (rid) LEFT JOIN repeats r USING (rid))"""

_VALUES = ", ".join(f"('{f}', {sql.replace(' div ', ' // ')}, {side}, {slack})" for f, sql, side, slack in FEATURES)
_FIELDS = "rid, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper"

VERDICTS = f"""
valued AS (SELECT rid, lang, source, x.feature, x.v::BIGINT AS v, x.side, x.slack
  FROM (SELECT * FROM measured WHERE n_words > 0) m, LATERAL (SELECT * FROM (VALUES {_VALUES}) AS t(feature, v, side, slack)) x),
bucketed AS (SELECT *, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bucket FROM valued),
levels AS (
  SELECT 2 AS level, lang, source, feature, bucket, count(*) AS n FROM bucketed GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, feature, bucket, count(*) FROM bucketed GROUP BY ALL
  UNION ALL SELECT 0, NULL, NULL, feature, bucket, count(*) FROM bucketed GROUP BY ALL),
summed AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, feature) AS total, sum(n) OVER (PARTITION BY level, lang, source, feature ORDER BY bucket) AS upto FROM levels),
quantiles AS (SELECT level, lang, source, feature, max(total) AS total, min(bucket) FILTER (WHERE upto * 100 >= 10 * total) AS q10,
  min(bucket) FILTER (WHERE upto * 100 >= 50 * total) AS q50, min(bucket) FILTER (WHERE upto * 100 >= 90 * total) AS q90 FROM summed GROUP BY ALL),
picked AS (SELECT a.lang, a.source, a.feature,
  {", ".join(f"CASE WHEN a.total >= {MIN_GROUP} THEN a.{q} WHEN b.total >= {MIN_GROUP} THEN b.{q} ELSE c.{q} END AS {q}" for q in ("q10", "q50", "q90"))}
  FROM quantiles a JOIN quantiles b ON a.level = 2 AND b.level = 1 AND a.lang IS NOT DISTINCT FROM b.lang AND a.feature = b.feature JOIN quantiles c ON c.level = 0 AND a.feature = c.feature),
outside AS (SELECT rid FROM valued v JOIN picked p ON v.lang IS NOT DISTINCT FROM p.lang AND v.source IS NOT DISTINCT FROM p.source AND v.feature = p.feature
  WHERE CASE WHEN side = 1 THEN v > q50 + greatest(slack, {SPREAD} * (q50 - q10)) ELSE v < q50 - greatest(slack, {SPREAD} * (q90 - q50)) END GROUP BY rid),
judged AS (SELECT m.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND o.rid IS NULL AS kept FROM measured m LEFT JOIN outside o ON m.rid = o.rid)"""

OP4 = f"WITH {MEASURED.format(docs='documents')}, {VERDICTS}\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
