"""DuckDB SQL for the rows of op2: every passage against every item that shares a term."""

from .decontamination import B, EPSILON, GRAM, K1, MIN_ANSWER, MIN_BLOCK, OVERLAP, PUNCTUATION, THRESHOLD

_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PUNCTUATION.decode().replace("'", "''")
_TO = "abcdefghijklmnopqrstuvwxyz" + " " * len(PUNCTUATION)


def _terms(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{_FROM}', '{_TO}'), '[^\\x20\\x09-\\x0D]+')"


_MARKS = (("a", "chr(10)"), ("b", "'. '"), ("c", "'? '"), ("d", "'! '"))
_SPLIT = ", ".join(f"{_terms(f'string_split(stripped, {m})[-1]')} AS last_{n}, contains(stripped, {m}) AND string_split(stripped, {m})[-1] <> stripped AND NOT starts_with(stripped, {m}) AS has_{n}" for n, m in _MARKS)
_LAST = " ".join(f"WHEN has_{n} AND len(last_{n}) >= {MIN_ANSWER} AND len(last_{n}) < len(w) THEN len(last_{n})" for n, _ in _MARKS)


def _grams(words: str, n: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({words}) - {n} + 2, 1)), lambda i: array_to_string({words}[i:i + {n} - 1], ' ')))"


def _side(words: str) -> str:
    return _grams(words, f"greatest(1, least({GRAM}, len({words})))")


_AROUND = "list_concat(" + ", ".join(_grams("w", str(n)) for n in range(1, GRAM + 1)) + ")"


OP2 = f"""WITH items AS (SELECT row_number() OVER () AS iid, item_id, trim(text, chr(10) || chr(9) || chr(11) || chr(12) || chr(13) || ' ') AS stripped, {_terms('text')} AS w FROM benchmark WHERE text IS NOT NULL),
split AS (SELECT iid, item_id, w, {_SPLIT} FROM items WHERE len(w) > 0), parted AS (SELECT iid, item_id, w, len(w) - CASE {_LAST} ELSE len(w) // 3 END AS cut FROM split),
sides AS (SELECT iid, item_id, {_side('w[:cut]')} AS q, {_side('w[cut + 1:]')} AS a FROM parted),
stats AS (SELECT count(*) AS n, avg(len(w)) AS mean, greatest({MIN_BLOCK}, max(len(w))) AS block FROM parted),
tf AS (SELECT iid, len, term, count(*) AS tf FROM (SELECT iid, len(w) AS len, unnest(w) AS term FROM parted) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT iid, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * len / mean)) AS w FROM tf JOIN df USING (term), stats),
postings AS (SELECT iid, term, w / sum(w) OVER (PARTITION BY iid) AS w FROM raw),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {_terms('text')} AS w FROM documents WHERE text IS NOT NULL), sized AS (SELECT docs.*, ceil(len(w) / block)::BIGINT AS blocks, block FROM docs, stats WHERE len(w) > 0),
passages AS (SELECT rid, doc_id, block, unnest(range(greatest(blocks - 1, 1))) AS k, w FROM sized),
found AS (SELECT rid, k, unnest(list_distinct(w[k * block + 1:(k + 2) * block])) AS term FROM passages),
scored AS (SELECT rid, k, iid, sum(p.w) AS score FROM found JOIN postings p USING (term) GROUP BY ALL HAVING sum(p.w) >= {THRESHOLD} - {EPSILON}),
around AS (SELECT s.*, p.doc_id, p.w[greatest(0, (s.k - 1) * block) + 1:(s.k + 3) * block] AS w FROM scored s JOIN passages p ON s.rid = p.rid AND s.k = p.k),
checked AS (SELECT rid, doc_id, item_id, score, len(list_intersect(q, g)) / greatest(len(q), 1) AS q, len(list_intersect(a, g)) / greatest(len(a), 1) AS a FROM (SELECT *, {_AROUND} AS g FROM around) JOIN sides USING (iid)),
best AS (SELECT rid, doc_id, item_id, max({{'score': round(score, 6), 'q': round(q, 6), 'a': round(a, 6)}}) AS x FROM checked WHERE q >= {OVERLAP} AND a >= {OVERLAP} GROUP BY ALL)
SELECT doc_id, item_id, x.score AS score, x.q AS question_overlap, x.a AS answer_overlap FROM best"""
