"""DuckDB SQL for the operators' queries that SQL can express; each is a plain restatement, by another way."""

from __future__ import annotations

import string

from .decontaminate import SLOP
from .quality import CLASSES, COMMON_WORDS, EDGES, Rules, vocabulary

_WORDS = "regexp_extract_all(translate(coalesce({0}, ''), '" + string.ascii_uppercase + "', '" + string.ascii_lowercase + "'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
n AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM n)),
dk AS (SELECT doc_id, w, z.n, unnest(range(1, len(w) - z.n + 2)) AS k FROM d, (SELECT DISTINCT n FROM n) z WHERE len(w) >= z.n),
hits AS (SELECT DISTINCT doc_id, item_id, k, iw.n FROM (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM dk) x JOIN iw ON iw.n = x.n AND iw.win = x.win),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id),
pos AS (SELECT doc_id, w[p] AS term, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
counts AS (SELECT term, count(*) AS c FROM pos GROUP BY term),
wt AS (SELECT win, n, string_split(win, ' ')[k] AS term, k FROM (SELECT DISTINCT win, n, unnest(range(1, n + 1)) AS k FROM iw)),
ranked AS (SELECT win, list({{'c': c, 'k': k, 'term': term}} ORDER BY c, k) AS r FROM wt JOIN counts USING (term) GROUP BY win, n HAVING count(*) = n),
near AS (SELECT DISTINCT win, a.doc_id FROM ranked JOIN pos a ON a.term = r[1].term JOIN pos b ON b.doc_id = a.doc_id AND b.term = coalesce(r[2].term, r[1].term)
  WHERE abs((b.p - a.p) - coalesce(r[2].k - r[1].k, 0)) <= CASE WHEN len(r) > 1 THEN {SLOP} ELSE 0 END),
near_items AS (SELECT doc_id, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_near FROM near JOIN iw USING (win) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near_items USING (doc_id)"""

LINE_DEDUP = """
WITH d AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
l AS (SELECT doc_id, k - 1 AS line_no, trim(lines[k], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS k FROM d)),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS nth FROM l WHERE length(line) >= 20),
c AS (SELECT line, min(nth) AS first FROM o GROUP BY line),
h AS (SELECT line, first, t, s, CASE s WHEN 0 THEN left(line, (t - 1) // 2) ELSE right(line, (t - 1) // 2) END AS half
  FROM (SELECT *, unnest([length(line), length(line) + 1]) AS t FROM c), (VALUES (0), (1)) v(s)),
p AS (SELECT DISTINCT a.line AS a, b.line AS b FROM h a JOIN h b ON a.t = b.t AND a.s = b.s AND a.half = b.half AND a.first > b.first),
late AS (SELECT DISTINCT a AS line FROM p WHERE
  (length(a) = length(b) AND len(list_filter(range(1, length(a) + 1), lambda i: a[i] <> b[i])) = 1)
  OR (length(a) = length(b) + 1 AND len(list_filter(range(1, length(a) + 1), lambda i: left(a, i - 1) || substr(a, i + 1) = b)) > 0)
  OR (length(b) = length(a) + 1 AND len(list_filter(range(1, length(b) + 1), lambda i: left(b, i - 1) || substr(b, i + 1) = a)) > 0)),
g AS (SELECT doc_id, list(line_no) AS removed FROM o JOIN c USING (line) WHERE nth <> first OR line IN (SELECT line FROM late) GROUP BY doc_id)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(len(removed), 0) AS BIGINT) AS n_removed,
CASE WHEN removed IS NULL THEN sha256(text) ELSE sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda k: NOT list_contains(removed, k - 1)), lambda k: lines[k]), chr(10)), '')) END AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT *, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE first < doc_id),
runs AS (SELECT doc_id, p, sum(CASE WHEN p <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM (SELECT *, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -100) AS before FROM hit)),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY doc_id, run),
g AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE left(h, 2 * a[1]) || array_to_string(list_transform(range(1, len(a) + 1),
  lambda i: substr(h, 2 * b[i] + 1, 2 * (CASE WHEN i < len(a) THEN a[i + 1] ELSE n END - b[i]))), '') END)) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_sql(rules: Rules = Rules()) -> str:
    """Base counts, and Jensen-Shannon distances from the sums of each language."""
    words, classes = len(vocabulary()) + 1, len(CLASSES) + 2
    counted = ", ".join(f"length(t) - length(regexp_replace(t, {_quote(p)}, '', 'g'))" for p in CLASSES.values())

    def distance(counts: str, total: str, ref: str) -> str:
        p, q = f"({counts}[i] / {total}::DOUBLE)", f"{ref}[i]"
        part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
        return f"sqrt(greatest(0, list_sum(list_transform(range(1, len({ref}) + 1), lambda i: {part(p)} + {part(q)})) / 2))"

    return f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
v AS (SELECT *, list_transform(w, lambda x: translate(trim(x, {_quote(EDGES)}), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) AS folded FROM t),
c AS (SELECT *, len(w) AS n, list_transform({_listed(vocabulary())}, lambda y: len(list_filter(folded, lambda x: x = y))) AS common,
  [{counted}, strlen(t) - length(t)] AS counted, length(array_to_string(w, '')) AS word_chars FROM v),
f AS (SELECT *, list_append(common, n - list_sum(common)) AS hw, list_append(counted, greatest(0, word_chars - list_sum(counted))) AS hc FROM c),
k AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, win) AS c FROM (SELECT doc_id, k, array_to_string(w[k:k + 4], ' ') AS win FROM (SELECT *, unnest(range(1, n - 3)) AS k FROM f WHERE n >= 5))),
rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM k WHERE c > 1) GROUP BY doc_id),
e AS (SELECT *, coalesce(r, 0) AS n_repeat, n < {rules.min_words} OR 100 * coalesce(r, 0) > {rules.max_repeat_percent} * n AS failed FROM f LEFT JOIN rep USING (doc_id)),
r AS (SELECT lang, list_transform(range(1, {words + 1}), lambda i: sw[i] / list_sum(sw)::DOUBLE) AS rw, list_transform(range(1, {classes + 1}), lambda i: sc[i] / list_sum(sc)::DOUBLE) AS rc
  FROM (SELECT lang, [{", ".join(f"sum(hw[{i}])" for i in range(1, words + 1))}] AS sw, [{", ".join(f"sum(hc[{i}])" for i in range(1, classes + 1))}] AS sc
  FROM e WHERE n >= {rules.word_guard} AND NOT failed AND lang IN ({", ".join(f"'{k}'" for k in COMMON_WORDS)}) GROUP BY lang)),
far AS (SELECT doc_id, min({distance("hw", "n", "rw")}) AS dw, min({distance("hc", "list_sum(hc)", "rc")}) AS dc FROM f, r WHERE n >= 5 AND (f.lang IS NULL OR f.lang IN (SELECT lang FROM r)) GROUP BY doc_id),
b AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM e LEFT JOIN far USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat AS BIGINT) AS n_repeat_words, failed AS base_failed,
NOT failed AND NOT (n >= {rules.word_guard} AND coalesce(dw > {rules.max_word_distance}, false))
AND NOT (word_chars >= {rules.char_guard} AND coalesce(dc > {rules.max_char_distance}, false)) AS kept FROM b"""


SQL = {"op1_benchmark_decontamination": DECONTAMINATION, "op7_line_dedup": LINE_DEDUP, "op9_suffix_dedup": SUFFIX_DEDUP, "op10_quality_rules": quality_sql()}
