"""The same results in SQL, for the operators that SQL can express."""

from __future__ import annotations

import string

from ledgerloom.llm import contamination as cn
from ledgerloom.llm import mixing as mx
from ledgerloom.llm import ngram_join as ng
from ledgerloom.llm import quality_rules as qr
from ledgerloom.llm import substring_dedup as sd

_RATES = {
    "symbols": "n_symbols * 1000 // n_words", "dup_lines": "n_dup_lines * 1000 // n_lines",
    "repeats": "n_repeat_words * 1000 // n_words", "word_length": "word_chars * 1000 // n_words",
}


def _sketch() -> str:
    return " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {rate} AS v FROM measured WHERE n_words > 0"
                              for m, rate in _RATES.items())


def _quartiles(keys: str) -> str:
    by = f"{keys}, measure" if keys else "measure"
    return f"""(SELECT {by}, max(size) AS size, min(bucket) FILTER (upto * 4 >= size) AS q1,
  min(bucket) FILTER (upto * 4 >= size * 3) AS q3
 FROM (SELECT {by}, bucket, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS size
  FROM (SELECT {by}, bucket, count(*) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL)"""


def _chosen(column: str) -> str:
    return (f"CASE WHEN o.size >= {qr.MIN_GROUP} THEN o.{column} WHEN l.size >= {qr.MIN_GROUP} THEN l.{column} "
            f"ELSE a.{column} END")


_SPREAD = "CASE measure " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in qr.SPREADS.items()) + " END"
_BEYOND = " OR ".join([f"{_RATES[m]} > high_{m}" for m in qr.SPREADS] + [f"{_RATES[m]} < low_{m}" for m in qr.LOWER])

QUALITY_RULES = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT rid, i, list_slice(w, i, i + {qr.REPEAT_WINDOW - 1}) AS win
  FROM (SELECT rid, w, unnest(range(1, len(w) - {qr.REPEAT_WINDOW - 2})) AS i FROM split)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, range({qr.REPEAT_WINDOW}) AS o(k) GROUP BY rid),
measured AS (SELECT rid, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM split LEFT JOIN repeats USING (rid)),
rates AS ({_sketch()}),
sketch AS (SELECT lang, source, measure, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bucket FROM rates),
picked AS (SELECT o.lang, o.source, o.measure, {_chosen("q1")} AS q1, {_chosen("q3")} AS q3
  FROM {_quartiles("lang, source")} o JOIN {_quartiles("lang")} l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure
  JOIN {_quartiles("")} a ON o.measure = a.measure),
fences AS (SELECT lang, source, {", ".join(f"max(q3 + reach) FILTER (measure = '{m}') AS high_{m}" for m in qr.SPREADS)},
  {", ".join(f"max(q1 - reach) FILTER (measure = '{m}') AS low_{m}" for m in qr.LOWER)}
  FROM (SELECT *, greatest(q3 - q1, {_SPREAD}) * {qr.FENCE} AS reach FROM picked) GROUP BY ALL),
judged AS (SELECT m.*, n_words < {qr.MIN_WORDS} OR 100 * n_repeat_words > {qr.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  coalesce({_BEYOND}, false) AS beyond
  FROM measured m LEFT JOIN fences f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT beyond AS kept
FROM judged"""

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_LETTER_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_LETTER_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_LETTER_WORDS} AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, least(len(w), {cn.WINDOW}) AS n, list_slice(w, i, i + {cn.WINDOW - 1}) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {cn.WINDOW - 2}, 2))) AS i FROM b WHERE len(w) > 0)),
doc_windows AS (SELECT rid, i, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM item_windows))),
places AS (SELECT rid, i, n, item_id FROM doc_windows JOIN item_windows USING (n, win)),
hit AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM places) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM places) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)"""

_BLANK_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LAST = (1 << 63) - 1


def _digest(*parts: str) -> str:
    return "md5(concat_ws(':', '7', " + ", ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts) + "))"


def _modulo(digest: str, n: str) -> str:
    return f"CAST('0x' || substr({digest}, 1, 15) AS BIGINT) % {n}"


MIX = f"""WITH d AS (SELECT doc_id, source, CAST(len({_BLANK_WORDS}) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS source_rows FROM d GROUP BY source),
ranked AS (SELECT *, CAST([{", ".join(map(str, mx.WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mx.WEIGHTS)} + 1] AS DOUBLE) AS weight,
  CAST(source_size * {mx.MAX_REPEATS} AS DOUBLE) AS most FROM totals),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
targets AS (SELECT *, least(most, max(level) OVER () * weight) AS target FROM levels),
blocks AS (SELECT *, CAST(coalesce(least(greatest(floor((SELECT min(target) FROM targets WHERE target > 0) * {mx.PRECISION}), 1), {mx.MAX_BLOCK}), 1) AS BIGINT) AS block FROM targets),
source_seats AS (SELECT source, count(*) AS quota FROM (SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS r, seats
  FROM (SELECT *, unnest(range(0, source_size * {mx.MAX_REPEATS} // block)) AS k FROM
   (SELECT *, CAST((SELECT sum(source_size) FROM totals) // block AS BIGINT) AS seats FROM blocks)))
  WHERE r <= seats GROUP BY source),
sources AS (SELECT b.*, coalesce(quota, 0) AS source_quota, CAST(ceil(source_rows / {mx.SHARD_ROWS}) AS BIGINT) AS shards
  FROM blocks b LEFT JOIN source_seats q ON b.source IS NOT DISTINCT FROM q.source),
dealt AS (SELECT d.*, source_size, target, block, source_quota, {_digest("doc_id")} AS digest, {_modulo(_digest("doc_id"), "shards")} AS shard
  FROM d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
shards AS (SELECT source, shard, block, source_quota, CAST(sum(size) AS BIGINT) AS words, CAST(ceil(sum(size) / block) AS BIGINT) AS blocks FROM dealt GROUP BY source, shard, block, source_quota),
shard_seats AS (SELECT source, shard, count(*) AS quota FROM (SELECT source, shard, source_quota,
  row_number() OVER (PARTITION BY source ORDER BY words / (2 * k + 1) DESC, shard, k) AS r
  FROM (SELECT *, unnest(range(0, least(blocks * {mx.MAX_REPEATS}, source_quota))) AS k FROM shards)) WHERE r <= source_quota GROUP BY ALL),
placed AS (SELECT p.*, sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING) AS stop,
  s.words, s.blocks, coalesce(q.quota, 0) AS quota, {_modulo(_digest("p.source", "p.shard"), "s.blocks")} AS first
  FROM dealt p LEFT JOIN shards s ON p.source IS NOT DISTINCT FROM s.source AND p.shard = s.shard AND s.words > 0
  LEFT JOIN shard_seats q ON p.source IS NOT DISTINCT FROM q.source AND p.shard = q.shard)
SELECT doc_id, source, size, source_size, target, CAST(coalesce(quota // blocks * size
 + greatest(least(stop, (first + quota % blocks) * block, words) - greatest(stop - size, first * block), 0)
 + greatest(least(stop, greatest(first + quota % blocks - blocks, 0) * block) - (stop - size), 0), 0) AS BIGINT) AS taken FROM placed"""

SUBSTRING_DEDUP = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, {_LAST}) AS id, {_BLANK_WORDS} AS w FROM documents),
windows AS (SELECT rid, id, i, array_to_string(list_slice(w, i, i + {sd.WINDOW - 1}), ' ') AS win
  FROM (SELECT rid, id, w, unnest(range(1, len(w) - {sd.WINDOW - 2})) AS i FROM d)),
firsts AS (SELECT win, min(id) AS least FROM windows GROUP BY win HAVING min(id) < max(id)),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + {sd.WINDOW})) AS pos FROM windows JOIN firsts USING (win) WHERE least < id),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t
  FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d) ANTI JOIN gone USING (rid, pos) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)"""

NGRAM_JOIN = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT rid, list_slice(w, i, i + {ng.SHINGLE - 1}) AS s
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - {ng.SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
pairs AS (SELECT a.rid AS a, b.rid AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.rid <> b.rid GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE 100 * common >= {ng.PERCENT} * (x.n + y.n - common)),
reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN reach r ON r.a = d.rid JOIN d o ON o.rid = r.b LEFT JOIN sizes s ON s.rid = d.rid GROUP BY d.rid, d.doc_id, n"""

ORACLE = {"op1_mix_to_weights": MIX, "op2_decontaminate": DECONTAMINATE, "op3_quality_rules": QUALITY_RULES,
          "op6_substring_dedup": SUBSTRING_DEDUP, "op9_ngram_jaccard_join": NGRAM_JOIN}
