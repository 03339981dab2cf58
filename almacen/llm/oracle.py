"""DuckDB SQL of the operators that SQL can express over whole tables.

Sharding permutes by a seeded generator, packing, BPE, language scores, HTML
trees and decoded layers have no SQL form; tests hold those to brute force.
"""

from __future__ import annotations

from . import preference, quality, vector_codes
from .common import UPPER

_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
_WORD = r"[^\x20\x09-\x0D]+"

OP1 = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOW} AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""


def _op3() -> str:
    stats = {"symbols": "1000 * n_symbols // greatest(word_chars, 1)",
             "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)",
             "repeats": "1000 * n_repeat_words // greatest(n_words, 1)",
             "upper": "1000 * n_upper // greatest(word_chars, 1)"}
    p = quality.ALPHA / len(quality.RULES)
    level = quality.DELTA / len(quality.RULES)
    unpivot = " UNION ALL ".join(f"SELECT doc_id, lang, '{r}' AS rule, {s} AS stat FROM f WHERE NOT base_failed"
                                 for r, s in stats.items())
    over = " OR ".join(f"coalesce({s} > cut_{r}, false)" for r, s in stats.items())
    wide = ", ".join(f"max(cutoff) FILTER (rule = '{r}') AS cut_{r}" for r in stats)
    grid = ", ".join(f"({i}, {g})" for i, g in enumerate(quality.GRID))
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, lang, coalesce(text, '') AS t, row_number() OVER () AS rn FROM documents),
w AS MATERIALIZED (
  SELECT *, regexp_extract_all(t, '{_WORD}') AS ws,
         list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '{_WORD}')) AS ls FROM d),
g AS (SELECT rn, i, ws[i:i + 4] AS gram FROM (SELECT rn, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT rn, count(DISTINCT i + k) AS n
      FROM (SELECT rn, i FROM g QUALIFY count(*) OVER (PARTITION BY rn, gram) > 1), range(5) AS z(k) GROUP BY rn),
f AS MATERIALIZED (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM (
    SELECT doc_id, lang, len(ws) AS n_words,
           CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
           len(ls) AS n_lines, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_upper
    FROM w LEFT JOIN r USING (rn))),
u AS ({unpivot}),
known AS (SELECT u.lang, u.rule, u.stat, l.quality FROM u JOIN labels l ON u.doc_id = l.doc_id
          WHERE l.quality IN (0, 1)),
x AS (SELECT lang, rule, step, cut, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 0) AS bad,
             count(*) FILTER (quality = 1 AND stat > cut) AS x, count(*) FILTER (quality = 0 AND stat > cut) AS y
      FROM known, (VALUES {grid}) AS c(step, cut) GROUP BY ALL),
tail AS (SELECT x.*, y * n - x * bad AS gain,
                (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
                        + k * ln({p}) + (n - k) * ln(1 - {p}))) FROM range(x.x + 1) AS ks(k)) AS p,
                (SELECT count(DISTINCT coalesce(lang, '~none')) FROM known) AS m FROM x),
cuts AS (SELECT lang, rule, cut AS cutoff FROM (
  SELECT *, bool_and(n > 0 AND p <= {level} / m) OVER (PARTITION BY lang, rule ORDER BY step) AS ok FROM tail)
  WHERE ok AND gain > 0 QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, cut DESC) = 1),
wide AS (SELECT lang, {wide} FROM cuts GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({over}) AS kept
FROM f LEFT JOIN wide ON f.lang IS NOT DISTINCT FROM wide.lang
"""


def _op6() -> str:
    end = preference.END.replace("\n", "' || chr(10) || '")
    render = f"'<|' || t.role || '|>' || chr(10) || t.text || '{end}'"

    def text(ts: str) -> str:
        return f"coalesce(list_aggregate(list_transform({ts}, lambda t: {render}), 'string_agg', ''), '')"

    def spans(ts: str) -> str:
        size = f"length({render})"
        upto = f"coalesce(list_sum(list_transform({ts}[1:i - 1], lambda t: {size})), 0)"
        head = f"length('<|' || {ts}[i].role || '|>') + 1"
        whole = f"coalesce(list_sum(list_transform({ts}[1:i], lambda t: {size})), 0)"
        return (f"coalesce(list_aggregate(list_transform(list_filter(range(1, len({ts}) + 1), "
                f"lambda i: {ts}[i].role = 'assistant'), lambda i: CAST({upto} + {head} AS BIGINT) || ':' || "
                f"CAST({whole} AS BIGINT)), 'string_agg', ','), '')")
    return f"""
WITH t AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
  GROUP BY conv_id),
a AS (SELECT *, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS ans FROM t),
b AS (SELECT *, CASE WHEN len(ans) > 1 THEN turns[ans[1]].text
                     ELSE coalesce(turns[ans[-1] - 1].text, '') END AS stale FROM a),
p AS (SELECT conv_id, CASE WHEN len(ans) = 0 THEN turns ELSE turns[1:ans[-1]] END AS c,
             CASE WHEN len(ans) = 0 THEN turns
                  ELSE list_concat(turns[1:ans[-1] - 1], [{{'role': 'assistant', 'text': stale}}]) END AS r FROM b),
n AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(c), len(r)) + 1),
                  lambda i: c[i] IS NOT DISTINCT FROM r[i]), false) - 1, least(len(c), len(r))) AS k FROM p),
s AS (SELECT conv_id, k, c[1:k] AS q, c[k + 1:] AS cc, r[k + 1:] AS rr FROM n)
SELECT conv_id, CAST(k AS BIGINT) AS prompt_turns, {text('q')} AS prompt, {text('cc')} AS chosen,
       {spans('cc')} AS chosen_spans, {text('rr')} AS rejected, {spans('rr')} AS rejected_spans FROM s
"""


OP8 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))))
    END AS sh FROM w),
c AS MATERIALIZED (SELECT min(doc_id) AS rep, len(sh) AS n, sh FROM s WHERE len(sh) > 0 GROUP BY sh),
u AS MATERIALIZED (SELECT rep, n, unnest(sh) AS g FROM c),
e AS MATERIALIZED (
  SELECT a.rep AS x, b.rep AS y FROM u a JOIN u b ON a.g = b.g AND a.rep <> b.rep
    AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT rep, rep FROM c UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x)
SELECT s.doc_id, len(s.sh) AS n_shingles, coalesce(m.comp, s.doc_id) AS component_id
FROM s LEFT JOIN (SELECT c.sh, min(reach.y) AS comp FROM c JOIN reach ON c.rep = reach.x GROUP BY c.sh) m ON s.sh = m.sh
"""


def _op11() -> str:
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES

    def assigned(book: str) -> str:
        return f"""
  SELECT x.rn, x.part, x.v, min(x.d) AS apart, arg_min(x.entry, x.d * {entries} + x.entry) AS entry FROM (
    SELECT p.rn, p.part, p.v, b.entry,
           list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))::BIGINT AS d
    FROM p JOIN {book} b ON p.part = b.part) x GROUP BY x.rn, x.part, x.v"""

    def moved(book: str, near: str) -> str:
        return f"""
  SELECT b.part, b.entry, CASE WHEN m.v IS NULL THEN b.v ELSE m.v END AS v FROM {book} b LEFT JOIN (
    SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT part, entry, i, count(*) AS n, sum(x)::BIGINT AS s FROM (
        SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS i FROM {near})
      GROUP BY part, entry, i) GROUP BY part, entry) m ON b.part = m.part AND b.entry = m.entry"""
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rn, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (
  SELECT rn, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS v
  FROM k, range({parts}) AS r(part)),
b0 AS MATERIALIZED (SELECT part, rn - 1 AS entry, v FROM p WHERE rn <= {entries}),
a0 AS MATERIALIZED ({assigned("b0")}),
b1 AS MATERIALIZED ({moved("b0", "a0")}),
a1 AS MATERIALIZED ({assigned("b1")}),
b2 AS MATERIALIZED ({moved("b1", "a1")}),
a2 AS MATERIALIZED ({assigned("b2")}),
c AS (SELECT rn, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(apart)::BIGINT AS error
      FROM a2 GROUP BY rn),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, h.codebooks_sha256
FROM k JOIN c ON k.rn = c.rn, h
"""


OP12 = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL),
o AS MATERIALIZED (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, left(text, 64),
                       sha256(strlen(role) || ':' || role || ':' || text)) AS own FROM t GROUP BY conv_id),
crc AS (SELECT n, list_reduce(list_prepend(n::BIGINT, range(8)::BIGINT[]),
               lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) AS r(n)),
tab AS (SELECT list(c ORDER BY n) AS c FROM crc),
hs AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
                string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
              lambda a, x: xor(a >> 8, tab.c[(xor(a, x) & 255) + 1])), 4294967295) % 9 AS h FROM o, tab),
path AS MATERIALIZED (
  SELECT o.conv_id, list_concat(coalesce(b.own, [])[1:hs.h], o.own[hs.h + 1:]) AS p
  FROM o JOIN hs USING (conv_id) LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 5),
m AS MATERIALIZED (
  SELECT conv_id, len(p) AS size, d, sha256(array_to_string(list_transform(p[1:d],
           lambda x: sha256(strlen(x.role) || ':' || x.role || ':' || x.text)), ',')) AS node,
         sha256(array_to_string(list_transform(p[1:d - 1],
           lambda x: sha256(strlen(x.role) || ':' || x.role || ':' || x.text)), ',')) AS parent,
         CASE WHEN d > 0 THEN strlen(p[d].text) ELSE 0 END AS bytes
  FROM (SELECT conv_id, p, unnest(range(len(p) + 1)) AS d FROM path)),
g AS MATERIALIZED (
  SELECT d, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '') AS ends
  FROM m GROUP BY d, node),
kids AS (SELECT d - 1 AS d, parent AS node, count(*) AS k FROM g WHERE d > 0 GROUP BY ALL),
f AS MATERIALIZED (SELECT g.*, coalesce(kids.k, 0) AS k FROM g LEFT JOIN kids ON g.d = kids.d AND g.node = kids.node),
sub AS (
  SELECT top.d, top.node, count(*) FILTER (below.k = 0) AS leaves, sum((below.n - 1) * below.bytes) AS saved
  FROM f below JOIN m ON m.conv_id = below.conv_id AND m.d <= below.d JOIN f top ON top.d = m.d AND top.node = m.node
  WHERE m.size >= below.d GROUP BY top.d, top.node)
SELECT f.conv_id, f.d::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n::BIGINT AS n_convs, f.k::BIGINT AS n_children,
       sub.leaves::BIGINT AS n_leaves, sub.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN sub ON sub.d = f.d AND sub.node = f.node
LEFT JOIN f up ON f.d > 0 AND up.d = f.d - 1 AND up.node = f.parent
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op3_quality_rules": _op3(), "op6_preference_format": _op6(),
            "op8_jaccard_join": OP8, "op11_vector_codes": _op11(), "op12_prefix_trie": OP12}
