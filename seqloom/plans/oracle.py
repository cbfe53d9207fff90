"""The queries of this package as SQL, where SQL can say them."""

from __future__ import annotations

TOK = "tok AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents)"
CNT = "cnt AS (SELECT token, count(*) AS n, count(DISTINCT doc_id) AS df FROM tok GROUP BY token)"


def _vocab(where: str) -> str:
    return f"WITH {TOK}, {CNT}, vocab AS (SELECT token, n, df, row_number() OVER (ORDER BY token) - 1 AS idx FROM cnt WHERE {where})"


KNOWN = _vocab("df >= 20")
ENC = KNOWN + ", enc AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, idx, vocab.token FROM tok JOIN vocab USING (token))"
EV = "ev AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS token, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type IS NOT NULL), vocab AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM (SELECT DISTINCT token FROM ev)), enc AS (SELECT doc_id, pos, idx, t, ev.token FROM ev JOIN vocab USING (token))"
VAL = "val AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS x FROM events WHERE value IS NOT NULL)"
DAY = "day AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) - 1 AS pos, count(*) AS x FROM events GROUP BY user_id, CAST(ts AS DATE))"
MAT = ENC + ", m AS (SELECT doc_id AS row_id, idx AS col_id, CAST(count(*) AS DOUBLE) AS value FROM enc GROUP BY 1, 2)"
CONV = "nodes AS (SELECT DISTINCT conv_id AS tree_id, turn AS node_id, coalesce(role, '?') AS label FROM conversations WHERE turn IS NOT NULL), edges AS (SELECT DISTINCT a.tree_id, a.node_id AS src, b.node_id AS dst FROM nodes a JOIN nodes b ON a.tree_id = b.tree_id AND b.node_id = a.node_id + 1)"


def _cooc(radius: int, after: bool = True, k: str = "1.0", w: int = 0, extra: str = "") -> str:
    a, b = ("a", "b") if after else ("b", "a")
    return f"SELECT a.idx AS row_id, {w} AS w, b.idx AS col_id, sum({k}) AS value FROM enc a JOIN enc b ON a.doc_id = b.doc_id AND {b}.pos - {a}.pos BETWEEN 1 AND {radius} {extra} GROUP BY 1, 2, 3"


def _gram(subgrams: bool) -> str:
    one = "SELECT doc_id, token AS gram FROM enc UNION ALL " if subgrams else ""
    return ENC + f""", g AS ({one}SELECT doc_id, token || ' ' || nxt AS gram FROM (SELECT doc_id, token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM enc) WHERE nxt IS NOT NULL),
    ok AS (SELECT gram FROM g GROUP BY gram HAVING count(DISTINCT doc_id) >= 5)
    SELECT doc_id AS row_id, gram, CAST(count(*) AS DOUBLE) AS value FROM g JOIN ok USING (gram) GROUP BY 1, 2"""


def _hist(bins: str) -> str:
    """bins(bin, lo, hi) is a CTE over val."""
    return f"""WITH {VAL}, {bins},
    hit AS (SELECT series_id, bin, count(*) AS n FROM val JOIN bins ON lo < x AND x <= hi GROUP BY 1, 2)
    SELECT s.series_id, CAST(b.bin AS INTEGER) AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT series_id FROM val) s CROSS JOIN bins b LEFT JOIN hit ON hit.series_id = s.series_id AND hit.bin = b.bin"""


def _uniform(n: int, lo: str, hi: str) -> str:
    return f"""ends AS (SELECT min(x) AS a, max(x) AS b FROM val), raw AS (SELECT k AS bin, a + (b - a) * k / {n} AS lo, a + (b - a) * (k + 1) / {n} AS hi, a, b FROM ends, range({n}) t(k)),
    bins AS (SELECT bin, CASE WHEN bin = 0 THEN {lo} ELSE lo END AS lo, CASE WHEN bin = {n - 1} THEN {hi} ELSE hi END AS hi FROM raw)"""


_EPS = 1e-11
_PROFILE = """WITH per AS (SELECT user_id, event_type, CAST(count(*) AS DOUBLE) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2),
 al AS (SELECT event_type, sum(n) AS y FROM per GROUP BY 1),
 g AS (SELECT u.user_id, al.event_type, coalesce(per.n, 0) AS x, al.y FROM (SELECT DISTINCT user_id FROM per) u CROSS JOIN al LEFT JOIN per ON per.user_id = u.user_id AND per.event_type = al.event_type),
 s AS (SELECT *, sum(x) OVER w AS sx, sum(y) OVER w AS sy, count(*) OVER w AS c FROM g WINDOW w AS (PARTITION BY user_id)),
 p AS (SELECT *, (x + 1e-11) / (sx + 1e-11 * c) AS p, (y + 1e-11) / (sy + 1e-11 * c) AS q, sum(x / sx - y / sy) OVER (PARTITION BY user_id ORDER BY event_type) AS gap FROM s),
 md AS (SELECT user_id, median(gap) AS md FROM p GROUP BY 1)"""
_WEIGHT = """, r AS (SELECT row_id, sum(value) AS r FROM m GROUP BY 1), b AS (SELECT row_id, r / sum(r) OVER () AS p, count(*) OVER () AS nr FROM r),
 e AS (SELECT col_id, value, p, nr, sum(value) OVER (PARTITION BY col_id) + 0.1 AS big FROM m JOIN b USING (row_id)),
 wt AS (SELECT col_id, sum((value + 0.1 * p) / big * ln((value + 0.1 * p) / big / p)) AS seen, sum(p) AS p, count(*) AS k, first(big) AS big, first(nr) AS nr FROM e GROUP BY 1)"""

SQL: dict[str, str] = {
    "vocab_freq": f"WITH {TOK} SELECT token, count(*) AS n, round(count(*) / (SELECT count(*) FROM tok), 9) AS freq FROM tok GROUP BY token",
    "doc_freq": f"WITH {TOK} SELECT token, count(DISTINCT doc_id) AS df, round(count(DISTINCT doc_id) / (SELECT count(*) FROM documents), 9) AS share FROM tok GROUP BY token",
    "vocab_prune": _vocab("n >= 5 AND df / (SELECT count(*) FROM documents) <= 0.4 AND token NOT IN ('the', 'of')") + " SELECT token, n, df, idx FROM vocab",
    "vocab_topk_ties": _vocab("n > (SELECT min(n) FROM (SELECT n FROM cnt ORDER BY n DESC LIMIT 101))") + " SELECT token, n, idx FROM vocab",
    "vocab_regex_exclude": _vocab("df >= 5 AND NOT regexp_full_match(token, '[A-Z].*|.*[.,]')") + " SELECT token, n, idx FROM vocab",
    "mask_encode": KNOWN + " SELECT coalesce(idx, (SELECT count(*) FROM vocab)) AS idx, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM tok LEFT JOIN vocab USING (token) GROUP BY 1",
    "encode_closed": ENC + " SELECT idx, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM enc GROUP BY 1",
    "ngram1": MAT + " SELECT row_id, col_id, value FROM m",
    "ngram2_exact": _gram(False),
    "ngram_subgrams": _gram(True),
    "ngram_merge": f"""WITH {TOK}, part AS (SELECT tok.*, lang = 'en' AS en FROM tok JOIN documents USING (doc_id) WHERE lang IS NOT NULL),
      ok AS (SELECT en, token, count(*) AS n, count(DISTINCT doc_id) AS df FROM part GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 20),
      names AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS col_id FROM (SELECT DISTINCT token FROM ok))
      SELECT col_id, names.token AS label, CAST(sum(n) AS DOUBLE) AS value, CAST(sum(df) AS BIGINT) AS rows FROM ok JOIN names USING (token) GROUP BY 1, 2""",
    "skipgram_pairs": ENC + " SELECT a.doc_id, a.idx AS head, b.idx AS tail, round(sum(1.0::DOUBLE / (b.pos - a.pos)), 6) AS value FROM enc a JOIN enc b ON a.doc_id = b.doc_id AND b.pos - a.pos BETWEEN 1 AND 2 GROUP BY 1, 2, 3",
    "skipgram_corpus": ENC + " SELECT a.idx AS head, b.idx AS tail, CAST(count(*) AS DOUBLE) AS value FROM enc a JOIN enc b ON a.doc_id = b.doc_id AND a.pos - b.pos BETWEEN 1 AND 3 GROUP BY 1, 2",
    "cooc_after_flat": ENC + f" SELECT row_id, w, col_id, CAST(value AS DOUBLE) AS value FROM ({_cooc(5)})",
    "cooc_directional_harmonic": ENC + f" SELECT row_id, w, col_id, round(value, 6) AS value FROM ({_cooc(3, False, '1.0::DOUBLE / (a.pos - b.pos)', 0)} UNION ALL {_cooc(3, True, '1.0::DOUBLE / (b.pos - a.pos)', 1)})",
    "cooc_geometric_norm": ENC + """, c AS (SELECT a.doc_id, a.pos, a.idx AS row_id, b.idx AS col_id, pow(0.9::DOUBLE, a.pos - b.pos) AS k FROM enc a JOIN enc b ON a.doc_id = b.doc_id AND a.pos - b.pos BETWEEN 1 AND 4),
      s AS (SELECT row_id, col_id, k / sum(k) OVER (PARTITION BY doc_id, pos) AS k FROM c) SELECT row_id, 0 AS w, col_id, round(sum(k), 6) AS value FROM s GROUP BY 1, 3""",
    "cooc_offset": ENC + " SELECT a.idx AS row_id, 0 AS w, b.idx AS col_id, CAST(count(*) AS DOUBLE) AS value FROM enc a JOIN enc b ON a.doc_id = b.doc_id AND b.pos - a.pos BETWEEN 2 AND 3 GROUP BY 1, 3",
    "cooc_variable_radius": ENC + """, f AS (SELECT idx, n / sum(n) OVER () AS f FROM vocab), r AS (SELECT idx, pow(f, -0.25) / sum(pow(f, 0.75)) OVER () * 2 AS r FROM f),
      rr AS (SELECT idx, CASE WHEN r > 0 AND r < 1 THEN 1 ELSE round_even(r, 0) END AS radius FROM r)
      SELECT a.idx AS row_id, 0 AS w, b.idx AS col_id, CAST(count(*) AS DOUBLE) AS value FROM enc a JOIN rr ON rr.idx = a.idx JOIN enc b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.pos - a.pos <= radius GROUP BY 1, 3""",
    "cooc_mask": KNOWN + ", mk AS (SELECT doc_id, pos, idx FROM tok JOIN vocab USING (token)) SELECT a.idx AS row_id, b.idx AS col_id, CAST(count(*) AS DOUBLE) AS value FROM mk a JOIN mk b ON a.doc_id = b.doc_id AND b.pos - a.pos BETWEEN 1 AND 3 GROUP BY 1, 2",
    "cooc_colnorm_eps": ENC + f", c AS ({_cooc(2)}), s AS (SELECT row_id, w, col_id, value / sum(value) OVER (PARTITION BY col_id) AS value FROM c) SELECT row_id, w, col_id, round(value, 6) AS value FROM s WHERE value >= 0.05",
    "cooc_em1": f"""WITH {EV}, c AS (SELECT a.doc_id, a.pos, a.idx AS row_id, b.idx AS col_id, pow(0.8::DOUBLE, b.pos - a.pos) AS k FROM enc a JOIN enc b ON a.doc_id = b.doc_id AND b.pos - a.pos BETWEEN 1 AND 3),
      n AS (SELECT row_id, col_id, k / sum(k) OVER (PARTITION BY doc_id, pos) AS k FROM c), p0 AS (SELECT row_id, col_id, sum(k) AS v FROM n GROUP BY 1, 2),
      p AS (SELECT row_id, col_id, v / sum(v) OVER (PARTITION BY col_id) AS v FROM p0), q AS (SELECT doc_id, pos, row_id, col_id, k * v AS q FROM c JOIN p USING (row_id, col_id)),
      s AS (SELECT row_id, col_id, q / sum(q) OVER (PARTITION BY doc_id, pos) AS s FROM q), p1 AS (SELECT row_id, col_id, sum(s) AS v FROM s GROUP BY 1, 2)
      SELECT row_id, col_id, round(v / sum(v) OVER (PARTITION BY col_id), 6) AS value FROM p1""",
    "cooc_timed": f"""WITH {EV}, g AS (SELECT avg(t - pt) AS delta FROM (SELECT t, lag(t) OVER (PARTITION BY doc_id ORDER BY pos) AS pt FROM enc))
      SELECT a.idx AS row_id, b.idx AS col_id, round(sum(pow(0.9::DOUBLE, abs(b.t - a.t) / delta)), 4) AS value FROM enc a JOIN enc b ON a.doc_id = b.doc_id AND b.pos - a.pos BETWEEN 1 AND 4, g GROUP BY 1, 2""",
    "cooc_ngram_rows": f"""WITH {EV}, n2 AS (SELECT doc_id, pos, token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM enc), gv AS (SELECT token, nxt, row_number() OVER (ORDER BY token, nxt) - 1 AS row_id FROM (SELECT DISTINCT token, nxt FROM n2 WHERE nxt IS NOT NULL)),
      o AS (SELECT doc_id, pos, row_id FROM n2 JOIN gv USING (token, nxt))
      SELECT row_id, 0 AS w, b.idx AS col_id, CAST(count(*) AS DOUBLE) AS value FROM o JOIN enc b ON o.doc_id = b.doc_id AND o.pos - b.pos BETWEEN 1 AND 3 GROUP BY 1, 3
      UNION ALL SELECT row_id, 1 AS w, b.idx AS col_id, CAST(count(*) AS DOUBLE) AS value FROM o JOIN enc b ON o.doc_id = b.doc_id AND b.pos - o.pos BETWEEN 2 AND 4 GROUP BY 1, 3""",
    "cooc_ngram_mask": f"""WITH {EV}, v2 AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM vocab WHERE token <> 'click'), m2 AS (SELECT doc_id, pos, coalesce(v2.token, '<mask>') AS token, v2.idx FROM ev LEFT JOIN v2 ON v2.token = ev.token),
      o AS (SELECT doc_id, pos, token || ' ' || nxt AS gram FROM (SELECT doc_id, pos, token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM m2) WHERE nxt IS NOT NULL AND NOT (token = '<mask>' AND nxt = '<mask>'))
      SELECT gram, 0 AS w, b.idx AS col_id, CAST(count(*) AS DOUBLE) AS value FROM o JOIN m2 b ON o.doc_id = b.doc_id AND o.pos - b.pos BETWEEN 1 AND 3 WHERE b.idx IS NOT NULL GROUP BY 1, 3
      UNION ALL SELECT gram, 1 AS w, b.idx AS col_id, CAST(count(*) AS DOUBLE) AS value FROM o JOIN m2 b ON o.doc_id = b.doc_id AND b.pos - o.pos BETWEEN 2 AND 4 WHERE b.idx IS NOT NULL GROUP BY 1, 3""",
    "cooc_multiset": """WITH it AS (SELECT o_custkey AS doc_id, dense_rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)) AS sp, row_number() OVER () AS rid, l_returnflag || l_linestatus AS token FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
      v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM (SELECT DISTINCT token FROM it)), e AS (SELECT it.*, idx FROM it JOIN v USING (token)),
      p AS (SELECT a.idx AS row_id, b.idx AS col_id, b.sp - a.sp AS gap FROM e a JOIN e b ON a.doc_id = b.doc_id AND abs(b.sp - a.sp) <= 1 AND a.rid <> b.rid)
      SELECT row_id, w, col_id, round(sum(pow(0.5::DOUBLE, abs(gap))), 6) AS value FROM (SELECT *, 0 AS w FROM p WHERE gap <= 0 UNION ALL SELECT *, 1 AS w FROM p WHERE gap >= 0) GROUP BY 1, 2, 3""",
    "tree_walks": f"""WITH {CONV}, w1 AS (SELECT tree_id, src, dst, 1.0::DOUBLE AS n FROM edges), w2 AS (SELECT a.tree_id, a.src, b.dst, a.n FROM w1 a JOIN edges b ON a.tree_id = b.tree_id AND a.dst = b.src), w3 AS (SELECT a.tree_id, a.src, b.dst, a.n FROM w2 a JOIN edges b ON a.tree_id = b.tree_id AND a.dst = b.src),
      w AS (SELECT *, 0.5::DOUBLE AS k FROM w1 UNION ALL SELECT *, 0.25 FROM w2 UNION ALL SELECT *, 0.125 FROM w3),
      c AS (SELECT x.label AS a, y.label AS b, sum(n * k) AS v FROM w JOIN nodes x ON x.tree_id = w.tree_id AND x.node_id = w.src JOIN nodes y ON y.tree_id = w.tree_id AND y.node_id = w.dst GROUP BY 1, 2)
      SELECT a AS row_label, 'post_' || b AS col_label, round(v, 6) AS value FROM c UNION ALL SELECT b AS row_label, 'pre_' || a AS col_label, round(v, 6) AS value FROM c""",
    "node_splice": f"""WITH RECURSIVE {CONV}, ok AS (SELECT DISTINCT tree_id, node_id FROM nodes WHERE label <> 'assistant'),
      walk AS (SELECT e.tree_id, e.src, e.dst FROM edges e JOIN ok ON ok.tree_id = e.tree_id AND ok.node_id = e.src
               UNION ALL SELECT w.tree_id, w.src, e.dst FROM walk w JOIN edges e ON e.tree_id = w.tree_id AND e.src = w.dst WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.tree_id = w.tree_id AND ok.node_id = w.dst))
      SELECT w.tree_id, src, dst, CAST(count(*) AS DOUBLE) AS weight FROM walk w JOIN ok ON ok.tree_id = w.tree_id AND ok.node_id = w.dst GROUP BY 1, 2, 3""",
    "edge_pivot": """WITH e AS (SELECT CAST(l_suppkey AS VARCHAR) AS r, strftime(l_shipdate, '%Y-%m') AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
      rr AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS i FROM (SELECT DISTINCT r FROM e)), cc AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS j FROM (SELECT DISTINCT c FROM e))
      SELECT r AS row_label, c AS col_label, i AS row_id, j AS col_id, round(v, 2) AS value FROM e JOIN rr USING (r) JOIN cc USING (c)""",
    "edge_pivot_joint": """WITH e AS (SELECT n_name AS r, r_name AS c, sum(s_acctbal) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
      x AS (SELECT l, row_number() OVER (ORDER BY l) - 1 AS i FROM (SELECT r AS l FROM e UNION SELECT c FROM e))
      SELECT r AS row_label, c AS col_label, a.i AS row_id, b.i AS col_id, round(v, 2) AS value FROM e JOIN x a ON a.l = r JOIN x b ON b.l = c""",
    "categorical_lists": """WITH p AS (SELECT o_custkey, 0 AS c, 'o_orderstatus:' || o_orderstatus AS v, min(o_orderkey) AS k FROM orders WHERE o_orderstatus IS NOT NULL AND o_custkey IS NOT NULL GROUP BY 1, 3
      UNION ALL SELECT o_custkey, 1, 'o_orderpriority:' || o_orderpriority, min(o_orderkey) FROM orders WHERE o_orderpriority IS NOT NULL AND o_custkey IS NOT NULL GROUP BY 1, 3)
      SELECT o_custkey, string_agg(v, '|' ORDER BY c, k) AS tokens FROM p GROUP BY 1""",
    "row_token_lists": "SELECT o_orderkey, concat_ws('|', 'o_orderstatus:' || o_orderstatus, 'o_orderpriority:' || o_orderpriority, 'o_custkey:' || o_custkey) AS tokens FROM orders",
    "hist_uniform": _hist(_uniform(10, "'-infinity'::DOUBLE", "'infinity'::DOUBLE")),
    "hist_outlier": _hist("ends AS (SELECT min(x) AS a, max(x) AS b FROM val), bins AS (SELECT k + 1 AS bin, a + (b - a) * k / 8 AS lo, CASE WHEN k = 7 THEN b ELSE a + (b - a) * (k + 1) / 8 END AS hi FROM ends, range(8) t(k) UNION ALL SELECT 0, '-infinity'::DOUBLE, a FROM ends UNION ALL SELECT 9, b, 'infinity'::DOUBLE FROM ends)"),
    "hist_mass": _hist("""bv AS (SELECT x, sum(x) AS m FROM val GROUP BY 1), run AS (SELECT x, sum(m) OVER (ORDER BY x) AS cum, sum(m) OVER () AS tot FROM bv),
      st AS (SELECT x, least(4, floor(cum * 5 / tot)) AS k FROM run), ed AS (SELECT min(x) AS hi FROM st WHERE k >= 1 GROUP BY k UNION SELECT max(x) FROM bv),
      bins AS (SELECT row_number() OVER (ORDER BY hi) - 1 AS bin, coalesce(lag(hi) OVER (ORDER BY hi), '-infinity'::DOUBLE) AS lo, hi FROM ed)"""),
    "kde_grid": f"WITH {VAL}, e AS (SELECT min(x) AS a, max(x) AS b FROM val), g AS (SELECT k AS g, a + (b - a) * k / 9 AS gp FROM e, range(10) t(k)) SELECT series_id, CAST(g AS INTEGER) AS g, round(avg(exp(-0.5 * pow((gp - x) / 5.0, 2))) / (5.0 * sqrt(2 * pi())), 6) AS density FROM val, g GROUP BY 1, 2",
    "cyclic_month": "SELECT CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "sliding_avg": f"WITH {VAL}, w AS (SELECT series_id, pos, avg(x) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS v, count(*) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS c FROM val) SELECT series_id, CAST(pos AS INTEGER) AS start, round(v, 6) AS value FROM w WHERE c = 5",
    "sliding_diff": f"WITH {VAL} SELECT a.series_id, CAST(a.pos AS INTEGER) AS start, CAST(k AS INTEGER) AS k, round(c.x - b.x, 6) AS value FROM val a, range(3) t(k), val b, val c, val z WHERE a.pos % 2 = 0 AND b.series_id = a.series_id AND c.series_id = a.series_id AND z.series_id = a.series_id AND z.pos = a.pos + 5 AND b.pos = a.pos + 1 + k AND c.pos = a.pos + 3 + k",
    "sliding_pad": f"""WITH {DAY}, e AS (SELECT series_id, max(pos) AS hi FROM day GROUP BY 1), p AS (SELECT series_id, pos, x FROM day UNION ALL SELECT series_id, -k, 0 FROM e, range(1, 3) t(k) UNION ALL SELECT series_id, hi + k, 0 FROM e, range(1, 3) t(k)),
      w AS (SELECT series_id, pos + 2 AS start, x::VARCHAR || ',' || (lead(x, 1) OVER w)::VARCHAR || ',' || (lead(x, 2) OVER w)::VARCHAR || ',' || (lead(x, 3) OVER w)::VARCHAR AS points FROM p WINDOW w AS (PARTITION BY series_id ORDER BY pos)) SELECT series_id, CAST(start AS INTEGER) AS start, points FROM w WHERE points IS NOT NULL""",
    "seq_difference": f"WITH {VAL} SELECT a.series_id, CAST(a.pos AS INTEGER) AS pos, round(b.x - a.x, 6) AS x FROM val a JOIN val b ON a.series_id = b.series_id AND b.pos = a.pos + 2",
    "changepoint_counts": f"""WITH {DAY}, w AS (SELECT series_id, pos - 4 AS start, x, sum(x) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS s FROM day)
      SELECT series_id, CAST(start AS INTEGER) AS start, round(-(lgamma(x + s + 1.0) - lgamma(x + 1.0) - lgamma(s + 1.0) + (1 + s) * ln(1 - 1 / 6.0) + x * ln(1 / 6.0)), 6) AS score FROM w WHERE start >= 0""",
    "topk_summary": MAT + " SELECT row_id, CAST(k AS INTEGER) AS rank, token AS label, value FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY value DESC, col_id DESC) AS k FROM m) x JOIN vocab ON vocab.idx = x.col_id WHERE k <= 3",
    "dist_profiles": _PROFILE + """ SELECT p.user_id,
      round(sqrt(greatest(0, 1 - sum(sqrt(x * y)) / sqrt(first(sx) * first(sy)))), 6) AS hellinger, round(0.5 * sum(abs(x / sx - y / sy)), 6) AS total_variation,
      round(0.5 * sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))), 6) AS jensen_shannon, round(sum(p * ln(p / q) + q * ln(q / p)), 6) AS symmetric_kl,
      round(sum(abs(gap)), 6) AS kantorovich, round(sqrt(sum(gap * gap)), 6) AS kantorovich2, round(sum(abs(gap - md)), 6) AS circular
      FROM p JOIN md USING (user_id) GROUP BY 1""",
    "dist_sparse": """WITH h AS (SELECT user_id, event_type, CAST(count(*) FILTER (hour(ts) < 12) AS DOUBLE) AS x, CAST(count(*) FILTER (hour(ts) >= 12) AS DOUBLE) AS y FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2),
      s AS (SELECT *, sum(x) OVER w AS sx, sum(y) OVER w AS sy, count(*) OVER w AS c FROM h WINDOW w AS (PARTITION BY user_id)),
      p AS (SELECT *, (x + 1e-11) / (sx + 1e-11 * c) AS p, (y + 1e-11) / (sy + 1e-11 * c) AS q FROM s)
      SELECT user_id, round(CASE WHEN first(sx) = 0 AND first(sy) = 0 THEN 0 WHEN first(sx) * first(sy) = 0 THEN 1 ELSE sqrt(greatest(0, 1 - sum(sqrt(x * y)) / sqrt(first(sx) * first(sy)))) END, 6) AS hellinger,
      round(coalesce(0.5 * sum(abs(CASE WHEN sx > 0 THEN x / sx END - CASE WHEN sy > 0 THEN y / sy END)), -1), 6) AS total_variation,
      round(0.5 * sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))), 6) AS jensen_shannon, round(sum(p * ln(p / q) + q * ln(q / p)), 6) AS symmetric_kl FROM p GROUP BY 1""",
    "info_weight_exact": MAT + _WEIGHT + " SELECT col_id, round(seen + (1 - p) * (0.1 / big) * ln(0.1 / big), 6) AS weight FROM wt",
    "info_weight_approx": MAT + _WEIGHT + " SELECT col_id, round(seen + (nr - k) / nr * (0.1 / big) * ln(0.1 / big), 6) AS weight FROM wt",
    "info_weight_supervised": MAT + """, lb AS (SELECT doc_id AS row_id, max(quality) AS label FROM labels WHERE quality IS NOT NULL GROUP BY 1), bx AS (SELECT label, col_id, sum(value) AS x FROM m JOIN lb USING (row_id) GROUP BY 1, 2),
      bs AS (SELECT label, sum(x) / (SELECT sum(x) FROM bx) AS b FROM bx GROUP BY 1), gr AS (SELECT c.col_id, bs.label, bs.b, coalesce(x, 0) + 0.1 * b AS raw FROM (SELECT DISTINCT col_id FROM bx) c CROSS JOIN bs LEFT JOIN bx ON bx.col_id = c.col_id AND bx.label = bs.label),
      o AS (SELECT col_id, b, raw / sum(raw) OVER (PARTITION BY col_id) AS o FROM gr) SELECT col_id, round(sum(o * ln(o / b)), 6) AS weight FROM o GROUP BY 1""",
    "info_weighted": MAT + _WEIGHT + """, ww AS (SELECT col_id, seen + (nr - k) / nr * (0.1 / big) * ln(0.1 / big) AS weight FROM wt), nw AS (SELECT col_id, pow(greatest(weight / avg(weight) OVER (), 0), 2) AS weight FROM ww)
      SELECT row_id, round(sum(value * weight), 4) AS mass FROM m JOIN nw USING (col_id) GROUP BY 1""",
    "bag_mean_vector": "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL) SELECT label AS row_id, CAST(k AS INTEGER) AS k, round(avg(x), 6) AS x FROM e GROUP BY 1, 2",
    "signature_level2": """WITH p AS (SELECT user_id AS path_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, epoch_us(ts) / 8.64e10 AS t, value AS v FROM events WHERE value IS NOT NULL),
      d AS (SELECT path_id, t - lag(t) OVER w AS dt, v - lag(v) OVER w AS dv, lag(t) OVER w - first(t) OVER w AS mt, lag(v) OVER w - first(v) OVER w AS mv FROM p WINDOW w AS (PARTITION BY path_id ORDER BY pos))
      SELECT path_id, round(sum(dt), 3) AS s_0, round(sum(dv), 3) AS s_1, round(sum((mt + 0.5 * dt) * dt), 3) AS s_0_0, round(sum((mt + 0.5 * dt) * dv), 3) AS s_0_1, round(sum((mv + 0.5 * dv) * dt), 3) AS s_1_0, round(sum((mv + 0.5 * dv) * dv), 3) AS s_1_1
      FROM d WHERE dt IS NOT NULL GROUP BY 1""",
    "svd_spectrum": """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings WHERE embedding IS NOT NULL), c AS (SELECT count(DISTINCT vec_id) AS c FROM e),
      g AS (SELECT a.k AS i, b.k AS j, sum(a.x * b.x) / first(c) AS g FROM e a JOIN e b USING (vec_id), c GROUP BY 1, 2)
      SELECT 1 AS power, round(sum(g), 6) AS value FROM g WHERE i = j UNION ALL SELECT 2, round(sum(g * g), 6) FROM g
      UNION ALL SELECT 3, round(sum(a.g * b.g * c.g), 6) FROM g a JOIN g b ON a.j = b.i JOIN g c ON b.j = c.i AND c.j = a.i""",
    "generated_windows": """WITH e AS (SELECT CAST(ts AS DATE) - DATE '1970-01-01' AS day FROM events WHERE ts IS NOT NULL), m AS (SELECT min(day) AS a, max(day) AS b FROM e),
      w AS (SELECT k AS "window", a + k AS first_day FROM m, range(100000) t(k) WHERE a + k <= b - 6)
      SELECT "window", first_day, count(day) AS n FROM w LEFT JOIN e ON day BETWEEN first_day AND first_day + 6 GROUP BY 1, 2""",
    "procrustes": """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings WHERE embedding IS NOT NULL)
      SELECT vec_id, CAST(k AS INTEGER) AS k, round(x - avg(x) OVER (PARTITION BY k), 6) + 0.0 AS x FROM e""",
    "signatures_log3": """WITH p AS (SELECT user_id AS path_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, epoch_us(ts) / 8.64e10 - 19000 AS t, value AS v FROM events WHERE value IS NOT NULL),
      d AS (SELECT path_id, pos, t - lag(t) OVER w AS a, v - lag(v) OVER w AS b, lag(t) OVER w - first(t) OVER w AS s0, lag(v) OVER w - first(v) OVER w AS s1 FROM p WINDOW w AS (PARTITION BY path_id ORDER BY pos)),
      e AS (SELECT *, coalesce(sum(s0 * a + a * a / 2) OVER w, 0) AS s00, coalesce(sum(s0 * b + a * b / 2) OVER w, 0) AS s01, coalesce(sum(s1 * b + b * b / 2) OVER w, 0) AS s11 FROM d WHERE a IS NOT NULL WINDOW w AS (PARTITION BY path_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      f AS (SELECT path_id, sum(a) AS x, sum(b) AS y, sum(s0 * a + a * a / 2) AS xx, sum(s0 * b + a * b / 2) AS xy, sum(s1 * b + b * b / 2) AS yy,
            sum(s00 * b + s0 * a * b / 2 + a * a * b / 6) AS xxy, sum(s01 * b + s0 * b * b / 2 + a * b * b / 6) AS xyy FROM e GROUP BY 1)
      SELECT path_id, round(x, 3) AS l_0, round(y, 3) AS l_1, round(xy - x * y / 2, 3) AS l_01, round(xxy - (x * xy + xx * y) / 2 + x * x * y / 3, 3) AS l_001, round(xyy - (x * yy + xy * y) / 2 + x * y * y / 3, 3) AS l_011 FROM f""",
    "row_denoise_mass": MAT.replace("WITH tok", "WITH RECURSIVE tok", 1) + """, bg AS (SELECT col_id, sum(value) AS mass FROM m GROUP BY 1),
      e0 AS (SELECT row_id, col_id, value / sum(value) OVER r AS x, mass / sum(mass) OVER r AS b FROM m JOIN bg USING (col_id) WINDOW r AS (PARTITION BY row_id)),
      it AS (SELECT row_id, x, b, (x + b) / 2 AS own, 0.5::DOUBLE AS mix, -1.0::DOUBLE AS was, 0 AS k FROM e0
        UNION ALL SELECT row_id, x, b, got / part, (part + 0.5) / 2, mix, k + 1 FROM (SELECT *, sum(got) OVER (PARTITION BY row_id) AS part FROM (SELECT *, x * (own * mix) / (own * mix + b * (1 - mix)) AS got FROM it WHERE abs(mix - was) > 1e-7 AND mix > 1e-7 AND mix < 1 - 1e-7)))
      SELECT row_id, round(t * mix, 4) AS mass FROM (SELECT row_id, arg_max(mix, k) AS mix FROM it GROUP BY 1) JOIN (SELECT row_id, sum(value) AS t FROM m GROUP BY 1) USING (row_id)""",
    "lz_events": """WITH RECURSIVE s AS (SELECT user_id AS id, string_agg(event_type[1], '' ORDER BY ts, event_id) AS s FROM events WHERE event_type IS NOT NULL GROUP BY 1),
      p AS (SELECT id, s, 0 AS e, 0 AS start, CAST([] AS VARCHAR[]) AS seen FROM s
        UNION ALL SELECT id, s, e + 1, CASE WHEN list_contains(seen, substr(s, start + 1, e - start)) THEN start ELSE e END,
          CASE WHEN list_contains(seen, substr(s, start + 1, e - start)) THEN seen ELSE list_append(seen, substr(s, start + 1, e - start)) END FROM p WHERE e < length(s))
      SELECT id, CAST(len(seen) AS BIGINT) AS phrases, CAST(e AS BIGINT) AS n, CAST(list_max(list_transform(seen, lambda x: length(x))) AS INTEGER) AS longest FROM p WHERE e = length(s)""",
}
