"""The oracle side: named SQL fragments and the WITH clause that a query needs of them."""

from __future__ import annotations

import re


def _pad(letter: str, column: str) -> str:
    return f"'{letter}' || lpad(CAST({column} AS VARCHAR), 9, '0')"


def _log1p(x: str) -> str:
    """ln(1 + x) loses small x; a series keeps them."""
    return f"CASE WHEN {x} < 1e-5 THEN {x} - {x} * {x} / 2 + {x} * {x} * {x} / 3 ELSE ln(1 + {x}) END"


def _cells(source: str, positive: bool = False, halflife: float = 30.0) -> str:
    where = "WHERE event_type IN ('add_to_cart', 'purchase', 'wishlist')" if positive else ""
    return f"""
  SELECT user_id, product_id, {_log1p('v')} AS value FROM (
    SELECT user_id, product_id, sum(w * power(0.5, greatest((r - us) / 86400e6, 0) / {halflife})) AS v
    FROM (SELECT *, CASE event_type WHEN 'view' THEN 1.0 WHEN 'wishlist' THEN 2.0 WHEN 'add_to_cart' THEN 3.0
                    WHEN 'rating' THEN 4.0 WHEN 'purchase' THEN 5.0 ELSE 1.0 END::DOUBLE AS w,
                 max(us) OVER () AS r FROM {source} {where})
    GROUP BY user_id, product_id) x
  WHERE v > 0 AND product_id IN (SELECT product_id FROM prod)"""


def _split(source: str, holdout: int, val: int, name: str) -> dict[str, str]:
    s = name
    return {
        f"{s}_held0": f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS nth_last FROM {source} WHERE event_type IN ('add_to_cart', 'purchase', 'wishlist') QUALIFY nth_last <= {holdout}",
        f"{s}_cut": f"SELECT user_id, min(us) AS cutoff FROM {s}_held0 GROUP BY user_id",
        f"{s}_train0": f"SELECT e.* FROM {source} e LEFT JOIN {s}_cut c USING (user_id) WHERE c.cutoff IS NULL OR e.us < c.cutoff",
        f"{s}_counts": f"SELECT user_id, count(*) AS n_train FROM {s}_train0 GROUP BY user_id HAVING count(*) >= 5",
        f"{s}_train": f"SELECT * FROM {s}_train0 WHERE user_id IN (SELECT user_id FROM {s}_counts)",
        f"{s}_held": f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS nth FROM {s}_held0 WHERE user_id IN (SELECT user_id FROM {s}_counts)",
        f"{s}_fresh": f"SELECT * FROM {s}_held h WHERE NOT EXISTS (SELECT 1 FROM {s}_train t WHERE t.user_id = h.user_id AND t.product_id = h.product_id)",
        f"{s}_val": f"SELECT * FROM {s}_fresh WHERE nth <= {val}",
        f"{s}_test": f"SELECT * FROM {s}_fresh WHERE nth > {val}",
        f"{s}_cells": _cells(f"{s}_train"),
        f"{s}_seg": f"SELECT 'all' AS segment, user_id FROM {s}_counts UNION ALL SELECT 'cold_start', user_id FROM {s}_counts WHERE n_train <= 25 UNION ALL SELECT 'warm', user_id FROM {s}_counts WHERE n_train >= 60",
    }


def _models(cells: str, p: str) -> dict[str, str]:
    """Popularity, neighbours and content over a table of cells; names begin with p."""
    return {
        f"{p}_pop": f"SELECT product_id, sum(value) AS total FROM {cells} GROUP BY product_id",
        f"{p}_popscore": f"SELECT product_id, {_log1p('coalesce(total, 0)')} AS score FROM prod LEFT JOIN {p}_pop USING (product_id)",
        f"{p}_users": f"SELECT DISTINCT user_id FROM {cells}",
        f"{p}_grid": f"SELECT user_id, product_id, c.user_id IS NOT NULL AND c.product_id IS NOT NULL AND c.value IS NOT NULL AS seen FROM (SELECT user_id, product_id FROM {p}_users, prod) g LEFT JOIN {cells} c USING (user_id, product_id)",
        f"{p}_poprecs": f"SELECT user_id, product_id, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, product_id) AS rank FROM {p}_grid JOIN {p}_popscore USING (product_id) WHERE NOT seen",
        f"{p}_unit": f"SELECT user_id, product_id, value / sqrt(sum(value * value) OVER (PARTITION BY user_id)) AS r FROM {cells}",
        f"{p}_co": f"SELECT a.product_id AS i, b.product_id AS j, sum(a.r * b.r) AS dot FROM {p}_unit a JOIN {p}_unit b USING (user_id) GROUP BY ALL",
        f"{p}_sim": f"SELECT i, j, dot / (1 + (a.total + b.total) / 10.0) AS sim FROM {p}_co JOIN {p}_pop a ON a.product_id = i JOIN {p}_pop b ON b.product_id = j WHERE i <> j AND dot > 0",
        f"{p}_near": f"SELECT i, j, sim, row_number() OVER (PARTITION BY i ORDER BY round(sim, 9) DESC, j) AS rank FROM {p}_sim QUALIFY rank <= 50",
        f"{p}_kraw": f"SELECT user_id, j AS product_id, sum(value * sim) AS score FROM {cells} c JOIN {p}_near n ON c.product_id = n.i GROUP BY ALL",
        f"{p}_kdense": f"SELECT user_id, product_id, seen, coalesce(score, 0) AS raw FROM {p}_grid LEFT JOIN {p}_kraw USING (user_id, product_id)",
        f"{p}_kscore": f"SELECT user_id, product_id, seen, CASE WHEN max(raw) OVER w - min(raw) OVER w > 1e-12 THEN (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) ELSE 0 END AS score FROM {p}_kdense WINDOW w AS (PARTITION BY user_id)",
        f"{p}_krecs": f"SELECT user_id, product_id, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, product_id) AS rank FROM {p}_kscore WHERE NOT seen",
        f"{p}_window": f"SELECT user_id, product_id, value, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 9) DESC, product_id) AS nth FROM {cells} QUALIFY nth <= 10",
        f"{p}_prof0": f"SELECT user_id, feature, sum(w.value * f.value) AS v FROM {p}_window w JOIN feat f USING (product_id) GROUP BY ALL",
        f"{p}_prof": f"SELECT user_id, feature, v / sqrt(sum(v * v) OVER (PARTITION BY user_id)) AS value FROM {p}_prof0",
        f"{p}_cmean": f"SELECT user_id, product_id, sum(p.value * f.value) AS score FROM {p}_prof p JOIN feat f USING (feature) GROUP BY ALL",
        f"{p}_cos": f"SELECT a.product_id AS i, b.product_id AS j, sum(a.value * b.value) AS cos FROM feat a JOIN (SELECT * FROM feat WHERE product_id IN (SELECT product_id FROM {cells})) b USING (feature) GROUP BY ALL",
        f"{p}_cmax": f"SELECT user_id, i AS product_id, max(cos) AS score FROM {cells} c JOIN {p}_cos s ON c.product_id = s.j GROUP BY ALL",
        f"{p}_cscore": f"SELECT user_id, product_id, seen, 0.5 * coalesce(m.score, 0) + 0.5 * coalesce(x.score, 0) + 0.05 * quality AS score FROM {p}_grid JOIN quality USING (product_id) LEFT JOIN {p}_cmean m USING (user_id, product_id) LEFT JOIN {p}_cmax x USING (user_id, product_id)",
        f"{p}_crecs": f"SELECT user_id, product_id, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, product_id) AS rank FROM {p}_cscore WHERE NOT seen",
    }


SQUARINGS = 20


def _latent(cells: str, p: str) -> dict[str, str]:
    """The two largest singular vectors, from high powers of X'X by repeated squaring, and the blends of their scores with the neighbours'."""
    out = {f"{p}_g0": f"SELECT a.product_id AS i, b.product_id AS j, sum(a.value * b.value) AS v FROM {cells} a JOIN {cells} b USING (user_id) GROUP BY ALL"}
    for g in ("g", "h"):
        for n in range(SQUARINGS):
            out[f"{p}_{g}{n + 1}"] = f"SELECT a.i, b.j, sum(a.v * b.v) / (SELECT sum(v * v) FROM {p}_{g}{n}) AS v FROM {p}_{g}{n} a JOIN {p}_{g}{n} b ON a.j = b.i GROUP BY a.i, b.j"
        top = f"{p}_{g}{SQUARINGS}"
        out[f"{p}_v{g}"] = f"SELECT i, v / sqrt(sum(v * v) OVER ()) AS x FROM {top} WHERE j = (SELECT i FROM {top} WHERE i = j ORDER BY v DESC, i LIMIT 1)"
        if g == "g":
            out[f"{p}_first"] = f"SELECT sum(a.x * g.v * b.x) AS size FROM {p}_g0 g JOIN {p}_vg a ON a.i = g.i JOIN {p}_vg b ON b.i = g.j"
            out[f"{p}_h0"] = f"SELECT a.i, b.i AS j, coalesce(g.v, 0) - size * a.x * b.x AS v FROM {p}_first, {p}_vg a CROSS JOIN {p}_vg b LEFT JOIN {p}_g0 g ON g.i = a.i AND g.j = b.i"
    out[f"{p}_coef"] = f"SELECT user_id, sum(value * a.x) AS c1, sum(value * b.x) AS c2 FROM {cells} JOIN {p}_vg a ON a.i = product_id JOIN {p}_vh b ON b.i = product_id GROUP BY user_id"
    out[f"{p}_lraw"] = f"SELECT user_id, a.i AS product_id, c1 * a.x + c2 * b.x AS score FROM {p}_coef, {p}_vg a JOIN {p}_vh b ON a.i = b.i"
    out[f"{p}_ldense"] = f"SELECT user_id, product_id, seen, coalesce(score, 0) AS raw FROM {p}_grid LEFT JOIN {p}_lraw USING (user_id, product_id)"
    out[f"{p}_lscore"] = f"SELECT user_id, product_id, CASE WHEN max(raw) OVER w - min(raw) OVER w > 1e-12 THEN (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) ELSE 0 END AS latent FROM {p}_ldense WINDOW w AS (PARTITION BY user_id)"
    out[f"{p}_brecs"] = f"""
  SELECT n, user_id, product_id, score, row_number() OVER (PARTITION BY n, user_id ORDER BY round(score, 9) DESC, product_id) AS rank FROM (
    SELECT n, user_id, product_id, n * score + (1 - n) * latent AS score FROM {p}_kscore JOIN {p}_lscore USING (user_id, product_id), (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS n) WHERE NOT seen) QUALIFY rank <= 100"""
    return out


POWERS = 30


def _power(cells: str, p: str) -> dict[str, str]:
    """The largest right singular vector by powers of X'X on the sparse table; its size says nothing."""
    out = {f"{p}_w0": f"SELECT product_id, 1.0::DOUBLE AS x FROM {cells} GROUP BY product_id"}
    for n in range(POWERS):
        out[f"{p}_a{n}"] = f"SELECT user_id, sum(value * x) AS x FROM {cells} JOIN {p}_w{n} USING (product_id) GROUP BY user_id"
        out[f"{p}_w{n + 1}"] = f"SELECT product_id, sum(value * x) / (SELECT max(x) FROM {p}_a{n}) AS x FROM {cells} JOIN {p}_a{n} USING (user_id) GROUP BY product_id"
    out[f"{p}_first1"] = f"SELECT product_id, x / sqrt(sum(x * x) OVER ()) AS x FROM {p}_w{POWERS}"
    return out


def _clean(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def _per_user(recs: str, truth: str, ks: str = "5, 10, 20") -> str:
    return f"""
  SELECT user_id, k, sum(hit) / k AS "precision", sum(hit) / n_rel AS recall,
         sum(CASE WHEN hit = 1 THEN hits / rank ELSE 0 END) / least(n_rel, k) AS map,
         sum(hit / log2(rank + 1)) / list_sum(list_transform(range(1, least(n_rel, k) + 1), lambda r: 1 / log2(r + 1))) AS ndcg,
         coalesce(1 / min(CASE WHEN hit = 1 THEN rank END), 0) AS mrr, max(hit)::DOUBLE AS hit_rate
  FROM (SELECT r.user_id, k, rank, n_rel, (t.user_id IS NOT NULL)::INT AS hit,
               sum((t.user_id IS NOT NULL)::INT) OVER (PARTITION BY r.user_id, k ORDER BY rank) AS hits
        FROM {recs} r JOIN (SELECT unnest([{ks}]) AS k) ON rank <= k
        JOIN (SELECT user_id, count(DISTINCT product_id) AS n_rel FROM {truth} GROUP BY user_id) n ON n.user_id = r.user_id
        LEFT JOIN (SELECT DISTINCT user_id, product_id FROM {truth}) t ON t.user_id = r.user_id AND t.product_id = r.product_id)
  GROUP BY user_id, k, n_rel"""


def _tfidf(terms: str, min_df: int) -> str:
    return f"""
  SELECT product_id, term, v / sqrt(sum(v * v) OVER (PARTITION BY product_id)) AS value FROM (
    SELECT product_id, term, (1 + ln(n)) * (ln((1 + (SELECT count(*) FROM prod)) / (1 + df)) + 1) AS v
    FROM {terms} JOIN (SELECT term, count(*)::DOUBLE AS df FROM {terms} GROUP BY term HAVING count(*) >= {min_df}) USING (term))"""


FRAGMENTS: dict[str, str] = {
    "ev": f"SELECT {_pad('E', 'event_id')} AS event_id, {_pad('U', 'user_id')} AS user_id, {_pad('P', "json_extract_string(props, '$.k')")} AS product_id, CASE event_type WHEN 'click' THEN 'add_to_cart' WHEN 'signup' THEN 'wishlist' ELSE event_type END AS event_type, epoch_us(ts) AS us FROM events",
    "vis": "SELECT event_id, user_id || '-' || (1 + sum(gap) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)) AS user_id, product_id, event_type, us FROM (SELECT *, (us - coalesce(lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id), us) > 48 * 3600000000)::INT AS gap FROM ev)",
    "star": f"""
  SELECT lpad(l_orderkey::VARCHAR, 10, '0') || '-' || lpad(l_linenumber::VARCHAR, 4, '0') || '-' || lpad(l_partkey::VARCHAR, 9, '0') || '-' || lpad(l_suppkey::VARCHAR, 9, '0') || '-' ||
         lpad(epoch_us(l_shipdate)::VARCHAR, 18, '0') || '-' || lpad(CAST(round(l_extendedprice * 100) AS BIGINT)::VARCHAR, 12, '0') AS event_id,
         {_pad('U', 'o_custkey')} AS user_id, {_pad('P', 'l_partkey')} AS product_id,
         CASE l_returnflag WHEN 'A' THEN 'purchase' WHEN 'R' THEN 'add_to_cart' ELSE 'view' END AS event_type, epoch_us(o_orderdate) AS us
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "prod": f"""
  SELECT {_pad('P', 'p_partkey')} AS product_id, p_name AS title, concat_ws(' ', p_type, p_brand, p_name) AS description, p_type AS category,
         'size' || (p_size // 10) AS subcategory, p_brand AS brand, p_retailprice AS price, 1 + (p_partkey * 7 % 41) / 10.0::DOUBLE AS rating,
         (p_partkey * 13 % 500)::BIGINT AS rating_count, string_split(p_name, ' ') AS tags FROM part""",
    "people": f"SELECT {_pad('U', 'c_custkey')} AS user_id FROM customer",
    "im": _cells("ev"),
    "impos": _cells("ev", positive=True),
    "num": "SELECT product_id, ln(1 + greatest(price, 0.01)) AS log_price, coalesce(rating, 3.5) AS rating, ln(1 + greatest(coalesce(rating_count, 0), 0)) AS log_rating_count FROM prod",
    "quality": """
  SELECT n.product_id, 0.7 * (((n.rating * rating_count + 120.0) / (rating_count + 30.0) - 1) / 4)
         + 0.3 * (log_rating_count - min(log_rating_count) OVER ()) / (max(log_rating_count) OVER () - min(log_rating_count) OVER () + 1e-9) AS quality
  FROM num n JOIN prod USING (product_id)""",
    "itext": f"SELECT product_id, concat_ws(' ', repeat({_clean('title')}, 2), {_clean('category')}, {_clean('subcategory')}, {_clean('brand')}, repeat({_clean("array_to_string(tags, ' ')")}, 2), {_clean('description')}) AS text FROM prod",
    "wterm": """
  SELECT product_id, term, count(*)::DOUBLE AS n FROM (
    SELECT product_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term
    FROM (SELECT product_id, regexp_extract_all(text, '[a-z0-9]{2,}') AS t FROM itext)) GROUP BY ALL""",
    "cterm": """
  SELECT product_id, term, count(*)::DOUBLE AS n FROM (
    SELECT product_id, substr(w, i, g) AS term FROM (
      SELECT product_id, w, g, unnest(range(1, length(w) - g + 2)) AS i FROM (
        SELECT product_id, ' ' || unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) || ' ' AS w FROM itext), (SELECT unnest([3, 4, 5]) AS g)
      WHERE length(w) >= g)) GROUP BY ALL""",
    "wtfidf": _tfidf("wterm", 2),
    "ctfidf": _tfidf("cterm", 3),
    "tax": "SELECT product_id, unnest(['category=' || coalesce(category, ''), 'subcategory=' || coalesce(subcategory, ''), 'brand=' || coalesce(brand, '')]) AS feature, 1.0::DOUBLE AS value FROM prod",
    "snum": "SELECT product_id, feature, abs((x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w > 0 THEN stddev_pop(x) OVER w ELSE 1 END) AS value FROM (UNPIVOT num ON log_price, rating, log_rating_count INTO NAME feature VALUE x) WINDOW w AS (PARTITION BY feature)",
    "feat": """
  SELECT product_id, feature, v / sqrt(sum(v * v) OVER (PARTITION BY product_id)) AS value FROM (
    SELECT product_id, 'word:' || term AS feature, value AS v FROM wtfidf UNION ALL SELECT product_id, 'char:' || term, 0.4 * value FROM ctfidf
    UNION ALL SELECT product_id, 'taxonomy:' || feature, 0.6 * value FROM tax UNION ALL SELECT product_id, 'numeric:' || feature, 0.25 * value FROM snum) WHERE v <> 0""",
    **_models("im", "m"),
    **_split("star", 5, 2, "s"),
    **_split("vis", 7, 2, "t"),
    **_models("s_cells", "sm"),
    **_models("t_cells", "tm"),
    "star_cells": _cells("star", halflife=36500.0),
    **_power("star_cells", "o"),
    **_latent("im", "m"),
    **_latent("t_cells", "tm"),
    "fused": "SELECT user_id, product_id, sum(w / (60 + rank)) AS score FROM (SELECT 0.4 AS w, user_id, product_id, rank FROM m_crecs WHERE rank <= 100 UNION ALL SELECT 0.5, user_id, product_id, rank FROM m_krecs WHERE rank <= 100 UNION ALL SELECT 0.1, user_id, product_id, rank FROM m_poprecs WHERE rank <= 100) GROUP BY ALL",
    "krecs20": "SELECT * FROM sm_krecs WHERE rank <= 20",
    "precs20": "SELECT * FROM sm_poprecs WHERE rank <= 20",
    "kuser": _per_user("krecs20", "s_test"),
    "puser": _per_user("precs20", "s_test"),
    "trials": """
  SELECT c, k, row_number() OVER (ORDER BY c, k) AS trial FROM (SELECT unnest([0.0, 0.2, 0.3, 0.4, 0.5, 0.6]::DOUBLE[]) AS c), (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS k) WHERE round(c + k, 9) < 1""",
    "tfused": """
  SELECT trial, user_id, product_id, sum(CASE m WHEN 'c' THEN c WHEN 'k' THEN k ELSE greatest(0, 1 - c - k) END / (60 + rank)) AS score FROM trials JOIN (
    SELECT 'c' AS m, user_id, product_id, rank FROM tm_crecs WHERE rank <= 100 UNION ALL SELECT 'k', user_id, product_id, rank FROM tm_krecs WHERE rank <= 100
    UNION ALL SELECT 'p', user_id, product_id, rank FROM tm_poprecs WHERE rank <= 100) ON m <> 'c' OR c > 0
  WHERE user_id IN (SELECT user_id FROM t_val) GROUP BY ALL""",
    "trecs": "SELECT trial, user_id || '#' || trial AS user_id, user_id AS person, product_id, score, row_number() OVER (PARTITION BY trial, user_id ORDER BY round(score, 9) DESC, product_id) AS rank FROM tfused QUALIFY rank <= 10",
    "ttruth": "SELECT user_id || '#' || trial AS user_id, product_id FROM t_val, trials",
    "tuser": _per_user("trecs", "ttruth", "10"),
    "trials3": """
  SELECT c, k, n, row_number() OVER (ORDER BY c, k, n) AS trial FROM (SELECT unnest([0.0, 0.2, 0.3, 0.4, 0.5, 0.6]::DOUBLE[]) AS c), (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS k), (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS n) WHERE round(c + k, 9) < 1""",
    "t3fused": """
  SELECT trial, user_id, product_id, sum(CASE m WHEN 'c' THEN c WHEN 'k' THEN k ELSE greatest(0, 1 - c - k) END / (60 + rank)) AS score FROM trials3 JOIN (
    SELECT 'c' AS m, NULL::DOUBLE AS w, user_id, product_id, rank FROM tm_crecs WHERE rank <= 100 UNION ALL SELECT 'k', n, user_id, product_id, rank FROM tm_brecs
    UNION ALL SELECT 'p', NULL, user_id, product_id, rank FROM tm_poprecs WHERE rank <= 100) ON (m <> 'c' OR c > 0) AND (m <> 'k' OR w = n)
  WHERE user_id IN (SELECT user_id FROM t_val) GROUP BY ALL""",
    "t3recs": "SELECT trial, user_id || '#' || trial AS user_id, user_id AS person, product_id, score, row_number() OVER (PARTITION BY trial, user_id ORDER BY round(score, 9) DESC, product_id) AS rank FROM t3fused QUALIFY rank <= 10",
    "t3truth": "SELECT user_id || '#' || trial AS user_id, product_id FROM t_val, trials3",
    "t3user": _per_user("t3recs", "t3truth", "10"),
    "thfused": "SELECT user_id, product_id, sum(w / (60 + rank)) AS score FROM (SELECT 0.4 AS w, user_id, product_id, rank FROM tm_crecs WHERE rank <= 100 UNION ALL SELECT 0.5, user_id, product_id, rank FROM tm_brecs WHERE n = 0.5 UNION ALL SELECT 0.1, user_id, product_id, rank FROM tm_poprecs WHERE rank <= 100) GROUP BY ALL",
    "evrecs": """
  SELECT 'content#' || user_id AS user_id, product_id, rank FROM tm_crecs WHERE rank <= 20 UNION ALL SELECT 'collaborative#' || user_id, product_id, rank FROM tm_brecs WHERE n = 0.5 AND rank <= 20
  UNION ALL SELECT 'popularity#' || user_id, product_id, rank FROM tm_poprecs WHERE rank <= 20
  UNION ALL SELECT 'hybrid#' || user_id, product_id, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, product_id) AS rank FROM thfused QUALIFY rank <= 20""",
    "evtruth": "SELECT m || '#' || user_id AS user_id, product_id FROM t_test, (SELECT unnest(['content', 'collaborative', 'popularity', 'hybrid']) AS m)",
    "evuser": _per_user("evrecs", "evtruth"),
}


def oracle(body: str) -> str:
    """body after a WITH clause of the fragments that it names, and those that they name."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in FRAGMENTS:
            if name not in order and re.search(rf"(?:\b(?:FROM|JOIN|UNPIVOT)|,)\s*\(?\s*{name}\b", sql):
                visit(FRAGMENTS[name])
                if name not in order:
                    order.append(name)

    visit(body)
    parts = ",\n".join(f"{name} AS MATERIALIZED ({FRAGMENTS[name]})" for name in order)
    return (f"WITH {parts}\n" if parts else "") + body
