"""DuckDB SQL oracles, one per query in ``catalog.QUERIES`` (same column
names).  Brute force on purpose: full pair scans, global windows."""

from __future__ import annotations


def _split(table: str, key: str, share: float, seed: int) -> str:
    return (f"SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || CAST({key} AS VARCHAR))) "
            f"<= ceil({share}::DOUBLE * count(*) OVER ()) AS is_test FROM {table}")


def _dist(a: str, b: str, metric: str) -> str:
    term = {"minkowski3": "pow(abs(z[1]::DOUBLE - z[2]::DOUBLE), 3)",
            "euclidean": "(z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)",
            "manhattan": "abs(z[1]::DOUBLE - z[2]::DOUBLE)"}[metric]
    return (f"list_reduce(list_transform(list_zip({a}, {b}), lambda z: {term}), "
            f"lambda x, y: x + y)")


def _knn_vote(train: str, test: str, key: str, label: str, dist: str, k: int) -> str:
    """Rows ``key, prediction`` for every test row: brute-force KNN."""
    return f"""
    SELECT {key}, prediction FROM (
      SELECT {key}, nlabel AS prediction,
             row_number() OVER (PARTITION BY {key} ORDER BY c DESC, nlabel) AS vr
      FROM (
        SELECT {key}, nlabel, count(*) AS c FROM (
          SELECT q.{key} AS {key}, r.{label} AS nlabel,
                 row_number() OVER (PARTITION BY q.{key} ORDER BY {dist}, r.{key}) AS rn
          FROM ({test}) q, ({train}) r
        ) WHERE rn <= {k} GROUP BY ALL
      )
    ) WHERE vr = 1"""


EMB_SPLIT = _split("embeddings", "vec_id", 0.25, 0)
EMB_TRAIN = f"SELECT * FROM ({EMB_SPLIT}) WHERE NOT is_test"
EMB_TEST = f"SELECT * FROM ({EMB_SPLIT}) WHERE is_test"
EUCL = _dist("q.embedding", "r.embedding", "euclidean")
MANH = _dist("q.embedding", "r.embedding", "manhattan")


def _part_split(scale: int) -> str:
    price = "p_retailprice" if scale == 1 else f"p_retailprice / {scale}.0"
    return _split(f"(SELECT p_partkey, p_size, {price} AS p_retailprice, p_type FROM part)",
                  "p_partkey", 0.25, 0)


def _part_knn(scale: int, features: list[str], k: int, weights: tuple = (1.0, 1.0)) -> str:
    s = _part_split(scale)
    dist = " + ".join(f"(q.{f}::DOUBLE - r.{f}::DOUBLE) * (q.{f}::DOUBLE - r.{f}::DOUBLE) * {w}::DOUBLE" for f, w in zip(features, weights))
    return _knn_vote(f"SELECT * FROM ({s}) WHERE NOT is_test", f"SELECT * FROM ({s}) WHERE is_test",
                     "p_partkey", "p_type", dist, k)


DOC_FEATS = ("SELECT d.doc_id, d.n_chars::DOUBLE AS n_chars, "
             "(length(d.text) - length(replace(d.text, ' ', '')))::DOUBLE AS n_spaces, l.quality "
             "FROM documents d JOIN labels l USING (doc_id)")
DOC_SPLIT = _split(f"({DOC_FEATS})", "doc_id", 0.25, 0)
DOC_DIST = " + ".join(f"(q.{f} - r.{f}) * (q.{f} - r.{f})" for f in ("n_chars", "n_spaces"))

ORACLE_SQL: dict[str, str] = {
    "exact_split_25": f"SELECT event_id, is_test FROM ({_split('events', 'event_id', 0.25, 0)})",
    "exact_split_20": f"SELECT event_id, is_test FROM ({_split('events', 'event_id', 0.2, 42)})",
    "knn_euclidean_k7": _knn_vote(EMB_TRAIN, EMB_TEST, "vec_id", "label", EUCL, 7),
    "knn_manhattan_k7": _knn_vote(EMB_TRAIN, EMB_TEST, "vec_id", "label", MANH, 7),
    "knn_many_k": f"""
      WITH nb AS (
        SELECT q.vec_id, q.label AS actual, r.label AS nlabel,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY {EUCL}, r.vec_id) AS rn
        FROM ({EMB_TEST}) q, ({EMB_TRAIN}) r),
      ks AS (SELECT unnest([3, 5, 7, 17]) AS k),
      votes AS (
        SELECT vec_id, k, actual, nlabel, count(*) AS c FROM nb JOIN ks ON nb.rn <= ks.k GROUP BY ALL),
      best AS (
        SELECT *, row_number() OVER (PARTITION BY vec_id, k ORDER BY c DESC, nlabel) AS vr FROM votes)
      SELECT k::INTEGER AS k, round(avg(CASE WHEN nlabel = actual THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy
      FROM best WHERE vr = 1 GROUP BY k""",
    "knn_accuracy": f"""
      WITH held AS ({_knn_vote(EMB_TRAIN, EMB_TEST, 'vec_id', 'label', EUCL, 7)}),
           own AS ({_knn_vote(EMB_TRAIN, EMB_TRAIN, 'vec_id', 'label', EUCL, 7)})
      SELECT 'held_out' AS part, round(avg(CASE WHEN h.prediction = e.label THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy
      FROM held h JOIN embeddings e USING (vec_id)
      UNION ALL
      SELECT 'training', round(avg(CASE WHEN o.prediction = e.label THEN 1.0 ELSE 0.0 END)::DOUBLE, 6)
      FROM own o JOIN embeddings e USING (vec_id)""",
    "knn_scaled_feature": f"""
      SELECT a.p_partkey, a.prediction AS pred_raw, b.prediction AS pred_scaled
      FROM ({_part_knn(1, ['p_size', 'p_retailprice'], 3)}) a
      JOIN ({_part_knn(1000, ['p_size', 'p_retailprice'], 3)}) b USING (p_partkey)""",
    "knn_feature_subset": _part_knn(1, ["p_retailprice"], 3),
    "knn_minkowski_p3": _knn_vote(EMB_TRAIN, EMB_TEST, "vec_id", "label", _dist("q.embedding", "r.embedding", "minkowski3"), 5),
    "knn_feature_weights": _part_knn(1, ["p_size", "p_retailprice"], 3, (100.0, 0.25)),
    "knn_k_above_n": """
      SELECT s_suppkey, (SELECT n_regionkey FROM nation GROUP BY n_regionkey ORDER BY count(*) DESC, n_regionkey LIMIT 1) AS prediction
      FROM supplier""",
    "knn_literal_rows": f"""
      WITH q AS (SELECT * FROM (VALUES (1, 10, 950.0::DOUBLE), (2, 33, 1500.5::DOUBLE)) t(row_id, p_size, p_retailprice))
      SELECT row_id::INTEGER AS row_id, prediction FROM ({_knn_vote('SELECT * FROM part', 'SELECT * FROM q', 'row_id', 'p_type',
        '(q.p_size::DOUBLE - r.p_size::DOUBLE) * (q.p_size::DOUBLE - r.p_size::DOUBLE) + (q.p_retailprice::DOUBLE - r.p_retailprice::DOUBLE) * (q.p_retailprice::DOUBLE - r.p_retailprice::DOUBLE)',
        5).replace('r.row_id', 'r.p_partkey')})
      UNION ALL SELECT 3, NULL""",
    "knn_own_prediction_score": f"""
      WITH first AS ({_knn_vote(EMB_TRAIN, EMB_TEST, 'vec_id', 'label', EUCL, 5)}),
           relab AS (SELECT t.vec_id, t.embedding, f.prediction FROM ({EMB_TEST}) t JOIN first f USING (vec_id)),
           second AS ({_knn_vote('SELECT * FROM relab', 'SELECT * FROM relab', 'vec_id', 'prediction', EUCL, 5)})
      SELECT 'same' AS fit, 1.0::DOUBLE AS accuracy
      UNION ALL SELECT 'refit', round(avg(CASE WHEN s.prediction = r.prediction THEN 1.0 ELSE 0.0 END)::DOUBLE, 6)
      FROM second s JOIN relab r USING (vec_id)""",
    "knn_pseudo_refit": f"""
      WITH first AS ({_knn_vote(EMB_TRAIN, EMB_TEST, 'vec_id', 'label', EUCL, 5)}),
           relab AS (SELECT t.vec_id, t.embedding, f.prediction AS pseudo_label
                     FROM ({EMB_TEST}) t JOIN first f USING (vec_id)),
           second AS ({_knn_vote('SELECT * FROM relab', 'SELECT * FROM relab', 'vec_id', 'pseudo_label', EUCL, 5)})
      SELECT s.vec_id, r.pseudo_label, s.prediction AS refit_prediction
      FROM second s JOIN relab r USING (vec_id)""",
    "knn_label_file_accuracy": f"""
      WITH pred AS ({_knn_vote(f'SELECT * FROM ({DOC_SPLIT}) WHERE NOT is_test',
                               f'SELECT * FROM ({DOC_SPLIT}) WHERE is_test', 'doc_id', 'quality', DOC_DIST, 5)})
      SELECT count(*) AS n_test, count_if(p.prediction <> l.quality) AS n_wrong,
             round(avg(CASE WHEN p.prediction = l.quality THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy
      FROM pred p JOIN labels l USING (doc_id)""",
}


def _r6(c: str, alias: str | None = None) -> str:
    return f"round({c}, 6) AS {alias or c}"


EUROPE = ("(SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN "
          "(SELECT r_regionkey FROM region WHERE r_name = 'EUROPE'))")

DAILY_FIRST = """
  SELECT user_id, CAST(ts AS DATE) AS day,
         arg_min(value, event_id) FILTER (WHERE event_type = 'purchase') AS purchase_value,
         arg_min(value, event_id) FILTER (WHERE event_type = 'error') AS error_value
  FROM events GROUP BY ALL"""

GRID = f"""
  WITH df AS ({DAILY_FIRST}),
  span AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM df GROUP BY user_id),
  grid AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM span)
  SELECT g.user_id, g.day, df.purchase_value, df.error_value
  FROM grid g LEFT JOIN df ON g.user_id = df.user_id AND g.day = df.day"""


def _filled(over: str) -> str:
    frame = f"OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""SELECT user_id, day,
      last_value(purchase_value IGNORE NULLS) {frame} AS purchase_value,
      last_value(error_value IGNORE NULLS) {frame} AS error_value
    FROM ({GRID})"""


FILLED = _filled("PARTITION BY user_id ORDER BY day")


def _series(event_type: str) -> str:
    """Dense daily series of one event type per user, forward filled (W1+W2)."""
    return f"""
    WITH r AS (
      SELECT user_id, CAST(ts AS DATE) AS day, arg_min(value, event_id) AS first_value,
             arg_min(value, event_id) FILTER (WHERE value > 50) AS big_value
      FROM events WHERE event_type = '{event_type}' GROUP BY ALL),
    span AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM r GROUP BY user_id),
    grid AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
    g AS (SELECT grid.user_id, grid.day, r.first_value, r.big_value
          FROM grid LEFT JOIN r ON grid.user_id = r.user_id AND grid.day = r.day)
    SELECT user_id, day,
      last_value(first_value IGNORE NULLS) OVER w AS first_value,
      last_value(big_value IGNORE NULLS) OVER w AS big_value
    FROM g WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


CLICKS = "SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'click'"

MATCH_SQL = """
  WITH ev AS (SELECT *, CAST(ts AS DATE) AS day FROM events),
  m AS (SELECT event_id AS match_id, day, printf('T%02d', (user_id * 7) % 40) AS home_team, printf('T%02d', (user_id * 7 + event_id % 11 + 1) % 40) AS away_team,
      floor(value)::BIGINT AS hs, CASE WHEN event_id % 9 <> 0 THEN floor(100 - value)::BIGINT END AS aws,
      CASE WHEN event_id % 5 = 0 THEN 'Friendly' WHEN event_id % 5 <> 1 THEN 'Cup' END AS kind FROM ev WHERE event_type = 'click'),
  r AS (SELECT team, day, arg_min(rank, event_id) FILTER (WHERE rank IS NOT NULL) AS rank, arg_min(points, event_id) FILTER (WHERE points IS NOT NULL) AS points
    FROM (SELECT event_id, day, printf('T%02d', (user_id * 7) % 40) AS team, CASE WHEN event_id % 4 <> 0 THEN floor(value)::BIGINT END AS rank,
            CASE WHEN event_id % 3 <> 0 THEN value * 10 END AS points FROM ev WHERE event_type = 'error') GROUP BY ALL),
  span AS (SELECT team, min(day) AS lo, max(day) AS hi FROM r GROUP BY team),
  grid AS (SELECT team, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
  f AS (SELECT g.team, g.day, last_value(rank IGNORE NULLS) OVER w AS rank, last_value(points IGNORE NULLS) OVER w AS points
    FROM grid g LEFT JOIN r ON r.team = g.team AND r.day = g.day WINDOW w AS (PARTITION BY g.team ORDER BY g.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  j AS (SELECT m.*, h.rank AS hr, a.rank AS ar, h.points AS hp, a.points AS ap FROM m JOIN f h ON h.team = home_team AND h.day = m.day
    JOIN f a ON a.team = away_team AND a.day = m.day)
  SELECT match_id, home_team, away_team, hr - ar AS rank_difference, round((hr + ar) / 2, 6) AS average_rank, round(hp - ap, 6) AS point_difference,
    hs - aws AS score_difference, coalesce(hs - aws > 0, false) AS is_won, NOT (kind IS NOT DISTINCT FROM 'Friendly') AS is_stake,
    CAST(coalesce(greatest(least(datediff('day', lag(day) OVER (PARTITION BY home_team ORDER BY day, match_id), day), 30), 0), 30) AS INTEGER) AS rest_days,
    CASE WHEN home_team IN ('T03', 'T17') THEN home_team ELSE 'Other' END AS wc_participant,
    (home_team = 'T03')::INTEGER AS T03, (home_team = 'T17')::INTEGER AS T17, (home_team NOT IN ('T03', 'T17'))::INTEGER AS Other
  FROM j"""

ORACLE_SQL.update({
    "match_feature_table": MATCH_SQL,
    "segmented_ffill": f"SELECT user_id, day, {_r6('purchase_value')}, {_r6('error_value')} FROM ({FILLED})",
    "left_join_missing": """
      WITH j AS (SELECT c_custkey, o_orderkey, o_totalprice, o_orderpriority FROM customer
                 LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) o ON o_custkey = c_custkey)
      SELECT c_custkey, o_orderkey, NOT (o_orderpriority IS NOT DISTINCT FROM '1-URGENT') AS not_urgent,
             coalesce(o_totalprice > 200000, false) AS large, (SELECT count(o_orderkey) FROM j) AS n_orders FROM j""",
    "merge_suffixes": """
      SELECT doc_id, item_id, lang, length(d.text)::INTEGER AS doc_chars, length(b.text)::INTEGER AS item_chars
      FROM documents d FULL JOIN benchmark b ON d.doc_id = b.item_id""",
    "lookup_unknown": """
      SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') ON r_regionkey = n_regionkey""",
    "csv_typed_roundtrip": """
      SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment,
             round(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, 6) AS c_credit,
             'c_custkey:bigint, c_name:string, c_nationkey:bigint, c_acctbal:double, c_mktsegment:string, c_credit:double' AS kinds
      FROM customer""",
    "csv_newline_header": "SELECT n_nationkey::BIGINT AS nation_key, n_name AS full_name FROM nation",
    "csv_dates": """
      SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(NULL AS DATE) AS no_day,
             datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))::INTEGER AS days FROM orders""",
    "csv_label_sink": """
      SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_id, (row_number() OVER (ORDER BY p_partkey) - 1) // 2 AS half, p_type AS label
      FROM part""",
    "clean_replace_project": """
      SELECT c_custkey,
             CASE c_name WHEN 'HOUSEHOLD' THEN 'HOME' WHEN 'AUTOMOBILE' THEN 'AUTO' ELSE c_name END AS c_name,
             CASE WHEN seg = '' THEN 'Other' ELSE seg END AS c_mktsegment, c_nationkey
      FROM (SELECT *, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'HOME' WHEN 'AUTOMOBILE' THEN 'AUTO'
                      ELSE c_mktsegment END AS seg FROM customer)
      WHERE NOT (c_custkey IS NULL AND c_name IS NULL AND c_mktsegment IS NULL AND c_nationkey IS NULL)""",
    "derived_features": f"""
      SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_day,
             {_r6('o_totalprice / 1000', 'total_k')},
             {_r6('o_totalprice - c_acctbal', 'balance_gap')},
             {_r6('(o_totalprice + c_acctbal) / 2', 'mean_amount')},
             coalesce(c_acctbal > 0, false) AS in_credit,
             NOT (o_orderpriority IS NOT DISTINCT FROM '1-URGENT') AS not_urgent,
             {_r6('coalesce(greatest(least(c_acctbal, 5000), 0), 0)', 'acctbal_clipped')}
      FROM orders JOIN customer ON o_custkey = c_custkey""",
    "filter_membership": f"""
      SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer
      WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0
        AND c_nationkey IN (SELECT n_nationkey FROM {EUROPE})""",
    "membership_flag_onehot": f"""
      WITH o AS (
        SELECT o_orderkey,
               CASE WHEN n.n_name IN (SELECT n_name FROM {EUROPE}) THEN n.n_name ELSE 'Other' END AS participant
        FROM orders JOIN customer ON o_custkey = c_custkey
        LEFT JOIN nation n ON c_nationkey = n.n_nationkey)
      SELECT o_orderkey, participant,
             (participant = 'NATION_13')::INTEGER AS NATION_13, (participant = 'NATION_18')::INTEGER AS NATION_18,
             (participant = 'NATION_23')::INTEGER AS NATION_23, (participant = 'NATION_3')::INTEGER AS NATION_3,
             (participant = 'NATION_8')::INTEGER AS NATION_8, (participant = 'Other')::INTEGER AS Other
      FROM o""",
    "daily_first": f"SELECT user_id, day, {_r6('purchase_value')}, {_r6('error_value')} FROM ({DAILY_FIRST})",
    "daily_grid_ffill": f"SELECT user_id, day, {_r6('purchase_value')}, {_r6('error_value')} FROM ({FILLED})",
    "ffill_across_keys": f"""SELECT user_id, day, {_r6('purchase_value')}, {_r6('error_value')}
      FROM ({_filled('ORDER BY user_id, day')})""",
    "asof_bounded": f"""
      SELECT l.event_id, l.user_id, l.day, {_r6('s.first_value', 'first_value')}, {_r6('s.big_value', 'big_value')}
      FROM ({CLICKS}) l JOIN ({_series('error')}) s ON l.user_id = s.user_id AND l.day = s.day""",
    "asof_two_sided": f"""
      SELECT l.event_id, l.user_id, l.day,
             {_r6('e.first_value', 'first_value_err')}, {_r6('p.first_value', 'first_value_pur')},
             {_r6('e.first_value - p.first_value', 'value_gap')},
             {_r6('(e.first_value + p.first_value) / 2', 'value_mean')}
      FROM ({CLICKS}) l
      JOIN ({_series('error')}) e ON l.user_id = e.user_id AND l.day = e.day
      JOIN ({_series('purchase')}) p ON l.user_id = p.user_id AND l.day = p.day""",
    "two_key_join": f"""
      SELECT l.event_id, l.user_id, l.day, r.s_user, r.s_day, {_r6('r.first_value', 'first_value')}
      FROM ({CLICKS}) l JOIN (
        SELECT user_id AS s_user, CAST(ts AS DATE) AS s_day, arg_min(value, event_id) AS first_value
        FROM events WHERE event_type = 'purchase' GROUP BY ALL) r
      ON l.day = r.s_day AND l.user_id = r.s_user""",
    "rest_days_clipped": """
      SELECT o_orderkey, o_custkey, order_day,
             CAST(coalesce(greatest(least(datediff('day', lag(order_day) OVER w, order_day), 30), 0), 30) AS INTEGER)
               AS rest_days
      FROM (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS order_day FROM orders)
      WINDOW w AS (PARTITION BY o_custkey ORDER BY order_day, o_orderkey)""",
    "rest_days_by_price": """
      SELECT o_orderkey, o_custkey, order_day,
             CAST(CASE WHEN lag(order_day) OVER w IS NULL THEN 30 ELSE greatest(least(datediff('day', lag(order_day) OVER w, order_day), 100), -100) END AS INTEGER) AS rest_days
      FROM (SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS order_day FROM orders)
      WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)""",
    "segmentless_ffill": f"""
      SELECT event_id, event_type,
             round(last_value(seen IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS last_seen,
             round(first_value(seen IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS next_seen
      FROM (SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN value END AS seen FROM events)""",
    "onehot_cells": """
      WITH c AS (SELECT p_type, (row_number() OVER (ORDER BY p_type) - 1)::INTEGER AS index FROM (SELECT DISTINCT p_type FROM part))
      SELECT p_partkey, p_type AS category, index, (SELECT count(*) FROM c)::INTEGER AS size FROM part JOIN c USING (p_type)""",
    "latest_per_key": f"""
      SELECT user_id, day, {_r6('purchase_value')}, {_r6('error_value')} FROM ({FILLED}) f
      WHERE day = (SELECT max(day) FROM ({FILLED}))
        AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')""",
    "first_rows": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders ORDER BY o_orderkey LIMIT 5",
})


SCORED_DOCS = "SELECT d.doc_id, d.n_chars, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)"
SCORE_COUNTS = f"""SELECT n_chars AS score, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS pos,
  sum(CASE WHEN quality = 1 THEN 0 ELSE 1 END) AS neg FROM ({SCORED_DOCS}) GROUP BY n_chars"""


def _dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _sigmoid(terms: list[str], intercept: float, coefs: list[float]) -> str:
    z = _dbl(intercept)
    for t, w in zip(terms, coefs):
        z = f"({z} + {_dbl(w)} * ({t}))"
    return f"(1.0 / (1.0 + exp(-{z})))"


def _poly2(names: list[str]) -> list[str]:
    out = list(names)
    for i in range(len(names)):
        for j in range(i, len(names)):
            out.append(f"{names[i]} * {names[j]}")
    return out


DOC_MODEL = """SELECT d.doc_id, d.n_chars / 1000 AS a,
  (length(d.text) - length(replace(d.text, ' ', ''))) / 1000 AS b,
  CAST(d.lang = 'en' AS DOUBLE) AS c, l.quality
  FROM documents d JOIN labels l USING (doc_id)"""

# must equal catalog.FIXED_* and catalog.PAIR_* (imported there from one place)
from corvid.plans.catalog import (FIXED_COEFS, FIXED_INTERCEPT, PAIR_COEFS, PAIR_INTERCEPT,  # noqa: E402
                                  TWO_RATING_COEFS, TWO_RATING_INTERCEPT)
from corvid.operators.tournament import PAIRING, ROUND_NAMES  # noqa: E402

FIXED_P = _sigmoid(_poly2(["a", "b", "c"]), FIXED_INTERCEPT, FIXED_COEFS)


def _two_p() -> str:
    feats = ["(a.points_k - b.points_k)", "((a.points_k + b.points_k) / 2)", "((a.place - b.place) / 10)", "1.0"]
    return _sigmoid(_poly2(feats), TWO_RATING_INTERCEPT, TWO_RATING_COEFS)


def _pair_p(h: str, a: str) -> str:
    return _sigmoid([f"({h} - {a}) / 1000", f"({h} + {a}) / 2000", "1.0"], PAIR_INTERCEPT, PAIR_COEFS)


TEAMS = ("SELECT c_custkey, c_name, c_acctbal, c_custkey // 32 AS bracket, "
         "CAST((c_custkey // 4) % 8 AS INTEGER) AS grp FROM customer")
T_SCORED = f"""SELECT a.bracket, a.grp, a.c_custkey AS home, b.c_custkey AS away,
  {_pair_p('a.c_acctbal', 'b.c_acctbal')} AS p_home
  FROM ({TEAMS}) a JOIN ({TEAMS}) b ON a.bracket = b.bracket AND a.grp = b.grp AND a.c_custkey < b.c_custkey"""
T_STAND = f"""
  WITH s AS ({T_SCORED}),
  sides AS (
    SELECT bracket, grp, home AS team,
           CASE WHEN p_home <= 0 THEN 0 WHEN p_home >= 0.76 THEN 3 WHEN p_home > 0 THEN 1 ELSE 0 END AS pts,
           p_home AS prob FROM s
    UNION ALL
    SELECT bracket, grp, away,
           CASE WHEN p_home <= 0 THEN 3 WHEN p_home >= 0.76 THEN 0 WHEN p_home > 0 THEN 1 ELSE 0 END,
           1.0 - p_home FROM s)
  SELECT t.bracket, t.grp, t.c_custkey, CAST(coalesce(sum(x.pts), 0) AS INTEGER) AS points,
         coalesce(sum(x.prob), 0.0) AS total_prob
  FROM ({TEAMS}) t LEFT JOIN sides x ON t.bracket = x.bracket AND t.grp = x.grp AND t.c_custkey = x.team
  GROUP BY t.bracket, t.grp, t.c_custkey"""
T_TOP2 = f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY bracket, grp
  ORDER BY points DESC, round(total_prob, 9) DESC, c_custkey) AS INTEGER) AS place FROM ({T_STAND})) WHERE place <= 2"""
T_SEEDED = f"""SELECT t.bracket, p.slot, t.c_custkey FROM ({T_TOP2}) t
  JOIN (SELECT CAST(unnest(range({len(PAIRING)})) AS INTEGER) AS slot,
               unnest({list(PAIRING)}) AS position) p
  ON t.grp * 2 + t.place - 1 = p.position"""


def _round(prev: str, n: int) -> str:
    return f"""SELECT bracket, pair, home, away, p_home,
      CASE WHEN away IS NULL THEN home WHEN home IS NULL THEN away
           WHEN p_home <= 0.8 THEN away ELSE home END AS winner,
      {n} AS round, '{ROUND_NAMES[n - 1]}' AS round_name
    FROM (
      SELECT bracket, pair, home, away,
             CASE WHEN home IS NOT NULL AND away IS NOT NULL THEN {_pair_p('rh', 'ra')} END AS p_home
      FROM (
        SELECT s.bracket, CAST(s.slot // 2 AS INTEGER) AS pair,
               max(CASE WHEN s.slot % 2 = 0 THEN s.c_custkey END) AS home,
               max(CASE WHEN s.slot % 2 = 1 THEN s.c_custkey END) AS away,
               max(CASE WHEN s.slot % 2 = 0 THEN t.c_acctbal END) AS rh,
               max(CASE WHEN s.slot % 2 = 1 THEN t.c_acctbal END) AS ra
        FROM ({prev}) s LEFT JOIN customer t ON s.c_custkey = t.c_custkey
        GROUP BY s.bracket, CAST(s.slot // 2 AS INTEGER)))"""


def _rounds_sql() -> str:
    ctes = [f"r1 AS ({_round(T_SEEDED, 1)})"]
    for n in range(2, 5):
        ctes.append(f"r{n} AS ({_round(f'SELECT bracket, pair AS slot, winner AS c_custkey FROM r{n - 1}', n)})")
    return "WITH " + ",\n".join(ctes) + "\nSELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4"


ROUNDS = _rounds_sql()

ORACLE_SQL.update({
    "confusion": """
      SELECT quality, count(*) FILTER (WHERE pred = 0) AS pred_0, count(*) FILTER (WHERE pred = 1) AS pred_1,
        0::BIGINT AS pred_other, 0::BIGINT AS pred_missing
      FROM (SELECT quality, CAST(n_chars >= 2000 AS INTEGER) AS pred FROM documents JOIN labels USING (doc_id))
      GROUP BY quality""",
    "confusion_with_missing": """
      WITH d AS (SELECT quality, CASE WHEN d.doc_id % 7 <> 0 THEN CASE WHEN n_chars > 5000 THEN 2 WHEN n_chars >= 2000 THEN 1 ELSE 0 END END AS pred
                 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
      c AS (SELECT quality, count(*) FILTER (WHERE pred = 0) AS pred_0, count(*) FILTER (WHERE pred = 1) AS pred_1,
              count(*) FILTER (WHERE pred NOT IN (0, 1)) AS pred_other, count(*) FILTER (WHERE pred IS NULL) AS pred_missing FROM d GROUP BY quality)
      SELECT * FROM c UNION ALL SELECT DISTINCT pred, 0, 0, 0, 0 FROM d WHERE pred IS NOT NULL AND pred NOT IN (SELECT quality FROM c WHERE quality IS NOT NULL)""",
    "confusion_table": """
      SELECT quality, CAST(least(floor(n_chars / 1000), 5) AS INTEGER) AS predicted, count(*) AS n
      FROM documents JOIN labels USING (doc_id) GROUP BY ALL""",
    "value_shares_by": f"""
      SELECT quality, lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS share
      FROM ({SCORED_DOCS}) GROUP BY quality, lang""",
    "logit_fit_gradient": """
      SELECT unnest(['intercept', 'n_chars_k', 'n_spaces_k', 'is_en', 'n_chars_k*n_chars_k', 'n_chars_k*n_spaces_k', 'n_chars_k*is_en',
                     'n_spaces_k*n_spaces_k', 'n_spaces_k*is_en', 'is_en*is_en']) AS term, true AS at_optimum""",
    "pair_scores_two_ratings": f"""
      WITH t AS (SELECT c_custkey, c_custkey // 4 AS grp, c_acctbal / 1000 AS points_k, c_nationkey::DOUBLE AS place FROM customer)
      SELECT a.grp, a.c_custkey AS home, b.c_custkey AS away, round({_two_p()}, 6) AS p_home
      FROM t a JOIN t b ON a.grp = b.grp AND a.c_custkey < b.c_custkey""",
    "reorder_by_list": """
      SELECT n_nationkey, n_name, CAST(CASE WHEN n_nationkey IN (3, 11) THEN NULL
        ELSE 24 - n_nationkey - (n_nationkey < 3)::INTEGER - (n_nationkey < 11)::INTEGER END AS INTEGER) AS slot FROM nation""",
    "neighbour_slots": """
      SELECT s_suppkey // 2 AS pair, max(s_name) FILTER (WHERE s_suppkey % 2 = 0) AS s_name_even, max(s_name) FILTER (WHERE s_suppkey % 2 = 1) AS s_name_odd
      FROM supplier GROUP BY 1""",
    "matchup_labels": f"""
      SELECT bracket, home, away, printf('%s(%.2f) vs. %s(%.2f)', h.c_name, 1.0 / p_home, a.c_name, 1.0 / (1.0 - p_home)) AS label, round(1.0 / p_home, 4) AS odds
      FROM ({T_SCORED}) JOIN customer h ON h.c_custkey = home JOIN customer a ON a.c_custkey = away""",
    "roc_points": f"""
      SELECT score AS threshold,
        round(sum(neg) OVER w / (SELECT sum(neg) FROM ({SCORE_COUNTS})), 6) AS fpr,
        round(sum(pos) OVER w / (SELECT sum(pos) FROM ({SCORE_COUNTS})), 6) AS tpr
      FROM ({SCORE_COUNTS})
      WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "auc": f"""
      SELECT round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                        THEN sum(pos * (cneg + neg * 0.5)) / (sum(pos) * sum(neg)) END, 6) AS auc
      FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  AS cneg FROM ({SCORE_COUNTS}))""",
    "value_shares": f"""
      SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
      FROM ({SCORED_DOCS}) WHERE quality = 0 GROUP BY lang""",
    "kde_grid": """
      WITH v AS (SELECT o_totalprice / 1000 AS x FROM orders),
      s AS (SELECT count(x) AS n, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi FROM v),
      p AS (SELECT n, sd * pow(n, -0.2) AS h, lo - 0.5 * (hi - lo) AS g0,
                   ((hi + 0.5 * (hi - lo)) - (lo - 0.5 * (hi - lo))) / 999 AS step FROM s),
      grid AS (SELECT range AS j FROM range(1000))
      SELECT CAST(j AS INTEGER) AS j, round(g0 + j * step, 6) AS x,
             round(sum(exp(-0.5 * ((g0 + j * step - x) / h) * ((g0 + j * step - x) / h)))
                   / (n * h * sqrt(2 * pi())), 9) AS density
      FROM grid, p, v GROUP BY j, g0, step, n, h""",
    "logit_score_fixed": f"""
      SELECT doc_id, round({FIXED_P}, 6) AS p_quality, CAST({FIXED_P} > 0.5 AS INTEGER) AS prediction
      FROM ({DOC_MODEL})""",
    "error_slices": f"""
      WITH pred AS ({_knn_vote(EMB_TRAIN, EMB_TEST, 'vec_id', 'label', EUCL, 7)}),
      scored AS (SELECT p.vec_id, p.prediction, e.label FROM pred p JOIN embeddings e USING (vec_id))
      SELECT 'wrong' AS slice, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
      FROM scored WHERE prediction <> label GROUP BY label
      UNION ALL
      SELECT 'all', label, count(*), round(count(*) / sum(count(*)) OVER (), 6) FROM scored GROUP BY label""",
    "pair_scores": f"SELECT bracket, grp, home, away, round(p_home, 6) AS p_home FROM ({T_SCORED})",
    "standings": f"SELECT bracket, grp, c_custkey, points, round(total_prob, 6) AS total_prob FROM ({T_STAND})",
    "top2_per_group": f"""SELECT bracket, grp, c_custkey, place, points, round(total_prob, 6) AS total_prob
      FROM ({T_TOP2})""",
    "seeded_slots": T_SEEDED,
    "fold_rounds": f"""SELECT bracket, round, round_name, pair, home, away, round(p_home, 6) AS p_home, winner
      FROM ({ROUNDS})""",
    "round_report": f"""
      SELECT r.bracket, r.round, r.pair,
             printf('%s(%.2f) vs. %s(%.2f)', h.c_name, 1.0 / r.p_home, a.c_name, 1.0 / (1.0 - r.p_home)) AS label,
             round(r.p_home, 6) AS p_home, round(1.0 - r.p_home, 6) AS p_away
      FROM ({ROUNDS}) r LEFT JOIN customer h ON r.home = h.c_custkey LEFT JOIN customer a ON r.away = a.c_custkey
      WHERE r.p_home IS NOT NULL""",
})


def _kde_sql(values: str, points: int) -> str:
    """Brute-force KDE (every value against every grid point)."""
    return f"""
      WITH v AS ({values}),
      s AS (SELECT count(x) AS n, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi FROM v),
      p AS (SELECT n, sd * pow(n, -0.2) AS h, lo - 0.5 * (hi - lo) AS g0,
                   ((hi + 0.5 * (hi - lo)) - (lo - 0.5 * (hi - lo))) / {points - 1} AS step FROM s),
      grid AS (SELECT range AS j FROM range({points}))
      SELECT CAST(j AS INTEGER) AS j, round(g0 + j * step, 6) AS x,
             round(sum(exp(-0.5 * ((g0 + j * step - x) / h) * ((g0 + j * step - x) / h)))
                   / (n * h * sqrt(2 * pi())), 9) AS density
      FROM grid, p, v GROUP BY j, g0, step, n, h"""


DOC_PRED = _knn_vote(f"SELECT * FROM ({DOC_SPLIT}) WHERE NOT is_test", f"SELECT * FROM ({DOC_SPLIT}) WHERE is_test",
                     "doc_id", "quality", DOC_DIST, 5)
DOC_SCORED = f"""SELECT p.doc_id, p.prediction, f.quality, f.n_chars / 1000 AS n_chars_k
  FROM ({DOC_PRED}) p JOIN ({DOC_FEATS}) f USING (doc_id)"""

ORACLE_SQL["error_slice_density"] = f"""
  SELECT 'wrong' AS slice, * FROM ({_kde_sql(f"SELECT n_chars_k AS x FROM ({DOC_SCORED}) WHERE prediction <> quality", 200)})
  UNION ALL
  SELECT 'all', * FROM ({_kde_sql(f"SELECT n_chars_k AS x FROM ({DOC_SCORED})", 200)})"""

FIXED_SCORED = f"""SELECT doc_id, quality, {FIXED_P} AS p, CAST({FIXED_P} > 0.5 AS INTEGER) AS pred
  FROM ({DOC_MODEL})"""
FIXED_COUNTS = f"""SELECT p AS score, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS pos,
  sum(CASE WHEN quality = 1 THEN 0 ELSE 1 END) AS neg FROM ({FIXED_SCORED}) GROUP BY p"""

ORACLE_SQL.update({
    "logit_fixed_auc": f"""
      SELECT round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                        THEN sum(pos * (cneg + neg * 0.5)) / (sum(pos) * sum(neg)) END, 6) AS auc
      FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  AS cneg FROM ({FIXED_COUNTS}))""",
    "logit_fixed_confusion": f"""
      SELECT quality, count(*) FILTER (WHERE pred = 0) AS pred_0, count(*) FILTER (WHERE pred = 1) AS pred_1,
        0::BIGINT AS pred_other, 0::BIGINT AS pred_missing
      FROM ({FIXED_SCORED}) GROUP BY quality""",
})

ORACLE_SQL["roc_points_pruned"] = f"""
  WITH c AS (
    SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp
    FROM ({SCORE_COUNTS})
    WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  n AS (
    SELECT *, lag(tp) OVER o AS tp0, lead(tp) OVER o AS tp2, lag(fp) OVER o AS fp0, lead(fp) OVER o AS fp2
    FROM c WINDOW o AS (ORDER BY score DESC))
  SELECT score AS threshold,
         round(fp / (SELECT sum(neg) FROM ({SCORE_COUNTS})), 6) AS fpr,
         round(tp / (SELECT sum(pos) FROM ({SCORE_COUNTS})), 6) AS tpr
  FROM n
  WHERE tp0 IS NULL OR tp2 IS NULL OR fp0 - 2 * fp + fp2 <> 0 OR tp0 - 2 * tp + tp2 <> 0"""

_PRED_CELLS = ", ".join(f"count(*) FILTER (WHERE p.prediction = {i}) AS pred_{i}" for i in range(10))
ORACLE_SQL["knn_confusion"] = f"""
  SELECT e.label AS actual, {_PRED_CELLS}, 0::BIGINT AS pred_other, 0::BIGINT AS pred_missing
  FROM ({_knn_vote(EMB_TRAIN, EMB_TEST, 'vec_id', 'label', EUCL, 7)}) p JOIN embeddings e USING (vec_id)
  GROUP BY e.label"""


def _newton_fit(rows: str, penalty: float, steps: int) -> str:
    """Plain Newton steps from zero on ``rows`` (x list of 10 terms, y): the last weights as a list.  The normal
    equations with their right side are one nested list, solved by elimination column by column."""
    n = 10
    line = [", ".join(f"sum(s * x[{min(i, j)}] * x[{max(i, j)}])" + (f" + {penalty}" if i == j > 1 else "") for j in range(1, n + 1))
            + f", sum((p - y) * x[{i}])" + (f" + {penalty} * w[{i}]" if i > 1 else "") for i in range(1, n + 1)]
    solved = f"""SELECT k, w, [{', '.join(f'[{x}]' for x in line)}] AS a
      FROM (SELECT *, p * (1 - p) AS s FROM (SELECT k, w, x, y, 1 / (1 + exp(-list_dot_product(x, w))) AS p FROM fit, rows WHERE k < {steps})) GROUP BY k, w"""
    for c in range(1, n + 1):
        solved = f"""SELECT k, w, list_transform(a, lambda r, i: CASE WHEN i = {c} THEN list_transform(r, lambda v: v / a[{c}][{c}])
          ELSE list_transform(r, lambda v, j: v - r[{c}] / a[{c}][{c}] * a[{c}][j]) END) AS a FROM ({solved})"""
    return f"""WITH RECURSIVE rows AS MATERIALIZED ({rows}),
    fit(k, w) AS (SELECT 0, [{', '.join(['0::DOUBLE'] * n)}]
      UNION ALL SELECT k + 1, list_transform(w, lambda v, i: v - a[i][{n + 1}]) FROM ({solved}))
    SELECT w FROM fit WHERE k = {steps}"""


_TERMS10 = "[1::DOUBLE, a, b, c, a * a, a * b, a * c, b * b, b * c, c * c]"
_MODEL_SPLIT = f"SELECT doc_id, quality, is_test, {_TERMS10} AS x FROM ({_split(f'({DOC_MODEL})', 'doc_id', 0.2, 42)})"
_MODEL_FIT = _newton_fit(f"SELECT x, quality::DOUBLE AS y FROM ({_MODEL_SPLIT}) WHERE NOT is_test", 1e5, 12)
_MODEL_P = f"SELECT d.*, 1 / (1 + exp(-list_dot_product(x, w))) AS p FROM ({_MODEL_SPLIT}) d, ({_MODEL_FIT})"
_CELLS = " UNION ALL ".join(f"SELECT part, 'actual_{a}_pred_{q}', count(*) FILTER (WHERE quality = {a} AND pred = {q})::DOUBLE FROM m GROUP BY part"
                            for a in (0, 1) for q in (0, 1))

ORACLE_SQL["logit_fit_predict"] = f"""
  SELECT doc_id, round(p, 6) AS p_quality, CAST(p > 0.5 AS INTEGER) AS prediction FROM ({_MODEL_P}) WHERE is_test"""

ORACLE_SQL["logit_evaluation"] = f"""
  WITH m AS MATERIALIZED (SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS part, quality, round(p, 9) AS p, CAST(round(p, 9) > 0.5 AS INTEGER) AS pred
    FROM ({_MODEL_P})),
  c AS (SELECT p, count(*) FILTER (WHERE quality = 1) AS pos, count(*) FILTER (WHERE quality <> 1) AS neg FROM m WHERE part = 'test' GROUP BY p),
  r AS (SELECT *, sum(neg) OVER (ORDER BY p) - neg AS below FROM c)
  SELECT part, 'accuracy' AS metric, round(avg((quality = pred)::INTEGER::DOUBLE), 6) AS value FROM m GROUP BY part
  UNION ALL {_CELLS}
  UNION ALL SELECT 'test', 'auc', round(sum(pos * (below + neg * 0.5)) / (sum(pos) * sum(neg)), 6) FROM r"""
