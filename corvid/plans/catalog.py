"""Spark side of every registered query.  Each takes (spark, sf_dir) and
returns a DataFrame whose columns match the SQL oracle of the same name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions import clip, days_between, decimal_odds, false_if_null, half, keep_if, matchup_label, not_equal_null_safe, to_day
from corvid.operators import clean, encode, features, joins, knn, logit, metrics, timeseries as ts, tournament
from corvid.operators.split import exact_split, split_parts
from corvid.session import materialize, shared_folder
from corvid.sources import dense_row_number, read_csv, read_table, write_labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(c) -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6)


# ---------------------------------------------------------------- split / KNN

@register
def exact_split_25(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events", ["event_id"])
    return exact_split(ev, "event_id", 0.25, seed=0)


@register
def exact_split_20(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events", ["event_id"])
    return exact_split(ev, "event_id", 0.2, seed=42)


def _embedding_parts(spark, sf):
    emb = read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    return split_parts(emb, "vec_id", 0.25, seed=0)


EMB = dict(features="embedding", label_col="label", train_id="vec_id")


def _emb_knn(spark, sf, k, metric, **kw):
    parts = _embedding_parts(spark, sf)
    train, test = parts
    return knn.knn_predict(train, test.drop("label"), **EMB, test_id="vec_id", k=k, metric=metric,
                           n_test=parts.n_test, **kw)


@register
def knn_euclidean_k7(spark, sf):
    return _emb_knn(spark, sf, 7, "euclidean")


@register
def knn_manhattan_k7(spark, sf):
    return _emb_knn(spark, sf, 7, "manhattan")


@register
def knn_many_k(spark, sf):
    parts = _embedding_parts(spark, sf)
    train, test = parts
    ks = [3, 5, 7, 17]
    votes = knn.knn_predict_many(train, test.withColumnRenamed("label", "actual"), **EMB, test_id="vec_id", ks=ks,
                                 keep_cols=["actual"], n_test=parts.n_test)
    acc = knn.accuracy(votes, "prediction", "actual", by=["k"])
    return acc.select(F.col("k").cast("int").alias("k"), r6("accuracy").alias("accuracy"))


@register
def knn_accuracy(spark, sf):
    parts = _embedding_parts(spark, sf)
    train, test = parts
    fit = knn.store_training(train, **EMB)  # one fit, two scores
    held = knn.knn_score(fit, test, score_label="label", test_id="vec_id", k=7, n_test=parts.n_test)
    own = knn.knn_score(fit, train, score_label="label", test_id="vec_id", k=7, n_test=parts.n_train)
    return held.withColumn("part", F.lit("held_out")).unionByName(own.withColumn("part", F.lit("training"))).select(
        "part", r6("accuracy").alias("accuracy"))


@register
def knn_own_prediction_score(spark, sf):
    """K7: a fit scored on its own predictions, and a refit on them scored on them."""
    parts = _embedding_parts(spark, sf)
    train, test = parts
    fit = knn.store_training(train, **EMB)
    kw = dict(test_id="vec_id", k=5, n_test=parts.n_test)
    pred = materialize(test.select("vec_id", "embedding").join(knn.knn_predict(fit, test, **kw), "vec_id"))
    same = knn.knn_score(fit, pred, score_label="prediction", **kw)
    refit = knn.store_training(pred, **{**EMB, "label_col": "prediction"})
    after = knn.knn_score(refit, pred, score_label="prediction", **kw)
    return same.withColumn("fit", F.lit("same")).unionByName(after.withColumn("fit", F.lit("refit"))).select(
        "fit", r6("accuracy").alias("accuracy"))


@register
def knn_minkowski_p3(spark, sf):
    return _emb_knn(spark, sf, 5, "minkowski", p=3)


def _part_parts(spark, sf):
    part = read_table(spark, sf, "part", ["p_partkey", "p_size", "p_retailprice", "p_type"])
    return split_parts(part, "p_partkey", 0.25, seed=0)


@register
def knn_confusion(spark, sf):
    """A9 on KNN output: multi-class confusion of the held-out predictions."""
    parts = _embedding_parts(spark, sf)
    train, test = parts
    pred = knn.knn_predict(train, test.withColumnRenamed("label", "actual"), **EMB, test_id="vec_id", k=7,
                           keep_cols=["actual"], n_test=parts.n_test)
    return metrics.confusion_matrix(pred, "actual", "prediction")


@register
def knn_scaled_feature(spark, sf):
    parts = _part_parts(spark, sf)  # one split, both unit scales
    preds = []
    for name, scale in (("pred_raw", 1), ("pred_scaled", 1000)):
        train, test = (d.withColumn("p_retailprice", F.col("p_retailprice") / scale) if scale != 1 else d
                       for d in parts)
        p = knn.knn_predict(train, test.drop("p_type"), features=["p_size", "p_retailprice"],
                            label_col="p_type", train_id="p_partkey", test_id="p_partkey", k=3,
                            n_test=parts.n_test)
        preds.append(p.withColumnRenamed("prediction", name))
    return preds[0].join(preds[1], "p_partkey")


@register
def knn_feature_subset(spark, sf):
    parts = _part_parts(spark, sf)
    train, test = parts
    return knn.knn_predict(train, test.drop("p_type"), features=["p_retailprice"],
                           label_col="p_type", train_id="p_partkey", test_id="p_partkey", k=3,
                           n_test=parts.n_test)


@register
def knn_feature_weights(spark, sf):
    """P18 by weights: a feature counts with its weight."""
    parts = _part_parts(spark, sf)
    train, test = parts
    return knn.knn_predict(train, test.drop("p_type"), features=["p_size", "p_retailprice"], weights=[100.0, 0.25],
                           label_col="p_type", train_id="p_partkey", test_id="p_partkey", k=3, n_test=parts.n_test)


@register
def knn_k_above_n(spark, sf):
    """K5: more neighbours asked for than there are training rows; all of them vote."""
    nation = read_table(spark, sf, "nation", ["n_nationkey", "n_regionkey"])
    supp = read_table(spark, sf, "supplier", ["s_suppkey", "s_nationkey"])
    nation, supp = nation.withColumnRenamed("n_nationkey", "nation"), supp.withColumnRenamed("s_nationkey", "nation")
    return knn.knn_predict(nation, supp, features=["nation"], label_col="n_regionkey", train_id="nation",
                           test_id="s_suppkey", k=1000, allow_fewer=True)


@register
def knn_literal_rows(spark, sf):
    """Rows typed in by hand, labelled from the stored parts; one lacks a feature."""
    part = read_table(spark, sf, "part", ["p_partkey", "p_size", "p_retailprice", "p_type"])
    rows = spark.createDataFrame([(1, 10, 950.0), (2, 33, 1500.5), (3, 49, None)], "row_id int, p_size int, p_retailprice double")
    return knn.knn_predict(part, rows, features=["p_size", "p_retailprice"], label_col="p_type", train_id="p_partkey",
                           test_id="row_id", k=5)


@register
def knn_pseudo_refit(spark, sf):
    parts = _embedding_parts(spark, sf)
    train, test = parts
    return knn.pseudo_label_refit(train, test.drop("label"), **EMB, test_id="vec_id", k=5, n_test=parts.n_test)


def _labelled_doc_features(spark, sf):
    """(doc_id, n_chars, n_spaces, quality) of the labelled documents, written once: the split, the
    fit and the test side all read these narrow columns, the texts are read once."""
    docs = _space_counts(spark, sf, ["n_chars"])
    labels = read_table(spark, sf, "labels", ["doc_id", "quality"])
    return _written(docs.join(labels, "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), "n_spaces", "quality"))


def _written(df):
    """``df`` as a table in the shared folder."""
    path = shared_folder(df.sparkSession, "features")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _space_counts(spark, sf, columns):
    """Documents with their number of blanks instead of the text: counted where the
    text is read, so it never enters a shuffle.  (The projection is kept below the
    join by a filter that reads it: without one Spark may move the count above.)"""
    docs = read_table(spark, sf, "documents", ["doc_id", "text", *columns])
    spaces = (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("double")
    return docs.select("doc_id", *columns, spaces.alias("n_spaces")).where("n_spaces is null or n_spaces >= 0")


@register
def knn_label_file_accuracy(spark, sf):
    labels = read_table(spark, sf, "labels", ["doc_id", "quality"])
    parts = split_parts(_labelled_doc_features(spark, sf), "doc_id", 0.25, seed=0)
    train, test = parts
    pred = knn.knn_predict(train, test.drop("quality"), features=["n_chars", "n_spaces"],
                           label_col="quality", train_id="doc_id", test_id="doc_id", k=5,
                           n_test=parts.n_test)
    scored = pred.join(labels, "doc_id")  # K9: compare with the label file by key
    return scored.agg(F.count(F.lit(1)).alias("n_test"),
                      F.count_if(~F.col("prediction").eqNullSafe(F.col("quality"))).alias("n_wrong"),
                      r6(F.avg(F.col("prediction").eqNullSafe(F.col("quality")).cast("double"))).alias("accuracy"))


# ------------------------------------------------------------ cleaning, joins


# Segment renames used by the cleaning query.
SEGMENT_RENAMES = {"HOUSEHOLD": "HOME", "AUTOMOBILE": "AUTO"}


@register
def left_join_missing(spark, sf):
    """P5 and P10 on columns that a left join leaves missing: the orders of the
    customers that have any; a missing priority is not equal to a given one."""
    cust = read_table(spark, sf, "customer", ["c_custkey", "c_acctbal"])
    orders = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]).where("o_totalprice > 150000")
    j = joins.merge(cust, orders, ["c_custkey"], ["o_custkey"], how="left")
    kept = clean.drop_all_missing(j.select("o_orderkey", "o_custkey", "o_totalprice")).agg(F.count(F.lit(1)).alias("n")).scalar()
    return j.select("c_custkey", "o_orderkey", not_equal_null_safe("o_orderpriority", "1-URGENT").alias("not_urgent"),
                    false_if_null(F.col("o_totalprice") > 200000).alias("large"), kept.alias("n_orders"))


@register
def merge_suffixes(spark, sf):
    """An outer join on differently named keys; ``text`` is on both sides."""
    docs = read_table(spark, sf, "documents", ["doc_id", "text", "lang"])
    items = read_table(spark, sf, "benchmark", ["item_id", "text"])
    j = joins.merge(docs, items, ["doc_id"], ["item_id"], how="outer", suffixes=("_doc", "_item"))
    return j.select("doc_id", "item_id", "lang", F.length("text_doc").alias("doc_chars"), F.length("text_item").alias("item_chars"))


@register
def lookup_unknown(spark, sf):
    """Regions of the nations, by a table that lacks one of them."""
    nation = read_table(spark, sf, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = read_table(spark, sf, "region", ["r_regionkey", "r_name"]).where("r_name <> 'ASIA'")
    return joins.lookup(nation, "n_regionkey", region, "r_regionkey", ["r_name"])


def _europe_nations(spark, sf):
    nation = read_table(spark, sf, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = read_table(spark, sf, "region", ["r_regionkey", "r_name"]).filter(F.col("r_name") == "EUROPE")
    return clean.keep_members(nation, "n_regionkey", region, "r_regionkey")


@register
def clean_replace_project(spark, sf):
    cust = read_table(spark, sf, "customer", ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"])
    out = clean.replace_values(cust, SEGMENT_RENAMES)
    out = clean.replace_values(out, {"": "Other"}, subset=["c_mktsegment"])
    return clean.drop_all_missing(out)


@register
def derived_features(spark, sf):
    orders = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
                                              "o_orderpriority"])
    cust = read_table(spark, sf, "customer", ["c_custkey", "c_acctbal"])
    j = orders.join(cust, orders.o_custkey == cust.c_custkey)
    return j.select(
        "o_orderkey",
        F.to_date("o_orderdate").alias("order_day"),
        r6(F.col("o_totalprice") / 1000).alias("total_k"),
        r6(F.col("o_totalprice") - F.col("c_acctbal")).alias("balance_gap"),
        r6((F.col("o_totalprice") + F.col("c_acctbal")) / 2).alias("mean_amount"),
        false_if_null(F.col("c_acctbal") > 0).alias("in_credit"),
        not_equal_null_safe("o_orderpriority", "1-URGENT").alias("not_urgent"),
        r6(F.coalesce(clip("c_acctbal", 0, 5000), F.lit(0.0))).alias("acctbal_clipped"),
    )


@register
def filter_membership(spark, sf):
    cust = read_table(spark, sf, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    picked = cust.filter(F.col("c_mktsegment") == "BUILDING").filter("c_acctbal > 0")
    picked = clean.keep_members(picked, "c_nationkey", _europe_nations(spark, sf), "n_nationkey")
    return picked.select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


@register
def membership_flag_onehot(spark, sf):
    orders = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    cust = read_table(spark, sf, "customer", ["c_custkey", "c_nationkey"])
    nation = read_table(spark, sf, "nation", ["n_nationkey", "n_name"])
    o = orders.join(cust, orders.o_custkey == cust.c_custkey)
    o = joins.lookup(o, "c_nationkey", nation, "n_nationkey", ["n_name"])
    europe = _europe_nations(spark, sf)
    o = clean.member_flag(o, "n_name", europe, "n_name", "in_europe")
    o = o.withColumn("participant", keep_if("in_europe", "n_name", ""))
    o = clean.replace_values(o, {"": "Other"}, subset=["participant"])
    return encode.one_hot(o.select("o_orderkey", "participant"), "participant")


def _event_days(spark, sf):
    ev = read_table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return ev.withColumn("day", F.to_date("ts"))


def _daily_first(spark, sf):
    ev = _event_days(spark, sf).select(
        "event_id", "user_id", "day",
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("purchase_value"),
        F.when(F.col("event_type") == "error", F.col("value")).alias("error_value"))
    return ts.daily_first(ev, ["user_id"], "day", "event_id", ["purchase_value", "error_value"])


VALUES = ["purchase_value", "error_value"]


def _filled_daily(spark, sf):
    return ts.daily_filled(_daily_first(spark, sf), ["user_id"], "day", VALUES)


@register
def daily_first(spark, sf):
    d = _daily_first(spark, sf)
    return d.select("user_id", "day", r6("purchase_value").alias("purchase_value"),
                    r6("error_value").alias("error_value"))


@register
def daily_grid_ffill(spark, sf):
    d = _filled_daily(spark, sf)
    return d.select("user_id", "day", r6("purchase_value").alias("purchase_value"),
                    r6("error_value").alias("error_value"))


@register
def segmented_ffill(spark, sf):
    """W1, W2 as separate steps: a stored grid, filled month by month."""
    grid = materialize(ts.daily_grid(_daily_first(spark, sf), ["user_id"], "day"))  # read by the fill and its summary
    d = ts.ffill(grid, ["user_id"], ["day"], VALUES, segment=F.date_trunc("month", "day"))
    return d.select("user_id", "day", r6("purchase_value").alias("purchase_value"), r6("error_value").alias("error_value"))


@register
def ffill_across_keys(spark, sf):
    daily = _daily_first(spark, sf)
    filled = ts.daily_filled(daily, ["user_id"], "day", VALUES)
    d = ts.ffill_across_keys(filled, "user_id", ["day"], VALUES, observed=daily)
    return d.select("user_id", "day", r6("purchase_value").alias("purchase_value"),
                    r6("error_value").alias("error_value"))


def _typed_series(spark, sf, event_type, suffix=""):
    """Daily first value (and first value above 50) of one event type per user."""
    ev = _event_days(spark, sf).filter(F.col("event_type") == event_type)
    ev = ev.select("event_id", "user_id", "day", F.col("value").alias("first_value"),
                   F.when(F.col("value") > 50, F.col("value")).alias("big_value"))
    d = ts.daily_first(ev, ["user_id"], "day", "event_id", ["first_value", "big_value"])
    return d.select(F.col("user_id").alias("s_user"), F.col("day").alias("s_day"),
                    *[F.col(c).alias(c + suffix) for c in ("first_value", "big_value")])


def _clicks(spark, sf):
    return _event_days(spark, sf).filter(F.col("event_type") == "click").select("event_id", "user_id", "day")


@register
def asof_bounded(spark, sf):
    out = ts.asof_join(_clicks(spark, sf), _typed_series(spark, sf, "error"), "user_id", "s_user", "day",
                       "s_day", ["first_value", "big_value"])
    return out.select("event_id", "user_id", "day", r6("first_value").alias("first_value"),
                      r6("big_value").alias("big_value"))


@register
def asof_two_sided(spark, sf):
    rights = [(_typed_series(spark, sf, "error", "_err"), "s_user", "s_day", ["first_value_err", "big_value_err"]),
              (_typed_series(spark, sf, "purchase", "_pur"), "s_user", "s_day", ["first_value_pur", "big_value_pur"])]
    b = ts.asof_join_many(_clicks(spark, sf), "user_id", "day", rights)
    return b.select("event_id", "user_id", "day",
                    r6("first_value_err").alias("first_value_err"), r6("first_value_pur").alias("first_value_pur"),
                    r6(F.col("first_value_err") - F.col("first_value_pur")).alias("value_gap"),
                    r6((F.col("first_value_err") + F.col("first_value_pur")) / 2).alias("value_mean"))


@register
def two_key_join(spark, sf):
    right = _typed_series(spark, sf, "purchase").select("s_user", "s_day", "first_value")
    out = joins.merge(_clicks(spark, sf), right, ["day", "user_id"], ["s_day", "s_user"])
    return out.select("event_id", "user_id", "day", "s_user", "s_day", r6("first_value").alias("first_value"))


@register
def rest_days_clipped(spark, sf):
    orders = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    o = orders.withColumn("order_day", F.to_date("o_orderdate")).drop("o_orderdate")
    out = ts.gap_days(o, ["o_custkey"], "order_day", ["order_day", "o_orderkey"], 0, 30, 30)
    return out.select("o_orderkey", "o_custkey", "order_day", "rest_days")


@register
def rest_days_by_price(spark, sf):
    """W3 in an order that is not the date's: days from the order before in the customer's order of prices."""
    orders = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    o = orders.withColumn("order_day", F.to_date("o_orderdate")).drop("o_orderdate")
    out = ts.gap_days(o, ["o_custkey"], "order_day", ["o_totalprice", "o_orderkey"], -100, 100, 30)
    return out.select("o_orderkey", "o_custkey", "order_day", "rest_days")


@register
def segmentless_ffill(spark, sf):
    """W2 by the ordered scan, forwards and backwards, with the event type as the only key: a few keys hold all rows."""
    ev = read_table(spark, sf, "events", ["event_id", "event_type", "user_id", "value"]).withColumn(
        "seen", F.when(F.col("event_id") % 7 == 0, F.col("value")))
    out = ts.ffill(ev, ["event_type"], ["event_id"], ["seen"], out_cols={"seen": "last_seen"})
    out = ts.ffill(out, ["event_type"], ["event_id"], ["seen"], ascending=False, out_cols={"seen": "next_seen"})
    return out.select("event_id", "event_type", r6("last_seen").alias("last_seen"), r6("next_seen").alias("next_seen"))


@register
def onehot_cells(spark, sf):
    """P15 without a column per category: the cells of the indicator matrix of all part types."""
    part = read_table(spark, sf, "part", ["p_partkey", "p_type"])
    cells = encode.one_hot_cells(part, "p_partkey", "p_type")
    return cells.select("p_partkey", "category", F.col("index").cast("int").alias("index"), F.col("size").cast("int").alias("size"))


@register
def latest_per_key(spark, sf):
    signups = _event_days(spark, sf).filter(F.col("event_type") == "signup").select("user_id")
    last = ts.latest_filled(_daily_first(spark, sf), ["user_id"], "day", VALUES)
    latest = tournament.latest_ratings(last, "day", "user_id", signups, "user_id")
    return latest.select("user_id", "day", r6("purchase_value").alias("purchase_value"),
                         r6("error_value").alias("error_value"))


@register
def match_feature_table(spark, sf):
    """The match feature table: clicks as matches between 40 groups of users, rated by
    the values of errors; purchases name the participants."""
    ev = _event_days(spark, sf)
    team = lambda shift: F.format_string("T%02d", (F.col("user_id") * 7 + shift) % 40)
    matches = ev.where("event_type = 'click'").select(
        F.col("event_id").alias("match_id"), F.col("day").alias("date"), team(0).alias("home_team"), team(F.col("event_id") % 11 + 1).alias("away_team"),
        F.floor("value").alias("home_score"), F.when(F.col("event_id") % 9 != 0, F.floor(100 - F.col("value"))).alias("away_score"),
        F.when(F.col("event_id") % 5 == 0, "Friendly").when(F.col("event_id") % 5 != 1, "Cup").alias("tournament"))
    ratings = ev.where("event_type = 'error'").select(
        F.col("event_id").alias("rating_row"), team(0).alias("country_full"), F.col("day").alias("rank_date"),
        F.when(F.col("event_id") % 4 != 0, F.floor("value")).alias("rank"), F.when(F.col("event_id") % 3 != 0, F.col("value") * 10).alias("weighted_points"))
    teams = spark.createDataFrame([("T03",), ("T17",)], "team string")
    out = features.match_features(matches, ratings, participants=teams, categories=["T03", "T17", "Other"])
    return out.select("match_id", "home_team", "away_team", "rank_difference", r6("average_rank").alias("average_rank"),
                      r6("point_difference").alias("point_difference"), "score_difference", "is_won", "is_stake", "rest_days",
                      "wc_participant", "T03", "T17", "Other")


@register
def first_rows(spark, sf):
    orders = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"])
    return clean.first_rows(orders, ["o_orderkey"], 5)


# ------------------------------------------------------------------ metrics


def _scored_docs(spark, sf):
    docs = read_table(spark, sf, "documents", ["doc_id", "n_chars", "lang"])
    labels = read_table(spark, sf, "labels", ["doc_id", "quality"])
    return docs.join(labels, "doc_id")


@register
def confusion(spark, sf):
    d = _scored_docs(spark, sf).withColumn("predicted", (F.col("n_chars") >= 2000).cast("int"))
    return metrics.confusion_matrix(d, "quality", "predicted", labels=[0, 1])


@register
def confusion_with_missing(spark, sf):
    """A9 with missing labels, missing predictions and predictions that no label names."""
    d = read_table(spark, sf, "documents", ["doc_id", "n_chars"]).join(read_table(spark, sf, "labels", ["doc_id", "quality"]), "doc_id", "left")
    d = d.withColumn("predicted", F.when(F.col("doc_id") % 7 != 0, F.when(F.col("n_chars") > 5000, 2).when(F.col("n_chars") >= 2000, 1).otherwise(0)))
    return metrics.confusion_matrix(d, "quality", "predicted", labels=[0, 1])


@register
def confusion_table(spark, sf):
    """A9 in long form: every (actual, predicted) pair with its count."""
    d = _scored_docs(spark, sf).withColumn("predicted", F.least(F.floor(F.col("n_chars") / 1000), F.lit(5)).cast("int"))
    return metrics.confusion_cells(d, "quality", "predicted")


@register
def roc_points(spark, sf):
    out = metrics.roc_points(_scored_docs(spark, sf), "quality", "n_chars")
    return out.select("threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@register
def roc_points_pruned(spark, sf):
    out = metrics.roc_points(_scored_docs(spark, sf), "quality", "n_chars", drop_intermediate=True)
    return out.select("threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@register
def auc(spark, sf):
    return metrics.auc(_scored_docs(spark, sf), "quality", "n_chars").select(r6("auc").alias("auc"))


@register
def value_shares(spark, sf):
    d = _scored_docs(spark, sf).filter(F.col("quality") == 0)
    return metrics.value_shares(d, "lang").select("lang", "n", r6("share").alias("share"))


@register
def value_shares_by(spark, sf):
    """A4 within groups: languages of the good and of the bad documents."""
    out = metrics.value_shares(_scored_docs(spark, sf), "lang", by=["quality"])
    return out.select("quality", "lang", "n", r6("share").alias("share"))


@register
def kde_grid(spark, sf):
    orders = read_table(spark, sf, "orders", ["o_totalprice"])
    k = metrics.kde_grid(orders.select((F.col("o_totalprice") / 1000).alias("total_k")), "total_k")
    return k.select("j", r6("x").alias("x"), F.round("density", 9).alias("density"))


# ------------------------------------------------------------- logistic model

# A given degree-2 model over (n_chars_k, n_spaces_k, is_en).
FIXED_INTERCEPT = 0.9
FIXED_COEFS = [0.02, 0.01, 0.15, -0.001, 0.0005, 0.01, -0.0002, 0.001, 0.05]
DOC_MODEL_FEATURES = ["n_chars_k", "n_spaces_k", "is_en"]


def _doc_model_table(spark, sf):
    docs = _space_counts(spark, sf, ["n_chars", "lang"])
    labels = read_table(spark, sf, "labels", ["doc_id", "quality"])
    return _written(docs.join(labels, "doc_id").select(
        "doc_id", (F.col("n_chars") / 1000).alias("n_chars_k"), (F.col("n_spaces") / 1000).alias("n_spaces_k"),
        (F.col("lang") == "en").cast("double").alias("is_en"), "quality"))


@register
def logit_fit_predict(spark, sf):
    train, test = split_parts(_doc_model_table(spark, sf), "doc_id", 0.2, seed=42)
    fit = logit.certified_fit(train, DOC_MODEL_FEATURES, "quality", C=1e-5)
    pred = test.withColumn("p_quality", fit.probability(DOC_MODEL_FEATURES))
    return pred.select("doc_id", r6("p_quality").alias("p_quality"), (F.col("p_quality") > 0.5).cast("int").alias("prediction"))


@register
def logit_fit_gradient(spark, sf):
    """L3/L4 checked: at the fitted coefficients the penalised gradient of every term is 0
    up to the optimiser's tolerance, measured by a plain aggregate over the training rows."""
    train, _ = split_parts(_doc_model_table(spark, sf), "doc_id", 0.2, seed=42)
    model = logit.fit_poly_logit(train, DOC_MODEL_FEATURES, "quality", C=1e-5, max_iter=1000, tol=1e-12)
    b0, w = logit.conventional_coefficients(model, len(DOC_MODEL_FEATURES))
    grad = logit.penalised_gradient(train, DOC_MODEL_FEATURES, "quality", b0, w, C=1e-5)
    rows = train.agg(F.count(F.lit(1))).scalar()
    return grad.select("term", (F.abs("gradient") <= 1e-3 * rows).alias("at_optimum"))


@register
def logit_score_fixed(spark, sf):
    d = _doc_model_table(spark, sf)
    p = logit.logistic_score(DOC_MODEL_FEATURES, FIXED_INTERCEPT, FIXED_COEFS, degree=2)
    d = d.withColumn("p_quality", p)
    return d.select("doc_id", r6("p_quality").alias("p_quality"),
                    (F.col("p_quality") > 0.5).cast("int").alias("prediction"))


@register
def error_slices(spark, sf):
    parts = _embedding_parts(spark, sf)
    train, test = parts
    pred = knn.knn_predict(train, test.drop("label"), **EMB, test_id="vec_id", k=7, n_test=parts.n_test)
    scored = materialize(pred.join(test.select("vec_id", "label"), "vec_id"))  # used twice
    wrong = clean.misclassified(scored, "prediction", "label")
    a = metrics.value_shares(wrong, "label").withColumn("slice", F.lit("wrong"))
    b = metrics.value_shares(scored, "label").withColumn("slice", F.lit("all"))
    return a.unionByName(b).select("slice", "label", "n", r6("share").alias("share"))


# ------------------------------------------------------------------ tournament

# The pair model -- P(home) = sigmoid(-0.1 + 1.0 * diff/1000
# + 0.05 * mean/1000 + 0.1 * is_stake), is_stake fixed to 1.
PAIR_INTERCEPT = -0.1
PAIR_COEFS = [1.0, 0.05, 0.1]


def pair_probability(r_home, r_away):
    feats = [(r_home - r_away) / 1000, (r_home + r_away) / 2000, F.lit(1.0)]
    return logit.logistic_score(feats, PAIR_INTERCEPT, PAIR_COEFS, degree=1)


def _teams(spark, sf):
    cust = read_table(spark, sf, "customer", ["c_custkey", "c_name", "c_acctbal"])
    return cust.select("c_custkey", "c_name", "c_acctbal",
                       F.floor(F.col("c_custkey") / 32).alias("bracket"),
                       (F.floor(F.col("c_custkey") / 4) % 8).cast("int").alias("grp"))


def _standings(spark, sf):
    teams = _teams(spark, sf)
    scored = tournament.pair_scores(teams, ["bracket", "grp"], "c_custkey", "c_acctbal", pair_probability, max_group_size=4)
    return teams, scored, tournament.standings(teams, scored, ["bracket", "grp"], "c_custkey")


def _top2(spark, sf):
    teams, _, st = _standings(spark, sf)
    # the sum's last digits depend on the order of addition: rank by the rounded sum
    order = [F.col("points").desc(), F.round("total_prob", 9).desc(), F.col("c_custkey")]
    return teams, tournament.top_per_group(st, ["bracket", "grp"], order, 2)


@register
def pair_scores(spark, sf):
    _, scored, _ = _standings(spark, sf)
    return scored.select("bracket", "grp", "home", "away", r6("p_home").alias("p_home"))


# A given degree-2 model over (rank difference, mean rank, point difference, stake).
TWO_RATING_INTERCEPT = 0.05
TWO_RATING_COEFS = [0.4, 0.01, -0.3, 0.1, 0.02, -0.005, 0.03, 0.01, 0.001, 0.02, -0.01, 0.05, -0.02, 0.015]


def two_rating_probability(home, away):
    """The pair model over two ratings a side and a fixed flag, all degree-2 terms."""
    feats = [home["points_k"] - away["points_k"], (home["points_k"] + away["points_k"]) / 2, (home["place"] - away["place"]) / 10, F.lit(1.0)]
    return logit.logistic_score(feats, TWO_RATING_INTERCEPT, TWO_RATING_COEFS, degree=2)


@register
def pair_scores_two_ratings(spark, sf):
    """T2 with the real model's shape: two ratings a side and a fixed flag."""
    cust = read_table(spark, sf, "customer", ["c_custkey", "c_acctbal", "c_nationkey"])
    teams = cust.select("c_custkey", F.floor(F.col("c_custkey") / 4).alias("grp"), (F.col("c_acctbal") / 1000).alias("points_k"),
                        F.col("c_nationkey").cast("double").alias("place"))
    scored = tournament.pair_scores(teams, ["grp"], "c_custkey", ["points_k", "place"], two_rating_probability, max_group_size=4)
    return scored.select("grp", "home", "away", r6("p_home").alias("p_home"))


@register
def reorder_by_list(spark, sf):
    """O3: nations in the order of a given list of positions; two are not listed."""
    nation = read_table(spark, sf, "nation", ["n_nationkey", "n_name"])
    order = [x for x in range(24, -1, -1) if x not in (3, 11)]
    return tournament.reorder_by_list(nation, "n_nationkey", order, unlisted="null")


@register
def neighbour_slots(spark, sf):
    """Suppliers in neighbouring slots side by side."""
    supp = read_table(spark, sf, "supplier", ["s_suppkey", "s_name"])
    return joins.pair_neighbour_slots(supp, [], "s_suppkey", ["s_name"], suffixes=("_even", "_odd"))


@register
def matchup_labels(spark, sf):
    """Every scored pair as text with its odds."""
    _, scored, _ = _standings(spark, sf)
    names = read_table(spark, sf, "customer", ["c_custkey", "c_name"])
    named = joins.lookup(joins.lookup(scored, "home", names, "c_custkey", ["c_name"], "_h", unknown="error"),
                         "away", names, "c_custkey", ["c_name"], "_a", unknown="error")
    return named.select("bracket", "home", "away", matchup_label("c_name_h", "p_home", "c_name_a").alias("label"),
                        F.round(decimal_odds("p_home"), 4).alias("odds"))


@register
def standings(spark, sf):
    _, _, st = _standings(spark, sf)
    return st.select("bracket", "grp", "c_custkey", "points", r6("total_prob").alias("total_prob"))


@register
def top2_per_group(spark, sf):
    _, top = _top2(spark, sf)
    return top.select("bracket", "grp", "c_custkey", "place", "points", r6("total_prob").alias("total_prob"))


def _seeded(spark, sf):
    teams, top = _top2(spark, sf)
    return teams, tournament.seed_slots(top, ["bracket"], "grp", "c_custkey")


@register
def seeded_slots(spark, sf):
    _, seeded = _seeded(spark, sf)
    return seeded


def _rounds(spark, sf):
    teams, seeded = _seeded(spark, sf)
    rounds = tournament.fold_rounds(seeded, ["bracket"], "c_custkey", teams, "c_acctbal", pair_probability,
                                    cut=0.8)
    return teams, rounds


@register
def fold_rounds(spark, sf):
    _, rounds = _rounds(spark, sf)
    return rounds.select("bracket", "round", "round_name", "pair", "home", "away", r6("p_home").alias("p_home"),
                         "winner")


@register
def round_report(spark, sf):
    teams, rounds = _rounds(spark, sf)
    rep = tournament.round_report(rounds, teams, "c_custkey", "c_name")
    return rep.select("bracket", "round", "pair", "label", r6("p_home").alias("p_home"), r6("p_away").alias("p_away"))


@register
def error_slice_density(spark, sf):
    """Density of a feature over the misclassified rows against all rows
    (KNN on documents predicting the quality label)."""
    parts = split_parts(_labelled_doc_features(spark, sf), "doc_id", 0.25, seed=0)
    train, test = parts
    pred = knn.knn_predict(train, test.drop("quality"), features=["n_chars", "n_spaces"],
                           label_col="quality", train_id="doc_id", test_id="doc_id", k=5, n_test=parts.n_test)
    scored = materialize(pred.join(test.select("doc_id", "quality", (F.col("n_chars") / 1000).alias("n_chars_k")),
                                   "doc_id"))  # read by two densities (stats + grid each)
    wrong = clean.misclassified(scored, "prediction", "quality")
    out = None
    for name, d in (("wrong", wrong), ("all", scored)):
        k = metrics.kde_grid(d.select("n_chars_k"), "n_chars_k", points=200).withColumn("slice", F.lit(name))
        out = k if out is None else out.unionByName(k)
    return out.select("slice", "j", r6("x").alias("x"), F.round("density", 9).alias("density"))


def _fixed_scores(spark, sf):
    d = _doc_model_table(spark, sf)
    p = logit.logistic_score(DOC_MODEL_FEATURES, FIXED_INTERCEPT, FIXED_COEFS, degree=2)
    return d.withColumn("p_quality", p).withColumn("prediction", (F.col("p_quality") > 0.5).cast("int"))


@register
def logit_fixed_auc(spark, sf):
    """A11 on model output: AUC of the fixed model's probabilities."""
    return metrics.auc(_fixed_scores(spark, sf), "quality", "p_quality").select(r6("auc").alias("auc"))


@register
def logit_fixed_confusion(spark, sf):
    """A9 on model output: confusion of the fixed model's hard predictions."""
    return metrics.confusion_matrix(_fixed_scores(spark, sf), "quality", "prediction", labels=[0, 1])


@register
def logit_evaluation(spark, sf):
    """The reference's evaluation of the fitted model: test AUC, and accuracy
    and confusion cells on the test and the training part.  Probabilities are
    rounded to 9 places, which the fit's certificate leaves in no doubt."""
    train, test = split_parts(_doc_model_table(spark, sf), "doc_id", 0.2, seed=42)
    fit = logit.certified_fit(train, DOC_MODEL_FEATURES, "quality", C=1e-5)
    out = None
    for part, d in (("test", test), ("train", train)):
        p = fit.probability(DOC_MODEL_FEATURES, within=1e-9)
        pred = materialize(d.select("quality", F.round(p, 9).alias("p"))).withColumn("prediction", (F.col("p") > 0.5).cast("int"))
        # accuracy and the four cells come from one aggregate of the part
        cells = [(a, p) for a in (0, 1) for p in (0, 1)]
        hit = F.col("prediction").eqNullSafe(F.col("quality")).cast("double")
        sums = pred.agg(F.avg(hit).alias("acc"), *[F.count_if((F.col("quality") == a) & (F.col("prediction") == p)).alias(f"c{a}{p}") for a, p in cells])
        rows = F.array(F.struct(F.lit("accuracy").alias("metric"), r6("acc").alias("value")),
                       *[F.struct(F.lit(f"actual_{a}_pred_{p}").alias("metric"), F.col(f"c{a}{p}").cast("double").alias("value")) for a, p in cells])
        res = sums.select(F.lit(part).alias("part"), F.inline(rows))
        if part == "test":
            res = res.unionByName(metrics.auc(pred, "quality", "p").select(
                F.lit(part).alias("part"), F.lit("auc").alias("metric"), r6("auc").alias("value")))
        out = res if out is None else out.unionByName(res)
    return out


# ------------------------------------------------------------------------ CSV


def _csv_copy(df: DataFrame, name: str) -> str:
    """Write a table as header CSV with the token ``NA`` for missing values."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("header", True).option("nullValue", "NA").option("escape", '"').csv(path)
    return path


@register
def csv_typed_roundtrip(spark, sf):
    """A table written as CSV and read back with types found after the missing tokens."""
    cust = read_table(spark, sf, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    cust = cust.withColumn("c_credit", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))  # some NA
    back = read_csv(spark, _csv_copy(cust, "csv"))
    kinds = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in back.schema.fields)
    return back.select("c_custkey", "c_name", "c_nationkey", r6("c_acctbal").alias("c_acctbal"), "c_mktsegment",
                       r6("c_credit").alias("c_credit"), F.lit(kinds).alias("kinds"))


@register
def csv_newline_header(spark, sf):
    """Column names with line breaks, which are read as blanks."""
    nation = read_table(spark, sf, "nation", ["n_nationkey", "n_name"]).toDF("nation\nkey", "full \n name")
    back = read_csv(spark, _csv_copy(nation, "csv"), multiline=True)
    return back.select(F.col("nation key").alias("nation_key"), F.col("full name").alias("full_name"))


@register
def csv_dates(spark, sf):
    """Days from text; what is no day is missing where that is allowed."""
    orders = read_table(spark, sf, "orders", ["o_orderkey", "o_orderdate", "o_orderpriority"])
    text = orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("other"))
    back = read_csv(spark, _csv_copy(text, "csv"), schema="o_orderkey long, day string, other string")
    return back.select("o_orderkey", to_day("day").alias("day"), to_day("other", tolerant=True).alias("no_day"),
                       days_between(to_day("day"), F.lit("1992-01-01").cast("date")).alias("days"))


@register
def csv_label_sink(spark, sf):
    """Labels written with a dense row number and read back."""
    part = dense_row_number(read_table(spark, sf, "part", ["p_partkey", "p_type"]).repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey"))
    path = shared_folder(spark, "labels")
    write_labels(part, path, "row_id", "p_type")
    back = read_csv(spark, path, schema="row_id long, label string")
    return back.select("row_id", half("row_id").alias("half"), "label")
