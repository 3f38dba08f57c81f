import pytest
from pyspark.sql import functions as F

from corvid.operators import clean, encode, joins


def test_replace_is_whole_cell_in_all_string_columns(spark):
    df = spark.createDataFrame([("Korea", "Korea Republic", 1), ("IRAN", "x", 2)], "a string, b string, n int")
    out = clean.replace_values(df, {"Korea": "Korea Republic", "IRAN": "Iran"}).orderBy("n").collect()
    assert out[0].a == "Korea Republic" and out[0].b == "Korea Republic"  # no substring replacement
    assert out[1].a == "Iran"


def test_drop_all_missing(spark):
    df = spark.createDataFrame([(None, None), ("A", None), (None, 1)], "t string, g int")
    assert clean.drop_all_missing(df).count() == 2


def test_one_hot_missing_is_all_zero(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id int, c string")
    out = encode.one_hot(df, "c").orderBy("id").collect()
    assert [(r.a, r.b) for r in out] == [(0, 1), (1, 0), (0, 0)]
    assert out[0].__fields__ == ["id", "c", "a", "b"]


def test_poly2_terms_order():
    names = [n for n, _ in encode.poly2_terms(["a", "b", "c"])]
    assert names == ["1", "a", "b", "c", "a*a", "a*b", "a*c", "b*b", "b*c", "c*c"]  # 4 inputs would give 15


def test_merge_suffixes_and_keys(spark):
    m = spark.createDataFrame([(1, "X", "Y")], "d int, home string, away string")
    r = spark.createDataFrame([(1, "X", 10), (1, "Y", 20)], "rd int, team string, rank int")
    a = joins.merge(m, r, ["d", "home"], ["rd", "team"])
    b = joins.merge(a, r, ["d", "away"], ["rd", "team"], suffixes=("_home", "_away"))
    row = b.first()
    assert row.rank_home == 10 and row.rank_away == 20
    assert set(b.columns) >= {"rd_home", "rd_away", "team_home", "team_away"}


def test_member_flag_and_semi(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,)], "t string")
    mem = spark.createDataFrame([("A",), ("A",)], "m string")
    flags = {r.t: r.is_member for r in clean.member_flag(df, "t", mem, "m").collect()}
    assert flags == {"A": True, "B": False, None: False}
    assert clean.keep_members(df, "t", mem, "m").count() == 1


def test_pairs_in_groups(spark):
    df = spark.createDataFrame([(g, t) for g in ("A", "B") for t in range(4)], "g string, t int")
    pairs = joins.pairs_in_groups(df, ["g"], "t", [], max_group_size=4)
    assert pairs.count() == 12
    assert pairs.filter(F.col("t_home") >= F.col("t_away")).count() == 0


def test_neighbour_slot_pairing(spark):
    df = spark.createDataFrame([(s, f"T{s}") for s in range(5)], "slot int, team string")
    out = {r.pair: (r.team_home, r.team_away)
           for r in joins.pair_neighbour_slots(df, [], "slot", ["team"]).collect()}
    assert out == {0: ("T0", "T1"), 1: ("T2", "T3"), 2: ("T4", None)}


def test_first_rows(spark):
    df = spark.range(20).withColumn("k", 19 - F.col("id"))
    assert [r.k for r in clean.first_rows(df, ["k"]).collect()] == [0, 1, 2, 3, 4]


def test_replace_by_table(spark):
    df = spark.createDataFrame([(1, "Germany DR"), (2, "China"), (3, "Spain"), (4, None)], "id int, team string")
    mapping = spark.createDataFrame([("Germany DR", "Germany"), ("China", "China PR")], "old string, new string")
    out = {r.id: r.team for r in clean.replace_by_table(df, "team", mapping).collect()}
    assert out == {1: "Germany", 2: "China PR", 3: "Spain", 4: None}


def test_merge_keeps_keys_of_every_join_type(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(2, "p"), (3, "q"), (None, "m")], "k int, v string")
    rows = lambda how, **kw: sorted(map(tuple, joins.merge(a, b, ["k"], ["k"], how=how, **kw).collect()), key=str)
    assert joins.merge(a, b, ["k"], ["k"]).columns == ["k", "v_x", "v_y"]
    assert rows("inner") == sorted([(2, "y", "p"), (None, "n", "m")], key=str)  # missing keys match, as in pandas
    assert rows("inner", null_safe=False) == [(2, "y", "p")]
    assert rows("outer") == sorted([(1, "x", None), (2, "y", "p"), (3, None, "q"), (None, "n", "m")], key=str)
    assert rows("right") == sorted([(2, "y", "p"), (3, None, "q"), (None, "n", "m")], key=str)
    assert rows("left_anti") == [(1, "x")]


def test_lookup_unknown_and_repeated_keys(spark):
    df = spark.createDataFrame([("A", 1), ("Z", 2), (None, 3)], "t string, i int")
    table = spark.createDataFrame([("A", 10), ("B", 20)], "t string, rank int")
    out = {r.i: r["rank"] for r in joins.lookup(df, "t", table, "t", ["rank"]).collect()}
    assert out == {1: 10, 2: None, 3: None}
    with pytest.raises(Exception, match="unknown key: Z"):
        joins.lookup(df.where("i = 2"), "t", table, "t", ["rank"], unknown="error").collect()
    with pytest.raises(Exception, match="this key twice: A"):
        joins.lookup(df, "t", table.unionByName(table.where("t = 'A'")), "t", ["rank"]).collect()


def test_one_hot_has_no_category_limit(spark):
    df = spark.range(1200).select(F.format_string("c%04d", "id").alias("c"))
    assert len(encode.one_hot(df, "c").columns) == 1201


def test_categories_as_a_table(spark):
    import pytest

    from corvid.operators import encode, metrics
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b"), (5, "c")], "id int, v string")
    assert sorted(tuple(r) for r in encode.category_index(df, "v").collect()) == [("a", 0), ("b", 1), ("c", 2)]
    cells = {tuple(r) for r in encode.one_hot_cells(df, "id", "v").collect()}
    assert cells == {(1, "b", 1, 3), (2, "a", 0, 3), (4, "b", 1, 3), (5, "c", 2, 3)}
    with pytest.raises(ValueError, match="more than 2 categories"):
        encode.one_hot(df, "v", most=2)
    with pytest.raises(ValueError, match="more than 2 categories"):
        metrics.confusion_matrix(df, "v", "v", most=2)
    assert encode.one_hot(df, "v", most=3).columns == ["id", "v", "a", "b", "c"]
