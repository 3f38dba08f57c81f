"""Pairwise scoring inside fixed-size groups, standings, top-n per group,
seeding and knock-out rounds (T1-T6, W4, O1, O3, O4, J6, J10).

Groups are small by construction (``pairs_in_groups`` emits size*(size-1)/2
rows per group), brackets are independent, so everything is grouped by
(bracket, ...) and all brackets run in the same jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.functions import matchup_label, tiered_points
from corvid.session import materialize
from corvid.operators.joins import pair_neighbour_slots, pairs_in_groups

# Seeding order of the 16 qualifiers (positions 2*group + place,
# groups A..H) -- slot i takes position PAIRING[i]; and the round names.
PAIRING = [0, 3, 4, 7, 8, 11, 12, 15, 1, 2, 5, 6, 9, 10, 13, 14]
ROUND_NAMES = ["round_of_16", "quarterfinal", "semifinal", "final"]

ProbFn = Callable[..., Column]  # (home rating(s), away rating(s)) -> P(home wins)


def latest_ratings(df: DataFrame, day_col: str, key_col: str, members: DataFrame | None = None,
                   member_col: str | None = None) -> DataFrame:
    """Rows of the latest day in the whole table (A2 scalar max, joined as
    a one-row broadcast), optionally only for keys in another table (J7)."""
    last = df.agg(F.max(day_col).alias("_last"))
    out = df.join(F.broadcast(last), df[day_col] == last["_last"]).drop("_last")
    if members is not None:
        keys = members.select(F.col(member_col).alias("_m"))
        out = out.join(keys, out[key_col] == keys["_m"], "left_semi")
    return out


def pair_scores(teams: DataFrame, group_cols: Sequence[str], team_col: str, ratings: str | Sequence[str],
                prob: ProbFn, max_group_size: int) -> DataFrame:
    """Every pair in a group (earlier team at home) with P(home wins).  ``prob``
    gets the home and the away rating as columns, or with a list of ``ratings``
    two dictionaries name -> column.  A pair with a missing rating has a NULL
    probability.  Groups may hold ``max_group_size`` teams at the most."""
    names = [ratings] if isinstance(ratings, str) else list(ratings)
    pairs = pairs_in_groups(teams, group_cols, team_col, names, max_group_size)
    home, away = ({c: F.col(f"{c}_{side}") for c in names} for side in ("home", "away"))
    p = prob(home[ratings], away[ratings]) if isinstance(ratings, str) else prob(home, away)
    return pairs.withColumn("p_home", p).select(
        *group_cols, F.col(f"{team_col}_home").alias("home"), F.col(f"{team_col}_away").alias("away"), "p_home")


def standings(teams: DataFrame, scored: DataFrame, group_cols: Sequence[str], team_col: str,
              lo: float = 0.0, hi: float = 0.76) -> DataFrame:
    """Points (F12 tiers) and summed win probability per team over both
    sides of its pairs; teams without a pair keep 0."""
    h_pts, a_pts = tiered_points("p_home", lo, hi)
    sides = scored.select(*group_cols, F.inline(F.array(
        F.struct(F.col("home").alias("team"), h_pts.alias("pts"), F.col("p_home").alias("prob")),
        F.struct(F.col("away").alias("team"), a_pts.alias("pts"), (F.lit(1.0) - F.col("p_home")).alias("prob")))))
    tot = sides.groupBy(*group_cols, "team").agg(F.sum("pts").alias("points"), F.sum("prob").alias("total_prob"))
    t = teams.select(*group_cols, F.col(team_col).alias("team"))
    out = t.join(tot, [*group_cols, "team"], "left")
    return out.select(*group_cols, F.col("team").alias(team_col),
                      F.coalesce("points", F.lit(0)).cast("int").alias("points"),
                      F.coalesce("total_prob", F.lit(0.0)).alias("total_prob"))


def top_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], n: int = 2,
                  rank_col: str = "place") -> DataFrame:
    """First ``n`` rows per group in the given order (WindowGroupLimit)."""
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def seed_slots(table: DataFrame, bracket_cols: Sequence[str], group_index: str, team_col: str,
               pairing: Sequence[int] = PAIRING) -> DataFrame:
    """T4/O3: qualifiers (``place`` 1/2 per group) -> knock-out slots.
    ``group_index`` is 0 for group A, 1 for B, ...; position = 2*group +
    place - 1; slot i takes position ``pairing[i]``.  A missing group leaves
    empty slots (byes); a position that ``pairing`` does not list is an error."""
    q = table.withColumn("_position", (F.col(group_index) * 2 + F.col("place") - 1).cast("int"))
    return reorder_by_list(q, "_position", pairing, "slot").select(*bracket_cols, "slot", team_col)


def reorder_by_list(df: DataFrame, position_col: str, positions: Sequence[int], out_col: str = "slot",
                    unlisted: str = "error") -> DataFrame:
    """O3: the place of each row's position in a list (a map lookup inside the
    scan, no join).  Rows whose position the list does not hold stop the query,
    or with ``unlisted="null"`` stay with NULL."""
    if unlisted not in ("error", "null"):
        raise ValueError("unlisted must be 'error' or 'null'")
    places = F.create_map(*[F.lit(int(x)) for slot, pos in enumerate(positions) for x in (pos, slot)])
    found = F.try_element_at(places, F.col(position_col).cast("int"))
    if unlisted == "error":
        text = F.format_string("reorder_by_list: position %s is not in the list", position_col)
        found = F.when(found.isNull(), F.raise_error(text).cast("int")).otherwise(found)
    return df.withColumn(out_col, found)


def fold_round(slots: DataFrame, bracket_cols: Sequence[str], team_col: str, ratings: DataFrame,
               rating_col: str, prob: ProbFn, cut: float = 0.8) -> DataFrame:
    """T5, one round: slots 2i / 2i+1 meet (J10), home wins when P(home) > cut.
    A slot without an opponent advances (bye); a pair with a missing rating is an
    error, not a win for either side.  Returns one row per pair:
    ``pair`` (= next slot), home, away, p_home, winner."""
    r = ratings.select(F.col(team_col).alias("_t"), F.col(rating_col).alias("_r"))
    s = slots.join(r, slots[team_col] == r["_t"], "left").drop("_t")
    g = pair_neighbour_slots(s, bracket_cols, "slot", [team_col, "_r"])
    g = g.select(*bracket_cols, F.col("pair").cast("int").alias("pair"), F.col(f"{team_col}_home").alias("home"),
                 F.col(f"{team_col}_away").alias("away"), F.col("_r_home").alias("_rh"), F.col("_r_away").alias("_ra"))
    both = F.col("home").isNotNull() & F.col("away").isNotNull()
    g = g.withColumn("p_home", F.when(both, prob(F.col("_rh"), F.col("_ra"))))
    missing = F.raise_error(F.format_string("fold_round: no rating for %s or %s", "home", "away")).cast("double")
    g = g.withColumn("p_home", F.when(both & F.col("p_home").isNull(), missing).otherwise(F.col("p_home")))
    winner = (F.when(F.col("away").isNull(), F.col("home")).when(F.col("home").isNull(), F.col("away"))
               .when(F.col("p_home") <= cut, F.col("away")).otherwise(F.col("home")))
    return g.withColumn("winner", winner).drop("_rh", "_ra")


def fold_rounds(slots: DataFrame, bracket_cols: Sequence[str], team_col: str, ratings: DataFrame,
                rating_col: str, prob: ProbFn, cut: float = 0.8, n_rounds: int | None = None,
                checkpoint_every: int | None = 1) -> DataFrame:
    """T5: repeat rounds until one slot is left (16 -> 8 -> 4 -> 2 -> 1), or
    ``n_rounds`` where given; returns all rounds with ``round`` and ``round_name``.
    The driver asks for the highest slot and builds one plan step per round.  Every round feeds both the next round
    and the output, so by default each round is written once to the shared
    checkpoint folder (``checkpoint_every=1``); otherwise every later round
    would re-run the whole plan before it.  ``None`` keeps one lazy plan."""
    if n_rounds is None:
        top = slots.agg(F.max("slot")).first()[0]
        n_rounds = max(1, int(top).bit_length()) if top is not None else 1
    out = []
    cur = slots
    for i in range(n_rounds):
        res = fold_round(cur, bracket_cols, team_col, ratings, rating_col, prob, cut)
        if checkpoint_every and (i + 1) % checkpoint_every == 0:
            res = materialize(res)
        name = ROUND_NAMES[i] if i < len(ROUND_NAMES) else f"round_{i + 1}"
        out.append(res.withColumn("round", F.lit(i + 1)).withColumn("round_name", F.lit(name)))
        cur = res.select(*bracket_cols, F.col("pair").alias("slot"), F.col("winner").alias(team_col))
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def round_report(rounds: DataFrame, names: DataFrame, team_col: str, name_col: str) -> DataFrame:
    """T6: 'home(odds) vs. away(odds)' label and the probability pair for every
    played match (byes have no report row)."""
    n_h = names.select(F.col(team_col).alias("home"), F.col(name_col).alias("_nh"))
    n_a = names.select(F.col(team_col).alias("away"), F.col(name_col).alias("_na"))
    played = rounds.filter(F.col("p_home").isNotNull())
    j = played.join(n_h, "home", "left").join(n_a, "away", "left")
    return j.withColumns({
        "label": matchup_label("_nh", "p_home", "_na"),
        "p_away": F.lit(1.0) - F.col("p_home"),
    }).drop("_nh", "_na")


