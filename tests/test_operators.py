"""Edge rules of the operators on small hand-built frames."""

from __future__ import annotations

import itertools
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import scoring as S
from tidemark.operators import adjustments as A
from tidemark.operators import consensus as K
from tidemark.operators import decisions as W
from tidemark.operators import evaluation as E
from tidemark.operators import identity as I
from tidemark.operators import models as M
from tidemark.operators import relational as R
from tidemark.operators import simulation as Z
from tidemark.operators import timeseries as TS
from tidemark.operators import valuation as V
from tidemark.sources import documents as D
from tidemark.sources import readers
from tidemark.streaming import stateful


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_null_rules(spark):
    null = F.lit(None).cast("double")
    assert one(spark, C.ratio(F.lit(1), F.lit(0)), C.clip(null, 0.0, 1.0), C.clip(F.lit(5.0), 0.0, 1.0)) == (None, None, 1.0)
    assert one(spark, C.minutes_seconds(F.lit("3:07")), C.minutes_seconds(F.lit("x"))) == (187, None)
    assert one(spark, C.listed_sum(F.lit("20; 35;;x")), C.listed_count(F.lit("20;35;50"), 30, 50)) == (55.0, 2)


def test_trimmed_mean(spark):
    assert one(spark, C.trimmed_mean(F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0, 100.0]))))[0] == 3.0
    assert one(spark, C.trimmed_mean(F.array(F.lit(1.0), F.lit(9.0))))[0] == 5.0


def test_normal_cdf(spark):
    import math

    for z in (-3.0, -0.5, 0.0, 1.0, 2.5):
        assert one(spark, C.normal_cdf(F.lit(z)))[0] == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))), abs=1e-6)


def test_name_key(spark):
    names = {"José Núñez Jr.": "jose nunez", "D'Andre O-Neil III": "dandre o neil", "Mike Smith": "michael smith"}
    for name, key in names.items():
        assert one(spark, C.name_key(F.lit(name), {"mike": "michael"}))[0] == key


def test_local_time_that_does_not_exist_or_exists_twice(spark):
    zone = "America/New_York"
    got = one(spark, *(C.local_to_utc(F.lit(t), zone).cast("string") for t in ("2024-07-01 13:00", "2024-03-10 02:30", "2024-11-03 01:30", "nothing")))
    assert got == ("2024-07-01 17:00:00", None, None, None)


def test_ewm_against_the_definition(spark):
    rows = [("a", k, float(k * k % 7) if k != 3 else None) for k in range(8)] + [("b", 0, 5.0)]
    df = spark.createDataFrame(rows, "e string, t int, x double")
    got = {(r.e, r.t): r.m for r in TS.with_ewm(df, {"m": ("x", 3)}, ["e"], ["t"]).collect()}
    for e, t, x in rows:
        past = [(tt, xx) for ee, tt, xx in rows if ee == e and tt <= t and xx is not None]
        want = sum(xx * 0.5 ** (t - tt) for tt, xx in past) / sum(0.5 ** (t - tt) for tt, _ in past)
        assert got[e, t] == (None if x is None else pytest.approx(want))


def test_lag_by_rows_is_not_lag_by_periods(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 3, 30.0), ("a", 4, 40.0)], "e string, week int, x double")
    shifted = TS.lag_shift_join(df.select("e", "week"), df, ["e"], "week", ["x"])
    assert {r.week: r.x for r in shifted.collect()} == {1: None, 3: None, 4: 30.0}
    assert {r.week: r.m for r in df.withColumn("m", TS.expanding_mean("x", ["e"], ["week"])).collect()} == {1: None, 3: 10.0, 4: 20.0}


@pytest.mark.parametrize("strict", [True, False])
def test_asof_against_brute_force(spark, strict):
    rng = random.Random(1)
    left = [(rng.choice(["a", "b", None]), rng.randrange(20), k) for k in range(60)]
    right = [(rng.choice(["a", "b", None]), rng.randrange(20), k) for k in range(30)]
    found = TS.asof_join(spark.createDataFrame(left, "k string, t int, l int"), spark.createDataFrame(right, "k string, t int, r int"), ["k"], "t", ["r"], strict, order=["r"])
    got = {row.l: row.r for row in found.collect()}
    for k, t, l in left:
        fits = [(tt, r) for kk, tt, r in right if k is not None and kk == k and (tt < t or tt == t and not strict)]
        assert got[l] == (max(fits)[1] if fits else None)


def test_periods_in_role_and_runs(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("a", 2, 0.25), ("a", 4, 0.6), ("a", 5, None), ("a", 6, 0.62)], "e string, w int, x double")
    assert {r.w: r.n for r in TS.periods_in_role(df, "x", ["e"], "w", 0.15, "n").collect()} == {1: 0, 2: 1, 4: 0, 5: 1, 6: 2}
    flags = spark.createDataFrame([("a", k, f) for k, f in enumerate([True, True, False, True, False, True, True, True])], "e string, w int, f boolean")
    assert sorted(r.length for r in TS.runs(flags, "f", ["e"], ["w"]).collect()) == [1, 2, 3]


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "k int, v string, extra int")
    assert sorted(map(tuple, R.upsert(old, new, ["k"]).collect())) == [(1, "a", None), (2, "c", 1), (3, "d", 1)]
    assert sorted(map(tuple, R.insert_if_absent(old, new, ["k"]).select("k", "v").collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_guards_raise(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1)), (1, datetime(2024, 1, 3))], "k int, t timestamp")
    with pytest.raises(Exception, match="repeated key"):
        R.unique_or_raise(df, ["k"]).collect()
    with pytest.raises(Exception, match="known too late"):
        R.assert_no_leakage(df, "t", F.lit(datetime(2024, 1, 2))).collect()
    assert R.visible(df, "t", F.lit(datetime(2024, 1, 3))).count() == 1


def test_scoring_validates(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    rules = {"a": S.Direct("a"), "b": S.sum_of("a", "b")}
    assert df.select(S.score(df, {"a": 2, "b": 1, "c": 0}, rules)).first()[0] == 3.0
    with pytest.raises(ValueError, match="no rule"):
        S.score(df, {"z": 1}, rules)
    with pytest.raises(ValueError, match="exclude"):
        S.score(df, {"a": 1, "b": 1}, rules, (frozenset({"a"}), frozenset({"b"})))


def test_capped_weights(spark):
    df = spark.createDataFrame([("g", "x", 0.9), ("g", "y", 0.06), ("g", "z", 0.04), ("h", "x", 1.0)], "g string, s string, weight double")
    got = {(r.g, r.s): r.weight for r in K.capped_weights(df, "g", "s").collect()}
    assert got == {("g", "x"): 0.7, ("g", "y"): pytest.approx(0.18), ("g", "z"): pytest.approx(0.12)}


def test_flex_fixed_point():
    points = {"A": [30, 20, 10, 9], "B": [25, 24, 23, 1]}
    assert V.converge_starters(points, {"A": 1, "B": 1}, ["A", "B"], 2) == {"A": 1, "B": 3}


def test_lineup_equals_brute_force():
    rng = random.Random(2)
    slots = [["A"], ["B"], ["A", "B"], ["C"]]
    for _ in range(40):
        groups, points = [rng.choice("ABC") for _ in range(6)], [rng.randrange(1, 30) for _ in range(6)]
        fits = [[k for k, s in enumerate(slots) if g in s] for g in groups]
        total, chosen = V.lineup_by_sets([float(p) for p in points], fits, len(slots))
        best = (0, 0.0)
        for order in itertools.product([-1, *range(6)], repeat=4):
            used = [i for i in order if i >= 0]
            if len(set(used)) == len(used) and all(i < 0 or s in fits[i] for s, i in enumerate(order)):
                best = max(best, (len(used), float(sum(points[i] for i in used))))
        assert (sum(c >= 0 for c in chosen), total) == best
        assert V.fills_slots(groups, slots) == (best[0] == 4)


def test_merge_small_and_cap():
    assert V.merge_small([1, 3, 1, 4], 2) == [0, 0, 0, 1]
    assert V.cap_segments([0, 2, 4], [10, 9, 8.9, 8, 1, 0], 2) == [0, 4]


def test_survival_is_one_without_expectation(spark):
    got = one(spark, V.survival(10, F.lit(None).cast("double"), F.lit(1.0), 5.0), V.survival(10, F.lit(10.0), F.lit(0.0), 5.0))
    assert got[0] == 1.0 and got[1] == pytest.approx(0.5, abs=1e-6)


def test_expected_best(spark):
    df = spark.createDataFrame([("g", 1, 10.0, 0.5), ("g", 2, 8.0, 1.0), ("g", 3, 6.0, 0.5)], "g string, k int, v double, p double")
    assert V.expected_best(df, "g", "v", "k", "p").first().expected_best == pytest.approx(5 + 4)


def test_spearman_of_constant_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 3.0), ("b", 1.0, 1.0), ("b", 2.0, 4.0), ("b", 3.0, float("nan"))], "g string, x double, y double")
    assert {r.g: r.spearman for r in E.spearman(df, ["g"], "x", "y").collect()} == {"a": None, "b": pytest.approx(1.0)}


def test_bootstrap_agrees_with_itself_and_covers(spark):
    df = spark.createDataFrame([(w, float(w % 5)) for w in range(40) for _ in range(3)], "w int, x double")
    a = E.bootstrap_interval(df, "w", F.col("x"), F.lit(1.0), 200).first()
    assert a == E.bootstrap_interval(df.repartition(3), "w", F.col("x"), F.lit(1.0), 200).first()
    assert a.low < a.value < a.high and a.value == pytest.approx(2.0) and a.clusters == 40


def test_durations_and_availability(spark):
    said = ["2-4 weeks", "3 weeks", "10 days", "out for the season", "day-to-day", "unclear", "1 to 2 weeks"]
    assert one(spark, *(A.duration_weeks(F.lit(t)) for t in said)) == (3.0, 3.0, 2.0, 18.0, 0.5, None, 1.5)
    assert one(spark, A.availability(F.lit("out"), F.lit(2.5), F.lit(1)), A.availability(F.lit("out"), F.lit(2.5), F.lit(2)), A.availability(F.lit("none"), F.lit(None).cast("double"), F.lit(0))) == (0.0, 0.5, 1.0)


def test_indel_ratio_equals_longest_common_subsequence():
    rng = random.Random(3)

    def lcs(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                rows[i][j] = rows[i - 1][j - 1] + 1 if x == y else max(rows[i - 1][j], rows[i][j - 1])
        return rows[-1][-1]

    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(0, 12))) for _ in range(2))
        assert I.indel_ratio(a, b) == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100)


def test_greedy_takes_best_pairs_first(spark):
    pairs = spark.createDataFrame([("b", 1, 1, 95.0), ("b", 1, 2, 90.0), ("b", 2, 1, 94.0), ("b", 2, 2, 80.0)], "b string, l int, r int, score double")
    assert sorted((x.l, x.r) for x in I.greedy_one_to_one(pairs, ["b"], "l", "r", "score").collect()) == [(1, 1), (2, 2)]


def test_positive_definite_repair_and_marginals():
    bad = np.array([[1.0, 0.9, -0.9], [0.9, 1.0, 0.9], [-0.9, 0.9, 1.0]])
    fixed = Z.nearest_positive_definite(bad)
    assert np.linalg.eigvalsh(fixed).min() > 0 and np.allclose(np.diag(fixed), 1)
    x = Z.inverse_marginal(np.array([0.05, 0.5, 0.9, 0.99]), [0.1, 0.5, 0.9], [2.0, 5.0, 11.0])
    assert x[1] == 5 and x[2] == 11 and x[3] > 11 and 0 <= x[0] <= 2
    assert Z.mixture_quantiles([2.0, 5.0, 11.0], [0.1, 0.5, 0.9], 0.4) == [0.0, 0.0, pytest.approx(np.interp(0.75, [0.1, 0.5, 0.9], [2, 5, 11]))]


def test_weighted_choice_follows_weights(spark):
    df = spark.range(4000).select(F.col("id").alias("g"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    chosen = Z.weighted_choice(df, ["g"], F.col("k").cast("double"), "k", 1).groupBy("k").count().collect()
    shares = {r.k: r["count"] / 4000 for r in chosen}
    assert 0 not in shares and shares[2] == pytest.approx(2 / 3, abs=0.04)


def test_ridge_finds_the_stronger_unit(spark):
    rng = random.Random(4)
    rows = [("s", u, o, 2.0 * u - o + rng.gauss(0, 0.1)) for u in range(3) for o in range(4) for _ in range(20)]
    got = {r.u: r.strength for r in M.ridge_strengths(spark.createDataFrame(rows, "g string, u int, o int, y double"), ["g"], "u", "o", "y", F.lit(1.0), 0.1).collect()}
    assert got[0] < got[1] < got[2] and got[2] - got[0] == pytest.approx(4, abs=0.3)


def test_training_is_strictly_before(spark):
    df = spark.createDataFrame([(2020, 5), (2021, 1), (2021, 2), (2021, 3)], "season int, week int")
    train, rows = M.before_and_at(df, "season", "week", (2021, 2))
    assert sorted(map(tuple, train.collect())) == [(2020, 5), (2021, 1)] and rows.count() == 1


def test_documents(spark):
    html = "<table><tr><th>Rank</th><th>Name</th></tr><tr><td>1</td><td>A &amp; <b>B</b></td></tr></table>"
    rows = D.html_rows(spark.createDataFrame([(7, html), (8, None)], "id int, html string"), "id")
    assert [(r.id, r.row_number, r.cells) for r in rows.collect()] == [(7, 1, ["Rank", "Name"]), (7, 2, ["1", "A & B"])]
    with pytest.raises(Exception, match="expected 3 cells"):
        D.checked_width(rows, 3).collect()
    xml = "<rss><channel><item><title>One</title><link>u1</link></item><item><title> </title><link>u2</link></item></channel></rss>"
    feed = D.feed_entries(spark.createDataFrame([(xml,)], "xml string")).collect()
    assert [(r.title, r.guid) for r in feed] == [("One", "u1")]
    players = D.json_map_rows(spark.createDataFrame([('{"1": {"name": "A"}, "2": {"name": "B"}}',)], "j string"), "j", "struct<name:string>")
    assert sorted(map(tuple, players.collect())) == [("1", "A"), ("2", "B")]
    assert one(spark, D.flipped_name(F.lit("Last, First")), D.value_at(F.array(F.lit(1), F.lit(2)), F.array(F.lit("a"), F.lit("b")), F.lit(2)), D.value_at(F.array(F.lit(1)), F.array(F.lit("a")), F.lit(3))) == ("First Last", "b", None)


def test_cache_and_swap(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(readers.CacheMissError):
        readers.cached(spark, path, None)
    assert readers.cached(spark, path, lambda: spark.range(3)).count() == 3
    assert readers.cached(spark, path, None).count() == 3
    readers.replace(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    readers.write_json(spark, {"a": 1}, f"file://{tmp_path}/j.json")
    assert '"a": 1' in (tmp_path / "j.json").read_text()


def test_partition_overwrite(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    rows = lambda *r: spark.createDataFrame(list(r), "season int, week int, x int")
    readers.overwrite_partitions(rows((2020, 1, 1), (2020, 2, 2)), path, ["season", "week"])
    readers.overwrite_partitions(rows((2020, 2, 9)), path, ["season", "week"])
    assert sorted((r.week, r.x) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 9)]
    assert readers.season_table(spark, path, [2021]).count() == 0


def test_due_windows(spark):
    now = datetime(2024, 9, 1, 12)
    games = spark.createDataFrame([(k, datetime(2024, 9, 1, 12 + (m // 60), m % 60)) for k, m in enumerate([4, 5, 30, 31, 90, 91])], "g int, t timestamp")
    got = {r.g: r.checkpoint for r in stateful.due_windows(games, "t", F.lit(now)).collect()}
    assert got == {1: 30, 2: 30, 3: 90, 4: 90}


def test_streams(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(3):
        events.filter(f"event_id % 3 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sink = f"file://{tmp_path}/out"
    query = stream.select("user_id", "event_id", "value").writeStream.foreachBatch(stateful.upsert_sink(sink, ["event_id"])).option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(sink).count() == events.count()
    first = stateful.drained(stateful.once(stream, "event_id", "ts", "400 days"), f"{tmp_path}/once", f"{tmp_path}/c2")
    assert first.count() == events.count()
    counts = stateful.drained(stateful.windowed_counts(stream, "ts", ["event_type"], "1 day", "0 seconds"), f"{tmp_path}/w", f"{tmp_path}/c3")
    assert counts.count() > 0


SLOTS = [["A"], ["B"], ["A", "B"]]


def test_lineup_regret(spark):
    rows = [("t", "A", 10.0, 1.0), ("t", "A", 5.0, 9.0), ("t", "A", 4.0, 8.0), ("t", "B", 3.0, 3.0)]
    got = W.lineup_regret(spark.createDataFrame(rows, "team string, g string, actual double, predicted double"), ["team"], "g", "actual", "predicted", SLOTS).first()
    assert (got.best, got.chosen, got.regret) == (18.0, 12.0, 6.0)


def test_candidate_gains_and_bids(spark):
    rosters = spark.createDataFrame([(r, f"{r}{k}", g, v) for r, values in ((1, (("A", 10.0), ("B", 8.0), ("A", 2.0), ("B", 1.0))), (2, (("A", 9.0), ("B", 9.0), ("A", 8.0)))) for k, (g, v) in enumerate(values)], "roster int, player string, g string, v double")
    candidates = spark.createDataFrame([("x", "A", 6.0), ("y", "B", 1.5)], "player string, g string, v double")
    gains = W.candidate_gains(rosters, candidates, "roster", "player", "g", "v", SLOTS)
    got = {(r.roster, r.player): (r.baseline, r.lineup_gain, round(r.depth_gain, 6), r.drop_player) for r in gains.collect()}
    assert got[1, "x"] == (20.0, 4.0, 0.0, "13") and got[1, "y"] == (20.0, 0.0, 0.075, "13") and got[2, "x"] == (26.0, 0.0, 0.0, None)
    board = W.bid_board(gains, spark.createDataFrame([(1, 100), (2, 7)], "roster int, budget int"), "roster", "player", 1, weeks_left=5)
    x = {r.player: r for r in board.collect()}["x"]
    assert x.max_bid == 98 and x.rivals == 0 and x.lock_bid == 1 and x.recommended_bid == 1


def test_legal_swaps():
    groups = {"a1": "A", "b1": "B", "a2": "A", "b2": "B", "k": "K", "a3": "A"}
    assert W.legal_swaps(["b2"], ["b1", "a1"], {k: groups[k] for k in ("a1", "b1", "a2", "b2", "k")}, SLOTS) == [("b2", "b1")]
    assert W.legal_swaps(["a3"], ["b1", "a2"], {k: groups[k] for k in ("a1", "b1", "a2", "a3")}, SLOTS) == [("a3", "a2")]
    assert W.legal_swaps(["a3"], [], {k: groups[k] for k in ("a1", "b1", "a3")}, SLOTS) == [("a3", None)]


def test_start_sit_prefers_the_better_player(spark):
    q = lambda m: [m - 4, m - 2, m, m + 2, m + 4]
    rows = [("m", s, f"{s}{k}", f"t{s}{k}", g, float(m), q(float(m))) for s in (0, 1) for k, (g, m) in enumerate((("A", 10), ("B", 10), ("A", 9), ("B", 5)))]
    df = spark.createDataFrame(rows, "matchup string, side int, player string, team string, g string, mean double, q array<double>")
    got = W.start_sit(df, "matchup", "side", "player", "team", "g", "mean", "q", [0.1, 0.25, 0.5, 0.75, 0.9], SLOTS, lambda a, b, same: 0.0).collect()
    assert [(r.sit, r.start) for r in got] == [(None, None), ("02", "03")]
    assert got[0].p_win == pytest.approx(0.5, abs=0.05) and got[1].delta_points == -4 and got[1].delta_p_win < -0.1


def test_season_table_has_every_team_or_raises(spark, data):
    from tidemark import plans
    from tidemark.operators import simulation

    nations = spark.read.parquet(f"{data}/customer.parquet").select("c_nationkey").distinct().count()
    assert plans.queries()["season_bracket"](spark, data).count() == nations > 12
    many = spark.range(65).selectExpr("id AS team", "1.0D AS mean", "1.0D AS sd")
    with pytest.raises(ValueError):
        simulation.season_table(many, "team", "mean", "sd", weeks=1, n=2)


def test_ewm_of_a_key_with_many_rows(spark):
    """Blocks give what one running quotient gives, nulls, a span of 1 and spans far apart included."""
    rows = [("a", t, None if t % 11 == 3 else float((t * 37) % 101)) for t in range(5000)] + [("b", 0, 2.0)]
    df = spark.createDataFrame(rows, "e string, t int, x double").repartition(3)
    found = TS.with_ewm(df, {"m": ("x", 4), "s": ("x", 1), "l": ("x", 300)}, ["e"], ["t"])
    assert found.columns == ["e", "t", "x", "m", "s", "l"]
    got = {(r.e, r.t): r for r in found.collect()}
    assert len(got) == 5001 and got["b", 0].m == 2.0
    for out, span in (("m", 4), ("l", 300)):
        decay, num, den = 1 - 2 / (span + 1), 0.0, 0.0
        for _, t, x in rows[:-1]:
            num, den = num * decay + (x or 0.0), den * decay + (x is not None)
            value = getattr(got["a", t], out)
            assert value is None if x is None else value == pytest.approx(num / den, rel=1e-9)
    assert all(r.s == r.x for r in got.values())


def test_text_operators_are_optional(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "tidemark.llm", None)
    monkeypatch.setitem(sys.modules, "tidemark.llm.registry", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        importlib.reload(entry)
        assert entry.queries() and "pipeline" not in entry.queries() and not any(q.startswith("op1_") for q in entry.queries())
        assert set(entry.oracle_sql()) <= set(entry.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_season_board_places_equal_values_by_entity_whatever_their_order(spark):
    values = {1: [0.3, 0.2, 0.1], 2: [0.1, 0.2, 0.3], 3: [0.2, 0.3, 0.1], 4: [None, 0.3, 0.3]}
    rows = [(e, "g", 1, w, v) for e, own in values.items() for w, v in enumerate(own, 1)]
    df = spark.createDataFrame(rows, "e int, g string, s int, w int, v double").coalesce(1)
    found = V.season_board(df, "e", "g", "s", "w", "v", at=3, last=6).collect()
    assert {r.e: r.place for r in found} == {1: 2, 2: 3, 3: 4, 4: 1}
    assert len({r.total for r in found if r.e < 4}) == 1 and [r.rest for r in found if r.e == 4] == [0.3 * 3]
    exact = V.season_board(df.withColumn("v", F.col("v").cast("decimal(18,2)")), "e", "g", "s", "w", "v", at=3, last=6).collect()
    assert {r.e: (r.place, r.to_date) for r in exact} == {1: (2, 0.6), 2: (3, 0.6), 3: (4, 0.6), 4: (1, 0.6)}


def test_nearest_equals_all_pairs_with_missing_values(spark):
    rng, nan, inf = random.Random(5), float("nan"), float("inf")
    odd = [None, nan, inf, -inf]
    value = lambda: rng.choice(odd) if rng.random() < 0.15 else float(rng.randrange(-12, 12))
    left = [(n, rng.choice([0, 1, 2, None]), value()) for n in range(80)] + [(3, 1, 2.0), (90, 7, 1.0), (91, 5, 2.0), (92, 5, None), (93, 6, nan)]
    right = [(n, rng.choice([0, 1, 2, None]), value()) for n in range(60)] + [(70, 5, None), (69, 5, None), (71, 6, nan), (72, 6, None), (73, 6, 4.0)]
    pairs: dict = {}
    for i, k, a in left:
        for j, m, b in right:
            if k is not None and k == m:
                gap = None if a is None or b is None else abs(a - b)
                pairs.setdefault(i, []).append((gap is None, gap is None or gap != gap, gap if gap is not None and gap == gap else 0.0, j, gap))
    want = {i: min(p)[3:] for i, p in pairs.items()}
    got = I.nearest(spark.createDataFrame(left, "l int, k int, a double"), spark.createDataFrame(right, "r int, k int, b double"), ["k"], "a", "b", "l", "r").collect()
    assert {r.l: (r.r, str(r.gap)) for r in got} == {i: (j, str(g)) for i, (j, g) in want.items()} and len(got) == len(want)


def test_fuzzy_one_to_one_is_greedy_over_all_pairs_without_forming_them(spark):
    rng, names = random.Random(9), ["ann lee", "ann le", "an lee", "bob ray", "bob rae", "", "cy", None]
    rows = lambda n: [(i, rng.choice(["x", "y", None]), rng.choice(names)) for i in rng.sample(range(300), n)]
    left = spark.createDataFrame(rows(120) + [(7, "x", "cy"), (7, "x", "bob ray")], "l long, b string, m string")
    right = spark.createDataFrame(rows(90) + [(5, "y", "ann le")], "r long, b string, n string")
    whole = I.greedy_one_to_one(I.fuzzy_pairs(left, right, ["b"], "m", "n", 70.0), ["b"], "l", "r", "score").select("b", "l", "r", "score")
    found = I.fuzzy_one_to_one(left, right, ["b"], "l", "r", "m", "n", 70.0)
    assert sorted(found.collect()) == sorted(whole.collect()) and found.count() > 40
    copies = spark.range(2000).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.lit(1).alias("p_size"), F.concat(F.lit("blue ring "), F.col("id") % 2).alias("p_name"))
    pairs = I.fuzzy_one_to_one(copies.toDF("l", "b", "s", "m"), copies.toDF("r", "b", "s", "n"), ["b", "s"], "l", "r", "m", "n", 80.0)
    assert pairs.filter("l = r and score = 100").count() == pairs.count() == 2000


@pytest.mark.parametrize("many_units,dense", [(True, 2048), (False, 2048), (True, 2)])
def test_ridge_strengths_equal_the_dense_solution(spark, monkeypatch, many_units, dense):
    monkeypatch.setattr(M, "DENSE", dense)
    rng, (units, others) = random.Random(6), (40, 5) if many_units else (5, 40)
    rows = [(g, rng.randrange(units), rng.randrange(others), rng.uniform(0, 30), rng.choice([0.5, 1.0])) for g in ("a", "b", None) for _ in range(300)]
    rows += [("a", None, 1, 5.0, 1.0), ("a", 1, None, 5.0, 1.0), ("a", 1, 1, None, 1.0)]
    want = {}
    for group in ("a", "b", None):
        own = [r for r in rows if r[0] == group and None not in r[1:]]
        us, os = sorted({r[1] for r in own}), sorted({r[2] for r in own})
        x, y, w = np.zeros((len(own), len(us) + len(os))), np.array([r[3] for r in own]), np.array([r[4] for r in own])
        for k, r in enumerate(own):
            x[k, us.index(r[1])] = x[k, len(us) + os.index(r[2])] = 1
        mean = (y * w).sum() / w.sum()
        solved = np.linalg.solve(x.T @ (w[:, None] * x) + 20 * np.eye(x.shape[1]), x.T @ (w * (y - mean)))
        want |= {(group, u): (mean, solved[k], sum(r[1] == u for r in own)) for k, u in enumerate(us)}
    df = spark.createDataFrame(rows, "g string, u int, o int, y double, w double")
    found = M.ridge_strengths(df, ["g"], "u", "o", "y", F.col("w")).collect()
    assert len(found) == len(want)
    for r in found:
        assert (r.mean, r.strength, r.n) == pytest.approx(want[r.g, r.u], abs=1e-8)


def test_ridge_strengths_of_many_units_need_no_square_matrix(spark):
    df = spark.range(60_000).select(F.lit(1).alias("g"), (F.col("id") % 30_000).alias("u"), (F.col("id") % 7).alias("o"), (F.col("id") % 11).cast("double").alias("y"))
    assert M.ridge_strengths(df, ["g"], "u", "o", "y", F.lit(1.0)).filter("n = 2 and strength is not null").count() == 30_000  # dense: 7 GB
