import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from calibrel.operators.error import recon_error
from calibrel.operators.codes import (
    FP8_MAX,
    channel_scales,
    dequantize,
    largest_code,
    fp8_codes,
    int_codes,
)
from calibrel.operators import stats
from calibrel.operators.packing import pack_e4m3, pack_int4, unpack_e4m3, unpack_int4
from calibrel.operators.smooth import smooth, smooth_scales
from calibrel.operators.stats import channel_stats, importance, second_moment
from calibrel.plans.recipe import Fp8Codes, IntCodes, Smooth, run_recipe, run_recipe_on_both
from calibrel.sinks import read_codes, write_codes

RNG = np.random.default_rng(7)
DATA = RNG.normal(size=(40, 10)) * np.array([1, 5, 0.1, 2, 9, 0.01, 3, 4, 0, 1.0])


def frame(spark, data=DATA, kind="array<double>"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], f"id int, v {kind}")


def matrix(df, column):
    return np.array([r[column] for r in df.orderBy("id").collect()], dtype=float)


@pytest.mark.parametrize("bits", [4, 8])
@pytest.mark.parametrize("size", [None, 3, 5, 10, 3216])
def test_groups_against_numpy(spark, bits, size):
    per = "row" if size is None else "group"
    coded = int_codes(frame(spark), "v", bits, per, size)
    width = min(size or 10, 10)
    q = largest_code(bits)
    for row in coded.collect():
        x = DATA[row["id"]]
        groups = [x[i : i + width] for i in range(0, 10, width)]
        scales = [np.abs(g).max() / q for g in groups]
        assert row["scales"] == scales
        codes = [c for g, s in zip(groups, scales) for c in (np.rint(g / s) if s else g * 0)]
        assert row["codes"] == [int(c) for c in codes]
    decoded = matrix(dequantize(coded, group_size=size), "decoded")
    steps = np.array([np.repeat(r["scales"], width)[:10] for r in coded.orderBy("id").collect()])
    assert (np.abs(decoded - DATA) <= steps / 2 * (1 + 1e-9)).all()


def test_zero_and_empty_vectors(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, []), (2, None)], "id int, v array<float>")
    found = {r["id"]: (r["codes"], r["scales"]) for r in int_codes(df, "v", 4, "group", 1).collect()}
    assert found[0] == ([0, 0], [0.0, 0.0]) and found[1][0] == [] and found[2][0] is None
    assert fp8_codes(df, "v").filter("id = 0").first()["codes"] == [0.0, 0.0]


def test_half_to_even(spark):
    df = spark.createDataFrame([(0, [127.0, 0.5, 1.5, 2.5, -2.5])], "id int, v array<double>")
    assert int_codes(df, "v").first()["codes"] == [127, 0, 2, 2, -2]


@pytest.mark.parametrize("size", [3, 4])
def test_importance_keeps_positions(spark, size):
    df = frame(spark)
    stats = channel_stats(df, "v")
    order = np.argsort(-(DATA**2).mean(0), kind="stable")
    ranks = {r["pos"]: r["rank"] for r in importance(stats).collect()}
    assert [ranks[p] for p in order] == list(range(10))
    coded = int_codes(df, "v", 8, "group", size, order="importance", stats=stats)
    decoded = matrix(dequantize(coded, group_size=size, ranks=importance(stats)), "decoded")
    expected = np.empty_like(DATA)
    for i, x in enumerate(DATA):
        for start in range(0, 10, size):
            at = order[start : start + size]
            scale = np.abs(x[at]).max() / 127
            expected[i, at] = np.rint(x[at] / scale) * scale if scale else 0
    assert np.allclose(decoded, expected, rtol=0, atol=1e-12)


def test_channels_are_clipped_to_given_statistics(spark):
    df = frame(spark)
    coded = int_codes(df, "v", 8, "channel")
    q = np.abs(DATA).max(0) / 127
    assert (matrix(coded, "codes") == np.rint(DATA / np.where(q == 0, 1, q))).all()
    assert "scales" not in coded.columns
    small = channel_stats(df.filter("id < 5"), "v")
    clipped = matrix(int_codes(df, "v", 8, "channel", stats=small), "codes")
    assert clipped.max() == 127 and clipped.min() == -127
    decoded = dequantize(coded, scales=channel_scales(channel_stats(df, "v"), 127))
    assert (np.abs(matrix(decoded, "decoded") - DATA) <= q / 2 * (1 + 1e-9)).all()


def e4m3_values():
    values = {0.0}
    for e in range(-6, 9):
        values |= {math.ldexp(1 + m / 8, e) for m in range(8)}
    values |= {math.ldexp(m / 8, -6) for m in range(8)}
    return np.array(sorted(v for v in values if v <= 448))


def nearest_fp8(y):
    values = e4m3_values()
    size = abs(y)
    best = np.abs(values - size)
    near = [i for i in np.flatnonzero(best == best.min())]
    # at equal distance the even mantissa wins, which is the even position
    pick = near[0] if len(near) == 1 else [i for i in near if i % 2 == 0][0]
    return math.copysign(values[pick], y) if y else 0.0


def test_fp8_is_the_nearest_value(spark):
    values = e4m3_values()
    middles = (values[1:] + values[:-1]) / 2
    probes = np.concatenate([values, middles, RNG.uniform(0, 448, 200), 2.0 ** RNG.uniform(-12, 8, 200)])
    probes = np.concatenate([probes, -probes, [448.0]])
    df = frame(spark, [probes])
    found = fp8_codes(df, "v").first()
    assert found["scales"] == [1.0]
    assert found["codes"] == [nearest_fp8(float(y)) for y in probes]


def test_fp8_per_channel(spark):
    df = frame(spark)
    stats = channel_stats(df, "v")
    coded = fp8_codes(df, "v", "channel", stats)
    decoded = matrix(dequantize(coded, scales=channel_scales(stats, FP8_MAX)), "decoded")
    assert np.allclose(decoded, DATA, rtol=1 / 16 + 1e-9, atol=np.abs(DATA).max(0) / 448 / 512)


def test_channel_stats(spark):
    found = {r["pos"]: r for r in channel_stats(frame(spark), "v").collect()}
    for p in range(10):
        assert found[p]["abs_max"] == np.abs(DATA[:, p]).max() and found[p]["n"] == 40
        assert found[p]["mean"] == pytest.approx(DATA[:, p].mean())
        assert found[p]["mean_sq"] == pytest.approx((DATA[:, p] ** 2).mean())


def test_second_moment(spark):
    df = frame(spark, kind="array<float>").repartition(3).union(
        spark.createDataFrame([(99, None)], "id int, v array<float>")
    )
    x = DATA.astype(np.float32).astype(float)
    h = x.T @ x / len(x)
    h += 0.05 * np.diag(h).mean() * np.eye(10)
    found = {(r["i"], r["j"]): r["h"] for r in second_moment(df, "v", damp=0.05).collect()}
    assert len(found) == 100
    assert np.allclose([[found[i, j] for j in range(10)] for i in range(10)], h, rtol=1e-12)


def test_second_moment_refuses_ragged_vectors(spark):
    df = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>").coalesce(1)
    with pytest.raises(Exception, match="differ in length"):
        second_moment(df, "v").collect()


def test_smoothing_keeps_dot_products(spark):
    weights = RNG.normal(size=(6, 10))
    x, w = smooth(frame(spark), frame(spark, weights), "v", "v", 0.8)
    before, after = DATA @ weights.T, matrix(x, "v") @ matrix(w, "v").T
    assert np.allclose(before, after, rtol=0, atol=1e-12)
    scales = smooth_scales(channel_stats(frame(spark), "v"), channel_stats(frame(spark, weights), "v"))
    s = {r["pos"]: r["s"] for r in scales.collect()}
    assert s[8] == 1.0
    assert s[1] == pytest.approx(np.abs(DATA[:, 1]).max() ** 0.8 / np.abs(weights[:, 1]).max() ** 0.2)


@pytest.mark.parametrize("weighted", [False, True])
def test_reconstruction_error(spark, weighted):
    df = frame(spark)
    decoded = dequantize(int_codes(df, "v", 4, "group", 4), group_size=4)
    error = (matrix(decoded, "decoded") - DATA) ** 2
    weights = channel_stats(df, "v") if weighted else None
    w = (DATA**2).mean(0) if weighted else np.ones(10)
    total = recon_error(decoded, "v", weights=weights).first()["mse"]
    assert total == pytest.approx((error * w).sum() / (40 * w.sum()))
    rows = recon_error(decoded, "v", by="row", key="id", weights=weights)
    assert matrix(rows, "mse") == pytest.approx((error * w).sum(1) / w.sum())
    groups = recon_error(decoded, "v", by="group", group_size=4, weights=weights).collect()
    for r in groups:
        cut = slice(4 * r["grp"], 4 * r["grp"] + 4)
        assert r["mse"] == pytest.approx((error * w)[:, cut].sum() / (40 * w[cut].sum()))


def test_recipe_runs_each_step_once_in_order(spark):
    weights = frame(spark, RNG.normal(size=(6, 10)))
    found = run_recipe(frame(spark), [Smooth(weights, "v", "v"), IntCodes("v")])
    by_hand = int_codes(smooth(frame(spark), weights, "v", "v")[0], "v")
    assert found.orderBy("id").collect() == by_hand.orderBy("id").collect()
    assert "codes" in run_recipe(frame(spark), [Fp8Codes("v")]).columns


def test_recipe_keeps_both_sides(spark):
    weights = frame(spark, RNG.normal(size=(6, 10)))
    smoothing = Smooth(weights, "v", "v")
    rows, turned = run_recipe_on_both(frame(spark), smoothing, [], [])
    product = matrix(rows, "v") @ matrix(turned, "v").T
    assert product == pytest.approx(DATA @ matrix(weights, "v").T)
    rows, turned = run_recipe_on_both(frame(spark), smoothing, [IntCodes("v")], [IntCodes("v", per="channel")])
    assert "scales" in rows.columns and "codes" in turned.columns and "scales" not in turned.columns


ODD = [[0.5, 2.0], [float("nan"), 1.0], [1.0, float("inf")], [1.0, None], [], None, [0.0, 0.0]]


@pytest.mark.parametrize("coder", [int_codes, fp8_codes])
def test_vectors_that_are_not_finite_have_no_codes(spark, coder):
    df = spark.createDataFrame(list(enumerate(ODD)), "id int, v array<double>")
    rows = {r["id"]: r for r in coder(df, "v").collect()}
    assert all(rows[k]["codes"] is None and rows[k]["scales"] is None for k in (1, 2, 3, 5))
    assert rows[4]["codes"] == [] and rows[6]["codes"] == [0, 0] and rows[0]["codes"] is not None
    by_channel = {r["id"]: r["codes"] for r in coder(df.filter("id <> 4"), "v", per="channel").collect()}
    assert [k for k, c in by_channel.items() if c is not None] == [0, 6]


def test_statistics_of_finite_values(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id int, v array<double>")
    found = {r["pos"]: r for r in channel_stats(df, "v").collect()}
    assert (found[0]["abs_max"], found[0]["n"], found[0]["n_other"]) == (1.0, 4, 1)
    assert (found[1]["abs_max"], found[1]["n"], found[1]["n_other"]) == (2.0, 3, 2)
    smoothed = {r["id"]: r["v"] for r in smooth(df.filter("size(v) = 2"), df, "v", "v")[0].collect()}
    assert all(math.isfinite(x) for k in (0, 6) for x in smoothed[k])


def test_importance_of_tiny_values(spark):
    df = spark.createDataFrame([(0, [1e-9, 3e-9, 2e-9, 0.0, 0.0])], "id int, v array<double>")
    ranks = {r["pos"]: r["rank"] for r in importance(channel_stats(df, "v")).collect()}
    assert ranks == {1: 0, 2: 1, 0: 2, 3: 3, 4: 4}


def test_errors_over_nothing_are_null(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id int, v array<double>")
    decoded = dequantize(int_codes(df, "v"))
    rows = {r["id"]: r["mse"] for r in recon_error(decoded, "v", by="row", key="id").collect()}
    assert rows[6] == 0 and all(rows[k] is None for k in (1, 2, 3, 4, 5))
    dead = spark.createDataFrame([(0, [1.0, 0.0])], "id int, v array<double>")
    decoded = dequantize(int_codes(dead, "v", 8, "group", 1), group_size=1)
    groups = recon_error(decoded, "v", by="group", group_size=1, weights=channel_stats(dead, "v")).collect()
    assert {r["grp"]: r["mse"] for r in groups} == {0: 0.0, 1: None}


def test_second_moment_of_many_blocks(spark):
    x = np.random.default_rng(4).normal(size=(300, 150))
    bad = [float("nan")] * 150
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(bad,), (None,)], "v array<double>").repartition(9)
    found = np.zeros((150, 150))
    cells = second_moment(df, "v", damp=0.0, fan_in=2).collect()
    for r in cells:
        found[r["i"], r["j"]] = r["h"]
    assert len(cells) == 150 * 150 and found == pytest.approx(x.T @ x / 300)


@pytest.mark.parametrize(
    "arguments",
    [{"bits": 9}, {"per": "group"}, {"group_size": 3}, {"per": "other"}, {"order": "other"}],
)
def test_wrong_arguments(spark, arguments):
    with pytest.raises(ValueError):
        int_codes(frame(spark), "v", **arguments)
    with pytest.raises(ValueError):
        fp8_codes(frame(spark), "v", per="other")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_local_steps_do_not_shuffle(spark):
    df = frame(spark)
    for coded in (int_codes(df, "v"), int_codes(df, "v", 4, "group", 4), fp8_codes(df, "v")):
        assert "Exchange" not in plan_of(coded)


def test_codes_are_not_worked_out_once_per_element(spark):
    plan = plan_of(int_codes(frame(spark), "v", 4, "group", 4, order="importance"))
    codes = [line for line in plan.splitlines() if "AS codes" in line]
    # the lambda that picks by rank works on a bound variable, not on the expression of the codes
    assert codes and all("zip_with(array(flatten(" in line for line in codes)


def test_tiles_of_a_task_are_bounded(monkeypatch):
    monkeypatch.setattr(stats, "BLOCK", 16)
    monkeypatch.setattr(stats, "HELD_BYTES", 3 * 16 * 16 * 8)
    monkeypatch.setattr(stats, "CHUNK_BYTES", 25 * 100 * 8)
    x = np.random.default_rng(9).normal(size=(130, 100))
    x[7, 3] = np.inf
    batches = [pa.record_batch({"v": pa.array(x[a : a + 60].tolist())}) for a in range(0, 130, 60)]
    total, rows = np.zeros((100, 100)), {}
    for batch in stats._partial_products(iter(batches)):
        (r,) = batch.to_pylist()
        cells = np.frombuffer(r["cells"]).reshape(-1, r["width"])
        assert cells.nbytes <= 16 * 16 * 8
        total[r["top"] : r["top"] + cells.shape[0], r["left"] : r["left"] + r["width"]] += cells
        rows[r["top"], r["left"]] = rows.get((r["top"], r["left"]), 0) + r["n"]
    good = np.delete(x, 7, axis=0)
    upper = np.triu_indices(100)
    assert np.allclose(total[upper], (good.T @ good)[upper]) and set(rows.values()) == {129} and len(rows) == 28


def test_packed_codes_come_back(spark):
    nibbles = [list(range(-7, 8)), [], [3], [-7, 7], None]
    df = spark.createDataFrame(list(enumerate(nibbles)), "id int, codes array<tinyint>")
    packed = df.select("id", "codes", pack_int4(F.col("codes")).alias("p"))
    for r in packed.select("id", "codes", "p", unpack_int4(F.col("p")).alias("back")).collect():
        assert r["back"] == r["codes"] and (r["p"] is None or len(r["p"]) == (len(r["codes"]) + 1) // 2)
    # all 256 bytes; both that are not a number read as one
    every = spark.createDataFrame([(bytearray(range(256)),), (bytearray(),), (None,)], "p binary")
    found = every.select("p", unpack_e4m3(F.col("p")).alias("codes"))
    rows = found.select("p", "codes", pack_e4m3(F.col("codes")).alias("again")).collect()
    assert rows[0]["again"] == bytearray(127 if b == 255 else b for b in range(256))
    values = rows[0]["codes"]
    assert values[0x08] == 2.0**-6 and values[0x01] == 2.0**-9 and values[0x7E] == 448 and values[0xC0] == -2.0
    assert len(set(map(str, values))) == 255 and rows[1]["codes"] == [] and rows[2]["codes"] is None


def test_packed_codes_are_small_on_disk(spark, tmp_path):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=256).tolist()) for i in range(400)], "id int, v array<double>").coalesce(1)
    sizes = {}
    for name, coded in (("int4", int_codes(df, "v", 4, "group", 32)), ("e4m3", fp8_codes(df, "v"))):
        path = str(tmp_path / name)
        write_codes(coded, path, "v", packing=name)
        assert sorted(map(str, read_codes(spark, path).select("id", "codes").collect())) == sorted(
            map(str, coded.select("id", "codes").collect())
        )
        column = f"codes_{name}"
        lengths = spark.read.parquet(f"{path}/rows").select(F.length(column)).distinct().collect()
        assert [r[0] for r in lengths] == [128 if name == "int4" else 256]
        spark.read.parquet(f"{path}/rows").select(column).write.parquet(path + "-codes")
        sizes[name] = sum(f.stat().st_size for f in (tmp_path / f"{name}-codes").glob("*.parquet"))
    assert sizes["int4"] < 400 * 128 * 1.1 + 2000 and sizes["e4m3"] < 400 * 256 * 1.1 + 2000


def test_states_add_up(spark):
    x = np.random.default_rng(2).normal(loc=1e4, size=(90, 6))
    x[3, 2], x[50:, 4] = np.nan, np.inf
    x[:, 5] = np.nan
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    cuts = [df.where(f"id >= {a} AND id < {b}") for a, b in ((0, 20), (20, 21), (21, 60), (60, 90), (90, 99))]
    merged = None
    for some in cuts:
        state = stats.channel_state(some, "v")
        merged = state if merged is None else stats.merge_states(merged.unionByName(state))
    got = {r["pos"]: r for r in stats.stats_of(merged).collect()}
    want = {r["pos"]: r for r in channel_stats(df, "v").collect()}
    assert got.keys() == want.keys()
    for pos, w in want.items():
        g = got[pos]
        assert (g["n"], g["n_other"], g["abs_max"]) == (w["n"], w["n_other"], w["abs_max"])
        assert (g["mean"], g["mean_sq"]) == (None, None) if w["mean"] is None else (
            g["mean"] == pytest.approx(w["mean"], rel=1e-12) and g["mean_sq"] == pytest.approx(w["mean_sq"], rel=1e-12)
        )
    m2 = {r["pos"]: r["m2"] for r in merged.collect()}
    assert m2[0] == pytest.approx(((x[:, 0] - x[:, 0].mean()) ** 2).sum(), rel=1e-9)
