import json

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from calibrel.operators.runs import run_compare, run_summary
from calibrel.sources import read_run_logs, read_stage_logs, records
from calibrel.sources.records import read_objects


def record(module, layer=0, loss="0.5", time="1.000", fwd="10.000", **other):
    fields = {
        "process": "gptq", "layer": layer, "module": module, "loss": loss, "samples": "2048",
        "damp": "0.01000", "time": time, "fwd_time": fwd, **other,
    }
    return json.dumps(fields, indent=4)


def write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


FULL = [
    ("self_attn.k_proj", "11.5"), ("self_attn.v_proj", "11.5"), ("self_attn.q_proj", "11.5"),
    ("self_attn.o_proj", "7.25"), ("mlp.up_proj", "7.75"), ("mlp.gate_proj", "7.75"),
    ("mlp.down_proj", "6.5"),
]


@pytest.fixture()
def folder(tmp_path):
    layer = "".join(record(m, fwd=f) + "\n" for m, f in FULL)
    # the last record has no newline behind it
    write(tmp_path, "gptq_log_red_fox_time_02_03_2031_04h_05m_06s.log",
          layer + record("self_attn.k_proj", layer=1, loss="7.25"))
    write(tmp_path, "gptq_log_owl_time_11_12_2030_07h_08m_09s.log",
          record("self_attn.k_proj", loss="0.25") + "\n\n")
    return tmp_path


def test_every_record_is_read(spark, folder):
    logs = read_run_logs(spark, str(folder)).collect()
    assert len(logs) == 9
    owl = [r for r in logs if r["run"] == "owl"][0]
    assert str(owl["started"]) == "2030-11-12 07:08:09"
    assert (owl["layer"], owl["loss"], owl["samples"], owl["damp"]) == (0, 0.25, 2048, 0.01)
    assert {r["run"] for r in logs} == {"red_fox", "owl"}
    assert all(r["bad_record"] is None for r in logs)


def test_bad_numbers_and_records_stay(spark, tmp_path):
    write(tmp_path, "gptq_log_x_time_02_03_2031_04h_05m_06s.log",
          record("a", loss="n/a") + "\n{\n  broken\n}\n" + record("b") + "\n")
    write(tmp_path, "notes.log", record("c") + "\n")
    logs = {r["module"]: r for r in read_run_logs(spark, str(tmp_path)).collect()}
    assert logs["a"]["loss"] is None and logs["a"]["bad_record"] is None
    assert "broken" in logs[None]["bad_record"]
    assert logs["c"]["run"] is None and logs["c"]["started"] is None


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("between", ["\n", "  \n", "", " ", "\r\n\t\r\n"])
@pytest.mark.parametrize("indent", [4, None])
def test_no_object_is_lost(spark, tmp_path, newline, between, indent):
    objects = [json.dumps({"layer": k, "module": f"m{k}"}, indent=indent) for k in range(7)]
    text = between.join(objects).replace("\n", newline)
    (tmp_path / "gptq_log_x_time_02_03_2031_04h_05m_06s.log").write_bytes(text.encode())
    logs = read_run_logs(spark, str(tmp_path)).collect()
    assert sorted(r["layer"] for r in logs if r["bad_record"] is None) == list(range(7)) and len(logs) == 7


def test_runs_of_one_name_and_bad_records(spark, tmp_path):
    for day, time in (("04", "1.0"), ("05", "2.0")):
        write(tmp_path, f"gptq_log_x_time_02_{day}_2031_04h_05m_06s.log",
              record("self_attn.k_proj", time=time, fwd=time) + "\n{\n  broken\n}\n")
    found = run_summary(read_run_logs(spark, str(tmp_path))).orderBy("started").collect()
    assert [(r["layer"], r["modules"], r["fwd_time"]) for r in found] == [(0, 1, 1.0), (0, 1, 2.0)]


def test_large_log_is_split(spark, tmp_path):
    write(tmp_path, "gptq_log_x_time_02_03_2031_04h_05m_06s.log",
          "".join(record("self_attn.k_proj", layer=i) + "\n" for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        logs = read_run_logs(spark, str(tmp_path))
        assert logs.rdd.getNumPartitions() > 5
        assert sorted(r["layer"] for r in logs.collect()) == list(range(4000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_forward_time_counts_once_per_stage(spark, folder):
    found = {(r["run"], r["layer"]): r for r in run_summary(read_run_logs(spark, str(folder))).collect()}
    layer = found["red_fox", 0]
    assert layer["modules"] == 7 and layer["time"] == pytest.approx(7.0)
    assert layer["fwd_time"] == pytest.approx(11.5 + 7.25 + 7.75 + 6.5)
    assert found["red_fox", 1]["max_loss"] == 7.25


def test_runs_that_stop_at_different_layers(spark, folder):
    compared = run_compare(read_run_logs(spark, str(folder)), "red_fox", "owl").collect()
    assert len(compared) == 8
    both = [r for r in compared if r["right_loss"] is not None]
    assert len(both) == 1 and both[0]["loss_change"] == -0.25
    assert all(r["loss_change"] is None for r in compared if r["right_loss"] is None)


def test_other_runs_are_not_read(spark, folder):
    assert read_run_logs(spark, str(folder)).rdd.getNumPartitions() == 2
    for only in ("run = 'owl'", "started < timestamp_ntz'2030-12-01 00:00:00'"):
        logs = read_run_logs(spark, str(folder), F.expr(only))
        assert logs.rdd.getNumPartitions() == 1 and {r["run"] for r in logs.collect()} == {"owl"}


def texts_of(spark, folder, **conf):
    for name, value in conf.items():
        spark.conf.set(f"spark.sql.files.{name}", value)
    try:
        return sorted(r["record_text"] for r in read_objects(spark, str(folder)).collect())
    finally:
        for name in conf:
            spark.conf.unset(f"spark.sql.files.{name}")


objects = st.lists(
    st.dictionaries(
        st.sampled_from(["a", "module"]),
        st.one_of(st.text(alphabet='a}{"\\\n:é ', max_size=8), st.integers(0, 9), st.lists(st.just({"b": "}"}), max_size=2)),
        max_size=2,
    ),
    max_size=25,
)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(objects, st.sampled_from([None, 0, 2]), st.sampled_from(["", "\n", " \r\n"]), st.sampled_from([7, 40, 300]))
def test_any_layout_and_any_split(spark, tmp_path_factory, found, indent, between, split):
    folder = tmp_path_factory.mktemp("objects")
    want = [json.dumps(o, indent=indent, ensure_ascii=False) for o in found]
    (folder / "x.log").write_bytes(between.join(want).encode())
    got = texts_of(spark, folder, maxPartitionBytes=str(split), openCostInBytes="1")
    assert got == sorted(want)


def test_braces_in_strings_and_objects_on_one_line(spark, tmp_path):
    write(tmp_path, "gptq_log_x_time_02_03_2031_04h_05m_06s.log", '{"module":"m} {x"}{"module":"\\"}{"}')
    assert sorted(r["module"] for r in read_run_logs(spark, str(tmp_path)).collect()) == ['"}{', "m} {x"]
    many = "".join(json.dumps({"module": f"m{k}", "layer": k}) for k in range(20_000))
    write(tmp_path, "gptq_log_x_time_02_03_2031_04h_05m_06s.log", many)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        logs = read_run_logs(spark, str(tmp_path))
        assert sorted(r["layer"] for r in logs.collect()) == list(range(20_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("split", ["20", "1000000"])
def test_a_broken_object_costs_itself_alone(spark, tmp_path, split):
    good = [record(f"m{k}") for k in range(4)]
    broken = ['{\n  "module": "never ended,\n  "layer": 1\n}', '{\n  "module": "cut off"', "no object at all }"]
    text = "\n".join([good[0], broken[0], good[1], broken[1], good[2], broken[2], good[3], '{\n "module": "unfinished"'])
    write(tmp_path, "a.log", text)
    got = texts_of(spark, tmp_path, maxPartitionBytes=split, openCostInBytes="1")
    assert got == sorted([*good, *broken, '{\n "module": "unfinished"'])


def test_stage_logs_have_day_first_names(spark, tmp_path):
    write(tmp_path, "07-01-2031_01.02.03.log", "manager stage: steps ready\n\nother\n")
    write(tmp_path, "29-02-2032_04.05.06.log", "manager stage: steps done\n" * 2)
    found = sorted((str(r["started"]), r["stage"]) for r in read_stage_logs(spark, str(tmp_path)).collect())
    assert found == [("2031-01-07 01:02:03", "steps ready")] + [("2032-02-29 04:05:06", "steps done")] * 2


def pieces_of(content):
    texts = content.split("}")
    return pa.array([t.encode() for t in texts], pa.binary())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='{}"\\\n a:,[', max_size=60) | st.lists(st.sampled_from(['{"a": 1', '\n{\n "b": "x"', ' \n', '{"c', '\n{"d": "y\\"']), max_size=12).map("}".join))
def test_pieces_in_bulk_do_what_each_does(content):
    values = pieces_of(content)
    usual, on_line = records._usual(values)
    for piece, is_usual, line in zip(values.to_pylist(), usual.tolist(), on_line.tolist()):
        effect = records.effect_of(piece.decode(), False)
        if is_usual:
            assert not effect.in_string and effect.opened == 1 and bool(effect.begins) == line
    n = len(values)
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * n), pa.array([9] * n), pa.array([10**6] * n), values], names=["file", "split", "size", "value"])
    row = next(records._transfers(iter([batch]))).to_pylist()[0]
    for side, in_string in (("outside", False), ("inside", True)):
        one = records.Transfer(in_string)
        for piece in values.to_pylist():
            one.take(records.effect_of(piece.decode(), one.in_string), True)
        assert row[side] == [float(x) for x in (one.in_string, *records._numbers(one))]


def test_objects_of_one_split_are_cut_in_one_scan(spark, tmp_path):
    write(tmp_path, "gptq_log_x_time_02_03_2031_04h_05m_06s.log", "".join(record("m", layer=i) + "\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        plan = read_objects(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "FileScan text" in plan and "Scan ExistingRDD" not in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_small_files_beside_a_split_one(spark, tmp_path):
    for k in range(40):
        write(tmp_path, f"small{k}.log", json.dumps({"layer": k}, indent=1) + "\n")
    large = [json.dumps({"layer": 100 + k, "of": {"deep": ["}"]}}) for k in range(3000)]
    write(tmp_path, "large.log", " ".join(large))
    # small enough that the number of all files' bytes decides how the large one is split
    got = texts_of(spark, tmp_path, maxPartitionBytes="20000", openCostInBytes="2000", minPartitionNum="10")
    assert len(got) == 3040 and sorted(t for t in got if "deep" in t) == sorted(large)
