"""Source audits, configuration checks, sinks and picks."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import source_audit as A
from tallyspark.operators import sinks

POLICY = A.Policy(frozenset({"socket", "urllib"}), frozenset({"eval", "os.system"}))


@pytest.mark.parametrize(
    ("source", "want"),
    [("", "miner_py_empty"), (None, "miner_py_empty"), ("import socket.x", "banned_import:socket.x"), ("from urllib import request", "banned_import_from:urllib"), ("import socketserver", None), ("os.system('x')", "banned_call:os.system"), ("a.eval(1)", "banned_call:a.eval"), ("M.from_pretrained('x')", "from_pretrained_must_use_model_name"), ("M.from_pretrained(model_name)", None), ("# import socket\nx = 1", None)],
)
def test_source_reason(source, want):
    assert A.source_reason(source, POLICY) == want


def test_default_policy_and_scripts(spark):
    assert A.source_reason("def", A.DEFAULT_POLICY).startswith("miner_py_syntax_error:")
    assert [A.source_reason(x, A.DEFAULT_POLICY) for x in ("import torch.hub", "import torch", "torch.hub.load('x')", "torch.load('x')", "from importlib import util", "x.pipeline()")] == ["banned_import:torch.hub", None, "banned_call:torch.hub.load", None, "banned_import_from:importlib", "banned_call:x.pipeline"]
    canonical = 'R = ""\nx = 1\n'
    assert [A.script_reason(x, canonical, ("R",)) for x in ('R = "a/b"\nx=1', 'R = "a"\nx=2', "(", " ", None)] == [None, "wrapper_hash_mismatch", "deploy_script_syntax_error", "empty_deploy_script", "empty_deploy_script"]
    digest = "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    rows = spark.createDataFrame([("x",), ("y",), ("",), (None,)], "s string").select(A.hash_reason(F.col("s"), digest).alias("r")).collect()
    assert [r["r"] for r in rows] == [None, "miner_py_hash_mismatch", "miner_py_empty", "miner_py_empty"]


def test_constants_and_hash():
    assert A.constants('# R = "no"\nR = "a"\nR = "b"\ndef f():\n    Q = "c"\n', ("R", "Q")) == {"R": "b", "Q": ""}
    one, two = A.normalized_hash('R = "a"\nx=1', ("R",)), A.normalized_hash('R = "b"  # c\n\nx = 1', ("R",))
    assert one == two != A.normalized_hash('R = "a"\nx=2', ("R",)) and A.normalized_hash("(", ()) is None


CONFIGS = [
    ("model_name: m",None),('"model_name": m',None),("'model_name': m",None),("{model_name: m}",None),('{"model_name": "m", other: [1, 2]}',None),
    ("model_name: >-\n  m\n",None),("model_name: |\n  m\n",None),("list: [a,\n  b]\nmodel_name: m",None),("a key: 1\nmodel_name: m",None),
    ("model_name: m # which\n",None),("# c\n---\nmodel_name: m\n...\n",None),("%YAML 1.1\n---\nmodel_name: m",None),("model_name: 'm'",None),('model_name: "\\x6d"',None),
    ("model_name:\n  m\n",None),("x: &a m\nmodel_name: *a",None),("model_name: !!str m",None),("deep:\n  model_name: z\nmodel_name: m",None),("list:\n- a\n- b: c\nmodel_name: m",None),
    ("  model_name: m\n  x: y",None),("x: 'two\n  lines'\nmodel_name: m",None),("model_name: z\nmodel_name: m",None),("model_name: org/name:v1","model_name_mismatch:yaml=org/name:v1"),
    ("model_name: n","model_name_mismatch:yaml=n"),("model_name: a b","model_name_mismatch:yaml=a b"),("model_name: a\n  b","model_name_mismatch:yaml=a b"),
    ("model_name:","config_missing_model_name"),("model_name: ~","config_missing_model_name"),("model_name: ''","config_missing_model_name"),("other: m","config_missing_model_name"),("model_name:\n  nested: m","config_missing_model_name") ,
    ("# only a comment","config_missing_model_name"),("",  "config_empty"),(None,"config_empty"),(" \n","config_empty"),
    ("- a\n- b","config_not_a_mapping"),("[a, b]","config_not_a_mapping"),("just text","config_not_a_mapping"),("'quoted'","config_not_a_mapping"),
    ("model_name: 'm","config_parse_error"),("model_name: [a","config_parse_error"),("{model_name: m","config_parse_error"),("model_name: m\n\tx: y","config_parse_error"),("model_name: a: b","config_parse_error"),("model_name: m\n x: y","config_parse_error"),("a: 1\nno entry","config_parse_error"),("model_name: *none","config_parse_error"),("model_name: @m","config_parse_error"),("a: 1\n---\nb: 2","config_parse_error"),
]


@pytest.mark.parametrize(("text", "want"), CONFIGS)
def test_config(text, want):
    assert A.config_reason(text, "m") == want


def test_masks_are_set_in_the_text():
    canonical = 'R = ""\nx = 1\n'
    same = lambda x: A.script_reason(x, canonical, ("R",)) is None
    assert same("R = 'a'\nx = 1") and same('R="a\nb"\nx = 1') and not same('S = "a"\nx = 1') and not same('R = f("a")\nx = 1')
    # Text of a comment or of another string is masked too, as far as the next quote.
    assert A.masked_text('# R = "q"\ny = "R = \'z\'"', ("R",)) == '# R = ""\ny = "R = """'


def test_audit_column(spark):
    rows = spark.createDataFrame([("import socket",), (None,)], "s string").select(A.audit_column(F.col("s"), POLICY).alias("r")).collect()
    assert [r["r"] for r in rows] == ["banned_import:socket", "miner_py_empty"]


def test_sinks(spark, tmp_path):
    t = datetime(2025, 1, 1)
    leases = spark.createDataFrame([("a", "evaluation", t), ("b", "evaluation", t), ("a", "other", t)], "activity_key string, kind string, expires_at timestamp")
    done = spark.createDataFrame([("a", t)], "activity_key string, at timestamp")
    assert sorted((r["activity_key"], r["kind"]) for r in sinks.hand_over(leases, done, 20).collect()) == [("a", "other"), ("a", "result"), ("b", "evaluation")]
    rows = spark.createDataFrame([("e", i, f"m{i}") for i in range(5)], "evaluation_id string, pos int, miner string")
    assert sorted(len(r["rows"]) for r in sinks.batches(rows, 2).collect()) == [1, 2, 2]
    sinks.write_evaluations(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 5


def test_picker():
    p = sinks.Picker(1)
    assert p.pick([]) is None and len({p.pick(["a", "b", "c"]) for _ in range(3)}) == 3 and p.pick(["a", "b", "c"]) in "abc"
