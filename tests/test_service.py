import io
import json

import pytest

from tessera import cli, models
from tessera.config import Config
from tessera.engine import Engine
from tessera.serve import serve


def test_models():
    assert models.lookup(" ") == models.lookup("BAAI/bge-small-en-v1.5") == models.lookup("bge-small-en-v1.5")
    assert models.lookup("bge-small-en-v1.5").query_prefix and models.lookup("all-MiniLM-L6-v2").query_prefix == ""
    assert models.lookup("some/other-model").width == 0 and not models.lookup("some/other-model").known
    for bad in ("bge", "a/b/c", "../x", "a/", "a/b c"):
        with pytest.raises(models.UnknownModel):
            models.lookup(bad)


def test_model_is_authoritative(spark, tmp_path):
    seen = []

    def embed(texts):
        seen.extend(texts)
        return [[1.0] * 384 for _ in texts]

    engine = Engine(spark, Config(root=str(tmp_path), store=f"file://{tmp_path}/s", embedding_model="bge-small-en-v1.5", embedding_width=384), embed)
    engine._query_vector("x"), engine._query_vector("x")
    assert seen == [models.MODELS[0].query_prefix + "x"]  # once, with the model's prefix
    with pytest.raises(ValueError):
        Engine(spark, Config(root=str(tmp_path), store=f"file://{tmp_path}/t", embedding_model="bge-small-en-v1.5", embedding_width=64), embed)


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "a.py").write_text("def parse(x):\n    return load(x)\n\n\ndef load(x):\n    return x\n")
    (root / "b.md").write_text("# parse things\n")
    assert cli.init(str(root), None) == cli.init(str(root), "elsewhere")  # what is there stays
    return root


def run(root, *args):
    out = io.StringIO()
    code = cli.main(["--root", str(root), *args], out)
    return code, out.getvalue()


def test_commands(project):
    code, text = run(project, "index")
    assert code == 0 and json.loads(text)["indexed"] == 2  # the settings' folder is no part of the project
    assert run(project, "search", "parse", "1", "--metadata-only", "--lang", "python")[1] == "a.py:1  parse                function_definition\n"
    assert run(project, "search", "parse", "--name", "parse")[1].partition(" ")[2] == "a.py:1-2 [python]\ndef parse(x):\n    return load(x)\n---\n"
    assert "  + func parse:1-2\n" in run(project, "map")[1] and "  func parse:1-2\n" in run(project, "map", "--no-marks")[1]
    assert run(project, "callers", "load")[1] == "1 callers of load:\n  a.py:2 parse\n"
    assert run(project, "impact", "load", "--depth", "1")[1] == "1 impact of load:\n  a.py:2 parse depth=1\n"
    assert run(project, "callees", "nothing")[1] == "No callees of nothing found.\n"
    code, text = run(project, "doctor")
    assert code == 0 and "ok   graph: built" in text
    assert json.loads(run(project, "stats")[1])["files"] == 2


def test_tools(project, spark):
    engine = Engine(spark, cli.settings(str(project), None, []))
    engine.index()
    asked = [
        {"id": 1, "method": "initialize", "params": {}}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "get_callees", "arguments": {"symbol": "parse"}}},
        {"id": 4, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "load", "limit": 1}}}, {"id": 5, "method": "tools/call", "params": {"name": "get_callers", "arguments": {"symbol": " "}}},
        {"id": 6, "method": "tools/call", "params": {"name": "nothing"}}, {"id": 7, "method": "nothing"}, {"id": 8, "method": "tools/call", "params": {"name": "get_map", "arguments": {"max_tokens": 5}}}, {"id": 9, "method": "ping"},
    ]
    out = io.StringIO()
    serve(engine, [json.dumps(m) for m in asked] + ["", "{"], out)
    got = [json.loads(line) for line in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, 6, 7, 8, 9, None]
    text = {g["id"]: g["result"]["content"][0]["text"] for g in got if "content" in g.get("result", {})}
    assert len(got[1]["result"]["tools"]) == 5 and text[3] == "1 callees of parse:\n  a.py:5 load\n"
    found = json.loads(text[4])
    assert found["results"][0]["name"] == "load" and not found["results"][0]["stale"] and "embedding" not in found["results"][0]
    assert got[4]["result"]["isError"] and got[5]["error"]["code"] == -32602 and got[6]["error"]["code"] == -32601 and got[9]["error"]["code"] == -32700
    assert text[8].startswith("# package: . (1 files, 2 symbols)")
    plain = Engine(spark, Config(root=str(project), store=engine.config.store, graph=False))
    out = io.StringIO()
    serve(plain, [json.dumps({"id": 1, "method": "tools/list"})], out)
    assert [t["name"] for t in json.loads(out.getvalue())["result"]["tools"]] == ["search", "get_map"]
