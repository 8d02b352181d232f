import json
import sys

import pytest

from stratalog.sources import tools

SERVER = """
import json, sys, time
for line in sys.stdin:
    m = json.loads(line)
    print(json.dumps({"jsonrpc": "2.0", "method": "note"}))
    q = m["params"].get("arguments", {}).get("query")
    out = {"jsonrpc": "2.0", "id": m["id"]}
    if m["method"] == "initialize": out["result"] = {}
    elif q == "fail": out["error"] = {"code": -1}
    elif q == "exit": sys.exit()
    elif q == "wait": time.sleep(30)
    elif q == "plain": out["result"] = {"content": [{"type": "text", "text": "no json"}]}
    elif q == "image": out["result"] = {"content": [{"type": "image"}]}
    else: out["result"] = {"content": [{"type": "text", "text": json.dumps({"tool": m["params"]["name"], **m["params"]["arguments"]})}]}
    print(json.dumps(out), flush=True)
"""


@pytest.fixture
def command(tmp_path):
    (tmp_path / "server.py").write_text(SERVER)
    return [sys.executable, str(tmp_path / "server.py")]


def test_call_tool(spark, command):
    names = ["a", "fail", "plain", "exit", "image", "wait", "b"]
    rows = spark.createDataFrame([(i, json.dumps({"query": q})) for i, q in enumerate(names)] + [(7, None), (8, "[1]"), (9, "{")], "n int, arguments string").coalesce(1)
    got = {r["n"]: r for r in tools.call_tool(rows, command, tools.VIDEOS, timeout=5).collect()}
    assert len(got) == 10
    assert json.loads(got[0]["result"]) == {"tool": tools.VIDEOS, "query": "a"} and got[0]["error"] is None
    assert json.loads(got[1]["error"])["error"] == {"code": -1} and got[1]["result"] is None
    assert json.loads(got[2]["result"]) == {"raw": "no json"}
    assert "EOFError" in got[3]["error"] and "TimeoutError" in got[5]["error"]
    assert json.loads(got[4]["result"]) == {"content": [{"type": "image"}]}
    assert json.loads(got[6]["result"])["query"] == "b"
    assert all(got[n]["result"] is None and got[n]["error"] for n in (7, 8, 9))


def test_requests(spark, command):
    asked = tools.search_pages(spark.createDataFrame([("x",), ("y",)], "query string"), 2)
    stored = tools.call_tool(asked.where("page = 1"), command, tools.VIDEOS)
    assert sorted((r["query"], r["page"]) for r in tools.missing_requests(asked, stored).collect()) == [("x", 2), ("y", 2)]
    assert tools.call_tool(asked.where("false"), command, tools.VIDEOS).count() == 0
    assert spark.range(1).select(tools.by_source(tools.F.lit("u"))).first()[0] == '{"bvid_or_url":"u"}'
