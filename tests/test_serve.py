import io
import json

from symloom.__main__ import QUERIES, serve


def answers(monkeypatch, capsys, *asked):
    monkeypatch.setattr("sys.stdin", io.StringIO("".join(x + "\n" for x in asked)))
    serve(None)
    return [json.loads(x) for x in capsys.readouterr().out.splitlines()]


def test_protocol(monkeypatch, capsys):
    ask = lambda i, m: json.dumps({"jsonrpc": "2.0", "id": i, "method": m})
    got = answers(monkeypatch, capsys, ask(1, "initialize"), json.dumps({"method": "notifications/initialized"}), ask(2, "tools/list"), ask(3, "nothing"), "{", ask(4, "ping"))
    assert [x["id"] for x in got] == [1, 2, 3, None, 4]
    listed = {t["name"]: t["inputSchema"] for t in got[1]["result"]["tools"]}
    assert tuple(listed) == QUERIES
    assert listed["find_symbol"]["required"] == ["name"] and listed["pack_repo"]["properties"]["token_budget"] == {"type": "integer"}
    assert got[2]["error"]["code"] == -32601 and got[3]["error"]["code"] == -32700 and got[4]["result"] == {}


def test_a_failed_query_is_an_answer(monkeypatch, capsys):
    got = answers(monkeypatch, capsys, json.dumps({"id": 1, "method": "tools/call", "params": {"name": "drop_everything"}}))
    assert got[0]["result"]["isError"]
