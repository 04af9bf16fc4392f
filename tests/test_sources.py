import hashlib
import json

import pytest

from millrace.operators import manifest
from millrace.sources import files


def test_jsonl_keeps_nulls_and_fails_on_garbage(spark, tmp_path):
    df = spark.createDataFrame([("b", None), ("a", "x")], "z string, y string")
    files.write_jsonl(df, str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert {"y": None, "z": "b"} in lines
    counts = {r.key: r.missing for r in manifest.missing_keys(files.read_json_lines(spark, str(tmp_path / "out")), "value", ["y", "q"]).collect()}
    assert counts == {"y": 0, "q": 2}
    (tmp_path / "bad.jsonl").write_text('{"z": 1}\nnot json\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "z int").collect()


def test_evaluation_questions(spark, tmp_path):
    (tmp_path / "math").mkdir()
    (tmp_path / "math/test.jsonl").write_text('{"problem": "", "question": "Q0"}\n\n{"other": 1}\n{"query": "Q2"}\n')
    (tmp_path / "amc23").mkdir()
    (tmp_path / "amc23/test.json").write_text('{"data": [{"problem": "A0"}]}')
    (tmp_path / "aime24").mkdir()
    (tmp_path / "aime24/test.json").write_text('[{"question": "B0"}]')
    got = {tuple(r) for r in files.evaluation_questions(spark, str(tmp_path)).collect()}
    assert got == {("math:0", "Q0"), ("math:2", "Q2"), ("amc23:0", "A0"), ("aime24:0", "B0")}


def test_sheet_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿sample_id,notes\ns1,\"a \"\"b\"\"\nc\"\n", encoding="utf-8")
    r = files.read_sheet(spark, str(tmp_path / "a.csv")).first()
    assert r.sample_id == "s1" and r.notes == 'a "b"\nc'


def test_digests(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    good = hashlib.sha256(b"abc").hexdigest()
    expected = spark.createDataFrame([("x.bin", good), ("gone", good)], "name string, sha256 string")
    assert [r.name for r in files.digest_mismatches(spark, str(tmp_path), expected).collect()] == ["gone"]


def test_sheet_begins_with_a_mark(spark, tmp_path):
    df = spark.createDataFrame([("s1", None, 'a "b", c'), ("s2", "x\ny", "")], "sample_id string, notes string, more string")
    files.write_sheet(df.coalesce(1), str(tmp_path / "s"))
    raw = next((tmp_path / "s").glob("part-*")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfsample_id,")
    assert sorted(map(tuple, files.read_sheet(spark, str(tmp_path / "s")).collect())) == [("s1", "", 'a "b", c'), ("s2", "x\ny", "")]


def test_digests_that_end_a_run(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    found = files.artifact_digests(spark, str(tmp_path), ["x.bin", "gone"])
    assert [(r.name, r.bytes) for r in found.collect()] == [("x.bin", 3)]
    wrong = files.digest_mismatches(spark, str(tmp_path), spark.createDataFrame([("x.bin", "0")], "name string, sha256 string"))
    with pytest.raises(ValueError, match="x.bin"):
        files.require_digests(wrong)
    files.require_digests(wrong.limit(0))


def test_chat_provider():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from millrace.sources.chat import ChatProvider, Sampling

    seen = []

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            prompt = body["messages"][1]["content"]
            bad = prompt == "never" or prompt == "second" and sum(b["messages"][1]["content"] == prompt for b in seen) < 2
            self.send_response(500 if prompt == "never" else 200)
            self.end_headers()
            text = " " if bad else f"to {prompt}"
            self.wfile.write(json.dumps({"choices": [{"message": {"content": text}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 7}}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        provider = ChatProvider("m", f"http://127.0.0.1:{server.server_port}/v1/chat/completions", "k", Sampling(0.1, 10, "low"), tries=3, pause=0.01)
        one, two, never = provider.complete(["first", "second", "never"], "sys", [1, 2, 3])
    finally:
        server.shutdown()
    assert (one.text, one.total_tokens, one.attempts) == ("to first", 7, 1) and (two.text, two.attempts) == ("to second", 2)
    assert never.text is None and never.attempts == 3 and never.error_type == "HTTPError" and "3 attempts" in never.error
    assert seen[0]["reasoning_effort"] == "low" and {b["seed"] for b in seen} == {1, 2, 3} and len(seen) == 6
