"""Raw requests and nested documents."""

import json
import random

from millrace.operators import payloads as p


def test_strings_and_spans_agree_with_a_parser():
    rng = random.Random(1)

    def made(depth):
        kind = rng.choice(["l", "d"] if depth == 3 else ["s", "n", "b", "l", "d"] if depth else ["s", "n", "b"])
        return {"s": lambda: rng.choice(['a"b', "é\n", "", "x" * 5]), "n": lambda: rng.choice([1, 2.50, None]), "b": lambda: True, "l": lambda: [made(depth - 1) for _ in range(3)], "d": lambda: {f"k{i} ": made(depth - 1) for i in range(3)}}[kind]()

    def walk(v, path=()):
        if isinstance(v, str):
            yield path, v
        for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            yield from walk(x, (*path, k))

    for indent in (None, 2):
        for _ in range(100):
            v = made(3)
            raw = json.dumps(v, indent=indent)
            found = list(p.strings(raw))
            assert [(a, t) for a, _, _, t in found] == list(walk(v))
            assert all(json.loads(raw[b:e]) == t for _, b, e, t in found)


def test_only_live_blocks_change_and_the_rest_stays_byte_for_byte():
    rows = json.dumps([{"id": i, "status": "ok"} for i in range(60)], indent=1)
    body = {"model": "m", "x": "1.50", "messages": [{"role": "user", "content": rows}, {"role": "assistant", "content": "hm"}, {"role": "user", "content": [{"type": "tool_result", "content": rows}, {"type": "text", "text": "why?"}]}]}
    raw = json.dumps(body).replace('"1.50"', "1.50")
    out, n, saved = p.rewritten(raw, p.live_strings(raw))
    assert n == 1 and saved > 0 and "1.50" in out
    assert json.loads(out)["messages"][0] == body["messages"][0]
    assert json.loads(json.loads(out)["messages"][2]["content"][0]["content"]) == json.loads(rows)
    begin = raw.index('"tool_result"')
    assert out[:begin] == raw[:begin] and out.endswith(raw[-40:])


def test_frozen_messages_and_retrieved_outputs_stay():
    rows = json.dumps([{"id": i} for i in range(200)], indent=1)
    frozen = json.dumps({"messages": [{"role": "user", "content": [{"type": "text", "text": rows, "cache_control": {"type": "ephemeral"}}]}]})
    assert p.rewritten(frozen, p.live_strings(frozen))[0] == frozen
    items = json.dumps({"input": [{"type": "function_call", "call_id": "a", "name": "retrieve"}, {"type": "function_call_output", "call_id": "a", "output": rows}, {"type": "function_call_output", "call_id": "b", "output": rows}]})
    out, n, _ = p.rewritten(items, p.live_strings(items))
    assert n == 1 and json.loads(out)["input"][1]["output"] == rows


def test_requests_on_spark(spark):
    rows = json.dumps([{"id": i} for i in range(200)], indent=1)
    df = spark.createDataFrame([(1, json.dumps({"messages": [{"role": "user", "content": rows}]})), (2, "not json"), (3, None)], "req_id long, body string")
    found = {r.req_id: (r.blocks, r.status) for r in p.rewrite_requests(df).collect()}
    assert found == {1: (1, "ok"), 2: (0, "unparsed"), 3: (0, "unparsed")}


def test_documents_become_tables_and_markers(spark):
    long = "word " * 100
    doc = json.dumps({"rows": [{"a": 1.50, "b": "x,y"}, {"a": 2, "c": None}], "inner": json.dumps([{"k": 1}, {"k": 2}]), "blob": long}).replace("1.5,", "1.50,")
    row = p.compact_documents(spark.createDataFrame([(1, doc), (2, "plain")], "doc_id long, text string")).orderBy("doc_id").collect()
    out = json.loads(row[0].text)
    assert out["rows"] == '[2]{a:json,b:string?,c:string?}\n1.50,"x,y",\n2,,\n'
    assert out["inner"] == "[2]{k:int}\n1\n2\n"
    assert list(row[0].kept.values()) == [long] and out["blob"].startswith("<<ccr:" + next(iter(row[0].kept)))
    assert row[1].text == "plain"


def test_objects_keep_errors_and_ends():
    obj = {f"k{i}": ("failed " if i == 11 else "") + "value " * 20 for i in range(30)}
    kept = p.crushed_object(obj, 6, ["failed"])
    assert {"k0", "k29", "k11"} <= set(kept) and 6 <= len(kept) <= 8
    assert p.crushed_object({"a": 1}, 3, []) == {"a": 1}


def test_hashed_vectors_are_unit_and_like_for_like():
    a, b, c = (p.hashed_vector(t) for t in ("connection refused by server", "Connection refused by the server", "apples and pears"))
    dot = lambda x, y: sum(i * j for i, j in zip(x, y, strict=True))
    assert abs(dot(a, a) - 1) < 1e-9 and dot(a, b) > dot(a, c)
    assert p.hashed_vector("") == [0.0] * 256


def test_uniform_inner_objects_become_columns():
    rows = json.loads('[{"a": 1, "m": {"x": 1, "y": "p"}}, {"a": 2, "m": {"x": 2, "y": "q"}}, {"a": 3, "m": null}]', parse_float=p._Literal, parse_int=p._Literal)
    assert p.table(rows) == "[3]{a:int,m.x:int?,m.y:string?}\n1,1,p\n2,2,q\n3,,\n"
    mixed = [{"m": {"x": 1}}, {"m": {"y": 2}}]
    assert p.flattened(mixed) == mixed


def test_bpe_counts(spark):
    from millrace.functions.bpe import counter

    df = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",)], "t string")
    assert [r[0] for r in df.select(counter()("t")).collect()][:3] == [2, 0, 0]
