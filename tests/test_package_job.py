"""JOB-2 end to end on literal packages."""

import base64
import json
import os

from lakeloom.plans.package_job import render_packages, write_packages


def _b64(text: str) -> str:
    return base64.b64encode(text.encode()).decode()


def _package(interceptor=None, shared=None, config=None, parts=None, **more):
    definition = {"parts": [{"path": "a.txt", "payload": _b64("1 10 x {{P}}"), "payloadType": "InlineBase64"}] if parts is None else parts}
    if interceptor:
        definition["interceptor"] = interceptor
    item = {"type": "Notebook", "displayName": "n/1", "description": "", "definition": definition}
    return json.dumps({"id": "ab", "displayName": "d", "deploymentConfig": {**(config or {}), **({"globalInterceptors": shared} if shared else {})}, "items": [item], **more})


def _own(replacements):
    return {"type": "StringReplacement", "config": {"replacements": replacements}}


def _ref(name):
    return {"type": "Reference", "config": {"id": name}}


def test_packages_are_rendered_written_and_rejected(spark, tmp_dir):
    linked = [{"path": "b.txt", "payload": "assets/b", "payloadType": "AssetLink"}, {"path": "e.txt", "payload": "assets/e", "payloadType": "OneLake"}]
    raws = {
        1: _package(_own({"x": "{{PACKAGE_ID}}", "10": "ten", "1": "one", "{{P}}": "{{P}}"}), config={"parameters": {"P": {"type": "string", "value": "v"}}}),
        2: _package(_ref("a"), {"a": _ref("b"), "b": _own({"x": "{{FOLDER_ID}}", "1": ""})}, {"location": "NewWorkspace"}),
        3: _package(),
        4: _package(_ref("a"), {"a": _ref("b"), "b": _ref("a")}),
        5: "{",
        6: _package(_own({"b": "{{DEPLOYMENT_ID}}"}), parts=linked),
        7: _package(parts=[]),
        8: None,
    }
    packages = spark.createDataFrame([(k, v, f"d{k}", "w", 1) for k, v in raws.items()], "k long, raw string, dep string, ws string, item long")
    files = spark.createDataFrame([("assets/b", _b64("bob")), ("assets/e", "")], "path string, content_base64 string")
    parts, rejected = render_packages(packages, files, "k", "raw", "dep", "ws")
    got = {(r.k, r.path): (r.item_name, base64.b64decode(r.content).decode(), r.file) for r in parts.collect()}
    assert got == {
        # integer keys first and by value: "1" is replaced before "10" can match
        (1, "a.txt"): ("n/1_d1", "one one0 ab v", "1/0_n_1_d1/a.txt"),
        # a variable without a value leaves the replacement as it is; no suffix in a new workspace
        (2, "a.txt"): ("n/1", " 0 {{FOLDER_ID}} {{P}}", "2/0_n_1/a.txt"),
        (3, "a.txt"): ("n/1_d3", "1 10 x {{P}}", "3/0_n_1_d3/a.txt"),
        (6, "b.txt"): ("n/1_d6", "d6od6", "6/0_n_1_d6/b.txt"),
        (6, "e.txt"): ("n/1_d6", "", "6/0_n_1_d6/e.txt"),
    }
    assert {r.k: r.errors for r in rejected.collect()} == {4: ["item 0: interceptor references have no end"], 5: ["not a JSON object"], 8: ["not a JSON object"]}
    root = os.path.join(tmp_dir, "out")
    write_packages(parts, root)
    with open(os.path.join(root, "6/0_n_1_d6/b.txt")) as f:
        assert f.read() == "d6od6"
    assert sum(len(names) for _, _, names in os.walk(root)) >= 5
