"""API documents against wording derived by hand."""

import json

from pyspark.sql import functions as F

from corpusloom.operators import apidocs

X = {"type": "object", "properties": {"a": {"type": "string", "enum": ["u", "v"]}, "x": {"$ref": "#/components/schemas/X"}}}
SPEC = {
    "openapi": "3", "info": {}, "components": {"schemas": {"X": X, "Y": {"type": "string"}, "Z": {"type": "array", "items": {"type": "number"}}}},
    "paths": {
        "/p/{id}/x": {
            "parameters": [{"name": "id", "required": True, "schema": {"type": "string", "description": "city"}}, {"schema": {}}], "x-note": {},
            "post": {
                "summary": "s", "description": "not said",
                "parameters": [{"name": "q", "required": True, "description": "what", "schema": {"type": "array", "items": {"$ref": "#/components/schemas/X"}}},
                               {"name": "k", "required": True, "schema": {"oneOf": [{"type": "integer"}, {"type": "string", "enum": [1, "b"]}]}}],
                "requestBody": {"content": {"application/json": {"schema": {"required": ["z"], "properties": {"z": {"type": "object", "properties": {"u": {"type": "string", "description": "du."}, "v": {}}}, "k": {"type": "integer"}}}}, "text/x": {}}},
                "responses": {"404": {}, "200": {"description": "fine", "content": {"application/json": {"schema": X}}}, "201": {"description": "unused"}},
            },
        },
        "/b": {"get": {"operationId": "getB", "description": "d", "requestBody": {"content": {"a/b": {"schema": {"$ref": "#/components/schemas/X"}}}}, "responses": {"500": {}}}, "put": 3},
    },
}


def test_functions_and_components_in_words(spark):
    deep = json.dumps({"paths": {"/d": {"get": {"parameters": [{"name": "n", "schema": "@"}]}}}}).replace('"@"', '{"type":"array","items":' * 300 + "{}" + "}" * 300)
    df = spark.createDataFrame([("t", json.dumps(SPEC)), ("bad", "{"), ("none", None), ("list", "[1]"), ("empty", "{}"), ("deep", deep)], "name string, document string")
    df = df.withColumn("said", F.lit("clash")).withColumn("op", F.lit(1))
    got = {r.function: r for r in apidocs.functions(df).collect()}
    assert set(got) == {"p_id_x_post", "getB", "b_put", "d_get"}
    post = got["p_id_x_post"]
    assert [(x.name, x.description, x.required) for x in post.inputs] == [
        ("q", "Array[#X].  what.", True), ("k", "integer.", False), ("id", "string. city. ", True), ("z", "Object{u: string. du., v}. ", True),
    ]
    assert post.text == (
        's\nParameters: {"q": "Required. Array[#X].  what.", "k": "integer.", "id": "Required. string. city. ", "z": "Required. Object{u: string. du., v}. "}\n'
        "Output: fine.\n - Format: application/json\n - Structure: Object{a, x: #X}\n"
    )
    assert got["getB"].text == "d\nParameters: {#X}\nOutput: \n - Format: \n - Structure: \n"
    assert [(r.component, r.description) for r in apidocs.components(df).orderBy("place").collect()] == [("X", "Object{a, x: #X}"), ("Y", ""), ("Z", "Array[number]")]
    assert apidocs.functions(df.limit(0)).count() == 0


def test_schema_words():
    assert apidocs.schema_words({"oneOf": [{"type": "integer"}, {"type": "string", "description": "x"}]}) == "integer. OR string. x."
    assert apidocs.schema_words({"oneOf": [{"type": "integer"}], "type": "number"}) == "number."
    assert apidocs.schema_words({"type": "array", "items": {"type": "object"}, "description": "many "}) == "Array[Object. ]. many ."
    assert apidocs.schema_words({"enum": [1, "a"]}) == "One of: [1, a]."
    assert apidocs.schema_words({"type": "object", "properties": {}}, brief=True) == "Object{}"


def test_media_flags(spark):
    def spec(*ops):
        return json.dumps({"paths": {f"/{k}": {m: {"requestBody": {"content": dict.fromkeys(i, 1)}, "responses": {str(200 + n): {"content": dict.fromkeys(o, 1)} for n, o in enumerate(outs)}}} for k, (m, i, outs) in enumerate(ops)}})

    cases = [
        (spec(("get", [], [["text/csv"]])), (True, True)), (spec(("get", [], [["image/png"], ["text/csv"]])), (True, True)), (spec(("get", [], [["text/csv"], ["image/png"]])), (True, False)),
        (spec(("post", ["image/png"], []), ("get", ["text/csv"], [])), (False, True)), (spec(("head", ["image/png"], [])), (True, True)),
        (spec(("get", ["image/png", "application/json"], [[]])), (True, True)), ("{}", (True, True)), ("no", (True, True)),
    ]
    df = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(cases)], "k int, document string")
    assert [tuple(r.f) for r in df.select("k", apidocs.media_flags(F.col("document")).alias("f")).orderBy("k").collect()] == [want for _, want in cases]


def test_calls_with_wrong_parameters(spark):
    wanted = [
        {"name": "a", "kind": "integer", "required": True}, {"name": "b", "kind": "number", "enum": "[1,2]", "required": True}, {"name": "c", "kind": "number"}, {"name": "d", "kind": "array"},
        {"name": "e", "kind": "object"}, {"name": "f", "kind": "string", "enum": '["v","w"]'}, {"name": "g", "kind": "string", "required": True}, {"name": "h", "kind": "boolean"}, {"name": "i", "kind": "odd"},
    ]
    calls = [
        '{"a":"3","b":"x","c":1,"d":null,"e":{"z":1},"f":"u","g":""}', '{"a":3}', None, '{"a":true,"b":1,"c":"7.5","d":[1],"e":[2],"f":"","g":1,"h":"no","i":[]}', '{"a":1.5,"b":2,"g":"x","h":1,"c":true}',
    ]
    df = spark.createDataFrame(list(enumerate(calls)), "k int, p string").withColumn("w", F.from_json(F.lit(json.dumps(wanted)), "array<struct<name:string,kind:string,enum:string,required:boolean>>"))
    got = {r.k: ([tuple(e) for e in r.errors], r.missing, r.message) for r in apidocs.checked_calls(df, ["k"], "p", "w").collect()}
    assert got[0][0] == [("b", "number", "string"), ("b", "one of [1,2]", '"x"'), ("d", "array", "None"), ("f", 'one of ["v","w"]', '"u"')] and got[0][1] == []
    assert got[0][2].split("\n")[0] == 'Parameter type error: "b", expected number, but got string. You need to change the input and try again.'
    assert got[1][:2] == ([], ["b", "g"]) and got[1][2] == 'Missing required parameters: "b", "g". You need to change the input and try again.'
    assert got[2][1] == ["a", "b", "g"]
    assert got[3][0] == [("e", "object", "array"), ("g", "string", "integer")] and got[3][1] == []
    assert got[4][0] == [("a", "integer", "number"), ("c", "number", "boolean"), ("h", "boolean", "integer")]
