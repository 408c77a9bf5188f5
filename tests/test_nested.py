import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbarium.operators import nested


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def found(spark, payloads):
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "raw_id long, payload string, record string")
    n = nested.flatten_payloads(df, "raw_id", "payload", typed=False)
    return rows(n.where("filled and child <> 'entries'").select("record", "entry_pos", "child", "child_pos"))


def test_every_shape(spark):
    d = {"language": "en", "text": "a"}
    got = found(
        spark,
        [
            json.dumps({"entries": [{"headword_native": "x", "definitions": [d, None, {"text": " "}, "b", ""]}]}),
            json.dumps([{"definitions": {"en": "a", "fr": "b"}}, None, {"definitions": d}]),
            json.dumps({"meta": {}, "result": {"payload": {"vocabulary": [{"cross_references": {"wiki": [{"definition": ""}, {"notes": "n"}], "video": [{"reliability_score": 0}]}}]}}}),
            json.dumps({"entry": {"example_sentences": json.dumps([{}, {"source": {"url": "", "pages": [3]}}])}}),
            json.dumps({"headword_native": "x", "definitions": "plain"}),
            None, "", "{\"entries\": [", "null", "[]", "{}", "[NaN]", "7", "[" * 5000, "[" * 5000 + "]" * 4999, "{\"a\":" * 3000 + "[1,]" + "}" * 3000,
        ],
    )
    assert got == [
        (0, 0, "definitions", 0), (0, 0, "definitions", 3),
        (1, 0, "definitions", 0), (1, 0, "definitions", 1), (1, 2, "definitions", 0),
        (2, 0, "cross_references", 1), (2, 0, "cross_references", 2),
        (3, 0, "example_sentences", 1),
        (4, 0, "definitions", 0),
    ]


def test_typed_tables_and_links(spark):
    p = json.dumps({"entries": [{"headword_native": "h\ud800", "example_sentences": {"jejueo": "t", "korean": "c", "source": {"url": "u"}}, "cross_references": [{"definition": "d", "reliability_score": "0.5"}]}]})
    df = spark.createDataFrame([(7, p), (7, p), (None, None)], "raw_id long, payload string")
    t = nested.payload_tables(nested.flatten_payloads(df, "raw_id", "payload"), "raw_id")
    assert rows(t["entries"]) == [(7, 0, "h�", None, None)] * 2
    assert rows(t["example_sentences"]) == [(7, 0, 0, "object", "t", "c", None, "u")] * 2
    assert t["cross_references"].first()["reliability_score"] == 0.5
    parts = nested.subtype_tables(nested.flatten_payloads(df, "raw_id", "payload"), "raw_id")
    assert set(parts) == {("entries", "entry"), ("example_sentences", "object"), ("cross_references", "object")}
    assert parts["example_sentences", "object"].columns == ["raw_id", "entry_pos", "child_pos", "target", "contact", "english", "source_url"]
    assert parts["entries", "entry"].count() == 2


def test_variants_have_their_own_tables(spark):
    p = json.dumps([{"definitions": ["a", {"text": "b"}, [["c"]]]}, {"definitions": {"en": "d"}}, {"definitions": {"wiki": [{"text": "e"}], "x": "f"}}])
    nodes = nested.flatten_payloads(spark.createDataFrame([(1, p)], "raw_id long, payload string"), "raw_id", "payload")
    parts = nested.subtype_tables(nodes, "raw_id")
    assert {v: t.columns[3:] for (k, v), t in parts.items() if k == "definitions"} == {
        "scalar": ["text"], "object": ["language", "text"], "list/scalar": ["text"], "keyed": ["language", "text"], "grouped/object": ["language", "text"], "grouped/scalar": ["text"]}
    got = nested.payload_tables(nodes, "raw_id")["definitions"]
    assert rows(got.select("entry_pos", "child_pos", "variant", "text")) == [(0, 0, "scalar", "a"), (0, 1, "object", "b"), (0, 2, "list/scalar", "c"), (1, 0, "keyed", "d"), (2, 0, "grouped/object", "e"), (2, 1, "grouped/scalar", "f")]
    assert nested.payload_tables(nodes.where("false"), "raw_id")["definitions"].count() == 0


@pytest.mark.parametrize("depth", [900, 1500, 5000, 100_000])
def test_any_depth(spark, depth):
    entry = '{"definitions": [{"text": "a"}, null, "b"]}'
    wrapped = '{"w":' * depth + "[" * depth + entry + "]" * depth + "}" * depth
    lists = '[{"definitions": ' + "[" * depth + '"c"' + "]" * depth + "}]"
    groups = '[{"cross_references": ' + '{"g":' * depth + '[{"notes": "n"}]' + "}" * depth + "}]"
    value = '[{"definitions": [{"text": ' + '[{"k":' * depth + "1" + "}]" * depth + "}]}]"
    got = found(spark, [wrapped, lists, groups, value])
    assert got == [(0, 0, "definitions", 0), (0, 0, "definitions", 2), (1, 0, "definitions", 0), (2, 0, "cross_references", 0), (3, 0, "definitions", 0)]
    df = spark.createDataFrame([(0, groups), (1, value)], "raw_id long, payload string")
    t = nested.payload_tables(nested.flatten_payloads(df, "raw_id", "payload"), "raw_id")
    assert t["cross_references"].first()["variant"] == "grouped/object"
    assert len(t["definitions"].first()["text"]) == len('{"k": ' * depth) + 3 * depth + 1 if depth > 3000 else True


def plain_children(node, kind, auto):
    """Brute force: positions by plain recursion."""
    s = auto.state(node, kind)
    if s == "list":
        return [c for x in node for c in (plain_children(x, kind, auto) if isinstance(x, list) else [x])]
    if s == "keyed":
        return list(node.values())
    if s == "grouped":
        return [c for v in node.values() for c in plain_children(v, kind, auto)]
    if s == "encoded":
        return plain_children(json.loads(node), kind, auto)
    return [] if s == "null" else [node]


LEAF = st.none() | st.booleans() | st.integers(-5, 5) | st.sampled_from(["", " ", "a", "[]", '[{"text": "x"}]', "{"])
TREE = st.recursive(LEAF, lambda t: st.lists(t, max_size=4) | st.dictionaries(st.sampled_from(["text", "language", "wiki", "en", "x"]), t, max_size=4), max_leaves=25)


@given(TREE)
def test_same_as_plain_recursion(tree):
    auto = nested.ShapeAutomaton()
    for kind in nested.KINDS:
        assert [c for _, c, _ in auto.children(tree, kind)] == plain_children(tree, kind, auto)
    text = json.dumps(tree)
    assert nested._read_deep(text) == tree


@given(st.text(alphabet='[]{}:,"a1 tru-e.0\\n', max_size=14))
def test_deep_reader_reads_what_json_reads(text):
    try:
        want = json.loads(text)
    except ValueError:
        want = "broken"
    try:
        got = nested._read_deep(text)
    except ValueError:
        got = "broken"
    assert got == want


def test_empty_and_long(spark):
    df = spark.createDataFrame([], "raw_id long, payload string")
    assert nested.flatten_payloads(df, "raw_id", "payload").count() == 0
    big = json.dumps([{"definitions": ["w" * 50] * 20000}])
    assert len(found(spark, [big])) == 20000


def test_child_table(spark):
    s = "rec_id long, variant string, xs array<struct<rec_id:string,text:string>>"
    df = spark.createDataFrame([(1, "v", [("a", " "), None, ("a", " ")]), (2, None, None), (3, "", [])], s)
    t = nested.child_table(df, ["rec_id"], "xs")
    assert t.columns == ["rec_id", "child_pos", "variant", "xs_rec_id", "text"]
    assert rows(t) == [(1, 0, "rec_id", "a", " "), (1, 2, "rec_id", "a", " ")]
    assert nested.child_table(df, ["rec_id"], "xs", keep_empty=True).count() == 3
    plain = df.select("rec_id", F.array(F.lit("q"), F.lit("")).alias("xs"))
    assert rows(nested.child_table(plain, ["rec_id"], "xs"))[0] == (1, 0, "value", "q")
