import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opinara.functions import parse
from opinara.functions.schema import ASPECTS, POLARITIES


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        (None, {}),
        ("", {}),
        ("no labels here", {}),
        ("{}", {}),
        ('{"service": "positive"}', {"service": "positive"}),
        ('```json\n{"Food-Quality": " Negative "}\n```', {"food_quality": "negative"}),
        ("{“service”: “neutral”}", {"service": "neutral"}),
        ("{service: positive, location: conflict}", {"service": "positive", "location": "conflict"}),
        ('{service": "positive"}', {"service": "positive"}),
        ("{'service': 'positive'}", {"service": "positive"}),
        ('[{"aspect": "service", "polarity": "positive"}, {"category": "location", "sentiment": "negative"}]', {"service": "positive", "location": "negative"}),
        ('[{"service": "positive"}, {"food_quality": "negative"}]', {"food_quality": "negative"}),
        ('{"service": {"polarity": "positive"}}', {"service": "positive"}),
        ('{"weather": "positive"}', {}),
        ('<think>{"service": "negative"}</think>{"service": "positive"}', {"service": "positive"}),
        ('<think>{"service": "negative"}</think>nothing', {"service": "negative"}),
        ('{"service": "positive"} and later {}', {}),
        ('{"service": "positive"} and later []', {"service": "positive"}),
        ('{"service": "positive", "service": "negative"}', {"service": "negative"}),
        ('{"service": "positive",} [note "x] {"location": "neutral"', {"service": "positive"}),
        ('[see "menu] {"location": "neutral"}', {"location": "neutral"}),
        ("[it isn't clear] {'location': 'neutral'}", {"location": "neutral"}),
        ('{"a": {"service": "positive"}, "b": }', {"service": "positive"}),
        ('{"note": "as in {service: positive}", "location": "negative"}', {"service": "positive"}),
        ('{"service": positive, "n": 3, "x": null, "y": [1, 2.5]}', {"service": "positive"}),
        ('{"service": "positive"]', {}),
        ('{"service": "posi', {}),
        ("[{'aspect': '', 'category': 'Drinks Prices', 'sentiment': 'NEUTRAL'},]", {"drinks_prices": "neutral"}),
        ('{"service": 5} {"food_quality": ["positive"]}', {}),
        ("{" * 3000 + '"service": "positive"', {}),
        ("[" * 3000 + "]" * 3000 + '{"service": "positive"}', {"service": "positive"}),
    ],
)
def test_read_labels(text, labels):
    assert parse.read_labels(text) == labels


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from(ASPECTS), st.sampled_from(POLARITIES)), st.text(alphabet="abc <>\n.", max_size=20))
def test_round_trip(labels, noise):
    import json

    assert parse.read_labels(noise + json.dumps(labels)) == labels


def test_first_object():
    assert parse.first_object('x {"PER": ["a"], "n": {"m": 1}} {"b": 2}') == {"PER": ["a"], "n": {"m": 1}}
    assert parse.first_object("none") == parse.first_object("{broken}") == parse.first_object("{open") == parse.first_object(None) == {}


def test_flatten():
    assert parse.flatten({"a": {"b": True}, "c": [1.0, "x", None]}) == [".a.b:True", ".c:1.0", ".c:x"]


def test_long_texts_take_time_in_proportion():
    import time

    def seconds(n):
        text = '{"service": [1, {"a": "b"}], x ' * n
        began = time.perf_counter()
        parse.read_labels(text)
        return time.perf_counter() - began

    assert seconds(20_000) < 60 * max(seconds(1_000), 0.01)


def test_both_ways_of_extraction_agree(spark):
    texts = ['<think>{</think>Map: {"service": "positive"} end', '{"Service ": "NEGATIVE", "x": "y"}', "{}", '{"x": "y"}', '{"x": "y"} {}', "{service: positive}", '{"service": "positive", "service": "negative"}', '{"service": 3}', None, "", '{"a": "\\u0041", "location": "neutral"}', "{'service': 'positive'}"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.m for r in df.select("k", parse.extract_labels("t").alias("m")).collect()}
    assert got == {i: parse.read_labels(t) for i, t in enumerate(texts)}
