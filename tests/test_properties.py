"""Properties on random inputs: decimals, pipe rows, sentences, p-values."""

import re
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verifold.functions import distribution, documents, locators
from verifold.functions.decimals import strict_decimal


def test_decimals_keep_value_and_precision(spark):
    texts = st.lists(st.from_regex(r"[+-]?([0-9]{1,12}(\.[0-9]{0,10})?|\.[0-9]{1,10})([eE][+-]?[0-9]{1,2})?", fullmatch=True), min_size=40, max_size=60)

    @settings(max_examples=8, deadline=None)
    @given(texts)
    def check(rows):
        d = spark.createDataFrame([(x,) for x in rows], "t string").select("t", strict_decimal(F.col("t")).alias("x"))
        for r in d.collect():
            value = Decimal(r["t"])
            if abs(value.adjusted()) > 40:
                assert r["x"] is None
            else:
                assert Decimal(int(r["x"]["u"])).scaleb(r["x"]["e"]) == value and r["x"]["e"] == value.as_tuple().exponent

    check()


@given(st.lists(st.text(alphabet="ab |\\\t", max_size=8), min_size=1, max_size=5))
def test_pipe_rows_split_where_bars_are_not_escaped(cells):
    escaped = [c.replace("\\", "").replace("|", "\\|").strip(" \t") for c in cells]
    line = "| " + " | ".join(escaped) + " |"
    assert [line[a:b] for a, b in documents.split_row(line, 0)] == escaped


@given(st.text(alphabet="aB.!? \n12éFig", max_size=60))
def test_sentences_tile_a_block(text):
    found = documents.sentences(text, 0, len(text))
    assert [s for a, s in found] == [s.strip() for a, s in found] and [a for a, _ in found] == sorted(a for a, _ in found)
    assert re.sub(r"\s", "", "".join(s for _, s in found)) == re.sub(r"\s", "", text)


@given(st.recursive(st.integers(0, 99).map(str) | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(alphabet="a/~b", max_size=3), x, max_size=3), max_leaves=8), st.data())
def test_pointers_reach_every_leaf(value, data):
    at, pointer = value, ""
    while isinstance(at, (list, dict)) and at:
        key = data.draw(st.sampled_from(sorted(at) if isinstance(at, dict) else list(range(len(at)))))
        pointer += "/" + str(key).replace("~", "~0").replace("/", "~1")
        at = at[key]
    assert locators.walk(value, pointer) == at


@given(st.floats(0.01, 30), st.floats(1, 200), st.floats(1, 200))
def test_p_values_are_probabilities_that_fall(x, a, b):
    for kind, args in (("t", (a, None)), ("F", (a, b)), ("chi2", (a, None)), ("z", (None, None))):
        p, q = distribution.p_value(kind, *args, x), distribution.p_value(kind, *args, x * 1.1)
        assert 0 <= q <= p + 1e-12 <= 1 + 2e-12
