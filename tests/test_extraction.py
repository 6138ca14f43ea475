"""Scans, structure, selection and admission on small papers, one behavior each."""

import re

import pytest
from pyspark.sql import functions as F

from verifold.functions import documents, grammar
from verifold.operators import extraction as X

PAPER = """# A study
## Abstract
The accuracy was 0.87 (95% CI: 0.81, 0.93). We recruited n = 412 patients and _N_ = 30 controls.
> 97 patients were enrolled.

## 3. Results ##
### Secondary outcome
Sensitivity was 0.92 ± 0.03 and p < 0.001, see Figure 3. In 2019 it was 10,000 as reported [12].
Smith et al. found 0.55. The mean é😀 weight reached 42.5 kg.
With a learning rate 0.01 and python 3.11 on the x-axis 5, doi: 10.1234/5 was 6.

Table 2: Outcomes

| Model | AUC | n |
|:--|---|---|
| Ours \\| new | 0.91 | 40 |
| Base | 12–15% | |

## References
1. Foo 2020.
"""


@pytest.fixture(scope="module")
def papers(spark):
    return spark.createDataFrame([(1, PAPER), (2, None), (3, ""), (4, "no numbers\r\nat all")], "doc_id long, text string")


def test_every_value_is_claimed_or_refused_once(papers):
    claims, refusals = X.extract(papers)
    scanned = X.scan(X.normalize(papers)).select("doc_id", "start", "end")
    both = claims.select("doc_id", "start", "end").unionByName(refusals.select("doc_id", "start", "end"))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, scanned.collect()))
    causes = {r["cause"] for r in refusals.collect()}
    assert causes <= set(X.SELECTION_CAUSES) | set(X.ADMISSION_CAUSES)


def test_claims(papers):
    claims, _ = X.extract(papers)
    got = {r["value"]: (r["metric"], r["units"], r["section"], r["parsed"]["kind"]) for r in claims.collect()}
    assert got["0.87"] == ("accuracy", None, "abstract", "Point")
    assert got["95% CI: 0.81, 0.93"] == ("95% CI", None, "abstract", "Interval")
    assert got["0.92 ± 0.03"] == ("Sensitivity", None, "results", "PlusMinus")
    assert got["< 0.001"] == ("p", None, "results", "Bound")
    assert got["42.5"][1:] == ("kg", "results", "Point")
    assert got["0.91"] == ("Table 2 Ours \\| new AUC", None, "table", "Point")
    assert got["12–15"][0] == "Table 2 Base AUC"


def test_refusals(papers):
    _, refusals = X.extract(papers)
    got = {(r["value"], r["cause"]) for r in refusals.collect()}
    assert {("3", "figure_number"), ("2019", "year"), ("12", "reference_numeral"), ("0.55", "related_work"), ("97", "no_named_metric"), ("1", "reference_numeral")} <= got
    assert ("0.01", "hyperparameter") in got or ("0.01", "doi_digits") in got


def test_spans_are_code_points(papers):
    text = documents.normalize(PAPER)
    for r in X.scan(X.normalize(papers)).collect():
        assert text[r["start"] : r["end"]] == r["value"]
        assert text[max(0, r["start"] - 32) : r["start"]] == r["before"] and text[r["end"] : r["end"] + 16] == r["after"]


def test_scan_matches_one_pass(spark):
    texts = [PAPER, "a>5 >> 6\n> 7\n  > > 8", "12-15 2025–12–18 1e-5 .5 x.5 I²<50 −3 -4 %-5 5% CI [1,2]", "١٢ 1,234.5 12,34"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in X.scan(d).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["value"]))
    for i, t in enumerate(texts):
        quoted = re.sub(r"(?m)^([ \t]*)>", rf"\1{grammar.QUOTE}", t)
        assert got.get(i, []) == [(m.start(), m[0]) for m in re.finditer(grammar.VALUE, quoted)], t


def test_headings(papers):
    got = [(r["title"], r["hint"]) for r in X.headings(papers).where("doc_id = 1").orderBy("start").collect()]
    assert got == [("a study", "other"), ("abstract", "abstract"), ("results", "results"), ("secondary outcome", "results"), ("references", "references")]


def test_lines(papers):
    got = [(r["start"], r["line"]) for r in X.lines(papers).where("doc_id = 1").orderBy("line_no").collect()]
    assert all(PAPER[a : a + len(t)] == t for a, t in got) and len(got) == PAPER.count("\n") + 1


def test_study_parameters(papers):
    assert {(r["name"], r["value"]) for r in X.study_parameters(papers).collect()} == {("n", "412"), ("N", "30")}


def test_sample_size_needs_balanced_emphasis(spark):
    rows = ["n = 1", "*n* = 2", "__N__=3", "_n = 4", "mean_n_ = 5", "median = 6", "N_ = 7"]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r["value"] for r in X.study_parameters(d).collect()} == {"1", "2", "3"}


@pytest.mark.parametrize(
    ("text", "kind"),
    [("0.870", "Point"), ("10,000%", "Point"), ("≥ 3.5", "Bound"), ("p < 0.05", "Bound"), ("0.85 +/- 0.03", "PlusMinus"), ("12–15%", "Range"), ("~ 100", "Approximate"), ("[0.1, 0.2]", "Interval"),
     ("95% CI 1.66–2.54", "Interval"), ("15–12", None), ("1 ± -2", None), ("12-15", None), ("abc", None), ("", None), (None, None), ("5 kg", None)],
)
def test_parse(spark, text, kind):
    r = grammar.with_parsed(spark.createDataFrame([(text,)], "t string"), "t", "p").first()
    assert (r["p"] and r["p"]["kind"]) == kind


def test_tables():
    cells = documents.cells_of(PAPER)
    assert [(c["row"], c["col"], c["text"]) for c in cells if c["row"] == 1] == [(1, 0, "Ours \\| new"), (1, 1, "0.91"), (1, 2, "40")]
    assert all(PAPER[c["start"] : c["end"]] == c["text"] for c in cells)
    assert documents.cells_of("| a | b |\n|---|\n") == []


def test_captioned_tables():
    text = "Table 3: Results\nSource DF F p\nGenotype 4 12.5<0.001\nError rate 8 – 0.3\n\nafter 5"
    got = {(c["header"], c["text"]) for c in documents.cells_of(text)}
    assert got == {
        ("Table 3 Genotype DF", "4"), ("Table 3 Genotype F", "12.5"), ("Table 3 Genotype p", "<0.001"), ("Table 3 Error rate DF", "8"), ("Table 3 Error rate p", "0.3"),
    }
    bare = documents.cells_of("Table 1.\nAlpha 1 2\nBeta 3 4 5\n")
    assert [c["header"] for c in bare] == ["Table 1 Alpha column 1", "Table 1 Alpha column 2", "Table 1 Beta column 1", "Table 1 Beta column 2", "Table 1 Beta column 3"]
    assert documents.cells_of("Table 1. x\nOne row\nAlpha 1 2\nBeta 3 4\n") == []


def test_sentences():
    text = "As in Fig. 2 by Smith, J. et al. it was 5. Then 1. more! "
    assert [s for _, s in documents.sentences(text, 0, len(text))] == ["As in Fig. 2 by Smith, J. et al. it was 5.", "Then 1.", "more!"]


def test_ungrounded(spark, papers):
    rows = [(1, 10_000, 10_004, "0.87"), (1, 45, 45, ""), (4, 0, 2, "no")]
    bad = X.ungrounded(spark.createDataFrame(rows, "doc_id long, start int, end int, value string"), papers)
    assert sorted(r["start"] for r in bad.collect()) == [45, 10_000]


def test_partitions_do_not_matter(papers):
    def out(d):
        claims, refusals = X.extract(d)
        return sorted(map(str, claims.collect())), sorted(map(str, refusals.collect()))

    assert out(papers.repartition(1)) == out(papers.repartition(7).orderBy(F.rand(3)))
