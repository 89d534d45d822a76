"""Every operator on tables with nulls, repeated rows, odd texts, no rows and columns of clashing names."""

import pytest

from panelforge.llm import decontaminate, licenses, linedups, mixing, neardup, pii, secrets, sharding, toxicity, transport

OPERATORS = {
    "op1": lambda docs, side: sharding.op1_sampled_splitters(docs),
    "op2": lambda docs, side: pii.op2_weak_labels(docs),
    "op3": lambda docs, side: transport.op3_transport_stream(docs),
    "op4": lambda docs, side: licenses.op4_license_dice(docs),
    "op5": lambda docs, side: decontaminate.op5_suffix_automaton(docs, side["benchmark"]),
    "op6": lambda docs, side: neardup.op6_divide_skip(docs),
    "op7": lambda docs, side: linedups.op7_repeated_lines(docs),
    "op7p": lambda docs, side: linedups.op7_repeated_passages(docs),
    "op8": lambda docs, side: secrets.op8_secret_forest(docs),
    "op9": lambda docs, side: toxicity.op9_weak_supervision(docs, side["labels"]),
    "op10": lambda docs, side: mixing.op10_mix_sources(docs),
}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside or return.
CLASH = "shard int, slot int, size string, key int, row int, head int, token string, spans string, base int, media string, score string, predicted int, n_items int, target int, taken int, line string, n int, law int"


@pytest.fixture(scope="module")
def side(spark):
    return {
        "benchmark": spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (None, None), (1, "")], "item_id long, text string"),
        "labels": spark.createDataFrame([(0, 1, 1), (0, 1, 1), (3, 0, None), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int"),
    }


def rows_of(prose):
    long = "1" * 60_000 + " " + "a@b." + "c." * 20_000 + " " + "+1" + " " * 20_000 + "word " * 20_000
    texts = [None, "", " \n\n ", "\U0001f600\u00e9", *prose(4, 60, 3), long, "same line\n" * 500]
    rows = [(i, t, "en", None if i % 3 else "s", None) for i, t in enumerate(texts)]
    return rows + [rows[4], rows[4], rows[0], (None, texts[4], None, None, 5), (None, texts[4], None, None, 5), (None, None, None, None, None), (4, texts[5], "de", "s", 1)]


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, prose, side, name):
    rows = rows_of(prose)
    plain = spark.createDataFrame(rows, COLUMNS)
    found = OPERATORS[name](plain, side)
    got = found.collect()
    if name != "op8" and name != "op4":
        assert len(got) == len(rows)
    assert {r.doc_id for r in got} <= {r[0] for r in rows}
    more = spark.createDataFrame([(*r, *[None] * len(CLASH.split(", "))) for r in rows], f"{COLUMNS}, {CLASH}")
    again = OPERATORS[name](more, side)
    assert again.columns == found.columns
    if name not in ("op1", "op10"):  # which of equal rows gets which place is open there
        assert sorted(map(repr, again.collect())) == sorted(map(repr, got))


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, side, name):
    assert OPERATORS[name](spark.createDataFrame([], COLUMNS), side).collect() == []
