"""Columns that are named like results or steps of an operator do not change what it gives."""

import pytest
from pyspark.sql import functions as F

from rolefit.llm import linededup, mixing, quality
from tests.llm.test_llm import odd_rows

OPERATORS = {
    "lines": (linededup.line_dedup, "deleted n_runs n_lines n_deleted clean_text line pos at"),
    "quality": (quality.quality_rules, "n_common_words kept base_failed n_words line words f w n line_key"),
    "mixing": (mixing.mix_sources, "taken passes target source_size slot rank cell size"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(spark, name):
    operator, clashing = OPERATORS[name]
    rows = [r[:4] for r in odd_rows()]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    wide = plain.withColumns({c: F.lit("clash") for c in clashing.split()})
    want = operator(plain)
    got = operator(wide)
    assert len(set(got.columns)) == len(got.columns)
    passed = [c for c in clashing.split() if c not in want.columns]
    assert {tuple(r) for r in got.select(*passed).distinct().collect()} == {("clash",) * len(passed)}
    same = [sorted(map(tuple, f.select(*want.columns).collect()), key=repr) for f in (got, want)]
    assert same[0] == same[1]
