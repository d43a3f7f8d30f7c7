"""The rule on distinct words judges texts of every length."""

import numpy as np
from test_ops import docs, extended, prose, rows

from matchstats.llm import quality_cascade


def test_long_word_salad_is_rejected(spark):
    salad = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    mix = lambda n: " ".join(salad[i] for i in np.random.default_rng(n).integers(0, 40, n))
    many = " ".join(f"clean{i}" for i in np.random.default_rng(1).integers(0, 1500, 20000))
    texts = [mix(300), mix(2000), mix(2001), mix(4000), mix(20000), many, prose(301, 2000), "", None]
    d = extended(docs(spark, texts))
    got = {r.doc_id: r.rejected_by for r in quality_cascade.cascade(d).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 4), "few_distinct"), 0: "few_distinct", 5: None, 6: None, 7: "base", 8: "base"}
    assert rows(quality_cascade.kept_documents(d), "doc_id") == [(5,), (6,)]
