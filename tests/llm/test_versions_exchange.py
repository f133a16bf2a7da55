"""Operator 8: the texts are shuffled once for both joins."""

import re

from saleslens.llm import versions as v


def test_both_joins_share_one_exchange_of_the_texts(docs_of):
    spark = docs_of([(1, "a")]).sparkSession
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, value in zip(names, ("false", "-1")):
            spark.conf.set(n, value)
        docs = docs_of([(i, f"line {i}\nanother {i % 3} line\n" * (i % 5)) for i in range(30)])
        plan = v.fingerprint_versions(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, value in zip(names, before):
            spark.conf.set(n, value)
    assert len(re.findall(r"ReusedExchange \[[^\]]*doc#", plan)) == 1
