"""Which rules are found does not hang on how wide the widest row is."""

from dyadflow.llm import urls


def test_one_wide_row_changes_no_rule(spark):
    """Three tokens are bad only together; sixteen others, each frequent, meet in a single row."""
    rows = [(["a", "b", "c"], True)] * 20 + [(x, False) for x in (["a", "b"], ["b", "c"], ["a", "c"]) for _ in range(20)]
    others = [f"n{i:02d}" for i in range(16)]
    rows += [([x], bad) for x in others for bad in [True] * 6 + [False] * 12]
    for last in (others[:2], others):
        mined = urls.mine_rules(spark.createDataFrame([*rows, (last, False)], "tokens array<string>, bad boolean"), 0.01, 0.7, 5)
        assert [(r.antecedent, r.confidence) for r in mined.collect()] == [(["a", "b", "c"], 1.0)]
