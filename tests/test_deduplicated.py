import __spark_entry__ as entry
from boxframe.plans import evaluation, proxies, registry


def test_evaluation_leaves_out_duplicates_and_parts(spark, sf_dir):
    """Predictions that are kept are fewer, and every evaluation counts just these."""
    raw, kept = proxies.pred(spark, sf_dir), evaluation.whole_pred(spark, sf_dir)
    n = kept.count()
    assert 0 < n < raw.count()
    assert kept.filter("not exists(boxes, b -> b.role = 0) or not exists(boxes, b -> b.role = 2)").count() == 0
    queries = entry.queries()
    for name in ("eval_exact_overall", "eval_soft_overall", "eval_by_size", "eval_by_group", "eval_by_group_soft", "eval_cv_union", "eval_images"):
        assert queries[f"{name}_deduplicated"](spark, sf_dir).selectExpr("sum(pred_total)").first()[0] == n, name
    assert queries["score_table_deduplicated"](spark, sf_dir).collect() != queries["score_table"](spark, sf_dir).collect()
    assert entry.entry(spark).first().pred_total == queries[registry.FLAGSHIP](spark, "/root/testdata/sf0.001").first().pred_total == evaluation.whole_pred(spark, "/root/testdata/sf0.001").count()
