from docweave.operators import layout


def test_two_sorts_place_the_boxes(spark):
    """Both counts of spanning boxes come from one order."""
    boxes = spark.createDataFrame([(1, 1, 1, 0.0, 100.0, 5.0, 600.0)], "doc_id int, page int, ord int, x0 double, x1 double, y1 double, page_width double")
    placed = layout.page_order(boxes).select("doc_id", "page", "ord", "kind", "place")
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert sum(line.strip(" +-:*()0123456789").startswith("Sort [") for line in plan.splitlines()) == 2
    assert [tuple(r) for r in placed.collect()] == [(1, 1, 1, "left", 1)]
