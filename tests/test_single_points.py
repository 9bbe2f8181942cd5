from docweave.operators import clusters, manifold


def test_a_pool_of_one_point_has_no_edges_and_no_neighbours(spark):
    """Their empty frames keep the type of the pool's name."""
    rows = [("one", "x", [1.0, 2.0])] + [("three", str(i), [float(i * i), 0.0]) for i in range(3)]
    points = spark.createDataFrame(rows, "pool string, item string, x array<double>")
    edges = {(r.pool, r.d, r.a, r.b) for r in clusters.spanning_trees(points, "pool").collect()}
    assert edges == {("three", 1.0, "0", "1"), ("three", 3.0, "1", "2")}
    found = {(r.pool, r.item, r.other) for r in manifold.neighbours(points.selectExpr("*", "x AS v"), "pool", 1).collect()}
    assert found == {("three", "0", "1"), ("three", "1", "0"), ("three", "2", "1")}
