"""What the findings of round 4 named, on small fixtures."""

from cipherlake.operators import slicing


def test_f1_slices_are_found_without_broadcasts(spark):
    edge = 1 << slicing.SPAN_BITS
    texts = {edge - 100: "a = 7", edge - 60: "b = a", edge - 20: "c = b", edge + 20: "use(c)", 2 * edge - 1: "d = 'x'", 2 * edge: "d = d", 2 * edge + 47: "use(d)", 2 * edge + 48: "use(d)"}
    rows = [("a.py", i, t) for i, t in texts.items()] + [("b.py", 1, "a = 1"), ("b.py", 1, "a = 'y'"), ("b.py", 2, None), (None, 1, "a = 3"), ("b.py", None, "a = 4")]
    asked = [("a.py", edge + 20, "c"), ("a.py", edge + 20, "c"), ("a.py", edge + 20, "b"), ("a.py", edge + 29, "c"), ("a.py", 2 * edge + 47, "d"), ("a.py", 2 * edge + 48, "d"), ("b.py", 2, "a"), ("b.py", 1, "a"), (None, 2, "a"), ("b.py", None, "a"), ("b.py", 2, None)]
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsCount()
    found = slicing.backward_slices(spark.createDataFrame(rows, "path string, line long, text string"), spark.createDataFrame(asked, "path string, line long, var string"))
    got = sorted(map(tuple, found.collect()))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = store.executionsList(seen, 1000)
    plans = [ran.apply(i).physicalPlanDescription() for i in range(ran.size())]
    # What is joined by a broadcast is built in the driver, whose memory it outgrew on larger tables.
    assert plans and not any("Broadcast" in p for p in plans)
    assert got == [("a.py", edge + 20, "c", "7", "integer", edge - 100, "HIGH"), ("a.py", 2 * edge + 47, "d", "x", "string", 2 * edge - 1, "HIGH"), ("b.py", 2, "a", "y", "string", 1, "HIGH")]
