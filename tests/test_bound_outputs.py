"""Bindings of functions with parameters: each output is made once a probe, whatever number of pairs ask for it."""

from kinfold.plans import live


def test_each_bound_output_is_made_once(spark):
    calls = []

    def fn(px, k):
        calls.append(k)
        return live.GRIDS["brightness_add"].fn(px, k)

    battery = spark.createDataFrame([(i, [(i * 31 + n * 7) % 200 for n in range(64)]) for i in range(3)], "probe_id long, px array<int>")
    pairs = [("g", "identity"), ("g", "invert"), ("g", "rotate_180")]
    told = {(r["a"], r["b"]): (r["relation"], r["direction"], r["binding_a"]) for r in live.probe_judge(battery, grids={"g": live.Grid("k", (0, 5, 10, 20), 5, fn)})(pairs).collect()}
    assert told["g", "identity"] == ("SUBSUMPTION", "A_SUBSUMES_B", "k=0") and told["g", "invert"][1] == "NONE"
    assert len(calls) == 4 + len(pairs)  # the four values, and the default for the distances of each pair
