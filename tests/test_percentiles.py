import random

import pytest
from pyspark.sql import functions as F

from understory.operators import aggregates, models, stats

PS = {"median": 0.5, "p10": 0.1, "p995": 0.995, "least": 0.0, "greatest": 1.0}


@pytest.mark.parametrize("keys", [[], ["k"], ["k", "j"]])
def test_spread_percentiles_equal_the_built_in(spark, keys):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.randrange(2), r.choice([None, 7.0, float(r.randrange(40)), r.gauss(0, 5)])) for _ in range(3000)] + [("one", 0, 3.5), ("none", 0, None)]
    df = spark.createDataFrame(rows, "k string, j int, v double")
    aggs = [F.count("v").alias("n")]
    a, b = (aggregates.with_percentiles(df, keys, aggs, F.col("v"), PS, spread) for spread in (True, False))
    show = lambda d: sorted([tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in x) for x in d.select(*keys, "n", *PS).collect()], key=repr)
    assert show(a) == show(b)


def test_operators_give_the_same_when_spread(spark, monkeypatch):
    r = random.Random(2)
    df = spark.createDataFrame([(r.choice("ab"), "g", r.uniform(0, 9), r.uniform(5, 20), k % 3) for k in range(800)], "kind string, grp string, s double, e double, fold int")
    works = [
        lambda: aggregates.summary(df, "s", ["kind"]), lambda: aggregates.height_summary(df, "e"), lambda: aggregates.normalised_mad(df, "s", ["kind"]), lambda: aggregates.normalised_mad(df, "s"), lambda: aggregates.change_summary(df, "e", F.col("s") > 3),
        lambda: models.median_prior(df, "kind", "grp", "s", "e", 10), lambda: models.fold_prior(df, "fold", 3, "kind", "grp", "s", "e", 10), lambda: stats.noise_table(df.select((F.col("fold") + 1).alias("scale"), F.col("s").alias("delta")), 1),
    ]
    show = lambda d: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in d.select(*sorted(d.columns)).collect()], key=repr)
    small = [show(w()) for w in works]
    monkeypatch.setattr(aggregates, "large", lambda df: True)
    assert [show(w()) for w in works] == small
