"""Features against brute force on small tables."""

import datetime

import numpy as np
import pytest

from tessera.operators import featuring as A


def vectors(model, df, key="k"):
    return {r[key]: r["features"].toArray() for r in model.transform(df).collect()}


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(11)
    cities = ["A"] * 12 + ["B"] * 9 + ["C"] * 3 + ["D"] * 3 + ["E"]
    data = [(i, float(r.integers(1, 50)) if i % 6 else None, float(i), datetime.date(2024, 1, 1) + datetime.timedelta(7 * i) if i % 5 else None, cities[i] if i % 9 else None, "xy"[i % 2]) for i in range(28)]
    return data, spark.createDataFrame(data, "k int, sqft double, rooms double, sold date, city string, kind string")


def test_numbers_calendar_and_rare_levels(spark, rows):
    data, df = rows
    m = A.fit_features(df, ["sqft", "rooms"], ["city"], ["sold"], max_levels=3)
    assert m.names == ["sqft", "rooms", "sold_year", "sold_month", "sold_day", "sold_weekday", "city_A", "city_B", "city_infrequent"]
    middle = float(np.median([x[1] for x in data if x[1] is not None]))
    days = [x[3] for x in data if x[3]]
    got = vectors(m, df)
    for k, sqft, rooms, sold, city, _ in data:
        city = city or "A"
        parts = [sold.year, sold.month, sold.day, sold.weekday()] if sold else [float(np.median([f(d) for d in days])) for f in (lambda d: d.year, lambda d: d.month, lambda d: d.day, lambda d: d.weekday())]
        want = [middle if sqft is None else sqft, rooms, *parts, city == "A", city == "B", city not in "AB"]
        assert got[k] == pytest.approx([float(x) for x in want])
    assert {s for _, s, _ in ((n, tuple(c), t) for n, c, t in m.lineage())} == {("sqft",), ("rooms",), ("sold",), ("city",)}


def test_crosses_equal_products(spark, rows):
    data, df = rows
    for only in (True, False):
        m = A.fit_features(df, ["sqft", "rooms"], ["city", "kind"], max_levels=10, degree=3, interaction_only=only, fill_level="constant")
        names, got = m.names, vectors(m, df)
        assert len(set(names)) == len(names) and "sqft rooms" in names and "city_A kind_x" in names and "sqft city_B kind_y" in names
        assert ("sqft^2" in names) is (not only) and ("sqft^2 city_A" in names) is (not only) and not any("city_A city_B" in n for n in names)
        at = {n: i for i, n in enumerate(names)}
        assert all(len(v) == len(names) for v in got.values())
        for v in got.values():
            for n in names:
                want = 1.0
                for factor in n.split(" "):
                    base, _, power = factor.partition("^")
                    want *= v[at[base]] ** int(power or 1)
                assert v[at[n]] == pytest.approx(want)


def test_scales_unknown_levels_and_text(spark, rows):
    _, df = rows
    m = A.fit_features(df, ["rooms"], ["kind"], scale="standard")
    x = np.array([v[0] for v in vectors(m, df).values()])
    assert x.mean() == pytest.approx(0) and x.std() == pytest.approx(1)
    assert vectors(m, spark.createDataFrame([(1, None, "z"), (2, 13.5, None)], "k int, rooms double, kind string"))[1].tolist() == [0.0, 0.0, 0.0]
    t = spark.createDataFrame([(1, "$1,000", "2024-03-05"), (2, "2,000", None), (3, "many", "03/07/2024")], "k int, price string, sold string")
    got = vectors(A.fit_features(t, ["price"], dates=["sold"]), t)
    assert got[3].tolist() == [1500.0, 2024.0, 3.0, 7.0, 3.0] and got[1].tolist() == [1000.0, 2024.0, 3.0, 5.0, 1.0]
    assert A.fit_features(df, ["rooms"], scale="robust").scale["rooms"] == (13.5, 13.5) and A.fit_features(df, ["rooms"], scale="minmax").scale["rooms"] == (0.0, 27.0)


def test_edges(spark, rows):
    _, df = rows
    none = A.fit_features(df.limit(0), ["sqft"], ["city"], ["sold"], degree=2)
    assert none.names[:2] == ["sqft", "sold_year"] and len(vectors(none, df)[3]) == len(none.names)
    with pytest.raises(ValueError, match="two features"):
        A.fit_features(df.withColumnRenamed("rooms", "sold_year"), ["sold_year"], dates=["sold"])
    with pytest.raises(ValueError, match="scale"):
        A.fit_features(df, ["sqft"], scale="log")


def test_polynomial_model_finds_a_product(spark):
    df = spark.createDataFrame([(float(a), float(b), 3.0 * a * b + 1) for a in range(6) for b in range(6)], "a double, b double, label double")
    f = A.fit_features(df, ["a", "b"], degree=2, interaction_only=True)
    pred = A.fit_on(df, f, "linear", "regression").transform(f.transform(df))
    assert max(abs(r["label"] - r["prediction"]) for r in pred.collect()) < 1e-6
