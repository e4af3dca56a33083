"""Rows made by rule."""

from marlstone import connect
from marlstone.sources import sample


def test_sample(spark, tmp_path):
    made = sample.entities(spark, 5, 20, 7, seed=3)
    ses = connect(spark, sample.MODEL, f"file://{tmp_path}", segment_points=50)
    for name, df in made.items():
        ses[name].create(df)
    ses["Meter"].append_series("litres", rows=sample.points(spark, 4, 100).repartition("key").sortWithinPartitions("key", "ts"))
    ses.flush()
    assert {n: ses[n].count() for n in made} == {"District": 5, "Meter": 100, "Valve": 10, "Repair": 35}
    assert ses["Meter"].count("flow == null") > 0
    one = ses["District"].get(3, include=["devices"])
    assert len(one["devices"]) == 22 and {d["_type"] for d in one["devices"]} == {"Meter", "Valve"}
    assert ses.stats()["series"]["points"] == 400 and ses.stats()["series"]["segments"] == 8
    again = sample.entities(spark.newSession(), 5, 20, 7, seed=3)
    assert sorted(made["Meter"].collect(), key=str) == sorted(again["Meter"].collect(), key=str)
    assert made["Meter"].exceptAll(sample.entities(spark, 5, 20, 7, seed=4)["Meter"]).count() > 0
