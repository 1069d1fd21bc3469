from satchel.operators import evoclusters
from satchel.plans import catalog


def test_migka_is_registered_with_its_own_population_and_generations(spark, monkeypatch):
    taken = {}
    monkeypatch.setitem(evoclusters.ALGORITHMS, "MIGKA", lambda bags, **options: taken.update(options) or spark.range(1))
    catalog.queries()["evolve_migka"](spark, "/root/testdata/sf0.001")
    assert "n" not in taken and "generations" not in taken
