import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from astrolane.operators.combine import WeightedCatalog, combine
from astrolane.operators.components import connected_components
from astrolane.operators.identity import IdentityIndex, IdentityQuery
from astrolane.operators.links import LinkRules, link
from astrolane.operators.match import MatchRules, cross_match, dense_ids, spherical_join
from astrolane.operators.selection import Cone, Shell, SkyPatch, selected
from astrolane.operators.weights import ConstantWeight, FKPWeight, InverseVarianceWeight, QualityMaskWeight, default_weight

A = [(10.0, -5.0, 0.1, 100.0, 10.0), (20.0, 0.0, 0.2, 200.0, 20.0), (30.0, 15.0, 0.3, 300.0, 30.0)]
B = [(10.0001, -5.0001, 0.1001, 110.0, 5.0), (30.0001, 15.0, 0.3001, 290.0, 50.0), (50.0, 5.0, 0.4, 999.0, 5.0)]


def catalogs(spark):
    make = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_index long, ra double, dec double, z double, v double, v_err double")
    return {"a": make(A), "b": make(B)}


def test_identities_on_the_toy_catalogs(spark):
    found = {dz: cross_match(catalogs(spark), MatchRules(5.0, dz)) for dz in (1e-2, 1e-5, None)}
    assert found[1e-2].rows.count() == 6 and found[1e-2].counts() == {"n_unique": 4, "n_multi": 2}
    assert found[1e-5].counts() == {"n_unique": 6, "n_multi": 0}
    assert found[None].multi_survey().count() == 4


@pytest.mark.parametrize("centre,spread,tol", [((40, 89.99), 0.02, 60), ((40, -89.995), 0.01, 30), ((0, 5), 0.02, 40), ((200, 80.5), 0.3, 120)])
def test_spherical_join_equals_all_pairs(spark, centre, spread, tol):
    rng = np.random.default_rng(3)
    dec = np.clip(centre[1] + rng.uniform(-spread, spread, 250), -90, 90)
    ra = (centre[0] + rng.uniform(-spread, spread, 250) / np.maximum(np.cos(np.radians(dec)), 1e-3)) % 360
    rows = spark.createDataFrame([(i, float(a), float(d)) for i, (a, d) in enumerate(zip(ra, dec))], "i long, ra double, dec double")
    got = sorted(map(tuple, spherical_join(rows, rows, tol).select("l_i", "r_i").collect()))
    d1, d2, da = np.radians(dec)[:, None], np.radians(dec)[None], np.radians(ra[:, None] - ra[None])
    h = np.sin((d1 - d2) / 2) ** 2 + np.cos(d1) * np.cos(d2) * np.sin(da / 2) ** 2
    want = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.degrees(2 * np.arcsin(np.sqrt(h))) * 3600 <= tol))]
    assert got == sorted(want)


def test_missing_redshift_keeps_a_pair_and_types_can_be_rejected(spark):
    two = lambda z, t: spark.createDataFrame([(0, 1.0, 1.0, z, t)], "row_index long, ra double, dec double, z double, z_type string")
    n = lambda a, b, rules: cross_match({"a": a, "b": b}, rules).counts()["n_unique"]
    assert n(two(float("nan"), "spec"), two(0.5, "phot"), MatchRules()) == 1
    assert n(two(0.1, "spec"), two(0.5, "phot"), MatchRules()) == 2
    assert n(two(0.1, "spec"), two(0.5, "phot"), MatchRules(dz_by_types={("phot", "spec"): None})) == 1
    assert n(two(0.1, "spec"), two(0.1, "phot"), MatchRules(reject_types={("phot", "spec")})) == 2
    assert MatchRules(dz_by_types={("a", "b"): 1.0}) == MatchRules(dz_by_types={("b", "a"): 1.0})


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 5)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 7 for i in range(200, 260)) and 5 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dense_ids_follow_the_order(spark):
    rows = spark.range(0, 1000).selectExpr("(id * 7919) % 1000 AS k").repartition(7)
    assert dense_ids(rows, ["k"], "n").where("n <> k").count() == 0


def test_links(spark):
    make = lambda name, rows: spark.createDataFrame([(name, *r) for r in rows], "dataset string, uid long, ra double, dec double, z double")
    s = 1 / 3600
    hosts = make("h", [(1, 15.0, 0.0, 0.05), (2, 15.0 + 0.4 * s, 0.0, 0.05), (3, 80.0, 0.0, None)])
    near, far = make("c", [(10, 15.0 + 0.2 * s, 0.0, 0.051)]), make("c", [(11, 15.0 + 5 * s, 0.0, 0.05)])
    rules = LinkRules("h", "c")
    assert link(hosts, near, rules).count() == 0 and link(hosts, far, rules).count() == 0
    both = link(hosts, near, LinkRules("h", "c", accept_ambiguous=True)).collect()
    assert [r["confidence"] for r in both] == [0.5, 0.5]
    one = link(hosts.where("uid = 1"), near, rules).first()
    assert one["confidence"] == 1.0 and math.isclose(one["dz"], -0.001, rel_tol=1e-4)
    blind = link(hosts.where("uid = 1"), make("c", [(12, 15.0, 0.0, float("nan"))]), rules).first()
    assert blind["dz"] is None
    assert link(hosts.where("uid = 3"), make("c", [(13, 80.0, 0.0, 0.1)]), rules).count() == 0
    with pytest.raises(ValueError):
        LinkRules("h", "c", sky_tol_arcsec=0)


def test_queries_on_an_index(spark):
    frames = catalogs(spark)
    index = IdentityIndex(cross_match(frames, MatchRules(5.0, 1e-2)).rows, MatchRules(5.0, 1e-2))
    q = IdentityQuery(index, frames)
    uid = index.lookup("b", 0)
    assert index.lookup("a", 0) == uid and index.datasets() == ["a", "b"] and index.multi_only().count() == 4
    assert [r["uid"] for r in q.from_selection([Cone(10, -5, 0.01), Shell(0.05, 0.2)]).collect()] == [uid]
    rows = {(r["dataset"], r["v"]) for r in q.partial_for([uid], ["v", "nothing"]).collect()}
    assert rows == {("a", 100.0), ("b", 110.0)}
    assert q.from_ids([uid, 99]).count() == 1 and q.from_foreign_ids("b", [0, 2]).count() == 2
    assert len(list(q.iter_partial([0, 1, 2], ["v"], 2))) == 2 and list(q.iter_partial([], ["v"], 2)) == []
    with pytest.raises(ValueError):
        next(q.iter_partial([0], ["v"], 0))
    with pytest.raises(KeyError):
        q.from_id(99)
    assert sorted(r["uid"] for r in index.restrict_to(["b"]).rows.collect()) == [0, 1, 2]


def test_combination_strategies(spark):
    rows = spark.createDataFrame([(0, "A", 100.0, 100.0), (0, "B", 110.0, 25.0), (1, "A", 200.0, 400.0), (1, "B", 210.0, 100.0), (2, "A", 5.0, 0.0), (2, "B", float("nan"), 1.0)], "uid long, survey string, value double, variance double")
    get = lambda s, **k: {r["uid"]: r for r in combine(rows, strategy=s, **k).collect()}
    best, ivar = get("best_only"), get("ivar_average")
    assert (best[0]["value"], best[0]["variance"], best[1]["value"]) == (110.0, 25.0, 210.0) and set(best) == {0, 1}
    assert math.isclose(ivar[0]["value"], 108) and math.isclose(ivar[0]["variance"], 20) and ivar[0]["surveys"] == "A,B"
    two = spark.createDataFrame([(0, "A", 100.0, 10.0), (0, "B", 200.0, 10.0)], rows.schema)
    assert math.isclose(combine(two, strategy="hyperparameter", alpha={"A": 1, "B": 3}).first()["value"], 175)
    assert get("unit_mean")[0]["variance"] is None
    with pytest.raises(ValueError):
        combine(rows, strategy="other")
    with pytest.raises(KeyError):
        combine(rows.drop("value"))


def test_weighted_catalog(spark):
    frames = {n: df.withColumn("v_pec_err", F.col("v_err")) for n, df in catalogs(spark).items()}
    match = cross_match(frames, MatchRules(5.0, 1e-2)).rows.select("uid", "dataset", "row_index")
    c = WeightedCatalog(frames, match).add_weight("a", ConstantWeight(2.0)).fill_defaults({"a": ("peculiar_velocity", "pv"), "b": ("peculiar_velocity", "pv")})
    rows = {(r["survey"], r["row_index"]): r["weight"] for r in c.concurrences("v", "v_err").collect()}
    assert rows["a", 0] == 2.0 and math.isclose(rows["b", 0], 1 / 25) and c.n_universal() == 4 and c.n_multi_survey() == 2
    assert c.combine("v", "v_err").count() == 4
    with pytest.raises(RuntimeError):
        WeightedCatalog(frames).combine("v", "v_err")
    with pytest.raises(KeyError):
        c.add_weight("x", ConstantWeight())


def test_weights(spark):
    rows = spark.createDataFrame([(0.01, 0.0), (0.02, 0.0), (0.0, 4.0), (None, float("nan"))], "e double, q double")
    get = lambda w: [r[0] for r in rows.select(w.on(rows)).collect()]
    assert get(InverseVarianceWeight("e"))[2:] == [0.0, 0.0]
    assert math.isclose(get(InverseVarianceWeight("e", 0.01))[0], 1 / 2e-4)
    assert get(QualityMaskWeight("q", "==", 0)) == [1.0, 1.0, 0.0, 0.0] and get(QualityMaskWeight("q", "!=", 0)) == [0.0, 0.0, 1.0, 1.0]
    assert get(FKPWeight(lambda z: F.lit(1e-4), 1e4, "e"))[0] == 0.5
    assert math.isclose(get(ConstantWeight(2.0) * ConstantWeight(3.0))[0], 6)
    for bad in (lambda: ConstantWeight(-1), lambda: QualityMaskWeight("q", "~", 0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        default_weight("spectroscopic", "phot")
    with pytest.raises(KeyError):
        InverseVarianceWeight("none").on(rows)


def test_selections(spark):
    rows = spark.createDataFrame([(180.0, 0.0, 0.3), (180.5, 0.0, 0.7), (181.5, 0.0, 1.0), (355.0, 5.0, 1.8), (5.0, -5.0, None), (180.0, 90.0, float("nan"))], "ra double, dec double, z double")
    n = lambda s: rows.where(selected(s)).count()
    assert n(Cone(180, 0, 1)) == 2 and n(Shell(0.5, 1.5)) == 2 and n(SkyPatch(350, 10, -10, 10)) == 2 and n(None) == 6
    assert n([Cone(180, 0, 2), Shell(0.5, 2)]) == 2 and n(Cone(0, 90, 1)) == 1
