"""The catalog front and what round trips through it: large ids, hydration, versions, FITS headers, row numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from astrolane.operators.combine import WeightedCatalog
from astrolane.operators.links import LinkRules
from astrolane.operators.match import MatchRules, cross_match, legacy_rules
from astrolane.operators.selection import Cone
from astrolane.sources import fits, ingest, loaders
from astrolane.sources.database import Database
from astrolane.sources.manifest import has_manifest
from astrolane.sources.scan import DatasetView, read_objects, read_points
from astrolane.sources.validity import Validity


def sky(spark, rows, key="long"):
    return spark.createDataFrame(rows, f"row_index {key}, ra double, dec double, z double")


def test_ids_of_any_size_and_strings_stay_apart(spark):
    big = 1 << 48
    a, b = sky(spark, [(big + 5, 10.0, 10.0, 0.1), (1, 50.0, 50.0, 0.1)]), sky(spark, [(5, 50.0, 50.0, 0.1), (7, 10.0, 10.0, 0.1)])
    got = {(r["dataset"], r["row_index"]): r["uid"] for r in cross_match({"a": a, "b": b}).rows.collect()}
    assert got["a", big + 5] == got["b", 7] and got["a", 1] == got["b", 5] and len(set(got.values())) == 2
    s = sky(spark, [("x", 50.0, 50.0, 0.1), ("y", 10.0, 10.0, 0.1)], "string")
    got = {(r["dataset"], r["row_index"]): r["uid"] for r in cross_match({"a": a, "s": s}).rows.collect()}
    assert got["a", str(big + 5)] == got["s", "y"] and got["a", "1"] == got["s", "x"]


def test_pairs_at_poles_and_seams_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    ra = np.concatenate([rng.uniform(0, 360, 60), rng.uniform(359.99, 360.01, 60) % 360, rng.uniform(0, 360, 60)])
    dec = np.concatenate([rng.uniform(89.99, 90, 60), rng.uniform(-0.01, 0.01, 60), rng.uniform(-90, -89.99, 60)])
    rows = [(i, float(x), float(y), None) for i, (x, y) in enumerate(zip(ra, dec, strict=True))]
    from astrolane.operators.match import spherical_join

    for tol in (5.0, 40.0):
        got = {(r["l_row_index"], r["r_row_index"]) for r in spherical_join(sky(spark, rows), sky(spark, rows), tol).collect()}
        x, y = np.radians(ra), np.radians(dec)
        h = np.sin((y[:, None] - y) / 2) ** 2 + np.cos(y[:, None]) * np.cos(y) * np.sin((x[:, None] - x) / 2) ** 2
        want = set(zip(*(k.tolist() for k in np.nonzero(np.degrees(2 * np.arcsin(np.sqrt(np.minimum(h, 1)))) * 3600 <= tol)), strict=True))
        assert got == want and len(want) > 200


def test_older_keywords():
    assert legacy_rules(None, sky_tol_arcsec=2.0) == MatchRules(2.0) and legacy_rules(None, dz_tol=None) == MatchRules(dz_tol=None)
    assert legacy_rules(None) == MatchRules()
    with pytest.raises(TypeError):
        legacy_rules(None, sky=1)
    with pytest.raises(ValueError):
        legacy_rules(MatchRules(), dz_tol=1.0)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("db")
    base = loaders.load_catalog(spark, "dummy", n=60)
    ingest.write_dataset(base, place / "spectroscopic" / "host", "host", "spectroscopic")
    ingest.write_dataset(base.withColumn("ra", F.col("ra") + 1e-5), place / "photometric" / "near", "near", "photometric")
    objects = base.select(F.col("galaxy_id").alias("object_id"), "ra", "dec", "z", "z_type", "z_err")
    epochs = objects.selectExpr("object_id", "58000.0D AS mjd", "'g' AS filter", "1.0D AS flux", "0.1D AS flux_err", "0 AS flag")
    ingest.write_light_curves(objects, epochs, place / "photometric" / "lc", "lc")
    return place


def test_light_curves_are_hydrated_from_their_objects(spark, root):
    db = Database(spark, root)
    index = db.build_identity(["spectroscopic_host", "photometric_lc"], name="both")
    assert index.counts() == {"n_unique": 60, "n_multi": 60} and index.datasets() == ["photometric_lc", "spectroscopic_host"]
    query = db.identity_query("both")
    rows = query.full_for(query.from_cone(180.0, 0.0, 180.0)).collect()
    assert len(rows) == 120 and all((r["n_epochs"] == 1) == (r["dataset"] == "photometric_lc") for r in rows)
    assert index.concurrences(0).count() == 2
    assert query.from_shell(0.0, 9.0).count() == 60 and query.from_skypatch(0.0, 360.0, -90.0, 90.0).count() == 60
    assert sum(part.count() for part in query.iter_partial(range(60), ["n_epochs"], 25)) == 120


def test_catalogs_from_an_index(spark, root):
    db = Database(spark, root)
    index = db.build_identity(["spectroscopic_host", "photometric_near"], MatchRules(2.0, None), name="pair")
    catalog = WeightedCatalog.from_identity(index, db._attributes).fill_from_database(db, "spec", skip_unknown=True)
    assert len(catalog.weights.get("spectroscopic_host", [])) == 1 and not catalog.weights.get("photometric_near")
    assert catalog.n_universal() == 60 and catalog.n_multi_survey() == 60
    with pytest.raises(KeyError):
        WeightedCatalog.from_identity(index, db._attributes).fill_from_database(db, "spec")
    links = db.build_links(LinkRules("spectroscopic", "photometric", 2.0, None), name="all", identity="pair")
    assert links.rows.count() == 60


def test_loaders_and_points_of_a_database(spark, root):
    db = Database.from_root(spark, root)
    loader = db.get_loader("spectroscopic_host")
    assert loader.load(selection=Cone(180.0, 0.0, 90.0), columns=["ra"]).count() == db.load("spectroscopic_host", cone=Cone(180.0, 0.0, 90.0)).count()
    assert "v_pec" in loader.available_columns()
    got = [r["row_index"] for r in read_points(spark, root / "spectroscopic" / "host").collect()]
    assert got == sorted(got) and len(got) == 60
    assert has_manifest(root / "spectroscopic" / "host") and not has_manifest(root)
    assert read_objects(spark, root / "photometric" / "lc").count() == 60
    with pytest.raises(ValueError):
        read_objects(spark, root / "spectroscopic" / "host")
    assert DatasetView.from_path(spark, root / "spectroscopic" / "host").n_rows == 60


def test_as_of_keeps_the_options(spark, tmp_path):
    rows = loaders.load_catalog(spark, "dummy", n=5)
    ingest.write_dataset(rows, tmp_path / "x" / "y", "n", "t", validity=Validity("2020-01-01T00:00:00Z"))
    db = Database(spark, tmp_path, name_from_path=lambda p: ("custom", "t"))
    assert list(db.as_of("2021-01-01T00:00:00Z")) == ["custom"] == list(db)
    assert not list(Database(spark, tmp_path, max_depth=1))


def test_fits_scales_nulls_logicals_and_odd_columns(spark, tmp_path):
    path = str(tmp_path / "t.fits")
    fits.write_fits(path, {"A": np.array([1, 2, -9], "i2"), "U": np.array([-32768, 0, 32767], "i2"), "S": np.array([10, 20, 30], "i4"), "L": np.array(["T", "F", " "]), "V": np.array([[1, 2], [3, 4], [5, 6]], "i4"), "P": np.arange(3).astype("i8")})
    data = bytearray(open(path, "rb").read())

    def card(old, new):
        at = data.index(old.ljust(80)[: len(old)].encode())
        data[at : at + 80] = new.ljust(80).encode()

    card("TFORM4  = '1A'", "TFORM4  = '1L'")
    card("TFORM6  = '1K'", "TFORM6  = '1PJ(3)'")
    end = data.index(b"END" + b" " * 77, 2880)
    for i, text in enumerate(["TNULL1  = -9", "TZERO2  = 32768", "TSCAL3  = 0.5", "TZERO3  = 1.0"]):
        data[end + 80 * i : end + 80 * (i + 1)] = text.ljust(80).encode()
    data[end + 320 : end + 400] = b"END".ljust(80)
    open(path, "wb").write(data)
    got = fits.read_fits(spark, path).orderBy(fits.ROW_INDEX).collect()
    assert [r["A"] for r in got] == [1, 2, None] and [r["U"] for r in got] == [0, 32768, 65535] and [r["S"] for r in got] == [6.0, 11.0, 16.0]
    assert [r["L"] for r in got] == [True, False, None] and got[2]["V"] == [5, 6] and "P" not in got[0].asDict()
    assert fits.read_fits(spark, path, ["A"], where={"L": True}).count() == 1
    with pytest.raises(ValueError):
        fits.read_fits(spark, path, ["P"])


def test_csv_rows_are_numbered_across_splits(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("i,t\n" + "".join(f"{i},{'x' * (i % 50)}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = ingest.numbered_csv(spark, str(path))
        assert rows.rdd.getNumPartitions() >= 1 and rows.where(f"{ingest.ROW_INDEX} <> i").count() == 0 and rows.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_crowded_cell_is_dealt_to_several_files(spark, tmp_path):
    rows = loaders.load_catalog(spark, "dummy", n=400).withColumn("ra", F.lit(10.0) + F.col("galaxy_id") * 1e-6).withColumn("dec", F.lit(5.0))
    m = ingest.write_dataset(rows, tmp_path / "d", "d", "test", nside=4, rows_per_file=100)
    assert len({f.cell for f in m.files}) == 1 and len(m.files) >= 4 and max(f.rows for f in m.files) <= 100 and m.n_rows == 400
    assert all(len(f.sha256) == 16 and f.size > 0 for f in m.files)

