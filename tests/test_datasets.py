import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from astrolane.operators.links import LinkRules
from astrolane.operators.match import MatchRules
from astrolane.operators.selection import Cone, Shell, SkyPatch, selected
from astrolane.sources import fits, ingest, loaders, schema
from astrolane.sources.database import Database, coerced, convert, from_config, parse_config
from astrolane.sources.manifest import NAME, ManifestError, read_manifest, write_atomic
from astrolane.sources.scan import DatasetView, original_columns
from astrolane.sources.schema import Geometry
from astrolane.sources.validity import Temporal, Validity


def points(spark, n=400):
    return loaders.load_catalog(spark, "dummy", n=n).withColumn("t_obs", 58000.0 + F.col("galaxy_id"))


def test_pruned_scans_equal_full_filters(spark, tmp_path):
    rows = points(spark).cache()
    manifest = ingest.write_dataset(rows, tmp_path / "d", "dummy", "test", nside=4)
    view = DatasetView.open(spark, tmp_path / "d")
    assert manifest.n_rows == view.n_rows == 400 and view.n_partitions == rows.select(F.expr("count(distinct galaxy_id)")).count() * len(manifest.files)
    for s, kw in ((Cone(180, 0, 25), "cone"), (SkyPatch(340, 30, -40, 40), "skypatch")):
        got = {r[0] for r in view.scan(["galaxy_id"], **{kw: s}).collect()}
        assert got == {r[0] for r in rows.where(s.column()).select("galaxy_id").collect()}
        assert len(view.pruned(s.cells(4))) < view.n_partitions
    assert view.scan(["galaxy_id"], t_range=(58010.0, 58019.0)).count() == 10
    assert view.scan(z_range=(9.0, None)).count() == 0 and view.scan(z_range=(9.0, None)).schema == view.scan().schema
    assert view.scan(filter="galaxy_id < 5").count() == 5 and manifest.temporal.time_column == "t_obs"
    with pytest.raises(FileExistsError):
        ingest.write_dataset(rows, tmp_path / "d", "dummy", "test")
    with pytest.raises(ValueError):
        view.objects()


def test_cells_of_several_files_are_one_in_the_statistics(spark, tmp_path, monkeypatch):
    from astrolane.plans import queries
    from astrolane.sources.manifest import DataFile, Manifest

    n, keys = 3000, F.col("id")
    orders = spark.range(1, n + 1).select(keys.alias("o_orderkey"), F.lit("F").alias("o_orderstatus"), keys.cast("double").alias("o_totalprice"), F.expr("date_add(DATE '1995-01-01', CAST(id % 900 AS INT))").alias("o_orderdate"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setitem(schema.CHUNK_ROWS, Geometry.POINT, 50)
    cells = {r["cell"]: r for r in queries.partition_stats(spark, str(tmp_path)).collect()}
    files = queries._dataset(spark, str(tmp_path)).manifest.files
    rows = queries.cat_a(spark, str(tmp_path)).groupBy(queries.sphere.healpix_nest("ra", "dec", 4).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("ra"), F.max("z"), F.max("t_obs")).collect()
    assert len(files) > len(cells) == len(rows)
    for r in rows:
        got = cells[r["cell"]]
        assert (got["n_rows"], got["ra_min"], got["z_max"], got["t_max"]) == tuple(r)[1:]
    assert queries.partition_stats(spark, str(tmp_path)).count() == len(cells)
    parts = (DataFile("a/1", 2, 7, {"z": [None, None]}), DataFile("a/2", 3, 7, {"z": [0.1, 0.2]}), DataFile("b/1", 1, 8, {"z": [None, None]}))
    united = Manifest("s", "t", Geometry.POINT, parts).cells()
    assert [(c.cell, c.rows, c.ranges["z"]) for c in united] == [(7, 5, [0.1, 0.2]), (8, 1, [None, None])]


def test_small_catalogs_are_not_over_partitioned():
    assert ingest.cell_nside(17_618) == 1 and ingest.cell_nside(700_000_000) >= 16 and ingest.cell_nside(10**12) == 32


def test_sightlines_maps_and_light_curves(spark, tmp_path):
    lines = spark.createDataFrame([(1, 10.0, 5.0, 2.0, "s", 2)], "sightline_id long, ra double, dec double, z_source double, survey_id string, n_pixels int")
    pixels = spark.createDataFrame([(1, 3.5, 0.1, 1.0), (1, 3.6, 0.2, 1.0)], "sightline_id long, loglam double, delta double, weight double")
    ingest.write_sightlines(lines, pixels, tmp_path / "s", "lya")
    view = DatasetView.open(spark, tmp_path / "s")
    assert view.scan().join(view.objects(), "sightline_id").count() == 2 and view.manifest.notes["has_objects_table"]
    ingest.write_sky_map(spark.range(3072).selectExpr("id AS healpix_index", "1.0D AS value"), tmp_path / "m", "map", nside=16)
    assert DatasetView.open(spark, tmp_path / "m").scan(healpix_cells=[1, 2]).count() == 2
    objects = spark.createDataFrame([(1, 1.0, 2.0, 0.1, "spec", 1e-3)], "object_id long, ra double, dec double, z double, z_type string, z_err double")
    epochs = spark.createDataFrame([(1, 58000.0, "g", 1.0, 0.1, 0), (1, 58010.0, "r", 2.0, 0.1, 0)], "object_id long, mjd double, filter string, flux double, flux_err double, flag int")
    m = ingest.write_light_curves(objects, epochs, tmp_path / "l", "ztf")
    assert (m.temporal.t_min, m.temporal.t_max) == (58000.0, 58010.0)
    assert DatasetView.open(spark, tmp_path / "l").objects().first()["n_epochs"] == 2
    with pytest.raises(ValueError, match="unknown objects"):
        ingest.write_light_curves(objects, epochs.withColumn("object_id", F.lit(9)), tmp_path / "x", "ztf")
    with pytest.raises(ValueError, match="without epochs"):
        ingest.write_light_curves(objects.union(objects.withColumn("object_id", F.lit(5))), epochs, tmp_path / "x", "ztf")
    with pytest.raises(ValueError):
        ingest.write_dataset(lines, tmp_path / "x", "a", "b")


def test_manifests_reject_what_they_cannot_read(spark, tmp_path):
    ingest.write_dataset(points(spark, 20), tmp_path / "d", "dummy", "test")
    path = tmp_path / "d" / NAME
    good = json.loads(path.read_text())
    old = good | {"valid": None}
    write_atomic(path, json.dumps(old))
    assert read_manifest(tmp_path / "d").validity.valid_from_utc == good["written"]
    for bad in ("{", "[]", json.dumps(good | {"astrolane_manifest": 3}), json.dumps({k: v for k, v in good.items() if k != "files"}), json.dumps(good | {"geometry": "disc"})):
        write_atomic(path, bad)
        with pytest.raises(ManifestError):
            read_manifest(tmp_path / "d")
    with pytest.raises(ManifestError):
        read_manifest(tmp_path / "none")


def test_fits_round_trip_and_linkback(spark, tmp_path):
    path = str(tmp_path / "q.fits")
    n = 50
    fits.write_fits(path, {"RA": np.linspace(0, 300, n), "DEC": np.linspace(-60, 60, n), "Z_RR": np.full(n, 0.5, "f4"), "ZERR": np.full(n, 1e-3, "f4"), "ZWARN": np.arange(n, dtype="i4") % 5, "SPECTYPE": np.array(["QSO", "GALAXY "] * (n // 2)), "FLUX_G": np.full(n, 100.0), "MAGS": np.ones((n, 5), "f4")})
    rows = fits.read_fits(spark, path, rows_per_task=7)
    assert rows.count() == n and rows.where("SPECTYPE = 'GALAXY'").count() == n // 2 and rows.select(F.size("MAGS")).first()[0] == 5
    assert fits.read_fits(spark, path, ["RA"], where={"SPECTYPE": "QSO", "ZWARN": 0}).count() == 5
    with pytest.raises(ValueError):
        fits.read_fits(spark, path, ["NONE"])
    convert(spark, "desi_qso", tmp_path / "desi", path)
    got = DatasetView.open(spark, tmp_path / "desi").scan()
    assert got.where("zwarning = 0 AND z_type = 'spec' AND mag_g = 17.5").count() == 5 == got.count()
    back = original_columns(spark, tmp_path / "desi", ["RA", "ZWARN"], got.select("_original_row_index"))
    assert back.where("ZWARN = 0").count() == 5  # numbers are those of the raw file, before any cut
    assert ingest.source_rows(spark, path, "fits") == n


def test_versions_identity_and_links(spark, tmp_path):
    base = points(spark, 30)
    old, new = Validity("2020-01-01T00:00:00Z", None, "1"), Validity("2021-01-01T00:00:00Z", None, "2", "survey_one")
    ingest.write_dataset(base, tmp_path / "survey" / "one", "one", "hosts", validity=old)
    ingest.write_dataset(base, tmp_path / "survey" / "two", "two", "hosts", validity=new)
    ingest.write_dataset(base.withColumn("ra", F.col("ra") + 1e-5), tmp_path / "sne", "sne", "children")
    db = Database(spark, tmp_path)
    assert db.list() == ["sne", "survey_two"] and db.as_of("2020-06-01T00:00:00+00:00").list() == ["survey_one"]
    assert [e.name for e in db.versions_of_root("survey")] == ["survey_one", "survey_two"]
    with pytest.raises(ValueError):
        db.as_of("2020-06-01T00:00:00")
    with pytest.raises(KeyError):
        db["nothing"]
    rules = MatchRules(1.0, None)
    index = db.build_identity(rules=rules)
    assert index.multi_only().count() == 60 and db.load_identity().rules == rules
    between = index.validity.valid_from_utc
    db.build_identity(["sne"], rules)
    assert db.load_identity().datasets() == ["sne"] and db.load_identity(as_of=between).datasets() == ["sne", "survey_two"]
    assert db.list_identities() == ["default"] and len(db.list_identities(True)) == 2
    db.build_identity(rules=rules)
    links = db.build_links(LinkRules("hosts", "children"), ["survey_two"], ["sne"])
    assert links.rows.count() == 30 and db.load_links().rows.where("confidence = 1").count() == 30
    first = links.rows.first()
    assert links.children_of(first["parent"]) == [first["child"]] and links.parent_of(-1) is None
    q = db.identity_query()
    uids = q.from_selection(Shell(0.0, 0.2))
    assert q.partial_for(uids, ["v_pec"]).count() == 60 and db.summary().count() == 2
    with pytest.raises(FileNotFoundError):
        db.load_identity("none")
    with pytest.raises(ValueError):
        db.build_identity(name="a__b")


def test_validity_and_temporal_contracts():
    v = Validity("2020-01-01T00:00:00Z", "2021-01-01T00:00:00Z")
    assert v.contains("2020-01-01T00:00:00Z") and not v.contains("2021-01-01T00:00:00Z")
    for bad in (lambda: Validity("2020-01-01"), lambda: Validity("2021-01-01T00:00:00Z", "2021-01-01T00:00:00Z"), lambda: Temporal(2.0, 1.0), lambda: Temporal(1.0, 2.0, time_reference="GPS")):
        with pytest.raises(ValueError):
            bad()


def test_configuration(spark, tmp_path):
    ini = tmp_path / "c.ini"
    ini.write_text(f"[database]\nroot = {tmp_path / 'db'}\n[dataset dummy]\nloader = dummy\nn = 40\n[dataset late]\nskip = true\n[dataset broken]\nloader = desi_bgs\n")
    base, sets = parse_config(ini)
    assert sets[0]["options"] == {"n": 40} and [coerced(x) for x in ("42", "true", "none", "1.5", "x")] == [42, True, None, 1.5, "x"]
    db, told = from_config(spark, ini)
    assert told["dummy"] == "done" and told["late"] == "skipped" and told["broken"].startswith("failed") and len(db) == 1
    (tmp_path / "bad.ini").write_text("[dataset a]\n")
    with pytest.raises(ValueError):
        parse_config(tmp_path / "bad.ini")


def test_registry_and_schema(spark):
    assert len(loaders.list_surveys()) == 10 and "snia" in loaders.list_survey_types()
    with pytest.raises(TypeError):
        loaders.REGISTRY["x"] = None
    with pytest.raises(ValueError):
        loaders.register(loaders.Dummy)
    with pytest.raises(NotImplementedError):
        loaders.load_catalog(spark, "sdss_mgs")
    rows = points(spark, 5)
    assert schema.validate(rows, ("core", "spectroscopic")) == []
    assert schema.validate(rows.withColumn("z", F.lit("a")), ("core",))
    with pytest.raises(ValueError):
        schema.validate(rows.drop("ra"), ("core",))
    with pytest.raises(ValueError):
        loaders.load_catalog(spark, "dummy", columns=["nope"])
    assert loaders.load_catalog(spark, "dummy", selection=selected and Shell(0.1, 0.2), n=50).count() < 50
    assert Geometry("point") is Geometry.POINT


def test_drops_are_matched_as_they_arrive(spark, tmp_path):
    from astrolane.streaming.drops import match_drops

    rows = points(spark, 20).selectExpr("galaxy_id AS row_index", "ra", "dec", "CAST(z AS DOUBLE) AS z")
    rows.limit(5).coalesce(1).write.parquet(str(tmp_path / "in"))
    match_drops(spark, str(tmp_path / "in"), rows.schema, rows, MatchRules(1.0), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("drop_row = catalog_row").count() == 5
