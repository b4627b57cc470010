"""More of the driver's queries: datasets, databases, raw files, loaders and streams, each through its own operator."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from ..functions import photometry, sphere
from ..operators import combine as cmb
from ..operators import weights as wt
from ..operators.match import MatchRules, cross_match
from ..operators.selection import Cone, Shell
from ..sources import fits, ingest, loaders
from ..sources.database import Database, coerced, from_config, name_of, overlapping
from ..sources.manifest import Manifest, hash_bytes, write_manifest
from ..sources.scan import DatasetView, original_columns, read_objects, read_points
from ..sources.schema import Geometry
from ..sources.validity import Validity
from ..streaming.drops import match_drops
from .onboard import onboard
from .queries import _IDS, _LONG, _MJD, _PAIR, DZ, TOL, A, B, ORACLES, QUERIES, _both, _cone, _dataset, _folder, _light_curves, _long, _once, _pixel, _table, _V, cat_a, cat_b, query


def _sky(spark, sf) -> Database:
    """Orders as a spectroscopic dataset, lines as a photometric one, users' events as light curves."""

    def make(place):
        for name, kind, rows in (("orders", "spectroscopic", cat_a(spark, sf)), ("lines", "photometric", cat_b(spark, sf))):
            ingest.write_dataset(rows.withColumn("_original_row_index", F.col("row_index")).withColumn("z_err", F.lit(1e-4).cast("float")), f"{place}/{kind}/{name}", name, kind)
        objects, epochs = _light_curves(spark, sf)
        ingest.write_light_curves(objects.selectExpr("*", "1e-1 AS z", "'phot' AS z_type", "1e-2 AS z_err"), epochs, f"{place}/photometric/curves", "curves")
        return place

    return Database(spark, _once(spark, sf, "sky", make))


@query("SELECT 'spectroscopic_orders' AS name, 'spectroscopic' AS survey_type, 'point' AS geometry, count(*) AS n_rows FROM orders UNION ALL SELECT 'photometric_lines', 'photometric', 'point', count(*) FROM lineitem UNION ALL SELECT 'photometric_curves', 'photometric', 'lightcurve', count(*) FROM events")
def database_summary(spark, sf):
    return _sky(spark, sf).summary().drop("n_partitions")


@query(f"SELECT row_index, ra, dec FROM {A} a WHERE {_cone(90, -10, 15)}")
def database_scan(spark, sf):
    return _sky(spark, sf).load("spectroscopic_orders", columns=["row_index", "ra", "dec"], cone=Cone(90.0, -10.0, 15.0))


@query(f"SELECT row_index, ra, dec FROM {A} a WHERE z BETWEEN 1e-1 AND 2e-1")
def database_sql(spark, sf):
    """The registered view, asked in SQL."""
    _sky(spark, sf).register_views()
    return spark.sql("SELECT row_index, ra, dec FROM spectroscopic_orders WHERE z BETWEEN 1e-1 AND 2e-1")


@query(f"SELECT row_index, z FROM {B} b WHERE z BETWEEN 2e-1 AND 3e-1")
def loader_of_dataset(spark, sf):
    return _sky(spark, sf).get_loader("photometric_lines").load(selection=Shell(0.2, 0.3), columns=["row_index", "z"], validate=False)


@query(f"SELECT row_index, ra FROM {A} a")
def points_in_order(spark, sf):
    return read_points(spark, _sky(spark, sf).entry("spectroscopic_orders").path, ["row_index", "ra"])


@query(f"SELECT user_id AS object_id, count(*) AS n_epochs, CAST(min({_MJD}) AS DOUBLE) AS mjd_min, {_pixel(32, '(user_id * 7919 % 3600000) * 1e-4', '((user_id * 104729 % 1200000) * 1e-4 - 60e0)')} AS cell FROM events GROUP BY user_id")
def objects_table(spark, sf):
    rows = read_objects(spark, _sky(spark, sf).entry("photometric_curves").path)
    return rows.select("object_id", F.col("n_epochs").cast("long").alias("n_epochs"), "mjd_min", F.col("_healpix32").cast("long").alias("cell"))


@query(f"SELECT user_id AS object_id, count(*) AS n FROM events WHERE {_MJD} BETWEEN 60315 AND 60325 GROUP BY user_id")
def epochs_in_time(spark, sf):
    return _sky(spark, sf)["photometric_curves"].scan(["object_id"], t_range=(60315.0, 60325.0)).groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT row_index, ra FROM {A} a WHERE false")
def empty_scan(spark, sf):
    return _dataset(spark, sf).scan(["row_index", "ra"], z_range=(99.0, None))


@query(f"SELECT row_index FROM {A} a WHERE {_cone(180, 0, 20)}")
def cells_united(spark, sf):
    """Cells beside a cone widen what is opened, not what comes back."""
    return _dataset(spark, sf).scan(["row_index"], cone=Cone(180.0, 0.0, 20.0), healpix_cells=[0, 1])


_NARROW = sphere.cone_cells(180.0, 0.0, 20.0, 4)[::2]


@query(f"SELECT row_index FROM {A} a WHERE {_cone(180, 0, 20)} AND {_pixel(4)} IN ({', '.join(map(str, _NARROW))})")
def cells_narrowed(spark, sf):
    return _dataset(spark, sf).scan(["row_index"], cone=Cone(180.0, 0.0, 20.0), healpix_cells=_NARROW, narrow_cells=True)


# ---- identities and links beside the datasets ----


@query(_IDS + "SELECT n, count(*) AS n_groups FROM (SELECT uid, count(*) AS n FROM idx GROUP BY uid) GROUP BY n")
def identity_stored(spark, sf):
    def make(_):
        db = _sky(spark, sf)
        db.build_identity(["spectroscopic_orders", "photometric_lines"], MatchRules(TOL, DZ), name="stored")
        return db

    rows = _once(spark, sf, "identity-stored", make).load_identity("stored").rows
    return rows.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("n_groups"))


@query(_IDS + "SELECT count(DISTINCT uid) AS n_unique, (SELECT count(*) FROM multi) AS n_multi FROM idx")
def stored_counts(spark, sf):
    identity_stored(spark, sf)
    counts = _sky(spark, sf).load_identity("stored").counts()
    return spark.createDataFrame([(counts["n_unique"], counts["n_multi"])], "n_unique long, n_multi long")


@query("SELECT 1 AS live, 1 AS archived, count(DISTINCT user_id) AS rows_then, count(DISTINCT user_id) AS rows_now FROM events")
def identity_archive(spark, sf):
    """A second build archives the first, which an instant between them still finds."""
    db, name = _sky(spark, sf), f"n{uuid.uuid4().hex}"
    db.build_identity(["photometric_curves"], MatchRules(1e-6), name=name)
    between = datetime.now(timezone.utc)
    db.build_identity(["photometric_curves"], MatchRules(1e-7), name=name)
    own = [n for n in db.list_identities(include_archived=True) if n.startswith(name)]
    then, now = db.load_identity(name, as_of=between), db.load_identity(name)
    assert then.rules != now.rules
    return spark.createDataFrame([(own.count(name), len(own) - 1, then.rows.count(), now.rows.count())], "live int, archived int, rows_then long, rows_now long")


@query(_IDS + "SELECT uid, dataset, row_index FROM idx WHERE uid IN (SELECT uid FROM multi)")
def matches_of_several(spark, sf):
    return cross_match(_both(spark, sf), MatchRules(TOL, DZ)).multi_survey().select("uid", "dataset", "row_index")


@query(f"SELECT row_a AS catalog_row, row_b AS drop_row, sep FROM ({_PAIR} AND abs(a.z - b.z) <= {DZ})")
def streamed_drops(spark, sf):
    """The lines arrive as a stream of files and are matched to the orders."""

    def make(place):
        cat_b(spark, sf).repartition(3).write.parquet(f"{place}/drops")
        schema = spark.read.parquet(f"{place}/drops").schema
        match_drops(spark, f"{place}/drops", schema, cat_a(spark, sf), MatchRules(TOL, DZ), f"{place}/out", f"{place}/checkpoint").awaitTermination()
        return place

    found = spark.read.parquet(f"{_once(spark, sf, 'drops', make)}/out")
    return found.select("catalog_row", "drop_row", F.round("sep_arcsec", 6).alias("sep"))


# ---- versions ----


@query(f"SELECT a.region AS region, count(*) AS n FROM {_V} a JOIN {_V} b ON a.region = b.region AND a.id < b.id GROUP BY a.region")
def overlapping_versions(spark, sf):
    """Versions of one folder that name no predecessor are valid at the same time."""

    def make(place):
        for r in _table(spark, sf, "nation").collect():
            began = "2020-01-01T00:00:00+00:00"
            write_manifest(f"{place}/r{r['n_regionkey']}/{r['n_nationkey']}", Manifest(r["n_name"], "x", Geometry.POINT, (), validity=Validity(began), written=began))
        return place

    pairs = overlapping(Database(spark, _once(spark, sf, "overlaps", make)).every)
    return spark.createDataFrame([(int(a[1]),) for a, _ in pairs], "region int").groupBy("region").agg(F.count(F.lit(1)).alias("n"))


# ---- raw files ----


def _raw(spark, sf) -> str:
    def make(place):
        Path(place).mkdir(parents=True)
        rows = _table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey").orderBy("s_suppkey").toPandas()
        fits.write_fits(f"{place}/t.fits", {"KEY": rows["s_suppkey"].to_numpy(np.int64), "NAME": rows["s_name"].to_numpy("U"), "BALANCE": rows["s_acctbal"].to_numpy(np.float64), "NATION": rows["s_nationkey"].to_numpy(np.int32)})
        rows.to_csv(f"{place}/t.csv", index=False)
        return place

    return _once(spark, sf, "raw", make)


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_index, s_suppkey, s_name, s_acctbal FROM supplier")
def fits_rows(spark, sf):
    rows = fits.read_fits(spark, f"{_raw(spark, sf)}/t.fits", ["KEY", "NAME", "BALANCE"])
    return rows.toDF("row_index", "s_suppkey", "s_name", "s_acctbal")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey = 3")
def fits_where(spark, sf):
    return fits.read_fits(spark, f"{_raw(spark, sf)}/t.fits", ["KEY"], where={"NATION": 3}).select(F.col("KEY").alias("s_suppkey"))


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_index, s_suppkey FROM supplier")
def csv_rows(spark, sf):
    rows = ingest.numbered_csv(spark, f"file://{_raw(spark, sf)}/t.csv")
    return rows.select(F.col(ingest.ROW_INDEX).alias("row_index"), F.col("s_suppkey").cast("long").alias("s_suppkey"))


@query("SELECT count(*) AS n_csv, count(*) AS n_fits FROM supplier")
def source_row_counts(spark, sf):
    place = _raw(spark, sf)
    return spark.createDataFrame([(ingest.source_rows(spark, f"{place}/t.csv", "csv"), ingest.source_rows(spark, f"{place}/t.fits", "fits"))], "n_csv long, n_fits long")


@query("SELECT row_index, s_name FROM (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_index, s_name, s_nationkey FROM supplier) WHERE s_nationkey < 5")
def original_file_columns(spark, sf):
    """Columns that a dataset left out, fetched from its raw file by row number."""

    def make(place):
        rows = fits.read_fits(spark, f"{_raw(spark, sf)}/t.fits", ["KEY", "NATION"]).selectExpr("*", "KEY * 7919 % 360 / 1e0 AS ra", "0e0 AS dec", "1e-1 AS z", "'spec' AS z_type", "1e-4 AS z_err")
        ingest.write_dataset(rows, place, "suppliers", "spectroscopic", original_files=({"path": f"{_raw(spark, sf)}/t.fits", "format": "fits"},))
        return place

    place = _once(spark, sf, "suppliers", make)
    wanted = read_points(spark, place).where("NATION < 5").select(ingest.ROW_INDEX)
    return original_columns(spark, place, ["NAME"], wanted).toDF("row_index", "s_name")


@query(f"SELECT row_index, round(CAST(22.5e0 - 2.5e0 * log10(value) AS FLOAT), 3) AS mag_g FROM {A} a WHERE z_type = 'spec' AND row_index % 3 = 0 AND z BETWEEN 5e-2 AND 3e-1")
def desi_pipeline(spark, sf):
    raw = cat_a(spark, sf).selectExpr("row_index AS _original_row_index", "ra AS RA", "dec AS DEC", "z AS Z_RR", "variance AS ZERR", "CASE z_type WHEN 'spec' THEN 'QSO ' ELSE 'STAR' END AS SPECTYPE", "row_index % 3 AS ZWARN", "value AS FLUX_G")
    rows = loaders.get_loader("desi_qso")(spark).standard(raw, z_min=0.05, z_max=0.3)
    return rows.select(F.col(ingest.ROW_INDEX).alias("row_index"), F.round("mag_g", 3).alias("mag_g"))


@query("SELECT vec_id AS row_index, round(CAST(embedding[1] AS DOUBLE), 5) AS psfmag_u, round(CAST(embedding[5] AS DOUBLE), 5) AS psfmag_z, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS n_dla FROM embeddings WHERE vec_id % 100 / 1e2 BETWEEN 2e-1 AND 7e-1")
def eboss_pipeline(spark, sf):
    raw = _table(spark, sf, "embeddings").selectExpr("vec_id AS _original_row_index", "vec_id % 100 / 1e2 AS Z", "embedding AS PSFMAG", "embedding AS Z_DLA")
    rows = loaders.get_loader("eboss_qso")(spark).standard(raw, z_min=0.2, z_max=0.7)
    return rows.select(F.col(ingest.ROW_INDEX).alias("row_index"), *(F.round(F.col(c).cast("double"), 5).alias(c) for c in ("psfmag_u", "psfmag_z")), F.col("n_dla").cast("long").alias("n_dla"))


# ---- functions ----


@query(f"SELECT row_index, {_pixel(32)} AS cell FROM {A} a")
def healpix_cells(spark, sf):
    return cat_a(spark, sf).select("row_index", sphere.healpix_nest("ra", "dec", 32).alias("cell"))


@query(f"SELECT row_index, round(degrees(2 * asin(least(1e0, (row_index % 2000) / 2e3))) * 3600, 5) AS arcsec FROM {A} a")
def chord_to_arcsec(spark, sf):
    return cat_a(spark, sf).select("row_index", F.round(sphere.arcsec_of_chord((F.col("row_index") % 2000) / 1e3), 5).alias("arcsec"))


@query(f"SELECT row_index, round(cbrt(1e-3 + (row_index % 1000) / 1e3 * (125e-3 - 1e-3)), 9) AS z FROM {A} a")
def redshift_sample(spark, sf):
    return cat_a(spark, sf).select("row_index", F.round(photometry.sampled_redshift((F.col("row_index") % 1000) / 1e3, 0.1, 0.5), 9).alias("z"))


@query("SELECT n_name, substr(sha256(n_name), 1, 16) AS digest FROM nation")
def digest_prefix(spark, sf):
    names = [r[0] for r in _table(spark, sf, "nation").select("n_name").collect()]
    return spark.createDataFrame([(n, hash_bytes(n.encode())) for n in names], "n_name string, digest string")


for _op in ("==", "!=", ">", ">=", "<", "<="):
    _name = "mask_" + {"==": "equal", "!=": "unequal", ">": "above", ">=": "from", "<": "below", "<=": "up_to"}[_op]
    QUERIES[_name] = lambda spark, sf, w=wt.QualityMaskWeight("v", _op, 50.0): cat_a(spark, sf).withColumn("v", F.when(F.col("row_index") % 10 != 0, F.col("variance"))).select("row_index", w.column().alias("w"))
    ORACLES[_name] = f"SELECT row_index, CASE WHEN row_index % 10 = 0 THEN {1.0 if _op == '!=' else 0.0}e0 WHEN variance {'=' if _op == '==' else _op} 50 THEN 1e0 ELSE 0e0 END AS w FROM {A} a"

for _kind, _type, _column in (("photometric", "phot", "z_phot_err"), ("peculiar_velocity", "pec", "velocity_error"), ("peculiar_velocity", "pv", "v_pec_err")):
    QUERIES[f"default_weight_{_type}"] = lambda spark, sf, k=_kind, t=_type, c=_column: cat_a(spark, sf).withColumn(c, F.col("variance")).select("row_index", F.round(wt.default_weight(k, t).column(), 9).alias("w"))
    ORACLES[f"default_weight_{_type}"] = f"SELECT row_index, round(1e0 / (variance * variance), 9) AS w FROM {A} a"


@query(f"SELECT uid, round(sum(value / variance) / sum(1 / variance) + 37e-7, 5) AS value, count(DISTINCT survey) AS n_surveys FROM {_LONG} l WHERE uid % 7 <> 0 AND uid % 11 <> 0 AND uid % 13 <> 0 GROUP BY uid")
def combine_bad_rows(spark, sf):
    """Rows with a variance of zero, one that is not a number, or no value count for nothing."""
    uid = F.col("uid")
    rows = _long(spark, sf).withColumn("variance", F.when(uid % 7 == 0, 0.0).when(uid % 11 == 0, float("nan")).otherwise(F.col("variance"))).withColumn("value", F.when(uid % 13 != 0, F.col("value")))
    return cmb.combine(rows).select("uid", F.round(F.col("value") + 3.7e-6, 5).alias("value"), F.col("n_surveys").cast("long").alias("n_surveys"))


# ---- configuration ----

_TEXTS = ["yes", "Off", "none", "", "12", "1.5", " text "]


@query("SELECT * FROM (VALUES ('yes', 'bool True'), ('Off', 'bool False'), ('none', 'NoneType None'), ('', 'NoneType None'), ('12', 'int 12'), ('1.5', 'float 1.5'), (' text ', 'str text')) v(text, value)")
def coerced_values(spark, sf):
    return spark.createDataFrame([(t, f"{type(coerced(t)).__name__} {coerced(t)}") for t in _TEXTS], "text string, value string")


@query("SELECT * FROM (VALUES ('Photometric/DES/y6', 'photometric_des_y6', 'photometric'), ('x', 'x', 'x')) v(path, name, survey_type)")
def names_of_paths(spark, sf):
    return spark.createDataFrame([(p, *name_of(Path(p))) for p in ("Photometric/DES/y6", "x")], "path string, name string, survey_type string")


@query("SELECT * FROM (VALUES ('dummy', 'done'), ('gone', 'skipped'), ('odd', 'failed')) v(name, told)")
def configured_build(spark, sf):
    place = _folder(spark, "configured")
    Path(place).mkdir(parents=True)
    Path(place, "c.ini").write_text(f"[database]\nroot = {place}/db\n[dataset dummy]\nn = 20\n[dataset gone]\nskip = yes\n[dataset odd]\nloader = nothing\n")
    _, told = from_config(spark, f"{place}/c.ini")
    return spark.createDataFrame([(n, t.split(":")[0]) for n, t in told.items()], "name string, told string")


@query("SELECT 'test_dummy' AS survey, 5000 AS n_rows, 1e0 AS weight")
def onboarded_survey(spark, sf):
    place = _folder(spark, "onboard")
    return onboard(spark, "dummy", place).select("survey", F.col("n_rows").cast("int").alias("n_rows"), F.round(F.col("mean_weight") / 1e8, 6).alias("weight"))


@query(f"SELECT count(*) AS n FROM {A} a")
def dataset_properties(spark, sf):
    """What a view tells from its manifest alone."""
    view = DatasetView.from_path(spark, _sky(spark, sf).entry("spectroscopic_orders").path)
    assert "ra" in view.columns and view.geometry is Geometry.POINT
    return spark.createDataFrame([(view.n_rows,)], "n long")
