"""The driver's queries over catalogs derived from its tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import photometry, sphere
from ..operators import combine as cmb
from ..operators import weights as wt
from ..operators.identity import IdentityIndex, IdentityQuery
from ..operators.links import LinkRules, LinkSet, first_rows, link
from ..operators.match import MatchRules, cross_match, dense_ids, matched_pairs, spherical_join, stacked
from ..operators.selection import Cone, Shell, SkyPatch, in_range, selected
from ..sources import ingest
from ..sources.database import Database
from ..sources.manifest import Manifest, write_manifest
from ..sources.scan import DatasetView
from ..sources.schema import Geometry
from ..sources.validity import Validity
from .staging import scratch_path, staged

TOL, DZ = 1.0, 7.5e-4
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- what is written once for a session ----

_WRITTEN: dict[tuple, object] = {}


def _folder(spark, tag: str) -> str:
    """A folder that the driver opens by path: the scratch folder must be on a mounted file system."""
    place = scratch_path(spark, tag)
    if place.startswith("file:"):
        return "/" + place[5:].lstrip("/")
    if "://" in place:
        raise ValueError(f"datasets are opened by path, which {place} does not allow")
    return place


def _once(spark, sf, tag: str, make):
    """What make(folder) gives, made once for a session and a folder of tables."""
    key = (spark.sparkContext.applicationId, sf, tag)
    if key not in _WRITTEN:
        _WRITTEN[key] = make(_folder(spark, tag))
    return _WRITTEN[key]


# ---- derived catalogs: the same expressions in both dialects ----

_A = """SELECT o_orderkey AS row_index, (o_orderkey * 7919 % 3600000) * 1e-4 AS ra, (o_orderkey * 104729 % 1200000) * 1e-4 - 60e0 AS dec,
 (o_orderkey % 4000) * 1e-4 + 1e-2 AS z, CASE o_orderstatus WHEN 'F' THEN 'spec' WHEN 'O' THEN 'phot' ELSE 'pv' END AS z_type,
 o_totalprice AS value, 1e0 + (o_orderkey % 97) AS variance, CAST({days} AS DOUBLE) AS t_obs FROM {orders}"""
_B = """(l_orderkey * 7919 % 3600000) * 1e-4 + (l_partkey % 11 - 5) * 1e-4 AS ra, (l_orderkey * 104729 % 1200000) * 1e-4 - 60e0 + (l_suppkey % 7 - 3) * 1e-4 AS dec,
 (l_orderkey % 4000) * 1e-4 + 1e-2 + (l_partkey % 5 - 2) * 5e-4 AS z, CASE l_returnflag WHEN 'A' THEN 'spec' WHEN 'N' THEN 'phot' ELSE 'pv' END AS z_type,
 l_extendedprice AS value, 1e0 + l_quantity AS variance, l_orderkey AS object_key"""
_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag"]


def cat_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders")
    return spark.sql(_A.format(days="datediff(CAST(o_orderdate AS DATE), DATE '1858-11-17')", orders="{rows}"), rows=rows)


def cat_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line, numbered in an order of its columns; numbered once for a session, as ingestion would."""
    numbered = _once(spark, sf_dir, "lines", lambda _: staged(dense_ids(_table(spark, sf_dir, "lineitem").select(*_ORDER), _ORDER, "row_index"), "lines"))
    return spark.sql(f"SELECT row_index, {_B} FROM {{rows}}", rows=numbered)


A = "(" + _A.format(days="date_diff('day', DATE '1858-11-17', CAST(o_orderdate AS DATE))", orders="orders") + ")"
B = f"(SELECT row_number() OVER (ORDER BY {', '.join(_ORDER)}) - 1 AS row_index, {_B} FROM lineitem)"


def _pixel(nside: int, ra: str = "ra", dec: str = "dec") -> str:
    """The nested HEALPix pixel in SQL, from the published equations of the pixelisation."""
    z, t = f"sin(radians({dec}))", f"({ra} / 90e0)"
    up, down = f"CAST(floor({nside} * (5e-1 + {t}) - {nside} * {z} * 75e-2) AS BIGINT)", f"CAST(floor({nside} * (5e-1 + {t}) + {nside} * {z} * 75e-2) AS BIGINT)"
    quarter, cap = f"CAST(least(3, floor({t})) AS BIGINT)", f"{nside} * sqrt(3 * (1 - abs({z})))"
    jp, jm = f"CAST(least({nside - 1}, floor(({t} - {quarter}) * {cap})) AS BIGINT)", f"CAST(least({nside - 1}, floor((1 - {t} + {quarter}) * {cap})) AS BIGINT)"
    belt = f"abs({z}) <= 2e0 / 3"
    fp, fm = f"(({up}) // {nside})", f"(({down}) // {nside})"
    face = f"CASE WHEN {belt} THEN CASE WHEN {fp} = {fm} THEN {fp} % 4 + 4 WHEN {fp} < {fm} THEN {fp} % 4 ELSE {fm} % 4 + 8 END WHEN {z} >= 0 THEN {quarter} ELSE {quarter} + 8 END"
    x = f"(CASE WHEN {belt} THEN {down} % {nside} WHEN {z} >= 0 THEN {nside - 1} - {jm} ELSE {jp} END)"
    y = f"(CASE WHEN {belt} THEN {nside - 1} - {up} % {nside} WHEN {z} >= 0 THEN {nside - 1} - {jp} ELSE {jm} END)"
    bits = " + ".join(f"({x} // {1 << i} % 2) * {1 << 2 * i} + ({y} // {1 << i} % 2) * {2 << 2 * i}" for i in range(nside.bit_length() - 1))
    return f"(({face}) * {nside * nside} + {bits})"


def _sep(a: str, b: str) -> str:
    return f"degrees(2 * asin(least(1e0, sqrt(pow(sin(radians(({b}.dec - {a}.dec) / 2)), 2) + cos(radians({a}.dec)) * cos(radians({b}.dec)) * pow(sin(radians(({b}.ra - {a}.ra) / 2)), 2)))))"


def _cone(ra: float, dec: float, r: float, a: str = "a") -> str:
    return f"degrees(2 * asin(least(1e0, sqrt(pow(sin(radians(({a}.dec - ({dec}e0)) / 2)), 2) + cos(radians({a}.dec)) * cos(radians({dec}e0)) * pow(sin(radians(({a}.ra - {ra}e0) / 2)), 2))))) <= {r}e0"


_AC = "SELECT row_index, ra, dec, z FROM"

# ---- scans and predicates ----


@query(f"{_AC} {A} a WHERE {_cone(180, 0, 20)}")
def cone_scan(spark, sf):
    return cat_a(spark, sf).where(Cone(180.0, 0.0, 20.0).column()).select("row_index", "ra", "dec", "z")


@query(f"{_AC} {A} a WHERE z BETWEEN 1e-1 AND 2e-1")
def shell_scan(spark, sf):
    return cat_a(spark, sf).where(Shell(0.1, 0.2).column()).select("row_index", "ra", "dec", "z")


@query(f"{_AC} {A} a WHERE ra BETWEEN 10e0 AND 60e0 AND dec BETWEEN -20e0 AND 30e0")
def skypatch_scan(spark, sf):
    return cat_a(spark, sf).where(SkyPatch(10.0, 60.0, -20.0, 30.0).column()).select("row_index", "ra", "dec", "z")


@query(f"{_AC} {A} a WHERE (ra >= 350e0 OR ra <= 10e0) AND dec BETWEEN -10e0 AND 10e0")
def skypatch_wrap(spark, sf):
    return cat_a(spark, sf).where(SkyPatch(350.0, 10.0, -10.0, 10.0).column()).select("row_index", "ra", "dec", "z")


@query(f"{_AC} {A} a WHERE {_cone(200, 10, 25)} AND z BETWEEN 5e-2 AND 25e-2")
def cone_shell(spark, sf):
    return cat_a(spark, sf).where(selected([Cone(200.0, 10.0, 25.0), Shell(0.05, 0.25)])).select("row_index", "ra", "dec", "z")


@query(f"{_AC} {A} a WHERE ra >= 100e0 AND dec <= 5e0 AND z BETWEEN 2e-2 AND 3e-1 AND value > 1e5")
def range_scan(spark, sf):
    test = in_range("ra", 100.0, None) & in_range("dec", None, 5.0) & in_range("z", 0.02, 0.3) & (F.col("value") > 1e5)
    return cat_a(spark, sf).where(test).select("row_index", "ra", "dec", "z")


@query(f"SELECT row_index, t_obs FROM {A} a WHERE t_obs BETWEEN 50000e0 AND 50500e0")
def time_range_scan(spark, sf):
    return cat_a(spark, sf).where(in_range("t_obs", 50000.0, 50500.0)).select("row_index", "t_obs")


def _dataset(spark, sf) -> DatasetView:
    """Catalog A written as a partitioned dataset."""

    def make(place):
        rows = cat_a(spark, sf).withColumn("_original_row_index", F.col("row_index")).withColumn("z_err", F.lit(1e-4).cast("float"))
        ingest.write_dataset(rows, place, "cat_a", "spectroscopic", nside=4)
        return DatasetView.open(spark, place)

    return _once(spark, sf, "dataset", make)


@query(f"{_AC} {A} a WHERE {_cone(180, 0, 20)} AND z BETWEEN 1e-2 AND 2e-1")
def partitioned_cone_scan(spark, sf):
    return _dataset(spark, sf).scan(["row_index", "ra", "dec", "z"], cone=Cone(180.0, 0.0, 20.0), z_range=(0.01, 0.2))


@query(f"{_AC} {A} a WHERE (ra >= 340e0 OR ra <= 20e0) AND dec BETWEEN -50e0 AND -20e0 AND t_obs >= 49000e0 AND value < 2e5")
def partitioned_patch_scan(spark, sf):
    return _dataset(spark, sf).scan(["row_index", "ra", "dec", "z"], "value < 200000", skypatch=SkyPatch(340.0, 20.0, -50.0, -20.0), t_range=(49000.0, None))


_CELLS = [0, 1, 20, 21, 100]


@query(f"SELECT {_pixel(4)} AS cell, row_index FROM {A} a WHERE {_pixel(4)} IN ({', '.join(map(str, _CELLS))})")
def cell_filter_scan(spark, sf):
    rows = _dataset(spark, sf).scan(healpix_cells=_CELLS)
    return rows.select(sphere.healpix_nest("ra", "dec", 4).cast("long").alias("cell"), "row_index")


@query(f"SELECT count(*) AS n_rows FROM {A} a")
def manifest_counts(spark, sf):
    return spark.createDataFrame([(_dataset(spark, sf).n_rows,)], "n_rows long")


@query(f"SELECT {_pixel(4)} AS cell, count(*) AS n_rows, min(ra) AS ra_min, max(ra) AS ra_max, min(dec) AS dec_min, max(dec) AS dec_max, min(z) AS z_min, max(z) AS z_max, min(t_obs) AS t_min, max(t_obs) AS t_max FROM {A} a GROUP BY 1")
def partition_stats(spark, sf):
    """The statistics that writing the dataset left in its manifest."""
    rows = [(p.cell, p.rows, *[v if v is None else float(v) for n in ("ra", "dec", "z", "t") for v in p.ranges[n]]) for p in _dataset(spark, sf).manifest.cells()]
    return spark.createDataFrame(rows, "cell long, n_rows long, " + ", ".join(f"{n}_{e} double" for n in ("ra", "dec", "z", "t") for e in ("min", "max")))


@query(f"SELECT row_index, round(cos(radians(dec)) * cos(radians(ra)), 9) AS x, round(cos(radians(dec)) * sin(radians(ra)), 9) AS y, round(sin(radians(dec)), 9) AS w FROM {A} a")
def unit_vectors(spark, sf):
    x, y, w = sphere.unit_vector("ra", "dec")
    return cat_a(spark, sf).select("row_index", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"), F.round(w, 9).alias("w"))


# ---- weights ----


def _weight(weight: wt.Weight):
    def run(spark, sf):
        return cat_a(spark, sf).select("row_index", F.round(weight.column(), 9).alias("w"))

    return run


def _density(z):
    return photometry.interpolated(z, [0.0, 0.1, 0.3, 0.5], [1e-3, 5e-4, 2e-4, 1e-4])


_DENSITY = "CASE WHEN z <= 0 THEN 1e-3 WHEN z < 1e-1 THEN 1e-3 + z * ((5e-4 - 1e-3) / 1e-1) WHEN z < 3e-1 THEN 5e-4 + (z - 1e-1) * ((2e-4 - 5e-4) / (3e-1 - 1e-1)) WHEN z < 5e-1 THEN 2e-4 + (z - 3e-1) * ((1e-4 - 2e-4) / (5e-1 - 3e-1)) ELSE 1e-4 END"
_W = f"AS w FROM {A} a"
for _name, _w, _sql in (
    ("constant_weight", wt.ConstantWeight(2.5), "2.5e0"),
    ("column_weight", wt.ColumnWeight("value"), "round(value, 9)"),
    ("quality_mask_weight", wt.QualityMaskWeight("variance", "<=", 50), "CASE WHEN variance <= 50 THEN 1e0 ELSE 0e0 END"),
    ("ivar_weight", wt.InverseVarianceWeight("variance"), "round(1e0 / (variance * variance), 9)"),
    ("ivar_floor_weight", wt.InverseVarianceWeight("variance", 3.0), "round(1e0 / (variance * variance + 9e0), 9)"),
    ("fkp_weight", wt.FKPWeight(_density, 1e4), f"round(1e0 / (1e0 + ({_DENSITY}) * 1e4), 9)"),
    ("product_weight", wt.InverseVarianceWeight("variance") * wt.QualityMaskWeight("z", ">", 0.2), "round(1e0 / (variance * variance) * CASE WHEN z > 2e-1 THEN 1e0 ELSE 0e0 END, 9)"),
    ("condition_weight", wt.ConditionWeight("z_type = 'pv'", 0.1), "CASE WHEN z_type = 'pv' THEN 1e-1 ELSE 1e0 END"),
    ("completeness_weight", wt.InverseCompletenessWeight("z", 0.05), "round(1e0 / greatest(5e-2, least(1e0, z)), 9)"),
):
    QUERIES[_name], ORACLES[_name] = _weight(_w), f"SELECT row_index, {_sql} {_W}"


@query(f"SELECT row_index, round(1e0 / (variance * variance), 9) AS w FROM {A} a WHERE z_type = 'spec'")
def default_weights(spark, sf):
    rows = cat_a(spark, sf).where("z_type = 'spec'").withColumn("z_spec_err", F.col("variance"))
    return rows.select("row_index", F.round(wt.default_weight("spectroscopic", "spec").on(rows), 9).alias("w"))


@query(f"SELECT row_index, round(value / (SELECT median(value) FROM {A} m), 9) AS w FROM {A} a")
def signal_to_noise_weight(spark, sf):
    rows = cat_a(spark, sf)
    median = rows.agg(F.percentile("value", F.lit(0.5))).first()[0]
    return rows.select("row_index", F.round(wt.MedianRatioWeight("value", median).on(rows), 9).alias("w"))


# ---- combination ----

_LONG = f"(SELECT row_index AS uid, 'a' AS survey, value, variance FROM {A} a UNION ALL SELECT object_key, 'b', value, variance FROM {B} b)"


def _long(spark, sf):
    a = cat_a(spark, sf).select(F.col("row_index").alias("uid"), F.lit("a").alias("survey"), "value", "variance")
    return a.union(cat_b(spark, sf).select("object_key", F.lit("b"), "value", "variance"))


def _rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    # the shift keeps decimal fractions such as 0.125 away from the middle between two rounded values
    return df.select("uid", F.round(F.col("value") + 3.7e-6, digits).alias("value"), *[F.round(F.col(c) + 3.7e-6, digits).alias(c) for c in ("variance", "weight")], F.col("n_surveys").cast("long").alias("n_surveys"), "surveys")


def _combined_sql(weight: str, variance: str = "round(1 / sum(w) + 37e-7, 5)", digits: int = 5) -> str:
    return f"SELECT uid, round(sum(w * value) / sum(w) + 37e-7, {digits}) AS value, {variance} AS variance, round(sum(w) + 37e-7, {digits}) AS weight, count(DISTINCT survey) AS n_surveys, string_agg(DISTINCT survey, ',' ORDER BY survey) AS surveys FROM (SELECT *, {weight} AS w FROM {_LONG} l) GROUP BY uid"


_BEST = f"(SELECT *, row_number() OVER (PARTITION BY uid ORDER BY variance, survey, value) AS rn FROM {_LONG} l)"


@query(f"SELECT b.uid, round(value + 37e-7, 5) AS value, round(variance + 37e-7, 5) AS variance, round(1 / variance + 37e-7, 5) AS weight, n_surveys, surveys FROM {_BEST} b JOIN (SELECT uid, count(DISTINCT survey) AS n_surveys, string_agg(DISTINCT survey, ',' ORDER BY survey) AS surveys FROM {_LONG} l GROUP BY uid) n ON n.uid = b.uid WHERE rn = 1")
def combine_best_only(spark, sf):
    return _rounded(cmb.combine(_long(spark, sf), strategy="best_only"))


@query(_combined_sql("1 / variance"))
def combine_ivar_average(spark, sf):
    return _rounded(cmb.combine(_long(spark, sf)))


@query(_combined_sql("CASE survey WHEN 'a' THEN 2e0 ELSE 5e-1 END / variance"))
def combine_hyperparameter(spark, sf):
    return _rounded(cmb.combine(_long(spark, sf), strategy="hyperparameter", alpha={"a": 2.0, "b": 0.5}))


@query(_combined_sql("(1 / variance) / avg(1 / variance) OVER (PARTITION BY survey)", "CAST(NULL AS DOUBLE)", 3))
def combine_unit_mean(spark, sf):
    return _rounded(cmb.combine(_long(spark, sf), strategy="unit_mean"), 3)


@query(f"SELECT survey, count(*) AS n FROM {_BEST} b WHERE rn = 1 GROUP BY survey")
def best_only_winners(spark, sf):
    best = cmb.combine(_long(spark, sf), strategy="best_only")
    long = _long(spark, sf).groupBy("uid").agg(F.min(F.struct("variance", "survey")).alias("s"))
    return best.join(long, "uid").groupBy(F.col("s.survey").alias("survey")).agg(F.count(F.lit(1)).alias("n"))


# ---- matching ----

_PAIR = f"SELECT a.row_index AS row_a, b.row_index AS row_b, round({_sep('a', 'b')} * 3600, 6) AS sep FROM {A} a JOIN {B} b ON b.dec BETWEEN a.dec - 1e-3 AND a.dec + 1e-3 WHERE {_sep('a', 'b')} * 3600 <= 1e0"


def _both(spark, sf):
    return {"a": cat_a(spark, sf), "b": cat_b(spark, sf)}


def _pairs(spark, sf, rules, catalogs=None):
    p = matched_pairs(stacked(catalogs or _both(spark, sf)), rules, ["a", "b"])
    return p.select(F.col("l_row_index").alias("row_a"), F.col("r_row_index").alias("row_b"), F.round("sep_arcsec", 6).alias("sep"))


@query(_PAIR)
def sky_pairs(spark, sf):
    p = spherical_join(cat_a(spark, sf).select("row_index", "ra", "dec"), cat_b(spark, sf).select("row_index", "ra", "dec"), TOL)
    return p.select(F.col("l_row_index").alias("row_a"), F.col("r_row_index").alias("row_b"), F.round("sep_arcsec", 6).alias("sep"))


@query(f"{_PAIR} AND abs(a.z - b.z) <= {DZ}")
def match_pairs_rules(spark, sf):
    return _pairs(spark, sf, MatchRules(TOL, DZ))


@query(f"{_PAIR} AND NOT (least(a.z_type, b.z_type) = 'phot' AND greatest(a.z_type, b.z_type) = 'spec') AND abs(a.z - b.z) <= {DZ}")
def match_reject_ztype(spark, sf):
    return _pairs(spark, sf, MatchRules(TOL, DZ, reject_types=frozenset({("spec", "phot")})))


@query(f"{_PAIR} AND abs(a.z - b.z) <= CASE WHEN least(a.z_type, b.z_type) = 'phot' AND greatest(a.z_type, b.z_type) = 'phot' THEN 5e0 ELSE {DZ} END")
def match_dz_by_types(spark, sf):
    return _pairs(spark, sf, MatchRules(TOL, DZ, {("phot", "phot"): None}))


@query(f"{_PAIR} AND (a.row_index % 50 = 0 OR abs(a.z - b.z) <= {DZ})")
def match_null_z_kept(spark, sf):
    a = cat_a(spark, sf).withColumn("z", F.when(F.col("row_index") % 50 != 0, F.col("z")))
    return _pairs(spark, sf, MatchRules(TOL, DZ), {"a": a, "b": cat_b(spark, sf)})


# ---- identities: components by a recursive walk over the accepted pairs ----

_NODE = 281474976710656
_IDS = f"""WITH RECURSIVE pair AS MATERIALIZED ({_PAIR} AND abs(a.z - b.z) <= {DZ}),
 edge AS (SELECT row_a AS x, row_b + {_NODE} AS y FROM pair UNION SELECT row_b + {_NODE}, row_a FROM pair),
 reach(node, other) AS (SELECT x, x FROM edge UNION SELECT r.node, e.y FROM reach r JOIN edge e ON e.x = r.other),
 part AS (SELECT node, min(other) AS first FROM reach GROUP BY node),
 node AS (SELECT 'a' AS dataset, row_index, row_index AS node, ra, dec, z, z_type, value FROM {A} a UNION ALL SELECT 'b', row_index, row_index + {_NODE}, ra, dec, z, z_type, value FROM {B} b),
 idx AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY coalesce(p.first, n.node)) - 1 AS uid, n.dataset, n.row_index, n.ra, n.dec, n.z, n.z_type, n.value FROM node n LEFT JOIN part p ON p.node = n.node),
 multi AS (SELECT uid FROM idx GROUP BY uid HAVING count(DISTINCT dataset) > 1) """


def _built(spark, sf) -> IdentityIndex:
    rules = MatchRules(TOL, DZ)
    return IdentityIndex(cross_match(_both(spark, sf), rules).rows.withColumn("survey_type", F.lit("spectroscopic")), rules)


def _index(spark, sf) -> IdentityIndex:
    """The index as it is used: built once, stored, and asked many times."""

    def make(_):
        index = _built(spark, sf)
        return replace(index, rows=staged(index.rows, "identity"))

    return _once(spark, sf, "identity", make)


def _attributes(spark, sf):
    return {n: df.select("row_index", "ra", "value", *(["t_obs"] if n == "a" else ["variance"])) for n, df in _both(spark, sf).items()}


@query(_IDS + "SELECT uid, dataset, row_index FROM idx")
def identity_index(spark, sf):
    return _built(spark, sf).rows.select("uid", "dataset", "row_index")


@query(_IDS + "SELECT count(DISTINCT uid) AS n_unique, (SELECT count(*) FROM multi) AS n_multi FROM idx")
def identity_counts(spark, sf):
    counts = cross_match(_both(spark, sf), MatchRules(TOL, DZ)).counts()
    return spark.createDataFrame([(counts["n_unique"], counts["n_multi"])], "n_unique long, n_multi long")


@query(_IDS + "SELECT uid, dataset, row_index FROM idx WHERE uid IN (SELECT uid FROM multi)")
def multi_only(spark, sf):
    return _index(spark, sf).multi_only().select("uid", "dataset", "row_index")


@query(_IDS + "SELECT dense_rank() OVER (ORDER BY uid) - 1 AS uid, dataset, row_index FROM idx WHERE dataset = 'b'")
def restrict_to(spark, sf):
    return _index(spark, sf).restrict_to(["b"]).rows.select("uid", "dataset", "row_index")


@query(_IDS + "SELECT DISTINCT dataset FROM idx")
def datasets_distinct(spark, sf):
    return spark.createDataFrame([(d,) for d in _index(spark, sf).datasets()], "dataset string")


@query(_IDS + "SELECT DISTINCT uid FROM idx WHERE uid IN (0, 5, 17, 99999999)")
def select_ids(spark, sf):
    return IdentityQuery(_index(spark, sf)).from_ids([0, 5, 17, 99999999])


@query(_IDS + "SELECT DISTINCT uid FROM idx WHERE dataset = 'b'")
def foreign_ids(spark, sf):
    return IdentityQuery(_index(spark, sf)).from_foreign_ids("b", cat_b(spark, sf).select("row_index"))


_PICK = f"SELECT DISTINCT uid FROM idx a WHERE {_cone(180, 0, 20)} AND z BETWEEN 5e-2 AND 3e-1"


def _picked(spark, sf):
    q = IdentityQuery(_index(spark, sf), _attributes(spark, sf))
    return q, staged(q.from_selection([Cone(180.0, 0.0, 20.0), Shell(0.05, 0.3)]), "picked")


@query(_IDS + _PICK)
def select_cone_shell(spark, sf):
    return _picked(spark, sf)[1]


@query(_IDS + f"SELECT uid, dataset, row_index FROM idx WHERE uid IN ({_PICK})")
def index_for(spark, sf):
    q, uids = _picked(spark, sf)
    return q.index_for(uids).select("uid", "dataset", "row_index")


@query(_IDS + f"SELECT uid, dataset, i.row_index, value, b.variance FROM idx i LEFT JOIN (SELECT 'b' AS ds, row_index AS r, variance FROM {B} b) b ON b.ds = i.dataset AND b.r = i.row_index WHERE uid IN ({_PICK})")
def partial_for(spark, sf):
    q, uids = _picked(spark, sf)
    return q.partial_for(uids, ["value", "variance"]).select("uid", "dataset", "row_index", "value", "variance")


@query(_IDS + f"SELECT uid, dataset, i.row_index, i.ra, value, a.t_obs, b.variance FROM idx i LEFT JOIN (SELECT 'b' AS ds, row_index AS r, variance FROM {B} b) b ON b.ds = i.dataset AND b.r = i.row_index LEFT JOIN (SELECT 'a' AS ds, row_index AS r, t_obs FROM {A} a) a ON a.ds = i.dataset AND a.r = i.row_index WHERE uid IN ({_PICK})")
def full_for(spark, sf):
    q, uids = _picked(spark, sf)
    return q.full_for(uids).select("uid", "dataset", "row_index", "ra", "value", "t_obs", "variance")


@query(_IDS + "SELECT uid, dataset, row_index, value FROM idx")
def iter_partial(spark, sf):
    q = IdentityQuery(_index(spark, sf), _attributes(spark, sf))
    n, out = q.index.rows.agg(F.max("uid")).first()[0] + 1, None
    for part in q.iter_partial(range(n), ["value"], -(-n // 3)):
        part = part.select("uid", "dataset", "row_index", "value")
        out = part if out is None else out.unionByName(part)
    return out


@query(_IDS + f"SELECT i.uid, dataset AS survey, i.row_index, round(value, 6) AS value FROM idx i WHERE uid IN (SELECT uid FROM multi)")
def concurrences(spark, sf):
    index = _index(spark, sf)
    catalog = cmb.WeightedCatalog(_both(spark, sf), staged(index.multi_only().select("uid", "dataset", "row_index"), "matched"))
    return catalog.concurrences("value", "variance").select("uid", "survey", "row_index", F.round("value", 6).alias("value"))


@query(_IDS + f"SELECT uid, round(sum(value / variance) / sum(1 / variance) + 37e-7, 5) AS value, round(1 / sum(1 / variance), 6) AS variance, count(DISTINCT dataset) AS n_surveys FROM (SELECT i.uid, i.dataset, i.value, coalesce(a.variance, b.variance) AS variance FROM idx i LEFT JOIN {A} a ON i.dataset = 'a' AND a.row_index = i.row_index LEFT JOIN {B} b ON i.dataset = 'b' AND b.row_index = i.row_index) GROUP BY uid")
def weighted_catalog(spark, sf):
    catalog = cmb.WeightedCatalog(_both(spark, sf), staged(_index(spark, sf).rows.select("uid", "dataset", "row_index"), "matched"))
    done = catalog.combine("value", "variance")
    return done.select("uid", F.round(F.col("value") + 3.7e-6, 5).alias("value"), F.round("variance", 6).alias("variance"), F.col("n_surveys").cast("long").alias("n_surveys"))


@query(_IDS + "SELECT round(median(d), 9) AS median_dz, round(quantile_cont(d, 9e-1), 9) AS p90_dz, round(avg(CASE WHEN d < 4e-4 THEN 1e0 ELSE 0e0 END), 9) AS share FROM (SELECT abs(min(z) FILTER (dataset = 'a') - min(z) FILTER (dataset = 'b')) AS d FROM idx WHERE uid IN (SELECT uid FROM multi) GROUP BY uid)")
def dz_quantiles(spark, sf):
    per = _index(spark, sf).multi_only().groupBy("uid").agg(*[F.min(F.when(F.col("dataset") == d, F.col("z"))).alias(d) for d in "ab"])
    d = per.select(F.abs(F.col("a") - F.col("b")).alias("d"))
    return d.agg(F.round(F.percentile("d", F.lit(0.5)), 9).alias("median_dz"), F.round(F.percentile("d", F.lit(0.9)), 9).alias("p90_dz"), F.round(F.avg((F.col("d") < 4e-4).cast("double")), 9).alias("share"))


# ---- links ----

_LINK = f"SELECT b.row_index AS parent, a.row_index AS child, {_sep('a', 'b')} * 3600 AS sep, b.z - a.z AS dz, count(*) OVER (PARTITION BY a.row_index) AS n FROM {A} a JOIN {B} b ON b.dec BETWEEN a.dec - 1e-3 AND a.dec + 1e-3 WHERE {_sep('a', 'b')} * 3600 <= 2e0 AND abs(a.z - b.z) <= {DZ}"
_LINKED = "SELECT parent, child, round(CAST(1e0 / n AS FLOAT), 4) AS confidence, round(CAST(sep AS FLOAT), 4) AS sep, round(CAST(dz AS FLOAT), 6) AS dz FROM"


def _links(spark, sf, ambiguous: bool) -> DataFrame:
    side = lambda df, name: df.select(F.lit(name).alias("dataset"), F.col("row_index").alias("uid"), "ra", "dec", "z")
    rules = LinkRules("b", "a", 2.0, DZ, accept_ambiguous=ambiguous)
    return link(side(cat_b(spark, sf), "b"), side(cat_a(spark, sf), "a"), rules)


def _link_columns(df):
    return df.select("parent", "child", F.round("confidence", 4).alias("confidence"), F.round("sky_sep_arcsec", 4).alias("sep"), F.round("dz", 6).alias("dz"))


@query(f"{_LINKED} ({_LINK}) WHERE n = 1")
def sub_links_strict(spark, sf):
    return _link_columns(_links(spark, sf, False))


@query(f"{_LINKED} ({_LINK})")
def sub_links_ambiguous(spark, sf):
    return _link_columns(_links(spark, sf, True))


@query(f"SELECT child FROM ({_LINK}) WHERE parent = (SELECT min(parent) FROM ({_LINK}))")
def children_of(spark, sf):
    rows = staged(_links(spark, sf, True), "links")
    parent = rows.agg(F.min("parent")).first()[0]
    return spark.createDataFrame([(c,) for c in LinkSet(rows, LinkRules("b", "a")).children_of(parent)], "child long")


@query(f"SELECT parent FROM ({_LINK}) WHERE child = (SELECT min(child) FROM ({_LINK}) WHERE n > 1)")
def parent_of(spark, sf):
    rows = staged(_links(spark, sf, True), "links")
    child = rows.where("confidence < 1").agg(F.min("child")).first()[0]
    found = LinkSet(rows, LinkRules("b", "a")).parent_of(child) if child is not None else []
    return spark.createDataFrame([(p,) for p in (found if isinstance(found, list) else [found])], "parent long")


# ---- light curves, sightlines, maps, vectors ----

_MJD = "date_diff('day', DATE '1858-11-17', CAST(ts AS DATE))"


def _light_curves(spark, sf):
    events = _table(spark, sf, "events")
    epochs = events.select(F.col("user_id").alias("object_id"), F.datediff(F.to_date("ts"), F.lit("1858-11-17").cast("date")).cast("double").alias("mjd"), F.col("event_type").alias("filter"), F.col("value").alias("flux"), F.lit(1.0).alias("flux_err"), F.lit(0).alias("flag"))
    objects = events.select("user_id").distinct().selectExpr("user_id AS object_id", "(user_id * 7919 % 3600000) * 1e-4 AS ra", "(user_id * 104729 % 1200000) * 1e-4 - 60e0 AS dec")
    return objects, epochs


@query(f"SELECT user_id AS object_id, count(*) AS n_epochs, CAST(min({_MJD}) AS DOUBLE) AS mjd_min, CAST(max({_MJD}) AS DOUBLE) AS mjd_max FROM events GROUP BY user_id")
def lightcurve_objects(spark, sf):
    objects, epochs = _light_curves(spark, sf)
    return ingest.epoch_statistics(objects, epochs).select("object_id", F.col("n_epochs").cast("long").alias("n_epochs"), "mjd_min", "mjd_max")


@query("SELECT DISTINCT user_id AS object_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def lightcurve_orphans(spark, sf):
    _, epochs = _light_curves(spark, sf)
    return ingest.orphan_epochs(_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("object_id")), epochs)


@query("SELECT vec_id AS sightline_id, label, count(*) AS n_pixels, round(sum(d * w) / sum(w), 6) AS mean_delta FROM (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS d, 1e0 + (generate_subscripts(embedding, 1) - 1) % 5 AS w FROM embeddings) GROUP BY ALL")
def sightline_join(spark, sf):
    def make(place):
        source = _table(spark, sf, "embeddings")
        objects = source.selectExpr("vec_id AS sightline_id", "label", "vec_id * 7919 % 3600 / 10e0 AS ra", "vec_id * 104729 % 1200 / 10e0 - 60e0 AS dec", "2e0 AS z_source", "'e' AS survey_id", "size(embedding) AS n_pixels")
        data = source.select(F.col("vec_id").alias("sightline_id"), F.posexplode("embedding").alias("pos", "d")).select("sightline_id", (3.55 + F.col("pos") * 1e-4).alias("loglam"), F.col("d").cast("double").alias("delta"), (1.0 + F.col("pos") % 5).alias("weight"))
        ingest.write_sightlines(objects, data, place, "sightlines")
        return DatasetView.open(spark, place)

    view = _once(spark, sf, "sightlines", make)
    joined = view.scan(["sightline_id", "delta", "weight"]).join(view.objects(["sightline_id", "label"]), "sightline_id").groupBy("sightline_id", "label")
    return joined.agg(F.count(F.lit(1)).alias("n_pixels"), F.round(F.sum(F.col("delta") * F.col("weight")) / F.sum("weight"), 6).alias("mean_delta"))


@query(f"SELECT row_index, p_retailprice AS map_value FROM {A} a JOIN part ON p_partkey = 1 + {_pixel(4)}")
def healpix_map_lookup(spark, sf):
    def make(place):
        data = _table(spark, sf, "part").where("p_partkey BETWEEN 1 AND 192").select((F.col("p_partkey") - 1).cast("long").alias("healpix_index"), F.col("p_retailprice").cast("double").alias("value"))
        ingest.write_sky_map(data, place, "part_map", nside=4)
        return DatasetView.open(spark, place)

    sky_map = _once(spark, sf, "sky-map", make).scan(["healpix_index", F.col("value").alias("map_value")])
    placed = cat_a(spark, sf).select("row_index", sphere.healpix_nest("ra", "dec", 4).alias("healpix_index"))
    return placed.join(sky_map, "healpix_index").select("row_index", "map_value")


@query(f"SELECT row_index, round(CAST(22.5e0 - 2.5e0 * log10(value) AS FLOAT), 3) AS mag FROM {A} a")
def flux_to_mag(spark, sf):
    return cat_a(spark, sf).select("row_index", F.round(photometry.flux_to_magnitude("value"), 3).alias("mag"))


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS v_u, round(CAST(embedding[2] AS DOUBLE), 6) AS v_g, round(CAST(embedding[5] AS DOUBLE), 6) AS v_z FROM embeddings")
def vector_explode(spark, sf):
    rows = _table(spark, sf, "embeddings").select("vec_id", *photometry.bands("embedding", "v"))
    return rows.select("vec_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("v_u", "v_g", "v_z")])


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS n FROM embeddings")
def dla_count(spark, sf):
    return _table(spark, sf, "embeddings").select("vec_id", photometry.count_positive("embedding").cast("long").alias("n"))


@query(f"SELECT CAST(floor(z / 5e-2) AS BIGINT) AS bin, count(*) AS n, round(count(*) / (pow((floor(z / 5e-2) + 1) * 5e-2, 3) - pow(floor(z / 5e-2) * 5e-2, 3)), 4) AS density FROM {A} a GROUP BY floor(z / 5e-2)")
def nz_histogram(spark, sf):
    counts = cat_a(spark, sf).groupBy(F.floor(F.col("z") / 5e-2).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    b = F.col("bin")
    return counts.withColumn("density", F.round(F.col("n") / (F.pow((b + 1) * 5e-2, F.lit(3.0)) - F.pow(b * 5e-2, F.lit(3.0))), 4))


@query(f"SELECT z_type, count(*) AS n, round(avg(5 * log10(299792.458e0 * z / 67.36e0) + 25), 6) AS mean_modulus, round(avg(ln(10e0) / 5 * variance * z * 299792.458e0), 3) AS mean_error FROM {A} a GROUP BY z_type")
def distance_functions(spark, sf):
    return cat_a(spark, sf).groupBy("z_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(photometry.distance_modulus(photometry.hubble_distance("z"))), 6).alias("mean_modulus"), F.round(F.avg(photometry.velocity_error("variance", "z")), 3).alias("mean_error"))


@query(f"SELECT dataset, count(*) AS n, count(t_obs) AS n_t FROM (SELECT 'a' AS dataset, t_obs FROM {A} a UNION ALL SELECT 'b', NULL FROM {B} b) GROUP BY dataset")
def outer_union(spark, sf):
    both = cat_a(spark, sf).withColumn("dataset", F.lit("a")).unionByName(cat_b(spark, sf).withColumn("dataset", F.lit("b")), allowMissingColumns=True)
    return both.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count("t_obs").alias("n_t"))


# ---- versions ----

_DAY = "strftime(DATE '2020-01-01' + CAST(n_nationkey AS INTEGER), '%Y-%m-%d')"
_V = f"(SELECT n_name AS id, n_regionkey AS region, {_DAY} AS valid_from, lead({_DAY}) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS valid_to FROM nation)"


def _database(spark, sf) -> Database:
    """Every nation is a version of its region's dataset, valid from a day until the region's next one begins."""

    def make(place):
        last: dict[int, str] = {}
        for r in _table(spark, sf, "nation").orderBy("n_nationkey").collect():
            name, region = r["n_name"].lower().replace(" ", "-"), r["n_regionkey"]
            began = (date(2020, 1, 1) + timedelta(days=r["n_nationkey"])).isoformat() + "T00:00:00+00:00"
            validity = Validity(began, supersedes=last.get(region))
            write_manifest(f"{place}/r{region}/{name}", Manifest(r["n_name"], f"r{region}", Geometry.POINT, (), validity=validity, written=began))
            last[region] = f"r{region}_{name}"
        return place

    return Database(spark, _once(spark, sf, "versions", make))


def _version_rows(spark, entries) -> DataFrame:
    rows = [(e.manifest.survey_name, int(e.manifest.survey_type[1:]), e.manifest.validity.valid_from_utc[:10], e.manifest.validity.valid_to_utc and e.manifest.validity.valid_to_utc[:10]) for e in entries]
    return spark.createDataFrame(rows, "id string, region long, valid_from string, valid_to string")


@query(f"SELECT id, region FROM {_V} WHERE valid_from <= '2020-01-13' AND (valid_to IS NULL OR '2020-01-13' < valid_to)")
def as_of_snapshot(spark, sf):
    db = _database(spark, sf).as_of("2020-01-13T12:00:00+00:00")
    return _version_rows(spark, [db.entry(n) for n in db]).select("id", "region")


@query(f"SELECT id, region, valid_from, valid_to FROM {_V}")
def supersession_close(spark, sf):
    return _version_rows(spark, _database(spark, sf).every.values())


@query(f"SELECT id, region, valid_from FROM {_V} WHERE region = 2")
def versions_sorted(spark, sf):
    return _version_rows(spark, _database(spark, sf).versions_of_root("r2")).select("id", "region", "valid_from")


@query(f"SELECT id FROM {_V} WHERE valid_to IS NULL")
def valid_now(spark, sf):
    """What Database lists without an instant: the open versions."""
    db = _database(spark, sf)
    return _version_rows(spark, [db.entry(n) for n in db.list()]).select("id")


@query(f"SELECT 'r' || region AS survey_type, count(*) AS n FROM {_V} WHERE valid_to IS NULL GROUP BY region")
def survey_types(spark, sf):
    db = _database(spark, sf)
    return spark.createDataFrame([(t, len(db.list(t))) for t in db.types], "survey_type string, n long")


@query()
def dummy_catalog(spark, sf):
    from ..sources.loaders import load_catalog

    return load_catalog(spark, "dummy", selection=Shell(0.01, 0.1), columns=["galaxy_id", "ra", "dec", "z", "v_pec", "mu"])


@query(f"SELECT uid, dataset, row_index FROM (SELECT 0 AS uid, '' AS dataset, 0 AS row_index) WHERE false")
def empty_match(spark, sf):
    return cross_match({}, MatchRules()).rows.select("uid", "dataset", "row_index")
