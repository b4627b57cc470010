import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from astrolane.functions import photometry, sphere


def grid(spark, n=4000, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(float(a), float(d)) for a, d in zip(rng.uniform(-10, 370, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n))))]
    return spark.createDataFrame(rows + [(0.0, 90.0), (12.0, -90.0), (359.999999, 0.0), (float("nan"), 1.0)], "ra double, dec double")


@pytest.mark.parametrize("nside", [1, 4, 32])
def test_cells_are_those_of_the_nearest_centres(spark, nside):
    rows = grid(spark).withColumn("p", sphere.healpix_nest("ra", "dec", nside)).toPandas()
    assert rows[rows.ra.isna()].p.isna().all()
    rows = rows[rows.ra.notna()]
    centres = sphere.cell_centres(nside)
    a, d = np.radians(rows.ra), np.radians(rows.dec)
    v = np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], axis=1)
    sep = np.degrees(np.arccos(np.clip((v * centres[rows.p.astype(int)]).sum(axis=1), -1, 1)))
    assert sep.max() < sphere.cell_radius(nside)
    assert rows.p.between(0, 12 * nside**2 - 1).all()


@pytest.mark.parametrize("nside", [1, 8])
def test_a_centre_lies_in_its_own_cell(spark, nside):
    v = sphere.cell_centres(nside)
    rows = spark.createDataFrame([(i, float(np.degrees(np.arctan2(y, x))), float(np.degrees(np.arcsin(z)))) for i, (x, y, z) in enumerate(v)], "i long, ra double, dec double")
    assert rows.where(sphere.healpix_nest("ra", "dec", nside) != F.col("i")).count() == 0


@pytest.mark.parametrize("ra,dec,r", [(180, 0, 20), (5, 85, 10), (359, -89, 3)])
def test_cone_cover_misses_nothing(spark, ra, dec, r):
    cells = sphere.cone_cells(ra, dec, r, 8)
    rows = grid(spark).withColumn("p", sphere.healpix_nest("ra", "dec", 8)).where(sphere.separation("ra", "dec", ra, dec) <= r)
    assert rows.where(~F.col("p").isin(cells)).count() == 0 and len(cells) < 12 * 64


def test_box_cover_misses_nothing(spark):
    for box in ((10, 60, -20, 30), (350, 10, -10, 10), (0, 90, 60, 89), (5, 6, -90, -80)):
        cells = sphere.box_cells(*box, 8)
        inside = (F.col("dec").between(box[2], box[3])) & (F.pmod(F.col("ra") - box[0], F.lit(360.0)) <= (box[1] - box[0]) % 360)
        rows = grid(spark).withColumn("p", sphere.healpix_nest("ra", "dec", 8)).where(inside)
        assert rows.where(~F.col("p").isin(cells)).count() == 0


def test_separations_agree_and_chords_invert(spark):
    row = spark.range(1).select(sphere.separation(10.0, 20.0, 10.0001, 20.0).alias("a"), sphere.haversine(10.0, 20.0, 10.0001, 20.0).alias("b"), sphere.arcsec_of_chord(F.lit(sphere.chord_of_arcsec(7.5))).alias("c")).first()
    assert math.isclose(row["a"], row["b"], rel_tol=1e-6) and math.isclose(row["c"], 7.5, rel_tol=1e-9)


def test_photometry(spark):
    row = spark.sql("SELECT 100D AS f, 0D AS g, CAST(NULL AS DOUBLE) AS h, array(1D, -1D, 3D) AS v").select(photometry.flux_to_magnitude("f"), photometry.flux_to_magnitude("g"), photometry.flux_to_magnitude("h"), photometry.count_positive("v"), photometry.element("v", 2), photometry.element("v", 9)).first()
    assert list(row) == [17.5, None, None, 2, 3.0, None]
