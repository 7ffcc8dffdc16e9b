"""Bricks: cells of the sky of a quarter degree, and per-brick pixel lookups."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BRICK = 0.25
NORTH = 32.375


def brick_columns(ra: Column, dec: Column, size: float = BRICK) -> dict[str, Column]:
    """brickrow, brickcol, brickname and the centre of the brick of a point.

    Rows are bands of declination, centred on multiples of size from -90; a row has an even number of columns, at least
    as many as keep them no wider than size at its edge nearest the equator.
    """
    rows = int(round(180 / size))
    row = F.least(F.floor((dec + 90.0 + size / 2) / size), F.lit(rows)).cast("int")
    mid = row * size - 90.0
    edge = F.greatest(F.lit(0.0), F.abs(mid) - size / 2)
    n = (F.ceil(F.lit(360.0 / size) * F.cos(F.radians(edge)) / 2) * 2).cast("int")
    n = F.when((row == 0) | (row == rows), F.lit(1)).otherwise(n)
    col = F.least(F.floor(F.pmod(ra, F.lit(360.0)) * n / 360.0), n - 1).cast("int")
    ra_mid = (col + 0.5) * 360.0 / n
    sign = F.when(mid < 0, "m").otherwise("p")
    name = F.concat(F.lpad(F.floor(ra_mid * 10).cast("string"), 4, "0"), sign, F.lpad(F.floor(F.abs(mid) * 10 + 1e-9).cast("string"), 3, "0"))
    return {"brickrow": row, "brickcol": col, "brickname": name, "brick_ra": ra_mid, "brick_dec": mid}


def with_bricks(points: DataFrame, ra: str = "RA", dec: str = "DEC", size: float = BRICK) -> DataFrame:
    cols = brick_columns(F.col(ra), F.col(dec), size)
    return points.withColumns(cols).withColumn("photsys", F.when(F.col("brick_dec") > NORTH, "N").otherwise("S"))


def tangent_pixel(ra, dec, ra0, dec0, scale: float, center: float):
    """Nearest pixel (x, y) of a tangent-plane image centred on a brick; scale in degrees a pixel."""
    ra, dec, ra0, dec0 = (np.radians(np.asarray(v, float)) for v in (ra, dec, ra0, dec0))
    c = np.sin(dec0) * np.sin(dec) + np.cos(dec0) * np.cos(dec) * np.cos(ra - ra0)
    x = -np.cos(dec) * np.sin(ra - ra0) / c
    y = (np.cos(dec0) * np.sin(dec) - np.sin(dec0) * np.cos(dec) * np.cos(ra - ra0)) / c
    return (np.rint(np.degrees(x) / scale + center).astype(int), np.rint(np.degrees(y) / scale + center).astype(int))


def pixel_values(points: DataFrame, images: dict, schema: str, ra: str = "RA", dec: str = "DEC", row_id: str = "row_id", salt: int = 1) -> DataFrame:
    """Columns of pixel values for each point.

    images: {column: (open, default)}; open(brickname, region) gives (array[y, x], degrees a pixel, centre pixel), or
    None where there is no image, whose points get the default. Each brick's image is read once by the task that has the
    brick (`salt` tasks share the points of a brick). schema: the added columns, e.g. "maskbits short".
    """
    keep = points.select(row_id, ra, dec)
    b = with_bricks(keep, ra, dec).withColumn("part", F.pmod(F.xxhash64(row_id), F.lit(salt)))
    names = [c.split()[0] for c in schema.split(",")]

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        brick, region = frame.brickname.iloc[0], frame.photsys.iloc[0]
        out = {row_id: frame[row_id]}
        for n in names:
            open_, default = images[n]
            image = open_(brick, region)
            if image is None:
                out[n] = np.full(len(frame), default)
            else:
                data, scale, center = image
                x, y = tangent_pixel(frame[ra], frame[dec], frame.brick_ra.iloc[0], frame.brick_dec.iloc[0], scale, center)
                inside = (x >= 0) & (y >= 0) & (x < data.shape[1]) & (y < data.shape[0])
                v = np.full(len(frame), default, dtype=data.dtype)
                v[inside] = data[y[inside], x[inside]]
                out[n] = v
        return pd.DataFrame(out)

    kind = dict(points.dtypes)[row_id]
    return points.join(b.groupBy("brickname", "photsys", "part").applyInPandas(gather, f"{row_id} {kind}, {schema}"), row_id)


def hashed_pixel(brickname: Column, x: Column, y: Column, bits: int = 8) -> Column:
    """A stand-in for an image: a value of some bits from md5 of brick and pixel."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", brickname, x.cast("string"), y.cast("string"))), 1, 8), 16, 10).cast("long") % (1 << bits)


