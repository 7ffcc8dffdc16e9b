"""Sources and sinks: catalogs with metadata, ECSV and text tables, FITS binary tables, tiles and cached lattices."""

from __future__ import annotations

import csv as _csv
import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.catalog import BoxCatalog, ParticleCatalog


def write_catalog(catalog: ParticleCatalog, path: str, files: int | None = None, exclude=(), group: str | None = None, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Rows without excluded columns, in `files` files when given, and the metadata as a JSON text beside them."""
    df = catalog.df.drop(*exclude)
    if files:
        df = df.repartition(files)
    where = f"{path}/{group}" if group else path
    df.write.mode(mode).format(fmt).save(f"{where}/rows")
    meta = {"position": catalog.position, "velocity": catalog.velocity, "vectors": sorted(catalog.vectors), "invariants": sorted(catalog.invariants), "attrs": catalog.attrs, "row_id": catalog.row_id}
    if isinstance(catalog, BoxCatalog):
        meta |= {"boxsize": catalog.boxsize, "boxcenter": catalog.boxcenter}
    text = json.dumps(meta, default=lambda v: np.asarray(v).tolist())
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(f"{where}/meta")


def read_catalog(spark: SparkSession, paths, group: str | None = None, fmt: str = "parquet", **changes) -> ParticleCatalog:
    """One catalog or several with the same columns; Spark reads only the columns and row groups that are used."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    paths = [f"{p}/{group}" if group else p for p in paths]
    df = spark.read.format(fmt).load([f"{p}/rows" for p in paths])
    meta = json.loads(spark.read.text(f"{paths[0]}/meta").first().value) | changes
    for k in ("vectors", "invariants"):
        meta[k] = frozenset(meta[k])
    return (BoxCatalog if "boxsize" in meta else ParticleCatalog)(df, **meta)


def parse_ecsv(text: str) -> tuple[list[str], list[dict]]:
    """Column names and rows of an ECSV table with blanks or commas as delimiter; JSON cells become lists."""
    names, rows, types, delimiter = [], [], {}, " "
    for line in text.splitlines():
        if line.startswith("#"):
            if m := re.search(r"name:\s*'?([^,'}]+?,?)'?,\s*datatype:\s*(\w+)(?:,\s*subtype:\s*'([^']+)')?", line):
                types[m[1]] = m[3] or m[2]
            if m := re.search(r"delimiter:\s*'?(.)'?", line):
                delimiter = m[1]
            continue
        if not line.strip():
            continue
        cells = next(_csv.reader([line.strip()], delimiter=delimiter, skipinitialspace=True))
        if not names:
            names = [c.rstrip(",") for c in cells]
            continue
        rows.append({n: _cell(c) for n, c in zip(names, cells)})
    return names, rows


def _cell(c: str):
    if c.startswith("["):
        return [float(v) for v in json.loads(c)]
    for kind in (int, float):
        try:
            return kind(c)
        except ValueError:
            pass
    return c


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # small tables of settings


def read_ecsv(spark: SparkSession, path: str) -> DataFrame:
    names, rows = parse_ecsv(read_text(spark, path))
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], names)


def precedence_union(tables: list[DataFrame], key: str) -> DataFrame:
    """Concatenate, keeping of what came before only rows below the next table's least key."""
    out = tables[0]
    for t in tables[1:]:
        low = t.agg(F.min(key).alias("m")).first().m
        out = out.where(F.col(key) < F.lit(low)).unionByName(t)
    return out.orderBy(key)


def read_nz_text(spark: SparkSession, path: str, header: int = 1, distance=None) -> DataFrame:
    """(zmin, zmax, nz, zmid, volume) of a white-space table; volume is d(zmax)^3 - d(zmin)^3."""
    lines = [l.split() for l in read_text(spark, path).splitlines()[header:] if l.strip() and not l.startswith("#")]  # noqa: E741
    rows = [tuple(map(float, l[:3])) for l in lines]  # noqa: E741
    d = distance or (lambda z: np.asarray(z, float))
    return spark.createDataFrame([(a, b, n, (a + b) / 2, float(d(b) ** 3 - d(a) ** 3)) for a, b, n in rows], "zmin double, zmax double, nz double, zmid double, volume double")


def tiles_for_program(tiles: DataFrame, observed: DataFrame, program: str, npasses: int, obsconditions: int = 1) -> DataFrame:
    """Observed tiles of a program in the first passes, with a constant OBSCONDITIONS."""
    kept = tiles.where((F.col("PROGRAM") == program) & (F.col("PASS") < npasses))
    return kept.join(observed.select("TILEID").distinct(), "TILEID", "left_semi").withColumn("OBSCONDITIONS", F.lit(obsconditions))


#: The data reduction of a release, and the last night of its first year.
RELEASES = {"sv3": "fuji", "m3": "daily", "y1": "daily", "y5": None}
LAST_NIGHT_Y1 = 20220613


def tiles_for_release(tiles: DataFrame, release: str, program: str = "dark") -> DataFrame:
    """TILEID, RA, DEC, PASS of the tiles of a release: survey and program, and for y1 up to its last night."""
    if release not in RELEASES:
        raise ValueError(f"unknown release {release}")
    survey = "sv3" if release == "sv3" else "main"
    out = tiles.where((F.col("SURVEY") == survey) & (F.col("FAPRGRM") == program))
    if release == "y1":
        out = out.where(F.col("LASTNIGHT") <= LAST_NIGHT_Y1)
    return out.withColumnRenamed("TILERA", "RA").withColumnRenamed("TILEDEC", "DEC")


def read_tiles_csv(spark: SparkSession, path: str, schema: str, skip: int = 18) -> DataFrame:
    """Tiles from a CSV file whose table follows `skip` lines of comment: one line of names, then rows. schema names the
    columns that are wanted."""
    lines = read_text(spark, path).splitlines()[skip:]  # some ten thousand tiles
    wanted = [c.split()[0] for c in schema.split(",")]
    kinds = {"string": str, "int": int, "long": int, "bigint": int, "double": float}
    cast = [kinds[c.split()[1].lower()] for c in schema.split(",")]
    rows = [tuple(k(r[n]) for n, k in zip(wanted, cast)) for r in _csv.DictReader(lines)]
    return spark.createDataFrame(rows, schema)


def read_sky_targets(spark: SparkSession, paths, tiles: DataFrame, radius: float, schema: str = "TARGETID long, RA double, DEC double", fmt: str = "fits") -> DataFrame:
    """Sky targets, of files of any number, that lie within a tile."""
    from skyloom.operators.footprint import points_in_tiles

    rows = read_fits(spark, paths, schema) if fmt == "fits" else spark.read.format(fmt).load(paths).select(*[c.split()[0] for c in schema.split(",")])
    return rows.join(points_in_tiles(rows, tiles, radius, row_id="TARGETID").select("TARGETID").distinct(), "TARGETID", "left_semi")


def tile_files(tiles: DataFrame, template: str = "{head}/{tile}.fits") -> list[str]:
    """One path a tile, from its number padded to six digits; head is its first three."""
    ids = sorted(r.TILEID for r in tiles.select("TILEID").distinct().collect())  # some thousand tiles
    return [template.format(head=f"{t:06d}"[:3], tile=f"{t:06d}") for t in ids]


def compact(df: DataFrame, path: str, columns, files: int) -> None:
    """Many small files of wide rows to a few files of the needed columns; reading keeps all its tasks."""
    df.select(*columns).repartition(files).write.mode("overwrite").parquet(path)


def cached_lattices(spark: SparkSession, path: str, make) -> DataFrame:
    """(l1, l2, l3, u) written once; later calls read it."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # the path is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows = [(*map(float, k), [[int(x) for x in v] for v in u]) for k, us in make().items() for u in us]
    spark.createDataFrame(rows, "l1 double, l2 double, l3 double, u array<array<int>>").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


#: FITS binary table formats as numpy types.
FITS_TYPES = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S"}


def parse_fits(data: bytes, hdu: int = 1) -> np.ndarray:
    """A binary table extension as a structured array: plain and fixed-length vector columns."""
    for index, header, body in _fits_units(data):
        if index == hdu:
            kinds = []
            for i in range(int(header["TFIELDS"])):
                m = re.match(r"(\d*)([A-Z])", header[f"TFORM{i + 1}"])
                n, k = int(m[1] or 1), m[2]
                name = header[f"TTYPE{i + 1}"]
                kinds.append((name, f"S{n}") if k == "A" else (name, FITS_TYPES[k]) if n == 1 else (name, FITS_TYPES[k], (n,)))
            return np.frombuffer(body, np.dtype(kinds), int(header["NAXIS2"]))
    raise ValueError(f"no extension {hdu}")


def _fits_units(data: bytes):
    """(index, header, body) of the units of a file."""
    at = index = 0
    while at < len(data):
        header: dict[str, str] = {}
        while True:
            block = data[at : at + 2880].decode("ascii", "replace")
            at += 2880
            cards = [block[i : i + 80] for i in range(0, 2880, 80)]
            for c in cards:
                if c[8:10] == "= ":
                    v = c[10:].strip()
                    header[c[:8].strip()] = v[1 : v.index("'", 1)].strip() if v.startswith("'") else v.split("/")[0].strip()
            if any(c.startswith("END") and not c[3:].strip() for c in cards):
                break
        dims = [int(header[f"NAXIS{i + 1}"]) for i in range(int(header["NAXIS"]))]
        size = abs(int(header["BITPIX"])) // 8 * int(np.prod(dims)) + int(header.get("PCOUNT", 0)) if dims else 0
        yield index, header, data[at : at + size]
        at += -(-size // 2880) * 2880
        index += 1


def parse_fits_image(data: bytes, hdu: int = 0) -> tuple[np.ndarray, dict[str, str]]:
    """An image and its header."""
    for index, header, body in _fits_units(data):
        if index == hdu:
            dims = [int(header[f"NAXIS{i + 1}"]) for i in range(int(header["NAXIS"]))]
            kind = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[int(header["BITPIX"])]
            a = np.frombuffer(body, kind, int(np.prod(dims))).reshape(dims[::-1])
            return a.astype(a.dtype.newbyteorder("=")), header
    raise ValueError(f"no extension {hdu}")


def image_bytes(image: np.ndarray, cards: dict | None = None) -> bytes:
    """A FITS file with one image and further cards."""
    image = np.asarray(image)
    bits = {"u1": 8, "i2": 16, "i4": 32, "i8": 64, "f4": -32, "f8": -64}[image.dtype.str[1:]]
    head = [("SIMPLE", "T"), ("BITPIX", bits), ("NAXIS", image.ndim), *[(f"NAXIS{i + 1}", n) for i, n in enumerate(image.shape[::-1])], *(cards or {}).items()]
    body = image.astype(image.dtype.newbyteorder(">")).tobytes()
    return _fits_header(head) + body.ljust(-(-len(body) // 2880) * 2880, b"\0")


def brick_image_opener(template: str):
    """For pixel_values: opens the FITS image of a brick, whose header has the degrees a pixel and the centre pixel.

    template: a path with {brick} and {region}, in a folder that executors mount; a missing file is a brick without image.
    """

    def open_(brick: str, region: str):
        try:
            with open(template.format(brick=brick, region=region), "rb") as f:
                image, header = parse_fits_image(f.read())
        except FileNotFoundError:
            return None
        return image, abs(float(header["CD1_1"])), float(header["CRPIX1"]) - 1

    return open_


def _fits_header(cards) -> bytes:
    text = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in cards) + "END".ljust(80)
    return text.ljust(-(-len(text) // 2880) * 2880).encode()


def read_healpix_map(spark: SparkSession, path: str, column: str, hdu: int = 1) -> DataFrame:
    """(pix, nbar) of a map in a FITS table, a pixel or a fixed number of pixels a row."""
    import pandas as pd

    def parse(frames):
        for f in frames:
            for content in f["content"]:
                v = parse_fits(bytes(content), hdu)[column].astype(float).ravel()
                yield pd.DataFrame({"pix": np.arange(len(v), dtype=np.int64), "nbar": v})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "pix long, nbar double")


def write_fits(df: DataFrame, path: str, files: int) -> DataFrame:
    """Rows in so many FITS tables under path, a folder that executors mount; (file, rows) of each.

    A task writes its file beside its place and moves it there whole, so that a task that is run again does no harm. Plain
    columns of numbers and texts; a file's rows are in its task's memory.
    """
    import os
    import uuid

    import pandas as pd

    target = path.removeprefix("file://")
    columns = df.columns

    def write(frames):
        from pyspark import TaskContext

        rows = pd.concat(list(frames) or [pd.DataFrame(columns=columns)])
        name = f"part-{TaskContext.get().partitionId():05d}.fits"
        os.makedirs(target, exist_ok=True)
        beside = os.path.join(target, f".{name}-{uuid.uuid4().hex}")
        if len(rows):
            with open(beside, "wb") as f:
                f.write(fits_bytes({c: rows[c].to_numpy() if rows[c].dtype != object else rows[c].to_numpy().astype(str) for c in columns}))
            os.replace(beside, os.path.join(target, name))
        yield pd.DataFrame({"file": [name], "rows": [len(rows)]})

    done = df.repartition(files).mapInPandas(write, "file string, rows long").collect()  # a row for each file
    return df.sparkSession.createDataFrame([tuple(r) for r in done], "file string, rows long")


def fits_bytes(columns: dict[str, np.ndarray]) -> bytes:
    """A FITS file with one binary table."""
    letters = {"f8": "D", "f4": "E", "i8": "K", "i4": "J", "i2": "I", "u1": "B"}
    kinds, forms = [], []
    for k, v in columns.items():
        v = np.asarray(v)
        code = v.dtype.str[1:]
        if v.dtype.kind == "U":
            v = v.astype("S")
            code = f"S{v.dtype.itemsize}"
        n = int(np.prod(v.shape[1:])) or 1
        forms.append(f"{code[1:]}A" if code[0] == "S" else f"{n if n > 1 else ''}{letters[code]}")
        kinds.append((k, code) if code[0] == "S" else (k, ">" + code) if n == 1 else (k, ">" + code, (n,)))
    rows = np.zeros(len(next(iter(columns.values()))), np.dtype(kinds))
    for k, v in columns.items():
        rows[k] = np.asarray(v).astype("S") if np.asarray(v).dtype.kind == "U" else v

    first = _fits_header([("SIMPLE", "T"), ("BITPIX", "8"), ("NAXIS", "0"), ("EXTEND", "T")])
    cards = [("XTENSION", "'BINTABLE'"), ("BITPIX", "8"), ("NAXIS", "2"), ("NAXIS1", rows.dtype.itemsize), ("NAXIS2", len(rows)), ("PCOUNT", "0"), ("GCOUNT", "1"), ("TFIELDS", len(kinds))]
    for i, (k, f) in enumerate(zip(columns, forms)):
        cards += [(f"TTYPE{i + 1}", f"'{k}'"), (f"TFORM{i + 1}", f"'{f}'")]
    body = rows.tobytes()
    return first + _fits_header(cards) + body.ljust(-(-len(body) // 2880) * 2880, b"\0")


def read_fits(spark: SparkSession, paths, schema: str, columns=None, hdu: int = 1) -> DataFrame:
    """FITS files read by executors, a file a row of work; schema names the columns that are wanted."""
    import pandas as pd

    paths = [paths] if isinstance(paths, str) else list(paths)
    names = columns or [c.split()[0] for c in schema.split(",")]

    def parse(frames):
        for f in frames:
            for content in f["content"]:
                t = parse_fits(bytes(content), hdu)
                cols = {}
                for n in names:
                    v = t[n]
                    v = v.astype(v.dtype.newbyteorder("=")) if v.dtype.kind != "S" else np.char.decode(v).astype(object)
                    cols[n] = list(v) if v.ndim > 1 else v
                yield pd.DataFrame(cols)

    return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(parse, schema)
