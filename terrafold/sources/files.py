"""File sources: documents, GeoJSON, manifests, images and masks, GeoTIFF headers.

Paths go to Spark's readers, so any store that Spark reads will do. Decoding pixels and recognising text need libraries or
models that aren't part of this package: `pages` and `recognise` take them as functions and run them in batches.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schemas import TOKENS

IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
PAGES = "source_id string, page_number int, image binary, error string"


def contained(path: str, root: str) -> str:
    """A path below a root, or ValueError: no parent steps, no other store."""
    from posixpath import normpath

    joined = normpath(path if "://" in path or path.startswith("/") else f"{root}/{path}")
    base = normpath(root)
    if joined != base and not joined.startswith(base + "/"):
        raise ValueError(f"{path} is outside {root}")
    return joined


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """source_id (file name), suffix, size_bytes, sha256, content of each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("source_id"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("suffix"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content")


def pages(files: DataFrame, render: Callable[[bytes, str, int], list[bytes]], dpi: int = 300) -> DataFrame:
    """A row a page (from 1) of each file, by a renderer (content, suffix, dpi) -> images. A failing file is one row with its error."""
    if not 72 <= dpi <= 600:
        raise ValueError("dpi must be 72 to 600")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source_id, suffix, content in zip(batch["source_id"], batch["suffix"], batch["content"]):
                try:
                    rows += [(source_id, k, image, None) for k, image in enumerate(render(content, suffix, dpi), 1)]
                except Exception as error:  # a bad file is a result, not the end of the job
                    rows.append((source_id, None, None, type(error).__name__))
            yield pd.DataFrame(rows, columns=["source_id", "page_number", "image", "error"]).astype({"page_number": "Int32"})

    return files.select("source_id", "suffix", "content").mapInPandas(work, PAGES)


MASKS = "source_id string, height int, width int, values array<double>, error string"


def masks(files: DataFrame, decode: Callable[[bytes, str], np.ndarray] | None = None) -> DataFrame:
    """A row a mask file: height, width and values row by row, or the error of a file that isn't one channel of two dimensions.

    NumPy files are read as they are, never as pickled objects; other images take a decoder (content, suffix) -> array.
    """

    def grid(content: bytes, suffix: str) -> np.ndarray:
        if suffix == ".npy":
            found = np.load(io.BytesIO(content), allow_pickle=False)
        elif decode:
            found = np.asarray(decode(content, suffix))
        else:
            raise ValueError("no decoder")
        found = found[:, :, 0] if found.ndim == 3 and found.shape[2] == 1 else found
        if found.ndim != 2:
            raise ValueError("not one channel")
        return found.astype(float)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source_id, suffix, content in zip(batch["source_id"], batch["suffix"], batch["content"]):
                try:
                    found = grid(content, suffix)
                    row = (source_id, *found.shape, found.ravel(), None)
                except Exception as error:  # a bad file is a result, not the end of the job
                    row = (source_id, None, None, None, type(error).__name__)
                yield pd.DataFrame([row], columns=["source_id", "height", "width", "values", "error"]).astype({"height": "Int32", "width": "Int32"})

    return files.select("source_id", "suffix", "content").mapInPandas(work, MASKS)


def recognise(page_rows: DataFrame, engine: Callable[[], Callable[[bytes], list[dict]]]) -> DataFrame:
    """Tokens of pages by an engine, made once a task: image -> [{text, confidence, left, top, width, height}, ...]."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = engine()
        for batch in batches:
            rows = []
            for source_id, number, image in zip(batch["source_id"], batch["page_number"], batch["image"]):
                for k, r in enumerate(run(image)):
                    box = {s: r[s] for s in ("left", "top", "width", "height")} if all(r.get(s) is not None for s in ("left", "top", "width", "height")) else None
                    rows.append((source_id, number, k, r["text"], r.get("confidence"), box))
            yield pd.DataFrame(rows, columns=["document_id", "page_number", "region_number", "text", "confidence", "box"])

    return page_rows.filter("error IS NULL").select("source_id", "page_number", "image").mapInPandas(work, TOKENS)


def box_from_corners(corners: Column) -> Column:
    """struct(left, top, width, height) of an array [x0, y0, x1, y1]; null for four readable, ordered numbers missing."""
    c = [F.try_element_at(corners, F.lit(k)) for k in (1, 2, 3, 4)]
    fine = (c[2] >= c[0]) & (c[3] >= c[1])
    return F.when(fine, F.struct(c[0].cast("int").alias("left"), c[1].cast("int").alias("top"), (c[2] - c[0]).cast("int").alias("width"), (c[3] - c[1]).cast("int").alias("height")))


_GEOMETRY = "struct<type:string,coordinates:array<array<array<double>>>>"


def geojson_ring(text: Column) -> Column:
    """Outer ring of a polygon in GeoJSON: a geometry, a feature, a collection of one feature, or bare coordinates; null for others."""
    geometry = F.from_json(text, _GEOMETRY)
    feature = F.from_json(text, f"struct<type:string,geometry:{_GEOMETRY}>")
    many = F.from_json(text, f"struct<type:string,features:array<struct<geometry:{_GEOMETRY}>>>")
    bare = F.from_json(text, "array<array<array<double>>>")
    polygon = lambda g: F.when(g["type"] == "Polygon", g["coordinates"])
    found = F.coalesce(
        polygon(geometry), F.when(feature["type"] == "Feature", polygon(feature["geometry"])), F.when((many["type"] == "FeatureCollection") & (F.size(many["features"]) == 1), polygon(many["features"][0]["geometry"])),
        F.when(F.startswith(F.ltrim(text), F.lit("[")), bare),
    )
    return F.when(F.size(found) > 0, F.transform(found[0], lambda p: G.point(p[0], p[1])))


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects of files, one a file, with a declared schema."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def manifest(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """Samples of a benchmark manifest: a list of samples, or an object with one; `sample` is a struct's fields."""
    text = spark.read.option("wholetext", "true").text(path)
    listed = F.coalesce(F.from_json("value", f"struct<samples:array<struct<{sample}>>>")["samples"], F.from_json("value", f"array<struct<{sample}>>"))
    return text.select(F.explode(listed).alias("s")).select("s.*")


def image_mask_pairs(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(stem, image, mask) of files with a path; a stem without its partner is an error when rows are read."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("stem")
    both = images.select(stem, F.col("path").alias("image")).join(masks.select(stem, F.col("path").alias("mask")), "stem", "full_outer")
    whole = F.col("image").isNotNull() & F.col("mask").isNotNull()
    return both.filter(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no partner for "), F.col("stem"))).cast("boolean")))


_TIFF = "struct<width:int,height:int,bands:int,dtype:string,epsg:int,transform:struct<a:double,b:double,c:double,d:double,e:double,f:double>,nodata:double,error:string>"
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8}
_FORMATS = {1: "B", 3: "H", 4: "I", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}


def tiff_tags(data: bytes) -> dict[int, tuple | str]:
    """Tags of a TIFF's or BigTIFF's first image."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    count = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
    at += 8 if big else 2
    step, inline = (20, 8) if big else (12, 4)
    tags: dict[int, tuple | str] = {}
    for k in range(count):
        p = at + k * step
        tag, kind = struct.unpack_from(order + "HH", data, p)
        n = struct.unpack_from(order + ("Q" if big else "I"), data, p + 4)[0]
        value = p + step - inline
        if n * _SIZES.get(kind, 1) > inline:
            value = struct.unpack_from(order + ("Q" if big else "I"), data, value)[0]
        if kind == 2:
            tags[tag] = data[value : value + n].split(b"\0")[0].decode("ascii", "replace")
        elif kind in _FORMATS:
            tags[tag] = struct.unpack_from(f"{order}{n}{_FORMATS[kind]}", data, value)
    return tags


def describe_tiff(data: bytes, require_crs: bool = True) -> dict:
    """Size, bands, type, EPSG code, affine transform and nodata of a GeoTIFF; `error` says why it can't be used."""
    out = dict.fromkeys(("width", "height", "bands", "dtype", "epsg", "transform", "nodata", "error"))
    try:
        tags = tiff_tags(data)
        kind = {1: "uint", 2: "int", 3: "float"}[tags.get(339, (1,))[0]]
        out |= {"width": tags[256][0], "height": tags[257][0], "bands": tags.get(277, (1,))[0], "dtype": f"{kind}{tags.get(258, (8,))[0]}"}
        keys = tags.get(34735, ())
        codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
        code = codes.get(3072) or codes.get(2048)
        out["epsg"] = code if code and code != 32767 else None
        if 34264 in tags:
            m = tags[34264]
            t = (m[0], m[1], m[3], m[4], m[5], m[7])
        elif 33550 in tags and 33922 in tags:
            (sx, sy, *_), (i, j, _, x, y, *_) = tags[33550], tags[33922]
            t = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
        else:
            t = None
        out["transform"] = dict(zip("abcdef", map(float, t))) if t else None
        nodata = tags.get(42113)
        out["nodata"] = float(nodata) if isinstance(nodata, str) and nodata.strip() else None
        if out["width"] < 1 or out["height"] < 1 or out["bands"] < 1:
            out["error"] = "EMPTY"
        elif require_crs and out["epsg"] is None:
            out["error"] = "CRS_MISSING"
        elif t is None or t[0] * t[4] - t[1] * t[3] == 0:
            out["error"] = "TRANSFORM_INVALID"
    except (KeyError, struct.error, IndexError, ValueError, TypeError):
        out["error"] = "NOT_A_GEOTIFF"
    return out


def inspect_rasters(files: DataFrame, require_crs: bool = True) -> DataFrame:
    """Header of each GeoTIFF with its bounds and uncompressed size; unusable ones carry an error."""

    @F.pandas_udf(_TIFF)
    def header(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([describe_tiff(bytes(c), require_crs) for c in content])

    rows = files.select("source_id", header("content").alias("h")).select("source_id", "h.*")
    first, last = G.affine_point(F.col("transform"), F.lit(0), F.lit(0)), G.affine_point(F.col("transform"), F.col("width"), F.col("height"))
    bytes_ = F.regexp_extract("dtype", r"(\d+)$", 1).cast("long") / 8
    edges = F.struct(F.least(first["x"], last["x"]).alias("x0"), F.least(first["y"], last["y"]).alias("y0"), F.greatest(first["x"], last["x"]).alias("x1"), F.greatest(first["y"], last["y"]).alias("y1"))
    return rows.withColumn("bounds", F.when(F.col("transform").isNotNull(), edges)).withColumn("estimated_bytes", (F.col("width").cast("long") * F.col("height") * F.col("bands") * bytes_).cast("long"))


#: Content types by file category, and the largest upload.
CONTENT_TYPES = {
    "DOCUMENT": ("application/pdf", "image/jpeg", "image/png", "image/tiff"),
    "IMAGERY": ("image/tiff", "image/jpeg", "image/png", "application/geotiff"),
    "GIS": ("application/geo+json", "application/json", "application/zip"),
    "SUPPORTING": ("application/pdf", "image/jpeg", "image/png", "text/csv"),
}
MAX_UPLOAD_BYTES = 5 * 1024**3


def upload_refusal(category: Column, content_type: Column, size: Column, sha256: Column, name: Column) -> Column:
    """Why an upload isn't accepted, null if it is."""
    kind = F.lower(F.trim(content_type))
    allowed = F.lit(False)
    for c, types in CONTENT_TYPES.items():
        allowed = allowed | ((category == c) & kind.isin(*types))
    unsafe = name.contains("/") | name.contains("\\") | name.contains("\0") | (F.length(name) < 1) | (F.length(name) > 255) | (F.trim(name) != name)
    return (
        F.when(~category.isin(*CONTENT_TYPES), "UNKNOWN_CATEGORY").when(~allowed, "CONTENT_TYPE").when(~size.between(1, MAX_UPLOAD_BYTES), "SIZE")
        .when(sha256.isNotNull() & ~sha256.rlike("^[A-Fa-f0-9]{64}$"), "CHECKSUM").when(unsafe, "FILE_NAME")
    )
