"""Readers for the formats the library takes in, each as a distributed scan."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def json_array(df: DataFrame, column: str, schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """Records of a JSON array column as rows; a malformed array gives none."""
    return df.select(*keep, F.inline(F.from_json(column, f"array<struct<{schema}>>")))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def geojson_sequence(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of a GeoJSON text sequence (record separators are taken off): properties, geometry type and coordinates as text."""
    kind = f"type string, properties struct<{properties}>, geometry struct<type:string, coordinates:string>"
    lines = spark.read.text(path).select(F.regexp_replace("value", "\x1e", "").alias("line")).where(F.trim("line") != "")
    feature = lines.select(F.from_json("line", kind).alias("f")).where("f.type = 'Feature'")
    return feature.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def csv_rows(spark: SparkSession, path: str, schema: str, keep: Column | None = None) -> DataFrame:
    """CSV with a header; the filter is pushed into the scan."""
    rows = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    return rows if keep is None else rows.where(keep)


def headed_sheet(rows: DataFrame, number: str, cells: str, first: str) -> DataFrame:
    """Cells by column name from raw sheet rows (``number``, array ``cells``): the heading is the first row whose first cell is ``first``."""
    heading = rows.where(F.get(F.col(cells), F.lit(0)) == first).agg(F.min_by(cells, number).alias("__names"), F.min(number).alias("__at"))  # one row
    below = rows.crossJoin(F.broadcast(heading)).where(F.col(number) > F.col("__at"))
    return below.select(number, F.map_from_arrays(F.transform("__names", lambda n: F.trim(n)), F.slice(cells, F.lit(1), F.size("__names"))).alias("record"))


def climate_rows(df: DataFrame, year: str, day_of_year: str) -> DataFrame:
    """Adds the date of a year and a day of the year."""
    return df.withColumn("date", F.date_add(F.make_date(F.col(year), F.lit(1), F.lit(1)), (F.col(day_of_year) - 1).cast("int")))


def in_box(df: DataFrame, box: str, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Rows whose ``box`` struct meets a rectangle, as comparisons of its fields that Parquet can skip by."""
    return df.where((F.col(f"{box}.xmin") <= xmax) & (F.col(f"{box}.xmax") >= xmin) & (F.col(f"{box}.ymin") <= ymax) & (F.col(f"{box}.ymax") >= ymin))


def grid_records(df: DataFrame, wanted: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rows of decoded grid messages whose (variable, level, forecast) is wanted. The test is on plain columns, so a scan can skip by it."""
    any_of = F.lit(False)
    for variable, level, forecast in wanted:
        any_of = any_of | ((F.col("variable") == variable) & (F.col("level") == level) & (F.col("forecast") == forecast))
    return df.where(any_of)


def record_ranges(index: DataFrame, file: str, line: str, wanted: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``file, record, variable, level, forecast, start, stop`` of the wanted messages of a grid file, from the lines of its index.

    A line is ``record:start:d=time:variable:level:forecast:``. A message ends before the next one starts; the last one of a
    file has no ``stop``. Lines of another form are left out.
    """
    part = lambda k: F.get(F.split(line, ":"), F.lit(k))
    lines = index.select(file, part(0).try_cast("int").alias("record"), part(1).try_cast("long").alias("start"), part(3).alias("variable"), part(4).alias("level"), part(5).alias("forecast"))
    told = lines.where("record is not null and start is not null")
    ends = told.withColumn("stop", F.lead("start").over(Window.partitionBy(file).orderBy("start", "record")) - 1)
    return grid_records(ends, wanted)


def catalogue_items(df: DataFrame, column: str, box: Sequence[float], since: str, until: str, most_cloud: float, keep: Sequence[str] = ()) -> DataFrame:
    """Items of a scene catalogue that meet a box, are of a time span and not too cloudy, with one row for each asset: ``item, time, cloud, band, href`` and ``bbox``."""
    kind = "id string, bbox array<double>, properties struct<datetime:string, `eo:cloud_cover`:double>, assets map<string, struct<href:string>>"
    item = df.select(*keep, F.from_json(column, kind).alias("i")).select(*keep, F.col("i.id").alias("item"), "i.bbox", F.to_timestamp_ntz("i.properties.datetime").alias("time"), F.col("i.properties.`eo:cloud_cover`").alias("cloud"), "i.assets")
    meets = (F.get("bbox", F.lit(0)) <= box[2]) & (F.get("bbox", F.lit(2)) >= box[0]) & (F.get("bbox", F.lit(1)) <= box[3]) & (F.get("bbox", F.lit(3)) >= box[1])
    timed = (F.col("time") >= F.lit(since).cast("timestamp_ntz")) & (F.col("time") < F.lit(until).cast("timestamp_ntz"))
    kept = item.where(meets & timed & (F.col("cloud") <= most_cloud))
    return kept.select(*keep, "item", "time", "cloud", "bbox", F.explode("assets").alias("band", "asset")).select(*keep, "item", "time", "cloud", "bbox", "band", F.col("asset.href").alias("href"))


def pixel_window(box: Sequence[Column], left: Column, top: Column, cell: float, width: int, height: int, block: int = 512) -> Column:
    """Rows and columns of a raster that a box (xmin, ymin, xmax, ymax) touches, cut to the raster, and the blocks that hold them; null where it misses it."""
    xmin, ymin, xmax, ymax = box
    first = lambda far: F.greatest(F.lit(0), F.floor(far / cell)).cast("long")
    last = lambda far, n: F.least(F.lit(n - 1), F.ceil(far / cell) - 1).cast("long")
    edges = {"col0": first(xmin - left), "col1": last(xmax - left, width), "row0": first(top - ymax), "row1": last(top - ymin, height)}
    blocks = [F.floor(v / block).alias(f"{k[:3]}_block{k[3]}") for k, v in edges.items()]
    return F.when((edges["col0"] <= edges["col1"]) & (edges["row0"] <= edges["row1"]), F.struct(*[v.alias(k) for k, v in edges.items()], *blocks))


def octree_points(points: DataFrame, nodes: DataFrame, box: Sequence[float], deepest: int) -> DataFrame:
    """Points inside a box (xmin, ymin, xmax, ymax) of nodes down to a level that meet it.

    ``nodes`` has ``node, level, xmin, ymin, size``. Where points are partitioned by ``node``, other nodes' files are not read.
    """
    xmin, ymin, xmax, ymax = box
    meets = (F.col("xmin") <= xmax) & (F.col("xmin") + F.col("size") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymin") + F.col("size") >= ymin)
    kept = nodes.where(meets & (F.col("level") <= deepest)).select("node")
    return points.where(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax)).join(kept, "node", "left_semi")


def fetched(df: DataFrame, url: str, into: str = "answer", timeout: float = 60.0) -> DataFrame:
    """``df`` with ``status, body, error`` of a GET of each row's URL; a failed request gives an error and ends nothing. Null URLs give nulls."""
    @F.pandas_udf("status int, body string, error string")
    def get(urls: pd.Series) -> pd.DataFrame:
        from urllib.request import urlopen

        def one(address: str | None) -> tuple:
            if address is None:
                return None, None, None
            try:
                with urlopen(address, timeout=timeout) as answer:
                    return getattr(answer, "status", None) or 200, answer.read().decode("utf-8", "replace"), None
            except (OSError, ValueError) as failure:
                return getattr(failure, "code", None), None, str(failure)

        out = pd.DataFrame([one(u) for u in urls], columns=["status", "body", "error"])
        return out.astype({"status": "Int32"})

    return df.withColumn(into, get(F.col(url)))


def zip_members(files: DataFrame, path: str = "path", content: str = "content", most: int = 256 << 20) -> DataFrame:
    """``path, member, size, sha256, content, error``: members of ZIP files, one file a row as ``binaryFile`` reads it.

    A member whose checksum fails or that is larger than ``most`` bytes, and a file that is no ZIP, give a row with an error and
    no content; no member is opened beyond that size, whatever its entry says.
    """
    def open_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import io
        import zipfile
        import zlib

        for batch in batches:
            for name, data in zip(batch[path], batch[content]):
                try:
                    box = zipfile.ZipFile(io.BytesIO(data or b""))
                except zipfile.BadZipFile as failure:
                    yield pd.DataFrame([(name, None, None, None, None, str(failure))], columns=columns)
                    continue
                for info in box.infolist():
                    try:
                        with box.open(info) as member:
                            body = member.read(most + 1)
                        if len(body) > most:
                            raise zipfile.BadZipFile(f"{info.filename} is larger than {most} bytes")
                        row = (name, info.filename, len(body), hashlib.sha256(body).hexdigest(), body, None)
                    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as failure:
                        row = (name, info.filename, info.file_size, None, None, str(failure))
                    yield pd.DataFrame([row], columns=columns)

    columns = ["path", "member", "size", "sha256", "content", "error"]
    return files.select(path, content).mapInPandas(open_all, "path string, member string, size long, sha256 string, content binary, error string")


def zipped(df: DataFrame) -> DataFrame:
    """``path, content``: a ZIP file of one member for each row ``path, member, text``."""
    @F.pandas_udf("binary")
    def pack(names: pd.Series, texts: pd.Series) -> pd.Series:
        import io
        import zipfile

        def one(name: str, text: str | None) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
                box.writestr(name, text or "")
            return out.getvalue()

        return pd.Series([one(n, t) for n, t in zip(names, texts)])

    return df.select("path", pack("member", "text").alias("content"))


def verified(members: DataFrame, expected: DataFrame) -> DataFrame:
    """``members`` with ``verdict`` against ``expected`` (``member, sha256``): ok, changed, unlisted or unreadable; listed ones that are not there are ``missing``."""
    listed = expected.select("member", F.col("sha256").alias("__sha"), F.lit(True).alias("__listed"))
    both = members.join(listed, "member", "full_outer")
    state = F.when(F.col("path").isNull(), "missing").when(F.col("error").isNotNull(), "unreadable").when(F.col("__listed").isNull(), "unlisted").when(F.col("sha256").eqNullSafe(F.col("__sha")), "ok").otherwise("changed")
    return both.withColumn("verdict", state).drop("__sha", "__listed")


class Lane(InputPartition):
    def __init__(self, first: int):
        self.first = first


class PagedReader(DataSourceReader):
    """Pages of a feature service, read by lanes: lane n of L asks for pages n, n + L, n + 2L, … until one is short.

    So nobody has to know how many there are, pages are read in parallel, and no lane asks more than once beyond the end.
    """

    def __init__(self, options: dict, schema):
        self.url, self.size, self.lanes = options["url"], int(options.get("pageSize", "1000")), int(options.get("lanes", "8"))
        self.total = int(options["total"]) if "total" in options else None
        self.columns = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        if self.size < 1 or self.lanes < 1:
            raise ValueError("pageSize and lanes must be positive")

    def partitions(self) -> list[InputPartition]:
        return [Lane(k) for k in range(self.lanes)]

    def read(self, partition: Lane) -> Iterator[tuple]:
        import json
        from urllib.request import urlopen

        for at in itertools.count(partition.first * self.size, self.lanes * self.size):
            if self.total is not None and at >= self.total:
                return
            with urlopen(self.url.format(offset=at, limit=self.size), timeout=60) as answer:
                page = json.load(answer)
            features = page if isinstance(page, list) else page.get("features") or []
            for feature in features:
                known = feature | (feature.get("properties") or {}) | (feature.get("attributes") or {})
                yield tuple(at if name == "at" else self.fitted(known.get(name), kind, json.dumps) for name, kind in self.columns)
            if len(features) < self.size:
                return

    @staticmethod
    def fitted(value, kind: str, text):
        """A JSON value as a column's; what does not fit is null, and a text column takes any value as JSON."""
        if value is None:
            return None
        if kind == "string":
            return value if isinstance(value, str) else text(value)
        try:
            if kind in ("bigint", "int"):
                return int(value)
            if kind == "double":
                return float(value)
        except (TypeError, ValueError):
            return None
        return value if kind == "boolean" and isinstance(value, bool) else None


class PagedSource(DataSource):
    """``spark.read.format("paged_features").schema("…").options(url="…?resultOffset={offset}&resultRecordCount={limit}", pageSize=…, lanes=…)``.

    A page is a JSON array of features, or an object that has it as ``features``; it is asked for by offset until one is
    short. Columns (long, int, double, boolean or string) take a feature's own members, its ``properties`` or its
    ``attributes`` by name; ``at`` is the page's offset, and a string column holds what is no string as JSON. A ``total``
    ends the paging early. A lane is one task, which is run again if its executor is lost.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        return "at long, id long, name string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options, schema)
