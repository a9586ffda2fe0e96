"""File sources and sinks: tables with required columns, track and map text files, payload checks."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAP_NAME = r"^[a-z]{4}\d{3}0\.\d{2}i(\.Z|\.gz)?$"
# fixed values: column order of the two text layouts
NINE = ["date", "clock", "time_sys", "alt_m", "lon_deg", "lat", "lst_h", "arglat_deg", "rho_obs"]
TWELVE = [*NINE, "rho_mean", "flag_dens", "flag_dens_mean"]


def require(df: DataFrame, columns: set[str]) -> DataFrame:
    missing = sorted(columns - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def read_track(spark: SparkSession, path: str, required: set[str] = frozenset({"time", "lat", "lon", "alt_km"})) -> DataFrame:
    df = require(spark.read.parquet(path), set(required))
    return nan_to_null(df.withColumn("time", F.col("time").cast("timestamp")))


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet by suffix, else CSV with a header; a missing path raises."""
    if re.search(r"\.(parquet|pq)/?$", path):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def layout_of(mission: str) -> str:
    """Layout of a mission's track files."""
    return "12col" if mission.strip().upper() == "GRACE" else "9col"


def parse_track_lines(lines: DataFrame, layout: str = "12col", nominal_only: bool = True) -> DataFrame:
    """Typed rows of text lines (column value) that begin with a date and a time of day; others and what follows a # go."""
    names = TWELVE if layout == "12col" else NINE
    body = F.split(F.trim(F.split("value", "#")[0]), r"\s+")
    rows = lines.select(body.alias("f")).filter(F.size("f") >= len(names))
    num = lambda n: F.expr(f"try_cast(f[{names.index(n)}] as double)")
    cols = {n: num(n) for n in names[3:] if n not in ("alt_m", "lon_deg")}
    stamp = F.try_to_timestamp(F.concat(F.col("f")[0], F.lit(" "), F.substring(F.col("f")[1], 1, 8)), F.lit("yyyy-MM-dd HH:mm:ss"))
    out = rows.select(
        stamp.alias("time"), F.expr("f[2]").alias("time_sys"), (num("alt_m") / 1000).alias("alt_km"),
        (F.pmod(num("lon_deg") + 180, F.lit(360.0)) - 180).alias("lon"), *[c.alias(n) for n, c in cols.items()],
    ).filter("time is not null")
    return out.filter("flag_dens = 0") if layout == "12col" and nominal_only else out


def read_track_text(spark: SparkSession, path: str, layout: str = "12col", nominal_only: bool = True) -> DataFrame:
    return parse_track_lines(spark.read.text(path), layout, nominal_only)


def read_track_archives(spark: SparkSession, glob: str, years: tuple[int, int], layout: str = "12col") -> DataFrame:
    """Monthly zips (one file is one unit of work); unreadable files become rows with `error`."""
    return archive_lines(spark.read.format("binaryFile").load(glob), years)


def archive_lines(archives: DataFrame, years: tuple[int, int]) -> DataFrame:
    """path, value (a line), error, mission, year, month of binary rows (path, content), which may be a stream."""

    def lines(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = [n for n in z.namelist() if n.endswith(".txt")]
                        pick = f"{stem}.txt" if f"{stem}.txt" in names else names[0]
                        text = z.read(pick).decode("utf-8", "replace").splitlines()
                    yield pd.DataFrame({"path": path, "value": text, "error": None})
                except (zipfile.BadZipFile, IndexError, KeyError) as e:
                    yield pd.DataFrame({"path": [path], "value": [""], "error": [f"{type(e).__name__}: {e}"]})

    part = lambda k: F.regexp_extract("path", r"([A-Z0-9]+)_([A-Z]+)_[A-Z]+_(\d{4})_(\d{2})_v02\.zip$", k)
    files = archives.select("path", "content").filter((part(2) == "DNS") & F.coalesce(part(3).try_cast("int").between(*years), F.lit(False)))
    found = files.mapInPandas(lines, "path string, value string, error string")
    return found.withColumns({"mission": part(1), "year": F.expr("try_cast(" + "regexp_extract(path, '_(\\\\d{4})_', 1) as int)"), "month": F.expr("try_cast(regexp_extract(path, '_(\\\\d{2})_v02', 1) as int)")})


def parse_map(text: str) -> list[tuple]:
    """(epoch, lat, lon, value) for every cell of the header's mesh in each map of one file; ValueError for a bad file.

    Cells without a value, and those marked 9999 or -1, are None. Rows may span any part of a
    latitude. A file without EXPONENT has whole units.
    """
    head: dict[str, tuple[float, float, float]] = {}
    exponent, epoch, cells, out = 0, None, None, []
    values, want, at = "", 0, (0, 0)

    def steps(first: float, last: float, step: float) -> int:
        return int(round((last - first) / step)) + 1

    def store() -> None:
        for k in range(want):
            v = int(values[5 * k : 5 * k + 5])
            cells[at[0], at[1] + k] = None if v in (9999, -1) else v * 10.0**exponent

    for line in text.splitlines():
        label = line[60:].strip()
        if want:
            if label.startswith(("LAT/LON1", "END OF")):
                raise ValueError("short row")
            values += line[:80].rstrip()
            if len(values) >= 5 * want:
                store()
                values, want = "", 0
        elif label.startswith(("LAT1", "LON1")):
            head[label[:3]] = tuple(float(x) for x in line[:60].split()[:3])
        elif label == "EXPONENT":
            exponent = int(line[:6])
        elif label == "START OF TEC MAP":
            if set(head) != {"LAT", "LON"}:
                raise ValueError("no grid in the header")
            if cells is not None:
                raise ValueError("a map does not end")
            cells, epoch = {}, None
        elif label == "EPOCH OF CURRENT MAP":
            y, mo, d, h, mi, s = (int(float(x)) for x in line[:60].split())
            epoch = pd.Timestamp(y, mo, d) + pd.Timedelta(hours=h, minutes=mi, seconds=s)
        elif label == "LAT/LON1/LON2/DLON/H" and cells is not None:
            lat, first, last, step = (float(x) for x in re.findall(r"-?\d+\.\d", line[:60])[:4])  # numbers may touch
            (lat0, lat1, dlat), (lon0, _, dlon) = head["LAT"], head["LON"]
            at, want = (int(round((lat - lat0) / dlat)), int(round((first - lon0) / dlon))), steps(first, last, step)
            if not 0 <= at[0] < steps(lat0, lat1, dlat) or at[1] < 0 or at[1] + want > steps(*head["LON"]):
                raise ValueError("a row outside the grid")
        elif label == "END OF TEC MAP":
            if epoch is None:
                raise ValueError("a map without an epoch")
            (lat0, _, dlat), (lon0, _, dlon) = head["LAT"], head["LON"]
            out += [(epoch, lat0 + i * dlat, lon0 + j * dlon, cells.get((i, j))) for i in range(steps(*head["LAT"])) for j in range(steps(*head["LON"]))]
            cells = None
    if set(head) != {"LAT", "LON"}:
        raise ValueError("no grid in the header")
    if cells is not None:
        raise ValueError("a map does not end")
    return out


def read_grid_maps(spark: SparkSession, glob: str, years: tuple[int, int] | None = None, center: str | None = None, name: str | None = None) -> DataFrame:
    """(epoch, center, latitude, longitude, tec_value, path, error): bad files come as one row with `error`.

    center: given, or the first four letters of the file's name. name: a pattern (such as MAP_NAME) of the names to read.
    """
    texts = spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return map_cells(texts, years, center, name)


def map_cells(files: DataFrame, years: tuple[int, int] | None = None, center: str | None = None, name: str | None = None) -> DataFrame:
    """The rows of read_grid_maps from path and value (a file's text, null where it cannot be had); may be a stream."""

    def run(batches):
        for pdf in batches:
            for path, text in zip(pdf["path"], pdf["value"], strict=True):
                try:
                    if text is None:
                        raise ValueError("the file's compression is not read")
                    out = pd.DataFrame(parse_map(text), columns=["epoch", "latitude", "longitude", "tec_value"]).assign(error=None)
                except ValueError as e:
                    out = pd.DataFrame({"epoch": [pd.NaT], "latitude": [None], "longitude": [None], "tec_value": [None], "error": [str(e)]})
                yield out.assign(path=path, center=center or path.rsplit("/", 1)[-1][:4].lower())[["epoch", "center", "latitude", "longitude", "tec_value", "path", "error"]]

    if name:
        files = files.filter(F.regexp_extract("path", "([^/]+)$", 1).rlike(name))
    out = files.mapInPandas(run, "epoch timestamp, center string, latitude double, longitude double, tec_value double, path string, error string")
    return out if years is None else out.filter(F.col("error").isNotNull() | F.year("epoch").between(*years))


def yearly_counts(maps: DataFrame) -> DataFrame:
    """year, rows and rows with a value of a map series; epochs that are null count as year null."""
    return maps.groupBy(F.year("epoch").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count("tec_value").alias("n_values"))


def newest(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The n rows that come last in order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def index_daily(df: DataFrame, start, end, names: dict[str, str] | None = None) -> DataFrame:
    """Daily index series (time and renamed columns) from the day of start to the day after end; none is an error."""
    names = names or {"f107_obs": "f107", "f107_81ctr_adj": "f107a", "Apavg": "ap_daily"}
    day = F.date_trunc("day", "time")
    out = df.select(day.alias("time"), *[F.col(c).cast("double").alias(n) for c, n in names.items() if c in df.columns])
    last = F.date_trunc("day", F.lit(end).cast("timestamp") + F.expr("interval 1 day - interval 1 microsecond"))
    out = nan_to_null(out.filter(F.col("time").between(F.date_trunc("day", F.lit(start).cast("timestamp")), last)))
    if not out.limit(1).count():
        raise ValueError(f"no index values between {start} and {end}")
    return out


def payload_kind(content: Column, content_type: Column | None = None) -> Column:
    """html (by its first bytes or its content type), tiny (under 2000 bytes), lzw, gz, plain (a map's first line) or other."""
    head = F.lower(F.ltrim(F.decode(F.substring(content, 1, 64), "ISO-8859-1")))
    html = head.startswith("<!") | head.startswith("<html")
    if content_type is not None:
        html = html | F.coalesce(F.lower(content_type).contains("text/html"), F.lit(False))
    magic = F.hex(F.substring(content, 1, 2))
    return (
        F.when(html, "html").when(F.octet_length(content) < 2000, "tiny").when(magic == "1F9D", "lzw").when(magic == "1F8B", "gz")
        .when(F.decode(F.substring(content, 1, 8), "ISO-8859-1") == "     1.0", "plain").otherwise("other")
    )


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    (df.write.partitionBy(by) if by else df.write).mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_run(df: DataFrame, path: str, tag: str) -> None:
    """One run's rows under path/tag=...; a run written again replaces its own rows alone."""
    df.drop("tag").write.mode("overwrite").parquet(f"{path}/tag={tag}")


def run_tag(retrain: bool, period: str, horizon: int) -> str:
    return f"dr{int(retrain)}_{period}_h{horizon}"
