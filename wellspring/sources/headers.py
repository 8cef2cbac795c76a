"""Headers, types and encodings of tabular files."""

from __future__ import annotations

import csv
import io
import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.functions.scalars import extension
from wellspring.functions.text import name_key
from wellspring.sources.files import opened, parsed

# fixed values: spellings of the logical fields of tabular inputs, in order of preference
FIELD_ALIASES = {
    "well": "WELL WELLNAME WELLID BOREHOLE HOLENAME 井名 井号",
    "uwi": "UWI API WELLUWI UNIQUEWELLID 统一井号",
    "x": "SURFACEX WELLHEADX 地面X 井口X X EASTING XCOORD XCOORDINATE LONGITUDE LON 经度 横坐标",
    "y": "SURFACEY WELLHEADY 地面Y 井口Y Y NORTHING YCOORD YCOORDINATE LATITUDE LAT 纬度 纵坐标",
    "base_x": "BASEX BOTTOMX TDX 井底X",
    "base_y": "BASEY BOTTOMY TDY 井底Y",
    "kb": "KB KBELEVATION ELEVATION DERRICKELEVATION DATUMELEVATION 补心海拔 井口海拔",
    "td": "TD TOTALDEPTH WELLDEPTH 完钻井深 总井深",
    "md": "MD MEASUREDDEPTH DEPTH DEPT 井深 斜深",
    "inc": "INC INCL INCLINATION ANGLE 井斜 井斜角",
    "azi": "AZI AZIMUTH AZM 方位 方位角",
    "top": "TOP TOPMD FROM STARTDEPTH 顶深 顶界",
    "base": "BASE BOTTOM BOT BASEMD TO ENDDEPTH 底深 底界",
    "name": "NAME POLYGON POLYGONNAME 区块 多边形 名称",
    "alias": "ALIAS ALIASNAME SHORTNAME 别名 缩写井名",
    "canonical": "CANONICAL CANONICALNAME FULLNAME 标准井名 正式井名",
    "version": "VERSION INTERPRETATIONVERSION REVISION REV 版本",
    "batch": "BATCH BATCHNAME 批次",
    "interval_name": "INTERVAL INTERVALNAME ZONE PERFORATION 射孔段 层段",
    "status": "STATUS STATE OPENSTATUS 状态 开关状态",
    "event_date": "DATE EVENTDATE STARTDATE PERFORATIONDATE 日期 射孔日期",
    "production_month": "PRODUCTIONMONTH PRODMONTH YEARMONTH MONTH PRODDATE DATE 生产月份 生产日期 年月",
    "onstream_date": "ONSTREAMDATE FIRSTPRODUCTIONDATE STARTPRODUCTION COMMENCEMENTDATE 投产时间 投产日期",
    "days_on": "DAYSON PRODDAYS DAYSPRODUCING 生产天数 开井天数",
    "liquid_rate": "LIQUIDRATE LIQRATE QL Q液 日产液 日产液量",
    "oil_rate": "OILRATE QO OILPRODRATE 日产油 日产油量",
    "water_rate": "WATERRATE QW WATERPRODRATE 日产水 日产水量",
    "water_cut": "WATERCUT WCUT WCT FW 含水率 含水",
    "monthly_oil": "MONTHLYOIL OILMONTH OILVOLUME MOIL 月产油 月产油量",
    "monthly_water": "MONTHLYWATER WATERMONTH WATERVOLUME MWATER 月产水 月产水量",
    "cumulative_oil": "CUMULATIVEOIL CUMOIL OILCUM NP 累产油 累计产油",
    "cumulative_water": "CUMULATIVEWATER CUMWATER WATERCUM WP 累产水 累计产水",
    "pressure": "PRESSURE BHP THP WHP RESERVOIRPRESSURE 压力 井底流压 油压 套压",
    "pressure_type": "PRESSURETYPE PRESSUREKIND 压力类型",
    "event_type": "EVENT EVENTTYPE OPERATION 开关井事件 事件类型",
}
# fixed values: types of files by ending, and the fields and words that tell the others
TYPE_BY_ENDING = {"las": "las", "mdb": "production", "accdb": "production", "sgy": "seismic", "segy": "seismic", "seg-y": "seismic", "zgy": "seismic", "geojson": "polygon", "json": "polygon"}
PRODUCTION_WORDS = "production|perfor|completion|ofm|prod|生产|射孔"
PRODUCTION_FIELDS = {"production_month", "onstream_date", "days_on", "liquid_rate", "oil_rate", "water_rate", "water_cut", "monthly_oil", "monthly_water", "cumulative_oil", "cumulative_water", "pressure", "event_type"}
RESULT_HEADERS = {"PHI", "POR", "PERM", "SW", "FACIES", "LITHOLOGY"}
TYPE_WORDS = (("deviation", "dev|deviation|轨迹|井斜"), ("core", "core|岩心"), ("interpretation", "top|interpret|解释"))
# fixed values: predicted types of files by ending or words, in the order tried; those that can be imported
IMAGES, SIDECARS, TABLES = "jpg jpeg png webp bmp tif tiff", "dbf shx prj sbn sbx xml", "csv tsv txt xlsx xlsm"
TABLE_WORDS = (("well_head", "wellhead|well head|井头|井坐标"), ("deviation", "deviation|wellpath|well path|轨迹|井斜"), ("interpretation", "interpret|reservoir|解释|孔渗|饱和"), ("core", "core|rock|岩心|岩芯|取心"))
IMPORTABLE = ("las", "time_depth", "seismic", "well_head", "deviation", "interpretation", "core", "polygon", "alias", "table", "ofm_mdb")


def field_map(headers: list[str]) -> dict[str, str]:
    """SRC04: logical field to header; of several headers that fit the preferred spelling
    wins, of equal ones the later header."""
    by_key = {name_key(h): h for h in headers}
    found = {f: next((by_key[a] for a in aliases.split() if a in by_key), None) for f, aliases in FIELD_ALIASES.items()}
    return {f: h for f, h in found.items() if h is not None}


def field_of(header: Column) -> Column:
    """SRC04: the first logical field that has a header among its spellings, else null."""
    key, c = F.regexp_replace(F.upper(header), "[^0-9A-Z一-鿿]", ""), F.when(F.lit(False), F.lit(""))
    for f, aliases in FIELD_ALIASES.items():
        c = c.when(key.isin(*aliases.split()), f)
    return c


def detect_type(path: str, headers: list[str] | None = None) -> str:
    """SRC03: type of a file by its ending, then by what its headers hold, then by words
    of its name; a head sheet where nothing tells."""
    name = re.sub(r"^.*[/\\]", "", path).lower()
    stem, _, ending = name.rpartition(".") if "." in name else (name, "", "")
    if ending in TYPE_BY_ENDING:
        return TYPE_BY_ENDING[ending]
    if headers:
        have, keys = set(field_map(headers)), {name_key(h) for h in headers}
        if re.search(PRODUCTION_WORDS, stem) and "well" in have and ({"top", "base"} <= have or have & PRODUCTION_FIELDS):
            return "production"
        rules = (
            ("alias", {"alias", "canonical"} <= have), ("deviation", {"well", "md", "inc", "azi"} <= have), ("interpretation", "well" in have and bool(have & {"top", "base"} or keys & RESULT_HEADERS)),
            ("polygon", {"x", "y", "name"} <= have and "well" not in have), ("well_head", "well" in have),
        )
        for kind, holds in rules:
            if holds:
                return kind
    return next((kind for kind, words in TYPE_WORDS if re.search(words, stem)), "well_head")


def predicted_type(path: Column) -> Column:
    """SC20: (type, importable) of a file by ending and words of its path: one of 16
    types. Native trajectories and shapes are listed, but not importable."""
    ext, low = extension(path), F.lower(F.translate(path, "/", "\\"))
    stem = F.lower(F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\.[^.]*$", ""))
    table = ext.isin(*TABLES.split())
    c = (
        F.when((ext == "las") & low.rlike("checkshot|time-depth|时深|校深"), "time_depth").when(ext == "las", "las").when(ext.isin("mdb", "accdb"), "ofm_mdb").when(ext.isin("sgy", "segy") | low.endswith(".seg-y"), "seismic")
        .when(ext.isin("geojson", "json", "shp"), "polygon").when(ext == "dev", "deviation").when((ext == "ptd") | low.rlike("horizon|层位"), "horizon").when(low.rlike("fault|断层"), "fault")
        .when(ext.isin(*IMAGES.split()), "image").when(ext.isin(*SIDECARS.split()), "sidecar")
    )
    for kind, words in TABLE_WORDS:
        c = c.when(table & low.rlike(words), kind)
    c = c.when(table & stem.rlike("alias|井名别名|井名对应"), "alias").when(table & low.rlike("polygon|边界|区块"), "polygon").when(table, "table").otherwise("other")
    return F.struct(c.alias("type"), (c.isin(*IMPORTABLE) & ~ext.isin("dev", "shp")).alias("importable"))


def probed(raw: bytes) -> tuple[str, str, list[str]]:
    """SRC01: (encoding, separator, headers) told from the first bytes of a file: UTF-8
    with or without mark, else GB 18030, else Latin-1; comma, tab or semicolon."""
    for encoding in ("utf-8-sig", "gb18030", "latin-1"):
        try:
            # the last character may be cut in two
            text = next(t for k in range(4) if (t := _text(raw[: len(raw) - k] if k else raw, encoding)) is not None)
            break
        except StopIteration:
            continue
    try:
        sep = csv.Sniffer().sniff(text[:8192], ",\t;").delimiter
    except csv.Error:
        sep = ","
    first = next(csv.reader([text.splitlines()[0]] if text.strip() else [""], delimiter=sep), [])
    return encoding, sep, [unicodedata.normalize("NFC", h).strip() for h in first]


def _text(raw: bytes, encoding: str) -> str | None:
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return None


def read_delimited(spark: SparkSession, path: str, head_bytes: int = 65536) -> DataFrame:
    """SRC01: a delimited file or folder of files of one kind as strings. Encoding,
    separator and headers are told from the first bytes of one file; then Spark reads all
    of them in parallel. Rows of other lengths are cut or filled with nulls."""
    first = spark.read.format("binaryFile").load(path).select("path").agg(F.min("path").alias("path")).first()["path"]
    if first is None:
        return spark.createDataFrame([], "none string").drop("none")
    with opened(first) as handle:
        encoding, sep, headers = probed(handle.read(head_bytes))
    names, seen = [], {}
    for i, h in enumerate(headers):
        h = h or f"COLUMN_{i + 1}"
        seen[h] = seen.get(h, 0) + 1
        names.append(h if seen[h] == 1 else f"{h}_{seen[h]}")
    if encoding == "gb18030":  # Spark does not decode it: a task a file does
        width = len(names)

        def rows(_: str, content: bytes) -> list[dict]:
            lines = list(csv.reader(io.StringIO(content.decode(encoding, errors="replace")), delimiter=sep))[1:]
            return [{"v": [(v or None) for v in (line + [""] * width)[:width]]} for line in lines if line]

        return parsed(spark, path, "*", rows, "v array<string>").select(*[F.col("v")[i].alias(n) for i, n in enumerate(names)])
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    return spark.read.csv(path, header=True, sep=sep, encoding="ISO-8859-1" if encoding == "latin-1" else "UTF-8", schema=schema, enforceSchema=True)
