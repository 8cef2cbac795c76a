"""Sinks: delimited text, logs, trajectories, versioned tables, manifests."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """SNK13: delimited text with a header; as many parts as partitions."""
    df.write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def wells_in_scope(wells: DataFrame, box: tuple[float, float, float, float] | None = None, rings: DataFrame | None = None) -> DataFrame:
    """SNK01: wells (id, x, y, ...) in a box (x0, y0, x1, y1), in any polygon (rings), or
    all of them; wells without a place are in no scope but that of all."""
    from wellspring.operators.surfaces import points_in_polygons

    out = wells if box is None else wells.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))
    if rings is None:
        return out
    return out.join(points_in_polygons(out.where("not isnan(x) and not isnan(y)").select("id", "x", "y"), rings, 1000.0).select("id").distinct(), "id", "left_semi")


def write_wells(wells: DataFrame, path: str) -> None:
    """SNK01: one delimited file with the mark of UTF-8 before its header, as spreadsheet
    programs want it, in the order of ids. A person's export: one task writes it."""
    names = [f"\ufeff{c}" if i == 0 else c for i, c in enumerate(wells.columns)]
    wells.orderBy(wells.columns[0]).coalesce(1).toDF(*names).write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def write_versioned(df: DataFrame, path: str, run_id: str) -> None:
    """SNK12, SNK14: rows of one run as a partition; a run written again replaces only itself."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def append_version(df: DataFrame, path: str) -> None:
    """SNK15: append rows of a META table; readers take the latest of each key."""
    df.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """SNK15: the newest row of each key."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "saved_at").alias("r")).select(*keys, "r.*")


def _lines(by: DataFrame, key: str, head: Column, line: Column, order: str) -> DataFrame:
    """(key, text): the head line and the ordered lines of each key."""
    g = by.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("s"), F.first(head).alias("h"))
    return g.select(key, F.concat(F.col("h"), F.lit("\n"), F.array_join(F.transform("s", lambda x: x["l"]), "\n"), F.lit("\n")).alias("text"))


def dev_files(path: DataFrame) -> DataFrame:
    """SNK04: (well, text) of trajectory files from points (well, md, x, y, z, tvd); a
    path has as many lines as stations."""
    num = lambda c: F.format_string("%.3f", F.col(c))
    return _lines(path, "well", F.concat(F.lit("# WELL "), F.col("well"), F.lit("\n# MD X Y Z TVD")), F.concat_ws(" ", *[num(c) for c in ("md", "x", "y", "z", "tvd")]), "md")


def las_bundle(samples: DataFrame, null: float = -999.25, headers: DataFrame | None = None) -> DataFrame:
    """SNK05, SNK06, SC35: (well, text) of logs with all curves of samples (well, mnemonic,
    unit, md, value): curves in order of name, numbers of four places, gaps as the null
    value; header lines to keep (well, place, line) go before the curves. A log has as many
    lines as depths."""
    num = lambda c: F.format_string("%.4f", c)
    curves = samples.groupBy("well", "mnemonic").agg(F.max("unit").alias("unit"))
    listed = curves.groupBy("well").agg(F.array_sort(F.collect_list(F.struct("mnemonic", F.coalesce("unit", F.lit("")).alias("unit")))).alias("curves"))
    at = samples.groupBy("well", "md", "mnemonic").agg(F.max("value").alias("value")).groupBy("well", "md").agg(F.map_from_entries(F.collect_list(F.struct("mnemonic", "value"))).alias("v"))
    line = F.concat_ws(" ", num(F.col("md")), F.array_join(F.transform("curves", lambda c: num(F.coalesce(F.try_element_at("v", c["mnemonic"]), F.lit(null)))), " "))
    body = at.join(listed, "well").select("well", "md", line.alias("line")).groupBy("well").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("md", "line"))), lambda x: x["line"]), "\n").alias("body"), F.min("md").alias("start"), F.max("md").alias("stop"))
    out = body.join(listed, "well")
    if headers is not None:
        kept = headers.groupBy("well").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("kept"))
        out = out.join(kept, "well", "left")
    said = F.coalesce(F.concat(F.col("kept"), F.lit("\n")), F.lit("")) if headers is not None else F.lit("")
    head = F.concat(F.lit("~VERSION INFORMATION\nVERS. 2.0 :\nWRAP. NO :\n~WELL INFORMATION\nSTRT.M "), num(F.col("start")), F.lit(" :\nSTOP.M "), num(F.col("stop")), F.lit(f" :\nNULL. {null} :\nWELL. "), F.col("well"), F.lit(" :\n"), said, F.lit("~CURVE INFORMATION\nDEPT.M :\n"), F.array_join(F.transform("curves", lambda c: F.concat(c["mnemonic"], F.lit("."), c["unit"], F.lit(" :"))), "\n"), F.lit("\n~ASCII\n"))
    return out.select("well", F.concat(head, "body", F.lit("\n")).alias("text"))


def las_files(samples: DataFrame, curve: str, null: float = -999.25) -> DataFrame:
    """SNK05: (well, text) of one-curve logs from samples (well, md, value)."""
    return las_bundle(samples.select("well", F.lit(curve).alias("mnemonic"), F.lit(None).cast("string").alias("unit"), "md", "value"), null)


def merged_focus(chosen: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK06: samples (well, mnemonic, unit, md, value) of the chosen curve of each well and
    type (well, curve_type, curve_id) from samples (curve_id, md, value, unit) under the name
    of their type, and a manifest of the wells: chosen curves, samples, range, and types
    without samples."""
    j = chosen.join(samples.select("curve_id", "unit", "md", "value"), "curve_id", "left")
    merged = j.where("md is not null").select("well", F.upper("curve_type").alias("mnemonic"), "unit", "md", "value")
    manifest = j.groupBy("well", "curve_type", "curve_id").agg(F.count("value").alias("samples"), F.min("md").alias("top"), F.max("md").alias("base"))
    return merged, manifest.withColumn("missing", F.col("samples") == 0)


def files_by_type(typed: DataFrame, files: DataFrame, types: list[str]) -> DataFrame:
    """SNK07: manifest of log files to copy whole because they hold a curve of the types:
    typed curves (las_file_id, curve_type), files (las_file_id, path); the types each holds,
    the folder of its first type, and whether its path is known."""
    held = typed.where(F.col("curve_type").isin(types)).groupBy("las_file_id").agg(F.array_sort(F.collect_set("curve_type")).alias("t"))
    j = held.join(files.select("las_file_id", "path").dropDuplicates(["las_file_id"]), "las_file_id", "left")
    return j.select("las_file_id", "path", F.array_join("t", ",").alias("types"), F.col("t")[0].alias("folder"), F.col("path").isNull().alias("missing"))


def directory_delivery(wanted: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK09: what is delivered and what is missing: wanted (well_key, kind), found (well_key,
    kind, path). Every file goes under kind and well, numbered where names clash; the report
    has a row a well with the kinds it lacks."""
    name = F.regexp_replace("path", r"^.*[/\\]", "")
    j = wanted.distinct().join(found, ["well_key", "kind"], "left")
    w = W.partitionBy("well_key", "kind", "name").orderBy("path")
    rows = j.where("path is not null").withColumn("name", name).withColumn("nth", F.row_number().over(w))
    unique = F.when(F.col("nth") == 1, F.col("name")).otherwise(F.concat(F.regexp_replace("name", r"(\.[^.]*)?$", ""), F.lit("_"), "nth", F.regexp_extract("name", r"(\.[^.]*)$", 1)))
    delivered = rows.select("well_key", "kind", "path", F.concat_ws("/", "kind", "well_key", unique).alias("target"))
    missing = j.groupBy("well_key").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("path").isNull(), F.col("kind")))), ",").alias("lacks"), F.countDistinct("path").alias("files"))
    return delivered, missing


def reconstruction(wells: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """SNK10: one row a well with all that is known of it as JSON: head and, for every named
    part (well_key, ...), its rows in order, empty where it has none; and how many there are."""
    out = wells.select("well_key", F.to_json(F.struct(*[c for c in wells.columns if c != "well_key"])).alias("head"))
    for name, df in parts.items():
        rest = [c for c in df.columns if c != "well_key"]
        rows = df.groupBy("well_key").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("r")).select("well_key", F.to_json("r").alias(name), F.size("r").alias(f"{name}_n"))
        out = out.join(rows, "well_key", "left").withColumns({name: F.coalesce(name, F.lit("[]")), f"{name}_n": F.coalesce(f"{name}_n", F.lit(0))})
    return out


def workbook(rows: list[list]) -> bytes:
    """SNK11: a workbook of one sheet of 26 columns at most, texts in place, numbers as
    numbers, nulls as no cell."""
    def cell(v, place: str) -> str:
        if v is None or v != v:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{place}"><v>{float(v)!r}</v></c>'
        return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    ns, office = "http://schemas.openxmlformats.org", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = "".join(f'<row r="{i}">' + "".join(cell(v, f"{chr(65 + j)}{i}") for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{ns}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{office}"><sheets><sheet name="perforations" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{ns}/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def perforation_workbooks(perforations: DataFrame) -> DataFrame:
    """SNK11: (sheet, content) a workbook a sheet of perforations (sheet, well, kind, top,
    base) in well and depth order under the standard columns; a sheet is what a person can
    open, so a task writes it."""
    head = ["WELL", "TYPE", "TOP_MD", "BASE_MD"]

    def build(b: pd.DataFrame) -> pd.DataFrame:
        rows = b.sort_values(["well", "top", "base"]).astype(object)[["well", "kind", "top", "base"]]
        return pd.DataFrame({"sheet": [b["sheet"].iloc[0]], "content": [workbook([head, *rows.where(rows.notna(), None).values.tolist()])]})

    return perforations.select("sheet", "well", "kind", "top", "base").groupBy("sheet").applyInPandas(build, "sheet string, content binary")


def write_texts(files: DataFrame, key: str, folder: str, suffix: str) -> DataFrame:
    """Write (key, text) as one file each under a folder of any filesystem that pyarrow
    knows and all executors reach; gives the manifest (key, path, bytes). A file appears
    under its name when it is whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        where.create_dir(base, recursive=True)
        for b in batches:
            out = []
            for k, text in zip(b[key], b["text"]):
                name = f"{base}/" + "".join(c if c.isalnum() or c in "-_" else "_" for c in str(k)) + suffix
                data = text if isinstance(text, bytes) else text.encode()
                with where.open_output_stream(name + ".tmp") as f:
                    f.write(data)
                where.move(name + ".tmp", name)
                out.append((k, name, len(data)))
            yield pd.DataFrame(out, columns=[key, "path", "bytes"])

    return files.select(key, "text").mapInPandas(run, f"{key} string, path string, bytes long")


def resampled_curve(samples: DataFrame, step: float, old_step: float) -> DataFrame:
    """MDL34: (well, md, value) on regular depths from the first to the last sample,
    linear over gaps of up to the greater of five old and two new steps. A sample gives the
    depths from its own up to the next one's, so depths meet no samples in a join: the few
    wells there are would be taken for a small side and all their depths be broadcast."""
    near = 1e-8
    w = W.partitionBy("well").orderBy("md", "value")
    gap = max(5 * old_step, 2 * step)
    s = samples.where("value is not null and md is not null")
    seg = s.select("well", "md", "value", F.first("md").over(w).alias("lo"), F.lead(F.struct("md", "value")).over(w).alias("n"))
    start = F.greatest(F.lit(0), F.floor((F.col("md") - near - F.col("lo")) / step))
    # of the last sample also a depth that rounding puts just behind it
    stop = F.coalesce(F.ceil((F.col("n.md") - F.col("lo")) / step), F.floor((F.col("md") - F.col("lo")) / step + 1e-9))
    at = seg.withColumn("i", F.explode(F.sequence(start, stop))).withColumn("q", F.col("lo") + F.col("i") * step)
    own = at.where((F.col("q") >= F.col("md") - near) & (F.col("n").isNull() | (F.col("q") < F.col("n.md") - near)))
    exact = F.abs(F.col("q") - F.col("md")) <= near
    t = (F.col("q") - F.col("md")) / (F.col("n.md") - F.col("md"))
    value = F.when(exact, F.col("value")).when(F.col("n.md") - F.col("md") <= gap, F.col("value") + (F.col("n.value") - F.col("value")) * t)
    return own.select("well", F.col("q").alias("md"), value.alias("value"))


# fixed values: the sets of a production export and their columns
EXPORT_COLUMNS = {
    "coordinates": "well x y", "perforations": "well top base kind", "summary": "well_key months oil_volume water_volume", "history": "well_key month oil_rate water_rate gas_rate days_on",
    "injection": "well_key month water_rate", "events": "well_key month status", "deviations": "well md inc azi", "markers": "well layer md", "keywords": "well_key keyword",
}


def export_sets(tables: dict[str, DataFrame], spark: SparkSession) -> dict[str, DataFrame]:
    """SNK02, SNK03: the nine sets of a production export under fixed columns, and a report
    of how many rows each has. Sets that are not given are empty; columns a table lacks are
    null; the columns are the same either way."""
    sets = {}
    for name, columns in EXPORT_COLUMNS.items():
        df = tables.get(name)
        have = df.columns if df is not None else []
        base = df if df is not None else spark.range(0)
        sets[name] = base.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns.split()])
    report = None
    for name, df in sets.items():
        n = df.agg(F.lit(name).alias("name"), F.count("*").alias("n")).withColumn("available", F.col("n") > 0)
        report = n if report is None else report.unionByName(n)
    return {**sets, "availability": report}
