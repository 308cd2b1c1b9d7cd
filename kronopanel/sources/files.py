"""Readers for the formats the panel's data comes in, and verification of landed files."""

from __future__ import annotations

import hashlib
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, fields, is_dataclass
from pathlib import Path
from typing import Any, get_args, get_origin, get_type_hints

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kronopanel.session import work_dir

# -- typed text ------------------------------------------------------------------------------------


def read_typed_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV with an explicit schema: codes stay text, whatever they look like."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(path)


def read_zipped_parquet(spark: SparkSession, archive: str, member: str) -> DataFrame:
    """A parquet member of a zip archive, streamed once into the shared folder, whatever file system the two lie on."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    source = path(archive)
    files = source.getFileSystem(conf)
    status = files.getFileStatus(source)
    mark = hashlib.sha256(f"{archive}|{member}|{status.getLen()}|{status.getModificationTime()}".encode()).hexdigest()[:24]
    target, part = path(f"{work_dir(spark)}/{mark}.parquet"), path(f"{work_dir(spark)}/{mark}.part")
    shared = target.getFileSystem(conf)
    if not shared.exists(target):
        packed = jvm.java.util.zip.ZipInputStream(files.open(source))
        try:
            while (entry := packed.getNextEntry()) is not None and entry.getName() != member:
                pass
            if entry is None:
                raise KeyError(member)
            out = shared.create(part, True)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(packed, out, 1 << 20, False)
            out.close()
        finally:
            packed.close()
        shared.rename(part, target)
    return spark.read.parquet(target.toString())


# -- zipped event days -----------------------------------------------------------------------------

#: The kept columns of an event file, with their position in a line.
EVENT_COLUMNS = {"sqldate": 1, "event_code": 26, "event_root_code": 28, "quad_class": 29, "goldstein": 30, "num_mentions": 31, "num_articles": 33, "avg_tone": 34, "country": 51, "adm1": 52, "lat": 53, "lon": 54, "date_added": 56, "source_url": 57}


def read_event_days(spark: SparkSession, path: str, country: str) -> DataFrame:
    """Zipped tab-separated event files of a folder, filtered by country while decoding.

    One task per file streams its lines; unreadable numbers and dates become NULL.
    """
    names = list(EVENT_COLUMNS)

    def lines(data: bytes) -> Iterator[list[str | None]]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for member in z.namelist():
                with z.open(member) as f:
                    for raw in io.TextIOWrapper(f, "utf-8", errors="replace"):
                        parts = raw.rstrip("\n").split("\t")
                        if len(parts) > EVENT_COLUMNS["source_url"] and parts[EVENT_COLUMNS["country"]] == country:
                            yield [parts[i] if i < len(parts) and parts[i] != "" else None for i in EVENT_COLUMNS.values()]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                chunk: list = []
                for row in lines(bytes(data)):
                    chunk.append(row)
                    if len(chunk) == 50_000:
                        yield pd.DataFrame(chunk, columns=names, dtype=object)
                        chunk = []
                if chunk:
                    yield pd.DataFrame(chunk, columns=names, dtype=object)

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, ", ".join(f"{c} string" for c in names))
    return typed_events(raw)


def typed_events(raw: DataFrame) -> DataFrame:
    day = lambda c: F.try_to_date(F.col(c), "yyyyMMdd")
    kinds = {"quad_class": "int", "goldstein": "double", "num_mentions": "int", "num_articles": "int", "avg_tone": "double", "lat": "double", "lon": "double"}
    return raw.select(*[day(c).alias(c) if c in ("sqldate", "date_added") else F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in raw.columns])


# -- JSON ------------------------------------------------------------------------------------------


def parse_power(payloads: DataFrame, key: str = "cell", text: str = "payload") -> DataFrame:
    """Monthly gridded weather: ``{header:{fill_value}, properties:{parameter:{T2M:{YYYYMM:x}}}}``.

    Month 13 is the annual mean and is dropped; the fill value means no value.
    """
    schema = "header struct<fill_value: double>, properties struct<parameter: struct<T2M: map<string,double>, PRECTOTCORR: map<string,double>>>"
    p = payloads.select(key, F.from_json(text, schema).alias("j"))
    t = p.select(key, F.col("j.header.fill_value").alias("fill"), F.col("j.properties.parameter.PRECTOTCORR").alias("rain"), F.explode("j.properties.parameter.T2M").alias("ym", "t2m"))
    t = t.where(F.substring("ym", 5, 2) <= "12")
    known = lambda c: F.when(~c.eqNullSafe(F.col("fill")), c)
    return t.select(key, F.to_date(F.concat("ym", F.lit("01")), "yyyyMMdd").alias("ds"), known(F.col("t2m")).alias("t2m"), known(F.try_element_at("rain", F.col("ym"))).alias("prectot"))


def calendar_tokens(raw: dict) -> list[tuple[int, int, str]]:
    """``{year: {months: [{month, days}]}}`` -> rows for the day-token parser."""
    return [(int(y), int(m["month"]), str(m["days"])) for y, v in raw.items() for m in v["months"]]


# -- spreadsheets ----------------------------------------------------------------------------------

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_names(payload: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(payload)) as z:
        return [s.attrib["name"] for s in ET.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheet", _NS)]


def read_sheet(payload: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """Rows of a worksheet as text: shared and inline strings, gaps filled, named sheets."""
    with zipfile.ZipFile(io.BytesIO(payload)) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
        links = {r.attrib["Id"]: r.attrib["Target"] for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        chosen = next((s for s in book.iterfind(".//m:sheet", _NS) if sheet in (None, s.attrib["name"])), None)
        if chosen is None:
            raise KeyError(sheet)
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in si.iterfind(".//m:t", _NS)) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
        target = links[chosen.attrib[_REL]].lstrip("/")
        root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
    out: list[list[str | None]] = []
    for row in root.iterfind(".//m:row", _NS):
        at = int(row.attrib.get("r", len(out) + 1)) - 1
        out.extend([] for _ in range(at - len(out)))
        cells: list[str | None] = []
        for c in row.iterfind("m:c", _NS):
            col = 0
            for letter in re.match("[A-Z]*", c.attrib.get("r", "")).group():
                col = col * 26 + ord(letter) - 64
            cells.extend([None] * (col - 1 - len(cells)))
            if c.attrib.get("t") == "inlineStr":
                value = "".join(t.text or "" for t in c.iterfind(".//m:t", _NS))
            else:
                v = c.find("m:v", _NS)
                value = None if v is None else strings[int(v.text)] if c.attrib.get("t") == "s" else v.text
            cells.append(value)
        out.append(cells)
    return out


def sheet_frame(spark: SparkSession, rows: Sequence[Sequence[str | None]], columns: Sequence[str]) -> DataFrame:
    """Ragged rows padded to the columns, with their row number."""
    n = len(columns)
    return spark.createDataFrame([(i, *[*r, *[None] * n][:n]) for i, r in enumerate(rows)], "row_no long, " + ", ".join(f"`{c}` string" for c in columns))


def parse_bulletin(rows: DataFrame, code: str, name: str, value: str) -> DataFrame:
    """Population bulletin: level by the shape of the code, region filled forward, typed value.

    The fill runs over the rows of one sheet.
    """
    from pyspark.sql import Window

    digits = F.regexp_replace(F.coalesce(F.col(code), F.lit("")), "[^0-9]", "")
    level = F.when(digits == "", "none").when(F.substring(digits, 3, 9).rlike("^0*$"), "region").when(F.substring(digits, 6, 6).rlike("^0*$"), "district").otherwise("settlement")
    number = F.regexp_replace(F.col(value), r"[\s ]", "").try_cast("long")
    r = rows.select("row_no", F.when(digits != "", digits).alias("code"), F.trim(name).alias("name"), number.alias("value"), level.alias("level"))
    region = F.when(F.col("level") == "region", F.substring("code", 1, 2))
    return r.withColumn("region", F.last(region, ignorenulls=True).over(Window.orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)))


# -- manifests -------------------------------------------------------------------------------------


class ArchiveAbsent(FileNotFoundError):
    """Files of the manifest are not there."""


class ArchiveMismatch(ValueError):
    """Files differ from the manifest."""


@dataclass(frozen=True)
class FileSpec:
    name: str
    sha256: str
    rows: int | None = None


def sha256_of(path: Path) -> str:
    digest = hashlib.sha256()
    with path.open("rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def build_manifest(folder: Path, pattern: str = "*.parquet") -> list[FileSpec]:
    import pyarrow.parquet as pq

    return [FileSpec(p.name, sha256_of(p), pq.ParquetFile(p).metadata.num_rows if p.suffix == ".parquet" else None) for p in sorted(folder.glob(pattern))]


def manifest_problems(folder: Path, files: Iterable[FileSpec]) -> list[str]:
    """What differs: absent files, other content, other row counts."""
    import pyarrow.parquet as pq

    out = []
    for f in files:
        p = folder / f.name
        if not p.exists():
            out.append(f"{f.name}: absent")
        elif sha256_of(p) != f.sha256:
            out.append(f"{f.name}: content differs")
        elif f.rows is not None and p.suffix == ".parquet" and pq.ParquetFile(p).metadata.num_rows != f.rows:
            out.append(f"{f.name}: rows differ")
    return out


def load_archive(spark: SparkSession, folder: Path, files: Sequence[FileSpec]) -> DataFrame:
    """Exactly the manifest's files; absent and altered ones are different errors."""
    problems = manifest_problems(folder, files)
    if any(p.endswith("absent") for p in problems):
        raise ArchiveAbsent("; ".join(problems))
    if problems:
        raise ArchiveMismatch("; ".join(problems))
    return spark.read.parquet(*[str(folder / f.name) for f in files])


def missing_days(events: DataFrame, day: str, first: str, last: str) -> DataFrame:
    """Days of the span that have no row."""
    span = events.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return span.join(events.select(F.col(day).cast("date").alias("day")).distinct(), "day", "left_anti")


# -- configuration and stamps ----------------------------------------------------------------------


class ConfigError(ValueError):
    """A configuration does not fit its type; the message names the path."""


def from_mapping(kind: type, raw: Any, path: str = "") -> Any:
    """Strict conversion of plain mappings into dataclasses: unknown and missing fields are errors."""
    if is_dataclass(kind):
        if not isinstance(raw, dict):
            raise ConfigError(f"{path or kind.__name__}: a mapping is expected")
        hints = get_type_hints(kind)
        known = {f.name: f for f in fields(kind)}
        if extra := set(raw) - set(known):
            raise ConfigError(f"{path}: unknown {sorted(extra)}")
        made = {}
        for name, f in known.items():
            if name in raw:
                made[name] = from_mapping(hints[name], raw[name], f"{path}.{name}".lstrip("."))
            elif f.default is f.default_factory:  # neither default nor factory
                raise ConfigError(f"{path}.{name}".lstrip(".") + ": missing")
        return kind(**made)
    origin, args = get_origin(kind), get_args(kind)
    if origin in (tuple, list):
        if not isinstance(raw, list | tuple):
            raise ConfigError(f"{path}: a list is expected")
        return origin(from_mapping(args[0], x, f"{path}[{i}]") for i, x in enumerate(raw))
    if origin is dict:
        return {k: from_mapping(args[1], v, f"{path}.{k}") for k, v in raw.items()}
    if kind is float and isinstance(raw, int) and not isinstance(raw, bool):
        return float(raw)
    if kind is Any or isinstance(raw, kind) and not (kind is int and isinstance(raw, bool)):
        return raw
    raise ConfigError(f"{path}: {kind.__name__} is expected, not {type(raw).__name__}")


def frame_digest(df: DataFrame) -> str:
    """Digest of a table's rows, independent of their order and partitioning."""
    h = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in sorted(df.columns)])
    r = df.select(h.alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{sorted(df.columns)}|{r.n}|{r.x}|{r.s}".encode()).hexdigest()


def digest(value: Any) -> str:
    """Digest of plain values."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str, ensure_ascii=False).encode()).hexdigest()


def write_stamp(path: Path, inputs: dict[str, str]) -> None:
    part = path.with_suffix(path.suffix + ".part")
    part.write_text(json.dumps(inputs, sort_keys=True, indent=1))
    part.rename(path)


def stale_inputs(path: Path, inputs: dict[str, str]) -> list[str]:
    """Names of inputs that changed since the stamp was written; all of them without a stamp."""
    if not path.exists():
        return sorted(inputs)
    old = json.loads(path.read_text())
    return sorted(k for k in {*old, *inputs} if old.get(k) != inputs.get(k))


def input_digest(key: str, root: Path) -> str | None:
    """Digest of an input named ``file:<path>`` or ``glob:<folder>/<pattern>[;except=a,b]``; None if the name says neither."""
    kind, _, spec = key.partition(":")
    if kind == "file":
        path = root / spec
        return sha256_of(path) if path.exists() else "absent"
    if kind == "glob":
        where, _, left_out = spec.partition(";except=")
        folder, _, pattern = where.rpartition("/")
        return digest({p.name: sha256_of(p) for p in sorted((root / folder).glob(pattern)) if p.name not in left_out.split(",")})
    return None


def stale_artifacts(stamps: dict[str, Path], root: Path) -> dict[str, list[str]]:
    """Artifacts that must be made anew, with the inputs that changed.

    An artifact without stamp, or whose stamp names no input that can be read again, proves nothing and is
    stale as well; it has the entry ``stamp``.
    """
    out = {}
    for name, path in stamps.items():
        old = json.loads(path.read_text()) if path.exists() else {}
        now = {k: v for k in old if (v := input_digest(k, root)) is not None}
        changed = sorted(k for k, v in now.items() if old[k] != v) if now else ["stamp"]
        if changed:
            out[name] = changed
    return out
