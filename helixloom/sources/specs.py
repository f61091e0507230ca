"""Readers of design specs and spreadsheets; a bad file is a row, not a failure."""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPEC = """struct<id:string,version:string,host:string,backbone:map<string,string>,constraints:struct<fragment_bp_max:int,forbid_sites:array<string>,host_context:string>,
architecture:struct<order:array<string>,trims:map<string,map<string,string>>>,
parts:array<struct<id:string,role:string,class:string,variant:string,pin:string,source:map<string,string>,seal:struct<status:string,lib:string,seq_sha256_12:string,length:string>>>>"""


def specs(files: DataFrame) -> DataFrame:
    """(path, spec, problem) of YAML files (path, text). A file that isn't
    YAML of a mapping has a null spec and says where it broke. Fields that a
    spec lacks are null; values keep the text they have as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for batch in batches:
            out: dict = {"path": batch.column("path").to_pylist(), "json": [], "problem": []}
            for text in batch.column("text").to_pylist():
                read = problem = None
                try:
                    read = yaml.safe_load(text or "")
                    if not isinstance(read, dict):
                        read, problem = None, "no mapping"
                except yaml.MarkedYAMLError as e:
                    at = e.problem_mark
                    problem = f"line {at.line + 1}, column {at.column + 1}: {e.problem}" if at else str(e)
                except yaml.YAMLError as e:
                    problem = str(e)
                out["json"].append(None if read is None else json.dumps(read, default=str))
                out["problem"].append(problem)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.string()) for k in out]))

    rows = files.select("path", "text").mapInArrow(run, "path string, json string, problem string")
    return rows.select("path", F.from_json("json", SPEC).alias("spec"), "problem")


def spec_parts(read: DataFrame) -> DataFrame:
    """(spec, id, role, sealed, pin, lib, length) rows of :func:`specs`."""
    each = read.where("spec is not null").select(F.col("spec.id").alias("spec"), F.explode("spec.parts").alias("p"))
    return each.select("spec", "p.id", "p.role", F.col("p.seal").isNotNull().alias("sealed"), F.col("p.seal.seq_sha256_12").alias("pin"), "p.seal.lib", "p.seal.length")


def spec_order(read: DataFrame) -> DataFrame:
    """(spec, position, id), positions from 0, repeats kept."""
    return read.where("spec is not null").select(F.col("spec.id").alias("spec"), F.posexplode("spec.architecture.order").alias("position", "id"))


def specs_by_host(files: DataFrame) -> DataFrame:
    """(host, specs) of spec files (path, text): the names of those whose first
    ``host:`` line names it. Lines are enough, so that a file that isn't YAML
    counts as well; one without such a line doesn't."""
    line = F.regexp_extract("text", r"(?m)^[ \t]*host:([^\r\n]*)", 1)
    host = F.regexp_replace(F.trim(F.split(line, "#")[0]), r"""^["']+|["']+$""", "")
    named = files.select(host.alias("host"), F.element_at(F.split("path", "/"), -1).alias("name")).where("host <> ''")
    return named.groupBy("host").agg(F.array_sort(F.collect_list("name")).alias("specs"))


def sheet_cells(content: bytes) -> list[str]:
    """Texts of a workbook's cells, sheets by name, cells in file order."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names, plain = book.namelist(), lambda node: "".join(t.text or "" for t in node.iter() if t.tag.endswith("}t"))
        shared = [plain(x) for x in ET.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        cells = []
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            for cell in (c for c in ET.fromstring(book.read(name)).iter() if c.tag.endswith("}c")):
                value = next((v.text or "" for v in cell if v.tag.endswith("}v")), "")
                kind = cell.get("t")
                cells.append(shared[int(value)] if kind == "s" and value else plain(cell) if kind == "inlineStr" else value)
        return cells


def sheets(files: DataFrame) -> DataFrame:
    """(path, text, problem): cells of workbooks (path, content), one a line,
    ready for ``files.loose_sequence``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict = {"path": batch.column("path").to_pylist(), "text": [], "problem": []}
            for content in batch.column("content").to_pylist():
                try:
                    text, problem = "\n".join(sheet_cells(content or b"")), None
                except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, IndexError) as e:
                    text, problem = None, f"{type(e).__name__}: {e}"
                out["text"].append(text)
                out["problem"].append(problem)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.string()) for k in out]))

    return files.select("path", "content").mapInArrow(run, "path string, text string, problem string")
