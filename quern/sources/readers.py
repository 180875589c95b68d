"""Readers: JSON lines with defaults, graph tables, text lines, spreadsheets, rule lists, weights."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions import text as T
from quern.functions import vectors as V

# Fields of the entity files and what a missing one becomes.
SCHEMAS = {
    "documents": {"id": "", "path": "", "kind": "DOC", "updated_at": "", "source_of_truth": False, "trust_level": 50.0, "status": "active", "excerpt": "", "content": ""},
    "rules": {"id": "", "title": "", "body": "", "scope": "global", "updated_at": "", "source_of_truth": True, "trust_level": 95.0, "status": "active", "priority": 0.0},
    "adrs": {"id": "", "path": "", "title": "", "body": "", "decision_date": "", "supersedes_id": "", "source_of_truth": True, "trust_level": 95.0, "status": "active"},
    "chunks": {"id": "", "file_id": "", "name": "", "kind": "chunk", "signature": "", "body": "", "start_line": 0.0, "end_line": 0.0, "language": "", "updated_at": "", "source_of_truth": False, "trust_level": 60.0, "status": "active"},
}
# Spreadsheet headers of each field; the first that is there counts.
HEADERS = {
    "case_number": ["case number", "ärendenummer", "case"], "title": ["title", "rubrik", "titel", "subject"], "account": ["account", "kund", "customer", "konto"], "contact": ["contact", "kontakt"],
    "description": ["description", "beskrivning"], "case_type": ["case type", "ärendetyp", "type"], "support_type": ["support type", "supporttyp"], "status": ["status"], "priority": ["priority", "prioritet"],
    "owner": ["owner", "ägare"], "created_at": ["created on", "skapad", "created"], "product": ["product", "produkt"],
}


def loose(kinds: dict[str, str], column: str, default) -> Column:
    """A column of any kind as that of its default: text that is a number, or a number that is true or false, counts as such."""
    c = F.col(column)
    if isinstance(default, bool):
        low = F.lower(T.trim(c.cast("string")))
        got = c if kinds[column] == "boolean" else F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False) if kinds[column] == "string" else c.try_cast("boolean")
    elif isinstance(default, float):
        got = T.trim(c).try_cast("double") if kinds[column] == "string" else c.try_cast("double")
        got = F.when(~F.isnan(got) & (F.abs(got) < float("inf")), got)
    else:
        got = F.nullif(c.cast("string"), F.lit(""))
    return F.coalesce(got, F.lit(default))


def vertices(rows: DataFrame, kind: str, content: DataFrame | None = None) -> DataFrame:
    """Rows of a graph table as entities of a kind, whatever types its columns have.

    Missing fields and values that cannot be read get the kind's default; rows
    without an id (documents: or without a path) are dropped, and a rule without
    a title gets its id. content is (id, content), for documents.
    """
    fields, kinds = SCHEMAS[kind], dict(rows.dtypes)
    out = rows.select(*[loose(kinds, k, v).alias(k) if k in kinds else F.lit(v).alias(k) for k, v in fields.items()]).where("id <> ''")
    if kind == "documents":
        out = out.where("path <> ''").withColumn("kind", F.when(F.upper("kind").isin("CODE", "ADR"), F.upper("kind")).otherwise("DOC"))
        if content is not None:
            out = out.drop("content").join(content.select("id", "content"), "id", "left").withColumn("content", F.coalesce("content", F.lit(""))).select(*fields)
    return out.withColumn("title", F.when(F.col("title") == "", F.col("id")).otherwise(F.col("title"))) if kind == "rules" else out


def statements(ddl: str) -> list[str]:
    """The statements of a definition: lines that begin with // left out, cut at semicolons."""
    text = "\n".join(line for line in ddl.splitlines() if not line.strip().startswith("//"))
    return [f"{s.strip()};" for s in text.split(";") if s.strip()]


def present(spark: SparkSession, folder: str, required: list[str], optional: list[str] = ()) -> list[str]:
    """Which optional files folder lacks; an error that names the first required one it lacks."""
    context = spark.sparkContext
    top = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = top.getFileSystem(context._jsc.hadoopConfiguration())
    there = lambda name: files.exists(context._jvm.org.apache.hadoop.fs.Path(top, name))
    for name in required:
        if not there(name):
            raise FileNotFoundError(f"{folder}/{name}")
    return [name for name in optional if not there(name)]


#: Spark's conditions for what a store does not give.
UNREAD = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "CANNOT_READ_FILE", "LOAD_DATA_PATH_NOT_EXISTS")


def chosen(graph: Callable[[], dict[str, DataFrame]], cache: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], str]:
    """Per kind the graph's rows where it has some, else the cache's; all of the cache's, and why, if the graph cannot be read.

    Only what the store does counts: files that are not there or cannot be read.
    A mistake in the caller's plan is raised.
    """
    try:
        found = graph()
        return {k: first_not_empty(found[k], own) if k in found else own for k, own in cache.items()}, ""
    except OSError as e:  # the store is another system; the cache serves on
        return dict(cache), f"graph not read: {e}"
    except PySparkException as e:
        if not str(e.getCondition() or "").startswith(UNREAD):
            raise
        return dict(cache), f"graph not read: {e}"
    except Py4JJavaError as e:
        if "java.io." not in str(e.java_exception):
            raise
        return dict(cache), f"graph not read: {e.java_exception}"


def model_of(index: DataFrame) -> str | None:
    """The first model that an index (id, model, vector) names, in the order of ids."""
    row = index.where("coalesce(model, '') <> ''").orderBy("id").select("model").first()
    return row["model"] if row else None


def stored_vectors(stored: DataFrame, ids: DataFrame, dimensions: int) -> DataFrame:
    """(id, vector) of stored vectors, packed as float32 or as arrays, of the ids asked for; those of another length are dropped."""
    own = stored.where(F.col("vector").isNotNull()).join(ids.select("id"), "id", "left_semi")
    if dict(stored.dtypes)["vector"] == "binary":
        own = own.withColumn("vector", V.unpacked(F.col("vector")))
    return own.where(F.size("vector") == dimensions).select("id", "vector")


def evaluation_records(rows: DataFrame) -> DataFrame:
    """Records (id, text, person, org, tags, date) of a spreadsheet's rows, for an evaluation without a store."""
    number = F.row_number().over(Window.partitionBy("file").orderBy("ordinal"))
    return rows.select(
        F.concat_ws("#", "file", number.cast("string")).alias("id"), "title", "description", "owner", "account", "support_type", "priority", "product", "created_at"
    ).select("id", F.concat_ws("\n", "title", F.nullif(F.substring("description", 1, 500), F.lit(""))).alias("text"), T.first_text(F.col("owner"), F.lit("Okänd")).alias("person"), F.nullif("account", F.lit("")).alias("org"),
        F.filter(F.array("support_type", "priority", "product"), lambda t: t != "").alias("tags"), F.try_to_timestamp(F.nullif("created_at", F.lit(""))).alias("date"))


def json_entities(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of a JSON-lines file with the defaults of their kind; broken lines and rows without an id are dropped."""
    fields = SCHEMAS[kind]
    kinds = {str: "string", bool: "boolean", float: "double"}
    raw = spark.read.schema(", ".join(f"`{k}` {kinds[type(v)]}" for k, v in fields.items())).option("mode", "DROPMALFORMED").json(path)
    rows = raw.select(*[F.coalesce(k, F.lit(v)).alias(k) for k, v in fields.items()]).where("id <> ''")
    return rows.withColumn("kind", F.when(F.upper("kind").isin("DOC", "CODE", "ADR"), F.upper("kind")).otherwise("DOC")) if kind == "documents" else rows


def relations(spark: SparkSession, path: str, relation: str) -> DataFrame:
    """(from, to, relation, note) of a JSON-lines file; both ends are needed, the note is the first of note and reason."""
    raw = spark.read.schema("`from` string, `to` string, note string, reason string").option("mode", "DROPMALFORMED").json(path)
    note = F.coalesce(T.first_text(F.col("note"), F.col("reason")), F.lit(""))
    return raw.where("coalesce(`from`, '') <> '' and coalesce(`to`, '') <> ''").select("from", "to", F.lit(relation).alias("relation"), note.alias("note"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, signature, model, vector) of an embedding index: finite numbers only, and some."""
    raw = spark.read.schema("id string, signature string, model string, vector array<double>").option("mode", "DROPMALFORMED").json(path)
    return raw.withColumn("vector", F.filter("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).where((F.coalesce("id", F.lit("")) != "") & (F.size("vector") > 0))


def lines(df: DataFrame, column: str = "raw") -> DataFrame:
    """One row per line of the column that is not blank, trimmed, with its place: id, pos, text."""
    each = df.select("id", F.posexplode(F.split(column, "\n")).alias("pos", "line"))
    return each.select("id", "pos", T.trim(F.col("line")).alias("text")).where("text <> ''")


def rules_yaml(spark: SparkSession, text: str) -> DataFrame:
    """Rules of a YAML list of flat maps; `enforce: false` makes a rule a draft. The file is a configuration, read on the driver."""
    rows: list[dict] = []
    for line in text.splitlines():
        m = re.match(r"^\s*(-\s+)?([A-Za-z_]+)\s*:\s*(.*?)\s*$", line)
        if not m:
            continue
        if m[1] and m[2] == "id":
            rows.append({})
        if rows:
            rows[-1][m[2]] = m[3].strip("'\"")
    base = SCHEMAS["rules"]
    out = []
    for r in rows:
        if r.get("id"):
            status = "draft" if r.get("enforce", "").lower() == "false" else r.get("status") or "active"
            number = r.get("priority", "")
            body = r.get("description") or r.get("body") or ""
            out.append({**base, "id": r["id"], "title": r.get("title") or r["id"], "body": body, "scope": r.get("scope") or "global", "status": status, "priority": float(number) if re.fullmatch(r"-?\d+(\.\d+)?", number) else 0.0})
    kinds = {str: "string", bool: "boolean", float: "double"}
    return spark.createDataFrame(out, ", ".join(f"{k} {kinds[type(v)]}" for k, v in base.items()))


def weights(text: str) -> dict[str, float]:
    """Ranking weights of a configuration's `ranking:` section over the defaults."""
    out, inside = dict(fixed.WEIGHTS), False
    for line in text.splitlines():
        if re.match(r"^\S", line):
            inside = line.strip() == "ranking:"
        elif inside and (m := re.match(r"^\s+(semantic|graph|trust|recency)\s*:\s*([0-9.]+)\s*$", line)):
            out[m[1]] = float(m[2])
    return out


def first_not_empty(*frames: DataFrame) -> DataFrame:
    """The first frame with a row, else the last."""
    return next((f for f in frames[:-1] if not f.isEmpty()), frames[-1])


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_rows(data: bytes) -> list[list[str]]:
    """Cells of the first sheet whose name does not hold 'hidden', as text; dates are left as their numbers."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [s for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        sheet = next((s for s in sheets if "hidden" not in (s.get("name") or "").lower()), sheets[0])
        path = target[sheet.get(_LINK)].lstrip("/")
        root = ElementTree.fromstring(z.read(path if path.startswith("xl/") else posixpath.join("xl", path)))
    out = []
    for row in root.iter(f"{_MAIN}row"):
        cells: dict[int, str] = {}
        for k, c in enumerate(row.iter(f"{_MAIN}c")):
            letters = re.match(r"[A-Z]+", c.get("r") or "")
            at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else k
            v = c.find(f"{_MAIN}v")
            text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
            cells[at] = shared[int(text)] if c.get("t") == "s" and text else text
        out.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
    return out


def sheet_records(data: bytes) -> list[dict[str, str]]:
    """Rows of a sheet by field, those without a title left out."""
    rows = sheet_rows(data)
    if not rows:
        return []
    heads = [re.sub(r"^\(do not (?:change|modify)\)\s*", "", h, flags=re.IGNORECASE).strip().lower() for h in rows[0]]
    at = {field: next((heads.index(n) for n in names if n in heads), None) for field, names in HEADERS.items()}
    out = []
    for r in rows[1:]:
        one = {f: (r[k].strip() if k is not None and k < len(r) else "") for f, k in at.items()}
        if one["created_at"] and re.fullmatch(r"\d+(\.\d+)?", one["created_at"]):
            one["created_at"] = (datetime(1899, 12, 30) + timedelta(days=float(one["created_at"]))).isoformat()
        if one["title"]:
            out.append(one)
    return out


def spreadsheets(spark: SparkSession, path: str) -> DataFrame:
    """Records of all spreadsheets below path, a file a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, data in zip(f["path"], f["content"], strict=True):
                rows = sheet_records(data)
                if rows:
                    yield pd.DataFrame(rows).assign(file=name, ordinal=range(len(rows)))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ", ".join(f"{k} string" for k in [*HEADERS, "file"]) + ", ordinal long")
