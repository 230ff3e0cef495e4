"""Sources and sinks: verified JSON exchange, snapshots with a manifest, encoded bytes, replayed feeds."""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from derlem.sources.store import Store


def export_json(df: DataFrame, folder: str, text: str) -> dict:
    """Write rows as JSON lines with a SHA-256 of each row's text; return their count and a digest over all of them.

    The digest is the sum of the rows' hashes, so that no order changes it and a row that stands twice counts twice.
    """
    h = F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8"), 256)
    out = df.withColumn("row_sha256", h)
    out.write.mode("overwrite").json(folder, ignoreNullFields=False)
    got = out.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("row_sha256", 1, 15), 16, 10).cast("decimal(38,0)")).alias("x")).first()
    return {"rows": got["n"], "digest": f"{int(got['x'] or 0):x}"}


def import_json(spark: SparkSession, folder: str, schema, text: str, *, wrapped: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows whose hash fits their text, and the others with the reason.

    Files hold an object a line, or, where ``wrapped`` names its field, one object with an array of rows.
    """
    fields = schema.simpleString()[7:-1] if hasattr(schema, "simpleString") else schema
    row = f"{fields}, row_sha256 string".replace(":", " ")
    if wrapped:
        one = spark.read.schema(f"`{wrapped}` array<struct<{row.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(folder)
        df = one.select(F.inline(wrapped)).withColumn("_broken", F.lit(None).cast("string"))
    else:
        df = spark.read.schema(f"{row}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(folder)
    ok = F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8"), 256) == F.col("row_sha256")
    why = F.when(F.col("_broken").isNotNull(), "unreadable").when(~F.coalesce(ok, F.lit(False)), "hash")
    df = df.withColumn("reason", why)
    return df.filter("reason is null").drop("reason", "_broken", "row_sha256"), df.filter("reason is not null")


def import_counts(accepted: DataFrame, rejected: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """(imported, skipped, errors): accepted rows that are new, accepted rows whose key is known, and the rejected ones."""
    new = accepted.join(known.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias("imported"))
    old = accepted.join(known.select(*keys).distinct(), keys, "left_semi").agg(F.count("*").alias("skipped"))
    return new.join(old).join(rejected.agg(F.count("*").alias("errors")))


def publish(df: DataFrame, root: str, generation: int, keep: int = 2) -> str:
    """Write a new generation beside the old ones, then move the pointer to it in one step; of the older ones the latest ``keep - 1`` stay."""
    store = Store(df.sparkSession, root)
    folder = f"{store.root}/gen={generation}"
    df.write.mode("overwrite").parquet(folder)
    store.write("CURRENT", {"generation": generation, "columns": sorted(df.columns), "rows": df.sparkSession.read.parquet(folder).count()})
    older = sorted((int(n[4:]) for n in store.names() if n.startswith("gen=") and n[4:].isdigit() and int(n[4:]) < generation), reverse=True)
    for n in older[keep - 1 :]:
        store.delete(f"gen={n}")
    return folder


def current(spark: SparkSession, root: str, columns: list[str] | None = None) -> DataFrame | None:
    """The published generation; None where there is none or it lacks a column, which is not the same as empty."""
    meta = Store(spark, root).read("CURRENT")
    if meta is None or (columns and not set(columns) <= set(meta["columns"])):
        return None
    return spark.read.parquet(f"{root.rstrip('/')}/gen={meta['generation']}")


def compact(spark: SparkSession, folder: str, target_bytes: int = 256 << 20) -> int:
    """Rewrite a folder's many small files as few of about ``target_bytes``; return how many there are then.

    The new files are written beside and take the folder's name when they are complete.
    """
    store = Store(spark, folder)
    size, _ = store.mark()
    n = max(1, -(-size // target_bytes))
    spark.read.parquet(folder).repartition(n).write.mode("overwrite").parquet(f"{store.root}.new")
    store.replace_by(f"{store.root}.new")
    return n


def with_columns(df: DataFrame, schema) -> DataFrame:
    """A table as a later schema has it: columns that are new to it come as null, kinds are cast, others stay."""
    have = set(df.columns)
    made = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*made, *[c for c in df.columns if c not in {f.name for f in schema.fields}])


def check_shape(columns: list[str], expected: list[str], fallback: list[str] = ()) -> tuple[str | None, list[str], str]:
    """(the column to read, warnings, signature): the first expected column there is, else a fallback with a warning; the signature is of what was declared."""
    signature = hashlib.sha256(",".join(sorted([*expected, *fallback])).encode()).hexdigest()[:16]
    for c in expected:
        if c in columns:
            return c, [], signature
    for c in fallback:
        if c in columns:
            return c, [f"the answer has changed: {c} in place of {expected[0]}"], signature
    return None, [f"none of {', '.join([*expected, *fallback])} in the answer"], signature


def read_archives(spark: SparkSession, folder: str, member: str = "content.xml", limit: int = 50 << 20) -> DataFrame:
    """(path, text, problem) of zipped XML documents: the text of all elements of one member, blocks on lines of their own.

    A broken archive, a missing member and one above ``limit`` bytes are rows with a problem, not faults of the whole.
    """

    def one(content: bytes) -> tuple[str | None, str | None]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                if z.getinfo(member).file_size > limit:
                    return None, "too large"
                root = ElementTree.fromstring(z.read(member))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
            return None, type(e).__name__
        lines = ["".join(e.itertext()).strip() for e in root.iter() if e.tag.split("}")[-1] in ("p", "paragraph", "h")]
        # a document without marked blocks keeps its inner text, whose line ends part the blocks
        return "\n".join(x for x in lines if x) or "".join(root.itertext()).strip(), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            got = [one(c) for c in x["content"]]
            yield pd.DataFrame({"path": x["path"], "text": [t for t, _ in got], "problem": [p for _, p in got]})

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(run, "path string, text string, problem string")


def read_pdfs(spark: SparkSession, folder: str, most: int = 2_000_000) -> DataFrame:
    """(path, text, problem) of the text layers; where no PDF library is installed every row has that problem."""

    def one(content: bytes) -> tuple[str | None, str | None]:
        try:
            from pypdf import PdfReader
        except ImportError:
            return None, "no library"
        try:
            text = "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)
        except Exception as e:  # noqa: BLE001  whatever a broken file raises
            return None, type(e).__name__
        return (text, None) if len(text) <= most else (None, "too large")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            got = [one(c) for c in x["content"]]
            yield pd.DataFrame({"path": x["path"], "text": [t for t, _ in got], "problem": [p for _, p in got]})

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(run, "path string, text string, problem string")


def upgrade_from_files(records: DataFrame, texts: DataFrame, keys: list[str], shortest: int = 50) -> DataFrame:
    """Records that only link to a file, with the text read from it: status, text, hash and a low confidence; where none was read nothing changes."""
    good = texts.filter(F.length(F.trim("text")) >= shortest).select(*keys, F.col("text").alias("_t"))
    j = records.join(good, keys, "left")
    up = (F.col("content_status") == "pdf_link_only") & F.col("_t").isNotNull()
    new = {"full_text": F.col("_t"), "content_hash": F.sha2(F.encode("_t", "utf-8"), 256), "content_status": F.lit("full_text"), "metadata_confidence": F.lit("low")}
    return j.withColumns({c: F.when(up, v).otherwise(F.col(c)) for c, v in new.items() if c in records.columns}).drop("_t")


def job_status(spark: SparkSession, folder: str, as_of: str, stale_hours: int = 48) -> DataFrame:
    """(path, state, last_line) of log files by their last lines: ok, failed, partial (begun, not ended) or stale (ended too long ago)."""
    log = spark.read.format("binaryFile").load(folder).select("path", F.col("modificationTime").alias("at"), F.decode("content", "utf-8").alias("t"))
    lines = F.filter(F.split("t", r"\r?\n"), lambda x: F.trim(x) != "")
    tail = F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 19), F.lit(20)), "\n")
    code = F.regexp_extract(tail, r"(?s).*\brc=(\d+)", 1)
    old = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("at") > stale_hours * 3600
    state = F.when((code != "") & (code != "0"), "failed").when(tail.rlike(r"(?i)traceback|error:"), "failed").when((code == "0") | tail.rlike(r"(?i)\b(done|finished|completed)\b"), F.when(old, "stale").otherwise("ok")).otherwise("partial")
    return log.select("path", state.alias("state"), F.element_at(lines, -1).alias("last_line"))


def parse_index(html: str | None) -> list[tuple[str, str | None, str, str]]:
    """(section, category, title, link) of a gazette's index page: headings name section and category, links the items, in either layout."""
    p = _Index()
    p.feed(html or "")
    p.close()
    return p.items


class _Index(HTMLParser):
    """Headings by tag or class, items by link; a title is the link's text without the dashes in front."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[tuple[str, str | None, str, str]] = []
        self.section, self.category, self.level, self.link, self.text = "", None, "", None, ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        kind = (a.get("class") or "").lower()
        if tag == "a" and a.get("href") and not a["href"].startswith("#"):
            self.link, self.text = a["href"], ""
        elif tag in ("h1", "h2") or "html-title" in kind or "bolum" in kind:
            self.level, self.text = "section", ""
        elif tag in ("h3", "h4", "b", "strong") or "html-subtitle" in kind or "kategori" in kind:
            self.level, self.text = "category", ""

    def handle_data(self, data: str) -> None:
        self.text += data

    def handle_endtag(self, tag: str) -> None:
        text = re.sub(r"^[\s–—-]+", "", re.sub(r"\s+", " ", self.text)).strip()
        if tag == "a" and self.link:
            if text:
                self.items.append((self.section, self.category, text, self.link))
            self.link, self.text = None, ""
        elif self.level and not self.link and text:
            if self.level == "section":
                self.section, self.category = text, None
            else:
                self.category = text
            self.level, self.text = "", ""


def decode_pages(spark: SparkSession, folder: str, charset: str = "windows-1254") -> DataFrame:
    """(path, text) of files of bytes; a charset named in the page's head wins over the default.

    The engine's own ``decode`` knows Unicode and Latin-1 only, so bytes are decoded in Arrow batches.
    """
    b = spark.read.format("binaryFile").load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"path": x["path"], "text": [_decode(c, charset) for c in x["content"]]})

    return b.mapInPandas(run, "path string, text string")


def _decode(content: bytes, charset: str) -> str:
    named = re.search(rb"charset\s*=\s*[\"']?([\w-]+)", content[:1024], re.IGNORECASE)
    try:
        return content.decode(named[1].decode() if named else charset, errors="replace")
    except LookupError:
        return content.decode(charset, errors="replace")


class ReplaySource(DataSource):
    """Feeds recorded as JSON lines, one partition per file: ``spark.read.format("replay")``.

    The interface of a live source without the network: options ``folder`` and ``fields``
    (a schema string).
    """

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return self.options.get("fields", "document_id string, text string")

    def reader(self, schema) -> DataSourceReader:
        return _Replay(self.options["folder"], [f.name for f in schema.fields])


class _Replay(DataSourceReader):
    def __init__(self, folder: str, names: list[str]) -> None:
        self.folder, self.names = folder, names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in sorted(os.listdir(self.folder)) if f.endswith(".jsonl")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(os.path.join(self.folder, partition.value), encoding="utf-8") as f:
            for line in f:
                row = json.loads(line)
                yield tuple(row.get(n) for n in self.names)
