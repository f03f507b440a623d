"""Sources and sinks in files."""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.records import IDS, cleaned, first_given, flattened, indexed, source_id

CUSTOMER = (
    "crid string, name string, first_name string, last_name string, address string, city string, state string, zip string, "
    "customer_type string, status string, move_count int, last_move date, created_date date, "
    "move_history array<struct<from_address:string,to_address:string,city:string,state:string,zip:string,move_date:date>>, "
    "related_crid string, relationship_type string, business_name string, branch_count int"
)
#: Spellings of the parts of a raw address, in the order they are joined.
LINE_PARTS = (
    ("address", "street", "street_address", "address1", "address_line_1", "addr"),
    ("street2", "address2", "address_line_2", "unit", "apt"),
    ("city", "town"),
    ("state", "province", "st"),
    ("zip", "zip_code", "zipcode", "postal_code"),
)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files of a folder, or of the file itself."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def customers(spark: SparkSession, path: str) -> DataFrame:
    """Customers from JSON arrays; a missing path is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], CUSTOMER)
    return spark.read.schema(CUSTOMER).json(path, multiLine=True)


def export(spark: SparkSession, path: str) -> DataFrame:
    """An address export: an array, or an object with one under addresses, data or records.

    The id is the first of address_id, id and crid, else ADDR- and the row's number;
    ids of rows without one follow the order of their content.
    """
    raw = spark.read.json(path, multiLine=True)
    for name in ("addresses", "data", "records"):
        if name in raw.columns:
            raw = raw.select(F.explode(name).alias("r")).select("r.*")
            break
    rows = raw.select(
        first_given(raw, ("address_id", "id", "crid")).alias("id"),
        first_given(raw, ("address", "street", "street_address")).alias("address"),
        first_given(raw, ("city",)).alias("city"),
        F.upper(first_given(raw, ("state",))).alias("state"),
        first_given(raw, ("zip", "zip_code", "zipcode")).alias("zip"),
    )
    given, none = rows.where("id is not null"), rows.where("id is null")
    numbered = indexed(none, ["state", "city", "address", "zip"])
    made = numbered.withColumn("id", F.format_string("ADDR-%06d", F.col("row_no"))).drop("row_no")
    return given.unionByName(made.select(*given.columns))


def delimiter(spark: SparkSession, path: str) -> str:
    """The most frequent of comma, tab, bar and semicolon in the first kilobyte."""
    head = spark.read.text(path).limit(20).collect()
    sample = "\n".join(r["value"] for r in head)[:1024]
    return max((",", "\t", "|", ";"), key=lambda c: (sample.count(c), -",\t|;".index(c)))


def delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Delimited text with a header: names and values cleaned; every column is a string."""
    return cleaned(spark.read.csv(path, header=True, sep=sep or delimiter(spark, path), multiLine=True, escape='"'))


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array or lines of JSON, flattened to three levels; bad lines are dropped."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    array = bool(first) and first[0]["value"].lstrip().startswith("[")
    df = spark.read.json(path, multiLine=array, mode="DROPMALFORMED")
    return cleaned(flattened(df))


def text_blocks(spark: SparkSession, path: str, by: str = "paragraph", size: int = 1000) -> DataFrame:
    """Blocks of text files: paragraphs, lines or stretches of ``size`` characters.

    Empty blocks are dropped, but count in the row number.
    """
    t = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    if by == "block":
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length("value") - 1) / size), F.lit(0))), lambda i: F.substring(F.col("value"), (i * size + 1).cast("int"), F.lit(size)))
    else:
        cut = F.split("value", r"\n\s*\n" if by == "paragraph" else "\n")
    return t.select("path", F.posexplode(cut).alias("row_no", "text")).select("path", (F.col("row_no") + 1).alias("row_no"), F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("text")).where("text <> ''")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors of binary files: dimension (u32) and count (u64), then length (u16), id and floats of each, little-endian."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                dim, n = struct.unpack_from("<IQ", data, 0)
                at, rows = 12, []
                for _ in range(n):
                    (k,) = struct.unpack_from("<H", data, at)
                    name = data[at + 2 : at + 2 + k].decode()
                    at += 2 + k
                    rows.append((name, list(struct.unpack_from(f"<{dim}f", data, at))))
                    at += 4 * dim
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows, columns=["source_id", "embedding"])
                        rows = []
                yield pd.DataFrame(rows, columns=["source_id", "embedding"])

    if any(f.endswith(".txt") for f in names(spark, path)):  # packed vectors as lines, in parts that can be read apart
        content = spark.read.text(path).select(F.unbase64("value").alias("content"))
    else:
        content = spark.read.format("binaryFile").load(path).select("content")
    return content.mapInPandas(run, "source_id string, embedding array<float>")


def pack_vectors(rows: list[tuple[str, list[float]]]) -> bytes:
    """The binary form that ``vectors`` reads."""
    dim = len(rows[0][1]) if rows else 0
    out = struct.pack("<IQ", dim, len(rows))
    for name, v in rows:
        raw = name.encode()
        out += struct.pack("<H", len(raw)) + raw + struct.pack(f"<{dim}f", *v)
    return out


def write_vectors(df: DataFrame, path: str) -> None:
    """(source_id, embedding) in the binary form, a file a partition; the folder is replaced.

    Every task packs its rows in parts of 100,000 and writes them through the file system of Spark.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, list[float]]] = []
        for b in batches:
            held += zip(b["source_id"], b["embedding"])
            while len(held) >= 100_000:
                yield pd.DataFrame({"value": [base64.b64encode(pack_vectors(held[:100_000])).decode()]})
                held = held[100_000:]
        if held:
            yield pd.DataFrame({"value": [base64.b64encode(pack_vectors(held)).decode()]})

    df.select("source_id", "embedding").mapInPandas(pack, "value string").write.mode("overwrite").text(path)


def address_batch(df: DataFrame, embeddings: DataFrame | None = None, after: str | None = None) -> DataFrame:
    """Records to ingest: source_id, raw_address and the row itself as JSON.

    ``embeddings`` (source_id, embedding) are attached where there are any.  With
    ``after`` only ids greater than it are kept, to go on after a checkpoint.
    """
    df = cleaned(df)
    line = F.concat_ws(", ", *[first_given(df, names) for names in LINE_PARTS])
    out = df.select(source_id(df, IDS).alias("source_id"), line.alias("raw_address"), F.to_json(F.struct(*sorted(df.columns))).alias("raw_data"))
    if after is not None:
        out = out.where(F.col("source_id") > after)
    return out.join(embeddings, "source_id", "left") if embeddings is not None else out


def _needs(module: str) -> Callable[[SparkSession, str], DataFrame]:
    def read(spark: SparkSession, path: str) -> DataFrame:
        raise NotImplementedError(f"reading {PurePosixPath(path).suffix} files needs the package {module}")

    return read


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".csv": delimited,
    ".tsv": lambda s, p: delimited(s, p, "\t"),
    ".json": json_records,
    ".jsonl": json_records,
    ".ndjson": json_records,
    ".txt": text_blocks,
    ".md": text_blocks,
    ".parquet": lambda s, p: s.read.parquet(p),
    ".orc": lambda s, p: s.read.orc(p),
    ".vec": vectors,
    ".xlsx": _needs("openpyxl"),
    ".pdf": _needs("pypdf"),
    ".docx": _needs("python-docx"),
}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Read a file by the suffix of its name."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in READERS:
        raise ValueError(f"no reader for {suffix or 'a name without suffix'}; there are {', '.join(READERS)}")
    return READERS[suffix](spark, path)


def first_source(spark: SparkSession, sources: list[tuple[str, str, Callable[[SparkSession, str], DataFrame]]]) -> tuple[str, DataFrame]:
    """The name and rows of the first source (name, path, reader) whose path is there."""
    for name, path, reader in sources:
        if exists(spark, path):
            return name, reader(spark, path)
    raise FileNotFoundError("none of the sources is there")


def from_callable(spark: SparkSession, fetch: Callable[[], list[dict]], schema: str) -> DataFrame:
    """Rows of a service, fetched by the caller's own function."""
    return spark.createDataFrame(fetch(), schema)


def query_text(spark: SparkSession, text: str, params: dict | None = None, **tables: DataFrame) -> DataFrame:
    """SQL text with named parameters over the given tables."""
    return spark.sql(text, args=params or {}, **tables)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header of all columns in sorted order; nested ones as JSON."""
    flat = flattened(df)
    flat.select(*sorted(flat.columns)).write.mode("overwrite").csv(path, header=True)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, partitioned if wanted, so that filters on these columns prune folders."""
    w = df.repartition(*by).write.partitionBy(*by) if by else df.write
    w.mode("overwrite").parquet(path)
