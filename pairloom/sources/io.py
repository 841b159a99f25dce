"""Sources and sinks of records, with the guards that reject malformed ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pairloom.functions.text import looks_scanned
from pairloom.operators.staging import against_all
from pairloom.schemas import DOC_TYPES, DOCUMENT, PAIR, QUERY
from pairloom.sources import office, portable
from pairloom.sources.portable import MAX_PAGES


def _guard(ok: Column, message: Column | str) -> Column:
    """True, or an error when the row is read."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(text).cast("boolean"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed line is an error, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents with valid types and unique ids."""
    d = read_jsonl(spark, path, DOCUMENT)
    d = d.filter(_guard(F.col("doc_type").isin(*DOC_TYPES), F.concat(F.lit("doc_type must be cv or jd: "), F.coalesce("doc_type", F.lit("null")))))
    n = F.count("*").over(W.partitionBy("doc_id"))
    return d.withColumn("__n", n).filter(_guard(F.col("__n") == 1, F.concat(F.lit("duplicate doc_id: "), F.coalesce("doc_id", F.lit("null"))))).drop("__n")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, PAIR).filter(_guard(F.col("label").between(-1, 3), "label must be -1 to 3"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, QUERY).filter(_guard(F.size("cv_ids") == F.size("relevance"), "cv_ids and relevance differ in length"))


def build_queries(pairs: DataFrame, cvs: DataFrame, jds: DataFrame) -> DataFrame:
    """jd_id, cv_ids, relevance over the full grid, -1 where a pair has no label."""
    grid = against_all(cvs.select("cv_id"), jds.select("jd_id"), "jd_id").join(pairs, ["jd_id", "cv_id"], "left").withColumn("label", F.coalesce("label", F.lit(-1)))
    both = F.array_sort(F.collect_list(F.struct("cv_id", "label")))
    return grid.groupBy("jd_id").agg(both.alias("x")).select("jd_id", F.col("x.cv_id").alias("cv_ids"), F.col("x.label").alias("relevance"))


def read_text_dir(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's stem), text of the .txt and .md files of a folder; a stem that two files have is an error."""
    files = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.{txt,md}").load(path)
    d = files.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.(?:txt|md)$", 1).alias("doc_id"), F.col("value").alias("text"))
    return d.withColumn("__n", F.count("*").over(W.partitionBy("doc_id"))).filter(_guard(F.col("__n") == 1, F.concat(F.lit("duplicate stem: "), F.col("doc_id")))).drop("__n")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_raw(spark: SparkSession, path: str, layout: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(cvs, jds) from cvs.jsonl and jds.jsonl, or from the folders cv and jd; auto prefers the former."""
    if layout not in ("auto", "jsonl", "dir"):
        raise ValueError(f"unknown layout {layout!r}")
    if layout in ("auto", "jsonl") and exists(spark, f"{path}/cvs.jsonl"):
        return read_documents(spark, f"{path}/cvs.jsonl"), read_documents(spark, f"{path}/jds.jsonl")
    if layout in ("auto", "dir") and exists(spark, f"{path}/cv"):
        return read_text_dir(spark, f"{path}/cv"), read_text_dir(spark, f"{path}/jd")
    raise FileNotFoundError(f"no corpus under {path}")


def read_pair_csv(spark: SparkSession, path: str) -> DataFrame:
    """jd_id, cv_id, grade of a CSV (job_description_text, resume_text, label): ids number the distinct texts by first row."""
    grades = F.create_map(*[F.lit(x) for x in ("No Fit", 0, "Potential Fit", 1, "Good Fit", 2)])
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).withColumn("ord", F.monotonically_increasing_id())

    def ids(col: str, name: str) -> DataFrame:
        first = rows.groupBy(col).agg(F.min("ord").alias("o"))
        return first.select(col, F.row_number().over(W.orderBy("o")).alias(name))

    out = rows.join(ids("job_description_text", "jd_id"), "job_description_text").join(ids("resume_text", "cv_id"), "resume_text")
    return out.select("jd_id", "cv_id", grades[F.col("label")].alias("grade"), "job_description_text", "resume_text")


#: Ids that a query to a database may list; beyond it the ids meet the table in Spark.
LISTED = 1000


def read_table(spark: SparkSession, url: str, table: str, ids: DataFrame | None = None, key: str = "id", parts: int = 1, columns: list[str] | None = None, **options) -> DataFrame:
    """A database table by JDBC. With ``parts`` it is read in so many ranges of the (whole-number) key, whose ends the database is asked for
    first; rows without a key are in the first range. Columns are chosen there; up to ``LISTED`` ids are listed in the question that
    the database gets, more are met by a semi join."""
    given = {"url": url, **options}
    if parts > 1:
        quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
        ends = spark.read.format("jdbc").options(query=f"select min({quoted}) as lo, max({quoted}) as hi from {table}", **given).load().first()
        if ends[0] is not None:
            given |= {"partitionColumn": key, "lowerBound": str(int(ends[0])), "upperBound": str(int(ends[1]) + 1), "numPartitions": str(parts)}
    t = spark.read.format("jdbc").options(dbtable=table, **given).load()
    if ids is not None:
        few = [r[0] for r in ids.select(key).distinct().limit(LISTED + 1).collect()]
        t = t.filter(F.col(key).isin(few)) if len(few) <= LISTED else t.join(ids.select(key).distinct(), key, "left_semi")
    return t.select(*columns) if columns else t


def inspect(spark: SparkSession, tables: list[str]) -> DataFrame:
    """table, columns, rows of registered tables or views."""
    rows = [(t, [c.name for c in spark.catalog.listColumns(t)], spark.table(t).count()) for t in tables]
    return spark.createDataFrame(rows, "table string, columns array<string>, rows long")


def columns_of(spark: SparkSession, tables: list[str]) -> DataFrame:
    """table, column (lower case) of registered tables or views, of which a reader picks what there is."""
    rows = [(t.lower(), c.name.lower()) for t in tables for c in spark.catalog.listColumns(t)]
    return spark.createDataFrame(rows, "table string, column string")


def picked(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns (name to type) of a table, whatever their case; those that it lacks are null."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[c.lower()]}`") if c.lower() in have else F.lit(None)).cast(kind).alias(c) for c, kind in wanted.items()])


def export_jobs(jobs: DataFrame, skip: tuple[str, ...] = ("DRAFT", "CANCELLED")) -> DataFrame:
    """Jobs that are not deleted, have a description and are in no skipped status, by id."""
    return jobs.filter(F.col("deletedAt").isNull() & (F.trim("description") != "") & ~F.col("status").isin(*skip)).orderBy("id")


def export_profiles(profiles: DataFrame, payloads: DataFrame, structured: DataFrame, legacy: DataFrame) -> DataFrame:
    """id, source, content: the latest confirmed payload, else the structured tables, else the legacy arrays.
    payloads: id, payload, status, createdAt. structured and legacy: id, content."""
    latest = payloads.filter("status = 'CONFIRMED'").groupBy("id").agg(F.max_by("payload", "createdAt").alias("p"))
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    j = profiles.select("id").join(latest, "id", "left").join(structured.select("id", F.col("content").alias("s")), "id", "left").join(legacy.select("id", F.col("content").alias("l")), "id", "left")
    kind = F.when(some(F.col("p")).isNotNull(), "payload").when(some(F.col("s")).isNotNull(), "structured").when(some(F.col("l")).isNotNull(), "legacy")
    return j.select("id", kind.alias("source"), F.coalesce(some(F.col("p")), some(F.col("s")), some(F.col("l"))).alias("content")).filter("source is not null")


def write_manifest(docs: DataFrame, kind: str, path: str) -> None:
    """Which row of a source each document (doc_id, id, note) comes from, as JSON lines."""
    docs.select("doc_id", F.concat_ws(":", F.lit(kind), F.col("id").cast("string")).alias("source"), "note").write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, "doc_id string, source string, note string")


def classify_upload(content: Column) -> Column:
    """pdf, doc, zip or null by the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("D0CF11E0A1B11AE1"), "doc").when(head.startswith("504B0304"), "zip")


def is_docx(content: Column) -> Column:
    """Whether a zip holds the main part of a word-processing document."""

    @F.pandas_udf("boolean")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(office.holds_document)

    return udf(content)


def extracted(content: Column, kind: Column, max_pages: int = MAX_PAGES) -> Column:
    """struct<text, pages, warnings, error> of files of kind pdf, docx, doc or text.

    The pages of a PDF (at most ``max_pages``) are parted by form feeds; ``pages`` counts those read and is 0 for other kinds. Warnings:
    ``OCR_LOW_QUALITY`` if the pages look scanned, ``TRUNCATED`` if there are more. An encrypted file gives the error ``encrypted``, any
    other that cannot be read ``invalid``, as do null content and unknown kinds; the text is then null.
    """

    @F.pandas_udf("text string, chars array<long>, total long, error string")
    def udf(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
        def one(b: bytes | None, k: str | None) -> tuple:
            try:
                if b is None or k not in ("pdf", "docx", "doc", "text"):
                    raise portable.Refused("invalid")
                if k == "pdf":
                    pages, total = portable.pdf_pages(b, max_pages)
                    return "\f".join(pages), [len(p) for p in pages], total, None
                return {"docx": office.docx_text, "doc": office.doc_text, "text": lambda x: x.decode("utf-8", "replace")}[k](b), [], 0, None
            except portable.Refused as e:
                return None, [], 0, str(e)

        return pd.DataFrame([one(b, k) for b, k in zip(content, kind, strict=True)], columns=["text", "chars", "total", "error"])

    def told(x: Column) -> Column:
        paged = x["total"] > 0
        warnings = F.array(F.when(paged & looks_scanned(x["chars"]), "OCR_LOW_QUALITY"), F.when(x["total"] > max_pages, "TRUNCATED"))
        return F.struct(x["text"].alias("text"), F.least(x["total"], F.lit(max_pages)).cast("int").alias("pages"), F.array_compact(warnings).alias("warnings"), x["error"].alias("error"))

    return F.get(F.transform(F.array(udf(content, kind)), told), F.lit(0))


def read_uploads(spark: SparkSession, path: str, max_pages: int = MAX_PAGES) -> DataFrame:
    """path, kind, text, pages, warnings, error of uploaded files: PDF, docx, legacy doc and plain text, told apart by their first bytes
    (plain text by its name). Spark lists no files of no bytes, so these have no row."""
    files = spark.read.format("binaryFile").load(path)
    kind = F.when(classify_upload(F.col("content")) == "zip", F.when(is_docx(F.col("content")), "docx")).otherwise(classify_upload(F.col("content")))
    f = files.select("path", "content", F.coalesce(kind, F.when(F.col("path").rlike(r"\.(txt|md)$"), "text")).alias("kind"))
    return f.withColumn("x", extracted(F.col("content"), F.col("kind"), max_pages)).select("path", "kind", "x.*")


def append_results(results: DataFrame, path: str, on: list[str]) -> None:
    """Append what the sink does not hold yet, so that a stopped run goes on where it was."""
    spark = results.sparkSession
    if exists(spark, path):
        results = results.join(spark.read.parquet(path).select(*on).distinct(), on, "left_anti")
    results.write.mode("append").parquet(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small aggregated table as Markdown."""
    rows = df.limit(most).collect()
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return head + "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in rows)


def latex(df: DataFrame, most: int = 1000) -> str:
    """A small aggregated table as a LaTeX tabular."""
    rows = df.limit(most).collect()
    line = lambda cells: " & ".join("" if c is None else str(c).replace("_", r"\_") for c in cells) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", line(df.columns), r"\hline", *map(line, rows), r"\end{tabular}"])
