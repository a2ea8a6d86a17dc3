"""Sources and sinks for filings: nested JSON, line JSON, binary pages, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.keys import accession_key

#: Field names of public company-fact and listing files.
_FACT = "struct<start: date, end: date, val: decimal(38,6), accn: string, fy: int, fp: string, form: string, filed: date>"
FACTS = f"cik bigint, facts map<string, map<string, struct<label: string, units: map<string, array<{_FACT}>>>>>"
SUBMISSIONS = "filings struct<recent: struct<accessionNumber: array<string>, form: array<string>, filingDate: array<string>, reportDate: array<string>, primaryDocument: array<string>>>"


def company_facts(spark: SparkSession, path: str) -> DataFrame:
    """One row per fact of company-fact files, taxonomy by concept by unit; amounts are read as decimals, never as floats."""
    raw = spark.read.schema(FACTS).option("multiLine", True).json(path)
    by_taxonomy = raw.select("cik", F.explode("facts").alias("taxonomy", "concepts"))
    by_concept = by_taxonomy.select("cik", "taxonomy", F.explode("concepts").alias("name", "c"))
    by_unit = by_concept.select("cik", F.concat_ws(":", "taxonomy", "name").alias("concept"), F.col("c.label").alias("label"), F.explode("c.units").alias("unit", "facts"))
    return by_unit.select("cik", "concept", "label", "unit", F.explode("facts").alias("f")).select(
        F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"), F.col("f.accn").alias("accession"), "concept", "label", F.col("f.val").alias("value"), "unit",
        F.col("f.start").alias("period_start"), F.col("f.end").alias("period_end"), F.col("f.fy").alias("fiscal_year"), F.col("f.fp").alias("fiscal_period"), F.col("f.form").alias("form_type"),
    )


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """One row per filing of column-wise listings; pages that lack a column give nulls. Several files are one listing."""
    r = spark.read.schema(SUBMISSIONS).option("multiLine", True).json(path).select("filings.recent.*")
    none = F.array().cast("array<string>")
    columns = [F.coalesce(c, none).alias(c) for c in ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument")]
    return r.select(*columns).select(F.explode(F.arrays_zip("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument")).alias("f")).select(
        F.col("f.accessionNumber").alias("accession"), F.col("f.form").alias("form_type"), F.col("f.filingDate").try_cast("date").alias("filing_date"),
        F.col("f.reportDate").try_cast("date").alias("period_end"), F.col("f.primaryDocument").alias("document"),
    )


def selected(listed: DataFrame, forms: list[str], since: str) -> DataFrame:
    """Filings of the forms from a day on that have a period; the condition reaches the scan."""
    return listed.filter(F.col("form_type").isin(forms) & (F.col("filing_date") >= F.lit(since).cast("date")) & F.col("period_end").isNotNull())


def selection_counts(listed: DataFrame, forms: list[str], since: str) -> DataFrame:
    """One row: filings listed, of other forms, too early, without a period, and selected."""
    form, early = F.col("form_type").isin(forms), F.coalesce(F.col("filing_date") < F.lit(since).cast("date"), F.lit(True))
    return listed.agg(
        F.count("*").alias("listed"), F.count_if(~F.coalesce(form, F.lit(False))).alias("other_form"), F.count_if(form & early).alias("early"),
        F.count_if(form & ~early & F.col("period_end").isNull()).alias("no_period"), F.count_if(form & ~early & F.col("period_end").isNotNull()).alias("selected"),
    )


def exactly(listed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Filings of the wanted accessions; the query fails if one is not listed or, where wanted names forms, of another form, as nothing may stand in for it."""
    w = wanted.select(accession_key("accession").alias("_key")).distinct()
    if "form_type" in wanted.columns:
        w = wanted.select(accession_key("accession").alias("_key"), F.col("form_type").alias("_form")).distinct()
    found = w.join(listed.withColumn("_key", accession_key("accession")), "_key", "left")
    wrong = F.col("accession").isNull()
    out = found.withColumn("accession", F.when(wrong, F.raise_error(F.concat(F.lit("not listed: "), "_key"))).otherwise(F.col("accession")))
    if "_form" in out.columns:
        other = ~F.col("_form").eqNullSafe(F.col("form_type"))
        out = out.withColumn("form_type", F.when(other, F.raise_error(F.concat(F.lit("another form: "), "_key"))).otherwise(F.col("form_type"))).drop("_form")
    return out.drop("_key")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Files with path, text and the hash of their bytes."""
    b = spark.read.format("binaryFile").load(path)
    return b.select("path", F.decode("content", "UTF-8").alias("html"), F.sha2("content", 256).alias("content_hash"), F.length("content").alias("bytes"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of line JSON by a given schema, which may be nested; blank lines are no records."""
    rows = spark.read.schema(schema).json(path)
    some = F.lit(False)
    for name in rows.columns:
        some = some | F.col(f"`{name}`").isNotNull()
    return rows.filter(some)


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of CSV with a header by a given schema; a malformed row is an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def settings(text: str) -> dict:
    """Settings of the form key: value with indented blocks and lists of "- item", as configuration files use them.

    Values are whole numbers, numbers, true, false, null, quoted or plain text. Anything else is an error.
    """
    import json

    def value(x: str):
        x = x.strip()
        if x in ("", "null", "~"):
            return None
        if x[0] in "[{\"":
            return json.loads(x)
        if x[0] == "'":
            return x[1:-1]
        if x in ("true", "false"):
            return x == "true"
        for kind in (int, float):
            try:
                return kind(x)
            except ValueError:
                pass
        return x

    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#")]

    def block(at: int, depth: int):
        out: dict | list = [] if at < len(lines) and lines[at][1].startswith("- ") else {}
        while at < len(lines) and lines[at][0] == depth:
            line = lines[at][1]
            if isinstance(out, list):
                if not line.startswith("- "):
                    raise ValueError(line)
                out.append(value(line[2:]))
                at += 1
                continue
            name, colon, rest = line.partition(":")
            if not colon:
                raise ValueError(line)
            rest = rest.split(" #")[0].strip()
            if rest or at + 1 == len(lines) or lines[at + 1][0] <= depth:
                out[name.strip()], at = value(rest), at + 1
            else:
                out[name.strip()], at = block(at + 1, lines[at + 1][0])
        if at < len(lines) and lines[at][0] > depth:
            raise ValueError(lines[at][1])
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def save_texts(texts: DataFrame, path: str) -> DataFrame:
    """key, text and its sha256 as Parquet, written as a whole or not at all; gives the hashes."""
    out = texts.select("key", "text", F.sha2("text", 256).alias("text_hash"))
    out.write.mode("overwrite").parquet(path)
    return texts.sparkSession.read.parquet(path).select("key", "text_hash")


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def save_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Tables as Parquet with a manifest of their content hashes."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    manifest(spark, list(tables), path).write.mode("overwrite").json(f"{path}/_manifest")


def content_key(df: DataFrame) -> DataFrame:
    """One row: rows and a sha256 of the content that does not depend on the order of rows.

    The sha256 of each row is added up in four parts as whole numbers, and the sums are hashed again, so
    rows that are there twice count twice and nothing is sorted.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in range(4)]
    return df.select(row.alias("h")).agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(",", *parts), 256).alias("content_hash"))


def manifest(spark: SparkSession, names: list[str], path: str) -> DataFrame:
    out = None
    for name in names:
        one = content_key(spark.read.parquet(f"{path}/{name}")).withColumn("table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def verified_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Tables of a snapshot with whether their content is that of the manifest; one that is missing is reported so."""
    said = spark.read.schema("rows bigint, content_hash string, `table` string").json(f"{path}/_manifest")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [r["table"] for r in said.select("table").collect() if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{r['table']}"))]
    same = (F.col("a.rows") == F.col("b.rows")) & (F.col("a.content_hash") == F.col("b.content_hash"))
    if not there:
        return said.select("table", F.lit(False).alias("same"), F.lit("missing").alias("state"))
    now = manifest(spark, there, path)
    state = F.when(F.col("b.rows").isNull(), "missing").when(same, "same").otherwise("changed")
    return said.alias("a").join(now.alias("b"), "table", "left").select("table", F.coalesce(same, F.lit(False)).alias("same"), state.alias("state"))


def restored(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a snapshot, which must be those of its manifest; a changed or missing one is an error."""
    bad = [r["table"] for r in verified_snapshot(spark, path).filter("not same").collect()]
    if bad:
        raise ValueError(f"not as in the manifest: {sorted(bad)}")
    names = [r["table"] for r in spark.read.schema("`table` string").json(f"{path}/_manifest").collect()]
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
