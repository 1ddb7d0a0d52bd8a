"""Flat tables: fixed schemas, unions with provenance, listings, safe writes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "qc_1s": "recording string, window_id int, start_sample bigint, start_time_sec double, end_time_sec double, bad boolean, rejection_reason string",
    "artifact_mask_10s": "recording string, window_idx_10s int, start_sec double, end_sec double, bad_overlap_sec double, mask_10s int",
    "blink_events": "recording string, start_time double, end_time double, duration double",
    "saccades": "recording string, saccade_onset_t double, fixation_t double, start_x double, start_y double, end_x double, end_y double",
    "signal": "recording string, channel string, sample_idx bigint, t double, value double",
    "windowed_power": "recording string, band string, channel string, window_idx int, center_sec double, value double",
    "channel_meta": "patient string, label string, DK_Atlas string, Y7_Atlas string, Y17_Atlas string, AparcAseg_Atlas string, network string, "
    "Y7_code string, Y17_code string, Good int, Bad int, SOZ int, Spikey int, Out int, WMvsGM string, hem string, sEEG_ECoG string",
    "attention_labels": "recording string, time_idx int, group_deviation_mahal double, group_dev_mahal_z double, mahal_time_z double, PC1_z double, "
    "scheme string, thr_int double, thr_ext double, label string",
    "stimulus_log": "time_s double, modality string, condition string, stimulus string, event string, raw_line string",
    "contact_coords": "pat_base string, electrode string, hem string, x double, y double, z double",
}


def schema_of(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A CSV table under its fixed schema; nothing is inferred from the data."""
    return spark.read.schema(SCHEMAS[name]).option("header", True).option("nanValue", "nan").csv(path)


def check_schema(df: DataFrame, name: str) -> DataFrame:
    want = {f.name: f.dataType.simpleString() for f in schema_of(name)}
    have = dict(df.dtypes)
    wrong = {c: (t, have.get(c)) for c, t in want.items() if have.get(c) != t}
    if wrong:
        raise ValueError(f"{name}: columns differ (wanted, found): {wrong}")
    return df.select(*want)


def standardise(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Rename columns by alias, ignoring case and outer blanks; two columns
    claiming one name are an error."""
    known = {a.strip().lower(): name for name, many in aliases.items() for a in [name, *many]}
    found = {c: known[c.strip().lower()] for c in df.columns if c.strip().lower() in known}
    if len(set(found.values())) < len(found):
        raise ValueError(f"several columns map to one name: {found}")
    return df.withColumnsRenamed(found)


def find_column(df: DataFrame, *names: str) -> str:
    """The one column matching any of the names, ignoring case."""
    want = {n.lower() for n in names}
    hits = [c for c in df.columns if c.strip().lower() in want]
    if len(hits) != 1:
        raise ValueError(f"{names}: found {hits}")
    return hits[0]


def read_many(spark: SparkSession, groups: dict[str, str], aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Union of CSV sets with their tag and file of origin. Columns are matched
    by name in every file, absent ones are null.

    A reader binds the columns of all files by the first one's header, so files
    are grouped by their own header line and each group is one read."""
    parts = []
    for tag, glob in groups.items():
        lines = spark.read.text(glob).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"), "value")
        heads = lines.where("b = 0").groupBy("file").agg(F.min_by("value", "m").alias("head"))
        # As many rows as the driver's own listing of the folder.
        for row in heads.groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("head").collect():
            d = spark.read.option("header", True).csv(row["files"])
            d = standardise(d, aliases) if aliases else d
            parts.append(d.select("*", F.col("_metadata.file_name").alias("source_csv"), F.lit(tag).alias("tag")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def list_inputs(spark: SparkSession, root: str, fields: dict[str, str], suffix: str = "*") -> DataFrame:
    """Files under root as keys parsed from their path: fields maps a column to
    a regular expression with one group. Contents are not read; '._' copies
    are skipped."""
    d = (
        spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", True).load(root)
        .select("path", "modificationTime", "length")
    )
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    d = d.withColumn("file_name", name).filter(~F.col("file_name").startswith("._"))
    hit = {c: F.regexp_extract("path", rx, 1) for c, rx in fields.items()}
    return d.withColumns({c: F.when(h != "", h) for c, h in hit.items()})


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _replace(spark: SparkSession, new: str, path: str) -> None:
    """Put a finished table in the place of another, which stays until then."""
    jvm = spark._jvm.org.apache.hadoop.fs
    old = f"{path}.old-{uuid.uuid4().hex}"
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(jvm.Path(path))
    if had and not fs.rename(jvm.Path(path), jvm.Path(old)):
        raise OSError(f"cannot move {path}")
    if not fs.rename(jvm.Path(new), jvm.Path(path)):
        if had:
            fs.rename(jvm.Path(old), jvm.Path(path))
        raise OSError(f"cannot move {new}")
    if had:
        fs.delete(jvm.Path(old), True)


def write_once(df: DataFrame, path: str, overwrite: bool = False, partition_by: list[str] | None = None) -> bool:
    """Write unless a finished table is there (it has its _SUCCESS mark).
    Output is written beside and moved into place when the job has committed,
    so a failed job leaves the table that was there. Returns whether it wrote."""
    spark = df.sparkSession
    if not overwrite and _exists(spark, f"{path}/_SUCCESS"):
        return False
    new = f"{path}.new-{uuid.uuid4().hex}"
    df.write.partitionBy(*(partition_by or [])).parquet(new)
    _replace(spark, new, path)
    return True


def write_signal(df: DataFrame, path: str, provenance: dict[str, str], partition_by: list[str], sort_by: list[str],
                 overwrite: bool = False) -> bool:
    """Columnar store of a signal-like table: partitioned by recording, sorted
    by channel and sample so that row groups skip. Provenance goes along as
    columns, which dictionary encoding makes nearly free. Many tasks write one
    partition value: rows are spread by a hash of their sample block too."""
    d = df.withColumns({f"prov_{k}": F.lit(v) for k, v in provenance.items()})
    block = F.floor(F.col(sort_by[-1]) / 1_000_000)
    d = d.repartition(*[F.col(c) for c in partition_by], block).sortWithinPartitions(*partition_by, *sort_by)
    return write_once(d, path, overwrite, partition_by)


def read_signal(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The stored table without its provenance columns."""
    d = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    return d.drop(*[c for c in d.columns if c.startswith("prov_")])


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.parquet(path)
    return d.select(*[F.col(c).alias(c[5:]) for c in d.columns if c.startswith("prov_")]).distinct()


def keep_annotations(fresh: DataFrame, existing: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A rescan that keeps what people wrote: annotated cells of the existing
    table win over the fresh blanks."""
    old = existing.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    d = fresh.join(old, keys, "left")
    return d.withColumns({c: F.when(F.trim(F.col(f"__{c}")) != "", F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).drop(
        *[f"__{c}" for c in columns])


def write_coverage(df: DataFrame, path: str, decision: str = "include") -> str:
    """Write the coverage table. Where the one there holds decisions, write the
    first sibling `<path>_rescan`, `<path>_rescan2`, ... that holds none.
    Returns the path written."""
    spark = df.sparkSession
    filled = ~F.trim(F.coalesce(F.col(decision).cast("string"), F.lit(""))).isin("", "nan", "None")
    to, n = path, 0
    while _exists(spark, f"{to}/_SUCCESS") and not spark.read.parquet(to).filter(filled).isEmpty():
        n += 1
        to = f"{path}_rescan{n if n > 1 else ''}"
    write_once(df, to, overwrite=True)
    return to


def truthy(col: Column) -> Column:
    return F.lower(F.trim(col.cast("string"))).isin("1", "true", "yes", "y")
