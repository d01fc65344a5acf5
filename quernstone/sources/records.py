"""Readers and writers of corpora, rule-independent."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "id string, text string, label int, source string, source_split string, license string, tier int"


@dataclass(frozen=True)
class Source:
    """Where rows come from and how their fields are named."""

    name: str
    tier: int = 1
    license: str = ""
    text: str = "text"
    label: str = "label"
    labels: dict[str, int] = field(default_factory=lambda: {"0": 0, "1": 1})
    splits: tuple[str, ...] = ("train",)
    path: str | None = None
    format: str = "json"


def registry(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """The sources as a table; only those of tier 1 are ever read."""
    return spark.createDataFrame([(s.name, s.tier, s.license, s.format, s.tier == 1) for s in sources], "name string, tier int, license string, format string, read boolean")


def decoded_label(raw: Column, labels: dict[str, int]) -> Column:
    """The label a raw value stands for; an unknown value raises an error, null stays null."""
    table = F.create_map(*[F.lit(x) for k, v in labels.items() for x in (k, v)])
    found = F.try_element_at(table, raw.cast("string"))
    return F.when(raw.isNull(), F.lit(None).cast("int")).when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown label "), raw.cast("string"))).cast("int"))


def read_jsonl(spark: SparkSession, path: str, schema: str = ROW) -> DataFrame:
    """Lines of JSON under a declared schema; blank lines are skipped and broken ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def location(source: Source, mirror: str | None = None) -> str:
    """The folder of a source: its own path, or the folder of its name in a mirror of remote sources."""
    if source.path is not None:
        return source.path
    if mirror is None:
        raise ValueError(f"{source.name} is remote and no mirror is given")
    return f"{mirror.rstrip('/')}/{source.name}"


def read_sources(spark: SparkSession, sources: list[Source], mirror: str | None = None, key: str = "key") -> DataFrame:
    """Rows of all sources of tier 1, local and remote; the others are never read."""
    return reduce(DataFrame.unionByName, [read_source(spark, s, key, mirror) for s in sources if s.tier == 1])


def read_source(spark: SparkSession, source: Source, key: str = "key", mirror: str | None = None) -> DataFrame:
    """Rows of one source, one pass per split; ids are source:split:key of a stable key column."""
    if source.tier != 1:
        raise ValueError(f"{source.name} is gated and is not read")
    parts = []
    for split in source.splits:
        raw = spark.read.format(source.format).load(f"{location(source, mirror)}/{split}")
        made_id = F.concat_ws(":", F.lit(source.name), F.lit(split), F.col(key).cast("string"))
        parts.append(raw.select(made_id.alias("id"), F.col(source.text).alias("text"), decoded_label(F.col(source.label), source.labels).alias("label"), F.lit(source.name).alias("source"), F.lit(split).alias("source_split"), F.lit(source.license).alias("license"), F.lit(source.tier).alias("tier")))
    return reduce(DataFrame.unionByName, parts)


PAYLOAD = "prompt string, label int, lang string, channel string, turns int, meta struct<tier:int,weight:double,reviewer:string>"


def parsed_payloads(raw: DataFrame) -> DataFrame:
    """Fields of JSON payloads; broken and null ones are left out."""
    return raw.select("id", "source", F.from_json("payload", PAYLOAD).alias("p")).where("p.prompt IS NOT NULL").select("id", "source", "p.prompt", "p.label", "p.lang", "p.channel", F.col("p.meta.tier").alias("tier"))


def write_partition(rows: DataFrame, path: str) -> None:
    """Sorted JSON lines without the family, ranges of ids a file."""
    rows.select("id", "text", "label", "source", "source_split", "license", "tier").orderBy("id").write.mode("overwrite").json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One JSON document of a manifest, which has a row per partition."""
    parts = {r["partition"]: {k: (sorted(v) if isinstance(v, list) else v) for k, v in r.asDict(True).items() if k != "partition"} for r in manifest.collect()}
    spark = manifest.sparkSession
    text = json.dumps({"schema_version": 1, "partitions": parts}, indent=2, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def audit_report(findings: dict[str, int], leaking: int, naive: float, clusters: list[tuple[int, int, int]] = ()) -> str:
    """The audit as Markdown; `clusters` are (cluster, partitions, rows) of those that leak."""
    lines = ["# Leakage audit", "", f"Leaking clusters after remediation: {leaking}", f"Leakage of a random split: {naive:.1%}", "", "| finding | count |", "|-|-:|"]
    lines += [f"| {k} | {v} |" for k, v in findings.items()]
    if clusters:
        lines += ["", "| cluster | partitions | rows |", "|-:|-:|-:|", *(f"| {c} | {p} | {n} |" for c, p, n in clusters)]
    return "\n".join(lines) + "\n"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One document as a single file in a folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_audit(findings: DataFrame, leaking: DataFrame, naive: float, path: str, listed: int = 100) -> None:
    """The audit report of `corpus.findings` and `corpus.leaking_clusters`, which lists the largest of those that leak."""
    worst = [tuple(r) for r in leaking.select("cluster", "partitions", "rows").orderBy(F.desc("rows"), "cluster").limit(listed).collect()]
    write_text(findings.sparkSession, audit_report(findings.first().asDict(), leaking.count(), naive, worst), path)


def write_weak_labels(rows: DataFrame, coverage: DataFrame, path: str, partition: str = "partition") -> None:
    """Rows (id, target, partition) with a target as JSON lines, a folder a partition, and the coverage report beside them."""
    rows.where("target IS NOT NULL").select("id", "target", partition).write.mode("overwrite").partitionBy(partition).json(f"{path}/labels")
    lines = ["# Weak labels", "", "| " + " | ".join(coverage.columns) + " |", "|" + "-|" * len(coverage.columns)]
    lines += ["| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in coverage.orderBy(coverage.columns[0]).collect()]
    write_text(rows.sparkSession, "\n".join(lines) + "\n", f"{path}/coverage")


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one with the schema where there is none."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)
