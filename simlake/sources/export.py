"""Sinks: stores and indexes as Parquet, directories of .asm files, YARA rules, JSON, CSV."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RESERVED = "^(?i)(con|prn|aux|nul|com[1-9]|lpt[1-9])([.].*)?$"


def write_store(store: DataFrame, path: str, mode: str = "append") -> None:
    store.write.mode(mode).parquet(path)


def write_index(index: DataFrame, path: str) -> None:
    """By band, so that a lookup reads one directory; buckets in order within a file, so that it reads few row groups."""
    index.repartition("band").sortWithinPartitions("bucket").write.mode("overwrite").partitionBy("band").parquet(path)


def primary_name(names: Column, checksum: Column) -> Column:
    return F.coalesce(F.get(names, F.lit(0)), F.concat(F.lit("snippet_"), F.substring(checksum, 1, 16)))


def safe_stem(name: Column, checksum: Column) -> Column:
    """A file stem: no separators or control signs, no leading dots, no reserved name, at most 120 characters."""
    s = F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f]', "_")
    s = F.regexp_replace(F.regexp_replace(s, r"^[. ]+", ""), r"[. ]+$", "")
    s = F.substring(s, 1, 120)
    s = F.when(s.rlike(_RESERVED), F.concat(F.lit("_"), s)).otherwise(s)
    return F.when(F.length(s) == 0, F.substring(checksum, 1, 16)).otherwise(s)


def export_names(store: DataFrame) -> DataFrame:
    """(checksum, file_name): stems that collide, whatever the case, get a part of their checksum, but for the first."""
    stem = store.select("checksum", safe_stem(primary_name(F.col("names"), F.col("checksum")), F.col("checksum")).alias("stem"))
    k = F.row_number().over(Window.partitionBy(F.lower("stem")).orderBy("checksum"))
    return stem.withColumn("k", k).select("checksum", F.when(F.col("k") == 1, F.concat("stem", F.lit(".asm"))).otherwise(F.concat("stem", F.lit("-"), F.substring("checksum", 1, 12), F.lit(".asm"))).alias("file_name"))


def export_directory(store: DataFrame, path: str) -> int:
    """Writes one file per snippet into a directory that all executors see; returns how many. A file never lands outside it."""
    root = os.path.realpath(path)
    os.makedirs(root, exist_ok=True)

    def put(batches):
        import pyarrow as pa

        for b in batches:
            n = 0
            for name, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = os.path.realpath(os.path.join(root, name))
                if os.path.dirname(at) == root:
                    with open(at, "w", encoding="utf-8", newline="") as f:
                        f.write(code or "")
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    named = export_names(store).join(store.select("checksum", "code"), "checksum")
    return named.select("file_name", "code").mapInArrow(put, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _escape(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\r", "\\r"), ("\n", "\\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def yara_rules(store: DataFrame) -> DataFrame:
    """(checksum, rule): a string-matching rule for each snippet; names and code are escaped, so that neither can leave its literal."""
    name = primary_name(F.col("names"), F.col("checksum"))
    ident = F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")
    ident = F.when(ident.rlike("^[a-zA-Z_]"), ident).otherwise(F.concat(F.lit("r_"), ident))
    rule = F.concat(
        F.lit("rule simlake_"), ident, F.lit("_"), F.substring("checksum", 1, 8), F.lit(' {\n  meta:\n    description = "'), _escape(name),
        F.lit('"\n    checksum = "'), F.col("checksum"), F.lit('"\n  strings:\n    $text = "'), _escape(F.col("code")), F.lit('" nocase ascii wide\n  condition:\n    $text\n}\n'),
    )
    return store.select("checksum", rule.alias("rule"))


def export_yara(store: DataFrame, path: str) -> None:
    yara_rules(store).select("rule").write.mode("overwrite").text(path)


def flat(df: DataFrame) -> DataFrame:
    """Arrays of strings as one text, for tables and CSV."""
    return df.select(*(F.array_join(f.name, ", ").alias(f.name) if re.match(r"array<string>", f.dataType.simpleString()) else F.col(f.name) for f in df.schema.fields if not f.dataType.simpleString().startswith("array<bigint>")))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def export_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", "true").csv(path)
