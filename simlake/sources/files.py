"""Sources: assembly directories, query files, stores, configuration."""

from __future__ import annotations

import os
import tempfile
import tomllib
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, code, path, reject): .asm and .txt files below a directory, whatever the case; blank and non-UTF-8 files are marked as rejects. Files of no bytes are left out by Spark's scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(asm|txt)$"))
    code = F.expr("try_validate_utf8(cast(content as string))")
    name = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    reject = F.when(F.length("content") == 0, "empty").when(code.isNull(), "not UTF-8").when(F.trim(F.regexp_replace(code, r"\s+", " ")) == "", "empty")
    return files.select(F.col("path").alias("ord"), F.url_decode(F.regexp_replace(name, r"\+", "%2B")).alias("name"), F.when(reject.isNull(), code).alias("code"), "path", reject.alias("reject"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, code): one query a line; blank lines and those that begin with # are left out."""
    lines = spark.read.text(path).withColumn("query_id", F.monotonically_increasing_id())
    return lines.where("trim(value) != '' and not startswith(trim(value), '#')").select("query_id", F.trim("value").alias("code"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_foreign(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A store table of another database, through JDBC; names and tags there are JSON texts."""
    df = spark.read.jdbc(url, table, properties=options)
    lists = {c: F.from_json(c, "array<string>") for c in ("names", "tags") if c in df.columns}
    return df.withColumns(lists) if lists else df


@dataclass(frozen=True)
class Config:
    lsh_threshold: float = 0.5
    num_permutations: int = 128
    top_n: int = 5
    ngram_size: int = 3
    jaccard_weight: float = 0.4
    format: str = "table"

    @classmethod
    def load(cls, path: str | os.PathLike) -> Config:
        """Known keys of a TOML file of the right kinds; a missing or bad file gives the defaults."""
        try:
            raw = tomllib.loads(Path(path).read_text("utf-8"))
        except (OSError, ValueError):
            return cls()
        kinds = {"lsh_threshold": (int, float), "jaccard_weight": (int, float), "num_permutations": int, "top_n": int, "ngram_size": int, "format": str}
        return cls(**{k: raw[k] for k, kind in kinds.items() if isinstance(raw.get(k), kind) and not isinstance(raw.get(k), bool)})

    def save(self, path: str | os.PathLike) -> None:
        """Written beside and moved into place."""
        path = Path(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        text = "".join(f"{k} = {v!r}\n" if not isinstance(v, str) else f'{k} = "{v}"\n' for k, v in asdict(self).items())
        with tempfile.NamedTemporaryFile("w", dir=path.parent, delete=False, encoding="utf-8") as f:
            f.write(text)
        os.replace(f.name, path)

    def set(self, key: str, value: str) -> Config:
        """With one value, parsed by the kind of its default."""
        kind = {f.name: type(f.default) for f in fields(self)}.get(key)
        if kind is None:
            raise KeyError(key)
        return replace(self, **{key: kind(value)})

    def unset(self, key: str) -> Config:
        return replace(self, **{key: {f.name: f.default for f in fields(self)}[key]})
