"""Sinks: canonical JSON lines, ordered Parquet shards, language tables, manifests, staged directories, locks."""

from __future__ import annotations

import contextlib
import json
import os
import shutil
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mhqa.functions.hashing import canonical_json
from mhqa.operators.keys import ContractError, with_ordinal
from mhqa.sources.readers import file_facts


ZSTD = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}


@contextlib.contextmanager
def exclusive(path: str) -> Iterator[None]:
    """A lock file beside ``path``; ContractError if another run holds it."""
    lock = f"{path}.lock"
    os.makedirs(os.path.dirname(os.path.abspath(lock)), exist_ok=True)
    try:
        os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
    except FileExistsError as error:
        raise ContractError(f"{path} is being written") from error
    try:
        yield
    finally:
        os.remove(lock)


def staged(path: str, write: Callable[[str], None], check: Callable[[str], None] | None = None) -> None:
    """``write`` to a directory beside ``path``, ``check`` it, then put it in place; if either fails, what was at ``path`` stays."""
    stage = f"{path}.staged"
    shutil.rmtree(stage, ignore_errors=True)
    with exclusive(path):
        try:
            write(stage)
            if check:
                check(stage)
        except BaseException:
            shutil.rmtree(stage, ignore_errors=True)
            raise
        old = f"{path}.old"
        shutil.rmtree(old, ignore_errors=True)
        if os.path.exists(path):
            os.replace(path, old)
        os.replace(stage, path)
        shutil.rmtree(old, ignore_errors=True)


def write_bytes(path: str, payload: bytes) -> None:
    """A file written beside its place, brought to the disk, and put there at once."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    temporary = f"{path}.{os.getpid()}.tmp"
    try:
        with open(temporary, "wb") as file:
            file.write(payload)
            file.flush()
            os.fsync(file.fileno())
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.remove(temporary)


def write_document(path: str, document: object) -> None:
    """A JSON document for readers: indented, keys sorted, not escaped to ASCII."""
    write_bytes(path, (json.dumps(document, ensure_ascii=False, sort_keys=True, indent=2, default=str) + "\n").encode())


def write_table(df: DataFrame, path: str, metadata: dict[str, str], *order: str) -> None:
    """Parquet with ``metadata`` in its schema (of each top-level field, where a reader finds it), sorted by ``order``, zstd at level 9."""
    noted = df.select(*[F.col(c).alias(c, metadata={**df.schema[c].metadata, **metadata}) for c in df.columns])
    ordered = noted.orderBy(*order) if order else noted
    staged(path, lambda p: ordered.write.options(**ZSTD).parquet(p))


def write_jsonl(df: DataFrame, path: str, *order: str, drop: Sequence[str] = ()) -> None:
    """Canonical JSON lines, ordered across files by ``order``, without the columns ``drop``."""
    ordered = df.orderBy(*order) if order else df
    staged(path, lambda p: ordered.select(canonical_json(F.struct(*[F.col(c) for c in df.columns if c not in drop])).alias("value")).write.text(p))


def write_shards(df: DataFrame, path: str, *order: str, rows: int = 5000, split: str = "train", schema: str | None = None) -> list[str]:
    """Parquet shards ``{split}-{i:05d}-of-{n:05d}.parquet`` of ``rows`` consecutive rows each, by the total order ``order``; their names."""
    numbered = with_ordinal(df, *order).withColumn("__shard", F.floor(F.col("ordinal") / rows).cast("int"))
    names: list[str] = []

    def write(stage: str) -> None:
        numbered.repartition("__shard").sortWithinPartitions("__shard", "ordinal").drop("ordinal").write.partitionBy("__shard").options(**ZSTD).parquet(stage)
        folders = sorted((f for f in os.listdir(stage) if f.startswith("__shard=")), key=lambda f: int(f.split("=")[1]))
        for k, folder in enumerate(folders):
            (part,) = [f for f in os.listdir(f"{stage}/{folder}") if f.endswith(".parquet")]
            names.append(f"{split}-{k:05d}-of-{len(folders):05d}.parquet")
            os.replace(f"{stage}/{folder}/{part}", f"{stage}/{names[-1]}")
            shutil.rmtree(f"{stage}/{folder}")

    def check(stage: str) -> None:
        back = df.sparkSession.read.parquet(*[f"{stage}/{n}" for n in names]) if names else df.limit(0)
        if [(f.name, f.dataType) for f in back.schema] != [(f.name, f.dataType) for f in df.schema] or back.count() != df.count():
            raise ContractError("the shards don't read back as written")

    staged(path, write, check)
    return names


def language_table(summary: DataFrame, path: str) -> None:
    """One CSV row for each language: counts and means with eight decimals for each unit. ``summary`` has (language, unit, n, mean)."""
    wide = summary.groupBy("language").pivot("unit", ["paragraph", "question", "answer"]).agg(F.first("n").alias("n"), F.format_string("%.8f", F.first("mean")).alias("mean")).orderBy("language")
    staged(path, lambda p: wide.coalesce(1).write.option("header", True).option("lineSep", "\n").csv(p))


def manifest(spark: SparkSession, directory: str, **facts: object) -> dict[str, object]:
    """Names, sizes, digests and (of Parquet files) rows of the files of a release, the environment and code revision, with ``facts`` and a fingerprint over all of it."""
    import platform
    import subprocess
    from hashlib import sha256

    import pyarrow.parquet as pq

    files = [r.asDict() for r in file_facts(spark, directory).drop("modified").orderBy("name").collect()]  # one row for each file of a release
    for file in files:
        if file["name"].endswith(".parquet"):
            file["rows"] = pq.read_metadata(f"{directory}/{file['name']}").num_rows  # the footer alone
    git = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, cwd=os.path.dirname(__file__), check=False)
    environment = {"python": platform.python_version(), "spark": spark.version, "revision": git.stdout.strip() if git.returncode == 0 else None}
    body = {"files": files, "environment": environment, **facts}
    return body | {"fingerprint": sha256(json.dumps(body, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()}
