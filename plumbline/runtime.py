"""Timing, logging and sizing helpers of the driver."""

from __future__ import annotations

import json
import logging
import math
import statistics
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class JsonFormatter(logging.Formatter):
    """One JSON object per line."""

    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record, "%Y-%m-%dT%H:%M:%S"), "level": record.levelname, "name": record.name, "message": record.getMessage()})


class ShortFormatter(logging.Formatter):
    def __init__(self):
        super().__init__("[%(levelname)s] %(message)s")


def json_file_logger(name: str, path: str, level: int = logging.INFO) -> logging.Logger:
    """A logger that writes JSON lines to a file of the driver; asked for twice, it writes once."""
    logger = logging.getLogger(name)
    logger.setLevel(level)
    if not any(getattr(h, "baseFilename", None) == logging.FileHandler(path, delay=True).baseFilename for h in logger.handlers):
        handler = logging.FileHandler(path)
        handler.setFormatter(JsonFormatter())
        logger.addHandler(handler)
    return logger


@dataclass(frozen=True)
class Timing:
    cold_s: float
    mean_s: float
    std_s: float
    min_s: float


def profile(df: DataFrame, runs: int = 5) -> Timing:
    """A cold run and then warm ones, each a whole run into Spark's noop sink."""

    def once() -> float:
        t = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    cold, warm = once(), [once() for _ in range(max(1, runs))]
    return Timing(cold, statistics.fmean(warm), statistics.pstdev(warm), min(warm))


def partitions_for(n_items: int, item_bytes: int, target_bytes: int = 128 << 20) -> int:
    """Number of parts of about `target_bytes` each, at least one."""
    return max(1, math.ceil(n_items * item_bytes / target_bytes))


def hardware(spark: SparkSession) -> dict[str, object]:
    sc = spark.sparkContext
    return {"master": sc.master, "parallelism": sc.defaultParallelism, "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")), "version": spark.version}


class MemoryPressureError(RuntimeError):
    """The driver is short of memory."""


def check_driver_memory(least_free: float = 0.15) -> float:
    """Share of memory that is free; below `least_free` an error is raised. Executors spill by themselves."""
    facts = dict(line.split(":", 1) for line in open("/proc/meminfo"))
    free = int(facts["MemAvailable"].split()[0]) / int(facts["MemTotal"].split()[0])
    if free < least_free:
        raise MemoryPressureError(f"{free:.0%} of the memory is free; {least_free:.0%} is wanted")
    return free


_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir. Where that isn't set, a local session gets a folder of its own;
    on a cluster, whose executors wouldn't see one, it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all of {master} shares")
        root = _LOCAL[app] = _LOCAL.get(app) or "file://" + tempfile.mkdtemp(prefix="plumbline-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for folders in _RECORDS:
        folders.append(path)
    return path


_RECORDS: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that scratch() names meanwhile, so that they can be removed when nothing reads them any more."""
    folders: list[str] = []
    _RECORDS.append(folders)
    try:
        yield folders
    finally:
        _RECORDS[:] = [x for x in _RECORDS if x is not folders]


def remove(spark: SparkSession, folders: Iterable[str]) -> None:
    """Deletes folders, by the session's own file system."""
    for folder in folders:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, by the session's own file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(content))
    out.close()
