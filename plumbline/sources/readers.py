"""Readers: numbers in text, WAV, and the optional scientific containers. All read through Spark's file sources."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what counts as a number in free text.
NUMBER = r"[-+]?\d+\.?\d*(?:[eE][-+]?\d+)?|[nN][aA][nN]"
SAMPLES = "file string, rate int, dtype string, channel int, idx long, sample double"


def numbers(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, idx, value): every number of a text file, in order. `nan` in any case is missing."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.regexp_extract_all("value", F.lit(f"({NUMBER})"), F.lit(1))).alias("idx", "_t"))
    value = F.when(F.lower("_t") == "nan", F.lit(float("nan"))).otherwise(F.col("_t").try_cast("double"))
    return lines.select("file", F.col("idx").cast("long").alias("idx"), value.alias("value"))


def parse_wav(content: bytes) -> tuple[int, str, np.ndarray]:
    """Rate, sample type and samples (frames x channels) of a RIFF file; samples are as stored."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            tag, channels, rate = struct.unpack_from("<HHI", body)
            bits = struct.unpack_from("<H", body, 14)[0]
            if tag == 0xFFFE and len(body) >= 26:
                tag = struct.unpack_from("<H", body, 24)[0]
            form = (tag, channels, rate, bits)
        elif name == b"data":
            if form is None:
                raise ValueError("data before format")
            tag, channels, rate, bits = form
            kind = {(1, 8): "uint8", (1, 16): "int16", (1, 32): "int32", (3, 32): "float32", (3, 64): "float64"}.get((tag, bits))
            if kind is None:
                raise ValueError(f"format {tag} of {bits} bits isn't read")
            x = np.frombuffer(body[: len(body) // (channels * bits // 8) * (channels * bits // 8)], np.dtype(kind).newbyteorder("<"))
            return rate, kind, x.reshape(-1, channels)
        at += 8 + size + size % 2
    raise ValueError("no data")


def write_wav(rate: int, samples: np.ndarray) -> bytes:
    x = np.atleast_2d(samples.T).T
    tag = 3 if x.dtype.kind == "f" else 1
    bits = 8 * x.dtype.itemsize
    head = struct.pack("<HHIIHH", tag, x.shape[1], rate, rate * x.shape[1] * bits // 8, x.shape[1] * bits // 8, bits)
    body = np.ascontiguousarray(x).astype(x.dtype.newbyteorder("<")).tobytes()
    chunks = b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def full_scale(dtype: str) -> float:
    """What samples are divided by: 1 for floats, one more than the greatest value for integers."""
    return 1.0 if dtype.startswith("float") else float(np.iinfo(dtype).max) + 1.0


def wav(spark: SparkSession, path: str, rows: int = 65536) -> DataFrame:
    """(file, rate, dtype, channel, idx, sample), a row per sample and channel, samples divided by full scale.

    A missing path raises an error; one task reads a file, and hands out `rows` samples at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rate, kind, x = parse_wav(bytes(content))
                n, channels = x.shape
                for i in range(0, n, rows):
                    part = x[i : i + rows]
                    yield pd.DataFrame({"file": file, "rate": rate, "dtype": kind, "channel": np.tile(np.arange(channels), len(part)), "idx": np.repeat(np.arange(i, i + len(part)), channels), "sample": part.ravel().astype(float) / full_scale(kind)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SAMPLES)


def container(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """(file, shape, idx, value): one numeric dataset of HDF5 (.h5, .hdf5) or NetCDF (.nc, .netcdf) files, flat.

    Their libraries are optional; without them an ImportError names the one that is missing. Other endings raise a
    ValueError, a missing path a FileNotFoundError.
    """
    end = path.rsplit(".", 1)[-1].lower()
    if end not in ("h5", "hdf5", "nc", "netcdf"):
        raise ValueError(f"no reader for .{end}")
    _require_path(spark, path)
    if end in ("h5", "hdf5"):
        import h5py  # noqa: F401
    else:
        import netCDF4  # noqa: F401

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                if end in ("h5", "hdf5"):
                    import h5py

                    with h5py.File(io.BytesIO(bytes(content)), "r") as f:
                        x = np.asarray(f[dataset])
                else:
                    import netCDF4

                    with netCDF4.Dataset("inmemory.nc", memory=bytes(content)) as f:
                        x = np.asarray(f.variables[dataset][:])
                yield pd.DataFrame({"file": file, "shape": [list(map(int, x.shape))] * x.size, "idx": np.arange(x.size), "value": x.ravel().astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, shape array<int>, idx long, value double")


def _require_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)
