"""Sinks: merged index, shards, JSON that is safe inside a page, files and pictures."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.build import assign_shards


def embed_safe(text: Column) -> Column:
    r"""Replace &, < and > by their six-character escapes."""
    for c, code in (("&", "0026"), ("<", "003c"), (">", "003e")):
        text = F.replace(text, F.lit(c), F.lit("\\u" + code))
    return text


def embed_safe_json(df: DataFrame) -> DataFrame:
    return df.select(embed_safe(F.to_json(F.struct("*"))).alias("json"))


def write_index(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    index.write.mode(mode).json(path)


def write_shards(papers: DataFrame, path: str, n: int = 4, mode: str = "overwrite") -> None:
    assign_shards(papers, n).write.mode(mode).partitionBy("shard").json(path)


def write_files(files: DataFrame, path: str) -> None:
    """One file for each row (name, data) in the folder `path` of any store that Arrow opens; a file appears whole or not at all, so a task may run twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        n = 0
        for b in batches:
            for name, data in zip(b.column("name").to_pylist(), b.column("data").to_pylist()):
                part = f"{root}/_{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(data or b"")
                store.move(part, f"{root}/{name}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    files.select("name", F.col("data").cast("binary").alias("data")).mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def encode_png(height: int, width: int, channels: int, data: bytes) -> bytes:
    """A PNG of rows of grey, BGR or BGRA bytes."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    order = {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[channels]
    lines = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(pixels[..., order]).reshape(height, width * channels)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def write_images(images: DataFrame, path: str) -> None:
    """PNG files of images (name, height, width, channels, data), compressed in the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"name": b["name"] + ".png", "data": [encode_png(*x) for x in zip(b["height"], b["width"], b["channels"], b["data"])]})

    write_files(images.select("name", "height", "width", "channels", "data").mapInPandas(run, "name string, data binary"), path)
