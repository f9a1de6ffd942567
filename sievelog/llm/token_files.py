"""Token ids in binary shards: every document is compressed alone with one shared zstandard dictionary.

A folder holds dictionary.zdict, manifest.json and shard-NNNNN.tok files in
ascending key order (null keys first). A shard is

    magic "SVTK1\\n", 32 bytes SHA-256 of the dictionary,
    the compressed documents one after another,
    the index: per document key (int64), null flag (uint8), ids (uint64), end of its bytes (uint64),
    and a footer: offset of the index (uint64), documents (uint64), ids (uint64), CRC-32 of the index (uint32), magic.

The index lets one document be read without the others. A shard is written
under another name and then renamed, so a task that runs twice or dies halfway
leaves no half shard.

The dictionary is trained on the ids of at most SAMPLE_DOCS documents of at
most SAMPLE_IDS ids each: it only affects size, never content.

Defined cases: a null text is empty and holds its end id alone; repeated rows
are kept; an empty table gives a folder without shards.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_text_batches, stage
from .tokens import encoder

MAGIC = b"SVTK1\n"
INDEX = np.dtype([("key", "<i8"), ("null", "u1"), ("ids", "<u8"), ("end", "<u8")])
FOOTER = "<QQQI6s"
SAMPLE_DOCS = 1_000
SAMPLE_IDS = 4_096
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Documents to a shard.
SHARD_DOCS = 20_000


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _sample(docs: DataFrame, text: str, n: int) -> list[str]:
    """A bounded sample of texts from all over the table."""
    total = docs.count()
    if not total:
        return []
    return [r[0] or "" for r in docs.select(F.substring(text, 1, 8 * SAMPLE_IDS)).sample(fraction=min(1.0, 1.5 * n / total), seed=10).limit(n).toLocalIterator()]


def train_dictionary(docs: DataFrame, vocabulary: str, text: str = "text") -> bytes:
    """b"" where there is too little to learn from."""
    enc = encoder(vocabulary, spaces_join=False)
    parts = [x[: 4 * SAMPLE_IDS] for x in enc.encode_all(_sample(docs, text, SAMPLE_DOCS))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [x for x in parts if x], level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _codec(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write(docs: DataFrame, path: str, vocabulary: str, *, end_id: int, shard_docs: int = SHARD_DOCS, key: str = "doc_id", text: str = "text") -> dict:
    """Writes the folder at path and returns its manifest."""
    spark = docs.sparkSession
    small_text_batches(spark)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    dictionary = train_dictionary(docs, vocabulary, text)
    sent = spark.sparkContext.broadcast(dictionary)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = encoder(vocabulary, spaces_join=False)
        press = zstandard.ZstdCompressor(level=LEVEL, **_codec(sent.value))
        for pdf in batches:
            ids = [x + end for x in enc.encode_all([t or "" for t in pdf["text"]])]
            yield pd.DataFrame({"key": pdf["key"].astype("Int64"), "ids": [len(x) // 4 for x in ids], "data": [press.compress(x) for x in ids]})

    pressed = stage(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInPandas(squeeze, "key long, ids long, data binary"), "token-files")
    total = pressed.count()
    fs, base = _place(path)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/dictionary.zdict") as f:
        f.write(dictionary)
    digest = hashlib.sha256(dictionary).digest()

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        fs, base = _place(path)
        number = TaskContext.get().partitionId()
        own = f"{base}/.shard-{number:05d}-{uuid.uuid4().hex}"
        index, at, out = [], 0, None
        for pdf in batches:
            if not len(pdf):
                continue
            if out is None:
                out = fs.open_output_stream(own)
                out.write(MAGIC + digest)
            part = np.zeros(len(pdf), INDEX)
            part["null"] = pdf["key"].isna()
            part["key"] = pdf["key"].fillna(0).astype("int64")
            part["ids"] = pdf["ids"]
            part["end"] = at + np.cumsum([len(x) for x in pdf["data"]])
            at = int(part["end"][-1])
            out.write(b"".join(pdf["data"]))
            index.append(part)
        if out is None:
            return
        whole = np.concatenate(index)
        n_ids = int(whole["ids"].sum())
        out.write(whole.tobytes())
        out.write(struct.pack(FOOTER, len(MAGIC) + 32 + at, len(whole), n_ids, zlib.crc32(whole.tobytes()), MAGIC))
        out.close()
        name = f"shard-{number:05d}.tok"
        fs.move(own, f"{base}/{name}")
        yield pd.DataFrame({"number": [number], "name": [name], "docs": [len(whole)], "ids": [n_ids]})

    n = max(1, -(-total // shard_docs))
    # rows that repeat a key are told apart by their place in what was staged, so many of them fill several shards
    order = [F.col("key").asc_nulls_first(), F.col("ids"), F.col("place")]
    placed = pressed.withColumn("place", F.monotonically_increasing_id())
    made = placed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("key", "ids", "data").mapInPandas(shards, "number int, name string, docs long, ids long")
    files = sorted((r.asDict() for r in made.collect()), key=lambda s: s["number"]) if total else []  # one row a shard
    manifest = {"dictionary_sha256": digest.hex(), "end_id": end_id, "shards": files}
    with fs.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _opened(fs: pafs.FileSystem, name: str, digest: bytes):
    f = fs.open_input_file(name)
    size = f.size()
    index_at, docs, ids, crc, magic = struct.unpack(FOOTER, f.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
    raw = f.read_at(docs * INDEX.itemsize, index_at)
    if magic != MAGIC or f.read_at(len(MAGIC) + 32, 0) != MAGIC + digest or zlib.crc32(raw) != crc:
        raise ValueError(f"{name} is damaged, or made with another dictionary")
    return f, np.frombuffer(raw, INDEX)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: key, start (ids of all documents before it), n_tokens, ids (little-endian uint32)."""
    fs, base = _place(path)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        manifest = json.loads(f.read())
    digest = bytes.fromhex(manifest["dictionary_sha256"])
    schema = "key long, start long, n_tokens long, ids binary"
    starts = np.cumsum([0, *[s["ids"] for s in manifest["shards"]]])
    if not manifest["shards"]:
        return spark.createDataFrame([], schema)
    todo = spark.createDataFrame([(s["name"], int(at)) for s, at in zip(manifest["shards"], starts)], "name string, start long")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _place(path)
        with fs.open_input_stream(f"{base}/dictionary.zdict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError("the dictionary is not the one of the manifest")
        unpress = zstandard.ZstdDecompressor(**_codec(dictionary))
        for pdf in batches:
            for name, start in zip(pdf["name"], pdf["start"]):
                f, index = _opened(fs, f"{base}/{name}", digest)
                at, first = len(MAGIC) + 32, start + np.concatenate([[0], np.cumsum(index["ids"].astype("int64"))])
                for lo in range(0, len(index), 256):
                    part = index[lo : lo + 256]
                    begin = int(index["end"][lo - 1]) if lo else 0
                    data = f.read_at(int(part["end"][-1]) - begin, at + begin)
                    cuts = np.concatenate([[0], part["end"].astype("int64") - begin])
                    yield pd.DataFrame({
                        "key": pd.Series(part["key"], dtype="Int64").mask(part["null"].astype(bool)), "start": first[lo : lo + len(part)], "n_tokens": part["ids"].astype("int64"),
                        "ids": [unpress.decompress(data[a:b]) for a, b in zip(cuts, cuts[1:])],
                    })
                f.close()

    return todo.repartitionByRange(len(manifest["shards"]), "name").mapInPandas(load, schema)


def read_document(path: str, shard: str, place: int) -> np.ndarray:
    """The ids of one document of a shard: footer, its index entry and the one before, and its own bytes are all that is read."""
    fs, base = _place(path)
    with fs.open_input_stream(f"{base}/dictionary.zdict") as f:
        dictionary = f.read()
    with fs.open_input_file(f"{base}/{shard}") as f:
        tail = struct.calcsize(FOOTER)
        index_at, docs, _, _, magic = struct.unpack(FOOTER, f.read_at(tail, f.size() - tail))
        if magic != MAGIC or f.read_at(len(MAGIC) + 32, 0) != MAGIC + hashlib.sha256(dictionary).digest():
            raise ValueError(f"{shard} is damaged, or made with another dictionary")
        if not 0 <= place < docs:
            raise IndexError(place)
        first = max(0, place - 1)
        entries = np.frombuffer(f.read_at((place + 1 - first) * INDEX.itemsize, index_at + first * INDEX.itemsize), INDEX)
        begin = int(entries["end"][0]) if place else 0
        data = f.read_at(int(entries["end"][-1]) - begin, len(MAGIC) + 32 + begin)
    ids = np.frombuffer(zstandard.ZstdDecompressor(**_codec(dictionary)).decompress(data), "<u4")
    if len(ids) != entries["ids"][-1]:
        raise ValueError(f"{shard}, document {place}: {len(ids)} ids")
    return ids


def checked(df: DataFrame) -> DataFrame:
    """read() with the CRC-32 of each document's ids in their place."""

    @F.pandas_udf("long")
    def crc(ids: pd.Series) -> pd.Series:
        return ids.map(zlib.crc32).astype("int64")

    return df.select("key", "start", "n_tokens", crc("ids").alias("ids_crc32"))
