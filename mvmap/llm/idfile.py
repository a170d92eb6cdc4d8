"""Operator 10: token-id files of shuffled planes.

Documents are range-partitioned by doc_id, encoded, and laid into chunks that
close at the first document end at or after ``chunk_ids`` ids. A chunk holds
blocks of ``block_ids`` ids; a block's ids are transposed into byte planes (or
bit planes) and each plane is compressed with zstandard on its own. A chunk
image is::

    magic 'PLN1' | plane kind u8 (0 byte, 1 bit) | block_ids u32 | n_ids u64
    then for each block, for each plane: compressed length u32 (0: all zero) | bytes

little-endian throughout. Chunk images are stored as binary cells of uncompressed
Parquet files under ``<path>/chunks`` with their document table, so writing goes
through Spark's commit protocol on any store Spark can reach; ``<path>/index`` is
the chunk index: file, chunk, first id overall, number of ids and documents,
first and last document, crc32 of the image.

Null text counts as empty (the end id alone). Texts are encoded whole; a very long one
makes its chunk as large as it is. Rows sort by (doc_id nulls first, text); repeated
rows are stored each, ties in no defined order, as they are alike. An empty table gives
an empty file set. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import struct
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mvmap.llm import common, tokens

MAGIC = b"PLN1"
CHUNKS = "file_no int, chunk_no int, start_in_file bigint, n_ids bigint, doc_ids array<bigint>, doc_lens array<bigint>, image binary"
DOCS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def encode_chunk(ids, block_ids: int, bits: bool, compressor) -> bytes:
    import numpy as np

    parts = [MAGIC, struct.pack("<BIQ", int(bits), block_ids, len(ids))]
    for at in range(0, len(ids), block_ids):
        block = np.ascontiguousarray(ids[at:at + block_ids], dtype="<u4")
        planes = block.view("u1").reshape(-1, 4)
        if bits:
            planes = np.packbits(np.unpackbits(planes, axis=1, bitorder="little").T, axis=1, bitorder="little")
        else:
            planes = np.ascontiguousarray(planes.T)
        for plane in planes:
            data = compressor.compress(plane.tobytes()) if plane.any() else b""
            parts += [struct.pack("<I", len(data)), data]
    return b"".join(parts)


def decode_chunk(image: bytes, decompressor):
    import numpy as np

    if image[:4] != MAGIC:
        raise ValueError("not a plane chunk")
    bits, block_ids, n = struct.unpack_from("<BIQ", image, 4)
    out, at = np.empty(n, dtype="<u4"), 4 + struct.calcsize("<BIQ")
    for start in range(0, n, block_ids):
        m = min(block_ids, n - start)
        count, width = (32, (m + 7) // 8) if bits else (4, m)
        planes = np.zeros((count, width), dtype="u1")
        for p in range(count):
            (size,) = struct.unpack_from("<I", image, at)
            at += 4
            if size:
                planes[p] = np.frombuffer(decompressor.decompress(image[at:at + size], max_output_size=width), dtype="u1")
                at += size
        if bits:
            planes = np.packbits(np.unpackbits(planes, axis=1, bitorder="little")[:, :m].T, axis=1, bitorder="little")
        else:
            planes = planes.T
        out[start:start + m] = np.ascontiguousarray(planes).view("<u4").ravel()
    return out


def _write(batches, path: str, end_id: int, block_ids: int, chunk_ids: int, bits: bool, level: int):
    import numpy as np
    import pyarrow as pa
    import zstandard
    from pyspark import TaskContext

    enc, comp = tokens.encoder(path), zstandard.ZstdCompressor(level=level)
    end, file_no = np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId()
    chunk_no = start = held = 0
    docs: list[int | None] = []
    parts: list[bytes] = []

    def flush():
        image = encode_chunk(np.frombuffer(b"".join(parts), dtype="<u4"), block_ids, bits, comp)
        row = [[file_no], [chunk_no], [start], [held], [docs], [[len(p) // 4 for p in parts]], [image]]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], [x.split()[0] for x in CHUNKS.split(", ")])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = enc.encode(text.as_py()) + end
            docs.append(doc)
            parts.append(ids)
            held += len(ids) // 4
            if held >= chunk_ids:
                yield flush()
                chunk_no, start, held, docs, parts = chunk_no + 1, start + held, 0, [], []
    if docs:
        yield flush()


def _read(batches, bases: dict[int, int]):
    import pyarrow as pa
    import zstandard

    decomp = zstandard.ZstdDecompressor()
    for batch in batches:
        for row in batch.to_pylist():
            raw = decode_chunk(row["image"], decomp).tobytes()
            at, starts, ids = 0, [], []
            for n in row["doc_lens"]:
                starts.append(bases[row["file_no"]] + row["start_in_file"] + at)
                ids.append(raw[4 * at:4 * (at + n)])
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["doc_lens"], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, block_ids: int = 65536, chunk_ids: int = 262144, bits: bool = False, level: int = 1) -> None:
    """Encode every text, append ``end_id`` and write the chunk files and index."""
    spark = docs.sparkSession
    fn = partial(_write, path=tokenizer or tokens.tokenizer_path(), end_id=end_id, block_ids=block_ids, chunk_ids=chunk_ids, bits=bits, level=level)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The text's hash lets one doc_id that fills a third of the rows spread over ranges.
    dealt = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"), F.col("text"))
    common.map_arrow(dealt, fn, CHUNKS).write.option("compression", "uncompressed").parquet(f"{path}/chunks")
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    files = chunks.groupBy("file_no").agg(F.sum("n_ids").alias("file_ids"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("file_no", F.coalesce(F.sum("file_ids").over(before), F.lit(0)).alias("file_start"))
    meta = chunks.select("file_no", "chunk_no", "start_in_file", "n_ids", F.size("doc_ids").alias("n_docs"), F.element_at("doc_ids", 1).alias("first_doc"), F.element_at("doc_ids", -1).alias("last_doc"), F.crc32("image").alias("image_crc32"))
    index = meta.join(base, "file_no").withColumn("start", F.col("file_start") + F.col("start_in_file"))
    index.write.parquet(f"{path}/index")


INDEX = "file_no int, chunk_no int, start_in_file bigint, n_ids bigint, n_docs int, first_doc bigint, last_doc bigint, image_crc32 bigint, file_start bigint, start bigint"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents as stored: doc_id, start (ids before it overall), n_tokens, ids.
    The driver holds one long per written file, as many as the write had tasks."""
    bases = {r.file_no: r.file_start for r in read_index(spark, path).select("file_no", "file_start").distinct().collect()}
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    return common.map_arrow(chunks, partial(_read, bases=bases), DOCS)


def op10_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "idfile")
    write_ids(common.documents(spark, sf_dir), path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
