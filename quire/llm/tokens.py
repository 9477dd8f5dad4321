"""Token ids in training order, in shards of fixed-stride binary records.

Documents become token ids of a given byte-level vocabulary, each followed by the end
token, and are packed into sequences of ``length`` ids; a partition of the input fills
its last sequence up with end tokens.  The sequences of all partitions are numbered in
order, and a keyed Feistel permutation gives each number its slot: four rounds over the
smallest even number of bits that holds them, repeated while the result lies outside
(cycle-walking).  So every slot from 0 to the last is taken once, without a sort and
without a table.  A shard holds a range of slots as records of equal size; record r is
at byte ``r * 2 * length``, so a reader may start anywhere.  The manifest that completes a
set of shards says how they are cut, and with which key.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quire.llm.stage import discard, stage, write_table
from quire.llm.words import mix
from quire.session import share_code, shared_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's texts are cut before pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 1024
RECORDS = 16_384
KEY = 20_240_601
ROUNDS = 4
_FEISTEL_ROUNDS = 4


class Encoder:
    """Little-endian 16-bit ids of texts, each encoded as a whole."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        if len(table) >= 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.end = len(table)
        self._encode = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def encode(self, data: bytes) -> bytes:
        return np.array(self._encode(data.decode("utf-8")), "<u2").tobytes()


@lru_cache(maxsize=2)
def _encoder(ranks: bytes, pattern: str) -> Encoder:
    return Encoder(ranks, pattern)


def feistel(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slots of ``index`` (numbers below ``n``): a permutation of 0 .. n - 1."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, _FEISTEL_ROUNDS + 1, dtype=np.uint64) + np.uint64(key))
    out = index.astype(np.uint64)
    walking = np.ones(len(out), bool)
    while walking.any():
        left, right = out[walking] >> np.uint64(half), out[walking] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[walking] = (left << np.uint64(half)) | right
        walking = out >= np.uint64(n)
    return out.astype(np.int64)


def sequences(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, length: int = LENGTH) -> DataFrame:
    """(part, number, n_tokens, tokens): packed sequences of each partition of ``docs``.

    n_tokens counts ids before the filling.  Null and empty texts give no ids at all.
    Rows that repeat are encoded as often.  Other columns are not read.
    """
    share_code(docs.sparkSession)
    with open(vocabulary, "rb") as f:  # by the driver; tasks get its content
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    stride = 2 * length

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        end = np.array([encoder.end], "<u2").tobytes()
        part, number, rest = TaskContext.get().partitionId(), 0, b""

        def out(numbers: list[int], sizes: list[int], records: list[bytes]) -> pa.RecordBatch:
            columns = [pa.array([part] * len(numbers), pa.int32()), pa.array(numbers, pa.int64()), pa.array(sizes, pa.int32()), pa.array(records, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "number", "n_tokens", "tokens"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch.column("text").slice(at, 256).cast(pa.binary()).to_pylist()
                data = rest + b"".join(encoder.encode(t) + end for t in texts if t)
                whole = len(data) // stride
                rest = data[whole * stride :]
                if whole:
                    records = [data[k * stride : (k + 1) * stride] for k in range(whole)]
                    yield out(list(range(number, number + whole)), [length] * whole, records)
                    number += whole
        if rest:
            yield out([number], [len(rest) // 2], [rest + end * (length - len(rest) // 2)])

    rows = docs.select(F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pack, "part int, number long, n_tokens int, tokens binary")


def training_order(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
    length: int = LENGTH,
    records: int = RECORDS,
    key: int = KEY,
) -> DataFrame:
    """All sequences in training order: slot, shard, record, n_tokens, tokens.

    The packed sequences are written once to the shared folder, which fixes their
    numbers; a lost executor repeats at most its share of the move into shards.  Each
    partition of the result holds whole shards, sorted by slot.  An empty table, or one
    without any text, gives an empty result.
    """
    placed, shards = _placed(stage(sequences(docs, vocabulary, pattern, length), "sequences", "zstd"), records, key)
    return _in_order(placed, 0, max(1, shards))


def _placed(packed: DataFrame, records: int, key: int) -> tuple[DataFrame, int]:
    """The sequences with slot, shard and record, as they come, and the number of shards."""
    # One row for each partition of the input.
    parts = packed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = stage(parts.select("part", before.alias("start"), "n"), "starts")
    n = starts.agg(F.sum("n")).first()[0] or 0

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), n, key))

    # Two numbers for each partition of the input, which Spark's driver lists as well.  The
    # mark keeps a choice of shards from working out all slots a second time.
    index = slot.asNondeterministic()(F.col("start") + F.col("number"))
    numbered = packed.join(F.broadcast(starts.drop("n")), "part").withColumn("slot", index)
    placed = numbered.select(
        "slot",
        F.expr(f"slot div {records}").cast("int").alias("shard"),
        (F.col("slot") % records).cast("int").alias("record"),
        "n_tokens",
        "tokens",
    )
    return placed, -(-n // records)


def _in_order(placed: DataFrame, first: int, stop: int) -> DataFrame:
    """The shards from ``first`` to before ``stop``, each in one partition."""
    return placed.repartitionById(stop - first, F.col("shard") - F.lit(first)).sortWithinPartitions("slot")


def written_order(
    docs: DataFrame,
    length: int = LENGTH,
    records: int = RECORDS,
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
    key: int = KEY,
) -> DataFrame:
    """Write all shards and a manifest; returns the rows of ``training_order``, read from them.

    The shards are in a folder ``shards-...`` of its own below ``spark.checkpoint.dir``.
    They are whole when this returns, whatever is read of the result and however often.
    Sequences move into shards in at most ``ROUNDS`` jobs, a range of shards in each, whose
    shuffle files go before the next one begins; then the packed sequences go.
    """
    packed = stage(sequences(docs, vocabulary, pattern, length), "sequences", "zstd")
    placed, shards = _placed(packed, records, key)
    uri = shared_dir(docs.sparkSession, "shards")
    width = max(1, -(-shards // ROUNDS))
    for first in range(0, max(1, shards), width):
        chosen = placed.filter((F.col("shard") >= first) & (F.col("shard") < first + width))
        _write_records(_in_order(chosen, first, min(first + width, max(1, shards))), uri, length)
    _complete(docs.sparkSession, uri, length, records, key)
    discard(packed)
    return read_shards(docs.sparkSession, uri)


_SHARDS = "shard int, records long, bytes long, short array<struct<record:int,n_tokens:int>>"


def write_shards(ordered: DataFrame, uri: str, length: int = LENGTH, records: int = RECORDS, key: int = KEY) -> DataFrame:
    """Write ``shard-00000.bin`` and so on below ``uri``; returns shard, records, bytes, short.

    ``uri`` is a folder that all executors share, of a file system that pyarrow opens.
    A task writes each of its shards under a name of its own and renames it when it is
    whole, so a repeated task replaces the file by an equal one.  A table of the shards
    and ``manifest.json`` follow; without the latter the set is not complete.  ``short``
    lists the sequences that are filled up, at most one for each partition of the input.
    """
    _write_records(ordered, uri, length)
    return _complete(ordered.sparkSession, uri, length, records, key)


def _write_records(ordered: DataFrame, uri: str, length: int) -> None:
    """Write the shards of ``ordered`` and add them to the table of the shards."""
    share_code(ordered.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        done, current, sink, count, short = [], None, None, 0, []

        def close() -> None:
            if sink is not None:
                sink.close()
                fs.move(f"{base}/.shard-{current:05d}.{attempt}", f"{base}/shard-{current:05d}.bin")
                done.append({"shard": current, "records": count, "bytes": count * 2 * length, "short": short})

        for batch in batches:
            for shard, n, tokens in zip(batch.column("shard").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("tokens")):
                if shard != current:
                    close()
                    current, count, short = shard, 0, []
                    sink = fs.open_output_stream(f"{base}/.shard-{shard:05d}.{attempt}")
                if n < length:
                    short.append({"record": count, "n_tokens": n})
                sink.write(tokens.as_buffer())
                count += 1
        close()
        parts = pa.list_(pa.struct([("record", pa.int32()), ("n_tokens", pa.int32())]))
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("short", parts)]))

    write_table(ordered.select("shard", "n_tokens", "tokens").mapInArrow(write, _SHARDS), f"{uri}/shards.parquet", mode="append")


def _complete(spark: SparkSession, uri: str, length: int, records: int, key: int) -> DataFrame:
    """The manifest over all shards that are written."""
    written = spark.read.schema(_SHARDS).parquet(f"{uri}/shards.parquet")
    totals = written.agg(F.count("*").alias("shards"), F.coalesce(F.sum("records"), F.lit(0)).alias("records")).first()
    manifest = {"stride": 2 * length, "length": length, "records_per_shard": records, "key": key, "shards": totals["shards"], "records": totals["records"]}
    fs, base = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_output_stream(f"{base}/{_MANIFEST}") as out:
        out.write(json.dumps(manifest).encode())
    return written


_MANIFEST = "manifest.json"
_READ_ROWS = 1024


def read_shards(spark: SparkSession, uri: str, slot: int = 0) -> DataFrame:
    """The sequences of written shards from ``slot`` on: slot, shard, record, n_tokens, tokens.

    A task reads whole shards from front to back; the one that ``slot`` lies in is entered
    at its place, and earlier ones are not opened, so a training run goes on where it was
    broken off.  ``ValueError`` if the set of shards is not complete.
    """
    share_code(spark)
    fs, base = pyarrow.fs.FileSystem.from_uri(uri)
    if fs.get_file_info(f"{base}/{_MANIFEST}").type != pyarrow.fs.FileType.File:
        raise ValueError(f"no complete set of shards at {uri}")
    with fs.open_input_stream(f"{base}/{_MANIFEST}") as f:
        manifest = json.loads(f.readall())
    stride, length, per_shard = manifest["stride"], manifest["length"], manifest["records_per_shard"]
    first, skip = divmod(slot, per_shard)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, folder = pyarrow.fs.FileSystem.from_uri(uri)
        for batch in batches:
            for row in batch.to_pylist():
                short = {x["record"]: x["n_tokens"] for x in row["short"]}
                at = skip if row["shard"] == first else 0
                with disk.open_input_file(f"{folder}/shard-{row['shard']:05d}.bin") as f:
                    f.seek(at * stride)
                    while at < row["records"]:
                        n = min(_READ_ROWS, row["records"] - at)
                        data = f.read(n * stride)
                        if len(data) != n * stride:
                            raise OSError(f"shard {row['shard']} is cut off")
                        numbers = np.arange(at, at + n)
                        sizes = np.array([short.get(k, length) for k in numbers.tolist()], np.int32)
                        offsets = pa.py_buffer((np.arange(n + 1) * stride).astype(np.int32))
                        tokens = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(data)])
                        columns = [row["shard"] * per_shard + numbers, np.full(n, row["shard"], np.int32), numbers.astype(np.int32), sizes]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), tokens], names=["slot", "shard", "record", "n_tokens", "tokens"])
                        at += n

    shards = spark.read.schema(_SHARDS).parquet(f"{uri}/shards.parquet").filter(F.col("shard") >= first)
    spread = shards.repartitionById(max(1, manifest["shards"] - first), F.col("shard") - F.lit(first))
    return spread.mapInArrow(read, "slot long, shard int, record int, n_tokens int, tokens binary")
