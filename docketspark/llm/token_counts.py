"""Token counts of flat, unindexed token files by a separator scan.

A stream is a flat sequence of fixed-width token ids in which every document ends with the end-of-document id; nothing
says where. Streams are read as blocks. In each block one vectorised comparison finds the separators; a prefix scan over
the blocks' sums then says how many tokens and separators precede a block and where the last one stood, which stitches the
documents that run over block ends. The scan has two levels, blocks within groups and groups within streams, so a
stream that holds a third of all blocks is not one task's.

Defined cases: an empty document, and a null text, has 0 tokens and still its separator; tokens after the last separator are
a document that is not ended; an empty stream has none; blocks may be of any size, in any order, a null block is empty; bytes
at a block's end that are no whole id are no token; a document may run over any number of blocks; repeated rows are documents
of their own; ids beyond the width are an error, not a wrong count; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docketspark.llm.common import filled, lean
from docketspark.session import cut

BLOCK_TOKENS = 1 << 16
GROUP_BLOCKS = 256


def read_flat_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS, split_bytes: int = 128 << 20) -> DataFrame:
    """Blocks (stream, block, data) of the flat files under ``path``; one file is one stream, of any size.

    Tasks read ranges of about ``split_bytes`` of a file, so a large file is many tasks' and none holds more than a block.
    """

    class Range(InputPartition):
        def __init__(self, file: str, start: int, stop: int):
            self.file, self.start, self.stop = file, start, stop

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.path, self.size = options["path"], int(options["block_bytes"])
            self.split = max(1, int(options["split_bytes"]) // self.size) * self.size

        def store(self):
            from pyarrow import fs

            return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

        def partitions(self):
            from pyarrow import fs

            store, root = self.store()
            top = store.get_file_info(root)
            files = [top] if top.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
            names = sorted((f.path, f.size) for f in files if f.is_file and f.size and not f.base_name.startswith((".", "_")))
            return [Range(name, start, min(start + self.split, size)) for name, size in names for start in range(0, size, self.split)]

        def read(self, partition):
            import pyarrow as pa

            store, _ = self.store()
            with store.open_input_file(partition.file) as f:
                for start in range(partition.start, partition.stop, self.size):
                    data = f.read_at(min(self.size, partition.stop - start), start)
                    yield pa.RecordBatch.from_arrays([pa.array([partition.file]), pa.array([start // self.size], pa.int64()), pa.array([data], pa.binary())], names=["stream", "block", "data"])

    class FlatTokens(DataSource):
        @classmethod
        def name(cls):
            return "flat_tokens"

        def schema(self):
            return "stream string, block long, data binary"

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(FlatTokens)
    return spark.read.format("flat_tokens").option("block_bytes", str(width * block_tokens)).option("split_bytes", str(split_bytes)).load(path)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Writes ``docs`` as token streams of two-byte ids, one a task, and gives their blocks and the order of the documents.

    The order (stream, ordinal, id) is kept beside the streams; the scan does not read it.
    """
    from docketspark.llm.bpe import coder_for

    if end_id > 0xFFFF:
        raise ValueError("the separator does not fit two bytes")
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = {"long": pa.int64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stream, block, ordinal = TaskContext.get().partitionId(), 0, 0
        rest = np.zeros(0, np.uint16)
        end = np.array([end_id], np.uint16)

        def blocks_of(parts: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal block
            data = [p.tobytes() for p in parts]
            n = len(data)
            out = [pa.array([stream] * n, kinds["long"]), pa.array(range(block, block + n), kinds["long"]), pa.array(data, kinds["binary"]), pa.nulls(n, kinds["long"]), pa.nulls(n, id_type)]
            block += n
            return pa.RecordBatch.from_arrays(out, names=names)

        names = ["stream", "block", "data", "ordinal", "id"]
        id_type = None
        for batch in batches:
            id_type = batch.column("id").type
            parts = [rest]
            for packed in coder_for(sent.value).slices(filled(batch.column("text"))):
                for ids in (np.frombuffer(p, np.uint32) for p in packed):
                    if len(ids) and ids.max() > 0xFFFF:
                        raise ValueError("an id does not fit two bytes")
                    parts += [ids.astype(np.uint16), end]
            tokens = np.concatenate(parts)
            whole = len(tokens) // block_tokens * block_tokens
            if whole:
                yield blocks_of(np.split(tokens[:whole], whole // block_tokens))
            rest = tokens[whole:]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([stream] * n, kinds["long"]), pa.nulls(n, kinds["long"]), pa.nulls(n, kinds["binary"]), pa.array(range(ordinal, ordinal + n), kinds["long"]), batch.column("id")], names=names)
            ordinal += n
        if len(rest):
            yield blocks_of([rest])

    packed = cut(rows.mapInArrow(lean(run), f"stream long, block long, data binary, ordinal long, id {rows.schema['id'].dataType.simpleString()}"), "token-streams")
    return packed.filter("block is not null").select("stream", "block", "data"), packed.filter("ordinal is not null").select("stream", "ordinal", "id")


def separators(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """Per block: stream, block, n_tokens, ends (positions of separators in the block)."""
    kind = {1: "<u1", 2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for data in batch.column("data"):
                raw = data.as_buffer() if data.is_valid else b""
                tokens = np.frombuffer(raw, kind, len(raw) // width)
                sizes.append(len(tokens))
                ends.append(np.flatnonzero(tokens == end_id))
            yield pa.RecordBatch.from_arrays([batch.column("stream"), batch.column("block"), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["stream", "block", "n_tokens", "ends"])

    given = blocks.select("stream", "block", "data")
    return given.mapInArrow(lean(run), f"stream {given.schema['stream'].dataType.simpleString()}, block {given.schema['block'].dataType.simpleString()}, n_tokens long, ends array<bigint>")


def count_tokens(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """Per document: stream, ordinal, start (its first token's position in the stream), n_tokens, ended."""
    found = cut(separators(blocks, end_id, width), "separators").withColumn("part", F.expr(f"block div {GROUP_BLOCKS}"))
    one = found.select("stream", "part", "block", "n_tokens", F.size("ends").cast("long").alias("n_ends"), F.try_element_at("ends", F.lit(-1)).alias("last_end"))
    before = W.partitionBy("stream", "part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    inner = one.select("stream", "part", "block", "n_tokens", "n_ends", "last_end", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("ends_before"))
    inner = inner.withColumn("end_at", F.col("base") + F.col("last_end")).withColumn("end_before", F.max("end_at").over(before))
    groups = inner.groupBy("stream", "part").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_ends").alias("n_ends"), F.max("end_at").alias("end_at"))
    earlier = W.partitionBy("stream").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    outer = groups.withColumn("group_base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).withColumn("group_ends", F.coalesce(F.sum("n_ends").over(earlier), F.lit(0)))
    outer = outer.withColumn("group_end_before", F.max(F.col("group_base") + F.col("end_at")).over(earlier))
    carried = inner.join(outer.select("stream", "part", "group_base", "group_ends", "group_end_before"), ["stream", "part"]).select(
        "stream",
        "block",
        (F.col("group_base") + F.col("base")).alias("base"),
        (F.col("group_ends") + F.col("ends_before")).alias("ends_before"),
        F.coalesce(F.col("group_base") + F.col("end_before"), F.col("group_end_before"), F.lit(-1)).alias("end_before"),
    )
    stitched = found.select("stream", "block", "ends").filter(F.size("ends") > 0).join(carried, ["stream", "block"])
    docs = stitched.select("stream", "base", "ends_before", "end_before", "ends", F.posexplode("ends").alias("k", "end")).select(
        "stream",
        (F.col("ends_before") + F.col("k")).alias("ordinal"),
        (F.when(F.col("k") == 0, F.col("end_before")).otherwise(F.col("base") + F.get("ends", F.col("k") - 1)) + 1).alias("start"),
        (F.col("base") + F.col("end")).alias("stop"),
        F.lit(True).alias("ended"),
    )
    totals = outer.groupBy("stream").agg(F.sum("n_ends").alias("ordinal"), (F.coalesce(F.max(F.col("group_base") + F.col("end_at")), F.lit(-1)) + 1).alias("start"), F.sum("n_tokens").alias("stop"))
    left = totals.filter("stop > start").select("stream", "ordinal", "start", "stop", F.lit(False).alias("ended"))
    return docs.unionByName(left).select("stream", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "ended")
