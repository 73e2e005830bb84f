"""Token counts of documents in flat unindexed token files, by a separator scan.

A token file is a run of little-endian identifiers in which every document ends with the
end-of-document identifier; nothing says where documents are.  Files are cut into blocks of fixed
size that are scanned anywhere; each finds its separators by one vectorised comparison.  A prefix
scan over the blocks' separator counts and last separators, by file, then stitches documents that
cross block boundaries.  Files lie in a folder that all executors share and are read by range.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, shared

KIND = "<u2"
END_OF_TEXT = 50_256
#: Identifiers of a block, and of a file about.
BLOCK = 1 << 21


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")


def write(docs: DataFrame, folder: str, ranks_path: str, pattern_text: str, end: int = END_OF_TEXT, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Writes a token file for each partition; (file, nth, ``id_col``): the order within each.

    Null texts count as empty and leave a separator alone.  A repeated attempt writes another
    file; only files named in the result count.
    """

    def run(batches):
        encode = bpe.encoding(ranks_path, pattern_text).encode_ordinary
        name, nth, stream = f"{folder}/{uuid.uuid4().hex}.tokens", 0, None
        for b in batches:
            if stream is None:
                files, path = _opened(name)
                files.create_dir(path.rpartition("/")[0], recursive=True)
                stream = files.open_output_stream(path)
            for text in b.column(1).to_pylist():
                stream.write(np.array([*encode(text or ""), end], KIND).tobytes())
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(nth, nth + n)), b.column(0)], ["file", "nth", "id"])
            nth += n
        if stream is not None:
            stream.close()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return shared.stage(rows.mapInArrow(run, f"file string, nth bigint, id {dict(docs.dtypes)[id_col]}"), "token-order").withColumnRenamed("id", id_col)


def sizes(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(file, ids): identifiers in each file of column ``file``, asked of the store by executors."""

    def run(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            lengths = []
            for name in names:
                store, path = _opened(name)
                lengths.append(store.get_file_info(path).size // np.dtype(KIND).itemsize)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64())], ["file", "ids"])

    return files.select("file").distinct().mapInArrow(run, "file string, ids bigint")


def _scanned(end):
    def run(batches):
        size = np.dtype(KIND).itemsize
        for b in batches:
            for name, block, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, path = _opened(name)
                with store.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(n * size, at * size), KIND)
                ends = np.flatnonzero(ids == end) + at
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([at + n], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([ends[-1] if len(ends) else None], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], ["file", "block", "stop", "n", "last", "ends"])

    return run


def count(sizes_: DataFrame, end: int = END_OF_TEXT, block: int = BLOCK) -> DataFrame:
    """(file, nth, begin, n_tokens) of every document of files (file, ids).

    Identifiers after the last separator are a last document without one.  Empty files have none.
    """
    cut = sizes_.where("ids > 0").select("file", "ids", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("ids") - 1) / block))).alias("block"))
    blocks = cut.select("file", "block", (F.col("block") * block).alias("at"), F.least(F.lit(block), F.col("ids") - F.col("block") * block).alias("n"))
    scanned = shared.stage(blocks.repartition("file", "block").mapInArrow(_scanned(end), "file string, block bigint, stop bigint, n bigint, last bigint, ends array<bigint>"), "token-blocks")
    # the prefix scan sees a few numbers of each block, not its separators
    by_file = Window.partitionBy("file").orderBy("block")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    scan = scanned.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("nth"), F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(-1)).alias("past"), F.lead("block").over(by_file).isNull().alias("final"))
    stitched = scanned.select("file", "block", "stop", "ends").join(scan, ["file", "block"])
    found = stitched.withColumn("ends", F.when(F.col("final") & (F.coalesce(F.try_element_at("ends", F.lit(-1)), F.col("past")) < F.col("stop") - 1), F.concat("ends", F.array("stop"))).otherwise(F.col("ends")))
    each = found.select("file", F.col("nth").alias("base"), F.posexplode(F.transform("ends", lambda e, i: F.struct(e.alias("stop"), F.when(i > 0, F.get("ends", i - 1)).otherwise(F.col("past")).alias("past")))).alias("i", "e"))
    return each.select("file", (F.col("base") + F.col("i")).alias("nth"), (F.col("e.past") + 1).alias("begin"), (F.col("e.stop") - F.col("e.past") - 1).alias("n_tokens"))
