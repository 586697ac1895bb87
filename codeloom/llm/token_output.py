"""Token ids of documents as files of range-coded blocks.

Documents are dealt by ranges of their keys and sorted, so the tasks in order hold them in
ascending order. Each task encodes its texts as they stream by and closes a file when it
holds ``FILE_TOKENS`` ids, always at the end of a document. A file is one row of the
output table: its bytes, and the keys and lengths of its documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import over_arrow, slices, table, trim
from codeloom.llm.range_coder import decode_file, encode_file
from codeloom.llm.totals import part_offsets
from codeloom.llm.words_tokenizer import BATCH_BYTES, vocabulary_path, worker_tokenizer
from codeloom.session import run_folder

END_ID = 1
FILE_TOKENS = 4 << 20
_FILES = "part int, seq int, base long, n_tokens long, keys array<long>, lens array<long>, data binary"
_DOCS = "part int, doc_id long, at long, n_tokens long, ids binary"


@dataclass(frozen=True)
class TokenFiles:
    folder: str

    def read(self, spark: SparkSession) -> DataFrame:
        """(doc_id, start, n_tokens, ids) decoded from the files; ids are little-endian 32-bit numbers.

        ``start`` counts the ids of all documents before. A damaged block ends the read with an error.
        """
        files = spark.read.parquet(self.folder)

        def work(batches):
            for batch in batches:
                for row in range(batch.num_rows):
                    x = batch.slice(row, 1).to_pylist()[0]
                    trim()
                    ids = decode_file(x["data"]).astype("<u4")
                    lens = np.array(x["lens"], np.int64)
                    ends = np.cumsum(lens)
                    if (ends[-1] if len(ends) else 0) != len(ids):
                        raise ValueError(f"file {x['part']}-{x['seq']} does not hold the ids of its documents")
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(lens), x["part"], np.int32)), pa.array(x["keys"], pa.int64()),
                        pa.array(x["base"] + ends - lens), pa.array(lens), pa.array([ids[a:b].tobytes() for a, b in zip(ends - lens, ends, strict=True)], pa.binary()),
                    ], names=["part", "doc_id", "at", "n_tokens", "ids"])

        docs = over_arrow(files, work, _DOCS)
        offsets = part_offsets(files.select("part", "n_tokens"), "part", "n_tokens")
        docs = docs.join(F.broadcast(offsets), "part")  # a row for each task that wrote
        return docs.select("doc_id", (F.col("ahead") + F.col("at")).alias("start"), "n_tokens", "ids")


def write_tokens(docs: DataFrame, folder: str | None = None, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> TokenFiles:
    """Encode whole texts, append ``end_id`` to each, and write files in ascending order of ``key``.

    Null texts are empty: their end id alone. Null keys come first; rows with equal keys are
    ordered by their texts' hashes, and repeated rows are all written. Other columns are not
    written. An empty table gives an empty output table.
    """
    folder = folder or run_folder(docs.sparkSession, "tokens")
    path = vocabulary or vocabulary_path()
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))

    def work(batches):
        part, seq, base = TaskContext.get().partitionId(), 0, 0
        ids, keys, lens, held = [], [], [], 0
        tokenizer = worker_tokenizer(path)

        def close():
            trim()
            data = encode_file(np.concatenate(ids))
            row = {"part": [part], "seq": [seq], "base": [base], "n_tokens": [held], "keys": [np.concatenate(keys)], "lens": [np.concatenate(lens)], "data": [data]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("base", pa.int64()), ("n_tokens", pa.int64()), ("keys", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("data", pa.binary())]))

        for batch in slices(batches, "t", BATCH_BYTES):
            found, sizes = tokenizer.encode(batch.column("t"), end_id)
            found, ends, at = found.astype(np.uint16), np.cumsum(sizes), 0
            named = np.array(batch.column("k").to_pylist(), object)
            while at < len(sizes):
                done = int(ends[at - 1]) if at else 0
                to = min(len(sizes), max(at + 1, int(np.searchsorted(ends, done + file_tokens - held, "right"))))
                ids.append(found[done : ends[to - 1]])
                keys.append(named[at:to])
                lens.append(sizes[at:to])
                held += int(ends[to - 1]) - done
                at = to
                if held >= file_tokens or at < len(sizes):
                    yield close()
                    seq, base = seq + 1, base + held
                    ids, keys, lens, held = [], [], [], 0
        if held:
            yield close()

    dealt = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h")
    over_arrow(dealt, work, _FILES).write.mode("errorifexists").parquet(folder)
    return TokenFiles(folder)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = write_tokens(table(spark, sf_dir, "documents")).read(spark)
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
