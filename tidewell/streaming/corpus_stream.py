"""A corpus in blocks, and a stream over it that stops at a budget of text bytes.

``write`` lays documents out in the order of pos: JSON lines in files, and an index with a row a block (file, first byte, bytes,
documents, text bytes, text bytes before).  The stream's offset is the text bytes before a block; each micro-batch admits
blocks of about ``batchBytes``, a task reads one block by its bytes, and blocks after the one that reaches ``budget`` are
never opened.  Its rows are (pos, text, n_bytes, bytes_before), those of operators.corpus.byte_budget_prefix.

An offset is offered in a file beside the query's checkpoint (option ``progress``) before Spark gets it, so a query
that starts again goes on from there: a batch that failed is planned anew, with no block lost or read twice.  Each
trigger admits one step, so use a processing-time trigger; ``ingest`` runs until the budget is met.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators.corpus import sum_before
from tidewell.sources.storage import filesystem, publish

BLOCK_BYTES = 32 << 20
BATCH_BYTES = 1 << 30
INDEX = "_index"
SCHEMA = "pos long, text string, n_bytes long, bytes_before long"


def write(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> None:
    """Lays out docs (pos, text), pos distinct, at a qualified path; null texts are empty."""
    spark = docs.sparkSession

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, folder = filesystem(path)
        fs.create_dir(folder, recursive=True)
        own, name, out, at = f"{folder}/_{uuid.uuid4().hex}", None, None, 0
        blocks: list[tuple] = []
        first, start, n, size = 0, 0, 0, 0
        for batch in batches:
            for pos, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    name, out = f"docs-{pos:020d}.jsonl", fs.open_output_stream(own)
                if not n:
                    first, start = pos, at
                line = json.dumps({"pos": pos, "text": text}, ensure_ascii=False).encode() + b"\n"
                out.write(line)
                at, n, size = at + len(line), n + 1, size + len(text.encode())
                if size >= block_bytes:
                    blocks.append((first, name, start, at - start, n, size))
                    n, size = 0, 0
        if n:
            blocks.append((first, name, start, at - start, n, size))
        if out is not None:
            out.close()
            publish(fs, own, f"{folder}/{name}")
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        columns = zip(*blocks, strict=True) if blocks else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["pos", "file", "at", "size", "n_docs", "text_bytes"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("pos", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(parts, "pos").sortWithinPartitions("pos")
    blocks = f"{path}/_blocks"
    dealt.mapInArrow(run, "pos long, file string, at long, size long, n_docs long, text_bytes long").write.mode("overwrite").parquet(blocks)
    index = sum_before(spark.read.parquet(blocks), "text_bytes", "text_before")
    index.orderBy("pos").write.mode("overwrite").parquet(f"{path}/{INDEX}")


@dataclass
class Block(InputPartition):
    file: str
    at: int
    size: int
    before: int


class Reader(DataSourceStreamReader):
    def __init__(self, path: str, budget: int, batch_bytes: int, progress: str | None):
        self.path, self.budget, self.batch_bytes, self.progress = path, budget, batch_bytes, progress
        self.offered: int | None = None
        self.index: list[tuple[int, Block]] | None = None

    def blocks(self) -> list[tuple[int, Block]]:
        """(text bytes up to its end, block) of the blocks that the budget meets, in order: the first always."""
        if self.index is None:
            from pyarrow import dataset

            fs, folder = filesystem(self.path)
            found = dataset.dataset(f"{folder}/{INDEX}", filesystem=fs, format="parquet", exclude_invalid_files=False)
            rows = found.to_table(filter=(dataset.field("text_before") < self.budget) | (dataset.field("text_before") == 0)).to_pylist()
            rows.sort(key=lambda r: r["pos"])
            self.index = [(r["text_before"] + r["text_bytes"], Block(f"{folder}/{r['file']}", r["at"], r["size"], r["text_before"])) for r in rows]
        return self.index

    def initialOffset(self) -> dict:
        return {"blocks": 0}

    def latestOffset(self) -> dict:
        if self.offered is None:
            self.offered = self._told()
        admitted, before = self.offered, None
        for end, block in self.blocks()[self.offered :]:
            before = block.before if before is None else before
            if admitted > self.offered and end - before > self.batch_bytes:
                break
            admitted += 1
        if admitted > self.offered:
            self.offered = admitted
            self._tell()
        return {"blocks": self.offered}

    def _told(self) -> int:
        if not self.progress:
            return 0
        fs, name = filesystem(self.progress)
        if not fs.get_file_info(name).is_file:
            return 0
        with fs.open_input_file(name) as file:
            return int(file.read())

    def _tell(self) -> None:
        if self.progress:
            fs, name = filesystem(self.progress)
            fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(name) as out:
                out.write(str(self.offered).encode())

    def partitions(self, start: dict, end: dict) -> list[Block]:
        return [block for _, block in self.blocks()[start["blocks"] : end["blocks"]]]

    def read(self, block: Block) -> Iterator[tuple]:
        fs, _ = filesystem(self.path)
        with fs.open_input_file(block.file) as file:
            file.seek(block.at)
            data = file.read(block.size)
        before, first = block.before, not block.before and not block.at
        for line in data.split(b"\n")[:-1]:
            row = json.loads(line)
            size = len(row["text"].encode())
            if before >= self.budget and (before or not first):
                return
            first = False
            yield row["pos"], row["text"], size, before
            before += size

    def commit(self, end: dict) -> None:
        pass


class CorpusStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_stream"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        o = self.options
        return Reader(o["path"], int(o["budget"]), int(o.get("batchBytes", BATCH_BYTES)), o.get("progress"))


def read(spark: SparkSession, path: str, budget: int, batch_bytes: int = BATCH_BYTES, progress: str | None = None) -> DataFrame:
    """The stream over a corpus at a qualified path; progress is a qualified file name, which queries do not share."""
    spark.dataSource.register(CorpusStream)
    reader = spark.readStream.format("corpus_stream").option("budget", budget).option("batchBytes", batch_bytes)
    return (reader.option("progress", progress) if progress else reader).load(path)


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream as Parquet until its budget is met."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start(out)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query
