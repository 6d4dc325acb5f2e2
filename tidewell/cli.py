"""Command line: ``python -m tidewell.cli COMMAND``.

gate              grades predictions or a baseline against an evaluation set, prints the report
evalset           draws a stratified evaluation set from raw questions
train-tokenizer   learns merges from a byte-budgeted sample of documents
tokenize          encodes documents, fills chunks, and writes training and validation shards with their totals
"""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import bpe, corpus, evalset, gate, validator
from tidewell.sources import jsonl, shards, storage


def credential(names: Iterable[str]) -> str | None:
    """The first of these environment variables that is set and not empty."""
    return next((v for n in names if (v := os.environ.get(n))), None)


def _tokenizer_file(spark: SparkSession, path: str) -> str:
    path = storage.qualified(spark, path)
    return path if path.endswith(".json") else f"{path}/tokenizer.json"


def save_tokenizer(spark: SparkSession, merges: list[tuple[int, int, int, int]], path: str) -> None:
    """Writes tokenizer.json in a folder, or the named .json file, as the tokenizers library reads it."""
    fs, name = storage.filesystem(_tokenizer_file(spark, path))
    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(name) as out:
        out.write(bpe.to_json(merges).encode())


def load_tokenizer(spark: SparkSession, path: str) -> list[tuple[int, int, int, int]]:
    """The merges of a tokenizer file."""
    fs, name = storage.filesystem(_tokenizer_file(spark, path))
    with fs.open_input_stream(name) as file:
        return bpe.from_json(file.read().decode())


def _documents(spark: SparkSession, path: str, budget: int) -> DataFrame:
    docs = spark.read.parquet(path).select(F.col("doc_id").alias("pos"), "text")
    return docs.join(corpus.byte_budget_prefix(docs, budget).select("pos"), "pos")


def run_gate(spark: SparkSession, a: argparse.Namespace) -> None:
    examples = jsonl.read(spark, a.eval, jsonl.EXAMPLE)
    preds = jsonl.read_predictions(spark, a.preds) if a.preds else None
    grades = validator.graded(gate.outputs(examples, preds=preds, baseline=a.baseline))
    told = gate.report_json(grades, a.preds or f"baseline:{a.baseline}").first().report
    print(told)
    if a.out:
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(told)


def run_evalset(spark: SparkSession, a: argparse.Namespace) -> None:
    drawn = evalset.stratified(evalset.project(jsonl.read(spark, a.raw, jsonl.RAW_QUESTION)), a.each, a.seed)
    evalset.write_jsonl(drawn, a.out)
    counts = drawn.groupBy((F.size("answers") > 0).alias("answerable")).count().collect()
    print(json.dumps({("answerable" if r.answerable else "unanswerable"): r["count"] for r in counts}, sort_keys=True))


def run_train(spark: SparkSession, a: argparse.Namespace) -> None:
    words = bpe.word_counts(_documents(spark, a.documents, int(a.sample_gb * 1e9)))
    merges = bpe.train({r.piece.encode(): r.cnt for r in words.toLocalIterator()}, a.vocab_size, a.min_frequency)
    save_tokenizer(spark, merges, a.out)
    print(json.dumps({"merges": len(merges), "vocab_size": len(bpe.SPECIALS) + 256 + len(merges)}))


def run_tokenize(spark: SparkSession, a: argparse.Namespace) -> None:
    merges = load_tokenizer(spark, a.merges)
    found = bpe.encode(_documents(spark, a.documents, int(a.sample_gb * 1e9)), merges)
    ids = found.select("pos", corpus.append_end(F.col("ids")).alias("ids"))
    ids.write.mode("overwrite").parquet(f"{a.out}/ids")
    ids = spark.read.parquet(f"{a.out}/ids")
    chunked = corpus.flush_chunks(ids.select("pos", F.size("ids").cast("long").alias("n_tokens")), a.flush_every)
    routed = corpus.route_chunks(chunked, a.val_tokens)
    splits = chunked.join(routed.select("chunk_id", "split"), "chunk_id").select("pos", "split")
    shards.register(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for split in ("train", "val"):
        stream = corpus.token_stream(ids.join(splits.filter(F.col("split") == split), "pos").select("pos", "ids"))
        stream.repartitionByRange(n, "offset").sortWithinPartitions("offset").write.format("token_shard").mode("overwrite").option("path", storage.qualified(spark, f"{a.out}/{split}")).save()
    meta = corpus.shard_meta(routed, len(bpe.SPECIALS) + 256 + len(merges))
    meta.coalesce(1).write.mode("overwrite").json(f"{a.out}/meta")
    print(meta.toJSON().first())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewell", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(required=True)
    g = sub.add_parser("gate")
    g.add_argument("--eval", required=True)
    one = g.add_mutually_exclusive_group(required=True)
    one.add_argument("--preds")
    one.add_argument("--baseline", choices=sorted(gate.BASELINES))
    g.add_argument("--out")
    g.set_defaults(run=run_gate)
    e = sub.add_parser("evalset")
    e.add_argument("--raw", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--each", type=int, default=1000)
    e.add_argument("--seed", type=int, default=0)
    e.set_defaults(run=run_evalset)
    t = sub.add_parser("train-tokenizer")
    t.add_argument("--documents", required=True)
    t.add_argument("--out", required=True)
    t.add_argument("--vocab-size", type=int, default=32768)
    t.add_argument("--min-frequency", type=int, default=2)
    t.add_argument("--sample-gb", type=float, default=2.0)
    t.set_defaults(run=run_train)
    k = sub.add_parser("tokenize")
    k.add_argument("--documents", required=True)
    k.add_argument("--merges", required=True)
    k.add_argument("--out", required=True)
    k.add_argument("--sample-gb", type=float, default=2.0)
    k.add_argument("--flush-every", type=int, default=1_000_000)
    k.add_argument("--val-tokens", type=int, default=1_000_000)
    k.set_defaults(run=run_tokenize)
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(SparkSession.builder.appName("tidewell").getOrCreate(), a)


if __name__ == "__main__":
    main()
