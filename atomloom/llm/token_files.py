"""Token-ID output: documents as ORC files of token ids in ascending doc_id order.

Spark's ORC writer stores each document's ids with integer run-length encoding, in stripes with
row indexes and a Bloom filter on doc_id. Readers split files by stripe, and a filter on doc_id
skips files, stripes and row groups by their metadata.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atomloom.llm.common import new_folder, valid_text, worker_cache
from atomloom.llm.words import gather, slices, split_words, stops_of

END_ID = 2
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(32 * 2**20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}

#: Letters that normalisation leaves as they are, but for A-Z, and that make one unit for the vocabulary; a run of marks makes another.
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_MARKS = string.punctuation


def _tokenizer(path: str):
    held = worker_cache()
    if path not in held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        held[path] = Tokenizer.from_file(path)
    return held[path]


def word_ids(tokenizer, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each of ``words``, end to end, and where each stops.

    Letters with marks behind them are two units, so the vocabulary is asked for either at once,
    in lower case. All other words take the library's whole way as they stand: control tokens
    match with case, and so do letters with combining marks.
    """
    lower = pc.ascii_lower(words)
    core, tail = pc.utf8_rtrim(lower, _MARKS), pc.utf8_ltrim(lower, _LETTERS)
    plain = pc.match_substring_regex(core, f"^[{_LETTERS}]+$").to_numpy(zero_copy_only=False)
    cores, tails = (x.filter(pa.array(plain)).dictionary_encode() for x in (core, tail))
    letters = str.maketrans({c: tokenizer.pre_tokenizer[1].pre_tokenize_str(c)[0][0] for c in _LETTERS})
    tokenize = tokenizer.model.tokenize
    lists = [[t.id for t in tokenize(c)] for c in " ".join(cores.dictionary.to_pylist()).translate(letters).split(" ")] if len(cores) else []
    others = tails.dictionary.to_pylist() + words.filter(pa.array(~plain)).to_pylist()
    lists += [x.ids for x in tokenizer.encode_batch_fast(others, add_special_tokens=False)]
    stops = stops_of(np.fromiter(map(len, lists), np.int64, len(lists)))
    flat = np.fromiter(chain.from_iterable(lists), np.int32, stops[-1])
    # Each word is two lists; one of those besides the plain words is followed by an empty one.
    n_cores, n_tails = len(cores.dictionary), len(tails.dictionary)
    parts = np.empty((len(words), 2), np.int64)
    parts[plain, 0] = cores.indices.to_numpy()
    parts[plain, 1] = tails.indices.to_numpy() + n_cores
    parts[~plain, 0] = np.arange(len(lists) - n_cores - n_tails) + n_cores + n_tails
    parts[~plain, 1] = len(lists)
    flat, ends = gather(flat, np.append(stops, stops[-1]), parts.ravel())
    return flat, ends[::2]


def _encode(path: str, end_id: int):
    """Encodes by distinct word: no token of these tokenizers spans white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, place = _tokenizer(path), 0
        for batch in slices(batches):
            offsets, index, words = split_words(batch.column("text"))
            ids, ends = gather(*word_ids(tokenizer, words), index)
            ends = ends[offsets]
            ids = np.insert(ids, ends[1:], end_id)
            ends = (ends + np.arange(len(ends))).astype(np.int32)
            places = pa.array(np.arange(place, place + batch.num_rows))
            place += batch.num_rows
            yield pa.record_batch([batch.column("doc_id"), places, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["doc_id", "place", "ids"])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, *, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id long, text string; others are ignored) and write ORC files to ``folder``.

    Rows: doc_id, place (in its file, from 0), n_tokens, ids (with ``end_id`` at the end), one for each row of ``docs``. Files
    follow each other in doc_id order by name, and rows within them; a null doc_id comes first,
    repeated rows stand together, ordered by text. A null or empty text is the end id alone; bytes
    that are no UTF-8 count as U+FFFD. An
    empty table makes an empty folder that can be read.

    The tokenizer must drop white space and lower-case its input, as ``word_bpe_49k.json`` does.
    Texts, not ids, are shuffled, in ranges of doc_id, so encoding happens once and in file order.
    """
    rows = docs.select("doc_id", valid_text("text")).repartitionByRange(F.col("doc_id").asc()).sortWithinPartitions("doc_id", "text")
    encoded = rows.mapInArrow(_encode(tokenizer_path, end_id), "doc_id long, place long, ids array<int>")
    encoded.select("doc_id", "place", F.size("ids").cast("long").alias("n_tokens"), "ids").write.options(**ORC_OPTIONS).orc(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the files, with the file each is in; filters on doc_id are pushed to ORC's metadata."""
    rows = spark.read.schema("doc_id long, place long, n_tokens long, ids array<int>").orc(folder)
    return rows.select("doc_id", "place", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat = ids.values.to_numpy().astype("<u4")
        at = ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[i:j]) for i, j in zip(at, at[1:])]
        names = [n for n in batch.schema.names if n != "ids"]
        yield pa.record_batch([*(batch.column(n) for n in names), pa.array(crc, pa.int64())], names=[*names, "ids_crc32"])


def token_starts(rows: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` (doc_id, n_tokens, file, others) with ``start``: the ids of all rows before, in the order of the files.

    Rows of one doc_id are told apart by ``place``; without it they must be alike.

    A file is a range of documents, so its own total is a partial sum: running sums within each
    file are added to the sum of the files of smaller doc_ids. Only one row a file meets in one place.
    """
    order = ["place"] if "place" in rows.columns else ["doc_id"]
    within = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = (rows if sizes is None else sizes).groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("first"))
    before = totals.select("file", F.coalesce(F.sum("total").over(Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(before, "file").withColumn("start", F.col("before") + F.col("within")).drop("before", "within", "file")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    read = read_token_files(spark, folder)
    checked = read.mapInArrow(_crc, "doc_id long, place long, n_tokens long, file string, ids_crc32 long")
    return token_starts(checked, read).select("doc_id", "start", "n_tokens", "ids_crc32")
