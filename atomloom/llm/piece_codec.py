"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are joined to one text, which is indexed by a suffix array. Every piece
of the vocabulary is looked up by binary search and gives a range of occurrences; these edges are
sorted by position, and then relaxed to one path through each word.

The public vocabulary is of the byte-pair kind, so an edge's cost is its merge rank and the path
is relaxed by the least rank first, over the words of the batch at once. (A shortest path by
summed scores, as for unigram vocabularies, would give other pieces than the library's.)
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.llm.common import valid_text, worker_cache
from atomloom.llm.words import distinct, gather, slices, stops_of

SPACE = "▁"
#: Characters indexed at a time.
INDEXED_CHARS = 300_000
#: Longer units than this are merged one by one with a heap, as rounds over all units merge once a unit.
LONG_UNIT = 256
NONE = np.iinfo(np.int32).max
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")


class Vocabulary:
    """The pieces of a model file, sorted for binary search."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(len(model))
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        self.unknown = model.unk_id()
        normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        normal.sort(key=model.id_to_piece)
        pieces = [model.id_to_piece(i) for i in normal]
        self.longest = max(map(len, pieces))
        kind = f"<U{self.longest}"
        self.low = np.array(pieces, kind)
        self.high = np.array([p.ljust(self.longest, "\U0010ffff") for p in pieces], kind)
        self.length = np.array(list(map(len, pieces)), np.int32)
        self.id = np.array(normal, np.int32)
        # Merge ranks: scores descend, so the best is 0.
        by_score = sorted(range(len(pieces)), key=lambda k: -model.get_score(normal[k]))
        self.rank = np.empty(len(pieces), np.int32)
        self.rank[by_score] = np.arange(len(pieces))
        self.id_of_rank = np.empty(len(pieces), np.int32)
        self.id_of_rank[self.rank] = self.id
        # Which characters may stand side by side in a piece: a number for each that is in a longer one (0: none), and a table of pairs.
        inner = sorted({c for p in pieces if len(p) > 1 for c in p})
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[list(map(ord, inner))] = np.arange(1, len(inner) + 1)
        self.joins = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for p in pieces:
            kinds = self.kind[list(map(ord, p))]
            self.joins[kinds[:-1], kinds[1:]] = True
        self.text = {i: model.id_to_piece(i).replace(SPACE, " ").encode() for i in normal} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.text |= {i: b"" for i in ids if model.is_control(i)} | {self.unknown: " ⁇ ".encode()}


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """The positions of ``codes`` in the order of what begins there, by prefix doubling up to ``depth`` characters."""
    own, rank = np.unique(codes, return_inverse=True)
    width, n = 1, len(codes)
    if len(own) < 2**15 - 1:  # four characters at once
        padded = np.concatenate((rank + 1, np.zeros(4, np.int64)))
        key = (padded[:n] << 45) | (padded[1 : n + 1] << 30) | (padded[2 : n + 2] << 15) | padded[3 : n + 3]
        width = 4
    else:
        key = rank.astype(np.int64)
    while True:
        order = np.argsort(key)
        if width >= depth or width >= n:
            return order
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], ordered[1:] != ordered[:-1])))
        after = np.zeros_like(rank)
        after[:-width] = rank[width:]
        key = rank * (n + 2) + after
        width *= 2


def edges(codes: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of pieces, sorted by start and length: (start, piece)."""
    order = suffix_array(codes, vocabulary.longest)
    padded = np.concatenate((codes, np.zeros(vocabulary.longest, codes.dtype)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, vocabulary.longest)[order]
    windows = np.ascontiguousarray(windows).view(vocabulary.low.dtype).ravel()
    first = np.searchsorted(windows, vocabulary.low, "left")
    count = np.searchsorted(windows, vocabulary.high, "right") - first
    piece = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    start = order[first[piece] + within]
    by_position = np.argsort(start * (vocabulary.longest + 1) + vocabulary.length[piece])
    return start[by_position], piece[by_position]


def relax(starts: np.ndarray, ends: np.ndarray, unit: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge neighbours within each unit, the least ``cost[start, length]`` first and the leftmost of equals, until none fits."""
    longest = cost.shape[1] - 1
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(starts):
        same = np.concatenate((unit[1:] == unit[:-1], [False]))
        span = np.concatenate((ends[1:] - starts[:-1], [0]))
        fits = same & (span <= longest)
        here = np.where(fits, cost[starts, np.where(fits, span, 0)], NONE)
        begins = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        sizes = np.diff(np.append(begins, len(unit)))
        best = np.minimum.reduceat(here, begins)
        open_ = np.repeat(best < NONE, sizes)
        done.append((starts[~open_], ends[~open_]))
        hits = np.flatnonzero(open_ & (here == np.repeat(best, sizes)))
        if len(hits):
            hits = hits[np.concatenate(([True], unit[hits][1:] != unit[hits][:-1]))]
            ends[hits] = ends[hits + 1]
            open_[hits + 1] = False
        starts, ends, unit = starts[open_], ends[open_], unit[open_]
    starts, ends = (np.concatenate(x) for x in zip(*done)) if done else (starts, ends)
    by_start = np.argsort(starts)
    return starts[by_start], ends[by_start]


def relax_long(first: int, stop: int, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``relax``, for the one unit from ``first`` to ``stop``: a heap of merges over linked neighbours, in n log n steps."""
    longest, n = cost.shape[1] - 1, stop - first
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins here; after is also where it ends
    alive = [True] * n
    table = cost[first:stop].tolist()

    def offer(i: int) -> None:
        j = after[i]
        if j < n and after[j] - i <= longest and table[i][after[j] - i] < NONE:
            heapq.heappush(heap, (table[i][after[j] - i], i, j, after[j]))

    heap: list[tuple[int, int, int, int]] = []
    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, end = heapq.heappop(heap)
        if not alive[i] or after[i] != j or not alive[j] or after[j] != end:
            continue  # one of the two has been merged since
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    starts = np.flatnonzero(alive)
    return starts + first, np.array(after)[starts] + first


def index_units(codes: np.ndarray, stops: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The piece ids of the units that ``stops`` cuts ``codes`` into, and how many each has. No unit is empty."""
    start, piece = edges(codes, vocabulary)
    cost = np.full((len(codes), vocabulary.longest + 1), NONE, np.int32)
    cost[start, vocabulary.length[piece]] = vocabulary.rank[piece]
    sizes = np.diff(stops)
    unit = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(np.repeat(sizes <= LONG_UNIT, sizes))
    found = [relax(at, at + 1, unit[at], cost)]
    found += [relax_long(int(stops[k]), int(stops[k + 1]), cost) for k in np.flatnonzero(sizes > LONG_UNIT)]
    starts, ends = (np.concatenate(x) for x in zip(*found))
    if len(found) > 1:
        order = np.argsort(starts)
        starts, ends = starts[order], ends[order]
    rank = cost[starts, ends - starts]
    ids = np.where(rank < NONE, vocabulary.id_of_rank[np.where(rank < NONE, rank, 0)], -1).astype(np.int32)
    unit, odd = unit[starts], np.flatnonzero(ids < 0)
    if len(odd):  # a character that is no piece: its bytes
        spelt = [[vocabulary.bytes.get(b, vocabulary.unknown) for b in chr(c).encode()] for c in codes[starts[odd]].tolist()]
        times = np.ones(len(ids), np.int64)
        times[odd] = list(map(len, spelt))
        ids, unit = np.repeat(ids, times), np.repeat(unit, times)
        ids[ids < 0] = [b for s in spelt for b in s]
    return ids, np.bincount(unit, minlength=len(sizes))


def word_pieces(words: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The piece ids of each of ``words``, with the space mark before it, end to end, and where each stops.

    Words are cut to units where two characters meet that no piece holds side by side; no piece
    spans a cut. Of the distinct units, so many are indexed together as make INDEXED_CHARS, cut at units' ends.
    """
    marked = [SPACE + w for w in words.to_pylist()]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    word_stops = stops_of(np.fromiter(map(len, marked), np.int64, len(marked)))
    del marked
    if not len(codes):
        return np.zeros(0, np.int32), word_stops
    kind = vocabulary.kind[codes]
    cut = np.concatenate(([True], ~vocabulary.joins[kind[:-1], kind[1:]], [True]))
    cut[word_stops] = True
    stops = np.flatnonzero(cut)
    spans = pa.Array.from_buffers(pa.large_binary(), len(stops) - 1, [None, pa.py_buffer(4 * stops), pa.py_buffer(codes)])
    _, index, units = distinct(pa.LargeListArray.from_arrays(pa.array([0, len(spans)], pa.int64()), spans))
    codes = np.frombuffer(b"".join(units.to_pylist()), np.uint32)
    sizes = pc.binary_length(units).to_numpy() // 4
    ends = stops_of(sizes)
    ids, counts, at = [], [], 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + INDEXED_CHARS, "right")) - 1)
        own, count = index_units(codes[ends[at] : ends[to]], ends[at : to + 1] - ends[at], vocabulary)
        ids.append(own)
        counts.append(count)
        at = to
    flat, unit_ends = gather(np.concatenate(ids), stops_of(np.concatenate(counts)), index)
    return flat, unit_ends[np.searchsorted(stops, word_stops)]


def words_of(text: str) -> list[str]:
    """The words of a text, each without the space mark before it. No piece has a mark behind another character."""
    return [run[1:] for run in _RUNS.findall(SPACE + text.replace(" ", SPACE))] if text else []


def encode_texts(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order in which ``texts`` come out, their ids, end to end, and where each stops."""
    # Texts whose words are parted by single spaces are split by Arrow, others one by one.
    odd = pc.match_substring_regex(texts, f"^$|^ | $|  |{SPACE}|\\A\\z").to_numpy(zero_copy_only=False)
    whole = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    single = pa.array([words_of(t) for t in texts.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))
    offsets, index, words = distinct(pa.concat_arrays([whole, single]))
    ids, ends = gather(*word_pieces(words, vocabulary), index)
    return np.concatenate((np.flatnonzero(~odd), np.flatnonzero(odd))), ids, ends[offsets]


def _held(path: str) -> Vocabulary:
    held = worker_cache()
    if path not in held:
        held[path] = Vocabulary(path)
    return held[path]


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            order, ids, ends = encode_texts(batch.column("text"), _held(path))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.record_batch([batch.column("doc_id").take(pa.array(order)), lists], names=["doc_id", "ids"])

    return run


def decode_ids(ids: np.ndarray, text: dict[int, bytes]) -> bytes:
    """The text of piece ids, less the space mark that encoding put first."""
    return b"".join(map(text.__getitem__, ids.tolist())).removeprefix(b" ")


def _decoder(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = _held(path).text
        for batch in batches:
            column = batch.column("ids")
            flat, at = column.values.to_numpy(), column.offsets.to_numpy()
            rows = [flat[i:j] for i, j in zip(at, at[1:])]
            decoded = [decode_ids(r, text) for r in rows]
            if not digest:
                own = [pa.array([d.decode(errors="replace") for d in decoded], pa.string())]
            else:
                own = [pa.array([len(r) for r in rows], pa.int64()), pa.array([zlib.crc32(r.astype("<u4")) for r in rows], pa.int64())]
                own.append(pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()))
            names = ["n_pieces", "ids_crc32", "decoded_sha256"] if digest else ["text"]
            yield pa.record_batch([batch.column("doc_id"), *own], names=["doc_id", *names])

    return run


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) for each row of ``docs`` (doc_id long, text string; others are ignored): the ids the library gives.

    ``model_path`` names a byte-pair model with byte fallback, identity normalisation and a space
    mark before the text; executors must be able to read it. A null or empty text has no ids.
    Repeated rows are encoded each; a null doc_id stays null. An empty table gives an empty one.
    Bytes that are no UTF-8 count as U+FFFD. Nothing is shuffled; a task holds a slice of a batch at a time.
    """
    return docs.select("doc_id", valid_text("text")).mapInArrow(_encoder(model_path), "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of ``encoded`` (doc_id long, ids array<int> without nulls); no ids give an empty text.

    A space mark that stood in a text comes back as a space; bytes that are no UTF-8 as replacement characters.
    """
    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(_decoder(model_path, False), "doc_id long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes it again: the number and checksum of its ids, and the decoded text's digest."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return encoded.mapInArrow(_decoder(path, True), "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string")
