"""Cost-balanced packing of tokenised documents into sequences.

A piece of n tokens costs ``n + quadratic * n**2``. Within a block of documents, pieces go in
descending order to the sequence of least cost that still has room; what fits in none is cut and goes
back in the queue, so all sequences of a block are filled and only what is left over moves on to the
next block. Blocks are bounded in tokens, and nothing is shuffled: each task packs the rows it scans.
The last left-over tokens of a task fill sequences of descending powers of two, which need no padding.

Defined cases: a null or empty text is one end token; longer texts than a sequence are cut; repeated
rows are packed each; an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import heapq
import os
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewise
from .shared import light_batches

CAPACITY = 4096
BLOCK = 1024
QUADRATIC = 1 / 2048
#: Texts encoded at a time: workers of all cores of an executor hold their slices at once, beside its heap.
SLICE_BYTES = 1 << 21
CACHE = 300_000
#: Pieces of a batch that goes back, 8 MB of ids at most with sequences of 4,096: a worker and its executor hold copies of it.
PIECES = 512
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of whole texts by a tokenizer whose tokens never cross white space.

    Of each slice of texts, the distinct stretches between ASCII blanks are normalised and split together;
    each distinct word is encoded once and then looked up. When too many words are held, those met in the
    fewest slices go. Texts that hold a special token's string are encoded by the tokenizer as they are.
    """

    def __init__(self, path: str, cache: int = CACHE):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.words = Tokenizer(self.whole.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # fixed value: how this vocabulary splits a text before merging; a line break ends a stretch
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n").findall
        self.cache = cache
        # of each word held: where its ids begin, how many they are, in how many slices it was met
        self.places = numbered(["\n"])
        self.starts, self.lengths, self.met = (np.zeros(1, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.uint32)

    def split(self, stretches: pa.Array) -> list[str]:
        """The words of all stretches, a line break after each stretch."""
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(stretches)], stretches), "\n")[0].as_py() + "\n" if len(stretches) else ""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no other letter is lowered by what follows it
        return self.pieces(text.lower())

    def learn(self, words: list[str]) -> None:
        runs = [" ".join(words[at : at + 500]) for at in range(0, len(words), 500)]
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in self.words.encode_batch_fast(runs, add_special_tokens=False)])
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            raise ValueError("the vocabulary doesn't mark word ends")
        starts = np.concatenate(([0], cuts[:-1]))
        self.starts = np.concatenate((self.starts, starts + len(self.ids)))
        self.lengths = np.concatenate((self.lengths, cuts - starts))
        self.met = np.concatenate((self.met, np.zeros(len(words), np.int64)))
        self.ids = np.concatenate((self.ids, ids))

    def forget(self) -> None:
        """Keep the half of the words that were met most often."""
        names = list(self.places)
        keep = np.sort(1 + np.argsort(-self.met[1:], kind="stable")[: self.cache // 2])
        keep = np.concatenate(([0], keep))
        self.ids = self.ids[stretch_places(self.starts[keep], self.lengths[keep])]
        self.lengths, self.met = self.lengths[keep], self.met[keep] // 2
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.places = numbered(names[k] for k in keep.tolist())

    def lookup(self, words: list[str]) -> np.ndarray:
        """Place of each word in the tables."""
        if len(self.places) > self.cache:
            self.forget()
        at = np.array(list(map(self.places.__getitem__, words)), np.int64)
        if new := list(islice(self.places, len(self.starts), None)):
            self.learn(new)
        self.met += np.bincount(at, minlength=len(self.met)) > 0
        return at

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; nulls are empty."""
        texts = texts.fill_null("")
        special = np.zeros(len(texts), bool)
        for token in self.special:
            special |= np.array(pc.match_substring(texts, token))
        split = pc.ascii_split_whitespace(texts)
        bounds = np.array(split.offsets)
        coded = split.flatten().dictionary_encode()
        words = self.lookup(self.split(coded.dictionary))
        breaks = np.flatnonzero(words == 0)
        before = np.concatenate(([0], np.cumsum(self.lengths[words])))
        cuts = np.concatenate(([0], before[breaks]))
        known = self.ids[stretch_places(self.starts[words], self.lengths[words])]  # the stretches' ids, one after the other
        at = np.array(coded.indices)
        each = np.diff(cuts)[at]
        ends = np.concatenate(([0], np.cumsum(each)))
        flat = known[stretch_places(cuts[:-1][at], each)]
        out = np.split(flat, ends[bounds[1:-1] - bounds[0]]) if len(texts) else []
        for i in np.flatnonzero(special):
            out[i] = np.array(self.whole.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
        return out


def numbered(names: Iterable[str]) -> defaultdict[str, int]:
    """Numbers from 0 for the names, and further ones for whatever is asked next."""
    places = defaultdict(count().__next__)
    for name in names:
        places[name]
    return places


def stretch_places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of runs that begin at ``starts``, one run after the other."""
    ends = np.cumsum(lengths)
    places = np.repeat(starts - (ends - lengths), lengths)
    places += np.arange(len(places))
    return places


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def fill(lengths: list[int], sequences: int, capacity: int, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """(item, start, length, sequence, offset) of placed pieces, and (item, start, length) of the rest.

    Fills ``sequences`` sequences whole if the lengths suffice.
    """
    queue = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    # a heap of (cost, sequence) for each room, and a tree over rooms that holds the least of each subtree
    size, none = 1 << capacity.bit_length(), (float("inf"), -1)
    by_room: dict[int, list[tuple[float, int]]] = {capacity: [(0.0, s) for s in range(sequences)]}
    least = [none] * (2 * size)

    def renew(free: int) -> None:
        node, value = free + size, by_room[free][0] if by_room[free] else none
        while least[node] != value:
            least[node] = value
            node >>= 1
            if not node:
                break
            value = min(least[2 * node], least[2 * node + 1])

    def cheapest(need: int) -> tuple[float, int]:
        """Of the sequences with so much room at least."""
        node = need + size
        best = least[node]
        while node > 1:
            if not node & 1:
                best = min(best, least[node + 1])
            node >>= 1
        return best

    renew(capacity)
    room = [capacity] * sequences
    placed = []
    while queue and least[1] != none:
        n, item, start = heapq.heappop(queue)
        n = -n
        found = cheapest(n) if n <= capacity else none
        cost, s = least[1] if found == none else found
        free = room[s]
        heapq.heappop(by_room[free])
        renew(free)
        put = min(n, free)
        placed.append((item, start, put, s, capacity - free))
        room[s] -= put
        if put < n:
            heapq.heappush(queue, (put - n, item, start + put))
        if room[s]:
            heapq.heappush(by_room.setdefault(room[s], []), (cost + put + quadratic * put * put, s))
            renew(room[s])
    return placed, sorted((item, start, -n) for n, item, start in queue)


_NAMES = ["_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]


class Packer:
    """Packs the documents of one task, block by block."""

    def __init__(self, task: int, kind: pa.DataType, capacity: int, block: int, quadratic: float):
        self.capacity, self.most, self.quadratic = capacity, block * capacity, quadratic
        self.sequence, self.kind = task << 32, kind
        self.items: list[tuple[object, int, np.ndarray, int]] = []  # id, start, ids, tokens of the document
        self.tokens = 0

    def add(self, key: object, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.items.append((key, 0, ids, len(ids)))
        self.tokens += len(ids)
        if self.tokens >= self.most:
            yield from self.flush(self.tokens // self.capacity, self.capacity)

    def flush(self, sequences: int, capacity: int) -> Iterator[pa.RecordBatch]:
        placed, rest = fill([len(x[2]) for x in self.items], sequences, capacity, self.quadratic)
        placed.sort(key=lambda p: (p[3], p[4]))
        for at in range(0, len(placed), PIECES):
            rows = [(self.items[i], start, n, s, offset) for i, start, n, s, offset in placed[at : at + PIECES]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x, *_ in rows], self.kind),
                    pa.array([x[1] + start for x, start, *_ in rows], pa.int64()),
                    pa.array([x[2][start : start + n].tobytes() for x, start, n, *_ in rows], pa.binary()),
                    pa.array([x[3] for x, *_ in rows], pa.int64()),
                    pa.array([self.sequence + s for *_, s, _ in rows], pa.int64()),
                    pa.array([offset for *_, offset in rows], pa.int64()),
                ],
                _NAMES,
            )
        self.sequence += sequences
        left = []
        for i, start, n in rest:
            key, low, ids, total = self.items[i]
            left.append((key, low + start, ids[start : start + n].copy(), total))
        self.items, self.tokens = left, sum(len(x[2]) for x in left)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.tokens >= self.capacity:
            yield from self.flush(self.tokens // self.capacity, self.capacity)
        while self.tokens:
            yield from self.flush(1, 1 << (self.tokens.bit_length() - 1))


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, block: int = BLOCK, quadratic: float = QUADRATIC,
) -> DataFrame:
    """One row per piece: id, ``start``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``."""
    light_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer_path).encode, None
        end = np.array([end_id], np.uint32)
        for batch in batches:
            packer = packer or Packer(TaskContext.get().partitionId(), batch.column(0).type, capacity, block, quadratic)
            sizes = np.cumsum(np.array(pc.binary_length(batch.column(1).fill_null(""))))
            row = 0
            while row < batch.num_rows:
                before = sizes[row - 1] if row else 0
                high = max(row + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
                keys = batch.column(0).slice(row, high - row).to_pylist()
                for key, ids in zip(keys, encode(batch.column(1).slice(row, high - row))):
                    yield from packer.add(key, np.concatenate((ids, end)))
                row = high
        if packer:
            yield from packer.close()

    schema = f"_id {kind}, start long, ids binary, doc_tokens long, sequence_id long, offset long"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(bytewise.tidied(packed), schema)
    return rows.withColumnRenamed("_id", id_col)
