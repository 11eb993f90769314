"""Best-fit packing of token sequences, online and in bounded space.

Every partition of documents is one stream. A document becomes ids plus an end id; a
longer one is cut so that only its first piece may be shorter than a sequence. A piece
goes to the fullest open sequence that still holds it. Open sequences are found through
a bitset keyed by free space: the lowest set bit at or above a piece's length is the best
fit, one integer operation. At most ``open_bins`` are open; when one more is needed, the
fullest closes first (a sequence without free space closes at once).

Memory is the open bins plus one Arrow batch; a lost task is repeated from its own scan
partition, and sequence ids are built from the partition number, so they stay unique.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread

SEQUENCE_LENGTH = 1024
OPEN_BINS = 256
END_ID = 2


def cut_points(total: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids; only the first may be short."""
    head = total % length if total > length else total
    out = [(0, head)] if head else []
    return out + [(at, length) for at in range(head, total, length)]


class OpenBins:
    """Bounded-space best-fit: free space -> open sequences, with a bitset over the free spaces."""

    def __init__(self, length: int = SEQUENCE_LENGTH, open_bins: int = OPEN_BINS, first_id: int = 0):
        if open_bins < 1 or length < 1:
            raise ValueError("at least one open sequence of at least one token is needed")
        self.length, self.limit, self.next_id = length, open_bins, first_id
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]
        self.bits, self.open = 0, 0

    def _pop(self, free: int) -> int:
        stack = self.by_free[free]
        found = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of ``size`` tokens."""
        above = self.bits >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            sequence = self._pop(free)
        else:
            sequence, free = self.next_id, self.length
            self.next_id += 1
        left = free - size
        if left:
            if self.open == self.limit:
                fullest = (self.bits & -self.bits).bit_length() - 1
                if left <= fullest:
                    return sequence, self.length - free  # itself the fullest: it closes
                self._pop(fullest)
            self.by_free[left].append(sequence)
            self.bits |= 1 << left
            self.open += 1
        return sequence, self.length - free


def byte_bpe_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Batch encoder for a tokenizer file, without special tokens added."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _printed_bytes() -> dict[str, int]:
    """The printable sign that stands for each byte in such files: itself if it prints, else the next code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(hidden)}


def same_vocabulary(given: dict, ranks: dict[bytes, int]) -> bool:
    """Whether a tokenizer file has the tokens of the rank file under the same ids, and its merges make them in that order."""
    sign = _printed_bytes()
    raw = lambda token: bytes(sign[c] for c in token)
    extra = {x["content"] for x in given.get("added_tokens", [])}
    model = given["model"]
    if {raw(t): i for t, i in model["vocab"].items() if t not in extra} != ranks:
        return False
    made = [ranks[b"".join(map(raw, m.split(" ") if isinstance(m, str) else m))] for m in model["merges"]]
    return made == sorted(made) and len(made) == len(set(made)) == len(ranks) - 256


def twin_encoder(path: str, ranks_path: str, pattern: str) -> Callable[[list[str]], list[list[int]]]:
    """The same ids as ``byte_bpe_encoder(path)`` where the rank file is the same vocabulary.

    Texts that hold the string of a special token go to the tokenizer file itself.
    """
    import base64
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    special = [x["content"] for x in given.get("added_tokens", [])]
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if not same_vocabulary(given, ranks):
        return byte_bpe_encoder(path)
    fast = tiktoken.Encoding("twin", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    slow = None

    def encode(texts: list[str]) -> list[list[int]]:
        nonlocal slow
        out = []
        for t in texts:
            if any(s in t for s in special):
                slow = slow or byte_bpe_encoder(path)
                out.append(slow([t])[0])
            else:
                out.append(fast.encode_ordinary(t))
        return out

    return encode


def pack_documents(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[int]]]], id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE_LENGTH, open_bins: int = OPEN_BINS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and the ids themselves if asked).

    ``encoder`` is called once a task and gives the batch encoder. A null text is empty (it
    is still one piece: the end id). Null and repeated ids are kept, each row packed by
    itself; texts of any length are encoded whole. An empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        bins = OpenBins(length, open_bins, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40)
        for batch in batches:
            doc, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            rows: list[list] = [[] for _ in range(8)]
            at = 0
            while at < len(texts):  # encoder batches of bounded size
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) < 4_000_000):
                    chars += len(texts[to])
                    to += 1
                for k, ids in enumerate(encode(texts[at:to]), at):
                    raw = np.array([*ids, end_id], dtype="<u4")
                    for piece, (start, size) in enumerate(cut_points(len(raw), length)):
                        sequence, offset = bins.place(size)
                        part = raw[start : start + size]
                        for column, value in zip(rows, (k, piece, start, size, zlib.crc32(part.tobytes()), sequence, offset, part if with_ids else None)):
                            column.append(value)
                at = to
            if rows[0]:
                arrays = [doc.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:7])]
                if with_ids:
                    arrays.append(pa.array([r.tolist() for r in rows[7]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    kinds = [docs.schema[id_col].dataType, T.IntegerType(), *[T.LongType()] * 5] + [T.ArrayType(T.IntegerType())] * with_ids
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(rows).mapInArrow(run, schema)
