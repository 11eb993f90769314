"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

The merges (a rank per byte string) are compiled on demand into a transducer that reads
bytes and writes tokens. It rests on two facts about BPE with a vocabulary in which every
token is its own encoding: a token sequence is an encoding exactly when each adjacent
pair is the encoding of its joined bytes, and every text has one encoding.

States are the token written last (or none). The input symbol at a place is the longest
token that matches there, found in a trie of all tokens, so the lookahead is bounded by
the longest token. It stands for all its own beginnings that are tokens; the transition
keeps those that may follow the state's token, longest first. Transitions are compiled
when first met and kept in one bounded table. The first alternative is written; the rare
one that leads nowhere is taken back, and since every prefix has one encoding its end is
never entered again, so a run stays linear in its input.

Which tokens may stand side by side is decided on the merge trees: undo the youngest
merge next to the border, again and again, and see whether the border pair would have
merged earlier. Whole runs between two blanks are kept as single arcs in a bounded table.

Tokens that are not their own encoding are only reached as whole pieces (they are then
taken as they are); the transducer leaves them out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread

#: Bounds of the lazily built tables; a full one is dropped and rebuilt, results stay the same.
MAX_TRANSITIONS = 1_000_000
MAX_ARCS = 600_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.next: dict[int, tuple[tuple[int, int], ...]] = {}
        self.trie = {b[:i]: -1 for b in ranks for i in range(1, len(b))}
        for b, i in ranks.items():
            if self._half(i) is not None or len(b) == 1:
                self.trie[b] = i
        self.starts: dict[int, tuple[int, ...]] = {}

    def _half(self, token: int) -> tuple[int, int] | None:
        """The two tokens of a token's last merge; None for a single byte or one that merging never reaches."""
        if token in self.halves:
            return self.halves[token]
        raw = self.tokens[token]
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 2:
            ranked = [(self.ranks.get(x + y, 1 << 60), i) for i, (x, y) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        found = tuple(self.ranks.get(p, -1) for p in parts) if len(parts) == 2 else None
        self.halves[token] = found = None if found is None or -1 in found else found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the joined bytes is a, b."""
        tokens, limit, left_undone = self.tokens, 1 << 60, True
        while True:
            joined = self.ranks.get(tokens[a] + tokens[b])
            if joined is not None and (joined < limit or joined == limit and not left_undone):
                return False
            left, right = self._half(a), self._half(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and a > b:
                limit, left_undone, a = a, True, left[1]
            else:
                limit, left_undone, b = b, False, right[0]

    def _transition(self, last: int, longest: int) -> tuple[tuple[int, int], ...]:
        starts = self.starts.get(longest)
        if starts is None:
            raw = self.tokens[longest]
            starts = self.starts[longest] = tuple(t for i in range(len(raw), 0, -1) if (t := self.trie.get(raw[:i], -1)) >= 0)
        if len(self.next) >= MAX_TRANSITIONS:
            self.next.clear()
        found = self.next[last + 1 << 32 | longest] = tuple((t, len(self.tokens[t])) for t in starts if last < 0 or self.compatible(last, t))
        return found

    def run(self, word: bytes) -> list[int]:
        """Token ids of one split piece."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        trie, known, n = self.trie.get, self.next.get, len(word)
        out: list[int] = []
        back: list[tuple[int, tuple, int]] = []
        dead: set[int] = set()
        at, last = 0, -1
        while at < n:
            longest, end = -1, at + 1
            found = trie(word[at:end])
            while found is not None:
                if found >= 0:
                    longest = found
                if end == n:
                    break
                end += 1
                found = trie(word[at:end])
            if longest < 0:
                raise ValueError(f"no token for byte {word[at]}")
            options = known(last + 1 << 32 | longest)
            if options is None:
                options = self._transition(last, longest)
            pick = 0
            while True:
                while pick < len(options) and at + options[pick][1] in dead:
                    pick += 1
                if pick < len(options):
                    break
                dead.add(at)
                if not back:
                    raise ValueError("the vocabulary cannot write this piece")
                at, options, pick = back.pop()
                out.pop()
                pick += 1
            last, size = options[pick]
            out.append(last)
            back.append((at, options, pick))
            at += size
        return out


#: White space other than the blank and the line feed; these and touching ones are left to the pattern.
_RARE_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _touching(text: str) -> bool:
    """Whether some blank may stand next to other white space: only there does the pattern look past a blank."""
    return "  " in text or "\n " in text or " \n" in text or _RARE_SPACE.search(text) is not None


class Encoder:
    """Splits a text by ``pattern`` and sends each piece through the transducer.

    With ``blank_starts_piece`` (true of the usual byte-level patterns, in which a blank
    between two other characters always begins a piece) a text is first cut at such
    blanks, and what lies between is kept in the table as one arc.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, blank_starts_piece: bool = True):
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.blank_starts_piece = blank_starts_piece
        self.runs: dict[str, list[int]] = {}

    def _run(self, text: str) -> list[int]:
        ids: list[int] = []
        for word in self.split(text):
            ids += self.transducer.run(word.encode())
        if len(text) <= 64:
            if len(self.runs) >= MAX_ARCS:
                self.runs.clear()
            self.runs[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if not self.blank_starts_piece or _touching(text):
            pieces = self.split(text)
        else:
            first, *rest = text.split(" ")
            pieces = [first] if first else []
            pieces += [" " + x for x in rest]
        out: list[int] = []
        known = self.runs.get
        for piece in pieces:
            ids = known(piece)
            out += self._run(piece) if ids is None else ids
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder_for(ranks_path: str, pattern: str) -> Encoder:
    """One encoder a worker process: its tables serve every task that follows."""
    if (ranks_path, pattern) not in _encoders:
        _encoders[ranks_path, pattern] = Encoder(load_ranks(ranks_path), pattern)
    return _encoders[ranks_path, pattern]


class Utf8State:
    """Incremental UTF-8: feed byte chunks cut anywhere, get text; a malformed byte becomes U+FFFD.

    The state is the incomplete character at the end of what was fed (three bytes at most).
    """

    def __init__(self) -> None:
        self.tail = b""

    @staticmethod
    def _incomplete(chunk: bytes) -> int:
        """How many bytes at the end begin a character that is not finished."""
        for back in range(1, min(3, len(chunk)) + 1):
            byte = chunk[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if back < need and byte < 0xF8 else 0
            if byte < 0x80:
                return 0
        return 0

    def feed(self, chunk: bytes) -> str:
        chunk = self.tail + chunk
        keep = self._incomplete(chunk)
        self.tail = chunk[len(chunk) - keep :]
        return chunk[: len(chunk) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.tail = self.tail, b""
        return rest.decode("utf-8", "replace")


def decode_stream(ids: list[int], tokens: dict[int, bytes], chunk: int = 4096) -> Iterator[bytes]:
    """Byte chunks of ``ids``; each ends at a character's end unless the bytes are malformed."""
    state = Utf8State()
    of = tokens.__getitem__
    for at in range(0, len(ids), chunk):
        yield state.feed(b"".join(map(of, ids[at : at + chunk]))).encode()
    rest = state.close()
    if rest:
        yield rest.encode()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 (and the ids if asked).

    A null text is empty: no token, the digests of an empty string. Null and repeated ids
    are kept; texts are encoded whole; an empty table gives no row. ``ranks_path`` must be
    readable where tasks run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(ranks_path, pattern)
        tokens = encoder.transducer.tokens
        text_of = {i: str(i) for i in tokens}.__getitem__
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for text in batch.column(1):
                ids = encoder.encode(text.as_py() or "")
                digest = hashlib.sha256()
                for chunk in decode_stream(ids, tokens):
                    digest.update(chunk)
                rows[0].append(len(ids))
                rows[1].append(hashlib.sha256(" ".join(map(text_of, ids)).encode()).hexdigest())
                rows[2].append(digest.hexdigest())
                if with_ids:
                    rows[3].append(ids)
            arrays = [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            if with_ids:
                arrays.append(pa.array(rows[3], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    kinds = [docs.schema[id_col].dataType, T.LongType(), T.StringType(), T.StringType()] + [T.ArrayType(T.IntegerType())] * with_ids
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return spread(rows).mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))
