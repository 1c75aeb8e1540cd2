"""Byte-level BPE by prefix dynamic programming.

Every prefix of a byte string has one valid encoding, so one valid last token. Storing that token for each prefix encodes
left to right: the last token of a prefix is the vocabulary token that ends it and may follow the last token of the
prefix before it. Appending bytes never changes what is stored, and an edit keeps everything before it and, as soon as
the stored tokens agree over the longest token's length, everything after it.

Defined cases: a null text encodes as the empty one, to no ids; bytes that are no UTF-8 encode like any others; rows that
repeat a doc_id are encoded each; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.common import pick, read, released

CACHED_PIECES = 150_000
CACHED_PAIRS = 300_000
CACHED_PIECE_BYTES = 64
#: Texts of about so many characters are held as pieces at once, and one text at least.
SPLIT_CHARS = 1 << 20


class Vocabulary:
    """Ranked byte tokens; a token's rank is its id and the order of merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._histories: dict[int, list[tuple[int, bytes, bytes]]] = {}
        #: Pairs of tokens already judged, as left << 32 | right.
        self.known: dict[int, bool] = {}

    @classmethod
    def parse(cls, lines: bytes) -> Vocabulary:
        """From lines of a base64 token and its rank."""
        return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())})

    def merged(self, data: bytes) -> list[int]:
        """Encoding by the definition: join the lowest-ranked neighbours until none can be joined."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            joined = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            best = min(joined)
            if best == 1 << 60:
                break
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _history(self, token: int) -> list[tuple[int, bytes, bytes]]:
        """The joins that make a token, as (rank, left, right), in the order in which they happen."""
        got = self._histories.get(token)
        if got is None:
            data = self.token[token]
            parts, got = [data[k : k + 1] for k in range(len(data))], []
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
                # Of each join only its effect on the outer parts matters.
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if at == 0 or at == len(parts) - 1:
                    got.append((rank, parts[0], parts[-1]))
            self._histories[token] = got
        return got

    def follows(self, left: int, right: int) -> bool:
        """Whether the two tokens stand next to each other in the encoding of their joined bytes.

        The joins of both happen by rank. Until each is done, its outer part faces the other's; the pair holds unless
        the two facing parts join at a rank no higher than (left side first) the next join of their own.
        """
        edge, start = self.token[left][-1:], self.token[right][:1]
        ahead, behind = self._history(left), self._history(right)
        i = j = 0
        ranks = self.ranks.get
        while True:
            across = ranks(edge + start)
            next_left = ahead[i][0] if i < len(ahead) else 1 << 60
            next_right = behind[j][0] if j < len(behind) else 1 << 60
            if across is not None and across < next_left and across <= next_right:
                return False
            if i == len(ahead) and j == len(behind):
                return True
            if next_left <= next_right:
                edge, i = ahead[i][2], i + 1
            else:
                start, j = behind[j][1], j + 1

    def __reduce__(self):
        return Vocabulary, (self.ranks,)


class PrefixEncoder:
    """The encoding of a growing or edited byte string; `last[i]` is the last token of the first i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last: list[int] = []
        self.append(data)

    def _last(self, data: bytes, end: int, base: int = 0) -> int:
        """The one token that ends the prefix at data[end]; data starts at byte `base`. Short tokens, the likeliest, are tried first."""
        get, known, longest, last = self.vocabulary.ranks.get, self.vocabulary.known, self.vocabulary.longest, self.last
        for start in range(end - 1, max(-1, end - 1 - longest), -1):
            token = get(data[start:end])
            if token is not None:
                before = base + start - 1
                if before < 0:
                    return token
                pair = last[before] << 32 | token
                ok = known.get(pair)
                if ok is None:
                    ok = known[pair] = self.vocabulary.follows(last[before], token)
                if ok:
                    return token
        raise ValueError("the vocabulary lacks a single byte")

    def append(self, more: bytes) -> None:
        if len(self.vocabulary.known) > CACHED_PAIRS:
            self.vocabulary.known.clear()
        at = len(self.data)
        base = max(0, at - self.vocabulary.longest)
        data = bytes(self.data[base:]) + more
        self.data += more
        for end in range(at - base + 1, len(data) + 1):
            self.last.append(self._last(data, end, base))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replaces the bytes from start to end; returns for how many bytes a last token was worked out again."""
        old, shift = self.last, start + len(new) - end
        self.data[start:end] = new
        self.last = old[:start]
        data, same = bytes(self.data), 0
        for at in range(start, len(data)):
            token = self._last(data, at + 1)
            self.last.append(token)
            same = same + 1 if at - shift >= end and old[at - shift] == token else 0
            # Later tokens depend on no more than the longest token's bytes before them, which are as they were.
            if same >= self.vocabulary.longest:
                self.last.extend(old[at - shift + 1 :])
                return at + 1 - start
        return len(data) - start

    def ids(self) -> list[int]:
        got, at = [], len(self.data)
        while at:
            token = self.last[at - 1]
            got.append(token)
            at -= len(self.vocabulary.token[token])
        return got[::-1]


class PieceEncoder:
    """Ids of pieces, one after another: the last token of each prefix from the shortest on, then back from the end. What two
    pieces begin with alike is worked out once where one follows the other, as appending never changes what is stored."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.piece = b""
        #: Of the prefixes of that piece the last token and where it begins.
        self.last: list[int] = []
        self.starts: list[int] = []

    def encode(self, piece: bytes) -> list[int]:
        vocabulary = self.vocabulary
        get, known, follows = vocabulary.ranks.get, vocabulary.known, vocabulary.follows
        whole = get(piece)
        if whole is not None:
            return [whole]
        if len(known) > CACHED_PAIRS:
            known.clear()
        if len(piece) > vocabulary.longest:
            return PrefixEncoder(vocabulary, piece).ids()
        last, starts, alike = self.last, self.starts, 0
        for old, new in zip(self.piece, piece):
            if old != new:
                break
            alike += 1
        self.piece = piece[:alike]  # what is known if this piece fails
        del last[alike:], starts[alike:]
        if not last:
            last.append(get(piece[:1]))
            starts.append(0)
        start = starts[-1]
        for end in range(len(last) + 1, len(piece) + 1):
            # Only one token ends each prefix, so the order of trials is free: the last one a byte longer is the likeliest.
            token, tried = get(piece[start:end]), start
            if token is not None and start:
                pair = last[start - 1] << 32 | token
                ok = known.get(pair)
                if ok is None:
                    ok = known[pair] = follows(last[start - 1], token)
                if not ok:
                    token = None
            if token is None:
                for start in range(end - 1, -1, -1):
                    if start == tried or (token := get(piece[start:end])) is None:
                        continue
                    if not start:
                        break
                    pair = last[start - 1] << 32 | token
                    ok = known.get(pair)
                    if ok is None:
                        ok = known[pair] = follows(last[start - 1], token)
                    if ok:
                        break
                else:
                    raise ValueError("the vocabulary lacks a single byte")
            last.append(token)
            starts.append(start)
        self.piece = piece
        ids, at = [], len(piece)
        while at:
            ids.append(last[at - 1])
            at = starts[at - 1]
        return ids[::-1]


def encode_piece(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """Ids of one piece."""
    return PieceEncoder(vocabulary).encode(piece)


class _Pieces(dict):
    """Piece of text to its ids. Two generations of bounded size: what is asked for again moves from the older to this one."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.older: dict[str, tuple[int, ...]] = {}

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def learn(self, pieces: set[str]) -> None:
        """Works out those that are new in the order of their bytes, in which neighbours begin alike."""
        encode = PieceEncoder(self.vocabulary).encode
        for piece in sorted(p for p in pieces if p not in self and p not in self.older):
            raw = piece.encode()
            if len(raw) <= CACHED_PIECE_BYTES:
                self.keep(piece, tuple(encode(raw)))

    def keep(self, piece: str, ids: tuple[int, ...]) -> None:
        if len(self) >= CACHED_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = ids

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode()
            ids = tuple(encode_piece(self.vocabulary, raw))
            if len(raw) > CACHED_PIECE_BYTES:
                return ids
        self.keep(piece, ids)
        return ids


#: The working vocabulary of this worker process, kept between tasks, and its pieces, kept during one.
_ready: dict[tuple[str, str], tuple[Vocabulary, _Pieces, list[bytes], list[str], regex.Pattern]] = {}


def _prepared(lines: bytes, pattern: str) -> tuple[Vocabulary, _Pieces, list[bytes], list[str], regex.Pattern]:
    key = (hashlib.sha256(lines).hexdigest(), pattern)
    if key not in _ready:
        vocabulary = Vocabulary.parse(lines)
        size = max(vocabulary.token) + 1
        _ready[key] = vocabulary, _Pieces(vocabulary), [vocabulary.token.get(k, b"") for k in range(size)], [str(k) for k in range(size)], regex.compile(pattern)
    return _ready[key]


def _split(texts: list[str | None], split: regex.Pattern, pieces: _Pieces) -> Iterator[list[str]]:
    """Pieces of each text; those of some texts at a time, of bounded size together, are learned before the texts are given."""
    held, size = [], 0
    for text in texts:
        held.append(split.findall(text or ""))
        size += len(text or "")
        if size > SPLIT_CHARS:
            pieces.learn(set(chain.from_iterable(held)))
            yield from held
            held, size = [], 0
    pieces.learn(set(chain.from_iterable(held)))
    yield from held


def _encoder(shared, pattern: str, keep_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pieces, token, digits, split = _prepared(shared.value, pattern)
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                some = batch.slice(part, 500)
                counts, id_hashes, decoded, held = [], [], [], array("i")
                for found in _split(some.column("text").to_pylist(), split, pieces):
                    ids = list(chain.from_iterable(map(pieces.__getitem__, found)))
                    counts.append(len(ids))
                    id_hashes.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(map(token.__getitem__, ids))).hexdigest())
                    if keep_ids:
                        held.extend(ids)
                columns = [some.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(held, np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Hundreds of thousands of pieces are made and none refers to itself: the cycle collector would walk them in vain.
        collecting = gc.isenabled()
        gc.disable()
        try:
            yield from encoded(batches)
        finally:
            if collecting:
                gc.enable()
            # The worker process goes on to other tasks and stages, whose memory this would take.
            vocabulary, pieces, *_ = _prepared(shared.value, pattern)
            pieces.forget()
            vocabulary.known.clear()

    return released(run)


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and (on request) ids of every document.

    The vocabulary is read once on the driver and broadcast: its size is that of the published file, whatever the input.
    """
    with open(vocabulary_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return pick(docs, "doc_id", "text").mapInArrow(_encoder(shared, pattern, keep_ids), schema)


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), *public_vocabulary(), keep_ids=False)
