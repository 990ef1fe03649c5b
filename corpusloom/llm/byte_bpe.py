"""Byte-level BPE: texts to token ids and back, by the ranks of a public vocabulary.

Each Spark task encodes its own rows, so nothing is shuffled. A batch of texts is
split into pieces by array passes over its characters; each distinct piece of a
batch is encoded once. A piece is encoded with a segment tree over its byte
positions: leaf ``i`` holds the rank of the pair of tokens that begins at byte
``i``, and every inner node the leftmost of the lowest ranks below it. The root
names the next merge; a merge updates three leaves (the pair itself, the pair that
its live left neighbour begins, and the one that is gone), each in logarithmic
time, so that a piece of n bytes without a blank costs n log n. Short pieces of
about one length have their trees side by side in one array and merge together,
one merge of each piece per step; long ones are merged alone.

Texts longer than a slice are encoded in parts, cut where a blank follows a
printable ASCII character, which always ends a piece.

Defined results: a null text is encoded as an empty one and has no ids; repeated
rows and rows without doc_id are encoded like all others; columns other than
doc_id and text aren't read. Special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wordhash import SLICE_BYTES, span_hashes, text_slices

#: Bytes of distinct pieces that a worker remembers the ids of.
REMEMBERED = 1 << 21
#: Bytes from which a piece is merged alone, and pieces merged together.
LONG_PIECE, TOGETHER = 64, 4096
_NO_PAIR = 1 << 62
_LETTER, _NUMBER, _OTHER, _SPACE = range(4)


def default_path() -> str:
    """The rank file; every worker must be able to open it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Vocabulary:
    """Ranks by bytes and by pairs of ids, and the bytes of all ids in one buffer."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        by_id = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            by_id[rank] = piece
        self.length = np.array([len(x) for x in by_id])
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.of_byte = np.array([self.ranks[bytes([k])] for k in range(256)])
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of ids that make a token, in order, and its rank; only encoding needs them."""
        get = self.ranks.get
        halves = ((get(x[:k]), get(x[k:]), r) for x, r in self.ranks.items() for k in range(1, len(x)))
        pairs = np.array([(a << 32 | b, r) for a, b, r in halves if a is not None and b is not None])
        pairs = pairs[np.argsort(pairs[:, 0])]
        return pairs[:, 0].copy(), pairs[:, 1].copy()

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two ids make, -1 where there is none."""
        key = left << 32 | right
        keys, ranks = self.pairs
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, ranks[at], -1)

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of distinct pieces."""
        new = [x for x in pieces if x not in self.known]
        if self.held > REMEMBERED:
            self.known, self.held, new = {}, 0, pieces
        groups: dict[int, list[bytes]] = {}
        for x in new:
            whole = self.ranks.get(x)
            if whole is not None:
                self.known[x] = whole.to_bytes(4, "little")
            elif len(x) > LONG_PIECE:
                self.known[x] = np.array(encode_piece(x, self.ranks), dtype="<u4").tobytes()
            else:
                groups.setdefault((len(x) - 1).bit_length(), []).append(x)
            self.held += len(x)
        for bits, group in groups.items():
            for k in range(0, len(group), TOGETHER):
                some = group[k : k + TOGETHER]
                self.known.update(zip(some, encode_pieces(some, 1 << bits, self), strict=True))
        return [self.known[x] for x in pieces]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read once in each worker."""
    return Vocabulary(path)


def encode_pieces(pieces: list[bytes], size: int, words: Vocabulary) -> list[bytes]:
    """Packed ids of many pieces of at most ``size`` bytes, a power of two: in every step
    each piece that has a pair left merges the one that the root of its tree names."""
    n = len(pieces)
    length = np.array([len(x) for x in pieces])
    padded = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in pieces), dtype=np.uint8).reshape(n, size)
    place = np.arange(size)
    token = words.of_byte[padded]
    live = place < length[:, None]
    after = np.broadcast_to(place + 1, (n, size)).copy()
    before = np.broadcast_to(place - 1, (n, size)).copy()
    tree = np.full((n, 2 * size), _NO_PAIR)
    rank = words.pair_rank(token[:, :-1], token[:, 1:])
    tree[:, size:-1] = np.where((rank >= 0) & live[:, 1:], rank << 32 | place[:-1], _NO_PAIR)
    for k in range(size.bit_length() - 2, -1, -1):
        low = tree[:, 2 << k : 4 << k]
        tree[:, 1 << k : 2 << k] = np.minimum(low[:, ::2], low[:, 1::2])
    rows = np.flatnonzero(tree[:, 1] != _NO_PAIR)
    while len(rows):
        at, made = tree[rows, 1] & 0xFFFFFFFF, tree[rows, 1] >> 32
        gone = after[rows, at]
        end = after[rows, gone]
        token[rows, at], after[rows, at], live[rows, gone] = made, end, False
        inside = end < length[rows]
        before[rows[inside], end[inside]] = at[inside]
        tree[rows, size + gone] = _NO_PAIR
        rank = np.where(inside, words.pair_rank(made, token[rows, np.minimum(end, size - 1)]), -1)
        tree[rows, size + at] = np.where(rank >= 0, rank << 32 | at, _NO_PAIR)
        left = before[rows, at]
        led = np.flatnonzero(left >= 0)
        rank = words.pair_rank(token[rows[led], left[led]], made[led])
        tree[rows[led], size + left[led]] = np.where(rank >= 0, rank << 32 | left[led], _NO_PAIR)
        up = size + np.stack([at, gone, np.maximum(left, 0)])
        while up[0, 0] > 1:
            up >>= 1
            tree[rows, up] = np.minimum(tree[rows, 2 * up], tree[rows, 2 * up + 1])
        rows = rows[tree[rows, 1] != _NO_PAIR]
    ids = token[live].astype("<u4")
    upto = np.concatenate([[0], np.cumsum(live.sum(axis=1))])
    return [ids[a:b].tobytes() for a, b in zip(upto[:-1], upto[1:], strict=True)]


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the lowest-ranked pair merges first, the leftmost of equal ones."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    tree = array("q", [_NO_PAIR]) * (2 * size)
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << 32 | i
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            i >>= 1
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                return
            tree[i] = least

    def pair(i: int) -> int:
        rank = ranks.get(piece[i : after[after[i]]]) if after[i] < n else None
        return _NO_PAIR if rank is None else rank << 32 | i

    while tree[1] != _NO_PAIR:
        at = tree[1] & 0xFFFFFFFF
        gone = after[at]
        after[at] = after[gone]
        if after[at] < n:
            before[after[at]] = at
        put(gone, _NO_PAIR)
        put(at, pair(at))
        if before[at] >= 0:
            put(before[at], pair(before[at]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, blank or other."""
    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    everything = "".join(map(chr, range(0x110000)))
    for kind, prop in ((_LETTER, "L"), (_NUMBER, "N"), (_SPACE, "White_Space")):
        for m in regex.finditer(rf"\p{{{prop}}}+", everything):
            out[m.start() : m.end()] = kind
    return out


def piece_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which the pieces of consecutive texts begin, as the public
    split pattern finds them: a contraction after an apostrophe; letters, numbers or
    other signs, with one space before; blanks up to the last one before a text part."""
    n_bytes = len(raw)
    text = raw.tobytes().decode("utf-8")
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    n = len(code)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    place = None
    bounds = offsets[:-1]
    if n != n_bytes:
        place = np.flatnonzero((raw & 0xC0) != 0x80)
        bounds = np.searchsorted(place, bounds)
    first = np.zeros(n + 3, dtype=bool)
    first[bounds[bounds < n]] = True
    first[n:] = True
    kind = _classes()[code]
    blank = kind == _SPACE
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    after_space = np.zeros(n, dtype=bool)
    after_space[1:] = (code[:-1] == 32) & ~first[1:n]
    # the last blank before other text stands alone or leads it
    leads = np.zeros(n, dtype=bool)
    leads[:-1] = blank[:-1] & ~blank[1:] & ~first[1:n]
    start = (run & (blank | ~after_space)) | leads
    quote = np.flatnonzero(start & (code == 39))
    if len(quote):
        ahead = np.concatenate([code, np.zeros(2, dtype=np.uint32)])
        one, two = ahead[quote + 1], ahead[quote + 2]
        is_one = ~first[quote + 1]
        short = is_one & np.isin(one, [ord(c) for c in "sdmt"])
        long = is_one & ~first[quote + 2] & (
            ((one == ord("l")) & (two == ord("l"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("r")) & (two == ord("e")))
        )
        start[quote[short | long] + 1] = False
        ends = np.concatenate([quote[short] + 2, quote[long] + 3])
        start[ends[ends < n]] = True
    at = np.flatnonzero(start)
    return at if place is None else place[at]


def _gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches ``start``, ``length`` of ``flat``, one behind the other."""
    upto = np.cumsum(length)
    total = int(upto[-1]) if len(upto) else 0
    return flat[np.repeat(start - (upto - length), length) + np.arange(total)]


def _distinct(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct piece, number of every piece among these)."""
    _, at, back = np.unique(span_hashes(raw, start, end), return_index=True, return_inverse=True)
    length = end - start
    same = length[at][back] == length
    if same.all() and np.array_equal(_gathered(raw, start[at][back], length), raw[start[0] : end[-1]]):
        return at, back
    number: dict[bytes, int] = {}  # two pieces with one hash: tell them apart by their bytes
    back = np.array([number.setdefault(raw[a:b].tobytes(), len(number)) for a, b in zip(start, end, strict=True)])
    return np.unique(back, return_index=True)[1], back


def _encoded(raw: np.ndarray, offsets: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, index of each text's first id with one more at the end)."""
    start = piece_starts(raw, offsets)
    if len(start) == 0:
        return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
    end = np.append(start[1:], len(raw))
    at, back = _distinct(raw, start, end)
    body = raw.tobytes()
    packed = words.ids([body[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
    length = np.array([len(x) // 4 for x in packed])
    flat = np.frombuffer(b"".join(packed), dtype="<u4")
    each = length[back]
    ids = _gathered(flat, (np.cumsum(length) - length)[back], each)
    upto = np.concatenate([[0], np.cumsum(each)])
    return ids, upto[np.searchsorted(start, offsets)]


def _parts(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A text in parts of about a slice, each but the last ending where a piece ends."""
    at = 0
    while len(raw) - at > SLICE_BYTES:
        look = at + SLICE_BYTES
        cut = None
        while cut is None and look < len(raw):
            window = raw[look - 1 : look + SLICE_BYTES]
            hit = np.flatnonzero((window[:-1] > 32) & (window[:-1] < 127) & ((window[1:] == 32) | (window[1:] == 10)))
            cut = look + int(hit[0]) if len(hit) else None
            look += SLICE_BYTES
        if cut is None:
            break
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n_tokens, ids): ids is binary, each id an
    unsigned 32-bit integer, lowest byte first."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for row, raw, offsets in text_slices(batch.column(1)):
                n = len(offsets) - 1
                if n == 1:
                    got = [_encoded(part, np.array([0, len(part)]), words)[0].astype("<u4").tobytes() for part in _parts(raw)]
                    rows = [b"".join(got)]
                else:
                    ids, first = _encoded(raw, offsets, words)
                    rows = [ids[a:b].astype("<u4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                counts = pa.array([len(x) // 4 for x in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), counts, pa.array(rows, pa.binary())], ["doc_id", "n_tokens", "ids"])

    id_field = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    schema = T.StructType([id_field, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``tokens`` with ``decoded``, the bytes that the packed ``ids`` stand for."""
    path = path or default_path()
    names = tokens.columns
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in tokens.schema], T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            out = []
            for packed in batch.column(names.index("ids")):
                ids = np.frombuffer(packed.as_py() or b"", dtype="<u4")
                step = SLICE_BYTES // 4
                out.append(b"".join(_gathered(words.flat, words.start[x], words.length[x]).tobytes() for x in (ids[k : k + step] for k in range(0, len(ids), step))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, "decoded"])

    return tokens.mapInArrow(run, schema)


def round_trip_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: its text is
    encoded, and the ids are decoded again."""
    return decode(encode(docs, path), path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
