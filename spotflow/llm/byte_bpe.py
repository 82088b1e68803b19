"""Byte-level BPE as a finite-state transducer, and decoding as a byte stream.

The rank file is compiled into a transducer that reads bytes and writes tokens.
A byte string has one BPE encoding, so after each byte the transducer has one
hypothesis for every position at which a token may still be open: the tokens
before it, and the trie node reached since. A token may follow another only if
merging both strings by rank gives just these two tokens. What all hypotheses
agree on is written at once; they can differ only over the tokens still open,
so the lookahead stays within a few token lengths. The subset of hypotheses is
the state of a deterministic machine whose states and arrows are made when a
text first needs them.
"""

from __future__ import annotations

import base64
import codecs
import gc
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from spotflow.llm.common import batches, hold, release, small_batches

#: Encoded pieces, and states, that a worker remembers before it starts anew. It
#: keeps them from task to task, until one of another operator begins.
PIECES, STATES = 400_000, 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Merge the adjacent pair of lowest rank, leftmost first, until none is left."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 60:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def packed(hypotheses: list[tuple]) -> bytes:
    """A state in one object: node, last token written, number of tokens not yet written and these, for each hypothesis."""
    return array("i", [x for pending, node, last in hypotheses for x in (node, last, len(pending), *pending)]).tobytes()


def unpacked(state: bytes) -> Iterator[tuple]:
    values, at = memoryview(state).cast("i").tolist(), 0
    while at < len(values):
        node, last, n = values[at:at + 3]
        yield tuple(values[at + 3:at + 3 + n]), node, last
        at += 3 + n


class Transducer:
    """Reads the bytes of a piece, writes its tokens; see the module's text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        # trie nodes are prefixes of tokens
        prefixes = sorted({t[:n] for t in ranks for n in range(1, len(t) + 1)}, key=len)
        nodes = {b"": 0} | {p: i for i, p in enumerate(prefixes, 1)}
        self.below = {nodes[p[:-1]] << 8 | p[-1]: nodes[p] for p in prefixes}  # node << 8 | byte -> node
        self.token_of = [None, *map(ranks.get, prefixes)]
        self._parts: dict[int, tuple[bytes, bytes] | None] = {}
        self._edges: dict[tuple[int, int], list] = {}
        self._pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        # a state: hypotheses (tokens not yet written, node, last token written), the one at a token's end first
        self.states: list[bytes] = [packed([((), 0, -1)])]
        self.ids = {self.states[0]: 0}
        self.arrows: dict[int, int] = {}  # state << 8 | byte -> next state
        self.writes: dict[int, tuple] = {}  # the same key -> tokens, where there are any
        self.met: set[int] = set()  # arrows that were missing once
        self._pairs.clear()

    def _halves(self, token: int) -> tuple[bytes, bytes] | None:
        """The two parts of the merge that gives the token; none for a byte or a token that merging never gives."""
        if token not in self._parts:
            text = self.bytes_of[token]
            below = {t: r for i in range(len(text)) for j in range(i + 1, len(text) + 1)
                     if (r := self.ranks.get(t := text[i:j])) is not None and t != text}
            halves = merge(text, below)
            self._parts[token] = tuple(halves) if len(halves) == 2 else None
        return self._parts[token]

    def _is_whole(self, token: int) -> bool:
        """Does merging give this token at all?"""
        return len(self.bytes_of[token]) == 1 or self._halves(token) is not None

    def _edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """The tokens that stand at one end while ``token`` is merged, each with the rank that ends it."""
        if (token, side) not in self._edges:
            out, until = [], float("inf")
            while True:
                out.append((self.bytes_of[token], until))
                halves = self._halves(token)
                if halves is None:
                    break
                until, token = token, self.ranks[halves[side]]
            self._edges[self.ranks[out[0][0]], side] = out
            return out
        return self._edges[token, side]

    def _may_follow(self, last: int, token: int) -> bool:
        """Does merging both strings together give just these two tokens? ``last`` is -1 if ``token`` is the first.

        Not if two tokens that meet at the seam while their sides are merged
        would be merged with each other first (the left one first if tied).
        """
        pair = (last + 1) << 32 | token
        known = self._pairs.get(pair)
        if known is None:
            rank = self.ranks.get
            known = self._pairs[pair] = self._is_whole(token) and (last < 0 or not any(
                (r := rank(a + b)) is not None and r < a_until and r <= b_until
                for a, a_until in self._edge(last, 1) for b, b_until in self._edge(token, 0)
            ))
        return known

    def _arrow(self, key: int) -> int:
        byte, below, token_of = key & 255, self.below, self.token_of
        ended = None
        hypotheses = [None]
        for pending, node, last in unpacked(self.states[key >> 8]):
            to = below.get(node << 8 | byte)
            if to is None:
                continue
            hypotheses.append((pending, to, last))
            if ended is None:
                token = token_of[to]
                if token is not None and self._may_follow(pending[-1] if pending else last, token):
                    ended = hypotheses[0] = (*pending, token), 0, -1
        n, first = 0, ended[0]  # what all agree on is written
        for n, token in enumerate(first):
            if not all(len(h[0]) > n and h[0][n] == token for h in hypotheses):
                break
        else:
            n = len(first)
        if n:
            self.writes[key] = first[:n]
            last = first[n - 1]
            hypotheses = [(p[n:], node, -1 if len(p) > n else last) for p, node, _ in hypotheses]
        rest = packed(hypotheses)
        state = self.ids.get(rest)
        if state is None:
            state = self.ids[rest] = len(self.states)
            self.states.append(rest)
        self.arrows[key] = state
        return state

    def _walk(self, piece: bytes) -> list[int]:
        """The same hypotheses followed for this piece only, without making states of them."""
        below, token_of, pairs = self.below.get, self.token_of, self._pairs
        last = [-1]  # the token that ends at each position; -1 at the start, -2 where none does
        start = [0]
        open_ = [(0, 0)]  # where a token may still be open, and its node; the longest first
        for i, byte in enumerate(piece, 1):
            ended, begun, going = -2, 0, []
            for a, node in open_:
                to = below(node << 8 | byte)
                if to is None:
                    continue
                going.append((a, to))
                if ended == -2:
                    token = token_of[to]
                    if token is not None:
                        before = last[a]
                        fits = pairs.get((before + 1) << 32 | token)
                        if fits is None:
                            fits = self._may_follow(before, token)
                        if fits:
                            ended, begun = token, a
            last.append(ended)
            start.append(begun)
            open_ = going
            if ended != -2:
                going.append((i, 0))
        out, i = [], len(piece)
        while i:
            out.append(last[i])
            i = start[i]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one piece: a token of the vocabulary as it stands, else by the transducer."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        arrows, writes = self.arrows, self.writes
        out: list[int] = []
        state = 0
        for byte in piece:
            key = state << 8 | byte
            state = arrows.get(key)
            if state is None:
                if len(self.states) > STATES:
                    self.met.clear()  # no more arrows are made
                    return self._walk(piece)
                # an arrow is made when it is needed a second time
                if key not in self.met:
                    if len(self.met) < 8 * STATES:
                        self.met.add(key)
                    return self._walk(piece)
                self.met.discard(key)
                state = self._arrow(key)
            if key in writes:
                out += writes[key]
        out += next(unpacked(self.states[state]))[0]
        return out


class Pieces(dict):
    """Piece of text → its ids as little-endian 32-bit integers.

    Two generations: when the young one is full the old one goes, so pieces in use stay.
    """

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            tokens = self.transducer.encode(piece.encode())
            ids = pack(f"<{len(tokens)}I", *tokens)
        if len(piece) < 100:
            self[piece] = ids
        return ids

    def turn(self) -> None:
        if len(self) > PIECES // 2:
            self.old = dict(self)
            self.clear()
            pairs = self.transducer._pairs
            if len(pairs) > PIECES:
                pairs.clear()


def narrow(pattern: str, below: int = 0x250):
    """The pattern for texts whose characters lie below a code point, for the faster ``re``.

    \\p{L}, \\p{N} and white space become explicit classes, by the categories of
    these characters.
    """
    kinds = {"L": "", "N": "", "s": "\\x09-\\x0d\\x20\\x85\\xa0"}
    for c in map(chr, range(below)):
        if (kind := unicodedata.category(c)[0]) in "LN":
            kinds[kind] += c
    for name, known in (("\\p{L}", kinds["L"]), ("\\p{N}", kinds["N"]), ("\\s", kinds["s"])):
        pattern = re.sub(r"(\[[^\]]*?)" + re.escape(name), lambda m, k=known: m[1] + k, pattern)
        pattern = pattern.replace(name, f"[{known}]")
    return re.compile(pattern.replace("\\S", f"[^{kinds['s']}]")), re.compile(f"[\\x00-\\u{below - 1:04x}]*")


class Codec:
    """Encodes texts piece by piece, as the pattern splits them, and decodes ids."""

    def __init__(self, rank_file: str, pattern: str):
        import regex

        ranks = read_ranks(rank_file)
        self.any_split = regex.compile(pattern).findall
        few, all_few = narrow(pattern)
        self.few_split, self.are_few = few.findall, all_few.fullmatch
        self.pieces = Pieces(Transducer(ranks))
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def encode(self, text: str) -> bytes:
        self.pieces.turn()
        split = self.few_split if self.are_few(text) else self.any_split
        return b"".join(map(self.pieces.__getitem__, split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_stream(self, chunks: Iterable[bytes]) -> Iterator[str]:
        """Text as ids arrive: a character split over tokens waits for its last byte.

        Bytes that are no UTF-8 become U+FFFD.
        """
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in chunks:
            yield machine.decode(self.decode(ids))
        yield machine.decode(b"", True)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(rank_file: str, pattern: str) -> Codec:
    """One per Python worker; its rank file must lie at the same path on every worker."""
    if (rank_file, pattern) not in _codecs:
        _codecs[rank_file, pattern] = Codec(rank_file, pattern)
        hold("byte_bpe", _codecs.clear)
    return _codecs[rank_file, pattern]


def encode(docs: DataFrame, rank_file: str, pattern: str, column: str = "text", ids: str = "ids",
           chunk: int = 1 << 16) -> DataFrame:
    """Add the ids of each whole text (binary, little-endian unsigned 32-bit) and ``decoded``.

    ``decoded`` is what streaming decode in chunks of ids gives back, so a
    reader can compare it with the text. Null counts as an empty text and has
    no ids. Columns named like the new ones are replaced.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (ids, "decoded")]
    out = docs.select(*[F.col(f"`{c}`") for c in rest])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("byte_bpe")
        own = codec(rank_file, pattern)
        for batch in batches(source, column=column, owner="byte_bpe"):
            gc.disable()  # nothing here makes cycles, and walking the tables takes long
            try:
                texts = [t or "" for t in batch[column].to_pylist()]
                made = [own.encode(t) for t in texts]
                back = ["".join(own.decode_stream(m[i:i + 4 * chunk] for i in range(0, len(m), 4 * chunk))) for m in made]
            finally:
                gc.enable()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(made, pa.binary()), pa.array(back, pa.string())],
                names=[*batch.schema.names, ids, "decoded"],
            )

    kind = T.StructType([*out.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField("decoded", T.StringType())])
    return out.mapInArrow(run, kind)
