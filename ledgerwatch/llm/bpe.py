"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

Encoding. A sequence of tokens is the BPE encoding of its bytes if and only if
every two neighbours are: merging the bytes of `a` followed by those of `b` by
rank gives back exactly [a, b] (merges inside two tokens never depend on what
lies beyond them). So the merges compile into a non-deterministic transducer
whose paths are walks through the trie of all tokens; a walk that ends a token
may start the next one if the two are compatible. Every prefix has exactly one
encoding, so exactly one token can end at each byte.

Reading left to right, the transducer is determinised only as far as the input
needs: a state is the list of live paths (last token, trie node), eldest first,
and a transition gives the next state, which knows the token that ends there. Tokens
that all live paths have behind them are certain, and are read off backwards every
`WINDOW` bytes and at the end; a live path began no further back than the longest
token, so little remains. The table of transitions has a bounded size and stays
with the Python worker; whole pre-tokens are memoised during a task.

Decoding. An incremental UTF-8 state machine takes the tokens one by one and
holds back an unfinished character until the rest of it comes. Tokens of whole
characters pass a machine at rest as they are.

Nulls and edge cases: a null text is an empty one and gives no tokens; texts of
any length are read whole, a pre-token at a time; repeated rows give repeated
results; there are no ties, as every text has one encoding; bytes that no token
holds are an error; an empty table gives no rows; only `doc_id` and `text` are
read, so further columns of any name do not matter.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain, islice, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import kept, read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Transitions at most in the table of one Python worker (about 250 bytes each with their states), and pre-tokens in each half of its memo.
TABLE, MEMO = 400_000, 200_000
#: Bytes after which the tokens that are certain are read off.
WINDOW = 4096
#: Tokens that the decoder takes at a time.
CHUNK = 65_536
#: Above every rank.
NEVER = 1 << 60
#: A path is packed into one number, with the node in so many bits.
BITS = 24
LOW = (1 << BITS) - 1


class Transducer:
    """Encodes the bytes of one pre-token by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], table: int = TABLE):
        self.ranks, self.table = ranks, table
        #: The trie: child by node and byte; the token that ends at a node, whether it goes on, and its depth.
        self.child: dict[int, int] = {}
        self.token, self.inner, self.depth = array("i", [-1]), bytearray(1), array("H", [0])
        for raw, rank in ranks.items():
            node = 0
            for byte in raw:
                after = self.child.get(node << 8 | byte)
                if after is None:
                    after = self.child[node << 8 | byte] = len(self.token)
                    self.inner[node] = 1
                    self.token.append(-1)
                    self.inner.append(0)
                    self.depth.append(self.depth[node] + 1)
                node = after
            self.token[node] = rank
        self.raw = [b""] * (max(ranks.values(), default=-1) + 1)
        for raw, rank in ranks.items():
            self.raw[rank] = raw
        self.length = array("H", map(len, self.raw))
        self.grown: dict[int, tuple[list, list] | None] = {}
        self.reset()

    def reset(self) -> None:
        #: Determinised states by number: live paths, each (last token + 1) << BITS | node. State 0 is the start.
        self.states: list[tuple[int, ...]] = [(0,)]
        self.numbers = {self.states[0]: 0}
        #: The token that ends where a state is reached, -1 if none.
        self.ended = array("i", [-1])
        self.moves = Moves(self)
        #: Which tokens may follow which.
        self.pairs: dict[int, bool] = {}

    def edges(self, token: int) -> tuple[list, list] | None:
        """How the first and the last part of a token grow as its bytes merge by rank.

        Lists of (part, rank of the merge that takes it up); None if the bytes
        do not merge into the token, so that no encoding has it.
        """
        if token not in self.grown:
            ranks, parts = self.ranks, [bytes((x,)) for x in self.raw[token]]
            first, last, now = [], [], -1
            while len(parts) > 1:
                rank, at = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
                if rank == NEVER:
                    break
                now = max(now, rank)
                if at == 0:
                    first.append((parts[0], now))
                if at == len(parts) - 2:
                    last.append((parts[-1], now))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.grown[token] = (first + [(parts[0], NEVER)], last + [(parts[0], NEVER)]) if len(parts) == 1 else None
        return self.grown[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether `b` may follow `a` (-1: start): no merge across their border comes before the merges inside."""
        left, right = self.edges(a) if a >= 0 else ([], [(b"", NEVER)]), self.edges(b)
        if left is None or right is None:
            return False
        if a < 0:
            return True
        ranks, ends, starts, i, j = self.ranks, left[1], right[0], 0, 0
        while True:
            (x, until_x), (y, until_y) = ends[i], starts[j]
            rank = ranks.get(x + y, NEVER)
            if rank < until_x and rank <= until_y:
                return False
            if until_x == until_y == NEVER:
                return True
            # the merge further left goes first on equal ranks
            if until_x <= until_y:
                i += 1
            else:
                j += 1

    def move(self, state: int, byte: int) -> int:
        """Determinise one transition.

        Live paths are kept in the order in which their last token began. Only one
        of them can end a token here; the path that starts after it is the youngest.
        """
        after, ended, child, token, pairs = [], -1, self.child, self.token, self.pairs
        for path in self.states[state]:
            node = child.get((path & LOW) << 8 | byte)
            if node is None:
                continue
            if self.inner[node]:
                after.append(path & ~LOW | node)
            found = token[node]
            if found >= 0 and ended < 0:
                pair = path & ~LOW | found
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= self.table:
                        pairs.clear()
                    fits = pairs[pair] = self.compatible((path >> BITS) - 1, found)
                if fits:
                    ended = found
        if ended >= 0:
            after.append((ended + 1) << BITS)
        if not after:
            raise ValueError(f"no token of the vocabulary has byte {byte} here")
        key = tuple(after)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.ended.append(ended)
        return number

    def certain(self, trail: list[int]) -> list[int]:
        """The tokens on the way through these states (each << 8), in whose last one a token ends."""
        out, at, length, ended = [], len(trail), self.length, self.ended
        while at:
            token = ended[trail[at - 1] >> 8]
            out.append(token)
            at -= length[token]
        out.reverse()
        return out

    def settled(self, trail: list[int]) -> int:
        """How much of the way lies before the last place where all live paths end a token."""
        common = None
        for path in self.states[trail[-1] >> 8]:
            at, ends = len(trail) - self.depth[path & LOW], set()
            while at:
                ends.add(at)
                at -= self.length[self.ended[trail[at - 1] >> 8]]
            common = ends if common is None else common & ends
        return max(common or (), default=0)

    def encode(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        if len(self.moves) >= self.table:
            self.reset()
        state, moves = 0, self.moves
        if len(raw) <= WINDOW:
            return self.certain([state := moves[state | byte] for byte in raw])
        out, trail = [], []
        for at in range(0, len(raw), WINDOW):
            trail += [state := moves[state | byte] for byte in raw[at : at + WINDOW]]
            cut = self.settled(trail)
            out += self.certain(trail[:cut])
            del trail[:cut]
        return out + self.certain(trail)


class Moves(dict):
    """Transitions, made when first asked for: next state << 8, by state << 8 | byte."""

    def __init__(self, machine: Transducer):
        self.machine = machine

    def __missing__(self, key: int) -> int:
        found = self[key] = self.machine.move(key >> 8, key & 255) << 8
        return found


def _utf8_rows() -> dict[int, list[tuple[int, int, int, int]]]:
    """The UTF-8 machine by rule: for each state (first byte, last byte, next state, bits of the byte that count).

    States 1 to 3 wait for so many bytes more; 4 to 7 follow the lead bytes E0,
    ED, F0 and F4, whose second byte has a narrower range.
    """
    more = lambda after, low=0x80, high=0xBF: [(low, high, after, 0x3F)]
    lead = [(0x00, 0x7F, 0, 0x7F), (0xC2, 0xDF, 1, 0x1F), (0xE0, 0xE0, 4, 0x0F), (0xE1, 0xEC, 2, 0x0F), (0xED, 0xED, 5, 0x0F), (0xEE, 0xEF, 2, 0x0F), (0xF0, 0xF0, 6, 0x07), (0xF1, 0xF3, 3, 0x07), (0xF4, 0xF4, 7, 0x07)]
    return {0: lead, 1: more(0), 2: more(1), 3: more(2), 4: more(1, 0xA0), 5: more(1, high=0x9F), 6: more(2, 0x90), 7: more(2, high=0x8F)}


UTF8 = {state << 8 | byte: (after, bits) for state, rows in _utf8_rows().items() for low, high, after, bits in rows for byte in range(low, high + 1)}
REPLACEMENT = "\ufffd"


class Utf8Stream:
    """Incremental UTF-8: feed() returns the characters completed so far; broken ones become U+FFFD, as Python's decoder has it."""

    def __init__(self) -> None:
        self.state = self.point = 0

    def feed(self, raw: bytes) -> str:
        out, state, point = [], self.state, self.point
        for byte in raw:
            step = UTF8.get(state << 8 | byte)
            if step is None and state:
                # the character breaks off; the byte may begin another
                out.append(REPLACEMENT)
                state = point = 0
                step = UTF8.get(byte)
            if step is None:
                out.append(REPLACEMENT)
                continue
            state, point = step[0], point << 6 | byte & step[1]
            if not state:
                out.append(chr(point))
                point = 0
        self.state, self.point = state, point
        return "".join(out)

    def close(self) -> str:
        rest = REPLACEMENT if self.state else ""
        self.state = self.point = 0
        return rest


class Memo(dict):
    """Tokens of pre-tokens, in two halves of `size`: when the newer is full, it becomes the older and what is still in use comes back."""

    def __init__(self, machine: Transducer, size: int):
        self.machine, self.size, self.older = machine, size, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        found = self[piece] = self.older.get(piece) or tuple(self.machine.encode(piece.encode()))
        return found


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, path: str, pattern: str, memo: int = MEMO):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.machine, self.split, self.memo = Transducer(ranks), regex.compile(pattern), memo
        self.seen = Memo(self.machine, memo)
        #: Ids as text; tokens of whole characters as text; the other tokens.
        self.names = [str(k) for k in range(len(self.machine.raw))]
        self.text = [raw.decode("utf-8", "ignore") for raw in self.machine.raw]
        self.open = frozenset(k for k, raw in enumerate(self.machine.raw) if self.text[k].encode() != raw)

    def encode(self, text: str) -> list[int]:
        out, known = [], self.seen.__getitem__
        for pieces in self.pieces(text):
            out.extend(chain.from_iterable(map(known, pieces)))
        return out

    def forget(self) -> None:
        """Free the memo: Python workers outlive a task, and others need the memory then."""
        self.seen = Memo(self.machine, self.memo)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, in lists of bounded length."""
        if len(text) <= CHUNK:
            yield self.split.findall(text)
            return
        found = (m[0] for m in self.split.finditer(text))
        while part := list(islice(found, CHUNK)):
            yield part

    def decode(self, ids: list[int]) -> Iterator[str]:
        stream, text, raw, opened = Utf8Stream(), self.text, self.machine.raw, self.open
        for at in range(0, len(ids), CHUNK):
            part = ids[at : at + CHUNK]
            if stream.state == 0 and opened.isdisjoint(part):
                yield "".join(map(text.__getitem__, part))
            else:
                yield "".join([stream.feed(raw[k]) if stream.state or k in opened else text[k] for k in part])
        yield stream.close()


@contextmanager
def at_work(path: str | None = None, pattern: str | None = None) -> Iterator[Codec]:
    """The codec of this Python worker for the time of a task, without the cyclic garbage collector: nothing here makes cycles, and the tables are long to walk."""
    made, was = codec(path, pattern), gc.isenabled()
    gc.disable()
    try:
        yield made
    finally:
        made.forget()
        if was:
            gc.enable()


def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """The codec of this Python worker, until tasks of another operator run there; by default the public multilingual vocabulary."""
    import public_tokenizers

    mine = kept("bpe")
    if (path, pattern) not in mine:
        mine[path, pattern] = Codec(path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN)
    return mine[path, pattern]


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>): the tokens of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with at_work(path, pattern) as made:
            for batch in batches:
                for rows in slices(batch):
                    yield pd.DataFrame({"doc_id": rows["doc_id"], "ids": [made.encode(x or "") for x in rows["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, schema=f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = codec(path, None)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": ["".join(made.decode(list(x))) for x in batch["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, schema=f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def slices(batch: pd.DataFrame, chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Parts of a batch with about so many characters at most, one row at least."""
    ends = batch["text"].map(lambda x: len(x or "")).cumsum() // chars
    for _, rows in batch.groupby(ends.to_numpy(), sort=False):
        yield rows


def arrow_slices(batch: pa.RecordBatch, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """`slices` of an Arrow batch with a column text: what is not at work yet stays in Arrow's bytes."""
    lengths = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths, dtype=np.int64) // chars)) + 1
    for at, end in pairwise([0, *cuts.tolist(), len(batch)]):
        if at < end:
            yield batch.slice(at, end - at)


def _digested(made: Codec, part: pa.RecordBatch, with_ids: bool) -> pa.RecordBatch:
    rows = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": []} if with_ids else {})
    for value in part.column("text"):
        ids = made.encode(value.as_py() or "")
        read_back = hashlib.sha256()
        for piece in made.decode(ids):
            read_back.update(piece.encode())
        rows["n_tokens"].append(len(ids))
        rows["ids_sha256"].append(hashlib.sha256(",".join(map(made.names.__getitem__, ids)).encode()).hexdigest())
        rows["decoded_sha256"].append(read_back.hexdigest())
        if with_ids:
            rows["ids"].append(np.array(ids, np.int32))
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
    columns = [pa.array(x, kind) for x, kind in zip(rows.values(), kinds, strict=False)]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", *rows])


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, and decoded again from its ids; `with_ids` adds ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with at_work(path, pattern) as made:
            # no name here holds on to a batch while the next one is read
            yield from map(lambda part: _digested(made, part, with_ids), chain.from_iterable(map(arrow_slices, batches)))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema=schema + (", ids array<int>" if with_ids else ""))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
