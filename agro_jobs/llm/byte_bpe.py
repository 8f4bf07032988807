"""Byte-level BPE as a finite-state transducer, and decoding as a stream.

Encoding. The token that ends the encoding of a prefix is unique, and a row of tokens is an encoding
if each two neighbours stay apart when merged alone. So the encoder walks a piece byte by byte and
keeps, for every position at which a longer token may still start, the last token before it: these
are the leaves of a tree of undecided tokens. What all leaves agree on is emitted, after a lookahead
of at most one token's length. A state is that tree with the trie node of each leaf; states and
transitions are made when a text first needs them (lazy determinisation) and forgotten when more
than `MOST` are held, so memory is bounded and results stay the same.

Decoding. Bytes of tokens run through a UTF-8 state machine that holds back an unfinished character
until its last byte arrives and puts U+FFFD for each longest malformed part. Tokens that start and
end between characters go through in one step.

Nulls: a null text is the empty text, which has no tokens; null ids decode to the empty text. Texts may
be of any length: they are cut into pieces one after another. Repeated rows are rows of their own, an
empty table gives no rows, and the other columns are returned as they are; a column of the name of
the new one is replaced by it.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

MOST = 1 << 20  # transitions that a worker remembers
PAIRS = 1 << 18  # answers about tokens that it remembers
WORDS, PIECES, SHORT = 1 << 19, 1 << 18, 48  # words and pieces it remembers, of at most so many characters
BYTES_AT_ONCE = 1 << 20
CHARACTERS_AT_ONCE = 1 << 20
BLANKS = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S)(?= )")  # no piece of a pattern like the public ones goes on from a printed character into a space
TOKENS_AT_ONCE = 1 << 14
NONE, ROOT, DEAD = -1, 0, -1


def read_ranks(path: str) -> bytes:
    """The contents of a rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return f.read()


def ranks_of(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Memory(dict):
    """Answers of a function, kept until there are too many and then forgotten together: a look into it is one look into a dict."""

    def __init__(self, answer: Callable, most: int):
        super().__init__()
        self.answer, self.most = answer, most

    def __missing__(self, question):
        if len(self) >= self.most:
            self.clear()
        found = self[question] = self.answer(question)
        return found


class Transducer:
    """Tokens of one piece at a time. All 256 single bytes must be tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.trie: dict[int, int] = {}
        self.token_at: list[int] = [NONE]
        for token, rank in ranks.items():
            node = ROOT
            for b in token:
                step = node << 8 | b
                node = self.trie.get(step, 0)
                if not node:
                    node = self.trie[step] = len(self.token_at)
                    self.token_at.append(NONE)
            self.token_at[node] = rank
        self.apart, self.halves, self.made = Memory(self._apart, PAIRS), Memory(self._halves, PAIRS), Memory(self._made, PAIRS)
        self._forget()

    def _forget(self) -> None:
        """Back to the start state: a leaf at the root of the trie with no token before it."""
        self.states: list[bytes] = []
        self.rests: list[tuple[int, ...] | None] = []  # of the states in which a piece has ended
        self.numbers: dict[bytes, int] = {}
        self.steps: dict[int, int | tuple[int, tuple[int, ...]]] = {}  # the next state, with the tokens that are certain then if there are any
        self._number([ROOT, NONE, DEAD])

    def _halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two tokens whose merge makes this one."""
        cuts = list(range(len(token) + 1))
        while len(cuts) > 3:
            del cuts[min((self.ranks.get(token[a:c], 1 << 62), k) for k, (a, c) in enumerate(zip(cuts, cuts[2:], strict=False)))[1] + 1]
        return token[: cuts[1]], token[cuts[1] :]

    def _apart(self, pair: int) -> bool:
        """Do two tokens (left + 1 and right, 32 bits each) stay apart when their bytes are merged together (left may be NONE)?

        Merges happen by rising rank, the leftmost first. Undone from the last on, they show every pair of parts that
        ever met at the boundary, with the ranks at which each part was merged away; a pair that would have merged earlier crosses it.
        Only for tokens that merges lead to: the merges of others can't be undone.
        """
        right = pair & 0xFFFFFFFF
        a, b = self.tokens.get((pair >> 32) - 1, b""), self.tokens[right]
        gone_a = gone_b = 1 << 62
        while a:
            rank = self.ranks.get(a + b)
            if rank is not None and rank < gone_a and rank <= gone_b:
                return False
            if len(a) > 1 and (len(b) == 1 or self.ranks[a] > self.ranks[b]):
                gone_a, a = self.ranks[a], self.halves[a][1]
            elif len(b) > 1:
                gone_b, b = self.ranks[b], self.halves[b][0]
            else:
                return True
        return True

    def _made(self, token: int) -> bool:
        """Whether merges lead to the token at all."""
        data = self.tokens[token]
        cuts = list(range(len(data) + 1))
        while len(cuts) > 2:
            rank, at = min((self.ranks.get(data[a:c], 1 << 62), k) for k, (a, c) in enumerate(zip(cuts, cuts[2:], strict=False)))
            if rank == 1 << 62:
                return False
            del cuts[at + 1]
        return True

    def _tree(self, state: int) -> list[tuple[int, int, int]]:
        """(trie node or DEAD, last token, place of the parent) of every entry; the first one is the root."""
        flat = memoryview(self.states[state]).cast("i").tolist()
        return list(zip(flat[::3], flat[1::3], flat[2::3], strict=True))

    def _step(self, state: int, byte: int) -> int | tuple[int, tuple[int, ...]]:
        """What follows a state on one more byte, as `steps` keeps it."""
        if len(self.steps) >= MOST:
            tree = [x for entry in self._tree(state) for x in entry]
            self._forget()
            state = self._number(tree)
        trie, token_at = self.trie, self.token_at
        nodes, tokens, parents, grown = [], [], [], None
        for at, (node, token, parent) in enumerate(self._tree(state)):
            if node != DEAD:
                node = trie.get(node << 8 | byte, DEAD)
                if grown is None and node != DEAD and (new := token_at[node]) != NONE and self.made[new] and self.apart[token + 1 << 32 | new]:
                    grown = (new, at)
            nodes.append(node)
            tokens.append(token)
            parents.append(parent)
        nodes.append(ROOT)
        tokens.append(grown[0])
        parents.append(grown[1])
        # Entries that lead to a living leaf, and how many such entries hang on each.
        needed, children = [n != DEAD for n in nodes], [0] * len(nodes)
        for k in range(len(nodes) - 1, 0, -1):
            if needed[k]:
                needed[parents[k]] = True
                children[parents[k]] += 1
        # What all living leaves have in common is certain.
        top, emitted = 0, []
        while nodes[top] == DEAD and children[top] == 1:
            top = next(k for k in range(top + 1, len(nodes)) if needed[k] and parents[k] == top)
            emitted.append(tokens[top])
        kept = [k for k in range(top, len(nodes)) if needed[k]]
        place = {k: i for i, k in enumerate(kept)}
        new: list[int] = []
        for k in kept:
            new += (nodes[k], NONE if k == top and nodes[k] == DEAD else tokens[k], DEAD if k == top else place[parents[k]])
        number = self._number(new)
        found = self.steps[state << 8 | byte] = (number, tuple(emitted)) if emitted else number
        return found

    def _number(self, flat: list[int]) -> int:
        tree = array("i", flat).tobytes()
        number = self.numbers.setdefault(tree, len(self.states))
        if number == len(self.states):
            self.states.append(tree)
            self.rests.append(None)
        return number

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:  # also a token that no merges lead to
            return (whole,)
        out: list[int] = []
        state, known = 0, self.steps
        for byte in piece:
            then = known.get(state << 8 | byte)
            if then is None:
                then = self._step(state, byte)
                known = self.steps
            if type(then) is int:
                state = then
            else:
                state, emitted = then
                out += emitted
        out += self.rests[state] or self._rest(state)
        return tuple(out)

    def _rest(self, state: int) -> tuple[int, ...]:
        """The tokens that a piece which ends in this state still has to get."""
        tree, rest = self._tree(state), []
        leaf = len(tree) - 1
        while tree[leaf][2] != DEAD:
            rest.append(tree[leaf][1])
            leaf = tree[leaf][2]
        found = self.rests[state] = tuple(reversed(rest))
        return found


class Encoder:
    """Ids of whole texts, word by word; words and pieces seen lately come from memory.

    A text is cut before spaces that follow a printed character, where no match of the pattern can
    cross, and every such word is matched alone.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        machine, self.split = Transducer(ranks), regex.compile(pattern)
        self.machine = machine
        self.piece = Memory(lambda piece: machine.encode(piece.encode()), PIECES)
        self.known = Memory(self.word, PIECES)
        self.known_after_space = Memory(lambda word: self.word(" " + word), WORDS)

    def word(self, word: str) -> tuple[int, ...]:
        if len(word) > SHORT:
            return tuple(i for m in self.split.finditer(word) for i in self.machine.encode(m[0].encode()))
        out: list[int] = []
        for piece in self.split.findall(word):
            out += self.piece[piece]
        return tuple(out)

    def encode(self, text: str) -> array:
        out, at = array("I"), 0
        while at < len(text):
            end = CUT.search(text, at + CHARACTERS_AT_ONCE) if at + CHARACTERS_AT_ONCE < len(text) else None
            end = end.start() if end else len(text)
            block = text[at:end]
            if BLANKS.search(block) or block[0] == " ":
                words, known = CUT.split(block), self.known
            else:  # every space begins a word
                first, *words = block.split(" ")
                out.extend(self.known[first] if len(first) <= SHORT else self.word(first))
                known = self.known_after_space
            if max(map(len, words), default=0) <= SHORT:
                out.extend(chain.from_iterable(map(known.__getitem__, words)))
            else:
                for word in words:
                    out.extend(known[word] if len(word) <= SHORT else known.answer(word))
            at = end
        return out


def _utf8_machine() -> list[list[int]]:
    """next[state][byte]; 0: between characters, 1 to 3: so many bytes to come, 4 to 7: second bytes of narrower range, -1: malformed."""
    table = [[-1] * 256 for _ in range(8)]

    def put(state: int, first: int, last: int, then: int) -> None:
        table[state][first : last + 1] = [then] * (last + 1 - first)

    put(0, 0x00, 0x7F, 0)
    put(0, 0xC2, 0xDF, 1)
    put(0, 0xE1, 0xEF, 2)
    put(0, 0xF1, 0xF3, 3)
    for lead, state, first, last, then in ((0xE0, 4, 0xA0, 0xBF, 1), (0xED, 5, 0x80, 0x9F, 1), (0xF0, 6, 0x90, 0xBF, 2), (0xF4, 7, 0x80, 0x8F, 2)):
        put(0, lead, lead, state)
        put(state, first, last, then)
    for state in (1, 2, 3):
        put(state, 0x80, 0xBF, state - 1)
    return table


NEXT = _utf8_machine()


class Decoder:
    """Text of tokens, as a stream: `feed` returns what is complete, `close` the rest."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.whole = np.array([self._closed(t) for t in self.bytes], bool)
        self.state, self.held = 0, b""

    @staticmethod
    def _closed(token: bytes) -> bool:
        state = 0
        for b in token:
            state = NEXT[state][b]
            if state < 0:
                return False
        return state == 0

    def _push(self, token: bytes) -> str:
        out, held, state = [], bytearray(self.held), self.state
        for b in token:
            then = NEXT[state][b]
            if then < 0 and held:  # what was held is malformed; the byte may start anew
                out.append("�")
                held.clear()
                then = NEXT[0][b]
            if then < 0:
                out.append("�")
                state = 0
                continue
            held.append(b)
            state = then
            if not state:
                out.append(held.decode())
                held.clear()
        self.state, self.held = state, bytes(held)
        return "".join(out)

    def feed(self, ids: np.ndarray) -> str:
        """The characters that end with these tokens."""
        out, at, names = [], 0, self.bytes
        for odd in [*np.flatnonzero(~self.whole[ids]).tolist(), len(ids)]:
            while at < odd and self.held:  # a character begun before
                out.append(self._push(names[ids[at]]))
                at += 1
            if at < odd:
                out.append(b"".join(map(names.__getitem__, ids[at:odd].tolist())).decode())
            if odd < len(ids):
                out.append(self._push(names[ids[odd]]))
            at = odd + 1
        return "".join(out)

    def close(self) -> str:
        rest, self.state, self.held = "�" if self.held else "", 0, b""
        return rest

    def decode(self, ids: np.ndarray) -> str:
        parts = [self.feed(ids[k : k + TOKENS_AT_ONCE]) for k in range(0, len(ids), TOKENS_AT_ONCE)]
        return "".join([*parts, self.close()])


@lru_cache(2)
def _encoder(content: bytes, pattern: str) -> Encoder:
    return Encoder(ranks_of(content), pattern)


@lru_cache(2)
def _decoder(content: bytes) -> Decoder:
    return Decoder(ranks_of(content))


def _mapped(df: DataFrame, source: str, made: list[tuple[str, object]], work) -> DataFrame:
    """df with the columns `made` of `source` by `work` (a value to a tuple), about a MB of values at a time."""
    fields = [f for f in df.schema.fields if f.name not in [n for n, _ in made]]
    kept = [f.name for f in fields]
    schema = StructType([*fields, *[StructField(n, t, False) for n, t in made]])
    types = [pa.binary() if isinstance(t, BinaryType) else pa.string() for _, t in made]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for batch in batches:
            values, at = batch.column(source), 0
            while at < batch.num_rows:
                rows, size = [], 0
                while at + len(rows) < batch.num_rows and size < BYTES_AT_ONCE:
                    value = values[at + len(rows)].as_py()
                    size += len(value or "")
                    rows.append(each(value))
                part = batch.slice(at, len(rows))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), *columns], names=[*kept, *[n for n, _ in made]])
                at += len(rows)

    return df.mapInArrow(run, schema)


def _packed(ids: array) -> bytes:
    return np.frombuffer(ids, np.uint32).astype("<u4").tobytes()


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with `ids`: the tokens of the text as little-endian unsigned 32-bit integers, in binary.

    The rank file (about 1 MB, whatever the corpus) is broadcast; every worker compiles it once.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def work():
        encoder = _encoder(*shared.value)
        return lambda t: (_packed(encoder.encode(t or "")),)

    return _mapped(docs, text, [(ids, BinaryType())], work)


def decode(rows: DataFrame, ranks: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with `decoded`: the text of `ids`."""
    shared = rows.sparkSession.sparkContext.broadcast(ranks)

    def work():
        decoder = _decoder(shared.value)
        return lambda x: (decoder.decode(np.frombuffer(x or b"", "<u4")),)

    return _mapped(rows, ids, [(text, StringType())], work)


def there_and_back(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with `ids` and with `decoded`, the text made of the ids again, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def work():
        encoder, decoder = _encoder(*shared.value), _decoder(shared.value[0])

        def both(value: str | None) -> tuple[bytes, str]:
            coded = _packed(encoder.encode(value or ""))
            return coded, decoder.decode(np.frombuffer(coded, "<u4"))

        return both

    return _mapped(docs, text, [(ids, BinaryType()), (decoded, StringType())], work)


def digests(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, one row per row of docs."""
    return there_and_back(docs.select("doc_id", "text"), ranks, pattern).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
