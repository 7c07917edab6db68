"""Token counts by a finite-state transducer compiled from a byte-pair vocabulary.

The tokenizer is turned into a deterministic transducer over characters whose transitions carry the
change in the number of emitted tokens. A text is cut into chunks that run side by side; each chunk's
state map - what it does to the states that may enter it - is a constant from its first white space on,
where every state meets. A parallel prefix scan composes the maps. The map of a word between white space
is a constant whatever comes before, so it is remembered, and only words not seen before are run.

Byte-pair merging becomes finite-state through one fact: a token sequence is what merging gives if and
only if every two neighbours in it are (merging their joined characters gives these two). So of a
prefix only its last token matters, and the state keeps, for every place from which a token may still
reach on, the token that ends there and how many there were.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S
from ._text import Segments, WordMemory, batches

#: Characters of a chunk: enough chunks to fill vectors, long enough to hide their heads.
CHUNK = 256
#: Characters with a column in the dense table; the others take a slower way to the same result.
DENSE = 64
#: Characters that run at once, and the last ones of a chunk that suggest in which state it ends.
BLOCK, WARM = 1 << 18, 48
#: States after which the tables start afresh, and words whose state map is remembered, so that memory
#: stays bounded.
MOST_STATES, MOST_WORDS = 250_000, 2_000_000
#: What follows an apostrophe at the start of a piece, and is then one piece with it: fixed values of
#: the vocabulary's splitting pattern.
AFTER_APOSTROPHE = ("s", "t", "m", "d")
AFTER_APOSTROPHE_TWO = {"r": "e", "v": "e", "l": "l"}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others for the code points from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class Merges:
    """Byte-pair merging of one piece, lazily turned into a transducer over its bytes."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.suffix = suffix
        self.vocab = vocab
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank = {p: k for k, p in enumerate(pairs)}
        self.made = {a + b: (k, a, b) for k, (a, b) in reversed(list(enumerate(pairs)))}
        self.prefixes: set[str] = set()
        self.longest = 0
        for token in vocab:
            parts = self.parts(token)
            self.longest = max(self.longest, len(parts))
            self.prefixes.update("".join(parts[:k]) for k in range(1, len(parts)))
        self.fits: dict[tuple[str, str], bool] = {}
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self.start = self.number(("", ((0, "", 0),)))

    def parts(self, token: str) -> list[str]:
        """Base symbols of a token: its letters, the last with the end mark if it has one."""
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge neighbours, lowest rank first and leftmost among equals, until none can merge."""
        symbols = list(symbols)
        while len(symbols) > 1:
            ranks = [self.rank.get(p, len(self.rank)) for p in zip(symbols, symbols[1:])]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == len(self.rank):
                break
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols

    def neighbours(self, a: str, b: str) -> bool:
        """Whether merging the joined characters of two tokens gives these two.

        Undo the merges, last first. Each time, the two symbols that meet at the border lay there until
        one of them was used up; a merge of both that ranks earlier would have crossed it. Equal ranks
        go to the left: a use on the left comes first, one on the right comes too late.
        """
        pair = (a, b)
        if (found := self.fits.get(pair)) is not None:
            return found
        until, found = len(self.rank), True
        while True:
            if self.rank.get((a, b), until) < until:
                found = False
                break
            left, right = self.made.get(a), self.made.get(b)
            if left is None and right is None:
                break
            if right is None or left is not None and left[0] > right[0]:
                until, a = left[0], left[2]
            else:
                until, b = right[0] + 1, right[1]
        self.fits[pair] = found
        return found

    def number(self, state: tuple) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
        return self.ids[state]

    def step(self, at: int, symbol: str) -> tuple[int, int]:
        """(next state, change in the number of tokens) on one base symbol."""
        if (done := self.steps.get((at, symbol))) is not None:
            return done
        tail, places = self.states[at]
        alive, found, size = [], None, len(tail)
        for length, last, count in places:
            reach = tail[size - length :] + symbol
            if found is None and reach in self.vocab and (not last or self.neighbours(last, reach)):
                found = (reach, count + 1)
            if reach in self.prefixes:
                alive.append((length + len(symbol), last, count))
        token, count = found
        alive.append((0, token, count))
        longest = alive[0][0]
        whole = tail + symbol
        state = (whole[len(whole) - longest :], tuple((n, t, c - count) for n, t, c in alive))
        done = self.steps[at, symbol] = (self.number(state), count)
        return done


class Transducer:
    """The whole tokenizer, from normalised characters to token counts; tables fill as texts need them."""

    START = 0

    def __init__(self, path: str):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.memory = WordMemory(MOST_WORDS)
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.source = (model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.letters = byte_letters()
        self.kinds: dict[str, str] = {}
        self.look_up = np.full(0x110000, -1, dtype=np.int32)
        self.symbols: list[str] = []
        self.symbol("\n")
        self.clear()

    def clear(self) -> None:
        self.merges = Merges(*self.source)
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.other: dict[tuple[int, int], tuple[int, int]] = {}
        self.next = np.full((1024, DENSE), -1, dtype=np.int32)
        self.gain = np.zeros((1024, DENSE), dtype=np.int16)
        self.number(("", 0, ""))

    def symbol(self, c: str) -> int:
        k = self.look_up[ord(c)]
        if k < 0:
            k = self.look_up[ord(c)] = len(self.symbols)
            self.symbols.append(c)
            kind = unicodedata.category(c)
            kind = self.newer_kind(c) if kind == "Cn" else kind[0]
            self.kinds[c] = " " if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else kind if kind in "LN" else "'" if c == "'" else "P"
        return int(k)

    def newer_kind(self, c: str) -> str:
        """The kind of a character that is younger than Python's tables, from the library's splitting."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        split = lambda s: len(self.library.pre_tokenizer.pre_tokenize_str(s))
        return "L" if split("a" + c) == 1 else "N" if split(c + c) == 2 else "P"

    def number(self, state: tuple) -> int:
        if (k := self.ids.get(state)) is None:
            k = self.ids[state] = len(self.states)
            self.states.append(state)
            if k >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.gain = np.concatenate([self.gain, np.zeros_like(self.gain)])
        return k

    def bytes_of(self, c: str) -> list[str]:
        return [self.letters[b] for b in c.encode("utf-8", "surrogatepass")]

    def go(self, at: int, c: str) -> tuple[int, int]:
        total = 0
        for b in self.bytes_of(c):
            at, gain = self.merges.step(at, b)
            total += gain
        return at, total

    def close(self, at: int, c: str) -> int:
        """Tokens gained when ``c`` is the last character of the piece."""
        *front, last = self.bytes_of(c)
        total = 0
        for b in [*front, last + self.merges.suffix]:
            at, gain = self.merges.step(at, b)
            total += gain
        return total

    def piece(self, chars: str) -> int:
        at, total = self.merges.start, 0
        for c in chars[:-1]:
            at, gain = self.go(at, c)
            total += gain
        return total + self.close(at, chars[-1])

    def transition(self, state: tuple, c: str) -> tuple[tuple, int]:
        """(next state, tokens gained). A state is (open piece, merge state before its last character,
        that character): the last character waits, since it merges otherwise at the end of a piece."""
        mode, at, held = state
        kind, first = self.kinds[c], self.merges.start
        if mode == "":
            if kind == " ":
                return ("", 0, ""), 0
            if kind == "N":
                return ("", 0, ""), self.close(first, c)
            return ({"L": "L", "'": "'", "P": "P"}[kind], first, c), 0
        if mode == "'":
            if c in AFTER_APOSTROPHE:
                return ("", 0, ""), self.piece("'" + c)
            if c in AFTER_APOSTROPHE_TWO:
                return ("'" + c, first, c), 0
            mode = "P"
        if len(mode) == 2:
            if c == AFTER_APOSTROPHE_TWO[held]:
                return ("", 0, ""), self.piece("'" + held + c)
            after, gain = self.transition(("L", first, held), c)
            return after, gain + self.close(first, "'")
        if kind == mode or mode == "P" and kind == "'":
            at, gain = self.go(at, held)
            return (mode, at, c), gain
        after, gain = self.transition(("", 0, ""), c)
        return after, gain + self.close(at, held)

    def missing(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and gains for (state, symbol) pairs without an entry in the dense table."""
        pairs, back = np.unique(states.astype(np.int64) << 32 | symbols, return_inverse=True)
        got = []
        for s, k in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), strict=True):
            if (done := self.other.get((s, k))) is None:
                after, gain = self.transition(self.states[s], self.symbols[k])
                done = (self.number(after), gain)
                if k < DENSE:
                    self.next[s, k], self.gain[s, k] = done
                else:
                    self.other[s, k] = done
            got.append(done)
        got = np.array(got, dtype=np.int32)[back.ravel()]
        return got[:, 0], got[:, 1]

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One character in every lane."""
        flat = states * DENSE + np.minimum(symbols, DENSE - 1)
        after, gains = self.next.ravel()[flat], self.gain.ravel()[flat]
        lack = np.flatnonzero((after < 0) | (symbols >= DENSE - 1))
        if len(lack):
            after[lack], gains[lack] = self.missing(states[lack], symbols[lack])
        return after, gains

    def as_symbols(self, codes: np.ndarray) -> np.ndarray:
        symbols = self.look_up[codes]
        if len(new := np.flatnonzero(symbols < 0)):
            for code in np.unique(codes[new]).tolist():
                self.symbol(chr(code))
            symbols = self.look_up[codes]
        return symbols

    def gains(self, codes: np.ndarray, enter: int = START) -> tuple[np.ndarray, int]:
        """(tokens gained at each of the characters, state after them) from an entering state.

        What a chunk gains before its first white space stands at its first character.
        """
        symbols = self.as_symbols(codes)
        lanes = -(-len(symbols) // CHUNK)
        # What fills the last chunk is white space, but its state is taken before it.
        grid = np.zeros(lanes * CHUNK, dtype=np.int32)
        grid[: len(symbols)] = symbols
        white = np.array([self.kinds[c] == " " for c in self.symbols])
        rows = grid.reshape(lanes, CHUNK)
        is_white = white[rows]
        head = np.where(is_white.any(1), is_white.argmax(1), CHUNK)
        out = np.zeros((CHUNK, lanes), dtype=np.int32)
        # From the first white space on, nothing depends on the entering state.
        steps = np.ascontiguousarray(np.where(np.arange(CHUNK)[None, :] < head[:, None], 0, rows).T)
        state = np.zeros(lanes, dtype=np.int32)
        stop = len(symbols) - (lanes - 1) * CHUNK
        last = self.START
        for t in range(CHUNK):
            state, out[t] = self.step(state, steps[t])
            if t == stop - 1:
                last = int(state[-1])
        entry, gained, left = self.heads(rows, head, state, enter, stop)
        out[0] += gained
        return out.T.ravel()[: len(symbols)], last if head[-1] < stop else left

    def run(self, rows: np.ndarray, length: np.ndarray, chunk: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after, tokens gained) of the first ``length`` characters of each chunk from the states entered."""
        state, gained = enter.astype(np.int32), np.zeros(len(chunk), dtype=np.int64)
        most = length[chunk]
        for t in range(int(most.max(initial=0))):
            on = np.flatnonzero(most > t)
            state[on], got = self.step(state[on], rows[chunk[on], t])
            gained[on] += got
        return state, gained

    def heads(self, rows: np.ndarray, head: np.ndarray, tail: np.ndarray, enter: int, stop: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(entering state, tokens gained in the head, by chunk; state after the last one if it is all head).

        A chunk's state map holds the states that may enter it: the one known where its neighbour holds
        white space, and else what the neighbour's last characters suggest and what its own map leads
        to. All maps grow side by side until none leads out of the next; then they are composed by a
        prefix scan, in as many rounds as the longest run of chunks without white space has bits.
        """
        lanes = len(rows)
        through = head == CHUNK
        through[-1] = head[-1] >= stop
        length = np.minimum(head + 1, CHUNK)
        length[-1] = min(int(head[-1]) + 1, stop)
        anchor = np.ones(lanes, dtype=bool)
        anchor[1:] = ~through[:-1]
        before = np.concatenate([[enter], tail[:-1]]).astype(np.int64)
        if len(inner := np.flatnonzero(~anchor)):
            warm = min(WARM, CHUNK)
            before[inner] = self.run(rows[:, CHUNK - warm :], np.full(lanes, warm), inner - 1, np.full(len(inner), self.START))[0]
        known, after, gained = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        front = np.arange(lanes) << 32 | before
        while len(front):
            state, got = self.run(rows, length, front >> 32, front & 0xFFFFFFFF)
            leads = ((front >> 32) + 1) << 32 | state
            at = np.searchsorted(known, front)
            known, after, gained = np.insert(known, at, front), np.insert(after, at, leads), np.insert(gained, at, got)
            leads = np.unique(leads[through[front >> 32]])
            leads = leads[leads >> 32 < lanes]
            front = leads[~np.isin(leads, known)]
        # The prefix scan: jump[e] is the entry that lies 1, 2, 4, ... chunks after e.
        jump = np.minimum(np.searchsorted(known, after), len(known) - 1)
        starts = np.flatnonzero(anchor)
        steps = np.arange(lanes) - starts[np.cumsum(anchor) - 1]
        entry = np.searchsorted(known, np.arange(lanes) - steps << 32 | before[np.arange(lanes) - steps])
        for bit in range(int(steps.max(initial=0)).bit_length()):
            on = steps >> bit & 1 > 0
            entry[on] = jump[entry[on]]
            jump = jump[jump]
        return known[entry] & 0xFFFFFFFF, gained[entry], int(after[entry[-1]] & 0xFFFFFFFF)

    def prepare(self, text: str) -> tuple[str, int]:
        """(normalised text, special strings taken out of it); those become white space."""
        n = 0
        if self.special and "<|" in text:
            text, n = self.special.subn("\n", text)
        if not text.isascii():
            # Composition is undone by no boundary made of white space, so the pieces stay apart.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower(), n

    def words(self, words: list[str]) -> np.ndarray:
        """Tokens of each word (a string without ASCII white space)."""
        codes = np.frombuffer("\n".join([*words, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        edges = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).astype(np.int64)
        total, state = np.zeros(len(words), dtype=np.int64), self.START
        for k in range(0, len(codes), BLOCK):
            if len(self.states) > MOST_STATES:
                state = self.afresh(state)
            got, state = self.gains(codes[k : k + BLOCK], state)
            sums = np.concatenate([[0], np.cumsum(got.astype(np.int64))])
            a, b = np.searchsorted(edges, [k, k + len(got)], side="right") - 1
            inside = np.clip(edges[a : b + 2] - k, 0, len(got))
            total[a : b + 1] += np.diff(sums[inside])[: len(total) - a]
        return total

    def afresh(self, state: int) -> int:
        """Empty the tables; the number of ``state`` in the new ones."""
        mode, at, held = self.states[state]
        inner = self.merges.states[at]
        self.clear()
        return self.number((mode, self.merges.number(inner), held))

    def words_of(self, words: list[bytes]) -> np.ndarray:
        return self.words([w.decode("utf-8", "surrogatepass") for w in words])

    def counts(self, texts: Iterable[str | None]) -> np.ndarray:
        """Tokens of each text; null counts as empty."""
        ready, result = [], []
        for text in texts:
            text, n = self.prepare(text or "")
            ready.append(text.encode("utf-8", "surrogatepass"))
            result.append(n)
        result = np.array(result, dtype=np.int64)
        for k, end in batches(ready, 1_000_000):
            if self.memory.full:
                self.memory = WordMemory(MOST_WORDS)
            seen = Segments(ready[k:end])
            values = self.memory.values(seen, self.words_of)
            sums = np.concatenate([[0], np.cumsum(values)])
            result[k:end] += sums[seen.first[1:]] - sums[seen.first[:-1]]
        return result


_built: dict[str, Transducer] = {}
S.CLEAR["token_fst"] = _built.clear


def transducer(path: str) -> Transducer:
    """The compiled tokenizer of this worker process; its tables stay from task to task."""
    if path not in _built:
        _built.clear()
        _built[path] = Transducer(path)
    return _built[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, one row per input row.

    ``path`` names the vocabulary file on the workers. Null and empty texts have 0 bytes and 0 tokens;
    null ids, repeated rows and further columns are no matter; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.only("token_fst")
        machine = transducer(path)
        for batch in S.slices(batches):
            texts = batch.column(1).to_pylist()
            counts = machine.counts(texts)
            n_bytes = [0 if t is None else len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    base = S.small_batches(docs).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return base.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
