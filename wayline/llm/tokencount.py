"""Token counts by compiled finite-state transducers.

Two deterministic transducers run in cascade over a block of texts. The first
splits characters into words; its state maps over chunks of text are composed
by a parallel prefix scan, so every chunk learns its entry state at once. The
second is a BPE tokenizer compiled to a transducer: each transition, on a byte
or on a word's last byte, is annotated with the number of tokens that it adds.
It is compiled lazily, a transition when it is first met, and all words step
through it together. A state holds what later tokens may depend on: for each
suffix of the word that could begin a token, the last token before that suffix.

A long word is cut into chunks that step together too. A chunk's map takes entry
states to exit states and counts; as there is no end of states, it holds those
entries that are likely, the state that the symbols just before it lead to from
the beginning, and those that a neighbour's exits turn out to need. The maps are
composed by prefix scan, until no entry on the way is unknown.

Nulls are empty texts with no tokens. Special strings inside texts count as one
token, as they do in the library. Repeated rows stay repeated; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.bpe import byte_alphabet
from wayline.llm.common import per_task, resident, slices, texts

CHUNK = 512
#: The compiled transducer is dropped and begun anew beyond so many states.
MOST_STATES = 150_000
#: Symbols of a chunk of a long word, and symbols before it that its likely entry state is guessed from.
PART, BEFORE_PART = 256, 48
#: Fixed value: the word pattern of the tokenizer file. A tokenizer with another one is refused.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

SPACE, NUMBER, MARK, QUOTE, LETTER, CLOSES, R, V, L, E = range(10)
#: States: between words, in letters, in marks, after a quote that begins a word, and after such a quote and r, v or l.
OUT, IN_LETTERS, IN_MARKS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
HERE, BEFORE = 1, 2  #: a word begins at this character, at the one before


def word_splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and where words begin, of each state and class."""
    step, begins = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)
    for c in range(10):
        for s in range(7):
            letters = c >= LETTER
            held = IN_LETTERS if s >= QUOTED_R else s  # the quote was a word, r, v or l begins one
            ends = {QUOTED: {CLOSES}, QUOTED_R: {E}, QUOTED_V: {E}, QUOTED_L: {L}}.get(s, set())
            if c in ends:
                step[s, c] = OUT
                continue
            begins[s, c] = BEFORE if s >= QUOTED_R else 0
            if c == SPACE:
                step[s, c] = OUT
            elif c == NUMBER:
                step[s, c], begins[s, c] = OUT, begins[s, c] | HERE
            elif letters:
                longer = {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}
                if s == QUOTED and c in longer:
                    step[s, c] = longer[c]
                else:
                    step[s, c], begins[s, c] = IN_LETTERS, begins[s, c] | (0 if held == IN_LETTERS else HERE)
            elif held in (IN_MARKS, QUOTED):
                step[s, c] = IN_MARKS
            else:
                step[s, c], begins[s, c] = (QUOTED if c == QUOTE else IN_MARKS), begins[s, c] | HERE
    return step, begins


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    every = np.full(0x110000, MARK, np.uint8)
    text = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, text):
            first, last = ord(m[0][0]), ord(m[0][-1])
            run = np.arange(first, last + 1)
            every[run[(run < 0xD800) | (run >= 0xE000)]] = kind
    every[0x1C:0x20] = MARK
    for c, kind in (("'", QUOTE), ("r", R), ("v", V), ("l", L), ("e", E), *((c, CLOSES) for c in "stmd")):
        every[ord(c)] = kind
    return every


def word_starts(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """True where a word begins. kinds: the classes of a block that ends in a space."""
    step, begins = word_splitter()
    n = -(-len(kinds) // chunk)
    padded = np.zeros(n * chunk, np.uint8)
    padded[: len(kinds)] = kinds
    by_step = np.ascontiguousarray(padded.reshape(n, chunk).T)
    flat = step.ravel()
    maps = np.tile(np.arange(7, dtype=np.uint8), (n, 1))  # of each chunk: entry state to exit state
    for row in by_step:
        maps = flat[maps * np.uint8(10) + row[:, None]]
    reach = 1
    while reach < n:  # prefix scan: afterwards maps[i] is that of chunks 0 to i
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    state = np.zeros(n, np.uint8)
    state[1:] = maps[:-1, OUT]
    out = np.empty((chunk, n), np.uint8)
    flat_begins = begins.ravel()
    for i, row in enumerate(by_step):
        at = state * np.uint8(10) + row
        out[i], state = flat_begins[at], flat[at]
    out = out.T.ravel()[: len(kinds)]
    starts = (out & HERE).astype(bool)
    starts[:-1] |= (out[1:] & BEFORE).astype(bool)
    return starts


class Full(Exception):
    """The transducer has as many states as it may."""


class TokenTransducer:
    """The BPE of a tokenizer file; symbols are bytes, and 256 + byte for a word's last byte."""

    def __init__(self, path: str, most_states: int = MOST_STATES):
        self.most_states = most_states
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end, alphabet = model["end_of_word_suffix"], byte_alphabet()

        def symbols(token: str) -> tuple[int, ...]:
            last = token.endswith(end) and token != end
            body = [alphabet[c] for c in (token[: -len(end)] if last else token)]
            return (*body[:-1], body[-1] + 256) if last else tuple(body)

        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(symbols(a), symbols(b)): i for i, (a, b) in enumerate(merges)}
        self.tokens = {(b,) for b in range(512)} | {a + b for a, b in self.rank}
        self.begins = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.fit: dict[tuple, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = [(((), None, 0),)]  # (suffix, last token before it, tokens up to there less those up to here), longest suffix first
        self.number = {self.states[0]: 0}
        self.column = np.full(512, -1, np.int32)
        self.width = 32
        self.step = np.full((1024, self.width), -1, np.int32)
        self.adds = np.zeros((1024, self.width), np.int8)
        self.used = 0

    def encode(self, symbols: tuple[int, ...]) -> list[tuple[int, ...]]:
        parts = [(s,) for s in symbols]
        while len(parts) > 1:
            best, at = min((self.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, last: tuple | None, token: tuple) -> bool:
        """The token can follow: the two are the encoding of their text."""
        key = (last, token)
        if key not in self.fit:
            if len(self.fit) > 400_000:
                self.fit.clear()
            self.fit[key] = self.encode((last or ()) + token) == ([last, token] if last else [token])
        return self.fit[key]

    def follow(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        for suffix, last, count in state:
            token = (*suffix, symbol)
            if token in self.tokens and self.fits(last, token):
                break
        else:
            raise ValueError("the tokenizer's merges don't reach all of its tokens")
        adds = count + 1
        if symbol >= 256:
            return self.states[0], adds
        kept = [((*s, symbol), t, n - adds) for s, t, n in state if (*s, symbol) in self.begins]
        return (*kept, ((), token, 0)), adds

    def fill(self, state: int, symbol: int) -> None:
        column = self.column[symbol]
        if column < 0:
            column = self.column[symbol] = self.used
            self.used += 1
            if self.used > self.width:
                self.step = np.pad(self.step, ((0, 0), (0, 32)), constant_values=-1)
                self.adds = np.pad(self.adds, ((0, 0), (0, 32)))
                self.width += 32
        key, adds = self.follow(self.states[state], symbol)
        self.step[state, column], self.adds[state, column] = self.enter(key), adds

    def enter(self, key: tuple) -> int:
        """The number of a state."""
        if key not in self.number:
            if len(self.states) >= self.most_states:
                raise Full
            self.number[key] = len(self.states)
            self.states.append(key)
            if len(self.states) > len(self.step):
                more = len(self.step) // 2
                self.step = np.pad(self.step, ((0, more), (0, 0)), constant_values=-1)
                self.adds = np.pad(self.adds, ((0, more), (0, 0)))
        return self.number[key]

    def counts(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each word symbols[start:start + size]."""
        try:
            return self.counts_at_once(symbols, starts, sizes)
        except Full:
            self.clear()
        if len(sizes) > 1:
            half = len(sizes) // 2
            return np.concatenate((self.counts(symbols, starts[:half], sizes[:half]), self.counts(symbols, starts[half:], sizes[half:])))
        return np.array([self.count_in_turn(symbols[starts[0] : starts[0] + sizes[0]])])

    def count_in_turn(self, word: np.ndarray) -> int:
        """The same of one word with more states than there may be: they are dropped on the way."""
        key, total = self.states[0], 0
        for symbol in word.tolist():
            key, adds = self.follow(key, symbol)
            total += adds
        return total

    def counts_at_once(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n_parts = np.maximum(1, -(-sizes // PART))
        word = np.repeat(np.arange(len(sizes)), n_parts)
        place = np.arange(len(word)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
        first, size = starts[word] + place * PART, np.minimum(PART, sizes[word] - place * PART)
        entry = np.zeros((len(word), 1), np.int64)  # the entry states of each chunk's map; a word's first chunk has state 0
        later = np.flatnonzero(place > 0)
        if len(later):
            entry[later, 0], _ = self.walk(symbols, first[later] - BEFORE_PART, np.full(len(later), BEFORE_PART), np.zeros(len(later), np.int64))
        leave, count = (x[:, None] for x in self.walk(symbols, first, size, entry[:, 0]))
        while len(later):
            state = composed(entry, leave, place, later)  # where each chunk ends on the word's way, or -1
            ends = state[later - 1]
            lost = later[(ends >= 0) & ~(entry[later] == ends[:, None]).any(1)]
            if not len(lost):
                break
            more, tokens = self.walk(symbols, first[lost], size[lost], state[lost - 1])
            entry, leave, count = (np.pad(x, ((0, 0), (0, 1)), constant_values=-1) for x in (entry, leave, count))
            entry[lost, -1], leave[lost, -1], count[lost, -1] = state[lost - 1], more, tokens
        own = np.zeros(len(word), np.int64)
        if len(later):
            own[later] = state[later - 1]
        slot = (entry == own[:, None]).argmax(1)
        return np.bincount(word, weights=count[np.arange(len(word)), slot], minlength=len(sizes)).astype(np.int64)

    def walk(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state after each run of symbols from its entry state, and the tokens that it adds."""
        order = np.argsort(sizes, kind="stable")[::-1]
        first, longest = starts[order], sizes[order]
        state, total = entry[order].astype(np.int32), np.zeros(len(order), np.int32)
        active, at = len(order), 0
        while True:
            active = int(np.searchsorted(-longest[:active], -at, side="left"))  # those with more than at symbols
            if not active:
                break
            read = symbols[first[:active] + at]
            now = state[:active]
            while True:
                column = self.column[read]
                place = now * np.int64(self.width) + column
                found = np.where(column < 0, -1, self.step.ravel()[np.maximum(place, 0)])
                missing = np.flatnonzero(found < 0)
                if not len(missing):
                    break
                for key in np.unique(now[missing].astype(np.int64) << 16 | read[missing]).tolist():
                    self.fill(key >> 16, key & 0xFFFF)
            total[:active] += self.adds.ravel()[place]
            state[:active] = found
            at += 1
        states, tokens = np.empty_like(state), np.empty_like(total)
        states[order], tokens[order] = state, total
        return states, tokens


def composed(entry: np.ndarray, leave: np.ndarray, place: np.ndarray, later: np.ndarray) -> np.ndarray:
    """The state that each chunk ends in, from its word's first state on, by a prefix scan over the chunks' maps; -1: not known.

    A row of entry and leave is a chunk's map; places count the chunks of a word.
    """
    n, k = entry.shape
    own, out = entry.copy(), leave.copy()  # row i: the map of chunks i - reach + 1 to i of its word
    reach = 1
    while reach <= place.max():
        rows = later[place[later] >= reach]
        before = rows - reach
        middle = out[before]  # of each entry of the earlier map its exit, looked up in the later one
        hit = (middle[:, :, None] == own[rows][:, None, :]) & (middle >= 0)[:, :, None]
        after = np.where(hit.any(2), np.take_along_axis(out[rows], hit.argmax(2), axis=1), -1)
        own[rows], out[rows] = own[before], after
        reach *= 2
    return np.where(own == 0, out, -1).max(1, initial=-1) if k > 1 else np.where(own[:, 0] == 0, out[:, 0], -1)


class TokenCounter:
    #: Alphabets where lower case is the same as in the library: Latin without the dotted capital I, and punctuation.
    SIMPLE = re.compile(r"[\x00-įĲ-ɏ‐-‧‰-⁞€]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != WORDS:
            raise ValueError("this tokenizer splits words by another pattern")
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.transducer = TokenTransducer(path)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))

    def normal(self, text: str) -> str:
        if self.SIMPLE.fullmatch(text):
            return text.lower()
        text = unicodedata.normalize("NFC", text) if not unicodedata.is_normalized("NFC", text) else text
        return text.lower() if self.SIMPLE.fullmatch(text) else self.normalizer.normalize_str(text)

    def count(self, block: list[str]) -> np.ndarray:
        special = np.zeros(len(block), np.int64)
        ready = []
        for i, text in enumerate(block):
            if "<|" in text and any(s in text for s in self.special):
                parts = self.split_special.split(text)
                special[i] = len(parts) - 1
                ready.append(" ".join(map(self.normal, parts)))
            else:
                ready.append(self.normal(text))
        points = np.frombuffer("\n".join([*ready, ""]).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.array([len(x) + 1 for x in ready]))
        if not len(points):
            return special
        kinds = classes()[points]
        starts = word_starts(kinds)
        bounds = np.flatnonzero(starts | (kinds == SPACE))
        words = np.flatnonzero(starts[bounds[:-1]]) if len(bounds) > 1 else np.array([], np.int64)
        if not len(words):
            return special
        begin, end = bounds[words], bounds[words + 1]
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offset = np.concatenate(([0], np.cumsum(width)))
        symbols = np.frombuffer("\n".join([*ready, ""]).encode(), np.uint8).astype(np.uint16)
        first, last = offset[begin], offset[end]
        symbols[last - 1] += 256
        tokens = self.transducer.counts(symbols, first, (last - first).astype(np.int64))
        text_of = np.searchsorted(ends, begin, side="right")
        return special + np.bincount(text_of, weights=tokens, minlength=len(block)).astype(np.int64)


def counter(path: str) -> TokenCounter:
    return resident(("counter", path), lambda: TokenCounter(path))


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``n_tokens`` of every whole text."""
    base = texts(docs)
    kind = base.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for part in slices(batch):
                n = own.count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return base.withColumn("n_bytes", F.octet_length("text").cast("bigint")).mapInArrow(per_task(count), f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
