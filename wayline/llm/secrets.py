"""Secret scans through a trigram inverted index.

Each rule's regex gives a Boolean query over the trigrams that every match
must hold: an AND of parts, each an OR of literal strings, each an AND of
trigrams. A block of texts is indexed once; postings are intersected and
united, and only candidate texts are searched with the regex. A rule without
mandatory trigrams scans every text. The index holds lower-cased ASCII, so a
candidate set is never too small for a rule that ignores case.

Nulls are empty texts and have no spans. Spans count code points of the whole
text, end exclusive, and come by start, then by the rules' order. Repeated rows
stay repeated; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import per_task, resident, slices, texts


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int  #: characters that the checked group must have
    group: int = 0
    any_case: bool = False

    @functools.cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Leftmost matches that don't overlap, without those too short; these still use up their text."""
        return [m.span() for m in self.regex.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", 24),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 20),
)
RULES = BASE + MORE

#: A class of more members than this, or a part of more strings, ends a literal part.
MOST_MEMBERS, MOST_STRINGS = 8, 64

Query = list[list[frozenset[bytes]]]  # AND of OR of AND of trigrams


def literal_parts(pattern: str) -> list[set[str]]:
    """Sets of strings, one after the other, of each of which a match holds a member."""
    from re import _parser

    def strings(nodes) -> tuple[list[set[str]], bool]:
        """Parts of a sequence; whether the only part is the whole sequence."""
        parts, now, exact = [], {""}, True

        def cut() -> None:
            nonlocal now, exact
            parts.append(now)
            now, exact = {""}, False

        def add(more: set[str]) -> None:
            nonlocal now
            if len(now) * len(more) > MOST_STRINGS:
                cut()
            now = {a + b for a, b in product(now, more)}

        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                add({chr(arg)})
            elif name == "IN":
                members = {chr(c) for kind, value in arg if str(kind) in ("LITERAL", "RANGE") for c in ([value] if str(kind) == "LITERAL" else range(value[0], value[1] + 1))}
                if len(members) <= MOST_MEMBERS and all(str(kind) in ("LITERAL", "RANGE") for kind, _ in arg):
                    add(members)
                else:
                    cut()
            elif name == "SUBPATTERN":
                inner, whole = strings(arg[3])
                if whole:
                    add(inner[0])
                else:
                    parts.append(now)
                    parts.extend(inner)
                    now, exact = {""}, False
            elif name == "BRANCH":
                options = [strings(x) for x in arg[1]]
                if all(whole for _, whole in options):
                    add(set().union(*(x[0] for x, _ in options)))
                else:
                    cut()
            elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
                inner, whole = strings(arg[2])
                if whole:
                    add(inner[0] | {""})
                else:
                    cut()
            else:
                cut()
        return [*parts, now], exact and not parts

    return strings(_parser.parse(pattern))[0]


def trigram_query(rule: Rule) -> Query | None:
    """None: the rule has no mandatory trigrams."""
    query: Query = []
    for part in literal_parts(rule.pattern):
        grams = [frozenset(b[i : i + 3] for i in range(len(b) - 2)) for b in (x.lower().encode() for x in part)]
        if all(grams):
            query.append(grams)
    return query or None


class TrigramIndex:
    """Postings of the trigrams that some rule asks for, over one block of texts."""

    def __init__(self, queries: list[Query | None]):
        grams = sorted({g for q in queries if q for part in q for option in part for g in option})
        self.slot = {g: i + 1 for i, g in enumerate(grams)}
        letters = sorted({b for g in grams for b in g})
        self.letter = np.zeros(256, np.uint32)  # the number of each byte that some trigram has; 0: none
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.width = np.uint32(len(letters) + 1)
        self.slots = np.zeros(int(self.width) ** 3, dtype=np.uint16)
        for g, i in self.slot.items():
            self.slots[self.place(*(self.letter[b] for b in g))] = i

    def place(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (a * self.width + b) * self.width + c

    def postings(self, encoded: list[bytes]) -> dict[int, np.ndarray]:
        block = np.frombuffer(b"\0".join(encoded) + b"\0", dtype=np.uint8)
        if len(block) < 3:
            return {}
        wide = self.letter[block]
        found = self.slots[self.place(wide[:-2], wide[1:-1], wide[2:])]
        at = np.flatnonzero(found)
        ends = np.cumsum(np.array([len(x) + 1 for x in encoded]))
        text = np.searchsorted(ends, at, side="right")
        pairs = np.unique(found[at].astype(np.int64) << 32 | text)
        gram, cuts = np.unique(pairs >> 32, return_index=True)
        return dict(zip(gram.tolist(), np.split(pairs & 0xFFFFFFFF, cuts[1:]), strict=True)) if len(gram) else {}

    def candidates(self, query: Query, postings: dict[int, np.ndarray]) -> np.ndarray:
        none = np.array([], dtype=np.int64)

        def every(option: frozenset[bytes]) -> np.ndarray:
            lists = sorted((postings.get(self.slot[g], none) for g in option), key=len)
            return functools.reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), lists)

        parts = [functools.reduce(np.union1d, map(every, part)) for part in query]
        return functools.reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), parts)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r) for r in rules]
        self.index = TrigramIndex(self.queries)

    def spans(self, block: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of every text, in order."""
        postings = self.index.postings([x.encode().lower() for x in block])
        found: list[list[tuple[int, int, int]]] = [[] for _ in block]
        for k, (rule, query) in enumerate(zip(self.rules, self.queries, strict=True)):
            which = range(len(block)) if query is None else self.index.candidates(query, postings).tolist()
            for i in which:
                for start, end in rule.spans(block[i]):
                    found[i].append((start, k, end))
        for x in found:
            x.sort()
        return found


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return resident(("scanner", rules), lambda: Scanner(rules))


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id`` and ``spans`` (array of kind, start, end) of every whole text."""
    base = texts(docs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(rules)
        for batch in batches:
            for part in slices(batch):
                found = own.spans(part.column("text").to_pylist())
                rows = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in x] for x in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, SPAN)], names=["doc_id", "spans"])

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(per_task(find), f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if end > at:
            out += [text[at:start], mask] if start >= at else []
            at = end
    return "".join([*out, text[at:]]) if spans else text


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """All rows and columns, every span of ``text`` replaced by ``mask`` (overlapping spans: by one); null stays null."""
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(rules)
        for batch in batches:
            for part in slices(batch):
                text = part.column("text").to_pylist()
                found = own.spans([x or "" for x in text])
                new = [x if x is None else masked(x, s, mask) for x, s in zip(text, found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if n == "text" else part.column(n) for n in names], names=names)

    cleaned = docs.mapInArrow(per_task(clean), docs.schema)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else cleaned
