"""Secrets in texts, by one deterministic automaton for all rules.

The rules' regular expressions are read backwards, joined, made deterministic by subset construction and
minimised into one transition table (``automata``).  One pass over the bytes of a text, from its end, then
marks for every rule at once each place at which a match begins.  From the leftmost mark of a rule an
anchored automaton finds the longest match; the rule's next match begins at or after its end.  That is what a
leftmost, greedy search finds for rules whose alternatives are no prefixes of each other.

Bytes that take every state back to the first one (a line feed, say) cut texts into stretches that don't
depend on each other.  Stretches are scanned in step, one byte of each at a time; what is left of the few
longest is scanned byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from spanloom.llm import automata
from spanloom.llm.common import fresh

BATCH_BYTES = 1 << 22  # text that is scanned at once; a longer text is a batch of its own
IN_STEP = 48  # stretches that are worth scanning in step
_BREAK = b"\xff"  # in no text


@dataclass(frozen=True)
class Rule:
    """``lead`` then ``body``; a match counts if ``body`` takes ``least`` bytes or more.

    Matches that are too short are dropped after the search, so they still hide what they cover.
    """

    kind: str
    lead: str
    body: str
    least: int = 1
    any_case: bool = False


# Fixed values of the contract.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 12, True),
    Rule("access", "", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", "", r"[0-9a-f]{16,}"),
)
# Public formats of keys and tokens.
FORMAT_RULES = (
    Rule("private_key", "", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("github", "", r"gh[opsru]_[A-Za-z0-9]+", 40),
    Rule("slack", "", r"xox[abeoprs]-[A-Za-z0-9-]+", 20),
    Rule("google", "", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", "", r"[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("jwt", "", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("url_login", "://", r"[A-Za-z0-9._~%+-]+:[!-.0-9;-?A-~]+@"),
)
RULES = (*BASE_RULES, *FORMAT_RULES)


class Scanner:
    """The automata of a list of rules."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        trees = [automata.parse(r.lead + r.body, r.any_case) for r in rules]
        self.begins = automata.build(trees, backward=True, anywhere=True)
        self.whole = [automata.build([tree]) for tree in trees]
        self.leads = [automata.build([automata.parse(r.lead, r.any_case)]) if r.lead else None for r in rules]
        table = self.begins.table
        if self.begins.accepts[0]:
            raise ValueError("a rule matches the empty text")
        self.width = table.shape[1]
        self.flat = (table * self.width).ravel()  # states as offsets of their rows
        self.plain = self.flat.tolist()
        self.cuts = (table == 0).all(axis=0)[self.begins.classes]
        assert self.cuts[_BREAK[0]]

    def marks(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places at which matches begin, ascending, and the rules of each as bits."""
        raw = np.frombuffer(data, np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], self.cuts[raw], [True]]).astype(np.int8)))
        begin, last = edge[::2], edge[1::2] - 1
        size = last - begin + 1
        order = np.argsort(-size, kind="stable")
        begin, last, size = begin[order], last[order], size[order]
        columns = self.begins.classes[raw]
        accepting = self.begins.first_accepting * self.width
        state = np.zeros(len(size), np.int64)
        places, states = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        longest = int(size[0]) if len(size) else 0
        active = len(size) - np.searchsorted(size[::-1], np.arange(longest), side="right")
        done = 0
        for done, n in enumerate(active.tolist()):
            if n < IN_STEP:
                break
            at = last[:n] - done
            now = self.flat.take(state[:n] + columns.take(at))
            state[:n] = now
            hit = np.flatnonzero(now >= accepting)
            if len(hit):
                places.append(at[hit])
                states.append(now[hit])
        else:
            done = longest
        plain, few_at, few_state = self.plain, [], []
        for i in range(int(active[done]) if done < longest else 0):
            now = int(state[i])
            place = int(last[i]) - done
            for column in columns[begin[i]:place + 1][::-1].tobytes():
                now = plain[now + column]
                if now >= accepting:
                    few_at.append(place)
                    few_state.append(now)
                place -= 1
        place = np.concatenate([*places, np.array(few_at, np.int64)])
        rules = self.begins.accepts[np.concatenate([*states, np.array(few_state, np.int64)]) // self.width]
        order = np.argsort(place, kind="stable")
        return place[order], rules[order]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """``begin, rule, end`` in bytes, sorted."""
        found = []
        place, rules = self.marks(data)
        for number, rule in enumerate(self.rules):
            free, lead = 0, self.leads[number]
            for begin in place[rules >> number & 1 == 1].tolist():
                if begin >= free:
                    free = self.whole[number].longest(data, begin)
                    body = lead.longest(data, begin) if lead else begin
                    if free - body >= rule.least:
                        found.append((begin, number, free))
        return sorted(found)

    def of_texts(self, texts: list[bytes]) -> Iterator[list[tuple[int, int, int]]]:
        """The spans of each text, in code points."""
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        each: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for begin, number, end in self.spans(_BREAK.join(texts)):
            owner = int(np.searchsorted(starts, begin, side="right")) - 1
            each[owner].append((begin - int(starts[owner]), number, end - int(starts[owner])))
        for text, spans in zip(texts, each):
            if spans and not text.isascii():
                later = np.concatenate([[0], np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 == 0x80)])
                spans = [(b - int(later[b]), number, e - int(later[e])) for b, number, e in spans]
            yield spans


def _scanned(column: pa.Array, scanner: Scanner) -> Iterator[list[tuple[int, int, int]]]:
    """Spans of each text of a column, scanned in parts of about ``BATCH_BYTES``."""
    part: list[bytes] = []
    total = 0
    for text in column.cast(pa.large_binary()):
        part.append(text.as_py() or b"")
        total += len(part[-1])
        if total >= BATCH_BYTES:
            yield from scanner.of_texts(part)
            part, total = [], 0
    yield from scanner.of_texts(part)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``id_col, spans array<struct<kind, start, end>>`` of every row, without a shuffle.

    Offsets count code points, the end is exclusive; spans are ordered by start, then by the order of ``rules``.
    Spans of one kind don't overlap, those of two kinds may.  Null and empty texts have none; very long
    texts are scanned whole.  Repeated rows come out as often as they came in, null ids stay, an empty
    table gives an empty result; further columns are not carried.
    """
    scanner = Scanner(tuple(rules))
    kinds = pa.array([r.kind for r in scanner.rules], pa.string())
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = list(_scanned(batch["text"], scanner))
            flat = np.array([span for spans in each for span in spans], np.int64).reshape(-1, 3)
            items = pa.StructArray.from_arrays(
                [kinds.take(pa.array(flat[:, 1])), pa.array(flat[:, 0]), pa.array(flat[:, 2])],
                fields=[pa.field(*f) for f in fields])
            edges = pa.array(np.cumsum([0, *map(len, each)]), pa.int32())
            yield pa.record_batch([batch["id"], pa.ListArray.from_arrays(edges, items)], names=["id", "spans"])

    kind = source.schema["id"].dataType.simpleString()
    found = source.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return found.select(F.col("id").alias(id_col), "spans")


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text",
                 count_col: str = "n_masked") -> DataFrame:
    """``docs`` with every secret replaced by its kind in brackets, and ``count_col``, their number.

    Of spans that overlap the one that begins first counts, then the first of ``rules``; the rest of the
    others goes too.  Null texts stay null; all columns and rows are kept.
    """
    scanner = Scanner(tuple(rules))
    count_col = fresh(docs, count_col)
    at = docs.columns.index(text_col)

    def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, place, name = [], 0, ""
        for begin, number, end in spans:
            if begin >= place:
                out.append(text[place:begin])
                out.append(f"[{scanner.rules[number].kind}]")
            place = max(place, end)
        return "".join([*out, text[place:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = list(_scanned(batch.column(at), scanner))
            texts = [masked(t, s) if s else t for t, s in zip(batch.column(at).to_pylist(), each)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.record_batch([*columns, pa.array(list(map(len, each)), pa.int32())],
                                  names=[*batch.schema.names, count_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(count_col, IntegerType())]))
