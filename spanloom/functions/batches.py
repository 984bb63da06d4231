"""Functions on whole Arrow batches: words, lines and offsets of many texts at once.

Array lambdas are interpreted, element by element; here each step is one numpy or Arrow call for all
texts of a batch.  Batches are worked on in stretches of about ``STRETCH`` elements, so that what a task holds
besides the batch stays small whatever the length of the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

STRETCH = 1 << 20

# The UTF-8 forms of white space beyond ASCII, see ``text.WHITESPACE_RANGES``.
_WIDE_SPACES = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_SPACE = np.zeros(256, bool)
_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


def by_stretch(run: Callable[..., pa.Array], sizes: np.ndarray, *columns: pa.Array) -> pa.Array:
    """``run`` over slices of ``columns`` that hold about ``STRETCH`` of ``sizes`` each, put together."""
    stretch = np.cumsum(sizes) // STRETCH
    edges = [0, *(np.flatnonzero(np.diff(stretch)) + 1).tolist(), len(sizes)]
    parts = [run(*(c.slice(a, b - a) for c in columns)) for a, b in zip(edges, edges[1:]) if b > a or not len(sizes)]
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)


def sizes_of(values: pa.Array) -> np.ndarray:
    """Bytes of strings, elements of lists; 0 for null."""
    lengths = pa.compute.binary_length(values) if pa.types.is_string(values.type) else pa.compute.list_value_length(values)
    return lengths.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def before(sizes: np.ndarray) -> np.ndarray:
    """What comes before each place, and at the end the total."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def lists(offsets: np.ndarray, values: pa.Array, null: pa.Array | None = None) -> pa.Array:
    """A list array; ``null`` marks the rows that are null."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=null if null is not None and null.true_count else None)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins; null counts as empty."""
    at = before(sizes_of(texts))
    data = texts.buffers()[2]
    if data is None or not at[-1]:
        return np.zeros(0, np.uint8), at
    first = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]
    if texts.null_count:  # what a null covers is not its text
        return np.frombuffer("".join(texts.fill_null("").to_pylist()).encode(), np.uint8), at
    return np.frombuffer(data, np.uint8)[first:first + at[-1]], at


class Words:
    """The words of some texts: places in their bytes and, counted through all texts, in their characters."""

    def __init__(self, texts: pa.Array):
        self.data, self.at = bytes_of(texts)
        data = self.data
        space = _SPACE[data]
        wide = np.flatnonzero(data >= 0xC2)
        for form in _WIDE_SPACES if len(wide) else ():
            found = wide[data[wide] == form[0]]
            found = found[found + len(form) <= len(data)]
            for i in range(1, len(form)):
                found = found[data[found + i] == form[i]]
            for i in range(len(form)):
                space[found + i] = True
        edge = np.zeros(len(data) + 1, bool)
        edge[self.at] = True
        full = ~space
        inner = full[1:] & full[:-1] & ~edge[1:-1]
        self.begin = np.flatnonzero(full & np.concatenate([[True], ~inner])[:len(data)])
        self.end = np.flatnonzero(full & np.concatenate([~inner, [True]])[:len(data)]) + 1
        lead = (data & 0xC0) != 0x80
        self.ascii = bool(lead.all())
        if self.ascii:
            self.chars_at, self.char_begin, self.char_end = self.at, self.begin, self.end
        else:
            chars = before(lead)
            self.chars_at, self.char_begin, self.char_end = chars[self.at], chars[self.begin], chars[self.end]
            self.byte_of_char = np.append(np.flatnonzero(lead), len(data))

    def bytes_at(self, chars: np.ndarray) -> np.ndarray:
        return chars if self.ascii else self.byte_of_char[chars]

    def cut(self, begin: np.ndarray, end: np.ndarray) -> pa.Array:
        """Strings from places in the bytes."""
        offsets = before(end - begin)
        values = self.data[np.repeat(begin - offsets[:-1], end - begin) + np.arange(offsets[-1])]
        return pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values))


def _places(texts: pa.Array) -> pa.Array:
    found = Words(texts)
    offsets = np.searchsorted(found.begin, found.at)
    first = np.repeat(found.chars_at[:-1], np.diff(offsets))
    null = texts.is_null()
    return pa.StructArray.from_arrays([lists(offsets, pa.array((c - first).astype(np.int32)), null)
                                       for c in (found.char_begin, found.char_end)], ["begins", "ends"])


def _word_places(text: pa.Array) -> pa.Array:
    return by_stretch(_places, sizes_of(text), text)


def word_places(text: Column) -> Column:
    """``struct<begins, ends>``: where the words of a text begin and end, in characters from 0; null arrays for null.

    Called nondeterministic, which keeps a filter on the places from being pushed below and evaluating it twice.
    """
    return F.arrow_udf(_word_places, "begins array<int>, ends array<int>").asNondeterministic()(text)


def _words(texts: pa.Array) -> pa.Array:
    found = Words(texts)
    return lists(np.searchsorted(found.begin, found.at), found.cut(found.begin, found.end), texts.is_null())


def words_of(text: Column) -> Column:
    """``text.words`` in batches; called nondeterministic for the reason that ``word_places`` is."""
    def run(texts: pa.Array) -> pa.Array:
        return by_stretch(_words, sizes_of(texts), texts)

    return F.arrow_udf(run, "array<string>").asNondeterministic()(text)


def _word_count(texts: pa.Array) -> pa.Array:
    found = Words(texts)
    return pa.array(np.diff(np.searchsorted(found.begin, found.at)).astype(np.int32))


def word_count(text: Column) -> Column:
    """The number of words, 0 for null; called nondeterministic like ``word_places``."""
    def run(texts: pa.Array) -> pa.Array:
        return by_stretch(_word_count, sizes_of(texts), texts)

    return F.arrow_udf(run, "int").asNondeterministic()(text)


def _lines(texts: pa.Array, begins: pa.Array, ends: pa.Array, labels: pa.Array, outside: str) -> pa.Array:
    """Gap, span, gap, span, …, tail of each text, and the words in each of them."""
    found = Words(texts)
    n_spans = sizes_of(begins)
    doc = np.repeat(np.arange(len(texts)), n_spans)
    top, low = found.chars_at[1:], found.chars_at[:-1]
    b, e = (np.clip(x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + low[doc], low[doc], top[doc]) for x in (begins, ends))
    label = labels.flatten().dictionary_encode()
    # A text with s spans has 2 s + 1 segments: its spans are those at odd places.
    first = before(2 * n_spans + 1)
    at = first[doc] + 2 * (np.arange(len(doc)) - before(n_spans)[doc])
    begin, end, code = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64), np.full(first[-1], -1)
    begin[first[:-1]] = low
    begin[at + 1], end[at + 1], code[at + 1] = b, e, label.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    begin[at + 2], end[at] = e, b
    end[first[1:] - 1] = top

    start = np.searchsorted(found.char_end, begin, "right")
    count = np.where(end > begin, np.maximum(np.searchsorted(found.char_begin, end, "left") - start, 0), 0)
    total = before(count)
    place = np.arange(total[-1]) - np.repeat(total[:-1], count)  # of the word in its segment
    word = np.repeat(start, count) + place
    tokens = found.cut(found.bytes_at(np.maximum(found.char_begin[word], np.repeat(begin, count))),
                       found.bytes_at(np.minimum(found.char_end[word], np.repeat(end, count))))
    kinds = pa.array([outside, *(f"{p}-{x}" for x in label.dictionary.to_pylist() for p in "BI")], pa.string())
    code = np.repeat(code, count)
    tags = pa.DictionaryArray.from_arrays(pa.array(np.where(code < 0, 0, 1 + 2 * code + (place > 0)), pa.int32()), kinds).dictionary_decode()
    offsets = total[first]
    return pa.StructArray.from_arrays([lists(offsets, tokens), lists(offsets, tags)], ["tokens", "tags"])


LINES = "tokens array<string>, tags array<string>"


def lines_of(text: Column, begins: Column, ends: Column, labels: Column, outside: str) -> Column:
    """``struct<tokens, tags>``: the words of a text, tagged by its sorted spans, given as three arrays of one length.

    A gap reaches from the end of the span before (not from the furthest end so far) to the begin of the span, so
    overlapping spans repeat text; words are cut where a segment ends.
    """
    def run(texts: pa.Array, b: pa.Array, e: pa.Array, l: pa.Array) -> pa.Array:
        return by_stretch(lambda *c: _lines(*c, outside), sizes_of(texts) + sizes_of(b), texts, b, e, l)

    return F.arrow_udf(run, LINES)(text, begins, ends, labels)


def codes_of(values: pa.Array) -> tuple[np.ndarray, list[str]]:
    """A number for each distinct value, -1 for null, and the values."""
    encoded = values.dictionary_encode()
    return encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False), encoded.dictionary.to_pylist()


def repeats(place: np.ndarray, token: np.ndarray, tag: np.ndarray, outside: int, look_back: int) -> np.ndarray:
    """Labelled lines that repeat the token of a labelled line at a watched slot; ``place`` counts inside the document."""
    labelled = tag != outside
    known = labelled & (tag >= 0) & (token >= 0)  # a missing tag or token is none that others repeat
    oldest = np.maximum(place - look_back, 0)
    repeated = np.zeros(len(place), bool)
    for distance in range(1, min(look_back, len(place) - 1) + 1):
        slot = place[distance:] - distance - oldest[distance:]
        watched = (slot >= 0) & ((slot % 4 == 0) | (slot % 4 == 3))
        repeated[distance:] |= watched & known[:-distance] & (token[distance:] == token[:-distance])
    return repeated & labelled


def _kept(lines: pa.Array, passes: tuple[int, ...], outside: str) -> pa.Array:
    tokens, tags = lines.flatten()
    sizes, null = sizes_of(tags), tags.is_null()
    flat = [tokens.flatten(), tags.flatten()]
    token = codes_of(flat[0])[0]
    tag, names = codes_of(flat[1])
    rest = np.arange(len(tag))  # the lines that are left
    for look_back in passes:
        place = (np.arange(len(rest)) - np.repeat(before(sizes)[:-1], sizes)).astype(np.int32)
        keep = ~repeats(place, token[rest], tag[rest], names.index(outside) if outside in names else -2, look_back)
        sizes = np.diff(before(keep)[before(sizes)])
        rest = rest[keep]
    return pa.StructArray.from_arrays([lists(before(sizes), c.take(pa.array(rest)), null) for c in flat], ["tokens", "tags"])


def without_repeats(lines: Column, passes: tuple[int, ...], outside: str) -> Column:
    """``struct<tokens, tags>`` after each look-back in turn; see ``lines.dedupe_docs`` for the rule."""
    def run(lines: pa.Array) -> pa.Array:
        return by_stretch(lambda x: _kept(x, passes, outside), sizes_of(lines.field(1)), lines)

    return F.arrow_udf(run, LINES)(lines)


def _wide_places(texts: pa.Array) -> pa.Array:
    data, at = bytes_of(texts)
    lead = (data & 0xC0) != 0x80
    wide = data >= 0xF0  # the first byte of a character beyond the basic plane
    units = before(lead + wide.astype(np.int64))
    places = np.flatnonzero(wide)
    offsets = np.searchsorted(places, at)
    return lists(offsets, pa.array(units[places] - np.repeat(units[at[:-1]], np.diff(offsets))), texts.is_null())


def wide_places(text: Column) -> Column:
    """``array<bigint>``: the places, in UTF-16 units, of the characters that take two."""
    def run(texts: pa.Array) -> pa.Array:
        return by_stretch(_wide_places, sizes_of(texts), texts)

    return F.arrow_udf(run, "array<bigint>")(text)


def lowered(values: Column, ordered: Column) -> Column:
    """An array of numbers, each less how many elements of an ordered array are smaller; a null array lowers nothing."""
    def run(values: pa.Array, ordered: pa.Array) -> pa.Array:
        at, over, parts = before(sizes_of(values)), before(sizes_of(ordered)), []
        flat = values.flatten()
        number, steps = (x.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) for x in (flat, ordered.flatten()))
        for row in range(len(values)):
            found = number[at[row]:at[row + 1]]
            parts.append(found - np.searchsorted(steps[over[row]:over[row + 1]], found) if over[row + 1] > over[row] else found)
        mask = flat.is_null().to_numpy(zero_copy_only=False)
        return lists(at, pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int64(), mask=mask), values.is_null())

    return F.arrow_udf(run, "array<bigint>")(values, ordered)


def _run_places(mode: str, code: np.ndarray, names: list[str], first: np.ndarray, outside: str,
                suffixes: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows begin a run (of merging or single rows), and which merge; ``first`` marks the first row of a sentence."""
    def of(values: list, null) -> np.ndarray:
        return np.array([*values, null])[code]  # -1, a missing type, is the last

    starts = first.copy()
    if mode == "suffix":
        keys = [x[-3:] for x in names]
        key = of([keys.index(x) for x in keys], -1)
        starts[1:] |= key[1:] != key[:-1]
        listed = of([x.endswith(suffixes) for x in names], False)
        whole = of([x in suffixes for x in keys], False)
        ends_so = of([x in {y[-3:] for y in suffixes} for x in keys], False)
        run = np.cumsum(starts) - 1
        seen = np.cumsum(listed)
        earlier = (seen - listed)[starts][run]  # listed types before the run
        return starts, whole | (ends_so & (seen > earlier))
    inside, out = of([x.startswith("I-") for x in names], False), of([x == outside for x in names], False)
    classes = {x[2:]: i for i, x in enumerate(names)}
    kind, null = of([classes[x[2:]] for x in names], -1), code < 0
    goes_on = (inside[1:] & ~out[:-1] & (kind[1:] == kind[:-1])) | (out[1:] & out[:-1])
    unknown = null[1:] | (null[:-1] & (inside[1:] | out[1:]))  # not told apart from the row before
    starts[1:] |= ~goes_on & ~unknown
    return starts, ~out[starts][np.cumsum(starts) - 1]


def _merged(types: pa.Array, surfaces: pa.Array, mode: str, outside: str, suffixes: tuple[str, ...]) -> pa.Array:
    sizes = sizes_of(types)
    at, null, size = before(sizes), types.is_null(), int(sizes.sum())
    if not size:
        none = lists(at, pa.array([], pa.string()), null)
        return pa.StructArray.from_arrays([none, none], ["types", "surfaces"])
    code, names = codes_of(types.flatten())
    words = surfaces.flatten()
    first = np.zeros(size, bool)
    first[at[:-1][sizes > 0]] = True
    starts, merges = _run_places(mode, code, names, first, outside, suffixes)
    head = merges & (starts | ~np.concatenate([[False], merges[:-1]]))
    if mode == "suffix":
        short, kept = [x[-3:] for x in names], np.array([*[not x.startswith("I-") for x in names], False])[code]
    else:
        short, kept = [x[2:] if x.startswith(("B-", "I-")) else x for x in names], np.ones(size, bool)
    alone = ~merges & kept
    type_at = np.where(head, len(names) + code, code)
    out_types = pa.array([*names, *short], pa.string()).take(pa.array(type_at, mask=~(head | alone) | (code < 0)))

    begin = np.flatnonzero(head)
    bounds = np.append(np.flatnonzero(starts), size)
    length = bounds[np.searchsorted(bounds, begin, "right")] - begin
    begin, length = begin[length > 1], length[length > 1]
    offsets = before(length)
    inner = np.repeat(begin - offsets[:-1], length) + np.arange(offsets[-1])
    there = words.is_valid().to_numpy(zero_copy_only=False)[inner]
    joined = pa.compute.binary_join(lists(before(there)[offsets], words.take(pa.array(inner[there], pa.int64()))), " ")
    word_at = np.arange(size)
    word_at[begin] = size + np.arange(len(begin))
    out_words = pa.concat_arrays([words, joined]).take(pa.array(word_at, mask=~(head | alone)))
    return pa.StructArray.from_arrays([lists(at, out_types, null), lists(at, out_words, null)], ["types", "surfaces"])


def _key_starts(keys: list[pa.Array]) -> np.ndarray:
    """Where rows begin whose keys differ from those of the row before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        code = codes_of(key)[0]
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def merged_rows(table: pa.Table, keys: list[str], mode: str, outside: str, suffixes: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The same on flat rows: ``keys``, ``pos``, ``entity_type`` and ``surface_string`` of whole sentences, in any order."""
    def starts() -> np.ndarray:
        return _key_starts([table[k].combine_chunks() for k in keys])

    first = starts()
    pos = table["pos"].to_numpy()
    inside = np.ones(len(pos), bool)
    inside[first] = False
    heads = table.select(keys).take(pa.array(first))
    if heads.group_by(keys).aggregate([]).num_rows < len(first) or not (pos[1:] > pos[:-1])[inside[1:]].all():
        table = table.sort_by([(c, "ascending") for c in (*keys, "pos", "entity_type", "surface_string")]).combine_chunks()
        first = starts()
    at = np.append(first, table.num_rows)
    types, surfaces = (lists(at, table[c].combine_chunks()) for c in ("entity_type", "surface_string"))
    merged = by_stretch(lambda *c: _merged(*c, mode, outside, suffixes), np.diff(at), types, surfaces)
    out = [*(table[c].combine_chunks() for c in (*keys, "pos")), *(x.flatten() for x in merged.flatten())]
    whole = pa.record_batch(out, names=[*keys, "pos", "entity_type", "surface_string"])
    for begin in range(0, whole.num_rows, STRETCH >> 3):
        yield whole.slice(begin, STRETCH >> 3)


def merged_runs(types: Column, surfaces: Column, mode: str, outside: str, suffixes: tuple[str, ...]) -> Column:
    """``struct<types, surfaces>`` of entities, aligned with the input; see ``entity_eval.merge_runs`` for the rules."""
    def run(types: pa.Array, surfaces: pa.Array) -> pa.Array:
        return by_stretch(lambda *c: _merged(*c, mode, outside, suffixes), sizes_of(types), types, surfaces)

    return F.arrow_udf(run, "types array<string>, surfaces array<string>")(types, surfaces)
