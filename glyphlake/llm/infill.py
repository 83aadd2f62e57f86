"""Fill-in-middle transformation (operator 11): a parallel automaton scan.

A token is a run of letters or a single other character. An automaton over UTF-8 bytes counts the tokens that start
and notices the markers. A chunk of bytes is scanned from every state at once, without knowing the state in
which it is entered: what it yields is a function from states to states, and counts for each start state. Such
functions compose associatively, which resolves the state that each chunk is entered in, and sums of the counts
then tell which chunk holds the token at which a text is cut. Only that chunk is scanned again.

Inside a task the chunks are rows of LANE bytes of all texts of a batch, scanned side by side. Texts of more than
GIANT bytes are dealt out over tasks as chunks of that size; a document's functions, not its text, meet in one row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables

#: Markers before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Bytes of a text beyond which it is dealt out in chunks, which are of this size.
GIANT = 1 << 16

#: Bytes that are scanned side by side with the same number of others.
LANE = 128

#: Bytes of texts that are scanned at once.
SLICE_BYTES = 1 << 20

# States: outside letters; inside letters; after "<"; after "<" and a marker's letter.
_OUT, _IN, _OPEN, _NAMED = range(4)
# Classes of bytes: others; letters; letters of markers; "<"; ">"; bytes inside a code point; none (after a lane's end).
_OTHER, _LETTER, _NAME, _LESS, _MORE, _INSIDE, _NONE = range(7)

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = _NAME
_CLASS[ord("<")], _CLASS[ord(">")] = _LESS, _MORE
_CLASS[0x80:0xC0] = _INSIDE

_NEXT = np.array([[_OUT] * 4, [_IN] * 4, [_IN, _IN, _NAMED, _IN], [_OPEN] * 4, [_OUT] * 4, [_OUT] * 4, [_OUT, _IN, _OPEN, _NAMED]], np.int64)
_STARTS = np.array([[1] * 4, [1, 0, 1, 0], [1, 0, 1, 0], [1] * 4, [1] * 4, [0] * 4, [0] * 4], np.int64)
_MARKS = np.zeros((7, 4), np.int64)
_MARKS[_MORE, _NAMED] = 1
_CHARS = np.array([1, 1, 1, 1, 1, 0, 0], np.int64)
#: Counts of a step in one number: a lane has less than 2^20 tokens.
_COUNTS = (_STARTS + (_MARKS << 20)).ravel()
_STEP = _NEXT.ravel()


@dataclass
class Scan:
    """What chunks yield, a row for each: for each start state the last state, tokens and markers; and code points."""

    last: np.ndarray  # n x 4
    tokens: np.ndarray  # n x 4
    marks: np.ndarray  # n x 4
    chars: np.ndarray  # n


def scan_lanes(classes: np.ndarray) -> Scan:
    """Scans the columns of a matrix of classes from every state."""
    n = classes.shape[1]
    state = np.tile(np.arange(4), (n, 1))
    counts = np.zeros((n, 4), np.int64)
    for row in classes:
        at = state + 4 * row[:, None].astype(np.int64)
        counts += _COUNTS[at]
        state = _STEP[at]
    return Scan(state, counts & 0xFFFFF, counts >> 20, np.count_nonzero(classes < _INSIDE, axis=0))


def compose(last: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each chunk the function of all chunks of its run up to it.

    last: functions of chunks; first: for each chunk, the first one of its run. Functions are composed over
    spans that double until they reach the run's first chunk.
    """
    place, f, step = np.arange(len(last)) - first, last.copy(), 1
    while (place >= step).any():
        i = np.flatnonzero(place >= step)
        f[i] = np.take_along_axis(f[i], f[i - step], 1)
        step *= 2
    return f


def entry_states(last: np.ndarray, first: np.ndarray, state: int = _OUT) -> np.ndarray:
    """The state in which each chunk is entered, if its run is entered in `state`."""
    entry = np.full(len(last), state, np.int64)
    later = np.flatnonzero(np.arange(len(last)) > first)
    entry[later] = compose(last, first)[later - 1, state]
    return entry


def find_token(classes: np.ndarray, state: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Code points before token number `want` that starts in each column, entered in `state`."""
    state, seen, chars = state.astype(np.int64), np.zeros(len(want), np.int64), np.zeros(len(want), np.int64)
    found = np.zeros(len(want), np.int64)
    for row in classes:
        at = state + 4 * row.astype(np.int64)
        starts = _STARTS.ravel()[at]
        hit = (starts == 1) & (seen == want)
        found[hit] = chars[hit]
        seen += starts
        chars += _CHARS[row]
        state = _STEP[at]
    return found


def _lanes(data: np.ndarray, offsets: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of texts cut into lanes, a column each, and the first lane of each text (one more at the end)."""
    size = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(-(-size // lane))])
    doc = np.repeat(np.arange(len(size)), np.diff(first))
    start = offsets[doc] + (np.arange(first[-1]) - first[doc]) * lane
    at = start + np.arange(lane)[:, None]
    classes = np.full(at.shape, _NONE, np.uint8)
    inside = at < offsets[doc + 1]
    classes[inside] = _CLASS[data[at[inside]]]
    return classes, first


@dataclass
class Cuts:
    """For each text: its tokens, its markers, and the code points before both cuts."""

    n: np.ndarray
    marks: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def cut_points(data: np.ndarray, offsets: np.ndarray, one: np.ndarray, two: np.ndarray, lane: int = LANE) -> Cuts:
    """Cuts of whole texts: after the smaller and the larger of one % (n + 1) and two % (n + 1) tokens."""
    classes, first = _lanes(data, offsets, lane)
    scan = scan_lanes(classes)
    lanes = np.arange(first[-1])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    entry = entry_states(scan.last, first[doc])
    tokens, chars = _sums(scan.tokens[lanes, entry]), _sums(scan.chars)
    n = tokens[first[1:]] - tokens[first[:-1]]
    marks = _sums(scan.marks[lanes, entry])
    k = np.sort(np.stack([one % (n + 1), two % (n + 1)]), axis=0)
    places = []
    for want in k:
        place = chars[first[1:]] - chars[first[:-1]]  # the text's end, unless a token starts there
        some = np.flatnonzero(want < n)
        target = tokens[first[:-1]][some] + want[some]
        at = np.searchsorted(tokens, target, side="right") - 1
        inside = find_token(classes[:, at], entry[at], target - tokens[at])
        place[some] = chars[at] - chars[first[:-1]][some] + inside
        places.append(place)
    return Cuts(n, marks[first[1:]] - marks[first[:-1]], *places)


_CUT = "n long, marks long, low long, high long"


def _cut_texts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    """`cut_points` of a column, a slice of about SLICE_BYTES at a time."""
    text = text.cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    one, two = (x.to_numpy(zero_copy_only=False) for x in (one, two))
    parts, lo = [], 0
    while lo < len(text):
        hi = min(len(text), max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1))
        parts.append(cut_points(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], one[lo:hi], two[lo:hi]))
        lo = hi
    return pa.StructArray.from_arrays([pa.array(np.concatenate([getattr(p, f) for p in parts] or [[]]), pa.int64()) for f in ("n", "marks", "low", "high")], ["n", "marks", "low", "high"])


def _one_text(data: bytes) -> tuple[np.ndarray, Scan, np.ndarray]:
    """Lanes of one text, their scan, and their run's first lane."""
    classes, _ = _lanes(np.frombuffer(data, np.uint8), np.array([0, len(data)]), LANE)
    return classes, scan_lanes(classes), np.zeros(classes.shape[1], np.int64)


def _scan_chunks(data: pa.Array) -> pa.Array:
    """The function and the counts of each chunk of a giant text: last states, tokens and markers from each state, code points."""
    rows = []
    for x in data:
        _, scan, first = _one_text(x.as_py())
        lanes, entries = np.arange(len(first)), [entry_states(scan.last, first, s) for s in range(4)]
        rows.append(
            {
                "last": compose(scan.last, first)[-1].tolist(),
                "tokens": [int(scan.tokens[lanes, e].sum()) for e in entries],
                "marks": [int(scan.marks[lanes, e].sum()) for e in entries],
                "chars": int(scan.chars.sum()),
            }
        )
    return pa.array(rows, _FUNCTION_ARROW)


_FUNCTION = "last array<long>, tokens array<long>, marks array<long>, chars long"
_FUNCTION_ARROW = pa.struct([("last", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("chars", pa.int64())])
_PLACE = "chunk int, state int, want long, before long"
_PLACE_ARROW = pa.struct([("chunk", pa.int32()), ("state", pa.int32()), ("want", pa.int64()), ("before", pa.int64())])


def _resolve(functions: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    """Composes the functions of each giant's chunks, in order, and names the chunks that hold its cuts."""
    rows = []
    for chunks, x, y in zip(functions, one.to_pylist(), two.to_pylist(), strict=True):
        parts = chunks.values.field("f")
        grid = lambda name: parts.field(name).flatten().to_numpy().reshape(-1, 4)  # noqa: B023, E731
        last, ways = grid("last"), np.arange(len(parts))
        entry = entry_states(last, np.zeros(len(last), np.int64))
        tokens, chars = _sums(grid("tokens")[ways, entry]), _sums(parts.field("chars").to_numpy())
        n, found = int(tokens[-1]), []
        for want in sorted((x % (n + 1), y % (n + 1))):
            if want == n:  # the text's end
                found.append({"chunk": None, "state": 0, "want": 0, "before": int(chars[-1])})
            else:
                at = int(np.searchsorted(tokens, want, side="right")) - 1
                found.append({"chunk": at, "state": int(entry[at]), "want": want - int(tokens[at]), "before": int(chars[at])})
        rows.append({"n": n, "marks": int(grid("marks")[ways, entry].sum()), "low": found[0], "high": found[1]})
    return pa.array(rows, pa.struct([("n", pa.int64()), ("marks", pa.int64()), ("low", _PLACE_ARROW), ("high", _PLACE_ARROW)]))


def _select(data: pa.Array, state: pa.Array, want: pa.Array) -> pa.Array:
    """Code points before the wanted token of each chunk, which is scanned from its entry state; null without a chunk."""
    places = []
    for x, s, k in zip(data.to_pylist(), state.to_pylist(), want.to_pylist(), strict=True):
        if x is None:
            places.append(None)
            continue
        classes, scan, first = _one_text(x)
        entry = entry_states(scan.last, first, s)
        tokens, chars = _sums(scan.tokens[np.arange(len(entry)), entry]), _sums(scan.chars)
        at = int(np.searchsorted(tokens, k, side="right")) - 1
        places.append(int(chars[at] + find_token(classes[:, [at]], entry[[at]], np.array([k - tokens[at]]))[0]))
    return pa.array(places, pa.int64())


def _arrow(function, kind: str):
    return F.arrow_udf(function, kind)


def _part(k: int) -> Column:
    """The k-th group of eight hex digits of the document's hash."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def _giants(docs: DataFrame, giant: int) -> DataFrame:
    """doc_id, text and cut of the rows of docs, whose texts are dealt out in chunks."""
    spark = docs.sparkSession
    whole = tables.written(spark, docs.withColumn("key", F.monotonically_increasing_id()))
    data = F.col("text").cast("binary")
    piece = lambda i: F.substring(data, i * giant + 1, F.lit(giant))
    chunks = whole.select("key", "text", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / giant).cast("int"))).alias("chunk"))
    dealt = chunks.select("key", "chunk", piece(F.col("chunk")).alias("data")).repartition("key", "chunk")
    functions = dealt.select("key", F.struct("chunk", _arrow(_scan_chunks, f"struct<{_FUNCTION}>")("data").alias("f")).alias("function"))
    met = functions.groupBy("key").agg(F.sort_array(F.collect_list("function")).alias("functions"))
    solved = whole.join(met, "key").withColumn("at", _arrow(_resolve, f"struct<n:long,marks:long,low:struct<{_PLACE}>,high:struct<{_PLACE}>>")("functions", "one", "two"))
    place = lambda c: F.col(f"at.{c}.before") + F.coalesce(_arrow(_select, "long")(piece(F.col(f"at.{c}.chunk")), F.col(f"at.{c}.state"), F.col(f"at.{c}.want")), F.lit(0))
    return solved.select("doc_id", "text", F.struct("at.n", "at.marks", place("low").alias("low"), place("high").alias("high")).alias("cut"))


def transform(docs: DataFrame, giant: int = GIANT) -> DataFrame:
    """Rearranges each row of docs (doc_id, text) for filling in the middle.

    Returns doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain)
    and output. Rows are taken alone, so repeated rows give equal rows; a null text is empty, and an empty text is
    plain; a null doc_id is hashed as no digits; an empty table gives no rows; further columns don't matter.
    """
    tables.bounded_bytes(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", _part(1).alias("one"), _part(2).alias("two"))
    small = rows.where(F.octet_length("text") <= giant).select("doc_id", "text", _arrow(_cut_texts, f"struct<{_CUT}>")("text", "one", "two").alias("cut"))
    cut = small.unionByName(_giants(rows.where(F.octet_length("text") > giant), giant))
    low, high, text = F.col("cut.low"), F.col("cut.high"), F.col("text")
    plain = (text == "") | (F.col("cut.marks") > 0) | (_part(3) % 100 >= 90)
    form = F.when(plain, "plain").when(_part(4) % 100 < 20, "spm").otherwise("psm")
    cast = lambda c: c.cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), cast(low)), F.substring(text, cast(low + 1), cast(high - low)), F.substring(text, cast(high + 1), F.lit(2**31 - 1))
    formed = cut.withColumn("form", form)
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(text)
    )
    shown = lambda c, name: F.when(F.col("form") != "plain", c).alias(name)
    return formed.select("doc_id", F.col("cut.n").alias("n"), "form", shown(low, "prefix_chars"), shown(high - low, "middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of: parts between its markers, in their first order."""

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        one, two, after = F.locate(first, output), F.locate(second, output), len(first)
        end = F.lit(2**31 - 1)
        return F.substring(output, F.lit(len(PREFIX) + 1), one - len(PREFIX) - 1), F.substring(output, one + after, two - one - after), F.substring(output, two + len(second), end)

    prefix, suffix, middle = between(SUFFIX, MIDDLE)
    suffix_2, prefix_2, middle_2 = between(PREFIX, MIDDLE)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_2, middle_2, suffix_2)).otherwise(output)


def digest(docs: DataFrame, giant: int = GIANT) -> DataFrame:
    """`transform` with hashes of the output, and of the text that `restore` makes of it, instead of the output."""
    restored = restore(F.col("output"), F.col("form"))
    return transform(docs, giant).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256")
    )
