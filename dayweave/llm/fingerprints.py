"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

import hashlib
import sys
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from dayweave.llm.hashing import mixed
from dayweave.llm.text import running_totals
from dayweave.llm.tokens import utf8
from dayweave.sources import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Values of a fingerprint, and the levels whose names it is made of: phrases of the first have
# about 2.5 bytes, those of each further one as many phrases of the one below.
SLOTS, LEVELS = 128, (2, 3)
# Bytes parsed in one go; a longer text is parsed alone.
BLOCK_BYTES = 1 << 20
_RUN = np.uint64(0xA0761D6478BD642F)
_PLACE = np.random.default_rng(11).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTERS = np.random.default_rng(13).integers(1 << 62, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _coin_table(n: int) -> np.ndarray:
    """For symbols x and y below n: twice the lowest bit in which they differ, plus x's bit there.
    Neighbours that differ get values that differ again."""
    x, y = np.arange(n)[:, None], np.arange(n)[None, :]
    differ = x ^ y
    bit = np.bitwise_count((differ & -differ) - 1).astype(np.int64)
    return np.where(differ == 0, 0, 2 * bit + ((x >> bit) & 1)).astype(np.uint8)


# 128 symbols become 14, those 8, those 6; bytes become 16 first.
_TOSS = {n: _coin_table(n) for n in (256, 128, 16, 8)}


def _before(x: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Each symbol's left neighbour; that of a text's first symbol differs from it in the lowest bit."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[heads] = x[heads] ^ x.dtype.type(1)
    return out


def phrase_starts(names: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where phrases begin in texts without equal neighbours, which begin at `heads`.

    Deterministic coin tossing: each symbol is replaced by where and how it differs from its left
    neighbour, again and again, until six values are left. Neighbours still differ, so there is a
    local maximum at least every eleven symbols; phrases begin there. What decides about a place
    are its few left neighbours and the next one, whatever stands elsewhere.
    """
    before = _before(names, heads)
    if names.dtype == np.uint8:
        x, rounds = _TOSS[256][names, before], (16, 8)
    else:
        differ = names ^ before
        bit = np.bitwise_count((differ & -differ) - np.uint64(1))
        x, rounds = 2 * bit + ((names >> bit.astype(np.uint64)) & np.uint64(1)).astype(np.uint8), (128, 16, 8)
    for n in rounds:
        x = _TOSS[n][x, _before(x, heads)]
    start = np.zeros(len(x), dtype=bool)
    start[1:-1] = (x[1:-1] > x[:-2]) & (x[1:-1] > x[2:])
    # The last symbol of a text has no right neighbour.
    start[heads[1:] - 1] = False
    start[heads] = True
    return np.flatnonzero(start)


def _runs(names: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where runs of equal symbols begin."""
    new = np.ones(len(names), dtype=bool)
    new[1:] = names[1:] != names[:-1]
    new[heads] = True
    return np.flatnonzero(new)


def levels(data: np.ndarray, heads: np.ndarray, least: int = 0):
    """The names of the phrases of some texts, none of them empty, level by level, and where in
    the data each begins; until each text is one name, and `least` levels at least.

    On every level a run of equal symbols becomes one, named by its symbol and length, and the
    phrases of what is left become the symbols of the next level. Names are hashes of what they
    stand for, so equal phrases have equal names in all documents and tasks.
    """
    names, begin, level = data, np.arange(len(data)), 0
    while len(heads) and (len(names) > len(heads) or level < least):
        at = _runs(names, heads)
        length = np.diff(np.append(at, len(names))).astype(np.uint64)
        heads, begin, names = np.searchsorted(at, heads), begin[at], names[at]
        whole = names.copy() if level else _LETTERS[names]
        long = length > 1
        whole[long] = mixed(whole[long] + _RUN * length[long])
        start = phrase_starts(names, heads)
        place = np.arange(len(names)) - np.repeat(start, np.diff(np.append(start, len(names))))
        names = mixed(np.add.reduceat(mixed(whole * _PLACE[place % len(_PLACE)]), start))
        heads, begin, level = np.searchsorted(start, heads), begin[start], level + 1
        yield names, begin, heads


def fingerprints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The name of each whole text (0 for an empty one), and the values of its fingerprint.

    The names on two levels are dealt to slots by their hash; the smallest in a slot is its value,
    0 where there is none. Texts that share phrases agree in about as many slots as the share
    of phrases they have in common of all that they have.
    """
    roots, values = np.zeros(len(texts), np.uint64), np.full((len(texts), SLOTS), 1 << 16, np.uint32)
    full = np.flatnonzero([len(t) for t in texts])
    if len(full):
        size = np.array([len(texts[i]) for i in full])
        data, heads = np.frombuffer(b"".join(texts[i] for i in full), np.uint8), np.cumsum(size) - size
        whole = np.zeros(len(full), dtype=bool)
        for level, (names, _, heads) in enumerate(levels(data, heads, LEVELS[-1]), 1):
            count = np.diff(np.append(heads, len(names)))
            done = (count == 1) & ~whole
            roots[full[done]] = names[heads[done]]
            whole |= done
            if level in LEVELS:
                h = mixed(names ^ _RUN)
                slot = (h >> np.uint64(32)).astype(np.int64) % SLOTS
                np.minimum.at(values, (np.repeat(full, count), slot), (h & np.uint64(0xFFFF)).astype(np.uint32))
    return roots, np.where(values == 1 << 16, 0, np.maximum(values, 1)).astype(np.uint16)


def spelled(root: int, values: np.ndarray) -> str:
    """A fingerprint as text: the name of the whole, then the slots, in hexadecimal digits."""
    return f"{int(root):016x}{values.astype('>u2').tobytes().hex()}"


def likeness(a: tuple, b: tuple) -> float:
    """Of two fingerprints (name, values): the share of slots that agree of those that either uses."""
    if a[0] == b[0]:
        return 1.0
    used = (a[1] > 0) | (b[1] > 0)
    return float(((a[1] == b[1]) & used).sum() / max(int(used.sum()), 1))


def compare(a: str, b: str) -> float:
    """Likeness of two fingerprints as texts."""
    return likeness(*((f[:16], np.frombuffer(bytes.fromhex(f[16:]), ">u2")) for f in (a, b)))


def _blocks(texts: list[bytes]):
    """Ends of runs of texts of about BLOCK_BYTES."""
    size = 0
    for i, text in enumerate(texts, 1):
        size += len(text)
        if size >= BLOCK_BYTES or i == len(texts):
            yield i
            size = 0


def fingerprint(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of every document with the `fingerprint` of its whole text, without a shuffle.

    A missing text is an empty one. Equal texts have equal fingerprints; `compare` tells how much
    two of them have in common.
    """

    def write(batches):
        for batch in batches:
            texts, start = list(utf8(batch.column("__text"))), 0
            for end in _blocks(texts):
                found = [spelled(*f) for f in zip(*fingerprints(texts[start:end]))]
                own = batch.select(columns).slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(found, pa.string())], names=[*columns, "fingerprint"])
                start = end

    own = docs.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return docs.select(*columns, docs["text"].alias("__text")).mapInArrow(write, f"{schema}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _key(doc_id: int | None, h: int) -> tuple:
    """Larger ids first, missing ones last."""
    return (doc_id is None, 0 if doc_id is None else ~doc_id, h)


def _dealer(starts: list[tuple]):
    """Give each row its range; the first row of a range goes to the range before it too."""

    def deal(batches):
        for batch in batches:
            rows, ranges, ahead = [], [], []
            for i, key in enumerate(map(_key, *(batch.column(c).to_pylist() for c in ("doc_id", "h")))):
                place = bisect_right(starts, key) - 1
                rows.append(i)
                ranges.append(place)
                ahead.append(False)
                while place >= 0 and starts[place] == key:
                    rows.append(i)
                    ranges.append(place - 1 if place else len(starts) - 1)
                    ahead.append(True)
                    place -= 1
            out = pa.Table.from_batches([batch]).take(pa.array(rows, pa.int64()))
            for name, values in (("range", pa.array(ranges, pa.int32())), ("ahead", pa.array(ahead, pa.bool_()))):
                out = out.append_column(name, values)
            yield from out.to_batches()

    return deal


def _decoded(raw: bytes) -> str:
    return raw.decode(errors="surrogateescape")


def _comparer(batches):
    """Rows of ranges in order, each range followed by the first row of the next one."""
    held: list[tuple] = []

    def finished(last: bool):
        # The last one held waits for its follower, unless the range is over.
        nonlocal held
        texts = [t for *_, t in held]
        own = list(zip(*fingerprints(texts)))
        words = [_decoded(t) for t in texts]
        changed = [edited(a, b).encode(errors="surrogateescape") for a, b in zip(words, words[1:])]
        others = list(zip(*fingerprints(changed)))
        n = len(changed)
        columns = [
            pa.array([i for i, _ in held[:n]], pa.int64()),
            pa.array([len(w) for w in words[:n]], pa.int64()),
            pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
            pa.array([spelled(*f) for f in own[:n]], pa.string()),
            pa.array([spelled(*f) for f in others], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, others)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
        ]
        held = [] if last else held[-1:]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _OUT.split(", ")])

    size, over = 0, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "range", "ahead")]
        for doc_id, number, ahead, text in zip(*columns, utf8(batch.column("text"))):
            # Rows equal to the first one of the next range may come along; one is enough.
            if number == over:
                continue
            held.append((doc_id, text))
            size += len(text)
            if ahead or size >= BLOCK_BYTES:
                yield finished(last=ahead)
                size = 0
                over = number if ahead else None


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document in descending order of doc_id, after the last the first.
    Gives doc_id, n_chars, edited_sha256 (of UTF-8), fingerprint, edited_fingerprint, near_edited
    (fingerprint against that of the edited text) and near_next (against that of the next document).

    Places in the order come from ids, hashes and sizes alone. They cut the documents into ranges
    of about equal bytes, one for each shuffle partition; texts are shuffled once, to their
    ranges, and the first document of a range is sent to the range before it too.

    A missing text is an empty one, whose likeness is 1 to an empty text and 0 to any other. Rows with equal ids are
    ordered by a hash of their text, rows without an id come last; equal rows follow each other.
    A text of any length is parsed whole. One document is its own next one. An empty
    table gives no rows. Other columns are not used.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), "text")
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    narrow = rows.select("doc_id", "h", (F.octet_length("text") + 1).cast("long").alias("size"))
    placed = materialize(running_totals(narrow, order, {"up_to": F.col("size")}, "sizes"), "places")
    total = placed.agg(F.max("up_to")).first()[0] or 1
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor((F.col("up_to") - F.col("size")) * F.lit(parts) / F.lit(total))
    firsts = placed.groupBy(place.alias("range")).agg(F.min_by(F.struct("doc_id", "h"), "up_to").alias("first"))
    # As many rows as shuffle partitions at most.
    starts = sorted(_key(r["first"]["doc_id"], r["first"]["h"]) for r in firsts.collect())
    dealt = rows.mapInArrow(_dealer(starts), "doc_id long, h long, text string, range int, ahead boolean")
    laid = dealt.repartitionById(parts, F.col("range")).sortWithinPartitions("range", "ahead", *order)
    return laid.select("doc_id", "range", "ahead", "text").mapInArrow(_comparer, _OUT)
