"""Removing passages that repeat across documents, by a hash-compared sort of suffixes."""

from __future__ import annotations

import hashlib
import math
import sys
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from dayweave.llm.hashing import Hashed, Powers, mixed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Length of a repeated passage, and of the grams by which equal passages find each other.
SPAN, GRAM = 50, 24
REACH = SPAN - GRAM
# Texts are handled in units of about so many bytes, at most so many units, and in blocks.
UNIT_BYTES, MOST_UNITS, BLOCK_BYTES = 4 << 20, 300_000, 1 << 20
BUCKET_BYTES, FEWEST_BUCKETS = 64 << 20, 64
_WIDTH = SPAN + REACH
# A gram is hot if the units that have it in at least FEW surroundings have more than HOT in all.
# Its windows go to buckets one by one, each by its own hash and marked by the offset WHOLE.
FEW, HOT = 4, 1 << 14
WHOLE = 255


class Anchors:
    """Where the windows of SPAN bytes of some texts are anchored.

    Every window is anchored at the smallest hash among its grams, the first one on ties, so
    equal windows are anchored at the same place inside. Windows with the same anchor follow
    each other: one entry has the anchor's place, its hash, the first and the last window.
    """

    def __init__(self):
        self.powers = Powers()

    def of(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Entries of all texts: `text`, and the places `anchor`, `first`, `last` inside it."""
        found, held, size = [], [], 0
        for i, text in enumerate(texts):
            # A very long text goes in parts that overlap so that each window is in one.
            for at in range(0, max(len(text) - SPAN + 1, 0), BLOCK_BYTES):
                part = text[at : at + BLOCK_BYTES + SPAN - 1]
                held.append((i, at, part))
                size += len(part)
                if size >= BLOCK_BYTES:
                    found.append(self._block(held))
                    held, size = [], 0
        if held:
            found.append(self._block(held))
        names = ("text", "anchor", "first", "last", "key")
        empty = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
        columns = [np.concatenate(c) for c in zip(*found)] if found else empty
        return dict(zip(names, columns))

    def _block(self, parts):
        data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        sizes = np.array([len(p) for _, _, p in parts])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        n = len(data) - GRAM + 1
        at = np.arange(n)
        low = mixed(Hashed(data, self.powers).of(slice(0, n), slice(GRAM, GRAM + n)))
        key, place = low, at.astype(np.int32)
        width = 1
        while width < REACH + 1:
            step = min(width, REACH + 1 - width)
            right = low[step:]
            left = low[: len(right)]
            place = np.where(right < left, place[step : step + len(right)], place[: len(right)])
            low = np.minimum(left, right)
            width += step
        windows = len(data) - SPAN + 1
        valid = np.ones(windows, dtype=bool)
        for end in ends[:-1]:
            valid[max(end - SPAN + 1, 0) : end] = False
        fresh = np.empty(windows, dtype=bool)
        fresh[0] = True
        fresh[1:] = (place[1:windows] != place[: windows - 1]) | ~valid[:-1]
        first = np.flatnonzero(fresh & valid)
        # A run of windows ends before the next one starts or its text ends.
        stop = np.append(np.flatnonzero(fresh | ~valid), windows)
        last = stop[np.searchsorted(stop, first, side="right")] - 1
        anchor = place[first].astype(np.int64)
        part = np.searchsorted(ends, first, side="right")
        text = np.array([i for i, _, _ in parts])[part]
        shift = np.array([a for _, a, _ in parts])[part] - begins[part]
        # The smallest of many hashes is small; mixed again, they spread over all buckets.
        return text, anchor + shift, first + shift, last + shift, mixed(key[anchor])


def _texts(table: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and texts of a unit in the order of ids and texts, so that it is the same each time."""
    ids = table.column("doc_id").to_pylist()
    texts = [t or b"" for t in table.column("text").cast(pa.large_binary()).to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _known_texts(table: pa.Table) -> tuple[list, list[bytes], dict[str, np.ndarray]]:
    """The texts of a unit that can have or be a repetition: those with an id."""
    ids, texts = _texts(table)
    entries = Anchors().of([b"" if i is None else t for i, t in zip(ids, texts)])
    return ids, texts, entries


def _short(key: np.ndarray, bits: int) -> np.ndarray:
    return np.unique(key >> np.uint64(64 - bits))


_SENT = "bucket long, unit long, start long, keys binary, often binary, counts binary"


def _often(ids, texts, entries, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shortened hashes of the anchors that stand in at least FEW different surroundings in a
    unit, and in how many."""
    short = entries["key"] >> np.uint64(64 - bits)
    _, which, count = np.unique(short, return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[which] >= FEW)
    if not len(several):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    contexts = Contexts(ids, texts, entries, several, np.zeros(len(several), dtype=bool))
    keys, count = np.unique(contexts.key >> np.uint64(64 - bits), return_counts=True)
    often = count >= FEW
    return keys[often], count[often].astype(np.uint32)


def _sender(bits: int, buckets: int):
    """Tell each bucket which anchors a unit has: differences of sorted shortened hashes. Those
    that the unit has often go along with their counts."""

    def send(table: pa.Table) -> pa.Table:
        unit = table.column("unit")[0].as_py()
        ids, texts, entries = _known_texts(table)
        keys = _short(entries["key"], bits)
        cuts = np.searchsorted(_bucket(keys << np.uint64(64 - bits), buckets), np.arange(buckets + 1))
        often, count = _often(ids, texts, entries, bits)
        parts = np.searchsorted(_bucket(often << np.uint64(64 - bits), buckets), np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(cuts)):
            own = keys[cuts[b] : cuts[b + 1]]
            gaps = np.diff(own, prepend=np.uint64(0))
            narrow = len(gaps) < 2 or gaps[1:].max() < 1 << 32
            s = slice(parts[b], parts[b + 1])
            rows.append(
                (int(b), unit, int(own[0]) if narrow else None, gaps[1:].astype(np.uint32).tobytes() if narrow else own.tobytes(),
                 often[s].tobytes(), count[s].tobytes())
            )
        columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 3)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _SENT.split(", ")])

    return send


def _unpacked(start, packed: bytes) -> np.ndarray:
    if start is None:
        return np.frombuffer(packed, np.uint64)
    gaps = np.frombuffer(packed, np.uint32).astype(np.uint64)
    return np.uint64(start) + np.concatenate([np.zeros(1, np.uint64), np.cumsum(gaps, dtype=np.uint64)])


def _within(own: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Which of `own` are in a sorted array."""
    if not len(sorted_):
        return np.zeros(len(own), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_, own), len(sorted_) - 1)
    return sorted_[at] == own


def _meet(table: pa.Table) -> pa.Table:
    """For each unit one bit per anchor: whether another unit has it too; and its hot anchors."""
    units = table.column("unit").to_pylist()
    order = sorted(range(len(units)), key=units.__getitem__)
    starts, packed = table.column("start").to_pylist(), table.column("keys").to_pylist()
    lists = [_unpacked(starts[i], packed[i]) for i in order]
    merged = np.sort(np.concatenate(lists))
    twice = np.unique(merged[1:][merged[1:] == merged[:-1]])
    bits = [np.packbits(_within(own, twice)).tobytes() for own in lists]
    often, which = np.unique(np.frombuffer(b"".join(table.column("often").to_pylist()), np.uint64), return_inverse=True)
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32)
    hot = often[np.bincount(which, weights=counts, minlength=len(often)) > HOT]
    hots = [hot[_within(hot, own)].tobytes() for own in lists]
    bucket = table.column("bucket")[0].as_py()
    columns = [[units[i] for i in order], [bucket] * len(order), bits, hots]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["unit", "bucket", "bits", "hot"])


def _shared(entries, replies: pa.Table, bits: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries whose anchor some other text has too, and which of them are hot."""
    keys = _short(entries["key"], bits)
    cuts = np.searchsorted(_bucket(keys << np.uint64(64 - bits), buckets), np.arange(buckets + 1))
    found = np.zeros(len(keys), dtype=bool)
    for b, packed in zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist()):
        n = cuts[b + 1] - cuts[b]
        found[cuts[b] : cuts[b + 1]] = np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
    at = np.searchsorted(keys, entries["key"] >> np.uint64(64 - bits))
    # Or two texts of this unit have it.
    lowest, highest = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), -1)
    np.minimum.at(lowest, at, entries["text"])
    np.maximum.at(highest, at, entries["text"])
    places = np.flatnonzero((found | (lowest < highest))[at])
    hot = np.sort(np.frombuffer(b"".join(replies.column("hot").to_pylist()), np.uint64))
    return places, _within(keys[at[places]], hot)


def _classes(rows: np.ndarray, tag: np.ndarray, top: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first of each class of rows that are equal in bytes and tag, and the class of each row.
    Classes are in the order of `top`, if given.

    Rows are compared by a hash, and each is then verified against the first of its class; if
    two that differ have the same hash, the bytes themselves decide.
    """
    n = len(rows)
    padded = np.zeros((n, -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    folded = tag.astype(np.uint64)
    for word in padded.view(np.uint64).reshape(n, -1).T:
        folded = mixed(folded + word) * np.uint64(Powers.step)
    _, one, which = np.unique(folded, return_index=True, return_inverse=True)
    if (rows != rows[one[which]]).any() or (tag != tag[one[which]]).any():
        whole = np.concatenate([np.ascontiguousarray(tag.astype(">u8"))[:, None].view(np.uint8), padded], axis=1)
        whole = np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel()
        _, one, which = np.unique(whole, return_index=True, return_inverse=True)
    if top is not None:
        order = np.argsort(top[one], kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        one, which = one[order], rank[which]
    return one, which


class Contexts:
    """What surrounds the shared anchors of a unit: the bytes that its windows cover. Equal
    contexts are one, with the smallest document that has it. A hot anchor has a context for
    each window, whose key is the window's own hash."""

    def __init__(self, ids, texts, entries, shared, hot):
        chosen = {k: v[shared] for k, v in entries.items()}
        data = np.frombuffer(b"".join(texts) + b"\0" * _WIDTH, np.uint8)
        begins = np.cumsum([0, *map(len, texts)])[:-1]
        if hot.any():
            chosen, hot = self._alone(chosen, hot, data, begins)
        order = np.argsort(chosen["key"], kind="stable")
        chosen = {k: v[order] for k, v in chosen.items()}
        hot = hot[order]
        self.text, self.first, self.last = chosen["text"], chosen["first"], chosen["last"]
        self.doc = np.array([-1 if i is None else i for i in ids], dtype=np.int64)[self.text] if len(ids) else np.zeros(0, np.int64)
        size = self.last - self.first + SPAN
        start = begins[self.text] + self.first if len(begins) else np.zeros(0, np.int64)
        rows = data[start[:, None] + np.arange(_WIDTH)]
        rows[np.arange(_WIDTH) >= size[:, None]] = 0
        offset = np.where(hot, WHOLE, chosen["anchor"] - self.first)
        # In the order of the anchors' hashes, so that those of a bucket stand together.
        place = (size * 256 + offset).astype(np.uint64)
        _, top = np.unique(chosen["key"], return_inverse=True)
        self.one, self.which = _classes(rows, mixed(chosen["key"]) + place, top)
        self.least = np.full(len(self.one), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.which, self.doc)
        self.key, self.size, self.offset, self.rows = (x[self.one] for x in (chosen["key"], size, offset, rows))

    @staticmethod
    def _alone(chosen, hot, data, begins):
        """Entries with those of hot anchors replaced by one for each of their windows."""
        taken = {k: v[hot] for k, v in chosen.items()}
        windows = taken["last"] - taken["first"] + 1
        own = {k: np.repeat(v, windows) for k, v in taken.items()}
        own["first"] = own["first"] + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        own["last"] = own["first"]
        at = begins[own["text"]] + own["first"]
        own["key"] = mixed(Hashed(data, Powers()).of(at, at + SPAN))
        rest = np.count_nonzero(~hot)
        return {k: np.concatenate([v[~hot], own[k]]) for k, v in chosen.items()}, np.arange(rest + len(at)) >= rest


_MESSAGE = "bucket long, unit long, docs binary, sizes binary, offsets binary, bytes binary"


def _asker(bits: int, buckets: int):
    """Send the contexts of shared anchors to the buckets of their hashes."""

    def ask(key, texts: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        if texts.num_rows and replies.num_rows:
            ids, data, entries = _known_texts(texts)
            contexts = Contexts(ids, data, entries, *_shared(entries, replies, bits, buckets))
            cuts = np.searchsorted(_bucket(contexts.key, buckets), np.arange(buckets + 1))
            unit = texts.column("unit")[0].as_py()
            for b in np.flatnonzero(np.diff(cuts)):
                s = slice(cuts[b], cuts[b + 1])
                inside = np.arange(_WIDTH) < contexts.size[s][:, None]
                rows.append(
                    (int(b), unit, contexts.least[s].tobytes(), contexts.size[s].astype(np.uint8).tobytes(),
                     contexts.offset[s].astype(np.uint8).tobytes(), contexts.rows[s][inside].tobytes())
                )
        columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _MESSAGE.split(", ")])

    return ask


def sorted_suffixes(group: np.ndarray, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes inside each group, and what each shares with the one before it.

    `rows` holds the suffixes' bytes, `size` their lengths; `group` is ascending. The order is a
    mergesort whose comparisons find the common extension by a binary search on the hashes of
    prefixes. Common extensions are then verified on the bytes; a group in which two hashes
    agreed and the bytes did not is sorted by its bytes.
    """
    n, width = rows.shape
    powers = Powers().upto(width + 1)[0]
    prefix = np.zeros((n, width + 1), dtype=np.uint64)
    np.cumsum(Hashed.letters[rows] * powers[:width], axis=1, out=prefix[:, 1:])
    order = np.arange(n)
    cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), n)
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a > 1:
            order[a:b] = a + _merge_sorted(prefix[a:b], rows[a:b], size[a:b])
    shared = _extension(prefix, size, order, group)
    x, y = order[1:], order[:-1]
    wrong = ((rows[x] != rows[y]) & (np.arange(width) < shared[1:, None])).any(axis=1)
    for g in np.unique(group[1:][wrong]):
        a, b = np.searchsorted(group, [g, g + 1])
        order[a:b] = a + np.array(sorted(range(b - a), key=lambda i: rows[a + i, : size[a + i]].tobytes()))
        for i in range(a + 1, b):
            least = min(size[order[i]], size[order[i - 1]])
            differ = np.flatnonzero(rows[order[i], :least] != rows[order[i - 1], :least])
            shared[i] = differ[0] if len(differ) else least
    return order, shared


def _merge_sorted(prefix: np.ndarray, rows: np.ndarray, size: np.ndarray) -> list[int]:
    hashes, text, size = prefix.tolist(), [r.tobytes() for r in rows], size.tolist()

    def compare(i: int, j: int) -> int:
        a, b = hashes[i], hashes[j]
        low, high = 0, min(size[i], size[j])
        while low < high:
            middle = (low + high + 1) // 2
            if a[middle] == b[middle]:
                low = middle
            else:
                high = middle - 1
        if low < min(size[i], size[j]):
            return text[i][low] - text[j][low]
        return size[i] - size[j]

    return sorted(range(len(size)), key=cmp_to_key(compare))


def _extension(prefix, size, order, group) -> np.ndarray:
    """Length that each suffix shares with the one before it in its group, all searched at once."""
    x, y = order[1:], order[:-1]
    low = np.zeros(len(x), dtype=np.int64)
    high = np.where(group[1:] == group[:-1], np.minimum(size[x], size[y]), 0)
    while (low < high).any():
        middle = (low + high + 1) // 2
        equal = prefix[x, middle] == prefix[y, middle]
        low, high = np.where(equal, middle, low), np.where(equal, high, np.maximum(middle - 1, low))
    return np.append(0, low) if len(order) else low


def earlier_windows(rows, size, offset, doc) -> np.ndarray:
    """Bit s of each context: a smaller document has the window that starts at its byte s.

    Contexts with equal grams are sorted by what follows from the gram on. Windows that start
    the same way before the gram are equal if their suffixes share the rest, so windows with the
    gram at one offset fall into runs of the sorted order, and these into classes by what comes
    before; each class has a smallest document.
    """
    n = len(size)
    if not n:
        return np.zeros(0, np.uint32)
    width = np.arange(SPAN)
    padded = np.concatenate([rows, np.zeros((n, SPAN), np.uint8)], axis=1)
    suffix = padded[np.arange(n)[:, None], offset[:, None] + width]
    length = np.minimum(size - offset, SPAN)
    suffix[width >= length[:, None]] = 0
    _, group = _classes(suffix[:, :GRAM], np.zeros(n, np.uint64))
    by_group = np.argsort(group, kind="stable")
    several = np.bincount(group)[group[by_group]] > 1
    own = by_group[several]
    mask = np.zeros(n, dtype=np.uint32)
    if not len(own):
        return mask
    order, shared = sorted_suffixes(group[own], suffix[own], length[own])
    own = own[order]
    size, offset, doc, rows = size[own], offset[own], doc[own], rows[own]
    found = np.zeros(len(own), dtype=np.uint32)
    for before in range(REACH + 1):
        run = np.cumsum(shared < SPAN - before)
        has = np.flatnonzero((offset >= before) & (offset - before + SPAN <= size))
        if not len(has):
            continue
        head = rows[has[:, None], (offset[has] - before)[:, None] + np.arange(before)] if before else np.zeros((len(has), 0), np.uint8)
        _, kind = _classes(head, run[has].astype(np.uint64))
        least = np.full(kind.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, kind, doc[has])
        late = least[kind] < doc[has]
        found[has[late]] |= (np.uint32(1) << (offset[has[late]] - before).astype(np.uint32))
    mask[own] = found
    return mask


def _late(rows, size, offset, doc) -> np.ndarray:
    """`earlier_windows` of contexts of many units, of which equal ones are sorted once; single
    windows of hot grams have only equal ones to be compared with."""
    if not len(size):
        return np.zeros(0, np.uint32)
    one, which = _classes(rows, (size * 256 + offset).astype(np.uint64))
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    mask = np.zeros(len(one), dtype=np.uint32)
    sort = np.flatnonzero(offset[one] != WHOLE)
    own = one[sort]
    mask[sort] = earlier_windows(rows[own], size[own], offset[own], least[sort])
    every = (np.uint32(1) << (size - SPAN + 1).astype(np.uint32)) - np.uint32(1)
    return np.where(least[which] < doc, every, mask[which])


def _answer(table: pa.Table) -> pa.Table:
    """For each unit the windows of its contexts that a smaller document has."""
    units = table.column("unit").to_pylist()
    order = sorted(range(len(units)), key=units.__getitem__)
    columns = [table.column(c).to_pylist() for c in ("docs", "sizes", "offsets", "bytes")]
    doc = np.frombuffer(b"".join(columns[0][i] for i in order), np.int64)
    size = np.frombuffer(b"".join(columns[1][i] for i in order), np.uint8).astype(np.int64)
    offset = np.frombuffer(b"".join(columns[2][i] for i in order), np.uint8).astype(np.int64)
    rows = np.zeros((len(size), _WIDTH), np.uint8)
    rows[np.arange(_WIDTH) < size[:, None]] = np.frombuffer(b"".join(columns[3][i] for i in order), np.uint8)
    mask = _late(rows, size, offset, doc)
    out, at, bucket = [], 0, table.column("bucket")[0].as_py()
    for i in order:
        n = len(columns[1][i])
        out.append((units[i], bucket, mask[at : at + n].tobytes()))
        at += n
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["unit", "bucket", "masks"])


def _remover(bits: int, buckets: int):
    def remove(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        ids, data = _texts(texts)
        if answers.num_rows:
            _, _, entries = _known_texts(texts)
            replies = answers.filter(answers.column("bits").is_valid()).select(["bucket", "bits", "hot"])
            contexts = Contexts(ids, data, entries, *_shared(entries, replies, bits, buckets))
            cuts = np.searchsorted(_bucket(contexts.key, buckets), np.arange(buckets + 1))
            mask = np.zeros(len(contexts.one), dtype=np.uint32)
            for b, packed in zip(answers.column("bucket").to_pylist(), answers.column("masks").to_pylist()):
                if packed is not None:
                    mask[cuts[b] : cuts[b + 1]] = np.frombuffer(packed, np.uint32)
            gone = _covered(contexts, mask, data)
        else:
            gone = np.zeros(sum(map(len, data)), dtype=bool)
        rows, begin = [], 0
        for doc, text in zip(ids, data):
            spans = _spans(gone[begin : begin + len(text)])
            begin += len(text)
            kept, at = [], 0
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            left = b"".join([*kept, text[at:]])
            rows.append((doc, len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
        columns = list(zip(*rows)) if rows else [[]] * 6
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return remove


def _covered(contexts: Contexts, mask: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Which bytes of the texts, one after the other, lie in a window of a smaller document."""
    begins = np.cumsum([0, *map(len, texts)])
    first, last = begins[contexts.text] + contexts.first, begins[contexts.text] + contexts.last
    whole = contexts.doc > contexts.least[contexts.which]
    bits = np.where(whole, np.uint32(0), mask[contexts.which])
    starts, ends = [first[whole]], [last[whole] + SPAN]
    for s in range(REACH + 1):
        late = first[(bits >> np.uint32(s) & np.uint32(1)).astype(bool)] + s
        starts.append(late)
        ends.append(late + SPAN)
    size = int(begins[-1]) + 1
    open_ = np.bincount(np.concatenate(starts), minlength=size) - np.bincount(np.concatenate(ends), minlength=size)
    return (np.cumsum(open_) > 0)[:-1]


def _spans(gone: np.ndarray) -> list[tuple[int, int]]:
    """The maximal stretches of marked bytes."""
    if not gone.any():
        return []
    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Every document without the bytes covered by a string of SPAN bytes that also starts in a
    document with a smaller doc_id: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and `kept`,
    the remaining bytes.

    Texts are taken as UTF-8 bytes in units. Each unit tells buckets of hashes which anchors it
    has, and hears which of them other units have; it then sends what surrounds those to the
    same buckets, where suffixes are sorted and compared, and hears which windows a smaller
    document has. Texts themselves are shuffled once, by unit, and never to a bucket. Of one gram
    a bucket sorts at most HOT contexts and FEW - 1 of each unit: the windows of commoner grams
    are spread over all buckets by their own hashes, and only equal ones meet.

    A missing text is empty; a very long one is a unit of its own, taken whole. Rows with equal doc_id do not remove each other's bytes; a row
    without doc_id loses nothing and removes nothing. An empty table gives no rows. Other
    columns are not used.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units = max(1, min(math.ceil(total / UNIT_BYTES), MOST_UNITS))
    buckets = max(FEWEST_BUCKETS, math.ceil(total / BUCKET_BYTES))
    # Enough bits that few anchors agree by chance.
    bits = min(60, max(32, math.ceil(math.log2(total + 2)) + 15))

    unit = F.pmod(F.xxhash64("doc_id", "text"), F.lit(units)).alias("unit")
    laid = rows.select(unit, "doc_id", "text")
    sent = laid.groupBy("unit").applyInArrow(_sender(bits, buckets), _SENT)
    heard = sent.groupBy("bucket").applyInArrow(_meet, "unit long, bucket long, bits binary, hot binary")
    asked = laid.groupBy("unit").cogroup(heard.groupBy("unit")).applyInArrow(_asker(bits, buckets), _MESSAGE)
    masks = asked.groupBy("bucket").applyInArrow(_answer, "unit long, bucket long, masks binary")
    answers = heard.unionByName(masks, allowMissingColumns=True)
    return (
        laid.groupBy("unit")
        .cogroup(answers.groupBy("unit"))
        .applyInArrow(
            _remover(bits, buckets),
            "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
        )
    )
