"""Cross-tokenizer alignment: groups of tokens between common ends, found by pointer jumping."""

from __future__ import annotations

import hashlib
import os
import re
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from dayweave.llm.tokens import _byte_letters, tokenizer_path, utf8
from dayweave.sources import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Text that one unit holds, the words aligned in one go, and words a task remembers. They decide
# memory and speed only.
UNIT_BYTES, RUN_WORDS, WORDS_KEPT = 4 << 20, 200_000, 500_000
# A text longer than this is taken in sections.
SECTION = 1 << 20
# Groups with more links than this are reduced to distinct ids before they are multiplied.
MANY = 4096
_CUT = re.compile(r"(?<=\S) ")


def overlap_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of two sequences over the same bytes, numbered from 0.

    Every token points to the token of the other sequence that overlaps it and reaches farthest
    to the right, or to itself where none goes beyond its end; of two that end together the
    second sequence's is the terminal. Doubling the pointers until they stop leads every token
    to the terminal of its component, in a number of steps logarithmic in the longest chain.
    """
    na, nb = len(ends_a), len(ends_b)
    own_b = na + np.arange(nb)
    to = np.empty(na + nb, dtype=np.int64)
    to[:na] = na + np.searchsorted(ends_b, ends_a)
    holder = np.searchsorted(ends_a, ends_b)
    to[na:] = np.where(ends_a[holder] > ends_b, holder, own_b) if nb else own_b
    while not np.array_equal(further := to[to], to):
        to = further
    number = np.cumsum(to[na:] == own_b) - 1
    group = number[to - na]
    return group[:na], group[na:]


def sections(text: str) -> Iterator[str]:
    """The text with its added space, in pieces that tokens never cross: cut at spaces after
    something else than white space."""
    text = " " + text
    start = 0
    while len(text) - start > SECTION:
        near = text.rfind(" ", start + 1, start + SECTION)
        while near > start and text[near - 1].isspace():
            near = text.rfind(" ", start + 1, near)
        if near <= start:
            later = _CUT.search(text, start + SECTION)
            if not later:
                break
            near = later.start()
        yield text[start:near]
        start = near
    yield text[start:]


def words_of(section: str) -> list[str]:
    """The words of a section without their leading space; odd white space stays in them."""
    if section[:2] == "  " or re.search(r"\s ", section[1:]):
        return _CUT.split(section[1:])
    return section[1:].split(" ")


class Aligner:
    """Tokens of words by both tokenizers, remembered word by word.

    Neither tokenizer joins what stands before a space with the space when there is no white
    space before it: the first splits there before it merges, and the second has no piece with
    a space after another letter. So the tokens of a text are those of its words.
    """

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        # Spark already runs a task per core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.first = Tokenizer.from_file(path_a)
        self.first.encode_special_tokens = True
        self.second = SentencePieceProcessor(model_file=path_b)
        letters = {letter: b for b, letter in _byte_letters().items()}
        names = (self.first.id_to_token(i) or "" for i in range(self.first.get_vocab_size()))
        self.bytes_a = [bytes(letters[c] for c in name) for name in names]
        self.bytes_b = [self._piece(i) for i in range(len(self.second))]
        self.size_a, self.size_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        # Decimal ids with what follows them inside a side and at its end.
        self.text_a, self.text_b = (
            np.array([f"{i}{mark}" for mark in marks for i in range(n)], dtype=bytes)
            for marks, n in ((",|", len(self.bytes_a)), (",;", len(self.bytes_b)))
        )
        self._forget()

    def _piece(self, i: int) -> bytes:
        name = self.second.id_to_piece(i)
        return bytes([int(name[1:-1], 16)]) if self.second.is_byte(i) else name.replace("▁", " ").encode()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.starts = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.whole = np.zeros(0, dtype=bool)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word; words not met before are tokenized."""
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        if len(self.known) + len(new) > WORDS_KEPT:
            self._forget()
            new = list(dict.fromkeys(words))
        if new:
            self._learn(new)
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))

    def _learn(self, new: list[str]):
        a = [e.ids for e in self.first.encode_batch_fast([" " + w for w in new], add_special_tokens=False)]
        b = self.second.encode(new, num_threads=1)
        if "" in new:
            # A space at the end of a text; alone, the library takes it for no text.
            b[new.index("")] = [self.second.piece_to_id("▁")]
        spelled = " " + " ".join(new)
        whole = np.ones(len(new), dtype=bool)
        for ids, table in ((a, self.bytes_a), (b, self.bytes_b)):
            if b"".join([table[t] for x in ids for t in x]) != spelled.encode():
                whole &= [b"".join([table[t] for t in x]) == b" " + w.encode() for x, w in zip(ids, new)]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.whole = np.concatenate([self.whole, whole])
        for k, found in enumerate((a, b)):
            count = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int64, count.sum())
            self.starts[k] = np.concatenate([self.starts[k], self.starts[k][-1] + np.cumsum(count)])
            self.ids[k] = np.concatenate([self.ids[k], flat])

    def tokens(self, numbers: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids by one tokenizer of the words with these numbers, one after the other, and how
        many each word has."""
        first, count = self.starts[k][numbers], self.starts[k][numbers + 1] - self.starts[k][numbers]
        before = np.cumsum(count) - count
        return self.ids[k][np.repeat(first - before, count) + np.arange(count.sum())], count


class Run:
    """The tokens and groups of some words, which belong to documents numbered in `owner`."""

    def __init__(self, aligner: Aligner, words: list[str], owner: np.ndarray):
        self.aligner = aligner
        numbers = aligner.numbers(words)
        self.broken = np.unique(owner[~aligner.whole[numbers]])
        if len(self.broken):
            use = ~np.isin(owner, self.broken)
            numbers, owner = numbers[use], owner[use]
        self.a, count_a = aligner.tokens(numbers, 0)
        self.b, count_b = aligner.tokens(numbers, 1)
        self.doc_a, self.doc_b = np.repeat(owner, count_a), np.repeat(owner, count_b)
        self.ends_a = np.cumsum(aligner.size_a[self.a])
        self.of_a, self.of_b = overlap_groups(self.ends_a, np.cumsum(aligner.size_b[self.b]))
        self.n_a, self.n_b = np.bincount(self.of_a), np.bincount(self.of_b)
        self.from_a, self.from_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        self.doc = self.doc_a[self.from_a]

    def totals(self, n: int) -> np.ndarray:
        """Tokens of both kinds, groups and links of each of n documents."""
        links = np.zeros(n, np.int64)
        np.add.at(links, self.doc, self.n_a * self.n_b)
        return np.stack([*(np.bincount(d, minlength=n) for d in (self.doc_a, self.doc_b, self.doc)), links])

    def spelled(self) -> Iterator[tuple[int, bytes]]:
        """For each document its groups as text: ids of both sides in order, each group with an end mark."""
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[self.from_a + self.n_a - 1] = last_b[self.from_b + self.n_b - 1] = True
        out = np.empty(len(self.a) + len(self.b), dtype=max(self.aligner.text_a.dtype, self.aligner.text_b.dtype))
        out[np.arange(len(self.a)) + self.from_b[self.of_a]] = self.aligner.text_a[self.a + last_a * len(self.aligner.bytes_a)]
        out[np.arange(len(self.b)) + (self.from_a + self.n_a)[self.of_b]] = self.aligner.text_b[
            self.b + last_b * len(self.aligner.bytes_b)
        ]
        docs, first = np.unique(self.doc, return_index=True)
        edges = [*(self.from_a[first] + self.from_b[first]), len(out)]
        for doc, start, end in zip(docs.tolist(), edges, edges[1:]):
            yield doc, out[start:end].tobytes().translate(None, b"\0")

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of (document, id, id), distinct and in order, and how many links each has."""
        n_a, n_b = len(self.aligner.bytes_a), len(self.aligner.bytes_b)
        many = self.n_a * self.n_b
        few = np.flatnonzero(many <= MANY)
        count = many[few]
        group = np.repeat(few, count)
        at = np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)
        a = self.a[self.from_a[group] + at // self.n_b[group]]
        b = self.b[self.from_b[group] + at % self.n_b[group]]
        key, times = np.unique((self.doc[group] * n_a + a) * n_b + b, return_counts=True)
        rest = [(key, times)]
        for g in np.flatnonzero(many > MANY):
            a, times_a = np.unique(self.a[self.from_a[g] :][: self.n_a[g]], return_counts=True)
            b, times_b = np.unique(self.b[self.from_b[g] :][: self.n_b[g]], return_counts=True)
            key = (self.doc[g] * n_a + a[:, None]) * n_b + b
            rest.append((key.ravel(), (times_a[:, None] * times_b).ravel()))
        return rest[0] if len(rest) == 1 else summed(rest)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their numbers."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    out = np.zeros(len(key), np.int64)
    np.add.at(out, at, np.concatenate([n for _, n in parts]))
    return key, out


def _decoded(raw: bytes) -> str:
    """A text that is not UTF-8 counts as one that the tokens do not spell."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return "▁"


def runs(aligner: Aligner, texts: list[str]) -> Iterator[Run]:
    """The texts in runs of whole words; only a long text takes several."""
    words, owner = [], []

    def run():
        return Run(aligner, words, np.repeat([d for d, _ in owner], [n for _, n in owner]).astype(np.int64))

    for doc, text in enumerate(texts):
        for section in sections(text) if text else ():
            found = words_of(section)
            words += found
            owner.append((doc, len(found)))
            if len(words) >= RUN_WORDS:
                yield run()
                words, owner = [], []
    if words:
        yield run()


def measured(aligner: Aligner, texts: list[str]):
    """Totals (4 rows), digests of the groups, and keys of links with their numbers, for some texts."""
    n = len(texts)
    totals = np.zeros((4, n), np.int64)
    digests, links, broken = [None] * n, [], [np.zeros(0, np.int64)]
    for run in runs(aligner, texts):
        broken.append(run.broken)
        if not len(run.a):
            continue
        totals += run.totals(n)
        links.append(run.links())
        for doc, spelled in run.spelled():
            # Groups have end marks; the last one of a document goes.
            if digests[doc] is None:
                digests[doc] = hashlib.sha256(spelled[:-1])
            else:
                digests[doc].update(b";" + spelled[:-1])
    key, times = links[0] if len(links) == 1 else summed(links)
    broken = np.unique(np.concatenate(broken))
    totals[:, broken] = 0
    for doc in broken:
        digests[doc] = None
    use = ~np.isin(key // (len(aligner.bytes_a) * len(aligner.bytes_b)), broken)
    return totals, [d.hexdigest() if d else "" for d in digests], key[use], times[use]


def _lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, pa.int32()))


_MEASURES = ["n_a", "n_b", "n_groups", "n_links"]
_UNITS = "__unit long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, __at array<int>, __times array<int>, __pairs array<long>, __docs array<int>"


def _unit_writer(path_a: str, path_b: str, names: list[str]):
    """Rows for the documents of a unit, and one row with the distinct id pairs of the unit."""

    def write(batches):
        aligner = Aligner(path_a, path_b)
        space = len(aligner.bytes_a) * len(aligner.bytes_b)
        number = TaskContext.get().partitionId() << 32
        own, texts, size = [], [], 0

        def unit():
            n = len(texts)
            totals, digests, key, times = measured(aligner, texts)
            pairs, at = np.unique(key % space, return_inverse=True)
            edges = np.searchsorted(key // space, np.arange(n + 1))
            table = pa.Table.from_batches(own).combine_chunks()
            columns = [
                *(table.column(c).combine_chunks() for c in names),
                pa.array(np.full(n, number)),
                *(pa.array(t) for t in totals),
                pa.array(digests, pa.string()),
                _lists(at, edges),
                _lists(times, edges),
            ]
            none = [pa.nulls(n, t) for t in (pa.list_(pa.int64()), pa.list_(pa.int32()))]
            labels = [*names, "__unit", *_MEASURES, "groups_sha256", "__at", "__times", "__pairs", "__docs"]
            rows = pa.RecordBatch.from_arrays([*columns, *none], names=labels)
            yield rows
            empty = [pa.nulls(1, c.type) for c in columns]
            empty[len(names)] = pa.array([number])
            held = [pa.array([pairs], pa.list_(pa.int64())), pa.array([np.bincount(at)], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*empty, *held], names=labels)

        for batch in batches:
            start = 0
            for row, raw in enumerate(utf8(batch.column("__text"))):
                texts.append(_decoded(raw))
                size += len(raw)
                if size >= UNIT_BYTES or row + 1 == batch.num_rows:
                    own.append(batch.select(names).slice(start, row + 1 - start))
                    start = row + 1
                if size >= UNIT_BYTES:
                    yield from unit()
                    number, own, texts, size = number + 1, [], [], 0
        if texts:
            yield from unit()

    return write


def _scorer(names: list[str]):
    """Sums over the links of each document of a unit, from the corpus-wide counts of its pairs."""

    def score(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(pairs.column("pos")))
        n, best = (np.asarray(pairs.column(c))[order] for c in ("n", "best"))
        docs = docs.combine_chunks()
        at, times = (docs.column(c).combine_chunks() for c in ("__at", "__times"))
        edges = np.concatenate([[0], np.cumsum(np.asarray(at.value_lengths()))])
        at, times = (np.asarray(x.flatten()).astype(np.int64) for x in (at, times))
        ahead = [np.concatenate([[0], np.cumsum(times * v[at])]) for v in (best.astype(np.int64), n)]
        sums = [pa.array(x[edges[1:]] - x[edges[:-1]]) for x in ahead]
        columns = [docs.column(c) for c in (*names, *_MEASURES)]
        return pa.table([*columns, *sums, docs.column("groups_sha256")], names=[*names, *_MEASURES, "n_best", "count_sum", "groups_sha256"])

    return score


def align(docs: DataFrame, columns: list[str], path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """`columns` of every document with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    Each text is tokenized by a byte-level tokenizer (A, a space in front) and by a sentence
    piece model (B, which adds the space). Byte offsets where tokens of both end cut them into
    groups; a link is a pair of an A and a B token of one group. An id pair's count is the number
    of documents that hold it linked; n_best counts the links whose count is the highest of
    their A id in the corpus, count_sum adds up the counts of all links. Texts that are missing, empty, or not spelled
    by the tokens of both have no tokens: zeros, and '' for the digest of the groups.

    Tasks align texts in units of a few MB and write, per unit, each distinct id pair once with
    the number of documents that hold it. Pairs are counted from those, so a frequent pair is a
    row per unit, not per document, and partly summed before the shuffle. The counts go back to
    the units, whose documents then need no text any more.

    Rows are counted each, also repeated ones and those with equal or missing ids. A very long
    text is taken in sections. An empty table gives no rows. Other columns are not used, whatever
    their names.
    """
    path_a, path_b = path_a or tokenizer_path(TOKENIZER_A), path_b or tokenizer_path(TOKENIZER_B)
    own = docs.select(*columns).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    rows = docs.select(*columns, docs["text"].alias("__text"))
    units = materialize(rows.mapInArrow(_unit_writer(path_a, path_b, columns), f"{schema}, {_UNITS}"), "aligned")
    held = units.where(F.col("__pairs").isNotNull()).select(
        F.col("__unit").alias("unit"), F.posexplode(F.arrays_zip("__pairs", "__docs")).alias("pos", "held")
    )
    held = held.select("unit", "pos", F.col("held.__pairs").alias("pair"), F.col("held.__docs").alias("docs"))
    known = materialize(best_pairs(held, second_size(path_b)), "pair-counts")
    answers = held.select("unit", "pos", "pair").join(known.select("pair", "n", "best"), "pair").select("unit", "pos", "n", "best")
    parts = units.where(F.col("__pairs").isNull()).drop("__pairs", "__docs")
    out = ", ".join(f"{c} long" for c in (*_MEASURES, "n_best", "count_sum"))
    return (
        parts.groupBy("__unit")
        .cogroup(answers.groupBy("unit"))
        .applyInArrow(_scorer(columns), f"{schema}, {out}, groups_sha256 string")
    )


def second_size(path_b: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return len(SentencePieceProcessor(model_file=path_b))


def best_pairs(held: DataFrame, size_b: int) -> DataFrame:
    """pair, a, b, n and whether n is the highest of its A id, for every id pair of the corpus."""
    counts = held.groupBy("pair").agg(F.sum("docs").alias("n"))
    counts = counts.withColumns({"a": F.expr(f"pair div {size_b}"), "b": F.col("pair") % size_b})
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def token_groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """The groups themselves: doc_id, place in the text, bytes from and to (of the text with its
    added space) and the ids on both sides. Texts without tokens have no rows."""
    path_a, path_b = path_a or tokenizer_path(TOKENIZER_A), path_b or tokenizer_path(TOKENIZER_B)

    def write(batches):
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            for row, raw in enumerate(utf8(batch.column("text"))):
                found = list(runs(aligner, [_decoded(raw)]))
                if any(len(run.broken) for run in found):
                    continue
                base = offset = 0
                for run in found:
                    n = len(run.n_a)
                    to = run.ends_a[run.from_a + run.n_a - 1] + offset
                    start = np.concatenate([[offset], to[:-1]])
                    sides = [
                        pa.ListArray.from_arrays(pa.array([*edges, len(ids)], pa.int32()), pa.array(ids, pa.int32()))
                        for edges, ids in ((run.from_a, run.a), (run.from_b, run.b))
                    ]
                    own = batch.column("doc_id").take(pa.array(np.full(n, row)))
                    yield pa.RecordBatch.from_arrays(
                        [own, pa.array(base + np.arange(n)), pa.array(start), pa.array(to), *sides],
                        names=["doc_id", "place", "from_byte", "to_byte", "a_ids", "b_ids"],
                    )
                    base, offset = base + n, to[-1]

    schema = "doc_id long, place long, from_byte long, to_byte long, a_ids array<int>, b_ids array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, schema)
