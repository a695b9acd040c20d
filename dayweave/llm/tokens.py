"""Token ids by a public tokenizer, and token counts through a digest cache."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from dayweave.sources import materialize, scratch_space

# Executors get the functions themselves and need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
# Digests, of 32 bytes each, that may be broadcast.
FEW_DIGESTS = 100_000
# Words that a task remembers, and the longest of them in bytes: about 150 MB at most.
WORDS_KEPT, WORD_KEPT = 500_000, 64
# ASCII marks that the tokenizer never joins with a letter before them.
_MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class WordEncoder(dict):
    """Ids of words as little-endian 32-bit integers, remembered word by word.

    This tokenizer drops white space and never joins what stands on two sides of it, so the ids
    of a text are those of its words one after the other. A word is taken apart further where
    that is safe (letters followed by marks), and plain letters go to the merges directly;
    everything else goes to the library as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(_MARKS)
        text = core.decode(errors="replace")
        if len(core) < len(word) and self._plain(text[-1:]):
            ids = self[core] + self[word[len(core):]]
        elif len(core) == len(word) and self._plain(text):
            ids = self._merged(text)
        else:
            ids = self._encoded(word.decode(errors="replace"))
        if len(word) <= WORD_KEPT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = ids
        return ids

    @staticmethod
    def _plain(text: str) -> bool:
        """Letters whose lower case is one letter too."""
        return text.isalpha() and (text.isascii() or max(text) < "Ā")

    def _merged(self, text: str) -> bytes:
        text = text.lower() if text.isascii() else self.tokenizer.normalizer.normalize_str(text)
        if not self._plain(text):
            return self._encoded(text)
        spelled = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
        return b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled))

    def _encoded(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def ids(self, text: bytes) -> bytes:
        """Ids of a whole text in UTF-8. `split` cuts at the ASCII white space."""
        return b"".join(map(self.__getitem__, text.split()))


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The texts of an Arrow column as bytes, one at a time; a missing text is empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def normalised(text: str) -> Column:
    """What decides the count: the words, with one space between them. A missing text is empty."""
    return F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " "))


def version_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _counter(path: str):
    def count(batches):
        encoder = WordEncoder(path)
        for batch in batches:
            n = [len(encoder.ids(text)) // 4 for text in utf8(batch.column("content"))]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return count


def count_tokens(
    docs: DataFrame, columns: list[str], cache: str, path: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """`columns` of every document with `n_bytes`, `n_tokens` and `over_limit`.

    Counts are kept in the table at `cache` by the digests of the tokenizer's file and of the
    normalised text. Digests go first: those the cache does not know are found among digests
    alone, and only texts that have one of them are shuffled, once for all their copies, encoded
    and appended. A cache that knows all texts moves none of them. Jobs may append at the same
    time: a digest that is there several times counts once.

    A missing text is an empty one with 0 tokens; repeated rows and equal texts share one entry;
    a text of any length is encoded whole; a clashing column of `docs` not named in
    `columns` is not used. With no documents nothing is encoded.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path()
    version = version_digest(path)
    schema = "version string, digest binary, n_tokens long"
    spark.createDataFrame([], schema).write.mode("append").parquet(cache)

    def known():
        rows = spark.read.schema(schema).parquet(cache).where(F.col("version") == version)
        return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    digest = F.unhex(F.sha2("content", 256))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    keys = docs.select(*columns, n_bytes.alias("__bytes"), normalised("text").alias("content"))
    with scratch_space(spark, "token-counts") as folder:
        keys = materialize(keys.select(*columns, "__bytes", digest.alias("__digest")), "keys", folder)
        missing = keys.select(F.col("__digest").alias("digest")).distinct().join(known(), "digest", "left_anti")
        missing = materialize(missing, "missing", folder)
        n_missing = missing.count()
        contents = docs.select(normalised("text").alias("content")).select(digest.alias("digest"), "content")
        if n_missing <= FEW_DIGESTS:
            # Of a size that any task can hold.
            contents = contents.join(F.broadcast(missing), "digest", "left_semi").dropDuplicates(["digest"])
        else:
            contents = contents.dropDuplicates(["digest"]).join(missing, "digest", "left_semi")
        if n_missing:
            counted = contents.mapInArrow(_counter(path), "digest binary, n_tokens long")
            counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
        counts = known().select(F.col("digest").alias("__digest"), F.col("n_tokens").alias("__tokens"))
        out = keys.join(counts, "__digest").select(
            *columns,
            F.col("__bytes").alias("n_bytes"),
            F.col("__tokens").alias("n_tokens"),
            (F.col("__tokens") > limit).alias("over_limit"),
        )
        return materialize(out, "token-counts")
