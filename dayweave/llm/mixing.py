"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dayweave.llm.text import running_totals, word_count
from dayweave.sources import materialize

# The weights given to sources in their order, repeating, and how often a
# document may be used.
WEIGHTS = (1, 2, 3)
EPOCHS = 3
SEED = "mix"


def source_targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """`source`, `source_size`, `before` (size of the sources in front) and `target` per source.

    The sources share the size of all by weight; none gets more than `epochs` times its own
    size, and what is over is shared again by weight. In order of size by weight, the level at
    which the rest shares rises while sources are capped and falls after that, so it is the
    largest of the levels taken at each source. Empty sources get 0.
    """
    source = F.col("source").asc_nulls_last()
    ranked = running_totals(
        sizes, [source], {"rank": F.lit(1), "up_to": F.col("source_size")}, "sources"
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = ranked.withColumns(
        {
            "before": F.col("up_to") - F.col("source_size"),
            "weight": weight,
            "most": epochs * F.col("source_size"),
        }
    )
    ratio = F.col("most") / F.col("weight")
    levels = running_totals(
        ranked.withColumn("ratio", ratio),
        [F.col("ratio").asc(), source],
        {"most_to": F.col("most"), "weight_to": F.col("weight").cast("long")},
        "levels",
    )
    levels = materialize(levels, "targets")
    # Two rows of totals, whatever the number of sources.
    total = levels.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    rest = F.lit(total["size"] or 0) - (F.col("most_to") - F.col("most"))
    others = F.lit(total["weight"] or 0) - (F.col("weight_to") - F.col("weight"))
    level = levels.agg(F.max(rest / others).alias("level")).first()["level"] or 0.0
    return levels.select(
        "source",
        "source_size",
        "before",
        F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight")).alias("target"),
    )


def _shuffle_key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _queues(docs: DataFrame, seed: str, epochs: int) -> DataFrame:
    """Groups of equal (source, doc_id, size) with `up_to`, the size served in all queues up to
    their end, and what is known of their source."""
    rows = docs.select("source", "doc_id", word_count("text").alias("size"))
    grouped = materialize(rows.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    used = F.col("size") * F.col("copies")
    targets = source_targets(grouped.groupBy("source").agg(F.sum(used).alias("source_size")), epochs=epochs)
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id").asc_nulls_last(), F.col("size")]
    queue = running_totals(grouped.withColumn("key", _shuffle_key(seed)), order, {"up_to": used}, "queue")
    return queue.join(
        targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))
    ).drop("__source")


def schedule(docs: DataFrame, seed: str = SEED, epochs: int = EPOCHS) -> DataFrame:
    """Every document with its place in the queue of its source and what the mix takes of it.

    Each source serves its documents in a shuffled order fixed by `seed`, up to `epochs` times
    over. The virtual finish time of a document is the size its source has served up to its
    end, divided by the target of the source. All sources reach their targets, and the mix its
    budget (the sum of the targets), at time 1; the mix is cut there, and a document then being
    served is taken up to the cut. `taken` is the words taken over all epochs, `finish` the
    first finish time (NULL for sources without words).

    Documents are counted in groups of equal (source, doc_id, size), so repeated rows cannot
    gather in one place; each row of a group gets its own place in the queue. A missing text has
    size 0, a missing source is a source of its own, a missing id is an id. Empty input gives
    no rows. Other columns of `docs` are not used.
    """
    placed = _queues(docs, seed, epochs)
    used = F.col("size") * F.col("copies")
    first = F.col("up_to") - used - F.col("before")
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).withColumn(
        "start", first + (F.col("copy") - 1) * F.col("size")
    )
    quota = F.floor("target")
    words = [
        F.greatest(F.lit(0), F.least(F.col("size"), quota - F.col("start") - k * F.col("source_size")))
        for k in range(epochs)
    ]
    return each.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        sum(words[1:], words[0]).cast("long").alias("taken"),
        "start",
        F.array(*words).alias("words"),
        F.when(F.col("target") > 0, (F.col("start") + F.col("size")) / F.col("target")).alias("finish"),
    )


def mix(docs: DataFrame, seed: str = SEED, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: one row (doc_id, source, epoch, words, finish) per document served, in
    the order of virtual finish times, cut at the total budget."""
    served = schedule(docs, seed, epochs).select(
        "doc_id", "source", "size", "source_size", "target", "start", F.posexplode("words").alias("epoch", "words")
    )
    end = F.col("start") + F.col("size") + F.col("epoch") * F.col("source_size")
    return (
        served.where(F.col("words") > 0)
        .select("doc_id", "source", "epoch", "words", (end / F.col("target")).alias("finish"))
        .orderBy("finish", "doc_id", "epoch")
    )


def report(docs: DataFrame) -> DataFrame:
    """One row per document with what the mix takes of it, in the order of finish times."""
    return (
        schedule(docs)
        .select("doc_id", "size", "source_size", "target", "taken", "finish")
        .orderBy(F.col("finish").asc_nulls_last(), "doc_id")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, whole, as often as it uses them, with the columns of `docs`.

    A document cut at the end of the budget is used whole if at least half of it is taken, and
    else not; this moves a source by less than half a document. Rows that are equal in source,
    id and size have places of their own in the queue; where they differ in other columns,
    which of them takes which place is fixed by the order of those columns' hash. The group
    gets its number of uses exactly, also when its rows are all equal. Documents without words,
    missing and empty texts among them, are not used; a missing source is a source of its own;
    an empty table gives no rows.
    """
    names = docs.columns
    cuts = materialize(_cuts(docs), "cuts").withColumnsRenamed({"source": "__source", "key": "__cut_key", "size": "__cut_size"})
    own = docs.withColumns({"__size": word_count("text"), "__key": _shuffle_key(SEED)})
    # One row per source, so texts stay where they are.
    joined = own.where(F.col("__size") > 0).join(cuts, F.col("source").eqNullSafe(F.col("__source")))
    ahead = (F.col("__key") < F.col("__cut_key")) | (F.col("__key") == F.col("__cut_key")) & (F.col("__size") < F.col("__cut_size"))
    at_cut = (F.col("__key") == F.col("__cut_key")) & (F.col("__size") == F.col("__cut_size"))
    even = joined.where(~at_cut).withColumn("__times", F.col("full") + ahead.cast("int")).select(*names, "__times")
    # Of the rows at the cut the first ones are used once more, in the order of the rows' hash
    # and then of a number, which equal rows have too.
    row = F.xxhash64(*[c for c, t in docs.dtypes if not t.startswith("map")])
    rows = materialize(joined.where(at_cut).withColumn("__hash", row), "rows-at-cuts")
    rows = rows.withColumn("__number", F.monotonically_increasing_id())
    order = [F.col("__source").asc_nulls_last(), F.col("__hash"), F.col("__number")]
    ranked = running_totals(rows, order, {"__rank": F.lit(1)}, "ranks-at-cuts")
    before = ranked.groupBy("__source").agg(F.min("__rank").alias("__first")).withColumnRenamed("__source", "__of")
    ranked = ranked.join(before, F.col("__source").eqNullSafe(F.col("__of")))
    more = (F.col("__rank") - F.col("__first") < F.col("extra")).cast("int")
    # A sequence from 1 to 0 would run down.
    served = even.union(ranked.select(*names, (F.col("full") + more).alias("__times"))).where(F.col("__times") > 0)
    return served.withColumn("__use", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*names)


def _cuts(docs: DataFrame) -> DataFrame:
    """One row per source with words: where its queue is cut.

    Documents are used `full` times, and those before the group (key, size) once more; of that
    group `extra` rows are used once more, the last of them if at least half of it is taken.
    """
    used = F.col("size") * F.col("copies")
    first = F.col("up_to") - used - F.col("before")
    quota = F.floor("target")
    full = F.floor(quota / F.col("source_size"))
    left = quota - full * F.col("source_size")
    groups = _queues(docs, SEED, EPOCHS).where(used > 0).withColumns({"full": full.cast("int"), "into": left - first})
    over = F.pmod("into", "size")
    taken_half = (over > 0) & (2 * over >= F.col("size"))
    return groups.where((F.col("into") >= 0) & (F.col("into") < used)).select(
        "source", "key", "size", "full", (F.floor(F.col("into") / F.col("size")) + taken_half.cast("int")).alias("extra")
    )
