"""Mixing sources to target weights from fixed-length token blocks.

The words of a source are packed, document after document, into blocks of a
fixed number of words. A source gets as many block slots as its target needs.
Every output shard then draws how many of its places each source fills: a
multinomial draw conditioned on the sources' totals, so that targets are met and
not only expected. It is made without replacement: one keyed permutation puts
the tickets of all sources, one per slot, in the places of all shards, and
every shard but the last has ``SHARD_SLOTS`` places. The counts are a table of
shard and source; their running sums over the shards turn them into slot
numbers. Slot number k of a source is block ``permutation(k)``: a keyed
permutation of the block numbers, computed from k alone, whose passes use every
block once before any block is used again. Slots and blocks meet in an equality
join on (source, block); what the mix takes is the sum over the shards' slots.

Scale: only (source, id, size) rows are shuffled to lay out the blocks. Places
within a source come from bucket totals, so no task sorts a whole source, and a
source with a third of all rows is many buckets. Tickets and slots are made in
as many tasks as their number asks for. Per-source totals are one row per source.
Joins with slots and pieces, which grow with the input, ask for a merge join:
their compressed size says little about what a broadcast would hold. Everything
is DataFrame code.

Defined cases: a null text has size 0 and takes part in nothing; a null source
is a source of its own, last in order; null ids are allowed; rows that repeat an
id and a text share one entry and count as often as they stand there; other
columns pass through, also those named as a column that the mix adds (which all
begin with two underscores); an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .quality_rules import words

BLOCK_WORDS = 64
BUCKET_WORDS = 250_000
BUCKET_GROUP = 4096
SHARD_SLOTS = 4096
SLOT_RANGE = 65_536
TASK_SLOTS = 1 << 18
SHARD_GROUP = 4096
ROUNDS = 16
WEIGHTS = (3, 1, 2)
# What names a document row: its id, a hash of text and source, which of equal rows it is.
KEYS = ["__id", "__text_hash", "__part"]


def permuted(x: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0..n-1 ("swap or not"), for any n above 0."""
    def swap_or_not(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(r, *key), n) - x, n)
        coin = F.xxhash64(F.lit("coin"), r, *key, F.greatest(x, partner)).bitwiseAND(F.lit(1).cast("long"))
        return F.when(coin == 1, partner).otherwise(x)

    # A fold, since the expression of a round names x several times.
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), swap_or_not)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], factor: float, most: float) -> DataFrame:
    """One row per source: ``source_size``, ``weight`` and ``target``.

    ``sizes`` has ``source`` and ``size``. The targets share ``factor`` times all
    words by weight; a target stops at ``most`` times its source's size and the
    excess is shared again. The stopped sources are the first ones in the order
    of cap over weight; running sums find where the rest's share fits.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(order, F.lit(len(weights))))
    weighed = totals.select("source", "source_size", order.alias("source_no"), weight.alias("weight")).withColumn("cap", F.lit(most) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    share = (F.lit(factor) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    shares = weighed.withColumn("share", share).withColumn("stopped", F.col("cap") / F.col("weight") <= F.col("share"))
    # The share of the first source that isn't stopped holds for all such sources.
    common = F.min(F.when(~F.col("stopped"), F.struct(F.col("cap") / F.col("weight"), F.col("source_no"), F.col("share").alias("share")))).over(everything)["share"]
    return shares.select(
        "source",
        "source_no",
        "source_size",
        F.when(F.col("stopped"), F.col("cap")).otherwise(F.col("weight") * common).alias("target"),
    )


@dataclass(frozen=True)
class Mix:
    """The tables of a mix; ``__id``, ``__text_hash`` and ``__part`` name a document row.

    documents: the input rows with those keys, ``__size``, ``__source_size`` and
    ``__target``.
    sources: ``source_no``, ``source_size``, ``target``, ``blocks``, ``slots``.
    pieces: the part of each document in each block (``first`` word, ``n_words``).
    counts: how many slots each ``shard`` drew of each source, and its ``first`` one.
    """

    documents: DataFrame
    sources: DataFrame
    pieces: DataFrame
    counts: DataFrame
    seed: int
    tasks: int

    @property
    def slots(self) -> DataFrame:
        """Every slot with its output ``shard``, ``pass`` and ``block``, from the drawn counts."""
        drawn = self.counts.repartition(self.tasks, "shard", "source_no")
        k = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))
        slots = drawn.select("shard", "source_no", "blocks", k.alias("k")).withColumn("pass", F.floor(F.col("k") / F.col("blocks")))
        block = permuted(F.pmod(F.col("k"), F.col("blocks")), F.col("blocks"), F.lit(self.seed), F.col("source_no"), F.col("pass"))
        return slots.select("source_no", "k", "pass", "shard", block.alias("block"))

    def taken(self) -> DataFrame:
        """Words that the mix takes of each document, repeats and all shards counted."""
        uses = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("uses"))
        used = self.pieces.join(uses.hint("merge"), ["source_no", "block"])
        return used.groupBy(*KEYS).agg(F.sum(F.col("n_words") * F.col("uses")).alias("taken"))

    def taken_texts(self, text: str = "text") -> DataFrame:
        """The mix by documents: a row for each document and pass over its source.

        ``text`` is what the pass takes of the document: the whole text as it
        stands, or the words of the blocks that were drawn, one space between.
        Columns of ``documents`` stay; ``__pass`` is added.
        """
        used = self.pieces.join(self.slots.select("source_no", "block", F.col("pass").alias("__pass")).hint("merge"), ["source_no", "block"])
        spans = used.groupBy(*KEYS, "__pass").agg(F.sort_array(F.collect_list(F.struct("first", F.col("n_words").cast("int").alias("n")))).alias("__spans"), F.sum("n_words").alias("__taken"))
        spans = spans.withColumnsRenamed({k: f"__of{k}" for k in KEYS})
        joined = self.documents.join(spans.hint("merge"), [F.col(k).eqNullSafe(F.col(f"__of{k}")) for k in KEYS])
        joined = joined.withColumn("__words", F.when(F.col("__taken") < F.col("__size"), words(F.col(text))))
        parts = F.flatten(F.transform("__spans", lambda x: F.slice(F.col("__words"), x["first"] + 1, x["n"])))
        chosen = F.when(F.col("__words").isNull(), F.col(text)).otherwise(F.array_join(parts, " "))
        return joined.withColumn(text, chosen).drop("__spans", "__taken", "__words", *[f"__of{k}" for k in KEYS])

    def blocks(self, text: str = "text") -> DataFrame:
        """The mix itself: each slot with the words of its block."""
        spans = self.pieces.select("source_no", "block", "place", *KEYS, "first", "n_words")
        texts = self.documents.select(*[F.col(k).alias(f"__of{k}") for k in KEYS], F.col(text).alias("__text"))
        with_text = spans.join(texts.hint("merge"), [F.col(k).eqNullSafe(F.col(f"__of{k}")) for k in KEYS])
        packed = (
            with_text.withColumn("__text", F.array_join(F.slice(words(F.col("__text")), F.col("first") + 1, F.col("n_words").cast("int")), " "))
            .groupBy("source_no", "block")
            .agg(F.sort_array(F.collect_list(F.struct("place", "__text"))).alias("__parts"))
            .select("source_no", "block", F.array_join(F.col("__parts")["__text"], " ").alias("text"))
        )
        return self.slots.join(packed.hint("merge"), ["source_no", "block"])


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    factor: float = 1.5,
    most: int = 2,
    block_words: int = BLOCK_WORDS,
    seed: int = 7,
) -> Mix:
    """Plan a mix of ``docs``; see ``Mix`` for what comes out."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumns(
        {
            "__id": F.col(id_col).cast("long"),
            "__text_hash": F.xxhash64(whole, F.col(source)),
            "__size": F.size(words(whole)).cast("long"),
            "__source": F.col(source),
        }
    )
    rows = written(keyed.select("__id", "__text_hash", F.col("__size").alias("size"), F.col("__source").alias("source")), "mix_sizes")
    targets = written(source_targets(rows.select("source", "size"), weights, factor, float(most)), "mix_targets")
    n_blocks = F.ceil(F.col("source_size") / block_words)
    sources = targets.withColumn("blocks", n_blocks).withColumn("slots", F.coalesce(F.least(F.round(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size"))).cast("long"), F.col("blocks") * most), F.lit(0)))
    bounds = sources.agg(F.sum("source_size").alias("words"), F.sum("slots").alias("slots")).first()
    n_buckets = max(1, (bounds["words"] or 0) // BUCKET_WORDS)

    # Rows that repeat an id and a text are one entry, as long as all of them.
    same = F.col("source").eqNullSafe(F.col("__of"))
    numbered = rows.join(targets.select(F.col("source").alias("__of"), "source_no"), same).drop("__of", "source")
    entries = numbered.where("size > 0").groupBy("source_no", "__id", "__text_hash", "size").agg(F.count("*").alias("copies"))
    # Copies are laid out one after another, as parts 0, 1, ... of one entry.
    entries = entries.withColumn("__part", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int")))).drop("copies")
    entries = written(entries.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "__id", "__text_hash"), F.lit(n_buckets))), "mix_entries")
    # Where buckets start: totals of groups of buckets, then of the buckets of a group.
    totals = entries.groupBy("source_no", "bucket").agg(F.sum("size").alias("total")).withColumn("group", F.floor(F.col("bucket") / BUCKET_GROUP))
    of_groups = Window.partitionBy("source_no").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    of_buckets = Window.partitionBy("source_no", "group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    groups = totals.groupBy("source_no", "group").agg(F.sum("total").alias("all")).select("source_no", "group", F.coalesce(F.sum("all").over(of_groups), F.lit(0)).alias("group_start"))
    starts = totals.withColumn("within", F.coalesce(F.sum("total").over(of_buckets), F.lit(0))).join(groups, ["source_no", "group"])
    starts = starts.select("source_no", "bucket", (F.col("group_start") + F.col("within")).alias("bucket_start"))
    inside = Window.partitionBy("source_no", "bucket").orderBy(*KEYS).rowsBetween(Window.unboundedPreceding, -1)
    placed = entries.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["source_no", "bucket"])
    placed = placed.withColumn("start", F.col("bucket_start") + F.col("before"))
    block_of = lambda at: F.floor(at / block_words)
    pieces = placed.withColumn("block", F.explode(F.sequence(block_of(F.col("start")), block_of(F.col("start") + F.col("size") - 1))))
    place = F.greatest(F.col("start"), F.col("block") * block_words)
    pieces = written(
        pieces.withColumn("place", place).select(
            "source_no",
            "block",
            "place",
            *KEYS,
            (F.col("place") - F.col("start")).cast("int").alias("first"),
            (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.col("place")).alias("n_words"),
        ),
        "mix_pieces",
    )

    # Adaptive execution doesn't merge a stated number of partitions, however small their rows are.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (bounds["slots"] or 0) // TASK_SLOTS)
    counts = written(drawn_counts(sources, bounds["slots"] or 0, tasks, seed), "mix_counts")
    same_source = F.col("__source").eqNullSafe(F.col("__of"))
    numbers = targets.select(F.col("source").alias("__of"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    copy = F.row_number().over(Window.partitionBy("__id", "__text_hash").orderBy(F.lit(0))) - 1
    documents = keyed.join(numbers, same_source).drop("__of", "__source").withColumn("__part", copy)
    return Mix(documents, sources, pieces, counts, seed, tasks)


def drawn_counts(sources: DataFrame, all_slots: int, tasks: int, seed: int) -> DataFrame:
    """How many of its places each output shard gives to each source.

    ``sources`` has ``source_no``, ``blocks`` and ``slots``. All slots of all
    sources are tickets 0, 1, ...; ticket t is drawn at place ``permuted(t)``,
    and a shard holds the next ``SHARD_SLOTS`` places. ``first`` is the source's
    slots in the shards before: from totals of groups of shards, then of the
    shards of a group.
    """
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    tickets = sources.where("slots > 0").withColumn("ticket", F.coalesce(F.sum("slots").over(before), F.lit(0)))
    ranges = tickets.withColumn("range", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SLOT_RANGE))))
    ranges = ranges.repartition(tasks, "source_no", "range")
    k = F.explode(F.sequence(F.col("range") * SLOT_RANGE, F.least((F.col("range") + 1) * SLOT_RANGE, F.col("slots")) - 1))
    places = ranges.select("source_no", "blocks", "ticket", k.alias("k"))
    place = permuted(F.col("ticket") + F.col("k"), F.lit(all_slots).cast("long"), F.lit(seed), F.lit("shards"))
    drawn = places.withColumn("shard", F.floor(place / SHARD_SLOTS)).groupBy("shard", "source_no", "blocks").agg(F.count("*").alias("n"))
    drawn = drawn.withColumn("group", F.floor(F.col("shard") / SHARD_GROUP))
    of_groups = Window.partitionBy("source_no").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    of_shards = Window.partitionBy("source_no", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = written(drawn, "mix_draws")
    groups = drawn.groupBy("source_no", "group").agg(F.sum("n").alias("all")).select("source_no", "group", F.coalesce(F.sum("all").over(of_groups), F.lit(0)).alias("start"))
    within = drawn.withColumn("within", F.coalesce(F.sum("n").over(of_shards), F.lit(0)))
    return within.join(groups, ["source_no", "group"]).select("shard", "source_no", "blocks", "n", (F.col("start") + F.col("within")).alias("first"))
