"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key; documents are range-sorted by source and key; distributed prefix
sums of word counts place each one on its source's axis, and the budget is cut there exactly: whole
epochs first, then the documents before the cut once more, the document at the cut in part.

Targets: weights 1, 2, 3, repeating over the sources in code point order (null last), share all words;
no target exceeds ``most`` times its source, and what is over is shared again by weight.

Defined cases: a null text has size 0 and is never taken; a source without words has target 0; repeated
rows count each; equal keys go by id; an empty table gives an empty plan; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import SPACE, Scratch, fits, fresh, slice_offsets, sorted_slices, word_count

MOST_EPOCHS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Targets for rows (_null, _source, source_size), one per source.

    Sources are filled in order of cap over weight; one is capped if the level its predecessors leave
    would lift it above its cap, and the last level is shared by the rest.
    """
    by_name = Window.orderBy("_null", "_source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    sized = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    sized = sized.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = Window.orderBy(F.col("_cap") / F.col("_w"), "_null", "_source").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    sized = sized.withColumns({"_all": F.sum("source_size").over(everything), "_weights": F.sum("_w").over(everything)})
    left = F.col("_all") - F.coalesce(F.sum("_cap").over(filled), zero)
    over = F.col("_weights") - F.coalesce(F.sum("_w").over(filled), zero)
    sized = sized.withColumn("_capped", left * F.col("_w") > F.col("_cap") * over)
    level = (F.col("_all") - F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(zero)).over(everything)) / F.sum(
        F.when(F.col("_capped"), zero).otherwise(F.col("_w"))
    ).over(everything)
    target = F.when(F.col("_capped") | (F.col("_cap") == 0), F.col("_cap")).otherwise(F.least(level * F.col("_w"), F.col("_cap")))
    return sized.select("_null", "_source", "source_size", target.alias("target"))


def random_key(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("null"))))


def plan_mix(
    docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_EPOCHS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``, ``epochs``, ``part`` and ``taken``.

    ``epochs`` whole copies and then the first ``part`` words are taken: ``taken`` words in all.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    narrow = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).isNull().alias("_null"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"),
        word_count(F.col(text_col)).alias("size"), random_key(F.col(id_col), seed).alias("_key"),
    )
    narrow = scratch.save(narrow, "narrow")
    ranked = sorted_slices(narrow, [F.col(c) for c in ("_null", "_source", "_key", "_id")], scratch, "ranked")
    scratch.drop("narrow")
    source = ["_null", "_source"]
    goals = targets(ranked.groupBy(*source).agg(F.sum("size").alias("source_size")), weights, most)
    offsets = slice_offsets(ranked, F.col("size"), source).join(goals, source)
    running = Window.partitionBy("slice", *source).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.withColumn("_before", F.coalesce(F.sum("size").over(running), F.lit(0))).join(offsets, ["slice", *source])
    budget = F.least(F.round("target").cast("long"), F.col("source_size") * most)
    placed = placed.withColumn("_budget", budget)
    placed = placed.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0)).cast("long"))
    cut = F.col("_budget") - F.col("epochs") * F.col("source_size") - F.col("_offset") - F.col("_before")
    placed = placed.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), cut)).cast("long"))
    return placed.select(
        F.col("_id").alias(id_col), "size", "source_size", "target", "epochs", "part",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
    )


def mix(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of a plan, each as often as it is taken.

    A document taken in part keeps its first words, joined by one blank. Rows that share an id take the
    plan's rows of that id one by one, in the order of their sizes.
    """
    columns = docs.columns
    own = {c: fresh(columns, f"_{c}") for c in ("epochs", "part", "size", "k", "n")}
    taken = plan.filter("taken > 0").select(F.col(id_col), *(F.col(c).alias(own[c]) for c in ("epochs", "part", "size")))
    again = Scratch(docs.sparkSession, "mix").save(plan.groupBy(id_col).agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1").select(id_col), "again")
    if again.isEmpty():
        met = docs.join(taken, id_col)
    else:
        size, every = F.col(own["size"]), plan.select(F.col(id_col), *(F.col(c).alias(own[c]) for c in ("epochs", "part", "size")))
        few = F.broadcast(again) if fits(again) else again
        rows = docs.join(few, id_col, "left_semi").withColumn(own["size"], word_count(F.col(text_col)))
        rows = rows.withColumn(own["k"], F.row_number().over(Window.partitionBy(id_col).orderBy(size, F.xxhash64(text_col)))).drop(own["size"])
        every = every.join(few, id_col, "left_semi")
        every = every.withColumn(own["k"], F.row_number().over(Window.partitionBy(id_col).orderBy(size, F.desc(own["epochs"]), F.desc(own["part"]))))
        twice = rows.join(every, [id_col, own["k"]]).drop(own["k"])
        met = docs.join(few, id_col, "left_anti").join(taken, id_col).unionByName(twice)
    n, words = F.col(own["n"]), F.filter(F.split(text_col, SPACE), lambda w: w != "")
    cut = F.when(n == F.col(own["size"]), F.col(text_col)).otherwise(F.array_join(F.slice(words, 1, n.cast("int")), " "))
    whole = F.array_repeat(F.col(own["size"]), F.col(own["epochs"]).cast("int"))
    last = F.when(F.col(own["part"]) > 0, F.array(own["part"])).otherwise(F.array().cast("array<bigint>"))
    copies = met.withColumn(own["n"], F.explode(F.concat(whole, last))).filter(n > 0)
    return copies.withColumn(text_col, cut).select(*columns)
