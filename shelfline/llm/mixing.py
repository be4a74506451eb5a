"""Mixing sources to target weights, with DataFrame functions only.

Documents get hash-random keys and are summed in key order within their source, range by range.  Each
source is cut at its budget: whole epochs first, then the documents up to the remaining words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import WORD, free_names, running_sum, stored, text_of

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def budgets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """``source, source_size, target`` for rows of ``source, size``: one row per source.

    Sources in code point order (null last) weigh ``weights`` in turn and share the sum of all sizes.
    A target stops at ``epochs`` times its source; the excess goes to the others by weight.  The level
    at which that ends is found in closed form: sources are sorted by cap / weight, and the first
    whose cap is above its share of what is left sets the level for all after it.  The windows
    without partition see one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(turn - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("_turn", turn).withColumn("_w", weight).withColumn("_cap", F.lit(epochs) * F.col("source_size"))
    per = per.withColumn("_total", F.sum("source_size").over(every)).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", "_turn")
    gone = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("_level", (F.col("_total") - gone) / left)
    per = per.withColumn("_full", F.col("_ratio") <= F.col("_level"))
    level = F.min(F.when(~F.col("_full"), F.struct("_ratio", "_turn", "_level"))).over(every)["_level"]
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(level * F.col("_w"))
    return per.select("source", "source_size", target.alias("target"))


def mix(documents: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, copies`` and ``text_key``.

    ``copies`` is how often the mix repeats the document, ``taken`` the words that makes.  Documents
    are taken whole, so a source misses its target by half a document at most: the document at the
    border is in if at least half of it fits.  Nulls: a null text has size 0, null sources are one
    source, null ids are allowed.  Documents without words take 0 words and are repeated like their
    neighbours.  Repeated rows are separate documents.  An empty table gives no rows.  Extra columns
    are ignored.
    """
    text = text_of(documents)
    slim = documents.select(
        documents["doc_id"].cast("long").alias("doc_id"),
        documents["source"].cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(documents["doc_id"].cast("string"), F.lit("")), text)).alias("_key"),
        _text_key(documents).alias("text_key"),
        F.when(documents["source"].isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), documents["source"])).alias("_group"),
    )
    slim = stored(slim, "mix-sizes")
    goal = budgets(slim, weights, epochs)
    goal = goal.withColumn("_group", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), "source")))
    placed = running_sum(slim, "_group", "_key", ["size"], "size", goal.drop("source"))
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0))
    placed = placed.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    more = (F.col("_rest") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("_rest"))
    copies = (F.col("_whole") + more.cast("long")).cast("long")
    return placed.withColumn("copies", copies).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "text_key", "source"
    )


def _text_key(documents: DataFrame) -> Column:
    """64 bits of id, text and source: rows of one id are told apart by text, and by source."""
    return F.xxhash64(documents["doc_id"], documents["text"], documents["source"].isNull(), documents["source"])


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns, a row for each copy.

    Rows of one id and text under several sources are documents of their own.  Rows that agree in id,
    text and source are counted together and stand for each other, the one whose further columns hash
    least; ``copies`` bounds the rows that come of a document.  Null ids, texts and sources are values like
    others, texts are joined whole, and an empty table gives no rows.
    """
    key, copies, one, pick = free_names(documents, "text_key", "copies", "copy", "pick")
    ident = free_names(documents, "mix_id")[0]
    counts = mix(documents, **options).groupBy("doc_id", "text_key").agg(F.sum("copies").alias("copies"))
    counts = counts.where("copies > 0").select(
        F.coalesce(F.col("doc_id"), F.lit(-1)).alias(ident), F.col("text_key").alias(key), F.col("copies").alias(copies)
    )
    named = documents.withColumn(ident, F.coalesce(documents["doc_id"].cast("long"), F.lit(-1)))
    named = named.withColumn(key, _text_key(documents))
    rest = [documents[c] for c in documents.columns if c not in ("doc_id", "text", "source")]
    named = named.withColumn(pick, F.xxhash64(*rest) if rest else F.lit(0))
    # rows that repeat combine before the shuffle, which the join shares
    chosen = named.groupBy(ident, key).agg(F.min_by(F.struct(*documents.columns), pick).alias(pick))
    chosen = chosen.join(counts, [ident, key]).select(f"{pick}.*", copies)
    return chosen.withColumn(one, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*documents.columns)


def oracle(weights: Sequence[int] = WEIGHTS, epochs: int = MOST_EPOCHS, seed: str = "mix") -> str:
    """The SQL twin of ``mix`` without ``copies``."""
    n = len(weights)
    turns = " ".join(f"when {i} then {w}" for i, w in enumerate(weights))
    return rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('{seed}|' || coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')) as k
  from documents
), s as (select source, sum(size)::bigint as source_size from d group by source),
w as (
  select *, case (row_number() over (order by source nulls last) - 1) % {n} {turns} end as w,
         row_number() over (order by source nulls last) as turn, sum(source_size) over () as total
  from s
), l as (
  select *, {epochs} * source_size as cap, {epochs} * source_size::double / w as ratio,
    (total - coalesce(sum({epochs} * source_size) over (order by {epochs} * source_size::double / w, turn
       rows between unbounded preceding and 1 preceding), 0))::double
    / sum(w) over (order by {epochs} * source_size::double / w, turn rows between current row and unbounded following) as level
  from w
), first as (select level from l where ratio > level order by ratio, turn limit 1),
t as (
  select source, source_size, case when ratio <= level then cap::double else (select level from first) * w end as target from l
), p as (
  select d.doc_id, d.size, t.source_size, t.target,
    case when t.source_size > 0 then least({epochs}, floor(t.target / t.source_size)) else 0 end as whole,
    coalesce(sum(d.size) over (partition by d.source order by d.k, d.size rows between unbounded preceding and 1 preceding), 0) as before
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  (size * (whole + case when target - whole * source_size > 0 and before + size / 2.0 <= target - whole * source_size
                        then 1 else 0 end))::bigint as taken
from p
"""
