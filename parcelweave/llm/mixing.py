"""Mixing sources to target weights: whole copies, then Pareto order sampling (Rosen, 1997).

Each source gets a target in words; a document's expected copies are its importance times its
source's ratio, but at most ``cap``, and the ratio is such that they add up to the target.  The whole
part is allocated for certain.  For the rest, documents are ranked by their random odds over their
inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``, and taken in this order; a document that does not
fit in what is left of the target is passed over, and the order is gone through to its end, so that
no document is left that would fit.  The sample's size is thus fixed in words.

A document's importance is that of ``importance_col``, or else grows with the logarithm of its
length, so that inclusion odds differ within a source.  It is rounded to an eighth of a doubling,
which leaves a source a few hundred levels to find its ratio by.

``u`` comes from the MD5 of seed and id, so that reruns and retried tasks agree.  The draw needs
no sorted source: words are summed over buckets of the rank, and only the bucket that holds the
first misfit is sorted; behind it, the same is done with the documents of sizes that still fit.  What
is left is one row for each source, which a narrow pass applies to the documents.

Edge cases: a null source is a source and comes last; null, empty and blank texts have size 0;
texts of any length are counted whole; a source without words has target 0; a null id draws by its
text; rows that repeat an id share its draw and stand or fall together; a document of importance 0,
null or less is never taken; an empty table gives an empty result; other columns are ignored or, by
``mix``, kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelweave.llm.common import carried, take, uncarried, words
from parcelweave.storage import materialize

#: Sources whose plan may be broadcast (about 200 bytes each).
MOST_BROADCAST = 100_000
#: Rows of the largest source expected in a bucket of the rank.
BUCKET_ROWS = 2_000
#: Draws of a source that may be gone through one by one to close the gap.
FEW = 2_000


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: int, source_col: str) -> DataFrame:
    """``sizes``, a row for each source with its ``source_size``, with ``target``: shares of the total by weight, capped and reshared.

    All uncapped sources end at one level per unit of weight.  In the order of the level at
    which each is capped, the level is that of the first source that it leaves uncapped.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("most", (F.col("source_size") * cap).cast("double"))
    by = Window.orderBy(F.col("most") / F.col("w"), F.col(source_col).asc_nulls_last())
    before = F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(Window.partitionBy()).cast("double") - before) / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", level).withColumn("place", F.row_number().over(by))
    found = F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct("place", "level"))).over(Window.partitionBy())
    return rows.withColumn("cut", found).select(*sizes.columns, F.when(F.col("place") < F.col("cut.place"), F.col("most")).otherwise(F.least(F.col("cut.level") * F.col("w"), F.col("most"))).alias("target"))


def _uniform(id_col: Column, text: Column, seed: int) -> Column:
    name = F.coalesce(id_col.cast("string"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _rank(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds; null for a document without a chance."""
    return F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))


def length_importance(size: Column) -> Column:
    """From 1 for a word, by a quarter for each doubling."""
    return 1 + F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) + 1e-9) / 4


def _sized(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` of ``_id``, ``_text``, ``_source`` and perhaps ``_given`` with size, draw and importance in place of text and what is given."""
    size = F.size(words(F.col("_text"))).cast("long")
    given = F.col("_given").cast("double") if "_given" in rows.columns else length_importance(size)
    level = F.when(given > 0, F.pow(F.lit(2.0), F.round(F.log2(given) * 8) / 8)).otherwise(F.lit(0.0))
    return rows.select(*[c for c in rows.columns if c not in ("_text", "_given")], size.alias("_size"), _uniform(F.col("_id"), F.col("_text"), seed).alias("_u"), F.coalesce(level, F.lit(0.0)).alias("_i"))


def ratios(levels: DataFrame, cap: int) -> DataFrame:
    """``(_source, ratio)`` from ``(_source, target, _i, _words)``: the ratio by which ``least(cap, ratio * _i)`` copies of the words make up the target.

    The levels that the cap holds are the largest; the ratio is that of the first level, from the
    largest on, which it does not hold.
    """
    by = Window.partitionBy("_source").orderBy(F.col("_i").desc())
    before = F.coalesce(F.sum("_words").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("_i") * F.col("_words")).over(by.rowsBetween(0, Window.unboundedFollowing))
    tried = levels.where("_i > 0 AND _words > 0").select("_source", "_i", ((F.col("target") - cap * before) / rest).alias("_r"))
    free = F.col("_r") * F.col("_i") <= cap * (1 + 1e-9)
    return tried.groupBy("_source").agg(F.coalesce(F.max_by(F.when(free, F.col("_r")), F.when(free, F.col("_i"))), cap / F.min("_i")).alias("ratio"))


def plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", importance_col: str | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and draws, and the plan: one row for each source.

    The plan has the source's size, target and ``ratio``, the runs of draws that are taken if
    their sizes fit (``_segments``: after a draw, before a draw, at most so many words), and the
    draws, of at most ``_gap`` words, that close what is left (``_close``).
    """
    names = {"_id": id_col, "_text": text_col, "_source": source_col} | ({"_given": importance_col} if importance_col else {})
    sized = materialize(_sized(take(docs, **names), seed), "sizes")
    levels = materialize(sized.groupBy("_source", "_i").agg(F.sum("_size").alias("_words"), F.count(F.lit(1)).alias("_n")), "levels")
    per = levels.groupBy("_source").agg(F.sum("_words").alias("source_size"), F.sum("_n").alias("_rows"))
    scaled = materialize(targets(per, weights, cap, "_source"), "goals")
    found = ratios(_with_plan(levels, scaled.select("_source", "target"), inner=True), cap)
    scaled = materialize(_with_plan(scaled, found).withColumn("ratio", F.coalesce("ratio", F.lit(0.0))), "targets")
    most = scaled.agg(F.max("_rows")).first()[0] or 1
    buckets = 1 << max(4, min(24, (most // BUCKET_ROWS).bit_length() + 1))

    chances = _with_plan(sized, scaled).select("_source", "_size", "target", "_u", "_id", F.least(F.lit(float(cap)), F.col("ratio") * F.col("_i")).alias("_e"))
    chances = chances.withColumn("_whole", F.floor("_e")).withColumn("_rank", _rank(F.col("_u"), F.col("_e") - F.floor("_e")))
    chances = chances.withColumn("_bucket", F.floor(F.col("_rank") / (1 + F.col("_rank")) * buckets))
    key = F.struct("_rank", "_u")
    room = chances.groupBy("_source").agg((F.first("target") - F.sum(F.col("_whole") * F.col("_size"))).alias("_left"))
    state = materialize(room.withColumn("_after", F.lit(None).cast("struct<_rank: double, _u: double>")).withColumn("_segments", F.array().cast("array<struct<after: struct<_rank: double, _u: double>, before: struct<_rank: double, _u: double>, most: double>>")), "room")
    rest = chances.where("_rank IS NOT NULL").select("_source", "_size", "_rank", "_u", "_bucket")
    while True:
        # in order while all fit; then past the draw that does not, among those of sizes that still fit
        found = _first_misfit(rest, state.select("_source", "_left"))
        segment = F.struct(F.col("_after").alias("after"), F.col("_before").alias("before"), F.when(F.col("_after").isNotNull(), F.col("_left")).alias("most"))
        going = F.col("_after").isNotNull() | (F.size("_segments") == 0)
        state = _with_plan(state, found).select("_source", (F.col("_left") - F.coalesce("_filled", F.lit(0))).alias("_left"), F.col("_before").alias("_after"), F.when(going, F.concat("_segments", F.array(segment))).otherwise(F.col("_segments")).alias("_segments"))
        state = materialize(state, "segments")
        open_ = state.where("_after IS NOT NULL").select("_source", "_left", "_after")
        rest = materialize(_with_plan(rest, open_, inner=True).where(F.col("_size").between(1, F.col("_left")) & (key > F.col("_after"))).select("_source", "_size", "_rank", "_u", "_bucket"), "rest")
        if (rest.groupBy("_source").count().agg(F.max("count")).first()[0] or 0) <= FEW:
            break
    # where few are left, one by one
    listed = rest.groupBy("_source", "_rank", "_u").agg(F.sum("_size").alias("_size")).groupBy("_source").agg(F.sort_array(F.collect_list(F.struct("_rank", "_u", "_size"))).alias("_offers"))
    offered = _with_plan(listed, open_, inner=True)
    none = F.struct(F.col("_left").alias("gap"), F.slice(F.transform("_offers", lambda x: F.struct(x["_rank"].alias("_rank"), x["_u"].alias("_u"))), 1, 0).alias("keys"))
    fits = F.aggregate("_offers", none, lambda s, x: F.when(x["_size"] <= s["gap"], F.struct((s["gap"] - x["_size"]).alias("gap"), F.concat(s["keys"], F.array(F.struct(x["_rank"].alias("_rank"), x["_u"].alias("_u")))).alias("keys"))).otherwise(s), lambda s: s["keys"])
    close = offered.select("_source", F.col("_left").alias("_gap"), fits.alias("_close"))
    made = scaled.alias("s").join(state.alias("c"), F.col("s._source").eqNullSafe(F.col("c._source")), "left").join(close.alias("d"), F.col("s._source").eqNullSafe(F.col("d._source")), "left")
    return sized, materialize(made.select("s._source", "source_size", "target", "ratio", "_segments", "_gap", "_close"), "plan")


def _first_misfit(rows: DataFrame, room: DataFrame) -> DataFrame:
    """``(_source, _before, _filled)``: in order of the draws, the first that exceeds what is left, and the words of those before it.

    Sources whose draws all fit have no row.  Only the bucket in which the words exceed it is sorted.
    """
    ordered = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = _with_plan(rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_words")), room, inner=True)
    sums = sums.withColumn("_upto", F.sum("_words").over(ordered)).where("_upto > _left")
    edge = sums.groupBy("_source").agg(F.min_by(F.struct(F.col("_bucket").alias("_at"), (F.col("_upto") - F.col("_words")).alias("_base"), "_left"), "_bucket").alias("_edge")).select("_source", "_edge.*")
    inside = _with_plan(rows, materialize(edge, "edges"), inner=True).where(F.col("_bucket") == F.col("_at")).select("_source", "_left", "_base", "_rank", "_u", "_size")
    inside = inside.groupBy("_source", "_left", "_base", "_rank", "_u").agg(F.sum("_size").alias("_size"))
    inside = inside.withColumn("_upto", F.col("_base") + F.sum("_size").over(Window.partitionBy("_source").orderBy("_rank", "_u")))
    found = inside.groupBy("_source").agg(F.min(F.when(F.col("_upto") > F.col("_left"), F.struct("_rank", "_u"))).alias("_before"), F.coalesce(F.max(F.when(F.col("_upto") <= F.col("_left"), F.col("_upto"))), F.first("_base")).alias("_filled"))
    return materialize(found, "misfits")


def _with_plan(rows: DataFrame, per_source: DataFrame, inner: bool = False) -> DataFrame:
    """Rows with their source's row; broadcast behind a check of its size."""
    small = per_source.withColumnRenamed("_source", "_s")
    if per_source.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        small = F.broadcast(small)
    return rows.join(small, rows["_source"].eqNullSafe(small["_s"]), "inner" if inner else "left").drop("_s")


def _copies(cap: int) -> Column:
    e = F.least(F.lit(float(cap)), F.col("ratio") * F.col("_i"))
    rank = _rank(F.col("_u"), e - F.floor(e))
    mine = F.struct(rank.alias("_rank"), F.col("_u").alias("_u"))
    first = F.col("_segments")[0]
    # sizes matter only behind the first draw that did not fit
    later = F.exists("_segments", lambda x: (mine > x["after"]) & (x["before"].isNull() | (mine < x["before"])) & F.col("_size").between(1, x["most"]))
    close = (F.col("_size").between(1, F.col("_gap"))) & F.array_contains("_close", mine)
    drawn = rank.isNotNull() & (first["before"].isNull() | (mine < first["before"]) | F.coalesce(later, F.lit(False)) | F.coalesce(close, F.lit(False)))
    return (F.floor(e) + drawn.cast("int")).cast("long")


def taken(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", importance_col: str | None = None, seed: int = 7) -> DataFrame:
    """``(id_col, size, source_size, target, taken)``, one row for each row of ``docs``."""
    sized, sources = plan(docs, weights, cap, id_col, text_col, source_col, importance_col, seed)
    return _with_plan(sized, sources).select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * _copies(cap)).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", importance_col: str | None = None, seed: int = 7) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as it is taken.  No row's text is shuffled."""
    _, sources = plan(docs, weights, cap, id_col, text_col, source_col, importance_col, seed)
    names = {"_id": id_col, "_text": text_col, "_source": source_col} | ({"_given": importance_col} if importance_col else {})
    drawn = _sized(carried(docs, **names), seed)
    counted = _with_plan(drawn, sources).withColumn("_copies", _copies(cap).cast("int")).where("_copies > 0")
    return uncarried(counted.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))), docs)
