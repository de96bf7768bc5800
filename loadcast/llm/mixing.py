"""Mixing sources to target weights by a curriculum whose weights change over training time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, WORD, cut, ranked, small

#: Relative weight of a source over training time, for its weight class: (time, factor) with times from 0 to 1.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
#: Cells of the hash range, as bits, and the orders of its documents that a source may choose from.
CELL_BITS, ORDERS = 12, 8
#: Bytes of the lines of all sources that are broadcast at most.
SOURCE_BYTES = BROADCAST_BYTES
OWN = ("size", "source_size", "target", "copies", "positions")


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def curriculum(
    docs: DataFrame,
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    most: float = 3.0,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    seed: int = 9,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Adds to every document ``size``, ``source_size``, ``target``, ``copies`` and ``positions``.

    Sources in code point order (null last) take the weights in turn and share the words of all documents by
    them. A target stops at ``most`` times the words of its source, and what is left over is shared again by
    weight. Documents of a source lie in hash order on a line of its words; the target is met by whole rounds
    over the line and one partial round, so a document is taken ``floor(target / source_size)`` times or once
    more. Each copy has a place on the source's cumulative demand; with the source's weight schedule
    integrated over training time, inverting the demand at that place gives its training position in [0, 1].

    A document's place is the start of its cell of the hash range, exact, plus its share of the cell, so rows
    need no sort and no shuffle: only sums per (source, cell) are gathered, and a source with most of all rows
    is spread over its cells. Of ``ORDERS`` hash orders a source takes that in which some first part comes
    nearest to what its last, partial round needs; its taken words miss the target by part of a document or of a cell.

    Null text has size 0, null source is a source of its own (the last). Repeated rows and equal ids share
    their hash and so their copies. Rows of a source without words have target 0, no copies and empty
    positions. An empty table gives no rows. Extra columns are kept, whatever their names, but those named like the new
    ones are replaced.
    """
    kept = {f"c{i}": c for i, c in enumerate(docs.columns) if c not in OWN}
    # Columns go by numbers until the end, so none can be named like a helper.
    plain = docs.select(
        *[F.col(f"`{c}`").alias(n) for n, c in kept.items()],
        word_count(F.col(f"`{text_col}`")).alias("size"),
        F.col(f"`{source_col}`").alias("_source"),
        F.col(f"`{id_col}`").alias("_id"),
    )
    orders = F.array(*[F.lit(seed * 1000 + i) for i in range(ORDERS)])
    spread = plain.select("_source", "size", "_id", F.explode(orders).alias("_order"))
    cells = cut(
        spread.groupBy("_source", "_order", _cell(F.xxhash64("_order", "_id")).alias("_cell")).agg(
            F.sum("size").alias("_words")
        )
    )
    targets = cut(_targets(cells.where(F.col("_order") == seed * 1000), weights, most))
    line = Window.partitionBy("_source", "_order").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("_start", F.coalesce(F.sum("_words").over(line), F.lit(0)))
    whole = F.col("source_size")
    rounds = F.when(whole > 0, F.floor(F.col("target") / whole)).otherwise(0).cast("int")
    t = targets.withColumn("_rounds", rounds).alias("t")
    placed = starts.alias("c").join(t, F.col("c._source").eqNullSafe(F.col("t._source"))).drop(F.col("t._source"))
    need = F.col("target") - F.col("_rounds") * whole
    # The end of a part is the start of a cell; cells of several documents may be cut inside, so they miss by less.
    miss = F.min(F.least(F.abs(need - F.col("_start")), F.abs(need - F.col("_start") - F.col("_words"))))
    by_order = placed.groupBy("_source", "_order", "source_size", "target", "_class", "_rounds").agg(miss.alias("_miss"))
    best = by_order.groupBy("_source", "source_size", "target", "_class", "_rounds").agg(F.min(F.struct("_miss", "_order")).alias("_best"))
    chosen = cut(best.select("*", F.col("_best._order").alias("_order")).drop("_best"))
    o = chosen.select("_source", "_order").alias("o")
    mine = starts.alias("q").join(
        o, F.col("q._source").eqNullSafe(F.col("o._source")) & (F.col("q._order") == F.col("o._order")), "left_semi"
    )
    rows = _looked_up(plain, chosen, mine)
    size = F.col("size")
    middle = F.col("_start") + F.col("_share") * (F.col("_words") - size) + size / 2
    with_place = rows.select(*kept, "size", "source_size", "target", "_class", "_rounds", middle.alias("_middle"))
    extra = F.col("_middle") < F.col("target") - F.col("_rounds") * whole
    copies = F.when(F.col("target") > 0, F.col("_rounds") + extra.cast("int")).otherwise(0).alias("copies")
    taken = with_place.select("*", copies)
    at = F.transform(
        F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: _time(F.least((k * whole + F.col("_middle")) / F.col("target"), F.lit(1.0)), F.col("_class"), schedules),
    )
    # Names come back in a step of their own: inside a lambda, an alias given beside it would go before the column.
    placed = taken.select(*kept, "size", "source_size", "target", "copies", at.alias("positions"))
    return placed.select(*[F.col(n).alias(c) for n, c in kept.items()], *OWN)


def _looked_up(rows: DataFrame, chosen: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows with what is known of their source, their share of their cell, and the cell's start and words.

    A source is one row with the starts of all its cells as an array (33 kB), broadcast while the counted bytes of all
    sources are within ``SOURCE_BYTES``. With more sources, rows are joined by source and cell in a shuffle.
    """
    n, names = chosen.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col("_source").cast("string")))).first()
    lines = n * ((1 << CELL_BITS) + 1) * 8 + (names or 0)
    h = F.xxhash64("o._order", "d._id")
    share = (h.bitwiseAND(F.lit(_REST)) / F.lit(float(_REST + 1))).alias("_share")
    same = F.col("d._source").eqNullSafe(F.col("o._source"))
    known = [F.col(f"o.{c}") for c in ("source_size", "target", "_class", "_rounds")]
    if lines > SOURCE_BYTES:
        cell = rows.alias("d").join(small(chosen, n, BROADCAST_ROWS).alias("o"), same).select("d.*", *known, _cell(h).alias("_cell"), share)
        mine = F.col("r._source").eqNullSafe(F.col("p._source")) & (F.col("r._cell") == F.col("p._cell"))
        return cell.alias("r").join(cells.alias("p"), mine).select("r.*", "p._start", "p._words")
    grid = chosen.select("_source", F.explode(F.sequence(F.lit(0), F.lit((1 << CELL_BITS) - 1))).alias("_cell"))
    there = F.col("g._source").eqNullSafe(F.col("w._source")) & (F.col("g._cell") == F.col("w._cell"))
    filled = grid.alias("g").join(cells.alias("w"), there, "left").select("g._source", "g._cell", F.coalesce("w._words", F.lit(0)).alias("_words"))
    before = Window.partitionBy("_source").orderBy("_cell")
    ends = filled.select("_source", F.struct("_cell", F.sum("_words").over(before).alias("_end")).alias("_at"))
    line = ends.groupBy("_source").agg(F.sort_array(F.collect_list("_at"))["_end"].alias("_ends")).alias("l")
    sources = chosen.alias("s").join(line, F.col("s._source").eqNullSafe(F.col("l._source"))).select("s.*", F.concat(F.array(F.lit(0)), "l._ends").alias("_starts"))
    start, end = F.get("o._starts", _cell(h)), F.get("o._starts", _cell(h) + 1)
    return rows.alias("d").join(F.broadcast(cut(sources)).alias("o"), same).select("d.*", *known, share, start.alias("_start"), (end - start).alias("_words"))


_REST = (1 << (64 - CELL_BITS)) - 1


def _cell(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - CELL_BITS).cast("int")


def in_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per copy, sorted over ranges of ``position``: the training order. Not taken rows are gone."""
    exploded = mixed.withColumn("position", F.explode("positions"))
    return exploded.repartitionByRange("position", id_col).sortWithinPartitions("position", id_col)


def _targets(cells: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """Words and target of each source; only sums over the sources reach the driver."""
    sizes = cells.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    sources = ranked(sizes, [F.col("_source").asc_nulls_last()], "_rank")
    turn = F.pmod("_rank", F.lit(len(weights))).cast("int")
    weighed = cut(
        sources.select(
            "_source",
            "source_size",
            turn.alias("_class"),
            F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1).alias("_weight"),
            (F.col("source_size") * F.lit(float(most))).alias("_most"),
        )
    )
    level = None
    stopped = F.lit(False)
    while True:
        s = weighed.agg(
            F.sum("source_size"),
            F.sum(F.when(stopped, F.col("_most"))),
            F.sum(F.when(~stopped, F.col("_weight"))),
        ).first()
        all_words, at_most, free = float(s[0] or 0), float(s[1] or 0), float(s[2] or 0)
        new = (all_words - at_most) / free if free else level or 0.0
        if new == level or not free:
            break
        level = new
        stopped = F.col("_weight") * F.lit(level) > F.col("_most")
    target = F.least(F.col("_weight") * F.lit(level or 0.0), F.col("_most"))
    return weighed.select("_source", "source_size", "_class", target.alias("target"))


def _time(done: Column, kind: Column, schedules: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """The training time at which the integrated schedule has delivered this part of a source's demand."""
    out = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        parts, total = [], 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            parts.append((total, t0, w0, (w1 - w0) / (t1 - t0)))
            total += (w0 + w1) / 2 * (t1 - t0)
        demand = done * F.lit(total)
        here = F.lit(None).cast("double")
        for before, t0, w0, slope in parts:
            due = F.greatest(demand - F.lit(before), F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * due, F.lit(0.0)))
            when = F.lit(t0) + F.when(due > 0, 2 * due / (F.lit(w0) + root)).otherwise(0.0)
            here = when if before == 0.0 else F.when(demand >= F.lit(before), when).otherwise(here)
        out = here if i == 0 else F.when(kind % len(schedules) == i, here).otherwise(out)
    return F.least(out, F.lit(1.0))
