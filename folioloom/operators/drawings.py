"""Drawings from paths: boxes that follow each other and lie near what has been drawn so far, without anything else in between."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

#: Points within which boxes are near, the share of a page beyond which a box is background, least sides of a drawing and of a lone path, and least density.
NEAR, BACKGROUND, LEAST_SIDE, LEAST_LONE, DENSITY = 6.0, 0.15, 4.0, 10.0, 0.2


def breaks(paths: DataFrame, foreign: DataFrame, marks: DataFrame, by: list[str]) -> DataFrame:
    """``paths`` with cut: something else is drawn between the path before it and it, or a matrix is set there at an outer level.

    paths: ``(<by>, seq, depth, start, end, ..)``; foreign: ``(<by>, at)``; marks as in ``intervals``. A matrix at a depth below the path's own cuts.
    """
    rows = paths.withColumn("depth", F.col("depth").cast("long"))
    before = F.lag("end").over(W.partitionBy(*by).orderBy("seq")).cast("long")
    rows = rows.select("*", F.col("start").cast("long").alias("at"), F.lit("path").alias("op"), before.alias("past"))
    others = foreign.select(*by, "at", F.lit("foreign").alias("op")).unionByName(marks.select(*by, "at", "op"))
    return broken(rows.unionByName(others.withColumn("at", F.col("at").cast("long")), allowMissingColumns=True), by)


def _breaker(n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, level, foreign, matrices = None, 0, None, {}
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(n_keys))))
            ats, ops, pasts = (batch.column(n_keys + k).to_pylist() for k in range(3))
            depths = batch.column(batch.schema.get_field_index("depth")).to_pylist()
            rows, cut = [], []
            for k, own in enumerate(keys):
                if own != page:
                    page, level, foreign, matrices = own, 0, None, {}
                op = ops[k]
                if op == "path":
                    past = pasts[k]
                    rows.append(k)
                    cut.append(past is not None and past < ats[k] and (foreign is not None and foreign >= past or any(at >= past for outer, at in matrices.items() if outer < depths[k])))
                elif op == "foreign":
                    foreign = ats[k]
                elif op == "open":
                    level += 1
                elif op == "close":
                    level = max(level - 1, 0)
                elif op == "matrix":
                    matrices[level] = ats[k]
            paths = batch.take(pa.array(rows, pa.int64()))
            kept = [k for k in range(batch.num_columns) if not n_keys <= k < n_keys + 3]
            yield pa.RecordBatch.from_arrays([*(paths.column(k) for k in kept), pa.array(cut, pa.bool_())], names=[*(batch.schema.names[k] for k in kept), "cut"])

    return run


def broken(events: DataFrame, by: list[str]) -> DataFrame:
    """The paths of ``events (<by>, at, op, past, depth, <columns of paths>)`` with cut, as ``breaks`` has it: page by page, in order of their starts.

    op: path (at: its start, past: the end of the path before it, null for the first), foreign, or a mark's; all but paths have nulls for what paths alone have. A page's events are
    dealt once and pass in order; what is held is the last place of something foreign, and of a matrix at each level.
    """
    head = [*by, "at", "op", "past"]
    rows = events.select(*head, *(c for c in events.columns if c not in head)).repartition(*by).sortWithinPartitions(*by, "at", F.col("op") != "path")
    return rows.mapInArrow(_breaker(len(by)), StructType([f for f in rows.schema if f.name not in ("at", "op", "past")]).add("cut", BooleanType()))


def _grower(n_keys: int, page_area: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, n, last, box = None, 0, None, None
        for batch in batches:
            cols, out = {f: batch.column(k).to_pylist() for k, f in enumerate(batch.schema.names)}, []
            keys = list(zip(*(cols[f] for f in batch.schema.names[:n_keys])))
            for k, own in enumerate(keys):
                seq, depth, cut = cols["seq"][k], cols["depth"][k], cols["cut"][k]
                x0, y0, x1, y1 = (cols[c][k] for c in ("x0", "y0", "x1", "y1"))
                if own != page:
                    page, n, last = own, 0, None
                if (x1 - x0) * (y1 - y0) / page_area > BACKGROUND:
                    last = None
                    out.append(None)
                    continue
                goes_on = last == (seq - 1, depth) and not cut and x0 - NEAR <= box[2] and box[0] - NEAR <= x1 and y0 - NEAR <= box[3] and box[1] - NEAR <= y1
                if goes_on:
                    box = (min(box[0], x0), min(box[1], y0), max(box[2], x1), max(box[3], y1))
                else:
                    n, box = n + 1, (x0, y0, x1, y1)
                last = (seq, depth)
                out.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "drawing"])

    return run


def grown(paths: DataFrame, by: list[str], page_area: float, in_order: bool = False) -> DataFrame:
    """``paths (<by>, seq, depth, start, end, x0, y0, x1, y1, cut)`` with drawing, a number from 1 on each page; null for background, which also ends a drawing.

    A path goes on with the one before it in seq if depths agree, nothing cuts and its box is within 6 points of the box of all before it. A page's paths pass in order; what is held is one box.
    in_order: each page's paths stand in one task in order of seq already, as ``broken`` leaves them if seq rises with start.
    """
    kept = [*by, "seq", "depth", "start", "end", "x0", "y0", "x1", "y1", "cut"]
    rows = paths.select(kept) if in_order else paths.select(kept).repartition(*by).sortWithinPartitions(*by, "seq")
    return rows.mapInArrow(_grower(len(by), max(1.0, page_area)), StructType([*rows.schema.fields]).add("drawing", LongType()))


def drawings(paths: DataFrame, by: list[str], page_area: float, in_order: bool = False) -> DataFrame:
    """``(<by>, drawing, n, start, end, x0, y0, x1, y1, density, rank)`` of the drawings of ``grown`` that are large, small and dense enough.

    density: area of all boxes by that of the whole; rank: from the largest on a page to the smallest, then by start.
    """
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    rows = grown(paths, by, page_area, in_order).where("drawing is not null").groupBy(*by, "drawing").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"), *box, F.sum(area).alias("drawn"))
    least = F.when(F.col("n") > 1, LEAST_SIDE).otherwise(LEAST_LONE)
    rows = rows.withColumn("density", F.col("drawn") / F.greatest(area, F.lit(1e-6)))
    rows = rows.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least) & (area / max(1.0, page_area) <= BACKGROUND) & (F.col("density") >= DENSITY))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(area.desc(), "start")).cast("long")).drop("drawn")
