"""Contact sheets: frames of 8-bit luma, each fitted into a cell of a grid, as one picture a sheet.

A frame is made smaller (never larger) with its shape kept, put in the middle of its cell, and marked with its number on
the sheet and its time. Frames shrink where they are read, so that only cells are shuffled; sheets hold at most `most`
frames, which bounds a group: a video of more frames has several sheets.

Defined cases: frames are ordered by ts, then frame_id; one without luma, or with one that its size belies, is an empty
cell and counts in `missing`; one without a time is left out; repeated rows stand once; no frames give no sheet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.frames import resize

#: Grey of the ground, of borders, of a label's backing and of its letters; the backing's place in a cell.
GROUND, BORDER, BACKING, LETTERS = 245, 180, 0, 255
BACK_TOP, BACK_LEFT, BACK_BOTTOM, BACK_RIGHT = 2, 2, 19, 93
MIN_CELL = 64
#: Letters of labels, three samples wide and five high, drawn at twice the size.
GLYPHS = {
    "0": "### #.# #.# #.# ###", "1": ".#. ##. .#. .#. ###", "2": "### ..# ### #.. ###", "3": "### ..# ### ..# ###", "4": "#.# #.# ### ..# ..#",
    "5": "### #.. ### ..# ###", "6": "### #.. ### #.# ###", "7": "### ..# ..# ..# ..#", "8": "### #.# ### #.# ###", "9": "### #.# ### ..# ###",
    ":": "... .#. ... .#. ...", " ": "... ... ... ... ...",
}
TILE = "video long, frame_id long, ts double, tile_width int, tile_height int, tile binary"
SHEET = "video long, sheet long, width int, height int, n_frames int, missing int, first_ts double, last_ts double, luma binary"


def fitted(width: int, height: int, cell: int) -> tuple[int, int]:
    """The size of a picture made to fit into a cell: the longer side becomes the cell's if it is larger, the other follows, rounded, at least 1."""
    longer = max(width, height)
    if longer <= cell:
        return width, height
    return tuple(max(1, (2 * side * cell + longer) // (2 * longer)) for side in (width, height))


def label_of(number: int, ts: float) -> str:
    seconds = int(ts)
    return f"{number} {seconds // 60:02d}:{seconds % 60:02d}"


def stamp(cell: np.ndarray, label: str) -> None:
    """The backing and the label; what does not fit into the cell is cut off."""
    cell[BACK_TOP:BACK_BOTTOM, BACK_LEFT:BACK_RIGHT] = BACKING
    for i, c in enumerate(label):
        glyph = np.array([[x == "#" for x in row] for row in GLYPHS[c].split()]).repeat(2, 0).repeat(2, 1)
        top, left = BACK_TOP + 3, BACK_LEFT + 3 + 8 * i
        part = cell[top : top + 10, left : min(left + 6, BACK_RIGHT)]
        part[glyph[: part.shape[0], : part.shape[1]]] = LETTERS


def pasted(cells: list[tuple[int, float, int, int, bytes | None]], columns: int, cell: int) -> np.ndarray:
    """The sheet of (place, ts, width, height, tile) in order of their places."""
    rows = -(-len(cells) // columns)
    sheet = np.full((rows * cell, columns * cell), GROUND, np.uint8)
    for i, (_, ts, w, h, tile) in enumerate(cells):
        at = sheet[i // columns * cell :, i % columns * cell :][:cell, :cell]
        if tile is not None:
            y, x = (cell - h) // 2, (cell - w) // 2
            at[y : y + h, x : x + w] = np.frombuffer(tile, np.uint8).reshape(h, w)
        stamp(at, label_of(i + 1, ts))
        at[[0, -1], :] = BORDER
        at[:, [0, -1]] = BORDER
    return sheet


def tiles(frames: DataFrame, cell: int) -> DataFrame:
    """frames (video, frame_id, ts, width, height, luma), each made to fit into a cell; tile is null where there is no whole picture."""

    def run(batches):
        for batch in batches:
            out = []
            for v, f, ts, w, h, luma in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if luma is None or not w or not h or len(luma) != w * h:
                    out.append((v, f, ts, None, None, None))
                    continue
                to = fitted(w, h, cell)
                small = luma if to == (w, h) else resize(np.frombuffer(luma, np.uint8).reshape(1, h, w), *to).tobytes()
                out.append((v, f, ts, *to, small))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.binary()]
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in TILE.split(", ")])

    chosen = frames.select(F.col("video").cast("long"), F.col("frame_id").cast("long"), F.col("ts").cast("double"), F.col("width").cast("int"), F.col("height").cast("int"), "luma")
    return chosen.mapInArrow(run, TILE)


def contact_sheets(frames: DataFrame, columns: int, cell: int, most: int = 48) -> DataFrame:
    """Sheets of SHEET's columns: at most `most` frames each, `columns` cells a row, cells of at least MIN_CELL samples a side."""
    columns, cell = max(1, columns), max(MIN_CELL, cell)
    # Places are numbered among keys alone; pictures meet them by (video, frame_id).
    place = F.row_number().over(Window.partitionBy("video").orderBy("ts", "frame_id")) - 1
    numbered = frames.select(F.col("video").cast("long").alias("video"), F.col("frame_id").cast("long").alias("frame_id"), F.col("ts").cast("double").alias("ts")).distinct()
    numbered = numbered.withColumn("place", place.cast("long")).withColumn("sheet", F.expr(f"place div {most}"))
    rows = tiles(frames, cell).dropDuplicates(["video", "frame_id", "ts"]).join(numbered, ["video", "frame_id", "ts"])

    def one(group: pa.Table) -> pa.Table:
        cols = [group.column(c).to_pylist() for c in ("place", "ts", "tile_width", "tile_height", "tile")]
        cells = sorted(zip(*cols, strict=True), key=lambda c: c[0])
        luma = pasted(cells, columns, cell)
        values = [group.column("video")[0].as_py(), group.column("sheet")[0].as_py(), luma.shape[1], luma.shape[0], len(cells), sum(c[4] is None for c in cells), cells[0][1], cells[-1][1], luma.tobytes()]
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, *[pa.float64()] * 2, pa.binary()]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in SHEET.split(", ")])

    return rows.groupBy("video", "sheet").applyInArrow(one, SHEET)
