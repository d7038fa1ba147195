"""Contact sheets against a plain loop over samples."""

import numpy as np

from streamloom.operators import sheets as S
from streamloom.sources.frames import resize

ROWS = "video long, frame_id long, ts double, width int, height int, luma binary"


def plain(frames, columns, cell):
    """A sheet sample by sample."""
    rows = -(-len(frames) // columns)
    out = [[245] * (columns * cell) for _ in range(rows * cell)]
    for i, (_, _, ts, w, h, luma) in enumerate(frames):
        y0, x0 = i // columns * cell, i % columns * cell
        if luma is not None and len(luma) == w * h:
            scale = max(w, h)
            tw, th = (w, h) if scale <= cell else (max(1, round(w * cell / scale + 1e-9)), max(1, round(h * cell / scale + 1e-9)))
            small = resize(np.frombuffer(luma, np.uint8).reshape(1, h, w), tw, th)[0] if (tw, th) != (w, h) else np.frombuffer(luma, np.uint8).reshape(h, w)
            for y in range(th):
                for x in range(tw):
                    out[y0 + (cell - th) // 2 + y][x0 + (cell - tw) // 2 + x] = int(small[y][x])
        for y in range(2, 19):
            for x in range(2, min(93, cell)):
                out[y0 + y][x0 + x] = 0
        for k, c in enumerate(f"{i + 1} {int(ts) // 60:02d}:{int(ts) % 60:02d}"):
            for y, row in enumerate(S.GLYPHS[c].split()):
                for x, mark in enumerate(row):
                    for dy in range(2):
                        for dx in range(2):
                            px = 5 + 8 * k + 2 * x + dx
                            if mark == "#" and px < min(93, cell):
                                out[y0 + 5 + 2 * y + dy][x0 + px] = 255
        for k in range(cell):
            out[y0][x0 + k] = out[y0 + cell - 1][x0 + k] = out[y0 + k][x0] = out[y0 + k][x0 + cell - 1] = 180
    return bytes(b for row in out for b in row)


def pictures(seed, sizes, video=1):
    rng = np.random.default_rng(seed)
    return [(video, 100 - i, float(i * 7), w, h, rng.integers(0, 256, w * h, dtype=np.uint8).tobytes()) for i, (w, h) in enumerate(sizes)]


def test_sheets_equal_a_plain_loop(spark):
    one = pictures(1, [(200, 100), (64, 64), (10, 90), (70, 70), (300, 2), (5, 5), (129, 64)])
    two = pictures(2, [(80, 60)] * 3, video=2)
    frames = spark.createDataFrame([*one, *two, two[0]], ROWS).repartition(3)
    got = {(r["video"], r["sheet"]): r for r in S.contact_sheets(frames, 3, 64, 5).collect()}
    want = {(1, 0): one[:5], (1, 1): one[5:], (2, 0): two}
    assert got.keys() == want.keys()
    for k, rows in want.items():
        r = got[k]
        assert bytes(r["luma"]) == plain(rows, 3, 64), k
        assert (r["width"], r["height"], r["n_frames"], r["missing"]) == (192, 64 * -(-len(rows) // 3), len(rows), 0)
        assert (r["first_ts"], r["last_ts"]) == (rows[0][2], rows[-1][2])


def test_frames_without_pictures_and_long_labels(spark):
    rows = [(1, 1, 1.0, 8, 8, None), (1, 2, 2.0, 8, 8, b"short"), (1, 3, 60000.0, 8, 8, bytes(64)), (1, 4, 60000.0, None, None, b"x")]
    r = S.contact_sheets(spark.createDataFrame(rows, ROWS), 2, 10).collect()
    assert len(r) == 1 and (r[0]["n_frames"], r[0]["missing"], r[0]["width"]) == (4, 3, 128)
    blank = [(v, f, ts, w, h, luma if luma and w and len(luma) == w * h else None) for v, f, ts, w, h, luma in rows]
    assert bytes(r[0]["luma"]) == plain(blank, 2, 64)
    assert S.contact_sheets(spark.createDataFrame([], ROWS), 2, 64).count() == 0


def test_sizes():
    assert S.fitted(200, 100, 64) == (64, 32) and S.fitted(300, 2, 64) == (64, 1) and S.fitted(3, 4, 64) == (3, 4) and S.fitted(129, 64, 64) == (64, 32)
