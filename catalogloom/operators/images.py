"""Image cleaning: orientation, grayscale, threshold, bilevel output."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .incremental import pending_files

# Fixed value: gray values above this become white.
THRESHOLD = 200

# Weights of red, green and blue in 16-bit fixed point (ITU-R 601).
RED, GREEN, BLUE = 19595, 38470, 7471

# Fixed value: what to do to the pixel grid for each EXIF orientation.
UPRIGHT = {
    2: lambda a: a[:, ::-1],
    3: lambda a: a[::-1, ::-1],
    4: lambda a: a[::-1, :],
    5: lambda a: np.swapaxes(a, 0, 1),
    6: lambda a: np.swapaxes(a, 0, 1)[:, ::-1],
    7: lambda a: np.swapaxes(a, 0, 1)[::-1, ::-1],
    8: lambda a: np.swapaxes(a, 0, 1)[::-1, :],
}


def binarize_pixels(pixels: Column, threshold: int = THRESHOLD) -> Column:
    """Array of gray values to 255 above the threshold and 0 otherwise."""
    return F.transform(pixels, lambda p: F.when(p > threshold, F.lit(255)).otherwise(F.lit(0)))


def _gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Gray plane of row-major pixels in blue-green-red order; a fourth channel is ignored."""
    grid = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return grid[:, :, 0]
    blue, green, red = (grid[:, :, i].astype(np.uint32) for i in range(3))
    return ((red * RED + green * GREEN + blue * BLUE + 0x8000) >> 16).astype(np.uint8)


def _png_chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def bilevel_png(white: np.ndarray) -> bytes:
    """One bit per pixel, the smallest file that holds the cleaned image."""
    height, width = white.shape
    rows = np.hstack([np.zeros((height, 1), np.uint8), np.packbits(white, axis=1)])
    header = struct.pack(">IIBBBBB", width, height, 1, 0, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n"
        + _png_chunk(b"IHDR", header)
        + _png_chunk(b"IDAT", zlib.compress(rows.tobytes(), 9))
        + _png_chunk(b"IEND", b"")
    )


def binarize_images(images: DataFrame, threshold: int = THRESHOLD, orientation: str | None = None) -> DataFrame:
    """Cleaned images of rows with (…, height, width, channels, data).

    Replaces the pixel columns by the upright size, the counts of white and black pixels and the
    bytes of the cleaned PNG. ``orientation`` names a column with the EXIF orientation, for sources
    that decode without turning. Arrow batches of images stream through each task.
    """
    pixel = ["height", "width", "channels", "data"]
    keep = [c for c in images.columns if c not in pixel and c != orientation]
    made = {
        "height": T.IntegerType(),
        "width": T.IntegerType(),
        "white": T.LongType(),
        "black": T.LongType(),
        "content": T.BinaryType(),
    }
    schema = T.StructType(
        [*[images.schema[c] for c in keep], *[T.StructField(name, kind) for name, kind in made.items()]]
    )

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch[[*pixel, *([orientation] if orientation else [])]].itertuples(index=False):
                plane = _gray(row.data, row.height, row.width, row.channels)
                turn = row[4] if orientation else None
                if turn in UPRIGHT:
                    plane = UPRIGHT[turn](plane)
                white = plane > threshold
                lit = int(white.sum())
                rows.append((*white.shape, lit, white.size - lit, bilevel_png(white)))
            out = pd.DataFrame(rows, columns=list(made), index=batch.index)
            yield pd.concat([batch[keep], out], axis=1)

    return images.mapInPandas(clean, schema)


def decode_netpbm(content: bytes) -> tuple[int, int, int, bytes]:
    """(height, width, channels, pixels in blue-green-red order) of a plain gray or color map (P5, P6)."""
    match = re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+255\s", content)
    if not match:
        raise ValueError("no P5 or P6 map of 8 bits")
    width, height, channels = int(match[2]), int(match[3]), 1 if match[1] == b"5" else 3
    data = np.frombuffer(content, np.uint8, height * width * channels, match.end())
    return height, width, channels, data.reshape(-1, channels)[:, ::-1].tobytes()


def bilevel_netpbm(white: np.ndarray) -> bytes:
    """The cleaned image as a plain bitmap (P4), where a set bit is black."""
    height, width = white.shape
    return b"P4\n%d %d\n" % (width, height) + np.packbits(~white, axis=1).tobytes()


def clean_images(
    rows: DataFrame,
    decode: Callable[[bytes], tuple[int, int, int, bytes]] = decode_netpbm,
    encode: Callable[[np.ndarray], bytes] = bilevel_png,
    threshold: int = THRESHOLD,
    orientation: str | None = None,
    held_bytes: int = 1 << 25,
) -> DataFrame:
    """Cleaned images of rows with (…, content): decoded, turned, thresholded and encoded in one pass.

    Images travel as rows of a table: its scan deals them to tasks, no folder is listed and no small file
    is written. ``decode`` gives height, width, channels and blue-green-red pixels of the bytes, ``encode``
    the bytes of a plane that is true where the image is white. ``orientation`` names a column with the
    EXIF orientation; without it, or where it is NULL, the tag in the bytes counts.

    Replaces content and adds (height, width, white, black, error); bytes that cannot be decoded, or
    NULL, give NULLs and the reason. A task holds about ``held_bytes`` of results at a time.
    """
    keep = [c for c in rows.columns if c not in ("content", orientation)]
    made = "height int, width int, white long, black long, content binary, error string"
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), made])
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    names = [part.split()[0] for part in made.split(", ")]

    def clean(content: bytes | None, turn: int | None) -> tuple:
        if content is None:
            return (None,) * 5 + ("no content",)
        try:
            plane = _gray(*_as_grid(decode(content)))
            turn = exif_orientation(content) if turn is None else turn
            white = (UPRIGHT[turn](plane) if turn in UPRIGHT else plane) > threshold
            lit = int(white.sum())
            return (*white.shape, lit, white.size - lit, encode(white), None)
        except Exception as error:  # one bad image must not fail its task
            return (None,) * 5 + (repr(error),)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, start, held = [], 0, 0
            for k in range(batch.num_rows):  # one image at a time leaves the batch
                turn = batch.column("_turn")[k].as_py()
                done.append(clean(batch.column("content")[k].as_py(), turn))
                held += len(done[-1][4] or b"")
                if held >= held_bytes or k + 1 == batch.num_rows:
                    arrays = [pa.array(c, kind) for c, kind in zip(zip(*done), kinds)]
                    own = [batch.column(c).slice(start, len(done)) for c in keep]
                    yield pa.RecordBatch.from_arrays([*own, *arrays], [*keep, *names])
                    done, start, held = [], k + 1, 0

    turn = F.col(orientation).cast("int") if orientation else F.lit(None).cast("int")
    return rows.select(*keep, "content", turn.alias("_turn")).mapInArrow(run, schema)


def _as_grid(decoded: tuple[int, int, int, bytes]) -> tuple[bytes, int, int, int]:
    height, width, channels, data = decoded
    return data, height, width, channels


def process_assets(
    assets: DataFrame,
    processed: DataFrame,
    images: DataFrame,
    threshold: int = THRESHOLD,
    keys: tuple[str, ...] = ("product_id",),
    orientation: str | None = None,
) -> DataFrame:
    """Cleaned images of the assets whose processed file does not exist yet.

    ``assets`` and ``processed`` are lists of paths; the pending list is settled on those alone. The
    images, with their ``asset_path`` and pixels, meet only that list.
    """
    wanted = assets.select(*keys, "asset_path", "processed_path").distinct()
    todo = pending_files(wanted, processed, "processed_path", keys=keys)
    return binarize_images(images.join(todo, [*keys, "asset_path"], "inner"), threshold, orientation)


def exif_orientation(content: bytes) -> int:
    """EXIF orientation of PNG or JPEG bytes, 1 when there is none."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        at, body = 8, b""
        while at + 8 <= len(content):
            size, kind = struct.unpack(">I4s", content[at : at + 8])
            if kind == b"eXIf":
                body = content[at + 8 : at + 8 + size]
                break
            at += 12 + size
    else:
        mark = content.find(b"Exif\0\0", 0, 65536) if content[:2] == b"\xff\xd8" else -1
        body = content[mark + 6 :] if mark >= 0 else b""
    if body[:2] not in (b"II", b"MM") or len(body) < 10:
        return 1
    order = "<" if body[:2] == b"II" else ">"
    start = struct.unpack(order + "I", body[4:8])[0]
    count = struct.unpack(order + "H", body[start : start + 2])[0] if start + 2 <= len(body) else 0
    for i in range(count):
        entry = body[start + 2 + 12 * i : start + 14 + 12 * i]
        if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 0x0112:
            return struct.unpack(order + "H", entry[8:10])[0]
    return 1
