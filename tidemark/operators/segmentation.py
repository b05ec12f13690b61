"""Water segmentation around a model that the user brings: what goes in, what comes out.

No network and no weights are part of this package. ``predict`` does all that surrounds the model: scaling, channel
order, normalising, padding, cropping, and the class of the greatest score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Channel means and deviations (red, green, blue), longest long and short side, least padded side. Fixed values.
MEAN, STD = (123.675, 116.28, 103.53), (58.395, 57.12, 57.375)
LONG_SIDE, SHORT_SIDE, PADDED = 2048, 512, 512

#: (1, 3, height, width) float32 to (1, classes, h, w) scores.
Model = Callable[[np.ndarray], np.ndarray]


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres at halves, borders repeated."""
    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    data = image.astype(np.float32)
    r0, r1, fr = axis(data.shape[0], height)
    c0, c1, fc = axis(data.shape[1], width)
    fr, fc = (x.astype(np.float32) for x in (fr, fc))
    shape = (-1, 1) + (1,) * (data.ndim - 2)
    rows = data[r0] * (1 - fr).reshape(shape[0], *([1] * (data.ndim - 1))) + data[r1] * fr.reshape(-1, *([1] * (data.ndim - 1)))
    across = fc.reshape(1, -1, *([1] * (data.ndim - 2)))
    return rows[:, c0] * (1 - across) + rows[:, c1] * across


def scaled_size(height: int, width: int) -> tuple[int, int]:
    scale = min(LONG_SIDE / max(height, width), SHORT_SIDE / min(height, width))
    return int(height * scale + 0.5), int(width * scale + 0.5)


def prepare(bgr: np.ndarray) -> tuple[np.ndarray, tuple[int, int]]:
    """(1, 3, H, W) input, zero-padded at the right and the bottom, and the size without padding."""
    height, width = scaled_size(*bgr.shape[:2])
    rgb = (resize(bgr, height, width)[:, :, ::-1] - np.array(MEAN, np.float32)) / np.array(STD, np.float32)
    out = np.zeros((1, 3, max(height, PADDED), max(width, PADDED)), np.float32)
    out[0, :, :height, :width] = rgb.transpose(2, 0, 1)
    return out, (height, width)


def predict(model: Model, bgr: np.ndarray) -> np.ndarray:
    """The class of every pixel of the image, uint8."""
    data, (height, width) = prepare(bgr)
    scores = model(data)[0].transpose(1, 2, 0)
    scores = resize(scores, *data.shape[2:])[:height, :width]
    return resize(scores, *bgr.shape[:2]).argmax(-1).astype(np.uint8)


def colours(mask: np.ndarray) -> np.ndarray:
    """BGR picture of a mask: water dark red, the rest black."""
    out = np.zeros((*mask.shape, 3), np.uint8)
    out[mask == 1] = (0, 0, 128)
    return out


def segment(images: DataFrame, make_model: Callable[[], Model], name: str = "mask") -> DataFrame:
    """Images (n_rows, n_cols, bgr binary, ...) with their masks. A worker makes the model once."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        for batch in batches:
            sizes = zip(*(batch.column(c).to_pylist() for c in ("n_rows", "n_cols", "bgr")), strict=True)
            masks = [predict(model, np.frombuffer(d, np.uint8).reshape(h, w, 3)).tobytes() for h, w, d in sizes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(masks, pa.binary())], [*batch.schema.names, name])

    return images.mapInArrow(run, StructType([*images.schema.fields, StructField(name, BinaryType())]))
