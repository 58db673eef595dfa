"""A run of the whole pipeline on a stream made for it, as a check of an installation."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

from ..raster.kernels import pixel_hash
from ..recognizers import Settings
from ..sources import sup_writer
from .convert import convert, execute
from .requests import ConvertRequest, RequestError, one_of

BACKENDS = ("table", "http")
_INK = {1: (235, 128, 128, 255)}
_GREY = 255 - _INK[1][0]


@dataclass(frozen=True)
class SmokeRequest:
    """What a check uses: a folder for its files, a recogniser and the number of images."""

    folder: str
    backend: str = "table"
    url: str | None = None
    images: int = 3

    def checked(self) -> SmokeRequest:
        backend = one_of(self.backend, BACKENDS, "backend")
        if backend == "http" and not self.url:
            raise RequestError("the http backend needs an address")
        if backend != "http" and self.url:
            raise RequestError("an address is only for the http backend")
        if self.images < 1:
            raise RequestError("images must be positive")
        return SmokeRequest(self.folder, backend, self.url, self.images)


def smoke(spark: SparkSession, request: SmokeRequest) -> dict[str, int | str]:
    """Counters and ``status``: ``ok`` if the cues are those of the stream; with another backend, if there is a text for each image."""
    request = request.checked()
    shapes = [np.ones((4 + i, 12), dtype=np.uint8) for i in range(request.images)]
    data = b"".join(sup_writer.display_set(1_000 * 90 * (i + 1), [(0, 100, 900, shape)], _INK) for i, shape in enumerate(shapes))
    folder = Path(request.folder)
    folder.mkdir(parents=True, exist_ok=True)
    stream, out = folder / "smoke.sup", folder / "smoke.srt"
    stream.write_bytes(data + sup_writer.display_set(1_000 * 90 * (request.images + 1), [], _INK))
    answers = {pixel_hash(np.full(shape.shape, _GREY, dtype=np.uint8)).hex(): f"line {i}" for i, shape in enumerate(shapes)}
    settings = Settings("table", options={"answers": answers}) if request.backend == "table" else Settings("http", options={"url": request.url})
    job = ConvertRequest(str(stream), str(out), recogniser=settings)
    counters = execute(spark, job)
    cues = [(r.start_ms, r.end_ms, r.text) for r in convert(spark, job).cues.orderBy("cue_index").collect()]
    expected = [(1_000 * (i + 1), 1_000 * (i + 2), f"line {i}") for i in range(request.images)]
    good = cues == expected if request.backend == "table" else len(cues) == request.images and "unread" not in counters
    return counters | {"status": "ok" if good and out.exists() else "failed"}
