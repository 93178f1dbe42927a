"""Text of page images by whichever OCR library is installed, and the resolution that pages are rendered at for it."""

from __future__ import annotations

import importlib
import io
from collections.abc import Callable
from functools import cache

#: A page's image in, its text out.
Reader = Callable[[bytes], str]
#: What an image's longer side may have in pixels on a machine of at most so many GB, and beyond.
SIDES, LARGEST = ((2, 1100), (4, 1400), (8, 1700)), 2000
#: The resolutions that are asked for at least and at most, and by how much a page may exceed its side for the first.
LEAST_DPI, MOST_DPI, SLACK = 200.0, 400.0, 1.25


def render_side(memory_gb: float) -> int:
    """Pixels of a page's longer side that OCR can afford."""
    return next((side for most, side in SIDES if memory_gb <= most), LARGEST)


def render_dpi(points: float, side: int) -> int:
    """The resolution that brings a page of so many points to the wanted side; raised to the least one where that stays in the budget."""
    fits = 72.0 * side / (points or 792.0)
    raised = max(fits, LEAST_DPI)
    return int(min(MOST_DPI, raised if raised <= SLACK * fits else fits))


def _rapidocr() -> Reader:
    engine = importlib.import_module("rapidocr_onnxruntime").RapidOCR()
    return lambda image: "\n".join(line[1] for line in engine(image)[0] or [])


def _tesseract() -> Reader:
    library, images = importlib.import_module("pytesseract"), importlib.import_module("PIL.Image")
    library.get_tesseract_version()  # the program may be missing though the library is there
    return lambda image: library.image_to_string(images.open(io.BytesIO(image)))


def _paddleocr() -> Reader:
    numpy, images = importlib.import_module("numpy"), importlib.import_module("PIL.Image")
    engine = importlib.import_module("paddleocr").PaddleOCR(use_angle_cls=True, lang="en", show_log=False)
    return lambda image: "\n".join(line[1][0] for block in engine.ocr(numpy.array(images.open(io.BytesIO(image)).convert("RGB")), cls=True) or [] for line in block or [])


BACKENDS: dict[str, Callable[[], Reader]] = {"rapidocr": _rapidocr, "tesseract": _tesseract, "paddleocr": _paddleocr}


@cache
def reader(order: tuple[str, ...] = tuple(BACKENDS)) -> Reader | None:
    """The first backend that can be had, made once in a process; None if there is none."""
    for name in order:
        try:
            return BACKENDS[name]()
        except Exception:  # not installed, or it doesn't start here
            continue
    return None
