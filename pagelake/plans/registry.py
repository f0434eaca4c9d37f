"""Names of components, and what each needs."""

from __future__ import annotations

import importlib.util
import inspect
import shutil
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from typing import Any

from .. import detectors as D
from .. import readers as R


class Registry:
    def __init__(self, kind: str):
        self.kind, self._items = kind, {}

    def register(self, name: str, item: Any) -> None:
        self._items[name] = item

    def get(self, name: str) -> Any:
        if name not in self._items:
            raise KeyError(f"no {self.kind} named {name!r}; there are: {', '.join(self.list())}")
        return self._items[name]

    def list(self):
        """The names, in order."""
        return [*sorted(self._items)]


def accepted(maker: Callable, model: str | None = None, **options: Any) -> dict[str, Any]:
    """Those options that ``maker`` takes and that are given; ``model`` under the first of its names there."""
    takes = inspect.signature(maker).parameters
    if model is not None:
        options |= {next((n for n in ("model", "model_dir", "model_id") if n in takes), ""): str(model)}
    return {k: v for k, v in options.items() if k in takes and v is not None}


@dataclass
class Component:
    """A detector or recogniser by name: made where its libraries and programs are, otherwise an ImportError says what it needs."""

    name: str
    maker: Callable
    libraries: tuple[str, ...] = ()
    programs: tuple[str, ...] = ()
    lines: bool | None = None
    regions: bool = False

    def __call__(self, model: str | None = None, **options: Any) -> Any:
        missing = [f"the library {x}" for x in self.libraries if importlib.util.find_spec(x) is None] + [f"the program {x}" for x in self.programs if shutil.which(x) is None]
        if missing:
            raise ImportError(f"{self.name} needs {' and '.join(missing)}")
        options = accepted(self.maker, model, **options)
        return self.maker(**options) if self.lines is None else R.Reader.of(self.maker, self.lines, self.regions, **options)


detectors, recognizers, formatters = Registry("detector"), Registry("recogniser"), Registry("formatter")
for _c in (Component("as_yolo", D.yolo, ("onnxruntime",)), Component("paddlex", D.paddlex, ("paddlex",))):
    detectors.register(_c.name, _c)


def news(tessdata_dir: str | None = None) -> R.Tesseract:
    """Lines by the model ``news`` beside the package."""
    return R.Tesseract("news", tessdata_dir, "line")


for _c in (
    Component("tesseract", R.Tesseract, (), ("tesseract",), True, True),
    Component("tesseract-news", news, (), ("tesseract",), True, True),
    Component("tesserocr", R.Tesserocr, ("tesserocr", "PIL"), (), True, True),
    Component("kraken", R.Kraken, ("kraken", "PIL"), (), True),
    Component("trocr", R.Trocr, ("torch", "transformers", "PIL"), (), True),
    Component("effocr", R.Effocr, ("efficient_ocr",), (), True),
    Component("glm-ocr", R.glm, (), (), False, True),
    Component("lightonocr", R.lighton, ("torch", "transformers"), (), False, True),
):
    recognizers.register(_c.name, _c)
