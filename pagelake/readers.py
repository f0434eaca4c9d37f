"""Recognisers: adapters to libraries, programs and services that read text from crops.

A reader is made in a Python worker. ``recognize(contents, boxes)`` reads lines, ``recognize_regions`` whole
regions, both from PNG bytes into (text, confidence). Libraries are imported when a reader is made.
"""

from __future__ import annotations

import base64
import importlib
import io
import json
import os
import subprocess
import tempfile
import urllib.request
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial
from pathlib import Path
from typing import Any

TESSDATA = Path(__file__).resolve().parent / "tessdata"
MODES = ("line", "region")


def checked(mode: str, modes: tuple[str, ...] = MODES) -> str:
    if mode not in modes:
        raise ValueError(f"no mode {mode!r}; there are {', '.join(modes)}")
    return mode


def sure(text: str, confidence: float = 0.9) -> tuple[str, float]:
    """A text of a reader that gives no confidence of its own."""
    return text, confidence if text else 0.0


@contextmanager
def as_file(png: bytes, suffix: str = ".png"):
    with tempfile.NamedTemporaryFile(suffix=suffix) as f:
        f.write(png)
        f.flush()
        yield f.name


def pillow(png: bytes):
    from PIL import Image

    return Image.open(io.BytesIO(png)).convert("RGB")


class Each:
    """Reads crops one by one with ``line`` and, where it has it, ``region``."""

    line: Callable[[bytes], tuple[str, float]]

    def recognize(self, contents, boxes):
        return [self.line(x) for x in contents]


class Regions(Each):
    region: Callable[[bytes], tuple[str, float]]

    def recognize_regions(self, contents, boxes):
        return [self.region(x) for x in contents]


def find_tessdata(environment: dict[str, str] | None = None, run: Callable = subprocess.run, places: tuple[str, ...] | None = None) -> str:
    """The folder of language models: TESSDATA_PREFIX, else what the program reports, else the usual places."""
    named = (os.environ if environment is None else environment).get("TESSDATA_PREFIX")
    if named and Path(named).is_dir():
        return named
    try:
        said = run(["tesseract", "--print-parameters"], capture_output=True, text=True, timeout=5)
        for word in (x.split()[-1] for x in (said.stderr + "\n" + said.stdout).splitlines() if "tessdata" in x.lower() and "/" in x):
            if Path(word).is_dir():
                return word
    except (FileNotFoundError, subprocess.TimeoutExpired):
        pass
    share = [f"{root}/share" for root in ("/opt/homebrew", "/usr/local", "/usr")]
    usual = (f"{share[0]}/tessdata", f"{share[1]}/tessdata", *(f"{share[2]}/tesseract-ocr/{v}/tessdata" for v in ("5", "4.00")), f"{share[2]}/tessdata")
    for place in usual if places is None else places:
        if Path(place).is_dir():
            return place
    raise RuntimeError("there is no folder tessdata: set TESSDATA_PREFIX or give tessdata_dir")


class Tesseract(Regions):
    """The program ``tesseract``, once for each crop: page segmentation 7 for lines, 6 for regions. Models beside the package come before installed ones."""

    def __init__(self, model: str = "eng", tessdata_dir: str | None = None, mode: str = "region"):
        self.model, self.mode = model, checked(mode)
        beside = TESSDATA if (TESSDATA / f"{model}.traineddata").exists() else None
        self.tessdata_dir = str(tessdata_dir or beside or "") or None

    def command(self, path: str, segmentation: int) -> list[str]:
        where = ["--tessdata-dir", self.tessdata_dir] if self.tessdata_dir else []
        return ["tesseract", path, "stdout", "--psm", str(segmentation), *where, "-l", self.model]

    def _read(self, png: bytes, segmentation: int, timeout: int) -> tuple[str, float]:
        with as_file(png) as path:
            return sure(subprocess.run(self.command(path, segmentation), capture_output=True, text=True, timeout=timeout).stdout.strip())

    def line(self, png):
        return self._read(png, 7, 30)

    def region(self, png):
        return self._read(png, 6, 60)


class Tesserocr(Regions):
    """The same engine within the process, with its own confidences."""

    def __init__(self, model: str = "eng", tessdata_dir: str | None = None, mode: str = "region"):
        api = importlib.import_module("tesserocr")
        self.api = api.PyTessBaseAPI(path=str(tessdata_dir or find_tessdata()), lang=model)
        self.mode = checked(mode)
        self.api.SetPageSegMode(api.PSM.SINGLE_BLOCK if mode == "region" else api.PSM.SINGLE_LINE)

    def line(self, png):
        self.api.SetImage(pillow(png))
        return self.api.GetUTF8Text().strip(), self.api.MeanTextConf() / 100.0

    region = line

    def __del__(self):
        if hasattr(self, "api"):
            self.api.End()


def hub_file(repo: str, name: str, cache: str | None = None) -> str:
    """A model's file, fetched from the model hub on first use."""
    return importlib.import_module("huggingface_hub").hf_hub_download(repo_id=repo, filename=name, cache_dir=cache)


class Kraken(Each):
    """Lines by a kraken model: a file, or ``hub`` (repository and file name) to fetch one from."""

    def __init__(self, model: str | None = None, model_cache_dir: str | None = None, hub: tuple[str, str] | None = None):
        load = importlib.import_module("kraken.lib.models").load_any
        if model is None and hub is None:
            raise ValueError("kraken needs a model file, or the hub's repository and file name")
        self.net = load(str(model or hub_file(*hub, model_cache_dir)))
        self.rpred, self.containers = importlib.import_module("kraken.rpred").rpred, importlib.import_module("kraken.containers")

    def line(self, png):
        image, c = pillow(png), self.containers
        one = c.BBoxLine(id="line", bbox=(0, 0, *image.size))
        found = list(self.rpred(self.net, image, c.Segmentation(type="bbox", imagename="line", lines=[one], text_direction="horizontal-lr", script_detection=False)))
        return sure(found[-1].prediction if found else "")


def device_of(torch, device: str | None) -> str:
    """The device asked for, else CUDA, else MPS, else the CPU."""
    if device is not None:
        return device
    if torch.cuda.is_available():
        return "cuda"
    mps = getattr(torch.backends, "mps", None)
    return "mps" if mps is not None and mps.is_available() else "cpu"


class Trocr(Each):
    """Lines by an encoder and decoder of transformers; an error in a line leaves it empty."""

    def __init__(self, model_id: str = "microsoft/trocr-base-printed", device: str | None = None):
        self.torch, t = importlib.import_module("torch"), importlib.import_module("transformers")
        self.device = device_of(self.torch, device)
        self.processor, self.net = t.TrOCRProcessor.from_pretrained(model_id), t.VisionEncoderDecoderModel.from_pretrained(model_id).to(self.device)
        self.net.eval()

    def line(self, png):
        pixels = self.processor(images=pillow(png), return_tensors="pt").pixel_values.to(self.device)
        with self.torch.no_grad():
            ids = self.net.generate(pixels, max_new_tokens=128)
        return sure(self.processor.batch_decode(ids, skip_special_tokens=True)[0].strip())


class Effocr(Each):
    """Lines by localised characters and words, of ONNX models."""

    HUB = "dell-research-harvard/effocr_en"

    def __init__(self, model_dir: str | None = None):
        part = lambda own="": dict(model_backend="onnx", model_dir=str(model_dir or "./models"), hf_repo_id=self.HUB + own)
        readers = {kind: part(f"/{kind}_recognizer") for kind in ("char", "word")}
        self.engine = importlib.import_module("efficient_ocr").EffOCR(config={"Global": {"skip_line_detection": True}, "Recognizer": readers, "Localizer": part(), "Line": part()})

    def line(self, png):
        with as_file(png) as path:
            found = self.engine.infer(path)
        return sure(found[0].text.strip() if found and found[0].text else "", 0.8)


def has_repetition(text: str, least: int = 10, times: int = 3) -> bool:
    """As ``functions.text.repeats_itself``: the first characters occur as often; longer repeated beginnings imply it."""
    return len(text) >= least * times and text.count(text[:least]) >= times


def without_repetition(text: str, least: int = 10) -> str:
    """As the column of that name: the shortest beginning that the text goes on with once more."""
    for n in range(least, len(text) // 2 + 1):
        if text.startswith(text[:n], n):
            return text[:n].strip()
    return text.strip()


class Guarded(Regions):
    """A model that may repeat itself or fail: asked again up to ``max_retries`` times; the last answer is cut to what it repeats, the last error leaves ''."""

    max_retries = 2

    def ask(self, png: bytes) -> str:
        raise NotImplementedError

    def region(self, png):
        for attempt in range(self.max_retries + 1):
            last = attempt == self.max_retries
            try:
                text = self.ask(png).strip()
            except Exception:  # noqa: BLE001  the model's own errors
                if last:
                    return "", 0.0
                continue
            if not has_repetition(text):
                return sure(text)
            if last:
                return sure(without_repetition(text))
        return "", 0.0

    line = region


class Service(Guarded):
    """A model behind HTTP: every crop is posted as a chat completion with a base64 PNG."""

    def __init__(self, url: str = "http://localhost:8080/v1/chat/completions", model: str = "mlx-community/GLM-OCR-bf16", prompt: str = "Text Recognition:", max_tokens: int = 4096, timeout: float = 25.0, max_retries: int = 2):
        self.url, self.model, self.prompt, self.max_tokens, self.timeout, self.max_retries = url, model, prompt, max_tokens, timeout, max_retries

    def body(self, png: bytes) -> bytes:
        data = dict(url="data:image/png;base64," + base64.b64encode(png).decode())
        image = dict(type="image_url", image_url=data)
        message = {"role": "user", "content": [image, {"type": "text", "text": self.prompt}]}
        return json.dumps({"model": self.model, "max_tokens": self.max_tokens, "messages": [message]}).encode()

    def ask(self, png):
        request = urllib.request.Request(self.url, self.body(png), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            first = json.load(answer)["choices"][0]
        return first["message"]["content"]


class Vision(Guarded):
    """A vision-language model of transformers within the process, loaded with the first crop."""

    def __init__(self, model_id: str, device: str | None = None, prompt: str | None = None, max_new_tokens: int = 4096, max_retries: int = 2, classes: tuple[str, str] = ("AutoProcessor", "AutoModelForImageTextToText"), mps: bool = True, **options: Any):
        self.torch, self.library = importlib.import_module("torch"), importlib.import_module("transformers")
        self.device = device_of(self.torch, device)
        if self.device == "mps" and not mps:
            self.device = "cpu"
        self.model_id, self.prompt, self.max_new_tokens, self.max_retries, self.classes, self.options = model_id, prompt, max_new_tokens, max_retries, classes, options
        self.net = self.processor = None

    def _load(self):
        kind = self.torch.bfloat16 if self.device == "cuda" else self.torch.float32
        self.processor, self.net = (getattr(self.library, c).from_pretrained(self.model_id, **k) for c, k in zip(self.classes, ({}, {"dtype": kind})))
        self.net = self.net.to(self.device)

    def ask(self, png):
        if self.net is None:
            self._load()
        content = [{"type": "image", "url": "data:image/png;base64," + base64.b64encode(png).decode()}, *([{"type": "text", "text": self.prompt}] if self.prompt else [])]
        inputs = self.processor.apply_chat_template([{"role": "user", "content": content}], add_generation_prompt=True, tokenize=True, return_dict=True, return_tensors="pt").to(self.device)
        inputs.pop("token_type_ids", None)
        with self.torch.no_grad():
            out = self.net.generate(**inputs, max_new_tokens=self.max_new_tokens, **self.options)
        return self.processor.decode(out[0][inputs["input_ids"].shape[1] :], skip_special_tokens=True)


def glm(mode: str = "api", api_url: str = "http://localhost:8080/v1/chat/completions", model_id: str = "zai-org/GLM-OCR", mlx_model_id: str = "mlx-community/GLM-OCR-bf16", timeout: float = 25.0, max_retries: int = 2, device: str | None = None):
    """The GLM model behind a service, or within the process (not on MPS, where it goes wrong)."""
    if checked(mode, ("api", "local")) == "api":
        return Service(api_url, mlx_model_id, timeout=timeout, max_retries=max_retries)
    return Vision(model_id, device, "Text Recognition:", 4096, max_retries, mps=False)


def lighton(model_id: str = "lightonai/LightOnOCR-2-1B-base", device: str | None = None, max_new_tokens: int = 512):
    """The LightOn model within the process, asked once, without sampling."""
    return Vision(model_id, device, None, max_new_tokens, 0, ("LightOnOcrProcessor", "LightOnOcrForConditionalGeneration"), do_sample=False)


@dataclass
class Reader:
    """What a pipeline needs of a recogniser: how workers make it, whether it reads lines and regions, and which it is to read."""

    factory: Callable[[], Any]
    lines: bool = True
    regions: bool = False
    mode: str = "line"

    @classmethod
    def of(cls, maker: Callable, lines: bool, regions: bool, **options: Any) -> Reader:
        mode = checked(options["mode"]) if "mode" in options and lines else ("line" if lines else "region")
        return cls(partial(maker, **options), lines, regions, mode)
