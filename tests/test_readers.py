"""Readers, detectors and the pipeline's routes, with stand-ins for libraries, programs and models."""

import json
import os
import sys
import threading
import types
from functools import partial
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake import detectors, readers
from pagelake.operators import recognize
from pagelake.plans.pipeline import Pipeline
from pagelake.plans.registry import accepted, recognizers
from pagelake.readers import Reader
from pagelake.schema import LINES, PAGES, REGIONS
from pagelake.sources import images


class Stub:
    """Reads the crop's size and its first pixel."""

    def recognize(self, contents, boxes):
        return [(self.say("line", c), 0.5) for c in contents]

    def recognize_regions(self, contents, boxes):
        return [(self.say("region", c), 0.8) for c in contents]

    def say(self, kind, content):
        if content is None:
            return f"{kind} of nothing"
        pixels = images.decode(content)
        return f"{kind} {pixels.shape[1]}x{pixels.shape[0]} {pixels[0, 0, 0]}"


class Sure:
    def recognize(self, contents, boxes):
        return [("read again", 0.95) for _ in contents]

    recognize_regions = recognize


class BadOne:
    def recognize(self, contents, boxes):
        if any(c == b"bad" for c in contents):
            raise OSError("unreadable")
        return [(c.decode().upper(), 0.9) for c in contents]


def test_an_error_costs_one_item(spark):
    rows = spark.createDataFrame([(1, 0, k, 0, 0, 9, 9, b"bad" if k == 4 else b"ok%d" % k) for k in range(10)], "page_id long, region_idx int, line_idx int, x0 int, y0 int, x1 int, y1 int, content binary").coalesce(1)
    got = {r.line_idx: (r.text, r.confidence) for r in recognize.recognized(rows, BadOne).collect()}
    assert got == {k: ("", 0.0) if k == 4 else (f"OK{k}", 0.9) for k in range(10)}


def test_plans_have_readers_of_their_own(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0, 0, 9, 9, b"x")], "page_id long, region_idx int, line_idx int, x0 int, y0 int, x1 int, y1 int, content binary").coalesce(1)
    for kind, want in ((BadOne, "X"), (Sure, "read again"), (BadOne, "X")):
        assert recognize.recognized(rows, kind).first().text == want


def test_images(spark):
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (7, 5, 3)).astype(np.uint8)
    png = images.encode(pixels)
    assert (images.decode(png) == pixels).all()
    assert (images.decode(b"P6\n# made here\n5 7\n255\n" + pixels.tobytes()) == pixels).all()
    grey = rng.integers(0, 256, (4, 6)).astype(np.uint8)
    assert (images.decode(b"P5\n6 4\n255\n" + grey.tobytes()) == grey[:, :, None]).all()
    assert (images.to_rgb(np.dstack([pixels, pixels[:, :, :1]])) == pixels).all()
    pages = spark.createDataFrame([(1, png), (2, b"no image"), (3, None)], "page_id long, content binary")
    assert {r.page_id: (r.width, r.height) for r in images.decoded(pages).collect()} == {1: (5, 7), 2: (None, None), 3: (None, None)}
    rows = spark.createDataFrame([(1, 0, 1, 2, 4, 6), (1, 1, -3, 0, 2, 99), (1, 2, 3, 3, 3, 3), (2, 0, 0, 0, 1, 1)], "page_id long, region_idx int, x0 int, y0 int, x1 int, y1 int")
    got = {(r.page_id, r.region_idx): r.content for r in images.crops(rows, pages).collect()}
    assert (images.decode(bytes(got[1, 0])) == pixels[2:6, 1:4]).all() and (images.decode(bytes(got[1, 1])) == pixels[:, :2]).all() and got[1, 2] is None and got[2, 0] is None


def filtered(pixels, way):
    """PNG rows under one of the five filters."""
    import struct
    import zlib

    h, w, c = pixels.shape
    p = np.zeros((h + 1, w + 1, c), int)
    p[1:, 1:] = pixels
    left, up, corner = p[1:, :-1], p[:-1, 1:], p[:-1, :-1]
    guess = left + up - corner
    near = [abs(guess - x) for x in (left, up, corner)]
    paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
    rows = (pixels - [0, left, up, (left + up) // 2, paeth][way]) & 255
    raw = b"".join(bytes([way]) + rows[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + bytes(4)
    return images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw))


@pytest.mark.parametrize("way", range(5))
def test_png_filters(way):
    for channels in (1, 3, 4):
        pixels = np.random.default_rng(way).integers(0, 256, (6, 5, channels)).astype(np.uint8)
        assert (images.to_rgb(images._png(filtered(pixels, way))) == images.to_rgb(pixels)).all()


def page(spark):
    pixels = np.zeros((100, 200, 3), np.uint8)
    pixels[:50] = 10
    pages = spark.createDataFrame([(1, "p", 200, 100, images.encode(pixels))], PAGES + ", content binary")
    regions = spark.createDataFrame([(1, 0, "article", 0, 0, 100, 50, "", 1.0), (1, 1, "table", 0, 50, 200, 100, "", 1.0)], REGIONS)
    lines = spark.createDataFrame([(1, 0, 0, 0, 0, 100, 20, "", 0.0), (1, 0, 1, 0, 22, 90, 42, "", 0.0)], LINES)
    return pages, regions, lines


def test_routes_of_a_pipeline(spark):
    def run(reader, **options):
        return Pipeline(recognizer=reader, layout_processing=False, **options).run(*page(spark)).first().result

    both = partial(Reader, Stub, True, True)
    assert run(both("line"), text_cleaning=False) == "line 100x20 10 line 90x20 10\n\nregion 200x50 0"
    assert run(both("region")) == "region 100x50 10\n\nregion 200x50 0"
    assert run(Reader(Stub, True, False), text_cleaning=False) == "line 100x20 10 line 90x20 10"
    assert run(Reader(Stub, False, True, "region")) == "region 100x50 10\n\nregion 200x50 0"
    assert run(both("line"), text_cleaning=False, fallback=Reader(Sure)) == "read again read again\n\nregion 200x50 0"
    assert run(both("line"), fallback=Reader(Sure, False, True), fallback_threshold=10).startswith("line 100x20 10")
    found = json.loads(run(both("line"), output="json", fallback=Reader(Sure, False, True)))
    assert [x["confidence"] for x in found["regions"][0]["lines"]] == [1.0, 1.0] and found["regions"][1]["confidence"] == 0.8
    with pytest.raises(ValueError, match="dictionary"):
        run(both("line"), spell_check=True)


def test_layout_is_on_by_default(spark):
    pages, regions, lines = page(spark)
    doubled = regions.union(regions.where("region_idx = 0").withColumn("region_idx", F.lit(2)))
    assert Pipeline(recognizer=Reader(Stub, True, True), text_cleaning=False).run(pages, doubled, lines).first().result.count("line 100x20") == 1


def test_service_retries_and_cuts():
    answers, seen = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            status, text = answers.pop(0)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": text}}]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    service = readers.glm(api_url=f"http://127.0.0.1:{server.server_port}/v1")
    again = "0123456789ab " * 4
    for given, want, asked in (
        ([(200, "  Some text. \n")], ("Some text.", 0.9), 1),
        ([(500, ""), (200, "second")], ("second", 0.9), 2),
        ([(200, again), (200, "clean")], ("clean", 0.9), 2),
        ([(200, again)] * 3, ("0123456789ab", 0.9), 3),
        ([(500, "")] * 3, ("", 0.0), 3),
        ([(200, "")], ("", 0.0), 1),
    ):
        answers[:], seen[:] = given, []
        assert service.recognize_regions([b"png"], [None]) == [want] and len(seen) == asked
    assert seen[0]["messages"][0]["content"][1]["text"] == "Text Recognition:" and seen[0]["max_tokens"] == 4096
    server.shutdown()


def program(folder, text):
    path = folder / "tesseract"
    path.write_text(f"#!/bin/sh\necho \" {text} $4 $# \"\n")
    path.chmod(0o755)


def test_tesseract_program(tmp_path, monkeypatch):
    with pytest.raises(ImportError, match="program tesseract"):
        monkeypatch.setenv("PATH", str(tmp_path))
        recognizers.get("tesseract")()
    program(tmp_path, "read")
    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    reader = recognizers.get("tesseract")("custom", mode="line", device="cpu")
    assert (reader.lines, reader.regions, reader.mode) == (True, True, "line") and reader.factory().model == "custom"
    made = reader.factory()
    assert made.recognize([b"x"], [None]) == [("read 7 6", 0.9)] and made.recognize_regions([b"x"], [None]) == [("read 6 6", 0.9)]
    assert readers.Tesseract("eng", "/data").command("a.png", 7) == ["tesseract", "a.png", "stdout", "--psm", "7", "--tessdata-dir", "/data", "-l", "eng"]
    program(tmp_path, "")
    (tmp_path / "tesseract").write_text("#!/bin/sh\n")
    assert made.recognize([b"x"], [None]) == [("", 0.0)]
    with pytest.raises(ValueError):
        recognizers.get("tesseract")(mode="word")
    monkeypatch.setattr(readers, "TESSDATA", tmp_path)
    (tmp_path / "news.traineddata").write_text("")
    news = recognizers.get("tesseract-news")()
    assert news.mode == "line" and news.factory().tessdata_dir == str(tmp_path)


def test_tessdata(tmp_path):
    said = types.SimpleNamespace(stderr="", stdout=f"tessdata at /no\ntessdata_dir {tmp_path}")
    assert readers.find_tessdata({"TESSDATA_PREFIX": str(tmp_path)}) == str(tmp_path)
    assert readers.find_tessdata({"TESSDATA_PREFIX": "/no"}, lambda *a, **k: said) == str(tmp_path)

    def absent(*a, **k):
        raise FileNotFoundError

    assert readers.find_tessdata({}, absent, ("/no", str(tmp_path))) == str(tmp_path)
    with pytest.raises(RuntimeError):
        readers.find_tessdata({}, absent, ())


def module(monkeypatch, name, **items):
    m = types.ModuleType(name)
    m.__dict__.update(items)
    monkeypatch.setitem(sys.modules, name, m)
    return m


def test_libraries(monkeypatch):
    monkeypatch.setattr(readers, "pillow", lambda png: types.SimpleNamespace(size=(30, 10), png=png))

    class Api:
        def __init__(self, path, lang):
            self.made = (path, lang)

        def SetPageSegMode(self, m):
            self.mode = m

        def SetImage(self, image):
            self.image = image

        def GetUTF8Text(self):
            return f" {self.mode} {self.image.png.decode()}\n"

        def MeanTextConf(self):
            return 87

        def End(self):
            pass

    module(monkeypatch, "tesserocr", PyTessBaseAPI=Api, PSM=types.SimpleNamespace(SINGLE_BLOCK="block", SINGLE_LINE="line"))
    assert readers.Tesserocr("eng", "/data").recognize_regions([b"a"], [0]) == [("block a", 0.87)]
    assert readers.Tesserocr("eng", "/data", "line").recognize([b"a"], [0]) == [("line a", 0.87)]

    hub = {}
    module(monkeypatch, "huggingface_hub", hf_hub_download=lambda **k: hub.update(k) or "/cache/m")
    module(monkeypatch, "kraken")
    module(monkeypatch, "kraken.lib")
    module(monkeypatch, "kraken.lib.models", load_any=lambda path: path)
    module(monkeypatch, "kraken.containers", BBoxLine=lambda **k: k["bbox"], Segmentation=lambda **k: k["lines"])
    module(monkeypatch, "kraken.rpred", rpred=lambda net, image, seg: [types.SimpleNamespace(prediction=f"{net} {seg[0]}")] if image.png else [])
    made = readers.Kraken(hub=("owner/models", "m.mlmodel"), model_cache_dir="/cache")
    assert hub == {"repo_id": "owner/models", "filename": "m.mlmodel", "cache_dir": "/cache"}
    assert made.recognize([b"a", b""], [0, 0]) == [("/cache/m (0, 0, 30, 10)", 0.9), ("", 0.0)]
    with pytest.raises(ValueError):
        readers.Kraken()

    class Effocr:
        def __init__(self, config):
            self.config = config

        def infer(self, path):
            return [types.SimpleNamespace(text=" " + open(path).read())]

    module(monkeypatch, "efficient_ocr", EffOCR=Effocr)
    made = readers.Effocr("/models")
    assert made.recognize([b"seen", b""], [0, 0]) == [("seen", 0.8), ("", 0.0)] and made.engine.config["Line"]["model_dir"] == "/models"


class Net:
    """Stands in for processors, models and tensors of transformers and torch."""

    def __init__(self, answer):
        self.answer, self.asked, self.shape = answer, [], (1, 2)

    def from_pretrained(self, name, **options):
        self.name, self.options = name, options
        return self

    def to(self, device):
        return self

    def eval(self):
        pass

    def __call__(self, **k):
        return self

    @property
    def pixel_values(self):
        return self

    def generate(self, *a, **k):
        self.asked.append(k)
        return [np.arange(4)]

    def batch_decode(self, ids, **k):
        return [self.answer]

    def apply_chat_template(self, messages, **k):
        self.messages = messages
        out = type("Inputs", (dict,), {"to": lambda s, d: s})
        return out(input_ids=self, token_type_ids=0)

    def decode(self, ids, **k):
        return f"{self.answer}{len(ids)}"


class NoGrad:
    def __enter__(self):
        pass

    def __exit__(self, *a):
        pass


def test_transformers(monkeypatch):
    monkeypatch.setattr(readers, "pillow", lambda png: png)
    torch = module(monkeypatch, "torch", no_grad=NoGrad, cuda=types.SimpleNamespace(is_available=lambda: False), backends=types.SimpleNamespace(mps=types.SimpleNamespace(is_available=lambda: True)), bfloat16="half", float32="whole")
    assert readers.device_of(torch, None) == "mps" and readers.device_of(torch, "cpu") == "cpu"
    net = Net(" word ")
    names = ("TrOCRProcessor", "VisionEncoderDecoderModel", "AutoProcessor", "AutoModelForImageTextToText", "LightOnOcrProcessor", "LightOnOcrForConditionalGeneration")
    module(monkeypatch, "transformers", **{n: net for n in names})
    assert readers.Trocr().recognize([b"a"], [0]) == [("word", 0.9)] and net.asked[-1] == {"max_new_tokens": 128}
    local = readers.glm("local")
    assert local.device == "cpu" and local.recognize_regions([b"a"], [0]) == [("word 2", 0.9)] and net.messages[0]["content"][1]["text"] == "Text Recognition:"
    light = readers.lighton(device="cuda")
    assert light.recognize_regions([b"a"], [0]) == [("word 2", 0.9)] and net.asked[-1]["do_sample"] is False and net.asked[-1]["max_new_tokens"] == 512 and net.options == {"dtype": "half"}
    with pytest.raises(ValueError):
        readers.glm("fast")


def test_options_go_where_they_are_taken():
    assert accepted(readers.Tesseract, "m", mode="line", device="cpu") == {"model": "m", "mode": "line"}
    assert accepted(readers.Effocr, "m", mode="line") == {"model_dir": "m"} and accepted(readers.Trocr, "m", device="cpu") == {"model_id": "m", "device": "cpu"}
    assert accepted(readers.Kraken) == {}


class Session:
    """One region over the left half of a 200 x 100 page, once more with less confidence, and two lines in each chunk."""

    def __init__(self, path):
        self.path = path

    def get_inputs(self):
        return [types.SimpleNamespace(name="images")]

    def run(self, outputs, given):
        assert given["images"].shape == (1, 3, 1280, 1280)
        if self.path == "layout":
            boxes = [(640 - 50, 640, 100, 100, 0.9, 0.1), (640 - 48, 640, 100, 100, 0.5, 0.1), (300, 300, 10, 10, 0.001, 0.001)]
        else:
            boxes = [(640, 600, 200, 100, 0.9), (640, 780, 200, 60, 0.8), (640, 602, 200, 100, 0.6), (640, 640, 10, 10, 0.1)]
        return [np.array([boxes], np.float32).transpose(0, 2, 1)]


def test_two_models(spark):
    pages = spark.createDataFrame([(1, images.encode(np.zeros((100, 200, 3), np.uint8))), (2, b"broken")], "page_id long, content binary")
    found, regions, lines = detectors.Yolo("layout", "line", Session)(pages)
    assert [tuple(r) for r in found.select("page_id", "width", "height").collect()] == [(1, 200, 100)]
    (region,) = regions.collect()
    assert (region.label, region.confidence, region.region_idx) == ("article", 1.0, 0) and (region.x0, region.y0, region.x1, region.y1) == (84, 10, 100, 15)
    assert sorted((r.line_idx, r.x0, r.y0, r.x1, r.y1) for r in lines.collect()) == [(0, 84, 11, 100, 13), (1, 84, 13, 100, 15)]
    assert detectors.Yolo("layout", None, Session)(pages)[2] is None
    out = Pipeline(detector=detectors.Yolo("layout", "line", Session), recognizer=Reader(Stub, True, True), text_cleaning=False).run(pages)
    assert {r.page_id: r.result.count("line 16x2") for r in out.collect()} == {1: 2}


class Model:
    def detect(self, content):
        return [{"coordinate": [-5.2, 0, 20.9, 30], "label": "text", "score": 0.7}, {"coordinate": [5, 5, 5, 9], "label": "text"}, {"coordinate": [0, 50, 999, 100]}]


def test_boxes_of_another_detector(spark, monkeypatch):
    pages = spark.createDataFrame([(1, images.encode(np.zeros((100, 200, 3), np.uint8)))], "page_id long, content binary")
    _, regions, lines = detectors.Boxes(Model)(pages)
    assert [tuple(r) for r in regions.orderBy("region_idx").collect()] == [(1, 0, "text", 0, 0, 20, 30, "", 0.7), (1, 1, "unknown", 0, 50, 200, 100, "", 0.0)] and lines is None
    asked = []
    module(monkeypatch, "paddlex", create_model=lambda name: types.SimpleNamespace(predict=lambda path: asked.append(os.path.exists(path)) or [{"boxes": [1, 2]}, {}]))
    assert detectors.paddlex().factory().detect(b"x") == [1, 2] and asked == [True]


def test_models_are_looked_for(tmp_path):
    with pytest.raises(FileNotFoundError):
        detectors.yolo(model_dir=str(tmp_path))
    for name in detectors.FILES:
        (tmp_path / name).write_bytes(b"")
    made = detectors.yolo(model_dir=str(tmp_path))
    assert made.line_model.endswith(detectors.FILES[1]) and detectors.yolo(str(tmp_path), skip_lines=True).line_model is None
