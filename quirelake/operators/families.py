"""Families of models over ONNX files: what goes in, and what comes out.

Each factory gives a batch function for ``plans.pipeline``. A session is any
object with ``run(names, feeds)``; ``onnx_session`` makes one of a file. No
weights come with this package, so sizes and thresholds are those published and
the code between image and result is tested with stand-in sessions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd

from ..functions import pixels, probmap, views
from ..schema import DOCLING_LABELS, LAYOUT_LABELS
from ..sources.dictionaries import model_path
from .layout import suppress
from .models import REGISTRIES, Model, Options, generate, generate_cached, onnx_session

# Fixed values of published models.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
DETECTORS_MAX = ("PP-OCRv5_server_det", "PP-OCRv5_mobile_det", "PP-OCRv4_server_det", "PP-OCRv4_mobile_det")
DETECTORS_MIN = ("PP-OCRv6_medium_det", "PP-OCRv6_small_det", "PP-OCRv6_tiny_det")
RECOGNIZERS = (
    "PP-OCRv6_medium_rec", "PP-OCRv6_small_rec", "PP-OCRv6_tiny_rec", "PP-OCRv5_server_rec", "PP-OCRv5_mobile_rec",
    "PP-OCRv4_server_rec", "PP-OCRv4_server_rec_doc", "PP-OCRv4_mobile_rec",
)
LABELS_17 = (
    "paragraph_title", "image", "text", "number", "abstract", "content", "figure_title", "formula", "table",
    "table_title", "reference", "doc_title", "footnote", "header", "algorithm", "footer", "seal",
)
LABELS_20 = (
    "paragraph_title", "image", "text", "number", "abstract", "content", "figure_title", "formula", "table", "reference",
    "doc_title", "footnote", "header", "algorithm", "footer", "seal", "chart", "formula_number", "aside_text", "reference_content",
)


def to_multiple(v: float, step: int = 32) -> int:
    """Nearest multiple, halves upwards, one step at least."""
    return max(int(np.floor(v / step + 0.5)) * step, step)


def detector_size(width: int, height: int, limit: int, kind: str, most: int = 4000) -> tuple[int, int]:
    """As ``boxes.detector_size``, for one image."""
    long, short = max(width, height), min(width, height)
    if kind not in ("max", "min", "resize_long"):
        raise ValueError(f"no such policy: {kind}")
    ratio = limit / long if kind == "resize_long" or (kind == "max" and long > limit) else limit / short if kind == "min" and short < limit else 1.0
    w, h = np.floor(width * ratio + 0.5), np.floor(height * ratio + 0.5)
    cap = most / max(w, h) if max(w, h) > most else 1.0
    return to_multiple(np.floor(w * cap + 0.5)), to_multiple(np.floor(h * cap + 0.5))


def detector(session, limit: int = 960, kind: str = "max", candidates: int = 1000) -> Model:
    """Images, padded to one size, to (quads, scores) each. ``limit_side_len``,
    ``limit_type``, ``thresh``, ``box_thresh`` and ``unclip_ratio`` are options of a call."""

    def model(items: Sequence[np.ndarray], options: Options) -> list:
        width, height = max(x.shape[1] for x in items), max(x.shape[0] for x in items)
        size = detector_size(width, height, int(options.number("limit_side_len", limit)), str(options.get("limit_type", kind)).lower())
        batch = [pixels.normalize(pixels.resize(pixels.pad_to(x, (width, height)), size), MEAN, STD) for x in items]
        (maps,) = session.run(None, {"x": pixels.pack(batch)})
        own = {"threshold": options.number("thresh", 0.3), "least_score": options.number("box_thresh", 0.6), "ratio": options.number("unclip_ratio", 1.5), "candidates": candidates}
        return [tuple(probmap.text_boxes(m.reshape(m.shape[-2:]), width, height, **own)) for m in maps]

    return model


def read_sequence(scores: np.ndarray, alphabet: Sequence[str]) -> tuple[str, list[float]]:
    """Text and mean score of (step, class) scores; class 0 is the blank, and one
    beyond the alphabet adds to the score alone."""
    best, top = scores.argmax(axis=1), scores.max(axis=1).astype(float)
    kept = (best != 0) & np.concatenate([[True], best[1:] != best[:-1]])
    text = "".join(alphabet[i - 1] for i in best[kept] if i <= len(alphabet))
    return text, [float(top[kept].mean()) if kept.any() else 0.0]


def recognizer(session, alphabet: Sequence[str], height: int = 48, base: int = 320, most: int = 3200) -> Model:
    """Line images, scaled to one height and padded to the widest, to (text, scores)."""

    def model(items: Sequence[np.ndarray], options: Options) -> list:
        ratio = max(base / height, *(x.shape[1] / x.shape[0] for x in items))
        width = min(int(height * ratio), most)
        (scores,) = session.run(None, {"x": np.stack([pixels.line_input(x, height, base, most, width) for x in items])})
        return [read_sequence(s, alphabet) for s in scores]

    return model


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def best_classes(scores: np.ndarray, labels: Sequence[str], k: int = 1) -> list[tuple[float, str]]:
    """The k best (score, label), ties to the lower class; one without a label is its number."""
    order = np.argsort(-scores, kind="stable")[:k]
    return [(float(scores[i]), labels[i] if i < len(labels) else str(i)) for i in order]


def classifier(session, labels: Sequence[str], prepare: Callable[[np.ndarray], np.ndarray], name: str = "x", logits: bool = False) -> Model:
    """Images to the best (score, label), or to a list of the ``k`` best where a call asks for more than one."""

    def model(items: Sequence[np.ndarray], options: Options) -> list:
        (scores,) = session.run(None, {name: pixels.pack([prepare(x) for x in items])})
        k = int(options.number("k", 1))
        found = [best_classes(s, labels, k) for s in (softmax(scores) if logits else scores)]
        return found if k > 1 else [f[0] for f in found]

    return model


def page_view(image: np.ndarray) -> np.ndarray:
    """Short side to 256, the middle 224 by 224."""
    return pixels.normalize(pixels.crop(pixels.resize_by_short(image, 256), (224, 224)), MEAN, STD)


def line_view(image: np.ndarray) -> np.ndarray:
    return pixels.normalize(pixels.resize(image, (160, 80)), MEAN, STD)


def figure_view(image: np.ndarray) -> np.ndarray:
    return pixels.normalize(pixels.resize(image, (224, 224)), MEAN, (0.47853944, 0.4732864, 0.47434163))


def kept_boxes(rows: np.ndarray, width: int, height: int, labels: Sequence[str], threshold: float | dict[int, float], nms: bool = True) -> list[tuple]:
    """(class, label, score, box) of a head's (class, score, left, top, right, bottom) rows.

    In order: threshold of all or of each class, suppression, images over nearly
    the whole page, clipping.
    """
    limit = np.array([threshold.get(int(c), 0.5) for c in rows[:, 0]]) if isinstance(threshold, dict) else threshold
    rows = rows[(rows[:, 1] > limit) & (rows[:, 0] > -1)]
    if nms and len(rows):
        order = np.argsort(-rows[:, 1], kind="stable")
        frame = pd.DataFrame(rows[order], columns=["cls", "score", "x1", "y1", "x2", "y2"]).assign(det_id=np.arange(len(rows)))
        rows = suppress(frame, 0.6, 0.98)[["cls", "score", "x1", "y1", "x2", "y2"]].to_numpy()
    clip = np.clip(rows[:, 2:6], 0, [width, height, width, height])
    if len(rows) > 1:
        most = (0.82 if width > height else 0.93) * width * height
        image = np.array([labels[int(c)] == "image" if int(c) < len(labels) else False for c in rows[:, 0]])
        stay = ~(image & ((clip[:, 2] - clip[:, 0]) * (clip[:, 3] - clip[:, 1]) > most))
        rows, clip = (rows[stay], clip[stay]) if stay.any() else (rows, clip)
    whole = (clip[:, 2] > clip[:, 0]) & (clip[:, 3] > clip[:, 1])
    name = lambda c: labels[c] if c < len(labels) else str(c)
    return [(int(r[0]), name(int(r[0])), float(r[1]), tuple(map(float, b))) for r, b in zip(rows[whole], clip[whole], strict=True)]


def box_layout(session, labels: Sequence[str], size: int, threshold: float | dict[int, float] = 0.5, nms: bool = True, mean=0.0, std=1.0) -> Model:
    """A layout head that gives boxes of the page itself: rows of class, score, box."""

    def model(items: Sequence[np.ndarray], options: Options) -> list:
        shapes = np.array([[size, size]] * len(items), np.float32)
        scale = np.array([[size / x.shape[0], size / x.shape[1]] for x in items], np.float32)
        image = pixels.pack([pixels.normalize(pixels.resize(x, (size, size), "cubic"), mean, std) for x in items])
        rows = np.asarray(session.run(None, {"image": image, "im_shape": shapes, "scale_factor": scale})[0]).reshape(len(items), -1, 6)
        limit = options.get("threshold", threshold)
        return [kept_boxes(r, x.shape[1], x.shape[0], labels, limit, nms) for r, x in zip(rows, items, strict=True)]

    return model


def order_of_votes(logits: np.ndarray) -> np.ndarray:
    """Place of each query by pairwise votes: upper scores against it from those
    before, the rest of its own from those after; ties by query."""
    p = 1 / (1 + np.exp(-logits))
    up = np.triu(p, 1)
    votes = up.sum(axis=0) + np.tril(1 - p.T, -1).sum(axis=0)
    place = np.empty(len(votes), int)
    place[np.argsort(votes, kind="stable")] = np.arange(len(votes))
    return place


def query_layout(session, labels: Sequence[str], size: int, threshold: float, inclusive: bool = False, ordered: bool = False, kind: str = "cubic") -> Model:
    """A layout head of queries: class scores, centre boxes and, where ``ordered``, pairwise order.

    The best of all (query, class) scores are read, as many as there are queries;
    no suppression. In reading order where the head gives one.
    """

    def model(items: Sequence[np.ndarray], options: Options) -> list:
        found = session.run(None, {"pixel_values": pixels.pack([pixels.normalize(pixels.resize(x, (size, size), kind), 0.0, 1.0) for x in items])})
        limit, out = options.number("threshold", threshold), []
        for i, x in enumerate(items):
            scores = 1 / (1 + np.exp(-found[0][i].astype(float)))
            flat = np.argsort(-scores.ravel(), kind="stable")[: len(scores)]
            query, cls = np.divmod(flat, scores.shape[1])
            s = scores[query, cls]
            keep = s >= limit if inclusive else s > limit
            cx, cy, w, h = found[1][i][query].astype(float).T
            box = np.stack([cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2], axis=1) * [x.shape[1], x.shape[0], x.shape[1], x.shape[0]]
            rows = np.flatnonzero(keep)
            if ordered:
                rows = rows[np.argsort(order_of_votes(found[2][i])[query[rows]], kind="stable")]
            out.append([(int(cls[r]), labels[cls[r]] if cls[r] < len(labels) else str(cls[r]), float(s[r]), tuple(map(float, box[r]))) for r in rows])
        return out

    return model


LABELS_23 = (
    "paragraph_title", "image", "text", "number", "abstract", "content", "figure_title", "formula", "table", "table_title", "reference", "doc_title",
    "footnote", "header", "algorithm", "footer", "seal", "chart_title", "chart", "formula_number", "header_image", "footer_image", "aside_text",
)
# Fixed values of published box layout heads: labels, side, and whether colours are standardised.
BOX_LAYOUTS = {
    "PP-DocLayoutV2": (LAYOUT_LABELS, 800, False),
    "PP-DocLayout_plus-L": (LABELS_20, 800, False),
    "PP-DocLayout-L": (LABELS_23, 640, False),
    "PP-DocLayout-M": (LABELS_23, 640, True),
    "PP-DocLayout-S": (LABELS_23, 480, True),
    "PicoDet-S_layout_17cls": (LABELS_17, 480, True),
    "PicoDet-L_layout_17cls": (LABELS_17, 640, True),
    "RT-DETR-H_layout_17cls": (LABELS_17, 640, False),
}
QUERY_LAYOUTS = ("docling-layout-egret-large", "docling-layout-egret-medium", "docling-layout-egret-xlarge", "docling-layout-heron", "docling-layout-heron-101")


@dataclass(frozen=True)
class Generator:
    """A model that writes text: ``encode(images, prompt)`` gives what ``step(state,
    ids)`` needs to score the next token, ``decode(ids)`` makes text of ids."""

    encode: Callable
    step: Callable
    decode: Callable[[list[int]], str]
    start: int
    end: int
    most: int
    clean: Callable[[str], str] = str.strip
    prompt: str = ""
    temperature: float = 0.0

    def __call__(self, items: Sequence[np.ndarray], options: Options) -> list:
        """(text, ids, -1) of each item, the whole batch in one loop."""
        state = self.encode(items, options.get("prompt", self.prompt))
        ids = generate(lambda x: self.step(state, x), np.full(len(items), self.start), self.end, int(options.number("max_tokens", self.most)), options.number("temperature", self.temperature), int(options.number("seed", 42)))
        return [(self.clean(self.decode(row)), row, -1.0) for row in ids]


#: Own default where no most tokens are published; a call's ``max_tokens`` goes before it.
MOST_TOKENS = 4096


@dataclass(frozen=True)
class Published:
    """What is published of a generator: names, the prompt of each task it stands
    under, ids that end a text (none: a call's ``end``, 2 without one, as the
    model's own settings tell), most tokens, whether it takes one image at a
    time, the temperature, and the view of an image that its encoder takes (none:
    the image). The first ids are the runtime's to give."""

    names: tuple[str, ...]
    prompts: dict[str, str]
    ends: tuple[int, ...] = ()
    most: int = MOST_TOKENS
    one_at_a_time: bool = False
    temperature: float = 0.0
    view: Callable[[np.ndarray], object] | None = None


def _clip(side: int) -> Callable:
    return lambda x: views.square(x, side, views.CLIP_MEAN, views.CLIP_STD)


# Fixed values of published generators.
GENERATORS = (
    Published(("PP-FormulaNet-L", "PP-FormulaNet_plus-L"), {"formula": ""}, (2,), 1537, view=lambda x: views.formula_view(x, 768)),
    Published(("PP-FormulaNet-S", "PP-FormulaNet_plus-S", "PP-FormulaNet_plus-M"), {"formula": ""}, (2,), view=lambda x: views.formula_view(x, 384)),
    Published(("pix2text-mfr",), {"formula": ""}, most=513, view=lambda x: views.square(x, 384)),
    Published(("pix2text-mfr-1.5",), {"formula": ""}, most=1025, view=lambda x: views.square(x, 384)),
    Published(("TexTeller",), {"formula": ""}, view=views.gray_view),
    Published(("nougat-latex-base",), {"formula": ""}, view=lambda x: views.framed_view(x, (560, 224))),
    Published(("granite-docling-258M",), {"formula": "Convert formula to LaTeX."}, (100257,), 8192, one_at_a_time=True, view=views.tiled_view),
    Published(("CodeFormulaV2",), {"formula": "<formula>"}, (100338,), 8192, one_at_a_time=True, view=views.tiled_view),
    Published(("Dolphin", "Dolphin-1.5"), {"formula": "Read formula in the image.", "table": "Parse the table in the image."}, (2,), 4096, view=lambda x: views.framed_view(x, (896, 896), 255)),
    Published(("unirec-0.1b",), {"formula": "", "table": ""}, (2,), 2048, one_at_a_time=True, view=views.fitted_view),
    Published(("Falcon-OCR", "Falcon-OCR-ONNX"), {"formula": "Extract the formula content from this image.", "table": "Extract the table content from this image."}, (11, 263)),
    Published(("GOT-OCR-2.0",), {"formula": "OCR with format: "}, (151645,), 4096, view=_clip(1024)),
    Published(("LlamaJCpp-OCR",), {"formula": "Extract all text from the image."}, (), 2048, one_at_a_time=True, temperature=0.2),
    Published(("GLM-OCR",), {"page_text": "OCR:"}, (59246,), one_at_a_time=True, view=views.budget_view),
    Published(("LightOnOCR-2-1B", "LightOnOCR-2-1B-ONNX"), {"page_text": ""}, (), 4096, view=views.capped_view),
    Published(("llava-onevision-qwen2-0.5b-ov-hf",), {"page_text": "OCR"}, (151645, 151643), 4096, view=lambda x: views.square(x, 384)),
    Published(("Qwen3-VL-2B-Instruct",), {"page_text": "Convert this formula image to LaTeX."}, (151645, 151643), 4096, view=views.grid_view),
    Published(("blip",), {"caption": ""}, (102,), 512, view=_clip(384)),
)


def names_of(task: str) -> list[str]:
    """Published generators of a task."""
    return sorted(n for g in GENERATORS if task in g.prompts for n in g.names)


@dataclass(frozen=True)
class Runtime:
    """A generator's networks: ``encode(views, prompt)`` gives the first ids and
    what the first step needs (images, where the runtime prepares them itself), ``step(new ids, kept)`` scores and what is kept
    (see ``generate_cached``), ``decode(ids)`` the text of ids."""

    encode: Callable
    step: Callable
    decode: Callable[[list[int]], str]
    prepares: bool = False


def published_generator(runtime: Runtime, of: Published, task: str) -> Model:
    """(text, ids, score) of each image; a caption's score is 1, others have none (-1).

    A model of one image at a time takes the items of a call one by one.
    """
    score = 1.0 if task == "caption" else -1.0

    def some(items: Sequence[np.ndarray], options: Options) -> list:
        items = items if of.view is None or runtime.prepares else [of.view(x) for x in items]
        start, first = runtime.encode(items, options.get("prompt", of.prompts[task]))
        step = lambda new, kept: runtime.step(new, first if kept is None else kept)
        ends = of.ends or (int(options.number("end", 2)),)
        ids = generate_cached(step, start, ends, int(options.number("max_tokens", of.most)), options.number("temperature", of.temperature), int(options.number("seed", 42)))
        texts = [runtime.decode([t for t in row if t not in ends]).strip() for row in ids]
        return [(t, row, score) for t, row in zip(texts, ids, strict=True)]

    def model(items: Sequence[np.ndarray], options: Options) -> list:
        return [x for item in items for x in some([item], options)] if of.one_at_a_time else some(items, options)

    return model


def no_runtime(path: str, of: Published) -> Runtime:
    raise NotImplementedError(f"give register_families the runtimes of {path}")


def register_families(
    root: str, alphabet: Sequence[str] = (), sessions: Callable[[str], object] = onnx_session, runtimes: Callable[[str, Published], Runtime] = no_runtime, figures: Sequence[str] = ()
) -> None:
    """Put the families under their published names, over files below ``root``.

    A file is opened by the first call of a worker that asks for the model.
    Generators run on what ``runtimes(folder, published)`` gives; ``figures`` are
    the labels of the figure classifier.
    """

    def over(build: Callable, file: str = "inference.onnx", suffix: str = "_onnx"):
        return lambda name, options: build(sessions(model_path(root, name, file, suffix)), options)

    put = lambda task, names, factory: REGISTRIES[task].register(names, factory)
    put("detection", DETECTORS_MAX, over(lambda s, o: detector(s), "model.onnx", ""))
    put("detection", DETECTORS_MIN, over(lambda s, o: detector(s, 64, "min", 3000)))
    put("recognition", RECOGNIZERS, over(lambda s, o: recognizer(s, alphabet)))
    put("doc_orientation", "PP-LCNet_x1_0_doc_ori", over(lambda s, o: classifier(s, ("0", "90", "180", "270"), page_view)))
    put("line_orientation", ("PP-LCNet_x1_0_textline_ori", "PP-LCNet_x0_25_textline_ori"), over(lambda s, o: classifier(s, ("0_degree", "180_degree"), line_view)))
    for name, (labels, side, standard) in BOX_LAYOUTS.items():
        put("layout", name, over(lambda s, o, a=(labels, side), b=(MEAN, STD) if standard else (0.0, 1.0): box_layout(s, *a, mean=b[0], std=b[1])))
    put("layout", "PP-DocLayoutV3", over(lambda s, o: query_layout(s, LAYOUT_LABELS, 800, 0.5, inclusive=True, ordered=True)))
    put("layout", QUERY_LAYOUTS, over(lambda s, o: query_layout(s, DOCLING_LABELS, 640, 0.3, kind="area")))
    put("classify", "DocumentFigureClassifier", over(lambda s, o: classifier(s, figures, figure_view, "input", logits=True), "model.onnx", ""))
    for of in GENERATORS:
        for task in of.prompts:
            for name in of.names:
                put(task, name, lambda n, o, of=of, task=task: published_generator(runtimes(f"{root}/{n}", of), of, task))
