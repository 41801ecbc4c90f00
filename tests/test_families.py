"""Model families over stand-in sessions, and the tokenizer functions."""

import numpy as np
import pytest

from quirelake.operators import families as fam
from quirelake.operators.models import REGISTRIES, Options

NONE = Options()


class Session:
    """Gives what a function makes of the feeds, and keeps these."""

    def __init__(self, run):
        self.give, self.fed = run, []

    def run(self, names, feeds):
        self.fed.append(feeds)
        return self.give(feeds)


def test_detector_boxes_are_on_the_page():
    def prob(feeds):
        n, _, h, w = feeds["x"].shape
        out = np.zeros((n, 1, h, w), np.float32)
        out[:, :, h // 4 : h // 2, w // 4 : w // 2] = 0.9
        return [out]

    s = Session(prob)
    found = fam.detector(s, 64, "max")([np.full((100, 200, 3), 255, np.uint8), np.zeros((80, 160, 3), np.uint8)], NONE)
    assert s.fed[0]["x"].shape == (2, 3, 32, 64) and len(found) == 2
    (quad,), (score,) = found[0]
    xs, ys = np.array(quad).T
    assert 36 < xs.min() < 55 and 95 < xs.max() < 115 and 10 < ys.min() < 27 and score > 0.85
    assert fam.detector_size(5000, 100, 64, "min") == (4000, 96) and fam.detector_size(1920, 1080, 960, "max") == (960, 544)
    with pytest.raises(ValueError):
        fam.detector_size(1, 1, 1, "none")


def test_recognizer_pads_to_the_widest():
    out = np.zeros((2, 3, 4), np.float32)
    out[0, :, 1], out[1, [0, 1, 2], [2, 0, 3]] = 0.8, (0.5, 0.9, 0.7)
    s = Session(lambda feeds: [out])
    found = fam.recognizer(s, "ab")([np.zeros((10, 100, 3), np.uint8), np.zeros((10, 20, 3), np.uint8)], NONE)
    assert s.fed[0]["x"].shape == (2, 3, 48, 480)
    assert found[0] == ("a", [pytest.approx(0.8)]) and found[1] == ("b", [pytest.approx(0.6)])
    assert fam.read_sequence(np.eye(3)[[0, 0]], "ab") == ("", [0.0])


def test_classifiers():
    s = Session(lambda feeds: [np.array([[0.1, 0.7, 0.7, 0.0]] * len(feeds["x"]))])
    page = np.zeros((300, 400, 3), np.uint8)
    labels = ("0", "90", "180", "270")
    assert fam.classifier(s, labels, fam.page_view)([page], NONE) == [(0.7, "90")] and s.fed[0]["x"].shape == (1, 3, 224, 224)
    assert fam.classifier(s, labels[:2], fam.line_view)([page], Options.of(k=3)) == [[(0.7, "90"), (0.7, "2"), (0.1, "0")]] and s.fed[1]["x"].shape == (1, 3, 80, 160)
    (score, label), = fam.classifier(s, labels, fam.figure_view, logits=True)([page], NONE)
    assert label == "90" and score == pytest.approx(np.exp(0.7) / (np.exp(0.7) * 2 + np.exp(0.1) + 1))


def test_box_layout_filters_and_suppresses():
    rows = np.array([[2, 0.9, 0, 0, 50, 50], [2, 0.8, 1, 1, 50, 50], [1, 0.9, -5, -5, 500, 500], [3, 0.4, 0, 0, 9, 9], [-1, 0.9, 0, 0, 9, 9], [5, 0.7, 90, 90, 120, 120], [4, 0.6, 130, 10, 140, 20]], float)
    s = Session(lambda feeds: [np.tile(rows, (len(feeds["image"]), 1))])
    found = fam.box_layout(s, fam.LABELS_17, 64)([np.zeros((100, 120, 3), np.uint8)] * 2, NONE)
    assert len(found) == 2 and [(c, label, box) for c, label, _, box in found[0]] == [(2, "text", (0, 0, 50, 50)), (5, "content", (90, 90, 120, 100))]
    assert fam.kept_boxes(rows[2:3], 120, 100, fam.LABELS_17, 0.5)[0][1] == "image"
    assert {c for c, *_ in fam.kept_boxes(rows, 200, 200, fam.LABELS_17, {2: 0.95, 3: 0.1})} == {3, 5, 4}
    assert fam.kept_boxes(rows[:0], 10, 10, fam.LABELS_17, 0.5) == []


def test_query_layout_reads_the_best_in_order():
    logits = np.full((1, 3, 2), -9.0)
    logits[0, 0, 1], logits[0, 1, 0], logits[0, 2, 1] = 2.0, 3.0, 0.0
    boxes = np.array([[[0.5, 0.5, 0.2, 0.4], [0.25, 0.25, 0.5, 0.5], [0.9, 0.9, 0.1, 0.1]]])
    order = np.full((1, 3, 3), -5.0)
    order[0, 0, 1] = 5.0  # query 1 gets more votes than query 0: it comes later
    s = Session(lambda feeds: [logits, boxes, order])
    image = [np.zeros((100, 200, 3), np.uint8)]
    plain = fam.query_layout(s, ("a", "b"), 32, 0.5)(image, NONE)[0]
    assert [(c, label) for c, label, *_ in plain] == [(0, "a"), (1, "b")] and plain[0][3] == (0, 0, 100, 50)
    ordered = fam.query_layout(s, ("a", "b"), 32, 0.5, inclusive=True, ordered=True)(image, NONE)[0]
    place = fam.order_of_votes(order[0])
    assert [q for q in np.argsort(place)] == [{(1, 0.8807970779778823): 0, (0, 0.9525741268224334): 1}.get((c, s), 2) for c, _, s, _ in ordered]
    assert fam.query_layout(s, ("a", "b"), 32, 0.9)(image, NONE)[0][0][1] == "a"


def test_order_of_votes_against_loops():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((7, 7))
    p = 1 / (1 + np.exp(-x))
    votes = [sum(p[i, j] for i in range(j)) + sum(1 - p[j, i] for i in range(j + 1, 7)) for j in range(7)]
    order = sorted(range(7), key=lambda j: (votes[j], j))
    assert [order.index(j) for j in range(7)] == fam.order_of_votes(x).tolist()


def test_generator():
    def step(state, ids):
        out = np.zeros((len(ids), 6))
        out[np.arange(len(ids)), [n if ids.shape[1] <= n else 2 for n in state]] = 1
        return out

    model = fam.Generator(lambda images, prompt: [int(x.mean()) for x in images], step, lambda ids: f" {prompt_free(ids)} ", start=0, end=2, most=9)
    found = model([np.full((2, 2, 3), 4, np.uint8), np.full((2, 2, 3), 3, np.uint8)], NONE)
    assert found == [("4 4 4 4", [4, 4, 4, 4, 2], -1.0), ("3 3 3", [3, 3, 3, 2], -1.0)]
    assert model([np.full((2, 2, 3), 5, np.uint8)], Options.of(max_tokens=2))[0][1] == [5, 5]


def prompt_free(ids):
    return " ".join(str(i) for i in ids if i != 2)


def test_families_are_registered_by_name():
    opened = []
    fam.register_families("/models", "ab", sessions=lambda path: opened.append(path) or Session(lambda feeds: [np.ones((1, 2))]))
    try:
        assert len(REGISTRIES["detection"].names()) == 7 and len(REGISTRIES["recognition"].names()) == 8 and len(REGISTRIES["layout"].names()) == 14
        REGISTRIES["line_orientation"].factory("PP-LCNet_x1_0_textline_ori")("PP-LCNet_x1_0_textline_ori", NONE)
        REGISTRIES["detection"].factory("PP-OCRv4_mobile_det")("PP-OCRv4_mobile_det", NONE)
        assert opened == ["/models/PP-LCNet_x1_0_textline_ori_onnx/inference.onnx", "/models/PP-OCRv4_mobile_det/model.onnx"]
        with pytest.raises(KeyError):
            REGISTRIES["layout"].factory("none")
    finally:
        for r in REGISTRIES.values():
            r.clear()


def test_tokenizer_functions(spark, sf_dir):
    names = pytest.importorskip("public_tokenizers")
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    from quirelake.functions import tokenizer

    path = names.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "the quick brown fox"), (2, None), (3, "")], "k int, t string")
    got = {r.k: (r.ids, r.back) for r in df.select("k", tokenizer.encode(F.col("t"), path).alias("ids")).select("k", "ids", tokenizer.decode(F.col("ids"), path).alias("back")).collect()}
    assert got == {1: (Tokenizer.from_file(path).encode("the quick brown fox").ids, "the quick brown fox"), 2: ([], ""), 3: ([], "")}


def test_generators_stand_under_their_names_and_tasks():
    from quirelake.operators.families import GENERATORS, Runtime, names_of, register_families
    from quirelake.operators.models import REGISTRIES, Options

    seen = []

    def runtimes(path, of):
        def step(new, kept):
            assert new.shape[1] == (2 if kept["n"] == 0 else 1)  # the prompt first, then a token a step
            scores = np.zeros((len(new), 200_000))
            end = (of.ends or (2,))[-1]
            for i, k in enumerate(kept["after"]):
                scores[i, end if kept["n"] >= k else 7 + kept["n"]] = 1
            return scores, kept | {"n": kept["n"] + 1}

        def encode(images, prompt):
            seen.append((path, prompt, len(images)))
            return np.zeros((len(images), 2), int), {"n": 0, "after": [int(x.mean()) for x in images]}

        return Runtime(encode, step, lambda ids: " " + ",".join(map(str, ids)) + " ", prepares=True)

    before = {task: dict(r._factories) for task, r in REGISTRIES.items()}
    try:
        register_families("/models", runtimes=runtimes, figures=("pie", "bar"))
        images = [np.full((4, 4, 3), n, np.uint8) for n in (1, 3)]
        for of in GENERATORS:
            for task, prompt in of.prompts.items():
                for name in of.names:
                    assert name in names_of(task) and REGISTRIES[task].is_registered(name)
                    seen.clear()
                    got = REGISTRIES[task].factory(name)(name, Options())(images, Options.of(temperature=0))
                    end = (of.ends or (2,))[-1]
                    assert got == [("7", [7, end], 1.0 if task == "caption" else -1.0), ("7,8,9", [7, 8, 9, end], 1.0 if task == "caption" else -1.0)]
                    assert seen == ([(f"/models/{name}", prompt, 1)] * 2 if of.one_at_a_time else [(f"/models/{name}", prompt, 2)])
        assert REGISTRIES["classify"].is_registered("DocumentFigureClassifier")
        assert {"Dolphin", "Dolphin-1.5", "unirec-0.1b", "Falcon-OCR", "Falcon-OCR-ONNX"} == REGISTRIES["table"].names() and len(REGISTRIES["formula"].names()) == 18
    finally:
        for task, r in REGISTRIES.items():
            r._factories = before[task]


def test_a_cached_loop_gives_what_an_uncached_one_does():
    from quirelake.operators.models import generate, generate_cached

    table = np.random.default_rng(3).standard_normal((40, 11))
    whole = lambda ids: table[ids.sum(axis=1) % 40]

    def step(new, kept):
        total = new.sum(axis=1) + (0 if kept is None else kept)
        return table[total % 40], total

    start = np.array([[1, 2], [3, 4], [0, 0]])
    for temperature in (0, 0.7):
        assert generate(whole, start, 5, 30, temperature) == generate_cached(step, start, (5,), 30, temperature)
