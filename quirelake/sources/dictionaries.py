"""Alphabets, label maps and model settings, read once by the driver."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def character_dict(yaml_text: str, key: str = "character_dict", space: bool = True) -> list[str]:
    """Alphabet of a recogniser, without the blank, from the block list ``key`` of
    a YAML file; the space is added as its last letter.

    Reads that list alone: plain, single- and double-quoted items.
    """
    out: list[str] = []
    depth = None
    for line in yaml_text.split("\n"):
        body = line.strip()
        if depth is None:
            if body == f"{key}:":
                depth = len(line) - len(line.lstrip())
            continue
        if not body:
            continue
        if not body.startswith("- ") and body != "-" or len(line) - len(line.lstrip()) < depth:
            break
        item = line.lstrip()[2:] if body != "-" else ""
        item = item.strip(" ") or item
        if len(item) > 1 and item[0] == item[-1] == "'":
            item = item[1:-1].replace("''", "'")
        elif len(item) > 1 and item[0] == item[-1] == '"':
            item = json.loads(item)
        out.append(item)
    if depth is None:
        raise KeyError(key)
    return [*out, " "] if space else out


def _by_number(names: dict[str, Any]) -> dict[int, Any]:
    return {int(k): names[k] for k in sorted(names, key=int)}


def id_to_token(path: str) -> dict[int, str]:
    """The ``id_to_token`` map of a JSON file (or the file's whole map), by id."""
    read = json.loads(Path(path).read_text(encoding="utf-8"))
    return _by_number(read.get("id_to_token", read))


def id_to_label(path: str) -> dict[int, str]:
    """The ``id2label`` map of a model's settings, by id."""
    return _by_number(json.loads(Path(path).read_text(encoding="utf-8"))["id2label"])


def model_settings(path: str, section: str = "text_config", **defaults: Any) -> dict[str, Any]:
    """Settings of a section (or of the file, where it has none), with defaults."""
    read = json.loads(Path(path).read_text(encoding="utf-8"))
    own = read.get(section, read)
    return {k: own.get(k, v) for k, v in defaults.items()}


def lookup_table(spark: SparkSession, names: dict[int, str]) -> DataFrame:
    """(id, name) rows of a closed label map, for joins."""
    return spark.createDataFrame(sorted(names.items()), "id int, name string")


def model_path(root: str, name: str, file: str, suffix: str = "") -> str:
    """root/name[suffix]/file."""
    return str(Path(root) / f"{name}{suffix}" / file)


def required_files(*paths: str) -> None:
    """An error that names the files that aren't there."""
    missing = [p for p in paths if not Path(p).is_file()]
    if missing:
        raise FileNotFoundError(", ".join(missing))
