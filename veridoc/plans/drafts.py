"""The published meta-schemas of drafts 6, 7, 2019-09 and 2020-12, and their names."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from veridoc.plans.registry import SchemaError

# The files beside this module hold the documents as json-schema.org publishes them, each under its id.
FILES = Path(__file__).parent / "metaschemas"
IDS = {
    6: "http://json-schema.org/draft-06/schema",
    7: "http://json-schema.org/draft-07/schema",
    2019: "https://json-schema.org/draft/2019-09/schema",
    2020: "https://json-schema.org/draft/2020-12/schema",
}
VOCABULARIES = {
    6: (),
    7: (),
    2019: ("core", "applicator", "validation", "meta-data", "format", "content"),
    2020: ("core", "applicator", "unevaluated", "validation", "meta-data", "format-annotation", "content"),
}
ALIASES = {
    "6": 6,
    "draft6": 6,
    "draft-6": 6,
    "draft06": 6,
    "draft-06": 6,
    "7": 7,
    "draft7": 7,
    "draft-7": 7,
    "draft07": 7,
    "draft-07": 7,
    "draft2019": 2019,
    "draft-2019": 2019,
    "draft2019-09": 2019,
    "2019": 2019,
    "2019-09": 2019,
    "draft2020": 2020,
    "draft-2020": 2020,
    "draft2020-12": 2020,
    "2020": 2020,
    "2020-12": 2020,
}


def _read(uri: str) -> dict[str, Any]:
    return json.loads((FILES / (uri.split("json-schema.org/")[1].replace("/", "_") + ".json")).read_text())


def by_version(version: int) -> tuple[str, list[dict[str, Any]]]:
    """(id, the meta-schema and the vocabularies that it refers to)."""
    if version not in IDS:
        raise SchemaError(f"unknown draft {version!r}")
    parts = [IDS[version].removesuffix("schema") + f"meta/{name}" for name in VOCABULARIES[version]]
    return IDS[version], [_read(uri) for uri in (IDS[version], *parts)]


def by_name(name: str) -> tuple[str, list[dict[str, Any]]]:
    if name not in ALIASES:
        raise SchemaError(f"unknown draft {name!r}")
    return by_version(ALIASES[name])


def by_id(uri: str) -> tuple[str, list[dict[str, Any]]]:
    for version, known in IDS.items():
        if known.lower() == uri.lower().rstrip("#"):
            return by_version(version)
    raise SchemaError(f"unknown draft {uri!r}")
