"""What both ways of judging share: schema documents and references, and how keywords' values are read."""

from __future__ import annotations

import math
import re
from typing import Any
from urllib.parse import unquote, urljoin

from veridoc.functions.formats import SPACE

#: Stands for a keyword that the schema doesn't have.
_ABSENT = object()
TYPES = frozenset("null boolean integer number bigint string object array tuple map set regex".split())


class SchemaError(ValueError):
    """The schema can't be compiled."""


class BigInt(int):
    """A whole number in a schema that bounds bigints, and those alone."""


class Registry:
    """Schema documents by id and anchor, and references resolved against them."""

    def __init__(self, root: Any, others: dict[str, Any] | None = None) -> None:
        self.root, self.ids = root, {}
        self.dynamic: dict[tuple[str, str], Any] = {}
        self._found: dict[tuple[str, str], tuple[Any, str]] = {}
        for uri, document in {**(others or {}), "": root}.items():
            self._crawl(document, uri.rstrip("#"))

    def _crawl(self, node: Any, base: str) -> None:
        if isinstance(node, dict):
            if isinstance(node.get("$id"), str):
                base = urljoin(base, node["$id"]).rstrip("#")
            self.ids.setdefault(base, node)
            for keyword in ("$anchor", "$dynamicAnchor"):
                if isinstance(node.get(keyword), str):
                    self.ids[f"{base}#{node[keyword]}"] = node
            if isinstance(node.get("$dynamicAnchor"), str):
                self.dynamic[base, node["$dynamicAnchor"]] = node
            for key, value in node.items():
                if key not in ("enum", "const", "default", "examples"):
                    self._crawl(value, base)
        elif isinstance(node, list):
            for value in node:
                self._crawl(value, base)

    def find(self, ref: str, base: str) -> tuple[Any, str]:
        """The schema that a reference names, and the base of what it holds."""
        if (ref, base) not in self._found:
            self._found[ref, base] = self._find(ref, base)
        return self._found[ref, base]

    def _find(self, ref: str, base: str) -> tuple[Any, str]:
        full = urljoin(base, ref)
        uri, _, fragment = full.partition("#")
        if full in self.ids:
            return self.ids[full], uri
        if uri not in self.ids:
            raise SchemaError(f"unknown schema {uri!r}")
        node = self.root if uri == "" else self.ids[uri]
        for k, part in enumerate(pointer_parts(unquote(fragment))):
            if k and isinstance(node, dict) and isinstance(node.get("$id"), str):  # passed on the way, so what follows is relative to it
                uri = urljoin(uri, node["$id"]).rstrip("#")
            try:
                node = node[int(part)] if isinstance(node, list) else node[part]
            except (KeyError, IndexError, ValueError, TypeError):
                raise SchemaError(f"{ref!r} leads nowhere") from None
        return node, uri


def pointer_parts(pointer: str) -> list[str]:
    """The keys of a JSON pointer, after RFC 6901."""
    return [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]


def pointer(*parts: str | int) -> str:
    """A JSON pointer from keys and positions."""
    return "".join("/" + str(p).replace("~", "~0").replace("/", "~1") for p in parts)


def is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, (bool, BigInt))


def numberish(x: Any, spec: bool = False) -> int | float | None:
    """A keyword's value as a number: by the engine's rules null is 0, false 0, "5" is 5; in spec mode numbers only."""
    if is_number(x):
        return x
    if spec or isinstance(x, BigInt):
        return None
    if x is None:
        return 0.0
    if isinstance(x, bool):
        return float(x)
    if isinstance(x, str):
        try:
            return None if math.isnan(n := float(x.strip() or 0)) or "_" in x else n
        except ValueError:
            return None
    return None


def split_pattern(pattern: str, end: str) -> tuple[str, str]:
    """An ECMAScript pattern with `$` written as `end` and `\\s` as all white space; /re/flags is taken apart."""
    flags = ""
    if m := re.fullmatch(r"/(.+)/([a-z]*)", pattern, re.S):
        pattern, flags = m[1], "".join(x for x in m[2] if x in "ims")
    out, inside, k = [], False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            two = pattern[k : k + 2]
            out.append({r"\s": SPACE if inside else f"[{SPACE}]", r"\S": two if inside else f"[^{SPACE}]"}.get(two, two))
            k += 2
            continue
        if c == "[" and inside:
            out.append("\\")
        inside = (inside or c == "[") and c != "]"
        out.append(end if c == "$" and not inside and "m" not in flags else c)
        k += 1
    return "".join(out), flags


def java_pattern(pattern: str) -> str:
    """An ECMAScript pattern for Java."""
    text, flags = split_pattern(pattern, r"\z")
    return (f"(?{flags})" if flags else "") + text


def bounds(schema: dict, name: str, exclusive: str, spec: bool) -> list[tuple[float, bool]]:
    """(bound, whether it is exclusive) for each bound of one side; by the engine's rules an exclusive one replaces the other."""
    bound, strict = numberish(schema.get(name, _ABSENT), spec), schema.get(exclusive, _ABSENT)
    if strict is True:
        return [] if bound is None else [(bound, True)]
    strict = numberish(strict, spec)
    out = [] if strict is None else [(strict, True)]
    return out + [(bound, False)] if bound is not None and (spec or strict is None) else out


def big_bounds(schema: dict, name: str, exclusive: str) -> list[tuple[int, bool]]:
    """The same of bounds on bigints."""
    bound, strict = schema.get(name), schema.get(exclusive)
    if strict is True or isinstance(strict, BigInt):
        return [(int(bound if strict is True else strict), True)] if isinstance(strict, BigInt) or isinstance(bound, BigInt) else []
    return [(int(bound), False)] if isinstance(bound, BigInt) else []


def limit(schema: dict, name: str, spec: bool) -> int | None:
    """A size keyword; by the engine's rules one below 1 is ignored."""
    n = numberish(schema.get(name, _ABSENT), spec)
    return None if n is None or n != math.floor(n) or n < 1 and not spec else int(n)
