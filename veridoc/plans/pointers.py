"""References as objects: a URI taken apart into document, query and fragment, and how schemas are traversed."""

from __future__ import annotations

import re
from typing import Any, NamedTuple
from urllib.parse import quote, unquote, urljoin, urlsplit

from veridoc.functions.formats import PATTERNS
from veridoc.plans.registry import SchemaError


class JsonPointerOptions(NamedTuple):
    """Whether anchors are known in all documents, whether they are known at all, whether parts that are no schemas are passed over."""

    anchors_global: bool = True
    anchors_allowed: bool = True
    skip_errors: bool = True


class TraverseOptions(NamedTuple):
    """The URI of a schema that has none, whether keywords beside a reference are merged with its target, and the pointers' options."""

    origin: str = "urn:veridoc:root"
    merge_schemas: bool = True
    anchors_global: bool = True
    anchors_allowed: bool = True
    skip_errors: bool = True

    @property
    def pointers(self) -> JsonPointerOptions:
        return JsonPointerOptions(self.anchors_global, self.anchors_allowed, self.skip_errors)


class JsonPointer(NamedTuple):
    """id: the whole; search: the query; document: what stands before it, with a `#`; fragment: an anchor, a pointer, or None."""

    id: str
    search: str | None
    document: str
    fragment: str | None


def create_pointer(ref: Any, base: Any = None, options: JsonPointerOptions | None = None) -> JsonPointer:
    """A reference resolved against a base; either may be missing. A fragment that is neither anchor nor pointer is left out."""
    options = options or JsonPointerOptions()
    given = [x for x in (ref, base) if isinstance(x, str) and x.strip()]
    if not given:
        raise SchemaError("neither a reference nor a base is given")
    full = urljoin(given[1], given[0]) if len(given) > 1 else given[0]
    if not urlsplit(full).scheme:
        raise SchemaError(f"{full!r} has no scheme")
    uri, _, fragment = full.partition("#")
    left, _, search = uri.partition("?")
    document = f"{left}#"
    if fragment.startswith("/"):
        return JsonPointer(document + fragment, search or None, document, fragment)
    if options.anchors_allowed and re.fullmatch(PATTERNS["html-identifier"], fragment, re.ASCII):
        return JsonPointer(("" if options.anchors_global else left) + f"#{fragment}", search or None, document, fragment)
    return JsonPointer(document, search or None, document, None)


def encode_path(path: str, *keys: str | int) -> str:
    """A path with further keys, escaped and percent-encoded."""
    return path + "".join("/" + quote(str(k).replace("~", "~0").replace("/", "~1"), safe="!'()*~") for k in keys)


def decode_path(path: str) -> list[str]:
    return [unquote(p).replace("~1", "/").replace("~0", "~") for p in path.split("/")[1:]]
