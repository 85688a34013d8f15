"""The engine that schemas and formats are registered with; it compiles validators."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame

from veridoc.plans.drafts import IDS, by_version
from veridoc.plans.pointers import TraverseOptions
from veridoc.plans.registry import SchemaError
from veridoc.plans.schema import Rules, Validator, judge_document


class ValidationOptions(NamedTuple):
    """skip_errors: records are made only where they are asked for. Without it `Engine.mark` adds them to every table."""

    skip_errors: bool = True


class ValidatorOptions(NamedTuple):
    """What an engine starts with."""

    formats: dict[str, Callable[[Column], Column]] = {}
    schemas: tuple[Any, ...] = ()
    validation: ValidationOptions = ValidationOptions()
    traverse: TraverseOptions = TraverseOptions()
    mode: str = "compat"


class Engine:
    """Registered schemas, meta-schemas and formats. Ids are compared without a trailing `#`."""

    def __init__(self, schemas: list[Any] | None = None, formats: dict[str, Callable[[Column], Column]] | None = None, mode: str = "compat") -> None:
        self.schemas: dict[str, Any] = {}
        self.metas: dict[str, Any] = {}
        self.formats, self.mode, self.validation = dict(formats or {}), mode, ValidationOptions()
        for schema in schemas or ():
            self.add_schema(schema)

    @classmethod
    def of(cls, options: ValidatorOptions) -> Engine:
        out = cls(list(options.schemas), options.formats, options.mode)
        out.validation = options.validation
        return out

    def mark(self, df: DataFrame, schema: Any, column: str | dict[str, str] | None = None) -> DataFrame:
        """df with the verdict on each row, and with its records unless the options skip them."""
        judge = self.compile(schema)
        marked = judge.mark(df, column)
        return marked if self.validation.skip_errors else judge.with_errors(marked, column if column is not None else {c: f"`{c}`" for c in df.columns})

    def compile_async(self, schema: Any) -> Validator:
        """Declared, and not to be had: a schema compiles at once."""
        raise NotImplementedError("compile")

    def add_format(self, name: str, predicate: Callable[[Column], Column]) -> Engine:
        """A format as a predicate on a VARIANT Column."""
        return self.add_formats({name: predicate})

    def add_formats(self, formats: dict[str, Callable[[Column], Column]]) -> Engine:
        for name, predicate in formats.items():
            if not callable(predicate):
                raise SchemaError(f"format {name!r} is no function")
            self.formats[name] = predicate
        return self

    @staticmethod
    def _store(known: dict[str, Any], schema: Any, key: str | None) -> str | None:
        """Stored by key, else by its id; boolean schemas are left out, as nothing can name them."""
        if not isinstance(schema, dict):
            return None
        name = key if key is not None else schema.get("$id")
        if not isinstance(name, str):
            raise SchemaError("a schema needs an id or a key")
        name = name.rstrip("#")
        if name in known:
            raise SchemaError(f"schema {name!r} is known already")
        known[name] = schema
        return name

    def add_schema(self, schema: Any, key: str | None = None) -> Engine:
        """A schema that others may refer to; a list is stored as key[0], key[1] and so on, or by their ids."""
        if isinstance(schema, list):
            for k, one in enumerate(schema):
                self._store(self.schemas, one, None if key is None else f"{key}[{k}]")
        else:
            self._store(self.schemas, schema, key)
        return self

    def add_meta_schema(self, schema: Any, key: str | None = None) -> Engine:
        """A meta-schema; of a list the first is the root, the others are what it refers to."""
        root, *parts = schema if isinstance(schema, list) else [schema]
        for part in parts:
            self._store(self.schemas, part, None)
        self._store(self.metas, root, key)
        return self

    def add_draft(self, version: int) -> Engine:
        """The published meta-schema of draft 6, 7, 2019 (09) or 2020 (12), with the vocabularies that it refers to."""
        return self.add_meta_schema(by_version(version)[1])

    def get_schema(self, key: str) -> Any | None:
        return self.schemas.get(key.rstrip("#"))

    def validate_schema(self, schema: Any) -> bool:
        """Whether a schema obeys the meta-schema that it names, draft 6 by default; true while none is registered, false for an unknown one.

        Meta-schemas are read as JSON Schema has it, in either mode.
        """
        if not self.metas:
            return True
        name = schema.get("$schema") if isinstance(schema, dict) else None
        meta = self.metas.get((name or IDS[6]).rstrip("#"))
        return meta is not None and judge_document(Rules(meta, self.schemas, "spec"), schema)

    def compile(self, schema: Any, schemas: list[Any] | dict[str, Any] | None = None) -> Validator:
        others = dict(self.schemas)
        for key, one in schemas.items() if isinstance(schemas, dict) else ((None, s) for s in schemas or ()):
            self._store(others, one, key)
        return Validator(schema, others=others, mode=self.mode, custom=self.formats)
