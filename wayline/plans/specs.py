"""Operators by name: serialisable specifications, and names of configurations."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial
from importlib import import_module

#: Packages whose functions a specification may name.
ALLOWED = ("wayline.",)


def spec(operator: Callable | str, *args, **kwargs) -> dict:
    """``module, name, args, kwargs`` of an operator or of its ``module:name``; a plain dictionary that JSON holds if the arguments do."""
    if isinstance(operator, str):
        module, colon, name = operator.partition(":")
        if not colon or ":" in name:
            raise ValueError(f"not of the form module:name: {operator}")
    else:
        module, name = operator.__module__, operator.__qualname__
    return {"module": module, "name": name, "args": list(args), "kwargs": kwargs}


def instantiate(given: Mapping) -> Callable:
    """The operator with the arguments filled in. Only functions of this library are looked up."""
    if set(given) != {"module", "name", "args", "kwargs"}:
        raise ValueError(f"not a specification: {given}")
    if not f"{given['module']}.".startswith(ALLOWED):
        raise ValueError(f"{given['module']} is not among the packages allowed")
    found = import_module(given["module"])
    for part in given["name"].split("."):
        found = getattr(found, part)
    return partial(found, *given["args"], **given["kwargs"])


def text_of(given: Mapping) -> str:
    """``module:name(args, k=v)``, which caches are keyed by."""
    args = [str(a) for a in given["args"]] + [f"{k}={v}" for k, v in given["kwargs"].items()]
    return f"{given['module']}:{given['name']}({', '.join(args)})"


def formatted(template: str, config: Mapping) -> str:
    """The template with the configuration's leaves filled in; names of nested ones are joined by underscores."""
    flat: dict[str, object] = {}

    def walk(x: Mapping, path: tuple[str, ...]) -> None:
        for k, v in x.items():
            if isinstance(v, Mapping):
                walk(v, (*path, k))
            else:
                flat["_".join((*path, k))] = v

    walk(config, ())
    return template.format(**flat)
