"""Script files: statements, comments, and the runner's commands."""

from __future__ import annotations

import re

from .engine import Engine, split_statements
from .errors import StatementError
from .sources import datasets


def run(engine: Engine, script: str, data: str = "", modules: dict[str, dict] | None = None) -> list:
    """Results of a script's queries, in order.

    ``--create topic``, ``--delete topic`` and ``--load data`` are taken as commands: all data sets that a script loads into a topic are
    bound to it before a stream reads it.  ``set`` is of the command line's display and only kept.  ``register_wasm`` and
    ``unregister_wasm`` name a module by its file; its functions come from ``modules``, by the file's name without ending.
    """
    sets = datasets.read(data) if data else {}
    loads = re.findall(r"^--load data (\w+)", script, re.MULTILINE)
    by_topic: dict[str, list[str]] = {}
    for name in loads:
        if name in sets and name not in by_topic.setdefault(sets[name][0], []):
            by_topic[sets[name][0]].append(name)
    for topic, names in by_topic.items():
        engine.bind_topic(topic, datasets.topic(engine.spark, data, names))
    out = []
    for text in split_statements(re.sub(r"wait for results(.|\n)*?rows? returned", "", script)):
        bare = re.sub(r"(?m)^\s*--[^\n]*$", "", text).strip()
        if not bare:
            continue
        if setting := re.fullmatch(r"set\s+(\w+)\s+(\d+)", bare):
            engine.settings[setting[1]] = int(setting[2])
        elif module := re.fullmatch(r"(un)?register_wasm\s*\(\s*\"?(?:.*/)?([^/\"]+?)(?:\.\w+)?\"?\s*\)", bare, re.DOTALL):
            name = module[2]
            try:
                if module[1]:
                    engine.unregister_module(name)
                elif name in (modules or {}):
                    engine.register_module(name, modules[name])
                else:
                    raise StatementError(f"there are no functions for module {name!r}")
            except StatementError as e:
                out.append(e)
        else:
            try:
                found = engine.execute(bare)
            except StatementError as e:
                out.append(e)
                continue
            if found is not None:
                out.append(found)
    return out
