"""The engine as a process: one command, or a server on standard input.

``python -m pagewright --home PATH COMMAND ...`` prints an envelope as JSON; the exit code is the error's.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from typing import Any

from pagewright.errors import EngineError
from pagewright.plans import dsl, ports, serve, spec
from pagewright.plans.config import Config

SHELLS = ("bash", "zsh", "fish")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagewright")
    p.add_argument("--home", required=True, help="folder of the knowledge base, in any store that Spark reads")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple[str, dict]) -> None:
        c = commands.add_parser(name)
        for flag, options in arguments:
            c.add_argument(flag, **options)

    number, flag = {"type": int}, {"action": "store_true"}
    command("init")
    command("add", ("path", {}), ("--parser", {"default": "auto"}))
    command("ingest", ("dirs", {"nargs": "+"}), ("--max-files", number), ("--parser", {"default": "auto"}))
    command("search", ("query", {}), ("--mode", {"default": "hybrid"}), ("--limit", number), ("--expand", flag), ("--max-blocks", number | {"default": 12}), ("--max-chars", number | {"default": 8000}), ("--rerank", flag), ("--tag", {}), ("--concept", {}), ("--doc", {}))
    command("read", ("id", {}), ("--mode", {"default": "text"}))
    command("list", ("--limit", number | {"default": 100}), ("--tag", {}), ("--concept", {}))
    command("remove", ("id", {}), ("--purge", flag))
    command("explain", ("result_id", {}))
    command("enrich", ("id", {}))
    for name in ("reindex", "reindex-vector", "doctor", "capabilities", "serve"):
        command(name)
    command("taxonomy", ("action", {"choices": ("add", "list", "relations", "relate", "assign", "import")}), ("values", {"nargs": "*"}))
    command("config", ("action", {"choices": ("show", "get", "set")}), ("values", {"nargs": "*"}))
    command("execute", ("program", {"help": "JSON of a program, or @FILE"}))
    command("completions", ("shell", {"choices": SHELLS}))
    return p


def completions(shell: str) -> str:
    """A script that completes the names of commands."""
    names = " ".join(next(a for a in _parser()._actions if a.dest == "command").choices)
    return {"bash": f"complete -W '{names}' pagewright\n", "zsh": f"#compdef pagewright\n_arguments '1:command:({names})'\n", "fish": f"complete -c pagewright -f -a '{names}'\n"}[shell]


def _taxonomy(engine, action: str, values: list[str]) -> Any:
    acts: dict[str, tuple[int, Callable]] = {
        "add": (2, lambda scheme, label: {"concept_id": engine.add_concept(scheme, label)}),
        "list": (0, engine.concepts),
        "relations": (1, engine.relations),
        "relate": (3, lambda a, b, relation: engine.relate(a, b, relation.upper())),
        "assign": (2, engine.assign),
        "import": (1, engine.import_concepts),
    }
    n, act = acts[action]
    if len(values) != n:
        raise EngineError("E_INVALID_INPUT", f"taxonomy {action} takes {n} values")
    return act(*values)


def _config(config: Config, action: str, values: list[str]) -> Any:
    if action == "show":
        return config.show()
    if len(values) != (1 if action == "get" else 2):
        raise EngineError("E_INVALID_INPUT", f"config {action} takes a key" + (" and a value" if action == "set" else ""))
    return {values[0]: config.get(values[0]) if action == "get" else config.set(values[0], values[1])}


def embedder_of(config: dict[str, Any]) -> ports.Embedder | None:
    """The embedding service of a configuration, if it names one."""
    if "embed.base_url" not in config:
        return None
    post = ports.post_to(config["embed.base_url"], config.get("embed.api_key"))
    return ports.over_http(post, config.get("embed.model", ""), int(config.get("embed.dimensions", 0)))


def main(args: list[str], out=sys.stdout, lines=sys.stdin) -> int:
    given = _parser().parse_args(args)
    if given.command == "completions":
        out.write(completions(given.shell))
        return 0
    from pyspark.sql import SparkSession

    from pagewright.plans.engine import Engine

    spark = SparkSession.builder.getOrCreate()
    config = Config(spark, given.home)

    def run() -> Any:
        values = config.load()
        e = Engine(spark, given.home, embedder=embedder_of(values), reranker=ports.lexical, config=values)
        g = given
        if g.command == "ingest":
            report = e.ingest(g.dirs, g.max_files, g.parser)
            sys.stderr.writelines(f"{x}\n" for x in serve.progress(report, [f["path"] for f in report["failures"]]))
            return report
        acts: dict[str, Callable[[], Any]] = {
            "init": e.init,
            "add": lambda: e.add(g.path, g.parser),
            "search": lambda: e.search(g.query, g.mode, g.limit, g.expand, g.max_blocks, g.max_chars, g.rerank, g.tag, g.concept, g.doc),
            "read": lambda: e.read(g.id, g.mode),
            "list": lambda: e.list(g.limit, g.tag, g.concept),
            "remove": lambda: e.remove(g.id, g.purge),
            "explain": lambda: e.explain(g.result_id),
            "enrich": lambda: e.enrich(g.id),
            "reindex": e.reindex,
            "reindex-vector": e.reindex_vector,
            "doctor": e.doctor,
            "capabilities": spec.capabilities,
            "taxonomy": lambda: _taxonomy(e, g.action, g.values),
            "config": lambda: _config(config, g.action, g.values),
            "execute": lambda: dsl.execute(program(g.program), dsl.dispatch(e)),
        }
        return acts[g.command]()

    if given.command == "serve":
        engine = Engine(spark, given.home, embedder=embedder_of(config.load()), config=config.load())
        for reply in serve.serve(lines, dsl.dispatch(engine)):
            out.write(f"{reply}\n")
            out.flush()
        return 0
    envelope, code = serve.envelope(given.command, run)
    out.write(json.dumps(envelope, default=str) + "\n")
    return code


def program(text: str) -> list:
    try:
        if text.startswith("@"):
            with open(text[1:], encoding="utf-8") as f:
                text = f.read()
        return json.loads(text)
    except (OSError, ValueError) as e:
        raise EngineError("E_INVALID_INPUT", f"no program: {e}") from None


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
