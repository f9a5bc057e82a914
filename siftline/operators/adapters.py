"""Which agent a command line calls, and the prompt it passes: array functions over argv."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of executable names, options that carry the prompt, words that are no prompt.
AGENTS = {"qwen-coder": (["qwen", "coder"], ["--prompt", "-p"], []), "openhands": (["openhands", "hands"], ["--task", "-t"], ["run"])}
VALUED = ["--prompt", "--task", "-p", "-t"]


def adapter(argv: Column) -> Column:
    """Name of the first adapter whose agent argv runs; 'generic' for any other."""
    exe = F.lower(F.substring_index(F.get(argv, F.lit(0)), "/", -1))
    out = F.lit("generic")
    for name, (parts, _, _) in reversed(AGENTS.items()):
        out = F.when(exe.rlike("|".join(parts)), name).otherwise(out)
    return out


def option(args: Column, names: list[str]) -> Column:
    """Value of the first argument that is one of the names, with a successor, or name=value; else null."""
    values = F.transform(args, lambda a, i: F.struct(a.alias("a"), F.get(args, i + 1).alias("next")))

    def value(x: Column) -> Column:
        out = F.when(x["a"].isin(names) & x["next"].isNotNull(), x["next"])
        for n in names:
            out = out.when(x["a"].startswith(n + "="), F.substr(x["a"], F.lit(len(n) + 2)))
        return out

    return F.get(F.filter(F.transform(values, value), lambda v: v.isNotNull()), F.lit(0))


def positionals(args: Column, skip: list[str]) -> Column:
    """Arguments that are no options, joined; those that carry a value take it with them."""

    def step(state: Column, arg: Column) -> Column:
        held = state["skip"] | arg.startswith("-") | arg.isin(skip) if skip else state["skip"] | arg.startswith("-")
        return F.struct((~state["skip"] & arg.isin(VALUED)).alias("skip"), F.when(held, state["kept"]).otherwise(F.concat(state["kept"], F.array(arg))).alias("kept"))

    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("kept"))
    return F.trim(F.aggregate(args, start, step, lambda s: F.array_join(s["kept"], " ")))


def prompt(argv: Column) -> Column:
    """The prompt in argv, by the agent's own options."""
    args = F.slice(argv, 2, F.greatest(F.size(argv) - 1, F.lit(0)))
    out = F.when(F.size(argv) == 0, "").when(F.size(argv) == 1, F.get(argv, F.lit(0))).otherwise(F.trim(F.array_join(args, " ")))
    name = adapter(argv)
    for agent, (_, options, skip) in AGENTS.items():
        found = option(args, options)
        out = F.when(name == agent, F.when(F.coalesce(found, F.lit("")) != "", F.trim(found)).otherwise(positionals(args, skip))).otherwise(out)
    return out
