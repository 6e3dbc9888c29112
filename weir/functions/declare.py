"""Function declarations as text: FUN, PRED, UDAF, EXTR, STATE and SFUN lines, bound to Python builders."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from weir import types as T
from weir.functions.library import Registry, State

#: Words before a name that say where or at what cost a function runs: they change no result.
_IDLE = {"LFTA_LEGAL", "LFTA_ONLY", "SAMPLING", "HFTA_ONLY", "FREE", "LOW", "HIGH", "EXPENSIVE", "TOP", "COST", "MULTIPLE_RETURNS"}


@dataclass
class Declared:
    kind: str  # FUN PRED UDAF EXTR STATE SFUN
    name: str
    result: str | None = None
    args: tuple[str, ...] = ()
    constant: tuple[int, ...] = ()
    partial: bool = False
    running: bool = False
    of: str | None = None  # an extractor's aggregate, a stateful function's state
    marks: dict[str, str] = field(default_factory=dict)


def parse(text: str) -> list[Declared]:
    """Declarations, which semicolons part; # and // begin comments."""
    text = re.sub(r"(#|//)[^\n]*", "", text)
    out = []
    for part in text.split(";"):
        part = " ".join(part.split())
        if part:
            out.append(_one(part))
    return out


def _arguments(text: str) -> tuple[tuple[str, ...], tuple[int, ...]]:
    args, constant = [], []
    for k, a in enumerate(filter(None, (x.strip() for x in text.split(",")))):
        words = a.split()
        args.append(T.named(words[0]))
        if {w.upper() for w in words[1:]} & {"HANDLE", "CONST", "CLASS"}:
            constant.append(k)
    return tuple(args), tuple(constant)


def _one(line: str) -> Declared:
    m = re.fullmatch(r"(\w+) STATE (\w+)", line)
    if m:
        return Declared("STATE", m[2])
    m = re.fullmatch(r"PRED\s*(?:\[([^\]]*)\])?\s*(\w+)\s*\[([^\]]*)\]", line)
    if m:
        args, constant = _arguments(m[3])
        return Declared("PRED", m[2], T.BOOL, args, constant)
    m = re.fullmatch(r"(\w+) (FUN|UDAF|EXTR|SFUN)\s*(?:\[([^\]]*)\])?\s*([\w ]+?)\s*\(([^)]*)\)", line)
    if not m:
        raise ValueError(f"no declaration: {line!r}")
    args, constant = _arguments(m[5])
    marks = {w[0].upper(): " ".join(w[1:]) for x in (m[3] or "").split(",") if (w := x.split())}
    unknown = set(marks) - _IDLE - {"PARTIAL", "RUNNING", "SUBAGGR", "SUPERAGGR", "HFTA_SUBAGGR", "HFTA_SUPERAGGR"}
    if unknown:
        raise ValueError(f"{', '.join(sorted(unknown))}: no such mark in {line!r}")
    names = m[4].split()
    d = Declared(m[2], names[0], T.named(m[1]), args, constant, "PARTIAL" in marks, "RUNNING" in marks, None, marks)
    if m[2] == "EXTR":  # result EXTR name aggregate extractor (args)
        d.of = names[1]
    elif m[2] == "SFUN":
        d.of = names[1]
    return d


def declare(registry: Registry, text: str, builders: dict[str, Callable], states: dict[str, Callable] | None = None, over: dict[str, Callable] | None = None) -> None:
    """Register what a text declares, with `builders` by name.

    FUN, PRED: builder(columns) -> Column. UDAF, EXTR: builder(columns) -> aggregate Column; a RUNNING one has `over[name]`,
    which makes its value of the array of its epochs' partials. STATE: states[name]() gives the object whose methods are the SFUNs.
    """
    found = parse(text)
    running = {d.name: d.running for d in found if d.kind == "UDAF"}
    for d in found:
        if d.kind == "STATE":
            functions = {f.name: f.result for f in found if f.kind == "SFUN" and f.of == d.name}
            if not states or d.name not in states:
                raise ValueError(f"state {d.name} has no class")
            registry.register_state(State(d.name, states[d.name], functions))
            continue
        if d.kind == "SFUN":
            if d.of not in {s.name for s in found if s.kind == "STATE"}:
                raise ValueError(f"{d.name}: no state {d.of}")
            continue
        if d.name not in builders:
            if d.kind == "UDAF":  # only its extractors are called
                continue
            raise ValueError(f"{d.name} has no builder")
        build = builders[d.name]
        if d.kind == "FUN":
            registry.register_scalar(d.name, d.args, d.result, build, partial=d.partial, constant=d.constant)
        elif d.kind == "PRED":
            registry.register_predicate(d.name, d.args, build, constant=d.constant)
        else:
            moving = d.running or running.get(d.of or "", False)
            if moving and (not over or d.name not in over):
                raise ValueError(f"{d.name} runs over epochs: it needs `over`")
            registry.register_aggregate(d.name, d.args, d.result, build, running=moving, over=over[d.name] if moving else None, constant=d.constant)
