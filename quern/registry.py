"""Operators by name: lookup, groups, switching to reference forms, inspection, verification and timing."""

from __future__ import annotations

import difflib
import inspect as _inspect
import os
import time
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pyspark


@dataclass
class Operator:
    name: str
    fn: Callable
    ids: tuple[str, ...] = ()
    group: str = "core"
    #: A slower form of the same results, used while the operator is disabled.
    reference: Callable | None = None
    tested: str = "4.1"
    active: bool = True

    def __call__(self, *args, native: bool | None = None, **options):
        use = self.active if native is None else native
        return (self.fn if use or self.reference is None else self.reference)(*args, **options)


@dataclass
class OperatorRegistry:
    operators: dict[str, Operator] = field(default_factory=dict)

    def add(self, operator: Operator) -> Operator:
        if operator.name in self.operators:
            warnings.warn(f"operator {operator.name} is defined twice; the later one counts", stacklevel=3)
        self.operators[operator.name] = operator
        return operator

    def get(self, name: str) -> Operator:
        if name not in self.operators:
            near = difflib.get_close_matches(name, self.operators, 3)
            raise KeyError(f"no operator {name!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
        return self.operators[name]

    def names(self, group: str | None = None) -> list[str]:
        return sorted(n for n, o in self.operators.items() if group in (None, o.group))

    def groups(self) -> dict[str, list[str]]:
        return {g: self.names(g) for g in sorted({o.group for o in self.operators.values()})}

    def _chosen(self, which: str) -> list[Operator]:
        groups = self.groups()
        return [self.operators[n] for n in groups[which]] if which in groups else [self.get(which)]

    def activate(self, *which: str, strict: bool = False) -> None:
        for o in (o for w in which for o in self._chosen(w)):
            if not pyspark.__version__.startswith(o.tested):
                if strict:
                    raise RuntimeError(f"{o.name} is tested with Spark {o.tested}, not {pyspark.__version__}")
                warnings.warn(f"{o.name} is tested with Spark {o.tested}", stacklevel=2)
            o.active = True

    def deactivate(self, *which: str) -> None:
        for o in (o for w in which or self.groups() for o in self._chosen(w)):
            o.active = False

    @contextmanager
    def disabled(self, *which: str) -> Iterator[None]:
        before = {n: o.active for n, o in self.operators.items()}
        self.deactivate(*which)
        try:
            yield
        finally:
            for n, active in before.items():
                self.operators[n].active = active

    def status(self) -> dict[str, bool]:
        return {n: self.operators[n].active for n in self.names()}

    def inspect(self, name: str) -> dict:
        o = self.get(name)
        return {"name": o.name, "ids": o.ids, "group": o.group, "active": o.active, "reference": o.reference is not None, "signature": str(_inspect.signature(o.fn)), "summary": (_inspect.getdoc(o.fn) or "").split("\n")[0], "module": o.fn.__module__}

    def verify(self, name: str, *args, digits: int = 6, **options) -> bool:
        """Whether the native and the reference form agree on these arguments."""
        o = self.get(name)
        if o.reference is None:
            raise ValueError(f"{name} has no reference form")
        plain = lambda r: tuple(round(v, digits) if isinstance(v, float) else v for v in r)
        a, b = (sorted((plain(r) for r in o(*args, native=n, **options).collect()), key=str) for n in (True, False))
        return a == b

    def benchmark(self, name: str, *args, reps: int = 3, **options) -> dict[str, float]:
        """Seconds of writing the result nowhere: mean, median, min, max, sd."""
        import statistics as st

        took = []
        for _ in range(reps):
            began = time.perf_counter()
            self.get(name)(*args, **options).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return {"n": reps, "mean": st.mean(took), "median": st.median(took), "min": min(took), "max": max(took), "sd": st.stdev(took) if reps > 1 else 0.0}


REGISTRY = OperatorRegistry()


def operator(*ids: str, group: str = "core", reference: Callable | None = None) -> Callable:
    """Register a function under its own name, with its numbers in the operator inventory."""

    def put(fn: Callable) -> Operator:
        made = REGISTRY.add(Operator(fn.__name__, fn, ids, group, reference))
        made.__doc__ = fn.__doc__
        return made

    return put


def threads(option: int | None = None, default: int = 4, most: int = 16) -> int:
    """Threads to use: the environment counts before the option, the option before the default, none above `most`."""
    given = os.environ.get("QUERN_THREADS", "")
    return max(1, min(int(given) if given.isdigit() else option or default, most))
