"""What a function is: its code, and all that the code reaches by name.

The evidence of a body covers its bytecode and constants, the values in its closure, the
globals and module attributes that it names, and, in the same way, every function among
them that it may call. A helper that nothing names is no evidence. A value without a
canonical form is refused: what a body needs beyond code belongs into its inputs.
"""

from __future__ import annotations

import builtins
import dis
import functools
import hashlib
import sys
import types
from collections.abc import Callable, Iterator

from pyspark import SparkContext
from pyspark.sql import Column, SparkSession
from pyspark.sql import types as T

#: Modules whose code is taken by name and version, not by content.
_INSTALLED = ("site-packages", "dist-packages")


class Unjustified(TypeError):
    """A captured value has no canonical form, so that nothing can tell whether it has changed."""


def _foreign(module: types.ModuleType | None) -> bool:
    """Whether a module belongs to the language or to an installed library."""
    path = getattr(module, "__file__", None)
    if module is None or path is None:
        return True
    return any(p in path for p in _INSTALLED) or path.startswith(str(dis.__file__).rsplit("/", 1)[0])


def _named(code: types.CodeType) -> Iterator[tuple[str, ...]]:
    """The global names that code loads, each with the attributes read from it at once."""
    chain: list[str] = []
    for i in dis.get_instructions(code):
        if i.opname in ("LOAD_GLOBAL", "LOAD_NAME"):
            if chain:
                yield tuple(chain)
            chain = [i.argval]
        elif chain and i.opname in ("LOAD_ATTR", "LOAD_METHOD"):
            chain.append(i.argval)
        elif chain:
            yield tuple(chain)
            chain = []
    if chain:
        yield tuple(chain)
    for c in code.co_consts:
        if isinstance(c, types.CodeType):
            yield from _named(c)


class _Reader:
    def __init__(self):
        self.met: dict[int, int] = {}

    def code(self, code: types.CodeType) -> list:
        consts = [self.code(c) if isinstance(c, types.CodeType) else self.value(c, "a constant") for c in code.co_consts]
        return ["code", code.co_code.hex(), consts, list(code.co_names), list(code.co_varnames), code.co_argcount, code.co_kwonlyargcount, code.co_flags]

    def function(self, f: types.FunctionType) -> list:
        if id(f) in self.met:
            return ["again", self.met[id(f)]]
        self.met[id(f)] = len(self.met)
        cells = [[n, self.cell(n, c)] for n, c in zip(f.__code__.co_freevars, f.__closure__ or (), strict=True)]
        reached = []
        for chain in sorted(set(_named(f.__code__))):
            if chain[0] in f.__globals__:
                reached.append([".".join(chain), self.reached(f.__globals__[chain[0]], chain)])
        return ["function", self.code(f.__code__), cells, reached, self.value(f.__defaults__, "a default"), self.value(f.__kwdefaults__, "a default")]

    def cell(self, name: str, cell) -> list:
        try:
            return self.value(cell.cell_contents, name)
        except ValueError:
            return ["empty"]

    def reached(self, value, chain: tuple[str, ...]) -> list:
        """A global, or what its module holds under the attributes that follow."""
        for name in chain[1:]:
            if not isinstance(value, types.ModuleType) or _foreign(value):
                break
            value = getattr(value, name, None)
        return self.value(value, ".".join(chain))

    def value(self, v, name: str) -> list:
        if v is None or v is Ellipsis or isinstance(v, (bool, int, str, bytes, complex)):
            return [type(v).__name__, repr(v)]
        if isinstance(v, float):
            return ["float", v.hex()]
        if isinstance(v, (tuple, list)):
            return [type(v).__name__, [self.value(x, name) for x in v]]
        if isinstance(v, (set, frozenset)):
            return ["set", sorted((self.value(x, name) for x in v), key=repr)]
        if isinstance(v, dict):
            return ["dict", [[self.value(k, name), self.value(x, name)] for k, x in v.items()]]
        if isinstance(v, types.ModuleType):
            return ["module", v.__name__, str(getattr(v, "__version__", ""))] if _foreign(v) else ["module", v.__name__]
        if isinstance(v, types.FunctionType):
            home = sys.modules.get(v.__module__)
            return ["function", v.__module__, v.__qualname__, str(getattr(home, "__version__", ""))] if v.__module__ != "__main__" and home is not None and _foreign(home) else self.function(v)
        if isinstance(v, functools.partial):
            return ["partial", self.value(v.func, name), self.value(v.args, name), self.value(v.keywords, name)]
        if isinstance(v, types.MethodType):
            return ["method", self.value(v.__func__, name), self.value(v.__self__, name)]
        if isinstance(v, (types.BuiltinFunctionType, types.MethodDescriptorType)) or isinstance(v, type) and v.__module__ == builtins.__name__:
            return ["builtin", getattr(v, "__qualname__", repr(v))]
        if isinstance(v, type):
            return self.type(v)
        if isinstance(v, T.DataType):
            return ["type", v.json()]
        if isinstance(v, Column):
            return ["column", str(v)]
        if isinstance(v, (SparkSession, SparkContext)):  # a handle that holds no data
            return ["session"]
        if hasattr(v, "__wrapped__"):
            return ["wrapped", self.value(v.__wrapped__, name)]
        if hasattr(type(v), "__dataclass_fields__") and getattr(type(v), "__dataclass_params__").frozen:
            return ["data", self.type(type(v)), [[n, self.value(getattr(v, n), n)] for n in type(v).__dataclass_fields__]]
        raise Unjustified(f"{name} holds a {type(v).__name__}, which has no canonical form; make it an input of the step")

    def type(self, c: type) -> list:
        home = sys.modules.get(c.__module__)
        if _foreign(home):
            return ["class", c.__module__, c.__qualname__, str(getattr(home, "__version__", ""))]
        if id(c) in self.met:
            return ["again", self.met[id(c)]]
        self.met[id(c)] = len(self.met)
        found = ((n, getattr(x, "fget", None) or getattr(x, "__func__", x)) for n, x in vars(c).items())
        own = sorted(((n, f) for n, f in found if isinstance(f, types.FunctionType) and not f.__code__.co_filename.startswith("<")), key=lambda x: x[0])  # without generated methods
        return ["class", c.__module__, c.__qualname__, [[n, self.value(f, n)] for n, f in own]]


def code_digest(*functions: Callable) -> str:
    """SHA-256 of some functions and of all that their code reaches."""
    reader = _Reader()
    return hashlib.sha256(repr([reader.value(f, getattr(f, "__name__", "a body")) for f in functions]).encode()).hexdigest()
