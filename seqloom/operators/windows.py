"""Window radii and kernels.

A kernel gives the weight of a context from its distance (1, 2, ...). Kernels of fixed distance
are numbers or columns known when the plan is built, so they fold into the projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Kernel = Callable[[int], Column]


def flat(d: int) -> Column:
    return F.lit(1.0)


def harmonic(d: int) -> Column:
    return F.lit(1.0 / d)


def geometric(power: float = 0.9) -> Kernel:
    return lambda d: F.lit(power**d)


def offset(kernel: Kernel, skip: int) -> Kernel:
    """Weight 0 for the first `skip` places."""
    return lambda d: F.lit(0.0) if d <= skip else kernel(d)


#: Kernels by name; each takes its own arguments.
KERNELS: dict[str, Callable[..., Kernel]] = {"flat": lambda: flat, "harmonic": lambda: harmonic, "geometric": geometric}


def kernel_of(kernel: str | Kernel, **args) -> Kernel:
    """A named kernel, or any callable from a distance to a column."""
    skip = args.pop("offset", 0)
    if isinstance(kernel, str):
        if kernel not in KERNELS:
            raise ValueError(f"unknown kernel {kernel!r}: {sorted(KERNELS)}")
        kernel = KERNELS[kernel](**args)
    return offset(kernel, skip) if skip else kernel


def timed_flat(gap: Column, delta: Column) -> Column:
    return F.lit(1.0)


def timed_kernel_of(kernel: str | Callable, **args) -> Callable[[Column, Column], Column]:
    """A named kernel of time gaps, or any callable from a gap and the mean gap to a column."""
    if isinstance(kernel, str):
        if kernel not in TIMED_KERNELS:
            raise ValueError(f"unknown kernel {kernel!r}: {sorted(TIMED_KERNELS)}")
        return TIMED_KERNELS[kernel](**args)
    return kernel


def timed_geometric(power: float = 0.9) -> Callable[[Column, Column], Column]:
    return lambda gap, delta: F.pow(F.lit(power), F.abs(gap) / delta)


#: Kernels of time gaps by name.
TIMED_KERNELS: dict[str, Callable[..., Callable]] = {"flat": lambda: timed_flat, "geometric": timed_geometric}


def variable_radii(vocab: DataFrame, size: int, power: float = 0.75) -> DataFrame:
    """(idx, radius): rarer tokens look further. r = f^(power-1) / sum f^power, times size; below
    one is one, else rounded half to even."""
    total = F.broadcast(vocab.agg(F.sum("n").alias("__t")))  # one row
    f = vocab.crossJoin(total).select("idx", (F.col("n") / F.col("__t")).alias("f"))
    norm = F.broadcast(f.agg(F.sum(F.pow("f", F.lit(power))).alias("__s")))  # one row
    r = F.pow("f", F.lit(power - 1.0)) / F.col("__s") * size
    r = F.when((r > 0) & (r < 1), F.lit(1.0)).otherwise(F.rint(r))
    return f.crossJoin(norm).select("idx", r.cast("int").alias("radius"))


WindowFunction = Callable[[DataFrame, int], DataFrame]

#: Window functions by name: from a vocabulary (token, idx, n) and a size to (idx, radius); none
#: is the same radius for all.
WINDOWS: dict[str, WindowFunction | None] = {"fixed": None, "variable": variable_radii}


def window_function(window: str | WindowFunction) -> WindowFunction | None:
    """A named window function, or any callable from a vocabulary and a size to (idx, radius)."""
    if isinstance(window, str) and window not in WINDOWS:
        raise ValueError(f"unknown window function {window!r}: {sorted(WINDOWS)}")
    return WINDOWS[window] if isinstance(window, str) else window


@dataclass(frozen=True)
class WindowSpec:
    """One window: what lies before or after, up to a radius (the same for all tokens, or the
    token's own up to that), with a kernel and a weight among the windows. own_radii: the
    column of the tokens' radii."""

    orientation: str = "after"
    radius: int = 5
    kernel: Kernel = flat
    mix: float = 1.0
    own_radii: str | None = None

    def __post_init__(self):
        if self.orientation not in ("before", "after"):
            raise ValueError("a window looks before or after")

    @property
    def prefix(self) -> str:
        return "pre" if self.orientation == "before" else "post"


def expand(orientation: str, radius: int = 5, kernel: Kernel = flat, mix: float = 1.0, own_radii: str | None = None) -> list[WindowSpec]:
    """Windows of an orientation: "directional" is before and after side by side, "symmetric" is
    both in one block of columns."""
    if orientation in ("before", "after"):
        return [WindowSpec(orientation, radius, kernel, mix, own_radii)]
    if orientation in ("directional", "symmetric"):
        return [WindowSpec(o, radius, kernel, mix, own_radii) for o in ("before", "after")]
    raise ValueError(f"unknown orientation {orientation!r}")
