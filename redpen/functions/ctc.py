"""Emission matrices (steps x classes) as arrays of arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    return total(xs) / F.size(xs)


def softmax_row(xs: Column, temperature: float = 1.0) -> Column:
    t = F.lit(float(temperature))
    return _let(F.array_max(xs), lambda top: _let(F.transform(xs, lambda x: F.exp((x - top) / t)), lambda e: _let(total(e), lambda z: F.transform(e, lambda x: x / z))))


def looks_like_probabilities(matrix: Column) -> Column:
    """All values within [0, 1] and every row summing to one, within small tolerances."""
    return F.forall(matrix, lambda r: F.forall(r, lambda x: (x >= -0.001) & (x <= 1.001)) & (F.abs(total(r) - 1.0) <= 0.01001))


def softmax(matrix: Column, temperature: float = 1.0) -> Column:
    """Rows as probabilities; a matrix that has them already stays as it is."""
    return F.when(looks_like_probabilities(matrix), matrix).otherwise(F.transform(matrix, lambda r: softmax_row(r, temperature)))


def entropy(matrix: Column) -> Column:
    """Shannon entropy (nats) of every step."""
    return F.transform(matrix, lambda r: total(F.transform(r, lambda p: F.when(p > 0, -p * F.ln(p)).otherwise(0.0))))


def argmax(xs: Column) -> Column:
    """0-based class of the largest value, the lowest of equal ones."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def top_two(xs: Column) -> Column:
    """(first, second, p1, p2): the two most probable classes of a step, ties by class."""
    pairs = F.transform(xs, lambda x, i: F.struct((-x).alias("n"), i.alias("i")))
    return _let(F.array_sort(pairs), lambda s: F.struct(s[0]["i"].alias("first"), s[1]["i"].alias("second"), (-s[0]["n"]).alias("p1"), (-s[1]["n"]).alias("p2")))


def boundary_stats(matrix: Column, blank: int = 0, rho: float = 0.1) -> Column:
    """Blank probability at both edges: mean and peak over the first and last `rho` of the steps, one
    step at least; edges that would overlap are split at the middle. Fewer than two steps are invalid."""
    t, share = F.size(matrix), F.lit(float(rho))
    end = F.greatest(F.lit(1), F.floor(share * t).cast("int"))
    start = F.least(t - 1, F.ceil((F.lit(1.0) - share) * t).cast("int"))
    middle = F.floor(t / 2).cast("int")
    overlap = start <= end
    end, start = F.when(overlap, F.greatest(F.lit(1), middle)).otherwise(end), F.when(overlap, F.least(t - 1, middle)).otherwise(start)
    good = t >= 2
    blanks = F.transform(matrix, lambda r: r[blank])
    left, right = F.slice(blanks, F.lit(1), end), F.slice(blanks, F.greatest(start, F.lit(0)) + 1, F.greatest(t - start, F.lit(0)))
    stat = lambda e: F.when(good, e).otherwise(0.0)
    return F.struct(stat(mean(left)).alias("blank_mean_L"), stat(mean(right)).alias("blank_mean_R"), stat(F.array_max(left)).alias("blank_peak_L"), stat(F.array_max(right)).alias("blank_peak_R"), t.alias("T"), good.alias("valid"))


def greedy(matrix: Column, blank: int = 0) -> Column:
    """(steps, classes, confidence): best path with repeats and blanks taken out, and its mean probability."""
    best = F.transform(matrix, argmax)
    kept = F.filter(F.transform(best, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda s: (s["c"] != blank) & ((s["i"] == 0) | (F.get(best, s["i"] - 1) != s["c"])))
    return _let(kept, lambda k: F.struct(F.transform(k, lambda s: s["i"]).alias("steps"), F.transform(k, lambda s: s["c"]).alias("classes"), F.when(F.size(k) > 0, mean(F.transform(k, lambda s: F.array_max(F.get(matrix, s["i"]))))).otherwise(0.0).alias("confidence")))


def alignment_kind(decoded: Column, chars: Column, window: int = 2, extreme: float = 0.3) -> Column:
    """By which rule steps are aligned with characters, from their two numbers."""
    off = F.abs(decoded - chars)
    share = off / F.greatest(chars, F.lit(1))
    return F.when(off == 0, "perfect_match").when(off <= window, "tolerant_align").when(share <= extreme, "greedy_align").otherwise("fallback_align")


def uniform_alignment(steps: Column, chars: Column) -> Column:
    """(start, end) of the steps of each character, dealt out evenly, one step at least."""
    per = steps.cast("double") / F.greatest(chars, F.lit(1))
    every = F.when(chars >= 1, F.sequence(F.lit(0), chars - 1)).otherwise(F.array().cast("array<int>"))

    def place(i: Column) -> Column:
        start = F.floor(i * per).cast("int")
        end = F.least(F.floor((i + 1) * per).cast("int"), steps)
        return F.when(start < end, F.struct(start.alias("start"), end.alias("end"))).otherwise(F.struct(F.least(start, steps - 1).alias("start"), (F.least(start, steps - 1) + 1).alias("end")))

    return F.transform(every, place)


def crop(xs: Column, share: float, side: str) -> Column:
    """An array without `share` of its columns at one side."""
    cut = F.floor(F.size(xs) * F.lit(share)).cast("int")
    return F.slice(xs, cut + 1, F.size(xs) - cut) if side == "left" else F.slice(xs, F.lit(1), F.size(xs) - cut)


def aligned_steps(matrix: Column, chars: Column, blank: int = 0) -> Column:
    """(strategy, steps): for each of `chars` characters the steps that stand for it.

    Best-path runs without blanks are characters. As many as wanted: each its own run. Off by a few:
    surplus runs are dropped at the end, and missing characters take the last step. Off by up to 30
    percent: runs in order, and steps of highest entropy that no run holds for what is missing. Further
    off: steps dealt out evenly.
    """
    best = F.transform(matrix, argmax)

    def build(b: Column) -> Column:
        t = F.size(b)
        starts = F.filter(F.sequence(F.lit(0), t - 1), lambda i: (F.get(b, i) != blank) & ((i == 0) | (F.get(b, i - 1) != F.get(b, i))))

        def with_runs(s: Column) -> Column:
            run = lambda i: F.filter(F.sequence(i, t - 1), lambda j: ~F.exists(F.sequence(i, j), lambda k: F.get(b, k) != F.get(b, i)))
            runs = F.transform(s, run)
            n = F.size(s)
            kind = alignment_kind(n, chars)
            h = entropy(matrix)
            free = F.filter(F.sequence(F.lit(0), t - 1), lambda i: F.get(b, i) == blank)
            peaks = F.transform(F.array_sort(F.transform(free, lambda i: F.struct((-F.get(h, i)).alias("h"), i.alias("i")))), lambda x: F.array(x["i"]))
            last = F.array_repeat(F.array(t - 1), F.greatest(chars - n, F.lit(0)))
            few = F.slice(F.concat(runs, last), F.lit(1), chars)
            greedy_ = F.slice(F.concat(runs, peaks, last), F.lit(1), chars)
            even = F.transform(uniform_alignment(t, chars), lambda u: F.sequence(u["start"], u["end"] - 1))
            steps = F.when(kind == "perfect_match", runs).when(kind == "tolerant_align", few).when(kind == "greedy_align", greedy_).otherwise(even)
            return F.struct(kind.alias("strategy"), F.when(chars > 0, steps).otherwise(F.array().cast("array<array<int>>")).alias("steps"))

        return _let(starts, with_runs)

    return _let(best, build)
