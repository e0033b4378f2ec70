"""Scalar functions of the symbolic-music layer as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTAVE = 12


def quantise(beats: Column) -> Column:
    """Twelfths of a beat, half to even, from 0 to 192."""
    return F.least(F.greatest(F.rint(beats * 12).cast("int"), F.lit(0)), F.lit(192))


def clip_interval(semitones: Column, reach: int = 36) -> Column:
    return F.least(F.greatest(semitones, F.lit(-reach)), F.lit(reach))


def slot(beats: Column, parts: int) -> Column:
    """Number of the nearest part of a beat, half to even."""
    return F.rint(beats * parts).cast("int")


def log_bucket(beats: Column) -> Column:
    """Half-octave bucket 0..15 of a duration in beats."""
    return F.least(F.greatest(F.rint(2 * F.log2(F.greatest(beats, F.lit(1 / 32)))).cast("int") + 8, F.lit(0)), F.lit(15))


def pitch_bit(pitch: Column) -> Column:
    """The pitch class as a bit of a 12-bit mask."""
    return F.call_function("shiftleft", F.lit(1), F.pmod(pitch, F.lit(OCTAVE)).cast("int"))


def rotate_mask(mask: Column, shift: Column) -> Column:
    """A 12-bit pitch-class mask moved up by shift semitones, around the octave."""
    up = F.call_function("shiftleft", mask, shift)
    down = F.call_function("shiftright", mask, F.lit(OCTAVE) - shift)
    return up.bitwiseOR(down).bitwiseAND(F.lit(0xFFF))


def canonical_chroma(masks: Column) -> Column:
    """The lexicographically least of the 12 transpositions of a sequence of masks."""
    turns = F.transform(F.sequence(F.lit(0), F.lit(OCTAVE - 1)), lambda s: F.transform(masks, lambda m: rotate_mask(m, s.cast("int"))))
    return F.array_min(turns)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a over its length, which is taken once; a zero vector stays."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double"))))[0]


def roll(a: Column, n: Column | int) -> Column:
    """a turned left by n places."""
    k = n if isinstance(n, Column) else F.lit(n)
    return F.concat(F.slice(a, k + 1, F.size(a) - k), F.slice(a, F.lit(1), k))


def peak_first(a: Column) -> Column:
    """a turned so that its first largest entry leads; a zero vector stays."""
    top = F.array_max(a)
    return F.when(F.exists(a, lambda x: x != 0), roll(a, (F.array_position(a, top) - 1).cast("int"))).otherwise(a)


def rotation_cosine(a: Column, b: Column) -> Column:
    """The largest dot product of a with the 12 rotations of b; for unit vectors their cosine under the best transposition."""
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(OCTAVE - 1)), lambda s: dot(a, roll(b, s))))


def ratio(a: Column, b: Column) -> Column:
    return F.least(a, b) / F.greatest(F.greatest(a, b), F.lit(1e-6))


def velocity_step(velocity: Column) -> Column:
    return F.least(F.lit(15), F.floor(velocity * 16 / 128).cast("int"))


def program_family(program: Column, drum: Column) -> Column:
    return F.when(drum, 8).otherwise(F.least(F.lit(7), F.floor(program / 16).cast("int")))


def learning_rate(step: Column, steps: int, peak: float, warmup: int) -> Column:
    """Linear to the peak at the end of the warm-up, then half a cosine to zero at `steps`."""
    share = (step - warmup) / F.lit(float(steps - warmup))
    return F.when(step <= warmup, F.lit(peak) * step / warmup).otherwise(F.lit(peak) * 0.5 * (1 + F.cos(F.lit(math.pi) * share)))


def sinusoid(step: Column, width: int) -> Column:
    """width sines and cosines of a timestep at frequencies falling from 1 to 1/10000; an odd width ends in a zero."""
    half = width // 2
    waves = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: step * F.exp(-F.lit(math.log(10_000.0)) * i / max(half - 1, 1)))
    both = F.concat(F.transform(waves, lambda x: F.sin(x)), F.transform(waves, lambda x: F.cos(x)))
    return F.concat(both, F.array(F.lit(0.0))) if width % 2 else both


def collate(tokens: Column, prompt: Column, context: int, pad: int = 0) -> tuple[Column, Column, Column]:
    """(token ids, attention, loss mask) of `context` places: cut, padded, loss from the prompt's end to before the last token."""
    n = F.least(F.size(tokens), F.lit(context))
    places = F.sequence(F.lit(0), F.lit(context - 1))
    ids = F.concat(F.slice(tokens, F.lit(1), n), F.array_repeat(F.lit(pad).cast("int"), F.lit(context) - n))
    attention = F.transform(places, lambda i: (i < n).cast("int"))
    loss = F.transform(places, lambda i: ((i >= prompt) & (i < n - 1)).cast("int"))
    return ids, attention, loss


def prompt_mask(attention: Column, loss: Column) -> Column:
    """1 for attended places before the first place with loss (all attended places without any), the first place at least."""
    first = F.array_position(loss, F.lit(1)).cast("int")
    n = F.greatest(F.when(first > 0, first - 1).otherwise(F.aggregate(attention, F.lit(0), lambda acc, x: acc + x)), F.lit(1))
    return F.transform(attention, lambda a, i: F.when((i < n) & (a == 1), 1).otherwise(0))


def masked_mean(values: Column, mask: Column) -> Column:
    total = F.aggregate(F.zip_with(values, mask, lambda v, m: v * m), F.lit(0.0), lambda acc, x: acc + x)
    return total / F.greatest(F.aggregate(mask, F.lit(0), lambda acc, x: acc + x), F.lit(1))
