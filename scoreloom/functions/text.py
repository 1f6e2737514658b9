"""Text and pitch functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_text(c: Column) -> Column:
    """Trimmed, white space collapsed, lower case; blank is null."""
    plain = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.when(plain != "", plain)


def metronome_bpm(c: Column) -> Column:
    """The number after the first '=': '♩ = 120' gives 120."""
    return F.regexp_extract(c, r"=\s*(\d+(?:\.\d+)?)", 1).try_cast("decimal(10,3)")


_STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
_ALTERS = {-2: "bb", -1: "b", 0: "", 1: "#", 2: "##"}


def pitch_text(step: Column, alter: Column, octave: Column) -> Column:
    """'C#4'; other alterations as '(+3)'."""
    signs = F.lit(None).cast("string")
    for value, text in _ALTERS.items():
        signs = F.when(alter == value, text).otherwise(signs)
    other = F.concat(F.lit("("), F.when(alter > 0, "+").otherwise(""), alter.cast("string"), F.lit(")"))
    return F.concat(step, F.coalesce(signs, other), octave.cast("string"))


def midi(pitch: Column) -> Column:
    """(octave + 1) 12 + step + alteration; the largest int if it can't be read."""
    pattern = r"^([A-G])(##|bb|#|b|)(-?\d+)$"
    step, sign, octave = (F.regexp_extract(pitch, pattern, i) for i in (1, 2, 3))
    base = F.create_map(*(F.lit(x) for kv in _STEPS.items() for x in kv))[step]
    shift = F.when(sign == "##", 2).when(sign == "#", 1).when(sign == "b", -1).when(sign == "bb", -2).otherwise(0)
    return F.coalesce((octave.try_cast("int") + 1) * 12 + base + shift, F.lit(2147483647))


def diatonic(staff_step: Column, sign: Column, line: Column) -> Column:
    """struct<step, octave> of a notehead staff_step half-steps below the top line (0), by a G or F clef on `line`
    (counted from the bottom, 1). Null for other clefs."""
    # Counted in letters from C0; the clef's own note sits on its line, 10 - 2 * line half-steps below the top.
    reference = F.when(sign == "G", 4 * 7 + 4).when(sign == "F", 3 * 7 + 3)
    index = reference + (10 - 2 * line) - staff_step
    return F.when(index.isNotNull(), F.struct(F.element_at(F.array(*map(F.lit, "CDEFGAB")), F.pmod(index, F.lit(7)).cast("int") + 1).alias("step"), F.floor(index / 7).cast("int").alias("octave")))


def key_alter(step: Column, fifths: Column) -> Column:
    """-1, 0 or 1: what a key signature of -7 to 7 fifths does to a letter."""
    sharps, flats = F.array(*map(F.lit, "FCGDAEB")), F.array(*map(F.lit, "BEADGCF"))
    sharp = (fifths > 0) & (F.array_position(sharps, step) <= fifths)
    flat = (fifths < 0) & (F.array_position(flats, step) <= -fifths)
    return F.when(sharp, 1).when(flat, -1).otherwise(0)
