"""Onsets of a staff with several voices: one voice is the backbone, the others are anchored to it where they stand at the
same x. Staves of one voice need a running sum only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fractions
from . import sequences
from .groupwise import Columns, each_group

_STAFF = ["score_id", "measure_no", "staff"]
#: Fixed value, in staff spacings.
ALIGNED = 0.72


def _solve(rows: Columns) -> list[tuple]:
    """Rows of a staff's measure by x and id."""
    voices: dict[int, list[int]] = {}
    for i, voice in enumerate(rows["voice"]):
        voices.setdefault(voice, []).append(i)
    backbone = min(voices, key=lambda v: (-len(voices[v]), v))
    x, ticks, spacing = rows["x"], rows["_ticks"], max(rows["spacing"][0] or 0.0, 0.001)
    at: dict[int, int] = {}
    how: dict[int, tuple[str, float]] = {}
    now = 0
    for i in voices[backbone]:
        at[i], how[i] = now, ("backbone", 0.95)
        now += ticks[i]
    timeline = voices[backbone]
    for voice in sorted(v for v in voices if v != backbone):
        own, anchors, least = voices[voice], {}, 0
        for i in own:
            near = [(abs(x[timeline[k]] - x[i]), k) for k in range(least, len(timeline)) if abs(x[timeline[k]] - x[i]) <= spacing * ALIGNED]
            if near:
                d, least = min(near)
                anchors[i] = (at[timeline[least]], d / spacing)
        now = 0
        if anchors:
            first = next(i for i in own if i in anchors)
            now = max(0, anchors[first][0] - sum(ticks[i] for i in own[: own.index(first)]))
        for i in own:
            how[i] = ("from the start", 0.55) if not anchors else ("carried on", 0.88)
            if i in anchors:
                when, d = anchors[i]
                how[i] = ("conflict", 0.48) if when < now else ("aligned after a gap" if when > now else "aligned", 0.97 - min(d, 0.5) * 0.15)
                now = max(now, when)
            at[i] = now
            now += ticks[i]
    sure = rows["confidence"]
    return [(*(rows[k][i] for k in _STAFF), rows["id"][i], at[i], how[i][0], how[i][1] if sure[i] is None else min(sure[i], how[i][1])) for i in range(len(x))]


def anchored_onsets(events: DataFrame) -> DataFrame:
    """events (score_id, measure_no, staff, voice, id, x, duration, confidence, spacing) with at (struct<num, den>), how and
    confidence. id is unique in its measure and staff.

    The voice with most events, then the first, is the backbone: its durations add up from 0. An event of another voice
    within ALIGNED spacings of a backbone event, the closest that is not before the last one's, begins with it; between
    such anchors durations add up. Where the anchor is later, a gap stays; where the durations have passed it, they go
    on and how is 'conflict'. Voices without an anchor begin at 0. Sums are exact, in ticks of the measure.
    """
    base = fractions.lcm_of(F.collect_set("duration.den").over(Window.partitionBy("score_id", "measure_no")))
    rows = events.withColumn("_base", base).withColumn("_ticks", (F.col("duration.num") * F.col("_base") / F.col("duration.den")).cast("long"))
    of_staff = Window.partitionBy(*_STAFF)
    rows = rows.withColumn("_several", F.min("voice").over(of_staff) != F.max("voice").over(of_staff))
    alone = sequences.running_cursor(rows.where("NOT _several"), _STAFF, ["x", "id"], "_ticks", "_at")
    alone = alone.select(*_STAFF, "id", "_at", F.lit("one voice").alias("how"), F.least("confidence", F.lit(0.95)).alias("_sure"))
    kinds = dict(events.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in _STAFF), f"id {kinds['id']}", "_at long", "how string", "_sure double"])
    several = each_group(rows.where("_several").select(*_STAFF, "id", "voice", "x", "_ticks", F.col("spacing").cast("double").alias("spacing"), F.col("confidence").cast("double").alias("confidence")), _STAFF, ["x", "id"], _solve, schema)
    found = rows.join(alone.unionByName(several), [*_STAFF, "id"])
    return found.withColumns({"at": fractions.frac(F.col("_at"), F.col("_base")), "confidence": F.col("_sure")}).drop("_base", "_ticks", "_several", "_at", "_sure")
