"""SVG pages to tables of shapes.

Two stages. A page is read as a tree once; each geometric element, and each one that a `use` places, becomes a row with its
transform, its paint and its data. The rows are dealt out anew and their paths flattened, so that a page of many paths is
the work of many tasks.
"""

from __future__ import annotations

import math
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import materialize
from ..operators.shapes import CONTOURS, bounds

#: Fixed value: points that stand for a curve, and for a quarter of an arc.
SAMPLES = 12
_GEOMETRY = {"path", "line", "polyline", "polygon", "rect"}
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_TOKEN = re.compile(rf"[A-Za-z]|{_NUMBER}")
_TRANSFORM = re.compile(r"(matrix|translate)\s*\(([^)]*)\)", re.IGNORECASE)
_ELEMENT = (
    "seq int, source_kind string, source_id string, data_index string, tag string, data string, transform array<double>,"
    " stroke_width double, has_fill boolean, has_stroke boolean, error string"
)
Affine = tuple[float, float, float, float, float, float]
_SAME: Affine = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def local(name: str) -> str:
    return name.rpartition("}")[2] if isinstance(name, str) else ""


def number(text: str | None, default: float = 0.0) -> float:
    try:
        return float(text) if text is not None else default
    except ValueError:
        return default


def after(first: Affine, then: Affine) -> Affine:
    """One affine map, then another; (a, b, c, d, e, f) maps x, y to a x + c y + e, b x + d y + f."""
    p = np.array([[first[0], first[2], first[4]], [first[1], first[3], first[5]], [0, 0, 1]])
    q = np.array([[then[0], then[2], then[4]], [then[1], then[3], then[5]], [0, 0, 1]])
    (a, c, e), (b, d, f), _ = (q @ p).tolist()
    return a, b, c, d, e, f


def transform_of(text: str | None) -> Affine:
    """The maps of a transform attribute in the order in which they are listed; other functions than matrix and translate
    are passed over, a wrong number of arguments is an error."""
    found = _SAME
    for name, inside in _TRANSFORM.findall(text or ""):
        args = [float(x) for x in re.split(r"[,\s]+", inside) if x]
        if name.lower() == "translate" and args:
            step: Affine = (1.0, 0.0, 0.0, 1.0, args[0], args[1] if len(args) > 1 else 0.0)
        elif name.lower() == "matrix" and len(args) == 6:
            step = tuple(args)  # type: ignore[assignment]
        else:
            raise ValueError(f"unsupported transform: {name}({inside})")
        found = after(found, step)
    return found


class Page:
    """One page as a tree, with what its elements inherit."""

    def __init__(self, text: str):
        self.root = ET.fromstring(text)
        self.parent = {child: element for element in self.root.iter() for child in element}
        self.by_id: dict[str, ET.Element] = {}
        for element in self.root.iter():
            if element is not self.root and element.get("id") is not None:
                self.by_id.setdefault(element.get("id"), element)

    def up(self, element: ET.Element | None) -> Iterator[ET.Element]:
        while element is not None:
            yield element
            element = self.parent.get(element)

    def below_defs(self, element: ET.Element, top: ET.Element | None = None) -> bool:
        """Whether an element that holds this one, below top, is a defs."""
        for holder in self.up(self.parent.get(element)):
            if holder is top:
                return False
            if local(holder.tag) == "defs":
                return True
        return False

    def placed(self, element: ET.Element | None, last: ET.Element | None = None) -> Affine:
        """The maps from an element's own coordinates up to those of last, or of the page."""
        found = _SAME
        for holder in self.up(element):
            found = after(found, transform_of(holder.get("transform")))
            if holder is last:
                break
        return found

    def paint(self, name: str, default: str, *elements: ET.Element) -> str:
        """A property by the style or attribute of the closest holder, of the first element that has any."""
        for element in elements:
            for holder in self.up(element):
                for declaration in (holder.get("style") or "").split(";"):
                    key, colon, value = declaration.partition(":")
                    if colon and key.strip().lower() == name:
                        return value.strip()
                if (holder.get(name) or "").strip():
                    return holder.get(name).strip()
        return default

    def row(self, source: ET.Element, kind: str, source_id: str | None, transform: Affine, instance: ET.Element) -> tuple:
        chain = (source,) if source is instance else (source, instance)
        amount = lambda name: max(0.0, number(self.paint(name, "1", *chain), 1.0))
        width = amount("stroke-width")
        fill = self.paint("fill", "black", *chain).lower() != "none" and amount("fill-opacity") > 0
        stroke = self.paint("stroke", "none", *chain).lower() != "none" and amount("stroke-opacity") > 0 and width > 0
        scale = math.sqrt(sum(v * v for v in transform[:4]) / 2)
        tag = local(source.tag)
        return kind, source_id, instance.get("data-index"), tag, outline(tag, source.attrib), list(transform), width * scale if stroke else 0.0, fill, stroke

    def elements(self) -> Iterator[tuple]:
        """The rows of the page in order."""
        for element in self.root.iter():
            if element is self.root or self.below_defs(element):
                continue
            tag = local(element.tag)
            if tag in _GEOMETRY:
                yield self.row(element, tag, None, self.placed(element), element)
            elif tag == "use":
                href = element.get("href") or next((v for k, v in element.attrib.items() if local(k) == "href"), "")
                target = self.by_id.get(href[1:]) if href.startswith("#") else None
                if target is None:
                    continue
                moved = (1.0, 0.0, 0.0, 1.0, number(element.get("x")), number(element.get("y")))
                placement = after(moved, self.placed(element))
                for source in target.iter():
                    if local(source.tag) in _GEOMETRY and (source is target or not self.below_defs(source, target)):
                        yield self.row(source, "use", href[1:], after(self.placed(source, target), placement), element)


def outline(tag: str, attributes: dict[str, str]) -> str:
    """The attributes that draw an element, as path data; '' if it draws nothing."""
    of = lambda name: number(attributes.get(name))
    if tag == "path":
        return attributes.get("d", "")
    if tag == "line":
        return f"M {of('x1')!r} {of('y1')!r} L {of('x2')!r} {of('y2')!r}"
    if tag == "rect":
        x, y, w, h = map(of, ("x", "y", "width", "height"))
        return f"M {x!r} {y!r} L {x + w!r} {y!r} {x + w!r} {y + h!r} {x!r} {y + h!r} Z" if w > 0 and h > 0 else ""
    found = [float(v) for v in re.findall(_NUMBER, attributes.get("points", ""))]
    if len(found) < 4:
        return ""
    points = " ".join(f"{v!r}" for v in found[: len(found) // 2 * 2])
    return f"M {points}" + (" Z" if tag == "polygon" else "")


class Pen:
    """Draws path data into contours."""

    def __init__(self, samples: int = SAMPLES, filled: bool = False):
        self.samples, self.filled = samples, filled
        self.contours: list[tuple[list[complex], bool]] = []
        self.points: list[complex] | None = None
        self.at = self.start = 0j
        self.cubic: complex | None = None  # the last control point, if the last command had one of this kind
        self.quadratic: complex | None = None

    def finish(self, closed: bool = False) -> None:
        points, self.points = self.points, None
        if points is None or len(points) < 2:
            return
        closed = closed or (len(points) > 2 and abs(points[0] - points[-1]) ** 2 <= 1e-12) or (self.filled and _has_area(points))
        if closed and points[-1] != self.start:
            points.append(self.start)
        self.contours.append((points, closed))

    def move(self, to: complex) -> None:
        self.finish()
        self.at = self.start = to
        self.points = [to]
        self.cubic = self.quadratic = None

    def line(self, to: complex) -> None:
        self._held().append(to)
        self.at = to
        self.cubic = self.quadratic = None

    def curve(self, *controls: complex) -> None:
        """A Bézier curve of degree 2 or 3; the last control is its end."""
        t = np.arange(1, self.samples + 1) / self.samples
        if len(controls) == 3:
            b, c, d = controls
            points = (1 - t) ** 3 * self.at + 3 * (1 - t) ** 2 * t * b + 3 * (1 - t) * t**2 * c + t**3 * d
            self.cubic, self.quadratic = c, None
        else:
            b, d = controls
            points = (1 - t) ** 2 * self.at + 2 * (1 - t) * t * b + t**2 * d
            self.cubic, self.quadratic = None, b
        self._held().extend(points.tolist())
        self.at = d

    def arc(self, rx: float, ry: float, degrees: float, large: bool, sweep: bool, to: complex) -> None:
        """An elliptic arc, by its centre: both ends are turned into the axes of the ellipse and scaled to a unit circle."""
        held = self._held()
        rx, ry = abs(rx), abs(ry)
        if abs(self.at - to) ** 2 <= 1e-24:
            self.at = to
            self.cubic = self.quadratic = None
            return
        if rx <= 1e-12 or ry <= 1e-12:
            self.line(to)
            return
        turn = complex(math.cos(math.radians(degrees)), math.sin(math.radians(degrees)))
        half = (self.at - to) / 2 / turn
        unit = complex(half.real / rx, half.imag / ry)
        size = abs(unit)
        if size > 1:  # too small for the ends: scaled up
            rx, ry, unit = rx * size, ry * size, unit / size
            size = 1.0
        away = math.sqrt(max(0.0, 1 / size**2 - 1)) * (-1 if large == sweep else 1)
        centre = complex(unit.imag, -unit.real) * away
        begin, end = unit - centre, -unit - centre
        turned = math.atan2((begin.conjugate() * end).imag, (begin.conjugate() * end).real)
        if sweep and turned < 0:
            turned += 2 * math.pi
        elif not sweep and turned > 0:
            turned -= 2 * math.pi
        n = max(1, math.ceil(self.samples * abs(turned) / (math.pi / 2)))
        angle = math.atan2(begin.imag, begin.real) + turned * np.arange(1, n + 1) / n
        on = centre + np.cos(angle) + 1j * np.sin(angle)
        held.extend(((on.real * rx + 1j * on.imag * ry) * turn + (self.at + to) / 2).tolist())
        held[-1] = self.at = to
        self.cubic = self.quadratic = None

    def close(self) -> None:
        self.finish(closed=True)
        self.at = self.start
        self.cubic = self.quadratic = None

    def _held(self) -> list[complex]:
        if self.points is None:
            self.points = []
        return self.points


def _has_area(points: list[complex]) -> bool:
    p = np.array(points)
    box = float(np.ptp(p.real) * np.ptp(p.imag))
    area = abs(float(np.sum((p.conj() * np.roll(p, -1)).imag))) / 2
    return len(p) >= 3 and box > 1e-18 and area / box > 1e-8


def flatten(data: str, filled: bool = False, samples: int = SAMPLES) -> list[tuple[list[complex], bool]]:
    """The contours of path data, as points and whether each is closed. Open parts with an area are closed where they are
    filled."""
    pen, tokens, i = Pen(samples, filled), _TOKEN.findall(data), 0
    command = ""

    def value() -> float:
        nonlocal i
        i += 1
        return float(tokens[i - 1])

    def flag() -> bool:
        found = value()
        if found not in (0, 1):
            raise ValueError(f"arc flag {found}")
        return found == 1

    while i < len(tokens):
        if tokens[i].isalpha():
            command = tokens[i]
            i += 1
        kind, origin = command.upper(), pen.at if command.islower() else 0j
        point = lambda o=origin: o + complex(value(), value())  # noqa: B023, E731
        if kind == "M":
            pen.move(point())
            command = "l" if command == "m" else "L"
        elif kind == "L":
            pen.line(point())
        elif kind == "H":
            pen.line(complex(origin.real + value(), pen.at.imag))
        elif kind == "V":
            pen.line(complex(pen.at.real, origin.imag + value()))
        elif kind == "C":
            pen.curve(point(), point(), point())
        elif kind == "S":
            pen.curve(pen.at if pen.cubic is None else 2 * pen.at - pen.cubic, point(), point())
        elif kind == "Q":
            pen.curve(point(), point())
        elif kind == "T":
            pen.curve(pen.at if pen.quadratic is None else 2 * pen.at - pen.quadratic, point())
        elif kind == "A":
            pen.arc(value(), value(), value(), flag(), flag(), point())
        elif kind == "Z":
            pen.close()
            command = ""
        else:
            raise ValueError(f"path command {command!r}" if command else "numbers without a command")
    pen.finish()
    return pen.contours


def read_pages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(page, svg): each file's path and text."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("page"), F.col("value").alias("svg"))


def svg_elements(pages: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each drawn element of pages (keys, svg), in order by seq; a page that is no XML or whose transforms cannot
    be read has one row with an error."""
    names = [x.split()[0] for x in _ELEMENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                try:
                    rows = [(k, *row, None) for k, row in enumerate(Page(batch.column("svg")[i].as_py() or "").elements())]
                except (ET.ParseError, ValueError) as error:
                    rows = [(0, *[None] * 9, str(error))]
                for at in range(0, len(rows), 1000):
                    part = rows[at : at + 1000]
                    own = [pa.concat_arrays([batch.column(k).slice(i, 1)] * len(part)) for k in keys]
                    kinds = [pa.int32(), *[pa.string()] * 5, pa.list_(pa.float64()), pa.float64(), pa.bool_(), pa.bool_(), pa.string()]
                    columns = [pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*own, *columns], [*keys, *names])

    kinds = dict(pages.dtypes)
    return pages.select(*keys, "svg").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + _ELEMENT)


def flattened(elements: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """elements with contours in the page's coordinates instead of data and transform; bad path data gives an error."""
    kept = [c for c in elements.columns if c not in ("data", "transform", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contours, errors = [], []
            for data, transform, filled, error in zip(*(batch.column(c).to_pylist() for c in ("data", "transform", "has_fill", "error")), strict=True):
                drawn = []
                if error is None:
                    try:
                        drawn = flatten(data or "", bool(filled), samples)
                    except (ValueError, IndexError) as bad:
                        error = f"path data: {bad}"
                a, b, c, d, e, f = transform or _SAME
                contours.append([{"points": [{"x": a * p.real + c * p.imag + e, "y": b * p.real + d * p.imag + f} for p in points], "is_closed": closed} for points, closed in drawn])
                errors.append(error)
            kind = pa.list_(pa.struct([("points", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("is_closed", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(contours, kind), pa.array(errors, pa.string())], [*kept, "contours", "error"])

    kinds = dict(elements.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept)
    return elements.mapInArrow(run, f"{schema}, contours {CONTOURS}, error string")


def svg_shapes(pages: DataFrame, keys: list[str], samples: int = SAMPLES) -> tuple[DataFrame, DataFrame]:
    """The shapes of pages (keys, svg) and their errors.

    shapes: keys, shape_id (shape-1, shape-2, … in the order of the page), source_kind, source_id, data_index, contours,
    is_closed, stroke_width, has_fill, has_stroke, bounds. Elements that draw nothing are no shapes. Transforms of an
    element and all that hold it apply; stroke widths are scaled by the root mean square of their axes. errors: keys,
    error; a page with an error keeps its other shapes only if the error is one of path data.
    """
    elements = materialize(svg_elements(pages, keys), "elements")
    drawn = materialize(flattened(elements.repartition(*keys, "seq"), samples), "drawn")
    order = Window.partitionBy(*keys).orderBy("seq")
    shapes = drawn.where(F.col("error").isNull() & (F.size("contours") > 0)).withColumn("nth", F.row_number().over(order))
    whole = (F.size("contours") == 1) & F.element_at("contours", 1)["is_closed"]
    shapes = shapes.select(
        *keys, F.concat(F.lit("shape-"), F.col("nth").cast("string")).alias("shape_id"), "source_kind", "source_id", "data_index", "contours",
        whole.alias("is_closed"), "stroke_width", "has_fill", "has_stroke", bounds(F.col("contours")).alias("bounds"),
    )
    return shapes, drawn.where("error IS NOT NULL").select(*keys, "error")
